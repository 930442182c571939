"""Source divergence, byte-pair coding and vector codes against plain loops, the tokenizer library and SQL."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_tables import SF_SMALL, awkward, empty  # noqa: F401

from tessera.llm import bpe, divergence, vector_codes
from tessera.llm.tokencount import vocabulary
from tessera.sources.tables import read_table

tokenizers = pytest.importorskip("tokenizers")
WORD = tokenizers.Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
TEXTS = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("ab'sdt  \n\t\r\x0b\x0c\x1c\x85\xa0ßéÀ12.,!<|>")),
                max_size=80)


def plain_audit(rows, least_docs, most_rank):
    groups, held = defaultdict(Counter), Counter()
    for lang, source, text in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        groups[lang, source].update(words)
        held.update((lang, w) for w in set(words))
    out = []
    for lang in {lang for lang, _ in groups}:
        kept = sorted(w for (x, w), n in held.items() if x == lang and n >= least_docs)
        own = {s: {w: c[w] for w in kept} for (x, s), c in groups.items() if x == lang}
        whole = {w: sum(c[w] for c in own.values()) for w in kept}

        def p(counts):
            total = sum(counts.values()) + 5 * len(kept)
            return {w: 1 + 1_000_000_000 * (n + 5) // total for w, n in counts.items()}

        q = p(whole)
        ps = {s: p(c) for s, c in own.items()}
        for s in own:
            pairs = [(sum(abs(ps[s][w] - ps[t][w]) for w in kept), t) for t in own if t != s]
            terms = [(ps[s][w] - q[w], w) for w in kept if own[s][w] > 0 and ps[s][w] > q[w]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, most_rank)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])]
    return sorted(out)


def test_audit_equals_plain_loops(spark, awkward, empty, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 7)
    monkeypatch.setattr(divergence, "TILE_SOURCES", 2)
    rng = random.Random(3)
    words = ["ab", "Cd", "é", "中文", "zz", "q", "x", "y1y", "ÀÉ", "ss"]
    rows = [(rng.choice(["en", None, "de", ""]), rng.choice(["a", "b", None, "c", "d", "é"]),
             rng.choice([None, ""] + [" ".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(6)]))
            for _ in range(300)] + [("fr", s, t) for s, t in (("one", "rare words"), ("two", None))] + [("it", "alone", "ab")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    plain = [tuple(x or "" for x in r) for r in rows]
    for least, most in ((30, 50), (3, 4), (1, 1), (10_000, 50)):
        got = sorted(tuple(r) for r in divergence.audit_sources(docs, least, most).collect())
        assert got == plain_audit(plain, least, most)
    for table in (awkward, awkward.unionAll(awkward)):
        given_rows = [(r.lang or "", r.source or "", r.text or "") for r in table.collect()]
        assert sorted(tuple(r) for r in divergence.audit_sources(table, 2).collect()) == plain_audit(given_rows, 2, 50)
    result = divergence.audit_sources(empty)
    assert result.collect() == [] and result.dtypes[-2:] == [("value", "bigint"), ("rank", "int")]


def test_audit_counts_beyond_64_bits(spark):
    rows = [("en", "a", "x", 5 * 10 ** 11, 9 * 10 ** 11, True), ("en", "b", "x", 4 * 10 ** 11, 9 * 10 ** 11, False),
            ("en", "a", "", 0, 0, True), ("en", "b", "", 0, 0, False), ("en", "a", "y", 7, 7, True)]
    kept = spark.createDataFrame(rows, "lang string, source string, term string, n long, lang_n long, first boolean")
    groups = divergence.groups_of(kept)
    p = lambda n, total: 1 + 10 ** 9 * (n + 5) // (total + 10)
    a, b = 5 * 10 ** 11 + 7, 4 * 10 ** 11
    want = abs(p(a - 7, a) - p(b, b)) + abs(p(7, a) - p(0, b))
    assert {r.value for r in divergence.source_distances(kept, groups).collect()} == {want}


@given(st.lists(TEXTS, max_size=4))
@settings(max_examples=300, deadline=None)
def test_ids_and_texts_equal_the_library(texts):
    own = bpe.coder(vocabulary("word_bpe_49k.json"))
    for text, ids in zip(texts, own.encode(texts)):
        want = WORD.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, dtype="<u4").tolist() == want
        assert own.decode(ids) == WORD.decode(want, skip_special_tokens=False)


def plain_merges(word, ranks, made):
    word = list(word)
    while True:
        found = [(ranks[x, y], i) for i, (x, y) in enumerate(zip(word, word[1:])) if (x, y) in ranks]
        if not found:
            return word
        r, i = min(found)
        word[i:i + 2] = [made[r]]


@pytest.mark.parametrize("seed", range(150))
def test_ranks_over_all_words_equal_merging_each(seed):
    rng = random.Random(seed)
    words = [[rng.randrange(3) for _ in range(rng.randrange(1, 30))] for _ in range(rng.randrange(1, 6))]
    pairs, symbols = [], [0, 1, 2]
    while len(pairs) < 12:  # every merge uses symbols made before it
        pair = (rng.choice(symbols), rng.choice(symbols))
        if pair not in pairs:
            pairs.append(pair)
            symbols.append(len(symbols))
    made = list(range(3, 15))
    table = bpe.MergeTable(*(np.array(x, dtype=np.int64) for x in (*zip(*pairs), made)))
    flat = np.array([x for w in words for x in (*w, -1)], dtype=np.int64)
    out, start = bpe.apply_ranks(flat, table), 0
    for w in words:
        part = out[start:start + len(w)]
        assert part[part >= 0].tolist() == plain_merges(w, {p: i for i, p in enumerate(pairs)}, made)
        start += len(w) + 1


def test_a_vocabulary_out_of_order_is_refused():
    with pytest.raises(ValueError):
        bpe.MergeTable(np.array([3, 1]), np.array([1, 2]), np.array([4, 3]))


def test_words_are_forgotten_and_long_ones_not_kept(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 5)
    own = bpe.PairIndexCoder(vocabulary("word_bpe_49k.json"))
    texts = ["one two three", "four five six seven", "one " + "longword" * 2000, "<|endoftext|> two", "one"]
    for text in texts * 2:
        assert np.frombuffer(own.encode([text])[0], dtype="<u4").tolist() == WORD.encode(text, add_special_tokens=False).ids
        assert len(own.words) <= 7 and max(map(len, own.words)) <= bpe.LONGEST_WORD


def test_coding_of_documents(spark, awkward, empty):
    for docs in (awkward, read_table(spark, SF_SMALL, "documents")):
        rows = bpe.code_documents(docs).collect()
        again = bpe.decode_documents(bpe.code_documents(docs, decode=False)).collect()
        assert Counter(tuple(r) for r in again) == Counter(tuple(r) for r in rows)
        report = Counter(tuple(r) for r in bpe.coding_report(docs).collect())
        want = Counter()
        for r in rows:
            ids = WORD.encode(r.text or "", add_special_tokens=False).ids
            decoded = WORD.decode(ids, skip_special_tokens=False)
            assert (np.frombuffer(r.ids, dtype="<u4").tolist(), r.n_tokens, r.decoded) == (ids, len(ids), decoded)
            want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(),
                 hashlib.sha256(decoded.encode()).hexdigest()] += 1
        assert report == want and sum(want.values()) == docs.count()
    assert bpe.coding_report(empty).collect() == []


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, label, [math.floor(x * 4096) for x in v]) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // parts
    cut = [[r[2][p * width:(p + 1) * width] for p in range(parts)] for r in kept]
    books = [[cut[e][p] for e in range(min(entries, len(cut)))] for p in range(parts)]
    best = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        near = [[best(v[p], books[p])[1] for p in range(parts)] for v in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p] for v, n in zip(cut, near) if n[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    final = [[best(v[p], books[p]) for p in range(parts)] for v in cut]
    errors = [sum(d for d, _ in f) for f in final]
    of_label = Counter()
    for r, e in zip(kept, errors):
        of_label[r[1]] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((r[0], "".join(f"{e:02x}" for _, e in f), err, of_label[r[1]], digest)
                   for r, f, err in zip(kept, final, errors))


def test_codes_equal_plain_loops(spark):
    rng = random.Random(5)
    vector = lambda: [round(rng.gauss(0, 0.3), 2) for _ in range(16)]
    rows = [(i, vector(), i % 3 if i % 4 else None) for i in range(120)]
    rows += [(rows[5][0], rows[5][1], 1), rows[7], rows[7], (None, vector(), 2), (500, None, 1), (501, [0.1] * 15 + [None], 1),
             (502, [float("nan")] + [0.0] * 15, 1), (503, [float("inf")] + [0.0] * 15, 0), (504, [-0.00001] * 16, 0)]
    schema = "vec_id long, embedding array<double>, label int"
    table = spark.createDataFrame(rows, schema).withColumnRenamed("label", "label").selectExpr(
        "*", "1 as codes", "2 as cells", "3 as of_label", "4 as tally").repartition(4)
    assert Counter(tuple(r) for r in vector_codes.vector_code_report(table).collect()) == plain_codes(rows)
    few = rows[:3]
    got = vector_codes.vector_code_report(spark.createDataFrame(few, schema)).collect()
    assert Counter(tuple(r) for r in got) == plain_codes(few)
    assert vector_codes.vector_code_report(spark.createDataFrame([], schema)).collect() == []
    odd = spark.createDataFrame([(1, [], 1), (2, [], None), (3, [1.0], 1)], schema)
    assert [(r.code, r.error) for r in vector_codes.vector_code_report(odd).collect()] == [("00" * 8, 0)] * 2
    with pytest.raises(ValueError):
        vector_codes.compress_vectors(spark.createDataFrame([(1, [1e9] * 8, 1)], schema))


@given(st.integers(0, 10 ** 6))
@settings(max_examples=60, deadline=None)
def test_active_entries_give_what_full_scans_give(seed):
    rng = np.random.default_rng(seed)
    cells = rng.integers(-3, 4, (40, 2, 2))
    books = rng.integers(-3, 4, (2, 5, 2))
    codes, distances = np.zeros((40, 2), dtype=np.int64), np.zeros((40, 2), dtype=np.int64)
    assert vector_codes.reassign(cells, books, np.ones((2, 5), dtype=bool), codes, distances) == 80
    for _ in range(4):
        moved = rng.random((2, 5)) < 0.4
        books = np.where(moved[:, :, None], rng.integers(-3, 4, books.shape), books)
        scanned = vector_codes.reassign(cells, books, moved, codes, distances)
        full = ((cells[:, :, None] - books[None]) ** 2).sum(axis=3)
        assert (codes == full.argmin(axis=2)).all() and (distances == full.min(axis=2)).all() and scanned <= 80


def test_sql_of_audit_and_codes(spark):
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_SMALL}/{name}.parquet')")
    for frame, sql in ((divergence.audit_sources(read_table(spark, SF_SMALL, "documents")), divergence.AUDIT_SQL),
                       (vector_codes.vector_code_report(read_table(spark, SF_SMALL, "embeddings")),
                        vector_codes.vector_code_sql())):
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        assert Counter(tuple(r) for r in frame.select(names).collect()) == Counter(found.fetchall())
