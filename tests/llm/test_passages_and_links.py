"""Benchmark passages and the Jaccard join against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_tables import SF_SMALL, awkward, empty  # noqa: F401

from tessera.llm import decontaminate, jaccard
from tessera.sources.tables import read_table


def _letters(text):
    return "".join(c for c in (text or "").lower() if c.isalnum())


def test_every_whole_passage_is_found(spark):
    docs, bench = read_table(spark, SF_SMALL, "documents"), read_table(spark, SF_SMALL, "benchmark")
    rows = decontaminate.find_passages(docs, bench).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    items = {r.item_id: r.text for r in bench.collect()}
    want = {(d, i) for d, t in texts.items() for i, p in items.items() if _letters(p) in _letters(t)}
    assert want and {(r.doc_id, r.item_id) for r in rows if r.edits == 0} == want
    assert {(r.doc_id, r.item_id) for r in rows} == want      # nothing else is near
    for r in rows:
        assert _letters(texts[r.doc_id][r.start:r.end]) == _letters(items[r.item_id])


def test_edited_passages_within_the_budget(spark):
    rnd = random.Random(2)
    items = [(r.item_id, r.text) for r in read_table(spark, SF_SMALL, "benchmark").collect()]
    index = decontaminate.PassageIndex.of(items, 8, 0.1)
    filler = [r.text for r in read_table(spark, SF_SMALL, "documents").limit(60).collect()]
    for _ in range(150):
        item, text = rnd.choice(items)
        chars = list(text)
        for _ in range(rnd.randrange(int(len(_letters(text)) * 0.1) + 1)):
            at = rnd.randrange(len(chars))
            chars[at:at + 1] = rnd.choice((["x"], [], [chars[at], "y"])) if len(chars) > 1 else chars
        before, after = rnd.choice(filler), rnd.choice(filler)
        hits = decontaminate.find_in([(1, f"{before} {''.join(chars)} {after}")], index)
        assert item in [h[1] for h in hits]


def _edits(passage, region):
    row = [0] * (len(region) + 1)
    for i, c in enumerate(passage, 1):
        new = [i]
        for j, r in enumerate(region, 1):
            new.append(min(row[j - 1] + (c != r), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_alignment_equals_the_plain_table():
    rnd = random.Random(3)
    for _ in range(200):
        passage = np.array([rnd.randrange(4) for _ in range(rnd.randrange(1, 12))], dtype=np.uint32)
        region = np.array([rnd.randrange(4) for _ in range(rnd.randrange(0, 20))], dtype=np.uint32)
        best = _edits(passage, region)
        hit = decontaminate.align(passage, region, len(passage))
        assert hit is not None and hit[2] == best
        assert best == 0 or decontaminate.align(passage, region, best - 1) is None
        a, b, e = hit
        assert _edits(passage, region[a:b]) == e


def test_blocks_windows_and_awkward_rows(spark, awkward, empty, monkeypatch):
    bench = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog near the old river bank"),
                                   (2, None), (3, ""), (4, "x"), (None, "springt über den faulen Hund am alten"),
                                   (5, "Der schnelle braune Fuchs springt über den faulen Hund"),
                                   (5, "Der schnelle braune Fuchs springt über den faulen Hund")], "item_id long, text string")
    for block_bytes in (1 << 20, 60):
        rows = decontaminate.find_passages(awkward, bench, block_bytes=block_bytes).collect()
        assert Counter((r.doc_id, r.item_id) for r in rows) == Counter({(0, 1): 3, (1, 1): 1, (None, 1): 1, (2, 5): 1, (2, None): 1})
    assert decontaminate.find_passages(empty, bench).collect() == []
    assert decontaminate.find_passages(awkward, bench.limit(0)).collect() == []
    clean = decontaminate.clean_of(awkward, bench)
    assert clean.columns == awkward.columns and clean.count() == awkward.count() - 6
    monkeypatch.setattr(decontaminate, "PORTION", 500)
    index = decontaminate.PassageIndex.of([(1, bench.first().text)], 8, 0.1)
    long = "zz yy " * 400 + bench.first().text + " qq" * 700 + bench.first().text
    assert [h[5] for h in decontaminate.find_in([(1, long)], index)] == [1.0, 1.0]


def test_gram_hashes_differ_and_agree():
    rnd = np.random.default_rng(5)
    points = np.concatenate([rnd.integers(97, 100, 300), rnd.integers(97, 100, 300)]).astype(np.uint32)
    for q in (1, 2, 3, 5, 8, 11):
        hashes = decontaminate.gram_hashes(points, q)
        seen = defaultdict(set)
        for i, h in enumerate(hashes.tolist()):
            seen[tuple(points[i:i + q])].add(h)
        assert len(hashes) == len(points) - q + 1
        assert all(len(s) == 1 for s in seen.values()) and len(set.union(*seen.values())) == len(seen)


def _components(rows, words, percent):
    """(doc_id, set size, smallest doc_id reached, links) of each row, by comparing all that share a shingle."""
    sets = []
    for r in rows:
        w = (r.text or "").encode().lower().split()
        sets.append({tuple(w[i:i + words]) for i in range(max(len(w) - words + 1, 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    index, links = defaultdict(list), Counter()
    for i, own in enumerate(sets):
        for j, n in Counter(j for t in own for j in index[t]).items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                root[find(i)] = find(j)
                links.update((i, j))
        for t in own:
            index[t].append(i)
    least = {}
    for i, r in enumerate(rows):
        if sets[i] and r.doc_id is not None:
            least[find(i)] = min(r.doc_id, least.get(find(i), r.doc_id))
    return Counter((r.doc_id, len(sets[i]), least.get(find(i), r.doc_id) if sets[i] else r.doc_id, links[i])
                   for i, r in enumerate(rows))


def _near_copies(spark):
    rnd = random.Random(7)
    base = [rnd.choice("abcdefghij") + rnd.choice("klmnop") + str(rnd.randrange(40)) for _ in range(150)]
    rows, n = [], 0
    for family in range(3):
        own = base[family * 10:] if family else base
        for _ in range(25):
            words = list(own)
            for _ in range(rnd.randrange(6)):
                words[rnd.randrange(len(words))] = f"new{rnd.randrange(10 ** 6)}"
            rows.append((n, " ".join(words)))
            n += 1
    chain = [f"c{i}" for i in range(120)]
    for i in range(6):  # each is near the next one only
        rows.append((n, " ".join(chain[i * 4:i * 4 + 90])))
        n += 1
    shared = " ".join(f"p{i}" for i in range(60))
    for i in range(40):  # a passage that many share
        rows.append((n, f"{shared} " + " ".join(f"u{i}x{j}" for j in range(rnd.randrange(10, 80)))))
        n += 1
    rows += [(n, "one two"), (n + 1, "ONE  two"), (n + 2, "one"), (n + 3, ""), (n + 4, None)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("words,percent,side", [(3, 90, 512), (5, 80, 8), (1, 50, 5)])
def test_components_equal_brute_force(spark, monkeypatch, words, percent, side):
    monkeypatch.setattr(jaccard, "SIDE", side)
    docs = _near_copies(spark)
    # with 3 bits most sets that differ have the name of another
    rows = jaccard.jaccard_report(docs, words, percent, 3 if side == 8 else 64).collect()
    assert Counter(tuple(r) for r in rows) == _components(docs.collect(), words, percent)


def test_awkward_components_and_one_of_each(spark, awkward, empty):
    rows = jaccard.jaccard_report(awkward, 3, 90).collect()
    assert Counter(tuple(r) for r in rows) == _components(awkward.collect(), 3, 90)
    kept = jaccard.one_of_each(awkward)
    assert kept.columns == awkward.columns
    ids = Counter(r.doc_id for r in kept.collect())
    # doc 0 stands for its repeats, doc 1 and the null one; 8 for 9; empty texts all stay
    assert ids == Counter([0, 2, 3, 4, 5, 6, 7, 8, 10, 11, 12, None])
    assert jaccard.jaccard_report(empty).collect() == [] and jaccard.one_of_each(empty).count() == 0


def test_connected_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (7, 7)]
    random.Random(1).shuffle(edges)
    df = spark.createDataFrame([(a, b) if a % 2 else (b, a) for a, b in edges], "a long, b long")
    got = {r.node: r.root for r in jaccard.connected(df).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 102: 100}
    assert jaccard.connected(df.limit(0)).count() == 0


def test_prefixes_share_what_links_need():
    rnd = np.random.default_rng(9)
    for _ in range(300):
        n = int(rnd.integers(10, 300))
        own = rnd.permutation(10 ** 6)[:n]
        drop = int(rnd.integers(0, max(1, n // 8)))
        other = np.concatenate([own[drop:], rnd.permutation(10 ** 6)[:drop] + 10 ** 6])
        shared = n - drop
        if 100 * shared >= 90 * (n + len(other) - shared):
            a = set(np.sort(own)[:jaccard.prefix_size(n, 90)])
            b = set(np.sort(other)[:jaccard.prefix_size(len(other), 90)])
            assert len(a & b) >= min(jaccard.shared_needed(n), jaccard.shared_needed(len(other)))
