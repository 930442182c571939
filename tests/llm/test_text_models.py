"""Language, quality and language-model scores."""

import math
import zlib
from collections import Counter

import numpy as np
from llm_tables import SF_SMALL, awkward, empty  # noqa: F401

from pyspark.sql import functions as F

from tessera.llm import langid, lm_score, quality
from tessera.llm.compression import Compressors
from tessera.sources.tables import read_table

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_rows(spark):
    docs = read_table(spark, SF, "documents")
    langs = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = langid.held_out_languages(docs).collect()
    assert len(rows) == len(langs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    own = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in own]) > 0.95


def test_language_of_awkward_rows(spark, awkward, empty):
    rows = langid.identify_language(awkward, langid.learn_languages(read_table(spark, SF_SMALL, "documents"))).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        letters = any(map(str.isalpha, r.text or ""))
        assert (r.lang_pred == "und") == (not letters) and (letters or (r.score == 0 and r.rejected))
    assert next(r for r in rows if r.doc_id == 2).lang_pred == "de"
    none = langid.identify_language(awkward, {}).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert langid.held_out_languages(empty).collect() == []


def test_sizes_cover_the_whole_text():
    model = Compressors({"a": b"alpha beta gamma " * 50, "b": b"eins zwei drei vier " * 50}, segment=100)
    text = b"zzz " * 200 + b"eins zwei drei vier " * 100  # what tells stands late
    a, b = model.sizes(text)
    assert b < a and (model.sizes(text[:800]) < model.sizes(text)).all()


def test_quality_of_held_out_rows(spark):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    known = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality.held_out_quality(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    own = [(r.score, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    pairs = [(a, b) for a, x in own for b, y in own if x > y]
    assert np.mean([a > b for a, b in pairs]) > 0.95
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and docs.count() * 0.7 < kept.count() < docs.count()


def test_quality_of_awkward_rows(spark, awkward, empty):
    docs, labels = read_table(spark, SF_SMALL, "documents"), read_table(spark, SF_SMALL, "labels")
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 0), (3, None, None), (4, 7, 0)], labels.schema))
    model = quality.learn_quality(docs, odd)
    rows = quality.score_quality(awkward, model).collect()
    assert len(rows) == awkward.count() and len({r.score for r in rows if not r.text}) == 1
    none = quality.learn_quality(empty, labels)
    assert {r.score for r in quality.score_quality(awkward, none).collect()} == {0.5}
    assert quality.held_out_quality(empty, labels).collect() == []


def test_logistic_fit_separates_and_stays_finite():
    slope, intercept = quality.fit_logistic(np.array([-1.0, -0.5, 0.5, 1.0]), np.array([0, 0, 1, 1.0]))
    assert slope > 0 and math.isfinite(slope) and abs(intercept) < 1
    assert quality.fit_logistic(np.array([]), np.array([])) == (0.0, 0.0)


def _brute_base(rows):
    words = {}
    counts = Counter()
    for r in rows:
        own = [*(r.text or "").encode().lower().split(), None]
        words[id(r)] = own
        if zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 10:
            counts.update(own)
    n, v = sum(counts.values()), len(counts)
    return sorted((r.doc_id is None, r.doc_id or 0, len(words[id(r)]), sum(counts[w] > 0 for w in words[id(r)]), n,
                   round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words[id(r)]), 6))
                  for r in rows)


def test_base_score_is_exact(spark, awkward, empty):
    for docs in (awkward, read_table(spark, SF_SMALL, "documents")):
        rows = lm_score.language_model_report(docs).collect()
        got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
                     for r in rows)
        want = _brute_base(docs.collect())
        assert [g[:5] for g in got] == [w[:5] for w in want]
        np.testing.assert_allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
        assert all(r.score < 0 for r in rows)
    assert lm_score.language_model_report(empty).collect() == []


def test_rare_words_are_joined(spark, monkeypatch):
    docs = read_table(spark, SF_SMALL, "documents")
    monkeypatch.setattr(lm_score, "FREQUENT", 10)
    rows = lm_score.language_model_report(docs).collect()
    want = _brute_base(docs.collect())
    got = sorted((False, r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    np.testing.assert_allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)


def test_filter_gives_counts_back():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << lm_score.KEY_BITS, 5000, dtype=np.uint64))
    counts = rng.integers(1, 400, len(keys))
    steps = lm_score.steps_of(counts)
    bits, size = 8, 4096 * 8
    shape = lm_score.FrequencyFilter(bits, size, np.zeros(0, dtype=np.uint8))
    ranges = (keys >> np.uint64(lm_score.KEY_BITS - bits)).astype(int)
    parts = [shape.segment(keys[ranges == r], steps[ranges == r]) for r in range(1 << bits)]
    own = lm_score.FrequencyFilter(bits, size, np.concatenate(parts))
    got = own.steps(keys)
    assert (got >= steps).all() and (got == steps).mean() > 0.97     # never too low, seldom too high
    other = rng.integers(0, 1 << lm_score.KEY_BITS, 5000, dtype=np.uint64)
    assert (own.steps(other) > 0).mean() < 0.03
    exact = lm_score.MIDDLES[steps]
    assert (np.abs(exact / counts - 1) < 0.15).all()


def test_small_filter_leaves_out_the_rarest(spark):
    docs = read_table(spark, SF_SMALL, "documents").select("doc_id", "text")
    big, words = lm_score.learn_language_model(docs)
    small, _ = lm_score.learn_language_model(docs, filter_bytes=4096)
    assert small.filter.bits.nbytes <= 1 << 16 < big.filter.bits.nbytes
    top = words.orderBy("c", ascending=False).limit(5).collect()
    keys = lm_score.word_keys(np.array([r.token for r in top], dtype=np.int64).view(np.uint64))
    assert (small.filter.steps(keys) > 5).all()


def test_pairs_help_on_seen_text(spark):
    docs = read_table(spark, SF, "documents")
    rows = lm_score.language_model_report(docs).collect()
    for held in (False, True):
        own = [r for r in rows if r.held_out == held]
        assert sum(r.score for r in own) > sum(r.base_score for r in own)


def test_packed_counts_survive():
    keys = np.array([3, 9, 1 << 41, (1 << 48) - 1], dtype=np.uint64)
    counts = np.array([1, 80_000_000_000, 255, 254])
    shift = np.uint64(lm_score.KEY_BITS - 8)
    batch = lm_score._packed(keys, counts, shift)
    total = Counter()
    for r, k, c, x in zip(*(batch.column(i).to_pylist() for i in range(4))):
        for key, n in zip(lm_score._unpacked(k).tolist(), lm_score._whole(c, x).tolist()):
            total[key | r << int(shift)] += n
    assert total == dict(zip(keys.tolist(), counts.tolist()))


def test_what_the_filter_has_no_room_for_is_looked_up(spark, awkward, monkeypatch):
    monkeypatch.setattr(lm_score, "OPEN_HELD", 2000)    # several chunks
    for docs in (awkward, read_table(spark, SF_SMALL, "documents")):
        docs = lm_score.stored(docs.withColumn("held_out", lm_score.remainder("doc_id", 10) == 0))
        train = docs.where("not held_out").select("doc_id", "text")
        model, words = lm_score.learn_language_model(train, filter_bytes=64)
        whole, _ = lm_score.learn_language_model(train)
        assert model.partial and not whole.partial
        model, rows = lm_score.fit_and_score(docs, model, words)
        assert model.weight == lm_score.fit_and_score(docs, whole, words)[0].weight
        got = rows.collect()
        again = lm_score.score_texts(docs, model, words).collect()
        np.testing.assert_allclose(sorted(r.score for r in again), sorted(r.score for r in got))
        one, two = Counter(), Counter()
        for r in train.collect():
            own = lm_score.tokens_of(r.text)
            one.update(own.tolist())
            two.update(lm_score.pair_keys(lm_score.previous(own, np.array([0])), own).tolist())

        def middle(n):
            return lm_score.MIDDLES[lm_score.steps_of(np.array([n]))[0]]

        def middle_of_pair(n):  # 2 and 3, 4 to 7, 8 to 15, ...
            low = 2 ** int(math.log2(n)) if n > 1 else 0
            return math.sqrt(low * (2 * low - 1)) if low else 0

        fits = dict.fromkeys(lm_score.WEIGHTS, 0.0)     # of every training text, less its own count
        for r in train.collect():
            own = lm_score.tokens_of(r.text)
            keys, last = lm_score.pair_keys(lm_score.previous(own, np.array([0])), own).tolist(), lm_score.END
            for token, key in zip(own.tolist(), keys):
                before, pair, word = (max(n - 1, 0) for n in (middle(one[last]), middle_of_pair(two[key]), middle(one[token])))
                for weight in fits:
                    w = before / (before + weight)
                    fits[weight] += math.log10(w * min(pair / before if before else 0, 1) + (1 - w) * (word + 0.1) / model.total)
                last = token
        assert model.weight == max(fits, key=fits.get)
        want = []
        for r in docs.collect():
            own = lm_score.tokens_of(r.text)
            keys = lm_score.pair_keys(lm_score.previous(own, np.array([0])), own).tolist()
            score, last = 0.0, lm_score.END
            for token, key in zip(own.tolist(), keys):
                before, pair = middle(one[last]), middle_of_pair(two[key])
                w = before / (before + model.weight)
                score += math.log10(w * min(pair / before if before else 0, 1)
                                    + (1 - w) * (middle(one[token]) + 0.1) / model.total)
                last = token
            want.append((r.doc_id is None, r.doc_id or 0, len(own), score))
        got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.score) for r in got)
        want.sort()
        assert [g[:3] for g in got] == [w[:3] for w in want]
        np.testing.assert_allclose([g[3] for g in got], [w[3] for w in want], rtol=2e-3)


def test_columns_of_any_name_pass_through(spark, awkward):
    docs = awkward.withColumn("_x", F.lit("x")).withColumn("_lang", F.lit("y")).withColumn("_X_", F.lit(1))
    labels = spark.createDataFrame([(0, 1), (2, 0), (6, 1), (9, 0)], "doc_id long, quality int")
    model = quality.learn_quality(docs, labels)
    scored = quality.score_quality(docs, model)
    assert {c for c in docs.columns} <= set(scored.columns) and {r["_x"] for r in scored.collect()} == {"x"}
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= docs.count()
    named = langid.identify_language(docs, {"en": b"the quick", "de": b"der schnelle"})
    assert {r["_lang"] for r in named.collect()} == {"y"}


def plain_sizes(data, dictionaries, segment):
    import zstandard
    out = []
    for content in dictionaries.values():
        trained = zstandard.ZstdCompressionDict(content.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        total = 0
        for i in range(0, max(len(data), 1), segment):
            total += len(zstandard.ZstdCompressor(level=6, dict_data=trained, write_checksum=False, write_content_size=False,
                                                  write_dict_id=False).compress(data[i:i + segment]))
        out.append(total)
    return out


def test_languages_and_quality_equal_plain_loops(spark, awkward):
    small = read_table(spark, SF_SMALL, "documents")
    for docs in (awkward, small):
        marked = docs.withColumn("held_out", langid.remainder("doc_id", 4) == 2)
        model = langid.learn_languages(marked.where("not held_out"))
        want = Counter()
        for r in docs.collect():
            if not r.text or not any(map(str.isalpha, r.text)) or not model:
                want[r.doc_id, "und"] += 1
            else:
                sizes = plain_sizes(langid.letters(r.text), model, langid.SEGMENT)
                want[r.doc_id, list(model)[sizes.index(min(sizes))]] += 1
        assert Counter((r.doc_id, r.lang_pred) for r in langid.held_out_languages(docs).collect()) == want
    labels = read_table(spark, SF_SMALL, "labels")
    marked = small.withColumn("held_out", quality.remainder("doc_id", 5) == 0)
    model = quality.learn_quality(marked.where("not held_out"), labels)
    got = {r.doc_id: (r.score, r.predicted) for r in quality.held_out_quality(small, labels).collect()}
    for r in small.collect():
        data = (r.text or "").encode()
        bad, good = plain_sizes(data, {k: model.dictionaries[k] for k in ("0", "1")}, quality.SEGMENT)
        x = (bad - good) / len(data) if data else 0.0
        score = 1 / (1 + math.exp(-(x * model.slope + model.intercept)))
        assert abs(got[r.doc_id][0] - score) < 1e-9 and got[r.doc_id][1] == (score >= 0.3)


def test_hashes_of_words_agree_with_plain_words():
    import random

    import pyarrow as pa
    from tessera.llm.words import bytes_of, words_of
    rnd = random.Random(4)
    texts = ["", " ", "a", "A a", "x" * 256, "x" * 257 + " " + "X" * 257, "é\u00a0É\u2003b", "\t\n\x0b\x0c\r", "end", "of", ""]
    texts += ["".join(rnd.choice("aB \n\té\x1c") * rnd.randrange(1, 12) for _ in range(rnd.randrange(30))) for _ in range(300)]
    for column in (pa.array(texts), pa.array(texts, pa.large_string()).slice(3, 200), pa.array([], pa.string()), pa.array([""])):
        hashes, sizes = words_of(*bytes_of(column))
        plain = [t.encode().lower().split() for t in column.to_pylist()]
        assert sizes.tolist() == [len(p) for p in plain]
        seen = {}
        for word, h in zip((w for p in plain for w in p), hashes.tolist(), strict=True):
            assert seen.setdefault(word, h) == h
        assert len(set(seen.values())) == len(seen)
