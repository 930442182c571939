"""Token counts and packing against the tokenizer library."""

import zlib

import numpy as np
import pytest
from llm_tables import SF_SMALL, awkward, empty  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing, tokencount
from tessera.llm.tokencount import vocabulary
from tessera.sources.tables import read_table

tokenizers = pytest.importorskip("tokenizers")
BYTE, WORD = (tokenizers.Tokenizer.from_file(vocabulary(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
TEXTS = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("ab'sdt  \n\t\r\x0b\x0c\x1c\x85\xa0ßéÀ12.,!<|>")),
                max_size=80)


@given(TEXTS)
@settings(max_examples=300, deadline=None)
def test_counts_equal_the_library(text):
    assert tokencount.counter(vocabulary("byte_bpe_50k.json")).count(text) == \
        len(BYTE.encode(text, add_special_tokens=False).ids)


@given(st.lists(TEXTS, max_size=4))
@settings(max_examples=300, deadline=None)
def test_ids_equal_the_library(texts):
    got = packing.encoder(vocabulary("word_bpe_49k.json")).encode(texts)
    assert [np.frombuffer(g, dtype="<u4").tolist() for g in got] == \
        [WORD.encode(t, add_special_tokens=False).ids for t in texts]


def test_counts_of_documents(spark, awkward, empty):
    for docs in (awkward, read_table(spark, SF_SMALL, "documents")):
        rows = tokencount.count_tokens(docs).collect()
        assert len(rows) == docs.count()
        for r in rows:
            n = len(BYTE.encode(r.text or "", add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 1024)
    assert tokencount.count_tokens(empty).collect() == []


def test_merges_are_counted_lowest_rank_first():
    # a b c with (b c) before (a b): one merge, then a bc is no pair
    ranks = {1 << 32 | 2: 1, 2 << 32 | 3: 0}
    assert tokencount.merge_count([1, 2, 3], ranks, [9, 8]) == 2
    assert tokencount.merge_count([1, 1, 1], {1 << 32 | 1: 0}, [9]) == 2
    assert tokencount.merge_count([], ranks, []) == 0


def test_recent_forgets_but_computes_again():
    calls = []
    own = tokencount.Recent(lambda k: calls.append(k) or len(k), limit=2, longest=3)
    assert [own[k] for k in ("a", "bb", "ccc", "a", "dddd", "dddd")] == [1, 2, 3, 1, 4, 4]
    assert len(own) + len(own.old) <= 4 and calls.count("dddd") == 2


def _check_pieces(docs, pieces, window):
    texts = {}
    for r in docs:
        texts.setdefault(r.doc_id, []).append([*WORD.encode(r.text or "", add_special_tokens=False).ids, 2])
    by_doc, places = {}, {}
    for p in pieces:
        ids = np.frombuffer(p.ids, dtype="<u4").tolist()
        assert len(ids) == p.length
        by_doc.setdefault(p.doc_id, []).append((p.start, ids, p.doc_tokens))
        places.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window
    assert set(by_doc) == set(texts)
    for doc, own in by_doc.items():
        if len(texts[doc]) == 1:  # a repeated doc_id may mix its rows' pieces
            own.sort(key=lambda p: p[0])
            assert sum((ids for _, ids, _ in own), []) == texts[doc][0]
        assert sum(len(ids) for _, ids, _ in own) == sum(map(len, texts[doc]))
        assert {n for _, _, n in own} <= set(map(len, texts[doc]))
    return places


def test_packing_keeps_every_id(spark, awkward, empty):
    for docs in (awkward, read_table(spark, SF_SMALL, "documents").repartition(2)):
        pieces = packing.pack(docs, window=512).collect()
        places = _check_pieces(docs.collect(), pieces, 512)
        total = sum(n for own in places.values() for _, n in own)
        assert total / (512 * len(places)) > 0.95
    assert packing.pack(empty).collect() == []


def test_squares_choose_the_least_sum():
    packer = packing.SquaresPacker(10)
    rng = np.random.default_rng(4)
    for i, size in enumerate(rng.integers(1, 10, 400).tolist()):
        def after(level):
            n = packer.count.copy()
            if level:
                n[level] -= 1
            if level + size < 10:
                n[level + size] += 1
            return int((n ** 2).sum())
        options = [0] + [h for h in range(1, 10 - size + 1) if packer.count[h]]
        assert after(packer.level_for(size)) == min(map(after, options))
        packer.place((i, 0, b"\0\0\0\0" * size, size), size)
    assert (packer.count[1:10] == [sum(map(bool, packer.open.get(h, []))) for h in range(1, 10)]).all()


def test_crc_of_pieces(spark):
    from tessera.llm.queries import op6_packing
    rows = op6_packing(spark, SF_SMALL).collect()
    texts = {r.doc_id: r.text for r in read_table(spark, SF_SMALL, "documents").collect()}
    for r in rows[:50]:
        ids = np.array([*WORD.encode(texts[r.doc_id], add_special_tokens=False).ids, 2], dtype="<u4")
        assert zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32


def test_ids_of_older_words_are_not_merged_again(monkeypatch):
    own = packing.WordEncoder(vocabulary("word_bpe_49k.json"))
    own.words.limit, merged, encode = 4, [], own.merger.encode
    monkeypatch.setattr(own.merger, "encode", lambda words: merged.extend(words) or encode(words))
    texts = ["alpha beta gamma", "delta epsilon zeta", "Alpha, beta!", "\u00c4pfel \u2603 alpha"]
    got = [own.encode([t])[0] for t in texts]
    assert len(merged) == len(set(merged)) and {b"alpha", b"zeta", b"!"} <= set(merged)
    assert [np.frombuffer(g, dtype="<u4").tolist() for g in got] == [WORD.encode(t, add_special_tokens=False).ids for t in texts]
