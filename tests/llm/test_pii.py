"""Personal data: plain spans against the patterns as they stand, disguises, offsets."""

import hashlib
import re
import time

import pytest
from llm_tables import awkward, empty  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import pii

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def _luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == 1 and any(int(p) > 255 for p in m[0].split(".")) or kind == 2 and not (
                    12 <= len(digits) <= 19 and _luhn(digits)) or kind == 3 and not 9 <= len(digits) <= 15):
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


@given(st.text("a1@.+- (2)0%9é４", max_size=50))
@settings(max_examples=600, deadline=None)
def test_plain_spans_equal_the_patterns(text):
    assert pii.plain_spans(text) == _brute(text)
    plain = {(a, k, b) for a, k, b, new in pii.all_spans(text) if not new}
    assert plain == set(_brute(text))
    for a, _, b, _ in pii.all_spans(text):
        assert 0 <= a < b <= len(text)


@pytest.mark.parametrize("text,kind,found", [
    ("mail john [at] example [dot] com now", "email", "john [at] example [dot] com"),
    ("mail john dot doe at mail dot example dot com.", "email", "john dot doe at mail dot example dot com"),
    ("write to jоhn@exаmple.com today", "email", "jоhn@exаmple.com"),
    ("jane(at)example(dot)org", "email", "jane(at)example(dot)org"),
    ("john＠example．com", "email", "john＠example．com"),
    ("ask jane at example.com please", "email", "jane at example.com"),
    ("john @ example.com", "email", "john @ example.com"),
    ("jane\t@\texample.com", "email", "jane\t@\texample.com"),
    ("jane\u00a0@example.com", "email", "jane\u00a0@example.com"),
    ("JANE AT EXAMPLE.COM", "email", "JANE AT EXAMPLE.COM"),
    ("info{at}firma{punkt}de", "email", "info{at}firma{punkt}de"),
    ("ip 192 dot 168 dot 1 dot 1 end", "ip", "192 dot 168 dot 1 dot 1"),
    ("ip 10[.]0[.]0[.]1 end", "ip", "10[.]0[.]0[.]1"),
    ("ip one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
    ("card four one one one 1111 1111 1111 end", "card", "four one one one 1111 1111 1111"),
    ("card ４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
    ("card 4​111111111111111.", "card", "4​111111111111111"),
    ("call plus one five one seven five five five zero nine three eight", "phone",
     "plus one five one seven five five five zero nine three eight"),
    ("tel +44 20 seven nine four six zero nine five eight", "phone", "+44 20 seven nine four six zero nine five eight"),
])
def test_disguises_map_back_to_the_source(text, kind, found):
    own = [(pii.KINDS[k], text[a:b], new) for a, k, b, new in pii.all_spans(text)]
    assert (kind, found, True) in own


@pytest.mark.parametrize("text", [
    "He was at home. The dot on the i is at point five.", "thnt at andthwhat. Anesat of the dot and",
    "un deux trois quatre cinq", "one two three", "Version 1.2.3 of 2024-01-02, point 5",
    "Keep at it.Never stop.", "", "ñandú über École"])
def test_clean_texts_stay_clean(text):
    assert [s for s in pii.all_spans(text) if s[3]] == []


def test_rewriting_maps_every_place():
    done = pii.rewrite("ab XX cd YYYY e", iter([(3, 5, "1"), (9, 13, "")]))
    assert done.text == "ab 1 cd  e" and done.source(3, 4) == (3, 5) and done.source(0, 2) == (0, 2)
    assert done.source(5, 7) == (6, 8) and done.source(9, 10) == (14, 15)
    assert done.touches(3, 4) and not done.touches(5, 7)


def test_report(spark, awkward, empty):
    rows = pii.personal_data_report(awkward).collect()
    texts = awkward.collect()
    assert len(rows) == len(texts)
    own = next(r for r in rows if r.doc_id == 10)
    want = _brute(next(t.text for t in texts if t.doc_id == 10))
    joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
    assert own.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and own.spans == joined
    assert (own.n_email, own.n_phone, own.n_added) == (1, 1, 0)
    assert {r.spans for r in rows if r.doc_id in (3, 4, 5)} == {""}
    assert pii.personal_data_report(empty).collect() == []


@pytest.mark.parametrize("unit", ["1", "a", "1 ", "+", "1.", "a@", "a.", " dot ", "@", "[at]", " at ", "a at ", "a dot ", " [dot] ",
                                  "one ", "x @ y.", "one dot ", "at [at] a.", "( "])
def test_long_runs_take_linear_time(unit):
    took = []
    for size in (100_000, 800_000):
        text = "mail me x dot y " + unit * (size // len(unit)) + "@"
        began = time.process_time()
        pii.all_spans(text)
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0] + 1  # eight times the text; the square would be 64 times


def test_numbers_with_many_zeros():
    assert [s[1] for s in pii.plain_spans("0" * 6000 + "1.2.3.4")] == [1]


@given(st.lists(st.sampled_from(["jane", "AT", "at", "@", "x.Com", "y.DE", "DOT", "dot", "[at]", "(", ")", " ", "\t", "\n",
                                 "\u00a0", ".", "12", "Punkt", "org"]), max_size=9).map("".join))
@settings(max_examples=1500, deadline=None)
def test_the_guard_lets_all_through_that_has_signs(text):
    rewritten = pii.undisguised_signs(text).text
    assert rewritten == text or pii.has_signs(text, text.lower().translate(pii.PUNCTUATION).split())
