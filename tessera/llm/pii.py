"""Personal data in texts, also where it is disguised, with offsets kept.

Plain identifiers are found in the text as it is.  Transducers then rewrite
homoglyphs, spelled digits and at/dot disguises; each notes what it replaced,
so that an identifier found in the rewritten text is mapped back to the
characters of the source.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.compression import values

KINDS = ("email", "ip", "card", "phone")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match starts at the first digit of a run: what went before can't end within it.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @: the run of name characters before it, and the domain behind it."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of undisguised identifiers, leftmost and without overlap for each kind."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


class Rewritten(NamedTuple):
    """A text with the places where it was rewritten: starts and ends there and in the text before."""

    text: str
    edits: list[tuple[int, int, int, int]]  # new start, new end, old start, old end

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The span of the text before that became ``start`` to ``end``."""
        return self._old(start, False), self._old(end, True)

    def _old(self, at: int, closing: bool) -> int:
        i = bisect_right(self.edits, (at, -1 if closing else len(self.text) + 1)) - 1
        if i < 0:
            return at
        new_start, new_end, old_start, old_end = self.edits[i]
        if new_start <= at < new_end and not (closing and at == new_start):
            return old_end if closing else old_start
        return old_end + at - new_end

    def touches(self, start: int, end: int) -> bool:
        i = bisect_right(self.edits, (end, -1)) - 1
        return i >= 0 and self.edits[i][1] > start


def rewrite(text: str, matches: Iterator[tuple[int, int, str]]) -> Rewritten:
    """Replace each (start, end, by) of ``text``; they come in order and don't overlap."""
    parts, edits, done, shift = [], [], 0, 0
    for start, end, by in matches:
        parts += [text[done:start], by]
        edits.append((start + shift, start + shift + len(by), start, end))
        shift += len(by) - (end - start)
        done = end
    return Rewritten("".join(parts) + text[done:], edits)


#: Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("аеорсухіјѕԁһӏԛԝькмтвнАВЕКМНОРСТУХІЈЅαορντικυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
                      "aeopcyxijsdhlqwbkmtbhABEKMHOPCTYXIJSaopvtikuxABEZHIKMNOPTYX", strict=True))
INVISIBLE = "\xad​‌‍⁠﻿"
DASHES = "‐‑‒–—−"


def plain_form(char: str) -> str:
    """The ASCII character a non-ASCII one stands for; nothing for an invisible one; itself if it is no disguise."""
    if char in LOOKALIKES:
        return LOOKALIKES[char]
    if char in INVISIBLE:
        return ""
    if char in DASHES:
        return "-"
    if char in "。․∙•":
        return "."
    if (digit := unicodedata.digit(char, None)) is not None:
        return str(digit)
    folded = unicodedata.normalize("NFKC", char)
    return folded if len(folded) == 1 and folded.isascii() else char


NOT_ASCII = re.compile(r"[^\x00-\x7f]")
#: Latin letters with marks, which are no disguise.
WESTERN = re.compile("[^\x00-\x7f\xc0-ɏ]")


def unmask_letters(text: str) -> Rewritten:
    """Homoglyphs, digits and signs of other scripts, and invisible characters."""
    return rewrite(text, ((m.start(), m.end(), by) for m in NOT_ASCII.finditer(text) if (by := plain_form(m[0])) != m[0]))


#: Digits as words in English, German, French and Spanish.
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7",
    "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7",
    "ocho": "8", "nueve": "9",
}
_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_DOT = r"dot|punkt|punto|point"
#: Two digits or more, at least one of them a word, with little between; "dot" and "plus" may stand among them.
SPELLED = re.compile(rf"(?<!\w)(?:plus[\s-]+)?(?:(?:{_WORD})|[0-9]+)(?:(?:[\s,]{{0,2}}[\s.,-][\s]{{0,2}}(?:(?:{_DOT})[\s-]+)?)"
                     rf"(?:(?:{_WORD})(?!\w)|[0-9]+(?!\w)))+(?!\w)", re.I)
WORD = re.compile(rf"(?:(?P<dot>{_DOT})|(?P<plus>plus)|(?P<digit>{_WORD}))(?!\w)", re.I)


def spelled_digits(text: str) -> Rewritten:
    """Runs of digits of which some are words: the words as digits, without what stands between them."""
    def edits():
        for run in SPELLED.finditer(text):
            words = list(WORD.finditer(text, run.start(), run.end()))
            words = [w for w in words if not text[w.start() - 1:w.start()].isalnum() or w.start() == run.start()]
            if not any(w["digit"] for w in words):
                continue
            for i, w in enumerate(words):
                start = w.start()
                # from the token before to this one: white space and hyphens go
                while start > run.start() and text[start - 1] in " \t\n-,":
                    start -= 1
                if i and start < words[i - 1].end():
                    start = words[i - 1].end()
                end = w.end()
                nxt = words[i + 1].start() if i + 1 < len(words) else run.end()
                if nxt > end and text[end:nxt].strip(" \t\n-,") and text[end:nxt].strip(" \t\n-,")[0].isdigit():
                    while text[end] in " \t\n-,":
                        end += 1
                by = "." if w["dot"] else "+" if w["plus"] else DIGIT_WORDS[w["digit"].lower()]
                yield start, end, by
    return rewrite(text, edits())


_AT = r"at|arroba|arobase"
OPENING, CLOSING = "[({<", "])}>"
BRACKETED_DOT = rf"\s*[\[({{<]\s*(?:{_DOT}|\.)\s*[\])}}>]\s*"
#: The word or character of an at-sign, whatever stands around it.
AT_CORE = re.compile(rf"@|(?<!\w)(?:{_AT})(?!\w)", re.I)
NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+-")
DOMAIN_BEHIND = re.compile(rf"[A-Za-z0-9-]+(?:(?:{BRACKETED_DOT}|\s+(?:{_DOT})\s+|\.)[A-Za-z0-9-]+)+(?!\w)", re.I)
DOT_WORD = re.compile(rf"(?:{_DOT})\Z", re.I)
LONGEST_DOT = max(map(len, _DOT.split("|")))
#: Endings of domains that make a plain domain after "at" an address.
ENDINGS = frozenset("com org net edu gov io info de fr es uk eu".split())
DOT = re.compile(rf"{BRACKETED_DOT}|\s+(?:{_DOT})\s+", re.I)
NUMBER_DOT = re.compile(rf"(?<=[0-9])(?:{BRACKETED_DOT}|\s+(?:{_DOT})\s+)(?=[0-9])", re.I)
BRACKETED = re.compile(rf"[\[({{<]\s*(?:{_AT}|@|{_DOT}|\.)\s*[\])}}>]", re.I)
SIGN_WORDS = frozenset(_DOT.split("|"))
PLAIN_DOMAIN = re.compile(rf"\s(?:{_AT})\s+[A-Za-z0-9.-]*\.(?:{'|'.join(sorted(ENDINGS))})(?!\w)", re.I)


SPACED_AT = re.compile(r"\s@|@\s")


def has_signs(text: str, words: list[str]) -> bool:
    """Whether an at-sign or a dot may be disguised: a bracketed or spaced one, or one as a word."""
    low = text.lower()
    return (not SIGN_WORDS.isdisjoint(words) or "@" in text and SPACED_AT.search(text) is not None
            or any(b in text for b in "[({<") and BRACKETED.search(text) is not None
            or any(f".{e}" in low for e in ENDINGS) and PLAIN_DOMAIN.search(text) is not None)


def _before_space(text: str, at: int) -> int:
    while at and text[at - 1].isspace():
        at -= 1
    return at


def _after_space(text: str, at: int) -> int:
    while at < len(text) and text[at].isspace():
        at += 1
    return at


def _sign_around(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The whole at-sign of a core: with its brackets and the white space around; a bare word needs some on both sides."""
    low, high = _before_space(text, start), _after_space(text, end)
    if low and text[low - 1] in OPENING and text[high:high + 1] and text[high] in CLOSING:
        return _before_space(text, low - 1), _after_space(text, high + 1)
    return (low, high) if text[start] == "@" or low < start and high > end else None


def _dot_before(text: str, end: int) -> int | None:
    """Where a dot that ends at ``end``, plain, bracketed or as a word, starts."""
    if end and text[end - 1] == ".":
        return end - 1
    at = _before_space(text, end)
    closed = at and text[at - 1] in CLOSING
    last = _before_space(text, at - 1) if closed else at
    if closed and last and text[last - 1] == ".":
        first = last - 1
    elif m := DOT_WORD.search(text[max(0, last - LONGEST_DOT):last]):
        first = last - len(m[0])
    else:
        return None
    before = _before_space(text, first)
    if closed:
        return _before_space(text, before - 1) if before and text[before - 1] in OPENING else None
    return before if before < first and at < end else None


def _name_before(text: str, end: int, floor: int) -> int | None:
    """Where the name that ends at ``end`` starts, ``floor`` or later: its parts have dots, also disguised ones, between."""
    found = None
    while end is not None and end > floor:
        start = end
        while start > floor and text[start - 1] in NAME_CHARS:
            start -= 1
        if start == end:
            break
        if start == 0 or not (text[start - 1].isalnum() or text[start - 1] in "_%+-"):
            found = start
        end = _dot_before(text, start)
    return found


def _addresses(text: str) -> Iterator[tuple[int, int, int, int]]:
    """Start of the name, start and end of the at-sign, and end of the domain.

    Each at-sign is looked at once, from it to the left and to the right, so
    that the time is in proportion to the text.
    """
    done = 0
    for core in AT_CORE.finditer(text):
        if core.start() < done or (sign := _sign_around(text, *core.span())) is None:
            continue
        start = _name_before(text, sign[0], done)
        if start is not None and (domain := DOMAIN_BEHIND.match(text, sign[1])):
            done = domain.end()
            yield start, *sign, done


def undisguised_signs(text: str) -> Rewritten:
    """At-signs and dots of addresses that are words, bracketed or spaced."""
    def edits():
        found = []
        for start, low, high, end in _addresses(text):
            word_at = text[low:high].strip().lower() in _AT.split("|")
            if word_at and not DOT.search(text, high, end) and text[high:end].rpartition(".")[2].lower() not in ENDINGS:
                continue  # two sentences without a space between them look like this too
            if text[low:high] != "@":
                found.append((low, high, "@"))
            for part in ((start, low), (high, end)):
                found += [(d.start(), d.end(), ".") for d in DOT.finditer(text, *part)]
        taken = sorted((a, b) for a, b, _ in found)
        found += [(m.start(), m.end(), ".") for m in NUMBER_DOT.finditer(text)
                  if not _overlaps(taken, m.start(), m.end())]
        return sorted(found)
    return rewrite(text, iter(edits()))


def _overlaps(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether one of the spans, which come in order and don't overlap, takes in a part of this one."""
    i = bisect_right(spans, (end - 1, len(spans) and spans[-1][1])) - 1
    return i >= 0 and spans[i][1] > start


PUNCTUATION = str.maketrans(dict.fromkeys(".,;:!?()[]{}<>\"'|/-", " "))


def disguises(text: str) -> list:
    """The transducers that have something to do in this text, in their order."""
    out = []
    if not text.isascii() and WESTERN.search(text):
        out.append(unmask_letters)
        text = unmask_letters(text).text
    words = text.lower().translate(PUNCTUATION).split()
    if not DIGIT_WORDS.keys().isdisjoint(words) and SPELLED.search(text):
        out.append(spelled_digits)
        text = spelled_digits(text).text
    if has_signs(text, words):
        out.append(undisguised_signs)
    return out


def all_spans(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, added) of all identifiers in code points, by start, then kind.

    Added are those found in the rewritten text that take in something
    rewritten and lie within no plain identifier of their kind.
    """
    plain = plain_spans(text)
    out = [(*s, False) for s in plain]
    if steps := disguises(text):
        passes, now = [], text
        for step in steps:
            passes.append(step(now))
            now = passes[-1].text
        for start, kind, end in plain_spans(now):
            changed = False
            for done in reversed(passes):
                changed = changed or done.touches(start, end)
                start, end = done.source(start, end)
            if changed and not any(k == kind and a <= start and end <= b for a, k, b in plain):
                out.append((start, kind, end, True))
    return sorted(set(out))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("added", pa.bool_())]))


def personal_data(text: Column) -> Column:
    """Array of struct<kind, start, end, added>; a null text counts as empty."""
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([[{"kind": KINDS[k], "start": a, "end": b, "added": new} for a, k, b, new in all_spans(t)]
                            if t else [] for t in values(batch)], type=SPANS)

    return F.arrow_udf(find, "array<struct<kind: string, start: int, end: int, added: boolean>>")(text)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with ``spans``, the personal data of each whole text.

    A column of that name is replaced, all others pass through; every row is
    kept, and null and empty texts have no spans.
    """
    return docs.withColumn("spans", personal_data(F.col("text")))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


def personal_data_report(docs: DataFrame) -> DataFrame:
    """The query: counts and digest of the plain spans, and all spans."""
    found = find_personal_data(docs.select("doc_id", "text")).withColumn(
        "plain", F.filter("spans", lambda s: ~s["added"]))
    counts = [F.size(F.filter("plain", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("plain")), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"),
                        F.size(F.filter("spans", lambda s: s["added"])).cast("long").alias("n_added"))
