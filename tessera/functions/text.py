"""Text expressions, all JVM-side (no Python in the row path).

Python's ``str.strip`` and ``\\w`` are Unicode-aware while Spark's ``trim`` and
Java's ``\\s``/``\\w`` are not; the patterns below spell the Unicode classes out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources import literals as L

WORD_PATTERN = r"[\p{L}\p{N}_]+"
# The characters ``str.strip()`` removes, derived from Python's own rule, so
# that a native ``btrim`` strips exactly like the evaluated tool (and faster
# than a Unicode regex, whose notion of white space differs on U+001C-U+001F).
STRIP_CHARS = "".join(ch for ch in map(chr, range(0x110000)) if ch.isspace())


def normalize_newlines(text: Column) -> Column:
    """Universal newlines: ``\\r\\n`` and ``\\r`` become ``\\n``."""
    return F.regexp_replace(text, "\r\n?", "\n")


def strip(s: Column) -> Column:
    """Unicode whitespace strip at both ends, like ``str.strip()``."""
    return F.btrim(s, F.lit(STRIP_CHARS))


def nonblank_lines(text: Column) -> Column:
    """``array<string>`` of stripped, non-empty lines, in document order."""
    lines = F.split(normalize_newlines(F.coalesce(text, F.lit(""))), "\n", -1)
    return F.filter(F.transform(lines, strip), lambda l: F.length(l) > 0)


def is_header(line: Column) -> Column:
    """A short line not ending in a period."""
    return (F.length(line) < L.HEADER_MAX_CHARS) & ~line.endswith(".")


def words(s: Column) -> Column:
    """Lower-cased Unicode words, like ``re.findall(r'\\b\\w+\\b', s.lower())``."""
    return F.regexp_extract_all(F.lower(s), F.lit(WORD_PATTERN), 0)


def sentence_pieces(paragraph: Column) -> Column:
    """Split on ``[.!?]`` and strip; ``array<string>`` with empty pieces kept
    so that a piece's position is stable."""
    return F.transform(F.split(paragraph, L.SENTENCE_DELIMITERS, -1), strip)


def keep_sentence(piece: Column) -> Column:
    return F.length(piece) > L.SENTENCE_MIN_CHARS


def as_sentence(piece: Column) -> Column:
    return F.concat(piece, F.lit("."))


def topic_keywords(topic: Column) -> Column:
    """Words of a topic longer than 3 characters that are not stop words."""
    stop = F.array(*[F.lit(w) for w in L.KEYWORD_STOP_WORDS])
    return F.filter(words(topic),
                    lambda w: (F.length(w) > L.KEYWORD_MIN_CHARS) & ~F.array_contains(stop, w))


def any_keyword_in(sentence: Column, keywords: Column) -> Column:
    """True when some keyword occurs in the sentence (substring, lower-cased)."""
    low = F.lower(sentence)
    return F.exists(keywords, lambda k: F.contains(low, F.lower(k)))


def truthy_flag(flag: Column) -> Column:
    """Default-models switch: absent means true, else one of the true words."""
    accepted = [F.lit(v) for v in L.TRUE_FLAG_VALUES]
    return F.coalesce(F.lower(flag).isin(*accepted), F.lit(True))
