"""What a batch of texts holds, told by one pass an expression (RE2, by Arrow) or by numpy, for tests that would cost a pass a word in an expression."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import patterns as P

_WORD_POINTS: list[bytes] = []


def word_points(spark: SparkSession) -> bytes:
    r"""The code points that \w of the JVM's expressions (with U) stands for, a bit each; asked once a process."""
    if not _WORD_POINTS:
        points = spark.range(0x110000).where("id NOT BETWEEN 55296 AND 57343")
        words = points.where(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").rlike(r"(?U)^\w$"))
        known = np.zeros(0x110000, bool)
        known[words.toArrow()["id"].to_numpy()] = True
        _WORD_POINTS.append(np.packbits(known).tobytes())
    return _WORD_POINTS[0]


def point_table(packed: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)


def words_of(text: str, word: np.ndarray) -> list[str]:
    r"""All matches of \w+(?:[.-]\w+)*; word: the table of word characters."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    inside = word[points]
    inner = (points[1:-1] == ord(".")) | (points[1:-1] == ord("-"))
    inner &= inside[:-2] & inside[2:]
    inside[1:-1] |= inner
    points = points.copy()
    points[~inside] = ord(" ")
    return points.tobytes().decode("utf-32-le").split()


def one_of(words: list[str]) -> str:
    """One alternation of plain words."""
    return "|".join(re.sub(r"([\\.^$*+?{}\[\]|()-])", r"\\\1", w) for w in words)


#: Letters that folded texts (functions.text.folded) write as one, in lower-cased texts.
_ALIKE = {"i": "[iı]", "s": "[sſ]"}


def one_of_folded(words: list[str]) -> str:
    """One alternation for lower-cased texts, true where the folded text holds one of the words."""
    return "|".join("".join((_ALIKE.get(c) or one_of([c])) + "\u0307*" for c in w) for w in words)


def for_lower_case(expression: str) -> str:
    """An expression of folded texts (letters, groups, \\d and \\s) for lower-cased texts: it has a match wherever the folded text has one."""
    parts = re.sub(r"\\.|\{[^}]*\}|[^\W\d_]", lambda m: m[0] if len(m[0]) > 1 else _ALIKE.get(m[0], m[0]) + "\u0307*", expression)
    return parts.replace(r"\s", r"[\s\x0b]")


def held(texts: pa.Array, expression: str) -> np.ndarray:
    """Whether each text has a match; false for nulls."""
    return pc.fill_null(pc.match_substring_regex(texts, expression), False).to_numpy(zero_copy_only=False)


def flags(tests: list[np.ndarray], rows: int) -> np.ndarray:
    """A number a text, with bit i set where test i is true."""
    out = np.zeros(rows, np.int64)
    for i, test in enumerate(tests):
        out |= test.astype(np.int64) << i
    return out


def bit(number: Column, i: int) -> Column:
    return number.bitwiseAND(F.lit(1 << i)) != 0


def _whole(texts: pa.Array) -> list[str]:
    return [(b or b"").decode("utf-8", "replace") for b in texts.cast(pa.binary()).to_pylist()]


#: Characters that the JVM too takes for part of a word; at least what is white space there with U.
PLAIN, SPACE = "a-z0-9_", r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


# --- Importance (T13) ------------------------------------------------------------------------------------------------


def _word_counts(texts: pa.Array) -> np.ndarray:
    r"""The number of matches of \S+ in each text."""
    if not len(texts):
        return np.zeros(0, np.int64)
    texts = texts.cast(pa.string())
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    ink = (data != 32) & ((data < 9) | (data > 13))
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    at = ends[:-1][np.diff(ends) > 0]
    first[at] = ink[at]
    places = np.flatnonzero(first)
    return np.diff(np.searchsorted(places, ends))


def _few_names(texts: pa.Array, most: int = 5) -> np.ndarray:
    """The number of distinct capitalised words that aren't common ones, up to which it counts; a text is read until it has so many."""
    name, out = re.compile("[A-ZÇĞİÖŞÜ][a-zçğıöşü]{2,}"), []
    for text in _whole(texts):
        names: set[str] = set()
        for match in name.finditer(text):
            if (word := match[0]) not in names and word not in P.NOT_ENTITIES:
                names.add(word)
                if len(names) == most:
                    break
        out.append(len(names))
    return np.array(out, np.int64)


def importance_signs(text: Column, low: Column, cues: tuple[list[str], ...]) -> Column:
    """Of each text and its lower-cased form a struct: words (\\S+, their number), names (distinct capitalised ones, up to 5) and held, whose bits tell
    which of the lists of T13 have a word in it (decisions, importance, tasks, operations), then which of the lists of folded cues."""
    plain = [one_of(ws) for ws in (P.DECISION_MARKERS, P.IMPORTANCE_MARKERS, P.TASK_MARKERS, P.OPS_MARKERS)]
    expressions = plain + [one_of_folded(ws) for ws in cues]

    @F.arrow_udf("words long, names long, held long")
    def signs(text: pa.Array, low: pa.Array) -> pa.Array:
        held_in = flags([held(low, e) for e in expressions], len(low))
        none = text.is_null().to_numpy(zero_copy_only=False)
        counts = [pa.array(c, pa.int64(), mask=none) for c in (_word_counts(text), _few_names(text))]
        return pa.StructArray.from_arrays([*counts, pa.array(held_in)], ["words", "names", "held"])

    return signs(text, low)


# --- Entities (T30) --------------------------------------------------------------------------------------------------


def _apart(text: str, word: str) -> bool:
    """Whether the word stands somewhere without one of PLAIN beside it."""
    joined = lambda c: c == "_" or (c.isascii() and c.isalnum())
    at = text.find(word)
    while at >= 0:
        if not (at and joined(text[at - 1])) and not joined(text[at + len(word) : at + len(word) + 1]):
            return True
        at = text.find(word, at + 1)
    return False


def apart(texts: pa.Array, words: list[str]) -> np.ndarray:
    """A number a lower-cased text: bit i is set where words[i] stands apart; texts that hold none apart are told by one pass."""
    out = np.zeros(len(texts), np.int64)
    some = np.flatnonzero(held(texts, f"(?:^|[^{PLAIN}])(?:{one_of(words)})(?:$|[^{PLAIN}])"))
    for row, text in zip(some, _whole(texts.take(pa.array(some))), strict=True):
        out[row] = sum(1 << i for i, word in enumerate(words) if _apart(text, word))
    return out


def entity_signs(text: Column, low: Column, tests: list[tuple[bool, str]], words: list[str]) -> Column:
    """Of each text and its lower-cased form a struct: held, whose bit i tells whether tests[i] (of the text itself if true, else of its lower-cased
    form) has a match, the last one whether a word stands apart; and apart, which has a bit for each of up to 63 words."""

    @F.arrow_udf("held long, apart long")
    def signs(text: pa.Array, low: pa.Array) -> pa.Array:
        alone = apart(low, words)
        found = flags([*(held(text if own else low, e) for own, e in tests), alone != 0], len(low))
        return pa.StructArray.from_arrays([pa.array(found), pa.array(alone)], ["held", "apart"])

    return signs(text, low)
