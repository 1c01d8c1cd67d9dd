"""Repetition inside a text from its suffix array: maximal repeated substrings by longest-common-prefix intervals."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from meterflow.llm.texts import map_rows, slices, word_hashes

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

RESULT = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("n_words", LongType(), False),
        StructField("word_chars", LongType(), False),
        StructField("n_symbols", LongType(), False),
        StructField("n_dup_lines", LongType(), False),
        StructField("n_repeat_words", LongType(), False),
        StructField("base_failed", BooleanType(), False),
        StructField("kept", BooleanType(), False),
        StructField("repeat_fraction", DoubleType(), False),
        StructField("longest_repeat", LongType(), False),
        StructField("covered_fraction", DoubleType(), False),
        StructField("n_maximal_repeats", LongType(), False),
    ]
)

#: Shortest maximal repeat, in words, that counts towards the covered share.
SHORTEST = 4


def suffix_array(values: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Suffixes of all texts in order, their ranks, and the ranks by prefixes of 1, 2, 4, ... words.

    Prefix doubling over the words of many texts at once. ``text`` is the number of
    the text of each word; it is part of the first rank, so suffixes of different
    texts never share a prefix.
    """
    n = len(values)
    _, first = np.unique(values, return_inverse=True)
    key = text.astype(np.int64) * (int(first.max()) + 1 if n else 1) + first
    order = np.argsort(key, kind="stable")
    levels = []
    span = 1
    while True:
        sorted_key = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], (sorted_key[1:] != sorted_key[:-1]).astype(np.int64)]))
        levels.append(rank)
        if n == 0 or rank[order[-1]] == n - 1:
            return order, rank, levels
        # The second half of the longer prefix; 0 where the text has ended.
        second = np.zeros(n, dtype=np.int64)
        if span < n:
            same = text[span:] == text[:-span]
            second[:-span][same] = rank[span:][same] + 1
        key = rank * (n + 1) + second
        # Only suffixes whose rank is shared still need an order.
        open_ = np.zeros(n, dtype=bool)
        r = rank[order]
        tied = r[1:] == r[:-1]
        open_[1:] |= tied
        open_[:-1] |= tied
        at = np.flatnonzero(open_)
        order[at] = order[at][np.argsort(key[order[at]], kind="stable")]
        span *= 2


def neighbour_prefixes(order: np.ndarray, levels: list[np.ndarray], text: np.ndarray) -> np.ndarray:
    """Longest common prefix, in words, of each suffix with the one before it in order."""
    n = len(order)
    out = np.zeros(n, dtype=np.int64)
    if n < 2:
        return out
    at = np.arange(1, n)
    a, b = order[:-1].copy(), order[1:].copy()
    got = np.zeros(n - 1, dtype=np.int64)
    live = np.flatnonzero(text[a] == text[b])
    a, b, at = a[live], b[live], at[live]
    got = np.zeros(len(at), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        # A rank by 2**k words is only reached by suffixes that have equal words so far.
        x, y = a + got, b + got
        ok = np.minimum(n - x, n - y) > 0
        xs, ys = x[ok], y[ok]
        same = (levels[k][xs] == levels[k][ys]) & (text[xs] == text[a[ok]]) & (text[ys] == text[b[ok]])
        idx = np.flatnonzero(ok)[same]
        # Suffixes shorter than 2**k words have ranks of their own, so equal ranks mean equal full prefixes.
        got[idx] += 1 << k
    out[at] = got
    return out


def maximal_repeats(
    order: np.ndarray, lcp: np.ndarray, before: np.ndarray, shortest: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of the common-prefix array that are maximal repeats of ``shortest`` words or more, and what begins at each word.

    An interval is a run of suffixes in order with a common prefix that none beside the run has, so its repeat can't be
    extended to the right. It is maximal if the words ``before`` its suffixes (a number of its own where a text begins)
    are not all the same, so that it can't be extended to the left either. Returns the lengths of the
    maximal intervals, a suffix of each, and for each word the length of the innermost one its suffix is in (0: none). Time
    and memory are linear: a stack holds the open intervals, and each suffix is given its innermost one once.
    """
    n = len(order)
    begins = np.zeros(n, dtype=np.int64)
    high = np.flatnonzero(lcp >= shortest)
    if not len(high):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), begins
    # Places of the array at which an interval is open or has just ended; 0 closes what is open.
    places = np.union1d(high, np.minimum(high + 1, n))
    ends = np.append(np.where(lcp >= shortest, lcp, 0), 0)[places].tolist()
    lefts = before[order[places - 1]].tolist()
    lengths: list[int] = []
    members: list[int] = []
    given: list[int] = []
    given_length: list[int] = []
    stack: list[list[int]] = []  # length, first suffix, word before all of its suffixes (-1: several)
    free: list[int] = []  # suffixes in no maximal interval yet
    for k, common, left in zip(places.tolist(), ends, lefts, strict=True):
        first = k - 1
        free.append(first)
        while stack and stack[-1][0] > common:
            length, first, word = stack.pop()
            left = word if word == left else -1
            if left < 0:
                lengths.append(length)
                members.append(first)
                while free and free[-1] >= first:
                    given.append(free.pop())
                    given_length.append(length)
        if not common:
            free.clear()
        elif stack and stack[-1][0] == common:
            if stack[-1][2] != left:
                stack[-1][2] = -1
        else:
            stack.append([common, first, left])
    begins[order[given]] = given_length
    return np.array(lengths, dtype=np.int64), order[members], begins


def covered_words(begins: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    """Words of each text that lie in the union of the spans that begin at each word."""
    marks = np.zeros(len(begins) + 1, dtype=np.int64)
    at = np.flatnonzero(begins)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + begins[at], -1)
    return np.bincount(text, np.cumsum(marks[:-1]) > 0, n_texts).astype(np.int64)


def words_before(values: np.ndarray, text: np.ndarray) -> np.ndarray:
    """A number for the word before each word; the first word of each text has one that no other place has."""
    _, codes = np.unique(values, return_inverse=True)
    out = np.zeros(len(values), dtype=np.int64)
    out[1:] = codes[:-1]
    opens = np.flatnonzero(np.diff(text, prepend=-1))
    out[opens] = len(values) + np.arange(len(opens))
    return out


class Repeats(NamedTuple):
    """What is repeated in each of several texts."""

    in_windows: np.ndarray  #: words in windows that are found twice or more
    in_long: np.ndarray  #: words covered by repeats of a window or more
    covered: np.ndarray  #: words covered by maximal repeats of ``shortest`` words or more
    longest: np.ndarray  #: words of the longest repeat
    n_maximal: np.ndarray  #: distinct maximal repeats of ``shortest`` words or more


def repeats(values: np.ndarray, text: np.ndarray, n_texts: int, window: int, shortest: int = SHORTEST) -> Repeats:
    """Repeats inside each text; ``text`` is the number of the text of each word, in order.

    The suffix before or after a suffix in order shares its longest repeat, which tells whether its window is
    found again. The covered words come from the maximal repeats alone: any repeat is part of a maximal one.
    """
    zero = np.zeros(n_texts, dtype=np.int64)
    if not len(values):
        return Repeats(zero, zero, zero, zero, zero)
    order, _, levels = suffix_array(values, text)
    lcp = neighbour_prefixes(order, levels, text)
    longest = np.empty(len(values), dtype=np.int64)
    longest[order] = np.maximum(lcp, np.concatenate([lcp[1:], [0]]))
    most = zero.copy()
    np.maximum.at(most, text, longest)
    _, members, begins = maximal_repeats(order, lcp, words_before(values, text), shortest)
    return Repeats(
        covered_words(np.where(longest >= window, window, 0), text, n_texts),
        covered_words(np.where(longest >= window, longest, 0), text, n_texts),
        covered_words(begins, text, n_texts),
        most,
        np.bincount(text[members], minlength=n_texts).astype(np.int64),
    )


def _duplicate_lines(text: str) -> int:
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.strip(" \t\n\x0b\x0c\r"):
            seen.add(line)
    return n


def _measure(window: int, min_words: int, max_percent: int, shortest: int, max_fraction: float, max_longest: int):
    symbols = str.maketrans("", "", SYMBOLS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                hashes, first = word_hashes(texts, lower=False)
                n_words = np.diff(first)
                owner = np.repeat(np.arange(len(texts)), n_words)
                found = repeats(hashes, owner, len(texts), window, shortest)
                failed = (n_words < min_words) | (100 * found.in_windows > max_percent * n_words)
                covered = found.covered / np.maximum(n_words, 1)
                chars = [len(t) - sum(map(t.count, " \t\n\x0b\x0c\r")) for t in texts]
                yield {
                    "doc_id": part.column("doc_id"),
                    "n_words": n_words,
                    "word_chars": np.array(chars, dtype=np.int64),
                    "n_symbols": np.array([len(t) - len(t.translate(symbols)) for t in texts], dtype=np.int64),
                    "n_dup_lines": np.array([_duplicate_lines(t) for t in texts], dtype=np.int64),
                    "n_repeat_words": found.in_windows,
                    "base_failed": failed,
                    "kept": ~failed & (covered <= max_fraction) & (found.longest <= max_longest),
                    "repeat_fraction": found.in_long / np.maximum(n_words, 1),
                    "longest_repeat": found.longest,
                    "covered_fraction": covered,
                    "n_maximal_repeats": found.n_maximal,
                }

    return run


def repetition_rules(
    docs: DataFrame,
    window: int = 8,
    min_words: int = 20,
    max_percent: int = 30,
    shortest: int = SHORTEST,
    max_fraction: float = 0.4,
    max_longest: int = 100,
) -> DataFrame:
    """Counts and verdict of every text of ``docs`` (``doc_id``, ``text``; other columns are ignored).

    A text fails the base rule with under ``min_words`` words or more than ``max_percent`` percent of them
    in windows of ``window`` words found twice. It fails the suffix-array rule if maximal repeats of
    ``shortest`` words or more (``n_maximal_repeats`` of them) cover more than ``max_fraction`` of its words, or the longest
    repeat has more than ``max_longest`` words; limits may be met. ``repeat_fraction`` is the share in repeats of ``window`` words or more.
    Null and empty texts have no words and fail. Texts of any length are worked on whole, those over 1 MB alone, in memory in
    proportion to their words. Rows are judged one by one, so repeated rows get equal results and an empty
    table none. Words are compared by 64-bit hashes.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_rows(rows, _measure(window, min_words, max_percent, shortest, max_fraction, max_longest), RESULT)
