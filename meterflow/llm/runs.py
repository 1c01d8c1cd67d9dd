"""Periodic runs of words, found while the words pass by: lags at which the text repeats itself are kept with their match length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from meterflow.llm.texts import bytes_column, map_rows, slices, split_words

RUN = StructType([StructField(n, LongType(), False) for n in ("start", "length", "period")])
RESULT = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("n_words", LongType(), False),
        StructField("runs", ArrayType(RUN, False), False),
        StructField("collapsed", StringType(), False),
    ]
)

#: A run has at least so many words, and at least so many periods.
MIN_WORDS, MIN_PERIODS = 6, 4


def openings(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and lags at which the online pass begins to follow a diagonal, ordered by place.

    A lag q from s = 2**k up to 2 s - 1 ends with a run only if at least 3 q words in a row equal the word q
    before. That many words hold two neighbouring multiples of s at which the next s words agree with those q
    before. So at every s-th word the earlier occurrences of the word *together with the s - 1 words after it*
    are looked up, from s to 2 s - 1 words back: at most s of them, so the look-ups of one k are bounded by the
    number of words whatever they are. Words that begin no repeated stretch leave the tables early.
    """
    n = len(codes)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    local = np.arange(n) - first[owner]
    length = np.diff(first)[owner]
    where, lags = [], []
    place = np.arange(n)  # live places, by name and then by place
    _, name = np.unique(owner * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True)
    names = name.astype(np.int64)
    s = 1
    while True:
        # Names that occur twice or more; the others can't repeat with longer stretches either.
        counts = np.bincount(names, minlength=1)
        live = counts[names] > 1
        place, names = place[live], names[live]
        if not len(place):
            break
        order = np.argsort(names * np.int64(n) + place, kind="stable")
        place, names = place[order], names[order]
        key = names * np.int64(n) + place
        at = np.flatnonzero(local[place] % s == 0)
        base = names[at] * np.int64(n)
        low = np.searchsorted(key, base + np.maximum(place[at] - 2 * s + 1, 0))
        high = np.searchsorted(key, base + np.maximum(place[at] - s, -1), side="right")
        found = np.maximum(high - low, 0)
        i = np.repeat(place[at], found)
        j = place[np.repeat(low, found) + np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found)]
        q = i - j
        # Of neighbouring places with one lag the first opens the diagonal.
        pair = q * np.int64(n + 1) + i
        pair.sort()
        follows = np.isin(pair + s, pair, assume_unique=True)
        begins = follows & ~np.isin(pair - s, pair, assume_unique=True)
        where.append(pair[begins] % (n + 1))
        lags.append(pair[begins] // (n + 1))
        # Names of stretches of twice the length, of live places whose second half is live too and in the same text.
        full = np.full(n, -1, dtype=np.int64)
        full[place] = names
        place = np.sort(place)
        place = place[local[place] + 2 * s <= length[place]]
        place = place[full[place + s] >= 0]
        _, names = np.unique(full[place] * np.int64(n) + full[place + s], return_inverse=True)
        s *= 2
    if not where:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, q = np.concatenate(where), np.concatenate(lags)
    order = np.lexsort((q, i))
    return i[order], q[order]


def _primitive(words: list[int], start: int, period: int) -> bool:
    """Whether no shorter period that divides ``period`` repeats in the words."""
    rest, r = period, 2
    while rest > 1:
        if r * r > rest:
            r = rest
        if rest % r == 0:
            p = period // r
            if words[start : start + period - p] == words[start + p : start + period]:
                return False
            while rest % r == 0:
                rest //= r
        r += 1
    return True


def follow(words: list[int], opened: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of one text in one pass over its words.

    ``active`` holds the lags that match just now and for how many words. Each word lengthens the diagonals
    whose earlier word is the same; the others end there, and those long enough are a run at once.
    """
    runs: list[tuple[int, int, int]] = []
    active: dict[int, int] = {}

    def ended(lag: int, at: int) -> None:
        length = active.pop(lag) + lag
        start = at - length
        if length >= max(MIN_WORDS, MIN_PERIODS * lag) and _primitive(words, start, lag):
            runs.append((start, length, lag))

    i, todo, n = 0, 0, len(words)
    while i < n:
        if not active:
            if todo == len(opened):
                break
            i = opened[todo][0]
        word = words[i]
        for lag in [q for q in active if words[i - q] != word]:
            ended(lag, i)
        for lag in active:
            active[lag] += 1
        while todo < len(opened) and opened[todo][0] == i:
            lag = opened[todo][1]
            todo += 1
            # Not a lag that matches already, nor a multiple of one that has matched all the way back.
            if lag in active or any(lag % q == 0 and matched + q > lag for q, matched in active.items()):
                continue
            back = i - 1
            while back >= lag and words[back] == words[back - lag]:
                back -= 1
            active[lag] = i - back
        i += 1
    for lag in list(active):
        ended(lag, n)
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _repeat_tail(codes: np.ndarray, seed: int) -> np.ndarray:
    """The words from ``seed`` mod n on, replaced by repetitions of the first of them."""
    n = len(codes)
    a = seed % n
    p = 1 + (n - a) // (3 + seed % 8)
    out = codes.copy()
    out[a:] = np.resize(codes[a : a + p], n - a)
    return out


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for part in slices(batch, "text"):
            codes, distinct, first, _ = split_words(bytes_column(part, "text"), lower=False)
            seeds = part.column("seed").to_pylist()
            for k, seed in enumerate(seeds):
                if seed is not None and first[k + 1] > first[k]:
                    codes[first[k] : first[k + 1]] = _repeat_tail(codes[first[k] : first[k + 1]], seed)
            place, lag = openings(codes, first)
            cut = np.searchsorted(place, first)
            table = distinct.cast(pa.string()).to_pylist()
            runs, texts = [], []
            for k in range(len(seeds)):
                mine = codes[first[k] : first[k + 1]].tolist()
                if cut[k] == cut[k + 1]:
                    runs.append([])
                    texts.append(" ".join([table[c] for c in mine]))
                    continue
                opened = list(zip((place[cut[k] : cut[k + 1]] - first[k]).tolist(), lag[cut[k] : cut[k + 1]].tolist(), strict=True))
                got = follow(mine, opened)
                dropped = np.zeros(len(mine) + 1, dtype=np.int64)
                for start, length, period in got:
                    dropped[start + period] += 1
                    dropped[start + length] -= 1
                kept = (np.cumsum(dropped[:-1]) == 0).tolist()
                runs.append([{"start": s, "length": m, "period": p} for s, m, p in got])
                texts.append(" ".join([table[c] for c, keep in zip(mine, kept, strict=True) if keep]))
            yield {"doc_id": part.column("doc_id"), "n_words": np.diff(first), "runs": runs, "collapsed": texts}


def periodic_runs(docs: DataFrame, tail_seed: Column | None = None) -> DataFrame:
    """Periodic runs of the words of every text of ``docs`` (``doc_id``, ``text``; other columns are ignored).

    A run is a stretch of words with smallest period q, of at least ``MIN_WORDS`` words and ``MIN_PERIODS``
    periods, that can't be made longer in either direction. Returns ``doc_id``, ``n_words``, ``runs`` (by start,
    then period) and ``collapsed``: the words joined by one space, without those that a run holds after its
    first q words. Words are runs of characters other than space and 0x09 to 0x0D.

    ``tail_seed`` is a number for each row, or null: the words from place a = seed mod n on become repetitions
    of the first 1 + floor((n - a) / (3 + seed mod 8)) of them before runs are searched.

    Null and empty texts have no words, no runs and an empty ``collapsed``. Rows are judged one by one, so
    repeated rows give equal rows, null ids stay null and an empty table gives an empty one. Runs of equal start
    come by period. Very long texts are worked on whole; time is in proportion to n log n words, memory to n.
    """
    seed = F.lit(None) if tail_seed is None else tail_seed
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", seed.cast("bigint").alias("seed"))
    return map_rows(rows, _find, RESULT)


__all__ = ["MIN_PERIODS", "MIN_WORDS", "follow", "openings", "periodic_runs"]
