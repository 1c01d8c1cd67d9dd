"""Benchmark decontamination by templates: numbers, names and units become typed placeholders before windows are joined."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from meterflow.llm.texts import map_rows, mix, powers, slices
from meterflow.session import small_side, written

#: Words of a window; an item with fewer is one window.
WINDOW = 8

#: Words of a window that have to be plain ones, as a share; windows of an item with fewer are compared by their literal words, and
#: by their template once they are as much longer as it takes to hold as many plain words.
PLAIN = 0.5

#: Size that stands for such longer windows.
WIDE = 0

#: Windows of the benchmark up to which documents are searched for them before the join.
MAX_KNOWN = 2_000_000

#: Units of measurement, read as such after a number (fixed values).
UNITS = (
    "mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz ounce ounces pound pounds "
    "ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week "
    "weeks month months year years percent dollar dollars cent cents euro euros usd eur gbp kb mb gb tb hz khz mhz ghz w kw "
    "kwh v a j kj cal kcal mph kph meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms"
).split()

NUMBER, NAME, UNIT = np.uint64(1), np.uint64(2), np.uint64(3)

WINDOWS = StructType(
    [
        StructField("id", LongType()),
        StructField("hash", LongType(), False),
        StructField("size", IntegerType(), False),
        StructField("at", IntegerType(), False),
        StructField("literal", BooleanType(), False),
        StructField("slots", ArrayType(LongType(), False), False),
    ]
)

PLACES = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("item_id", LongType()),
        StructField("place", IntegerType(), False),
        StructField("literal", BooleanType(), False),
        StructField("wide", BooleanType(), False),
        StructField("changed", BooleanType(), False),
    ]
)

# Classes of bytes: 0 separates, 1 letter (all of a multi-byte character counts as letters), 2 digit.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?\n:")] = True
_POINT = np.zeros(256, dtype=bool)
_POINT[list(b".,")] = True


# Letters whose lower case has another length in UTF-8; there are none beyond the first plane.
_ODD = re.compile("([" + "".join(c for c in map(chr, [*range(0xD800), *range(0xE000, 0x10000)]) if len(c.lower().encode()) != len(c.encode())) + "])")


def _spelling(text: str) -> bytes:
    """The bytes of a text, as long as those of its lower case; of odd letters a byte that is no text, and the rest of their lower case."""
    parts = _ODD.split(text)
    parts[1::2] = [c.lower() for c in parts[1::2]]
    return b"".join(b"\xff" + x.encode()[1:] if i % 2 else x.encode() for i, x in enumerate(parts))


def _hash_runs(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:], dtype=np.uint64)
        return mix((total[stops] - total[starts]) * down[starts])


_unit_hashes: np.ndarray | None = None


def _units() -> np.ndarray:
    global _unit_hashes
    if _unit_hashes is None:
        data = np.frombuffer(" ".join(UNITS).encode(), dtype=np.uint8)
        gap = np.flatnonzero(data == 32)
        _unit_hashes = np.sort(_hash_runs(data, np.concatenate([[0], gap + 1]), np.concatenate([gap, [len(data)]])))
    return _unit_hashes


def template(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts as values (hash in lower case) and as template symbols, which are placeholders, and the first word of each text.

    Numbers (with points and commas inside) are one symbol, a unit right after a number another, a word in
    capital-and-small spelling that doesn't begin a sentence a third. Other words are their hash. Sentences begin
    after ``. ! ? :`` and line feeds.
    """
    raw, low = [], []
    for t in texts:
        raw.append(_spelling(t or ""))
        low.append((t or "").lower().encode())
    ends = np.cumsum(np.array([len(r) + 1 for r in raw], dtype=np.int64))
    data, lower = (np.frombuffer(b"\n".join([*x, b""]), dtype=np.uint8) for x in (raw, low))
    if not len(data):
        nothing = np.zeros(0, dtype=np.uint64)
        return nothing, nothing, np.zeros(0, bool), np.zeros(len(texts) + 1, np.int64)
    kind = _CLASS[lower]
    # General punctuation, such as curly quotes and dashes, separates words.
    sign = np.flatnonzero((lower[:-2] == 0xE2) & (lower[1:-1] == 0x80)) if len(lower) > 2 else np.zeros(0, np.int64)
    for k in range(3):
        kind[sign + k] = 0
    inner = np.flatnonzero(_POINT[lower[1:-1]] & (kind[:-2] == 2) & (kind[2:] == 2)) + 1
    kind[inner] = 2
    before = np.concatenate([[np.uint8(0)], kind[:-1]])
    starts = np.flatnonzero((kind != 0) & (kind != before))
    stops = np.flatnonzero((before != 0) & (kind != before))
    value = _hash_runs(lower, starts, stops)
    first = np.searchsorted(starts, np.concatenate([[0], ends])).astype(np.int64)
    number = kind[starts] == 2
    capital = data != lower
    stop = np.concatenate([[0], np.cumsum(_STOP[data])])
    previous = np.concatenate([[0], stops[:-1]])
    begins = stop[starts] > stop[previous]
    begins[first[:-1][first[:-1] < len(starts)]] = True
    caps = np.concatenate([[0], np.cumsum(capital)])
    # A capital first letter and small ones after it; the first letter may take two bytes.
    wide = np.where(data[starts] >= 0xC0, 2, 1)
    head = np.minimum(starts + wide, stops)
    name = ~number & ~begins & (caps[head] > caps[starts]) & (caps[stops] == caps[head]) & (stops > head)
    after_number = np.concatenate([[False], number[:-1]])
    after_number[first[:-1][first[:-1] < len(starts)]] = False
    known = _units()
    unit = ~number & after_number
    unit[unit] = known[np.minimum(np.searchsorted(known, value[unit]), len(known) - 1)] == value[unit]
    symbol = value.copy()
    symbol[number], symbol[name], symbol[unit] = NUMBER, NAME, UNIT
    return value, symbol, number | name | unit, first


_PLACES = np.random.default_rng(77).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _rolled(symbol: np.ndarray, size: int, literal: bool) -> np.ndarray:
    n = max(0, len(symbol) - size + 1)
    out = np.full(n, size + (WINDOW + 1) * literal, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out += symbol[j : n + j] * _PLACES[j]
    return mix(out)


def _wide(symbol: np.ndarray, slot: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and hash of the stretches of one text from a plain word to the next but so many, where these are longer than a window.

    A word lies in no more of them than a window needs plain words, so they take time and memory in proportion to the text.
    """
    plain = np.flatnonzero(~slot)
    needed = int(np.ceil(PLAIN * WINDOW))
    begin, end = plain[: max(0, len(plain) - needed + 1)], plain[needed - 1 :] + 1
    ok = (owner[begin] == owner[end - 1]) & (end - begin > WINDOW)
    begin, end = begin[ok], end[ok]
    if not len(begin):
        return begin, end, np.zeros(0, dtype=np.uint64)
    length = end - begin
    starts = np.cumsum(length) - length
    place = np.arange(length.sum()) - np.repeat(starts, length)
    with np.errstate(over="ignore"):
        words = mix(symbol[np.repeat(begin, length) + place] + mix(place.astype(np.uint64) + np.uint64(1)))
        return begin, end, mix(np.add.reduceat(words, starts) + length.astype(np.uint64))


def _windows(sizes: list[tuple[int, bool]], known, by_item: bool):
    """Windows of each text, for each number of words and whether they are literal, whose hash is in ``known`` (all if that is None).

    Items have literal windows where there are too few plain words, and wide ones from a plain word on; documents have literal windows everywhere, as the same words may be placeholders
    or not by their spelling and what stands before them. A literal window has no placeholders.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hashes, table = known.value if known is not None else (None, None)
        for batch in batches:
            for part in slices(batch, "text"):
                value, symbol, slot, first = template(part.column("text").to_pylist())
                ids = part.column("id").to_numpy(zero_copy_only=False) if not part.column("id").null_count else None
                id_list = part.column("id").to_pylist() if ids is None else None
                owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
                slots_before = np.concatenate([[0], np.cumsum(slot)])
                for size, literal in sizes:
                    if size == WIDE:
                        at, end, h = _wide(symbol, slot, owner)
                    else:
                        h = _rolled(value if literal else symbol, size, literal)
                        at = np.arange(len(h))
                        end = at + size
                    if table is not None:
                        ok = np.flatnonzero(table[(h & np.uint64(len(table) - 1)).astype(np.int64)])
                        ok = ok[hashes[np.minimum(np.searchsorted(hashes, h[ok]), len(hashes) - 1)] == h[ok]]
                        at, end, h = at[ok], end[ok], h[ok]
                    if size != WIDE:
                        ok = owner[at] == owner[end - 1]
                        if by_item:
                            # An item has windows of the full size, or one of its own size if it is shorter.
                            length = np.diff(first)[owner[at]]
                            ok &= (size == WINDOW) & (length >= size) | (size < WINDOW) & (length == size)
                        if by_item or not literal:
                            ok &= (slots_before[end] - slots_before[at] > (1 - PLAIN) * size) == literal
                        at, end, h = at[ok], end[ok], h[ok]
                    if not len(at):
                        continue
                    held = np.zeros(len(at), np.int64) if literal else slots_before[end] - slots_before[at]
                    values = [value[a:b][slot[a:b]] for a, b in zip(at[held > 0], end[held > 0], strict=True)]
                    flat = np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)
                    owners = owner[at]
                    yield {
                        "id": ids[owners] if ids is not None else [id_list[i] for i in owners.tolist()],
                        "hash": h.view(np.int64),
                        "size": np.full(len(at), size, dtype=np.int32),
                        "at": (at - first[owners]).astype(np.int32),
                        "literal": np.full(len(at), literal),
                        "slots": pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(held)]).astype(np.int32), flat),
                    }

    return run


def _known(items: DataFrame, windows: int):
    """Sorted hashes of all windows of the benchmark and a table of their low bits, or None where there are too many."""
    if windows > MAX_KNOWN:
        return None
    rows = items.select("hash").distinct().toPandas()["hash"].to_numpy(dtype=np.int64).view(np.uint64)
    hashes = np.sort(rows)
    table = np.zeros(1 << max(16, int(np.ceil(np.log2(max(1, len(hashes)) * 64)))), dtype=bool)
    table[(hashes & np.uint64(len(table) - 1)).astype(np.int64)] = True
    if not len(hashes):
        hashes = np.zeros(1, dtype=np.uint64)
    return items.sparkSession.sparkContext.broadcast((hashes, table))


def _agreeing(windows: list[tuple]) -> list[tuple]:
    """The windows of one passage whose placeholders agree with the rest of it.

    They are given as place, values of the item, values of the document, and whatever follows.

    A value of the item stands for its most frequent counterpart, the smallest of equals; windows where it has another one don't
    agree. Different values may share a counterpart, unless that is so in most of the windows with placeholders. Windows without
    placeholders always agree.
    """
    counts: dict[int, Counter] = defaultdict(Counter)
    for _, own, other, *_ in windows:
        for a, b in zip(own, other, strict=True):
            counts[a][b] += 1
    main = {a: min(c, key=lambda b: (-c[b], b)) for a, c in counts.items()}
    good = [w for w in windows if all(main[a] == b for a, b in zip(w[1], w[2], strict=True))]
    stands = defaultdict(set)
    for _, own, other, *_ in good:
        for a, b in zip(own, other, strict=True):
            stands[b].add(a)
    shared = sum(any(len(stands[b]) > 1 for b in other) for _, _, other, *_ in good)
    return good if 2 * shared <= sum(bool(own) for _, own, *_ in good) else [w for w in good if not w[1]]


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in PLACES}
        for row in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "item_id", "windows", "wide")], strict=True):
            windows = [(w["item_at"], w["item_slots"], w["slots"], w["literal"]) for w in row[2]]
            changed = any(own != other for _, own, other, _ in windows)
            for place, _, _, literal in _agreeing(windows):
                for name, value in zip(out, (*row[:2], place, literal, row[3], changed), strict=True):
                    out[name].append(value)
        yield out


def contaminated(docs: DataFrame, benchmark: DataFrame, min_share: float = 0.3) -> DataFrame:
    """Documents that hold benchmark items, also with other numbers, names and units.

    ``docs`` has ``doc_id`` and ``text``, ``benchmark`` ``item_id`` and ``text``; other columns are ignored. A window of eight template
    words matches if all symbols are equal. Windows at one distance between item and document are one passage, in which windows
    count that hold no placeholder or whose values have the same counterparts as in most of it. Where most of its windows with
    placeholders hold a counterpart that different values share, only those without count. An item is in a document if ``min_share`` of
    its windows or more count.

    Returns a row for each pair found: ``doc_id, item_id, n_windows, n_matched, share, reworded`` (whether some value
    differs). Windows of more placeholders than plain words match by their literal words, and those that begin at a plain word also
    by their template up to the fourth plain word, judged as passages of their own. ``share`` is that of all windows, that of the templates or that of
    the templates of eight words, whichever is greatest; so an item of fewer than four plain words is found by exact copies only. Null and empty texts, and rows with null ids match nothing. Items or documents that repeat an id are taken as one. Empty tables give no rows.
    """
    items = benchmark.select(F.col("item_id").cast("bigint").alias("id"), "text").where(F.col("id").isNotNull())
    items = written(map_rows(items, _windows([(n, k) for n in range(1, WINDOW + 1) for k in (False, True)] + [(WIDE, False)], None, True), WINDOWS), "items")
    sizes, windows = items.agg(F.collect_set(F.struct("size", "literal")), F.count(F.lit(1))).first()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").where(F.col("id").isNotNull())
    # Few windows of documents are left if the benchmark's are known before; else all of them meet in the join.
    seen = map_rows(texts, _windows(sorted(map(tuple, sizes)), _known(items, windows), False), WINDOWS)
    right = small_side(items.select("hash", "size", "literal", F.col("id").alias("item_id"), F.col("at").alias("item_at"), F.col("slots").alias("item_slots")))
    hits = seen.withColumnRenamed("id", "doc_id").join(right, ["hash", "size", "literal"])
    # Repeated windows of one item at one distance are one row: a group has no more rows than its item has windows.
    wide = (F.col("size") == WIDE).alias("wide")
    passages = hits.groupBy("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("distance"), wide).agg(
        F.collect_set(F.struct("item_at", "item_slots", "slots", "literal")).alias("windows")
    )
    good = map_rows(passages.select("doc_id", "item_id", "windows", "wide"), _places, PLACES)

    def places(c: str, wide: Column) -> list[Column]:
        """Numbers of all windows, of templates, and of those of eight words."""
        return [F.countDistinct(c), F.countDistinct(F.when(~F.col("literal"), F.col(c))), F.countDistinct(F.when(~F.col("literal") & ~wide, F.col(c)))]

    def named(counts: list[Column], prefix: str) -> list[Column]:
        return [c.alias(f"{prefix}_{n}") for c, n in zip(counts, ("windows", "templates", "short"), strict=True)]

    found = good.groupBy("doc_id", "item_id").agg(*named(places("place", F.col("wide")), "matched"), F.max("changed").alias("reworded"))
    size_of = items.groupBy(F.col("id").alias("item_id")).agg(*named(places("at", F.col("size") == WIDE), "n"))
    # Literal windows can't be found with other values, so they don't lower the share of the others, nor do long templates that of short ones.
    of = [F.when(F.col(f"n_{n}") > 0, F.col(f"matched_{n}") / F.col(f"n_{n}")) for n in ("windows", "templates", "short")]
    share = F.greatest(*of)
    found = found.join(small_side(size_of), "item_id").withColumn("share", share).where(F.col("share") >= min_share)
    return found.select("doc_id", "item_id", "n_windows", F.col("matched_windows").alias("n_matched"), "share", F.col("reworded").cast(BooleanType()).alias("reworded"))


def without_benchmark(docs: DataFrame, benchmark: DataFrame, min_share: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns. Rows with a null id stay."""
    found = small_side(contaminated(docs, benchmark, min_share).select(F.col("doc_id").alias("_found")).distinct())
    return docs.join(found, docs["doc_id"] == found["_found"], "left_anti")
