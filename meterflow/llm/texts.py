"""Helpers that several operators share: Arrow batches of texts, words as hashes, pieces of text for tokenizers."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of text that are worked on at once inside a task; one longer text is worked on alone.
CHUNK_BYTES = 1 << 20

#: Bytes of an Arrow batch sent to a task's Python worker, unless the session sets a number. Batches are held on both sides, and
#: the default of 10,000 rows or 64 MB lets two tasks of an executor hold hundreds of MB of texts they work on 1 MB at a time.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once for each application, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="meterflow-")) / "meterflow-source.zip"
    with zipfile.ZipFile(target, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def map_rows(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: StructType) -> DataFrame:
    """``mapInArrow`` for functions that give each output batch as a dict of columns."""
    ship(df.sparkSession)
    if df.sparkSession.conf.get(_BATCH_CONF, None) is None:
        df.sparkSession.conf.set(_BATCH_CONF, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for columns in fn(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[f.name], type=f.type, from_pandas=False) for f in arrow], schema=arrow
            )

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have ``limit`` bytes together, or one row that alone has more."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    if start < len(sizes):
        yield batch.slice(start)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit numbers (shift, multiply, shift)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _powers_of(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.cumprod(np.full(max(n, 1 << 16), base, dtype=np.uint64), dtype=np.uint64)
        # A single very long text must not leave its table behind.
        if n <= 2 * CHUNK_BYTES:
            _powers[name] = have
    return have


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of polynomial hashes and of its inverse, modulo 2**64."""
    return _powers_of("up", _BASE, n)[:n], _powers_of("down", _INVERSE, n)[:n]


#: Bytes that separate words: space and 0x09 to 0x0D.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(texts: list[str | None], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and for each text the number of its first word (one more at the end).

    Words are runs of bytes other than space and 0x09 to 0x0D. Distinct words are told apart by their bytes and hashed
    once by XXH3, which unlike a polynomial of the bytes has no words that are known to meet.
    """
    words = split_words([t.encode() if t else None for t in texts], lower)
    known = map(xxhash.xxh3_64_intdigest, words.distinct.to_pylist())
    hashes = np.fromiter(known, dtype=np.uint64, count=len(words.distinct))
    return hashes[words.codes], words.first.astype(np.int64)


#: White space other than a single space or line feed, the sign that stands for a space in pieces, and their neighbours.
_UNSAFE = ("  ", " \n", "\n ", *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000\u180e\ufeff\u2581",
           *map(chr, range(0x2000, 0x200C)))


def pieces(text: str) -> list[str] | None:
    """Parts between single spaces, or None where white space is such that parts can't be told apart safely.

    The tokenizers used here never join the end of a word with a following single
    space, so the parts can be encoded one by one. Texts with runs of spaces or
    rarer white space, or with a space at either end, are encoded whole.
    """
    if text.startswith(" ") or text.endswith(" ") or any(s in text for s in _UNSAFE):
        return None
    return text.split(" ")


class Words(NamedTuple):
    """The words of many texts: their numbers in a table of distinct words."""

    codes: np.ndarray  #: for each word its place in ``distinct``
    distinct: pa.Array  #: the distinct words as bytes
    first: np.ndarray  #: for each text the number of its first word, and the number of words at the end
    piece: np.ndarray  #: a number for each word that is the same for words with no break between them


#: Bytes that end a piece in phrase counts; space and tab only part words there.
BREAKS = np.zeros(256, dtype=bool)
BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True


def split_words(texts: list[bytes | None], lower: bool, breaks: np.ndarray | None = None) -> Words:
    """Words of UTF-8 texts, told apart by their bytes and not by a hash.

    Words are runs of bytes other than space, 0x09 to 0x0D and ``breaks``. All of these are ASCII, so no
    character is cut. ``lower`` lower-cases A-Z only.
    """
    raw = [t or b"" for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
    if lower:
        data = _LOWER[data]
    apart = SPACES if breaks is None else SPACES | breaks
    inside = ~apart[data]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    starts = np.flatnonzero(edge == 1)
    ends = np.flatnonzero(edge == -1)  # each text ends with a separator
    offsets = np.zeros(len(starts) + 1, dtype=np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    packed = pa.py_buffer(np.ascontiguousarray(data[inside]))
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), packed]).dictionary_encode()
    bounds = np.cumsum(np.array([0, *(len(r) + 1 for r in raw)], dtype=np.int64))
    piece = np.zeros(len(starts), dtype=np.int64)
    if breaks is not None and len(starts):
        piece = np.cumsum(breaks[data])[starts]
    return Words(words.indices.to_numpy().astype(np.int64), words.dictionary, np.searchsorted(starts, bounds), piece)


def bytes_column(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()
