"""Mixture-controlled packing: every window of sequences holds each source in its target share.

Deficit round-robin visits the source queues once a window, adds each source's
share of the window to its credit, serves the whole tokens of the credit and
carries the rest. After a virtual time ``t`` a source of weight ``g`` has been
credited ``g * t`` tokens and served that number rounded, so the state of the
round-robin at any window follows from the window's number alone. Each task can
therefore cut its own documents, and the deficits carry over windows and
partitions without anything being passed from one to the next. A source that is
used up serves no more, and the others share its part by their weights.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from meterflow.llm.texts import map_rows, slices
from meterflow.session import small_side, written

#: Texts of each call that both encoders work on.
PROBES = 4

#: Sequences of one mixing window.
WINDOW_SEQUENCES = 64

TOKENS = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("source", StringType()),
        StructField("chunk", IntegerType(), False),
        StructField("begin", LongType(), False),
        StructField("doc_tokens", LongType(), False),
        StructField("ids", BinaryType(), False),
    ]
)

PIECES = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("start", LongType(), False),
        StructField("length", LongType(), False),
        StructField("ids_crc32", LongType(), False),
        StructField("doc_tokens", LongType(), False),
        StructField("sequence_id", LongType(), False),
        StructField("offset", LongType(), False),
        StructField("source", StringType()),
    ]
)


@functools.cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return model


#: Characters that stand for the bytes of a token in a byte-level vocabulary: printable ones for themselves, the
#: others in order from 256 on (fixed by the format).
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def _byte_ranks(path: str) -> dict[bytes, int] | None:
    """Tokens of a byte-level BPE file as bytes with their ids, if merging by smallest id is what the file says.

    That holds where the ids of merged tokens follow the order of the merges, there is
    no normalizer, and the only added tokens are special ones.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
    if model.get("type") != "BPE" or not plain or spec.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
        return None
    others = [b for b in range(256) if b not in set(_PRINTABLE)]
    byte_of = {chr(b): b for b in _PRINTABLE} | {chr(256 + i): b for i, b in enumerate(others)}
    added = {t["content"] for t in spec.get("added_tokens", [])}
    vocabulary = {t: i for t, i in model["vocab"].items() if t not in added}
    merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged) or len(merged) + 256 != len(vocabulary):
        return None
    return {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items()}


@functools.cache
def _fast(path: str):
    """The vocabulary under the faster of the two byte-level encoders, where it fits."""
    ranks = _byte_ranks(path)
    if ranks is None:
        return None
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers, as ``tokenizers`` gives them for the file.

    A byte-level BPE file is read into an encoder that needs a fifth of the time; texts
    with a special string or a very long run of white space, and the first texts of each call, go through ``tokenizers``, and a
    difference is an error. Other files are left to ``tokenizers`` altogether.
    """
    model, fast = _tokenizer(path), _fast(path)

    def exact(parts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype="<u4").tobytes() for x in model.encode_batch(parts, add_special_tokens=False)]

    if fast is None:
        return exact(texts)
    special = [t.content for t in model.get_added_tokens_decoder().values()]

    def quick(text: str) -> bytes | None:
        if any(s in text for s in special) or " " * 999 in text or "\n" * 999 in text:
            return None
        try:
            return np.array(fast.encode_ordinary(text), dtype="<u4").tobytes()
        except BaseException as e:
            # Its pattern engine gives up on very long runs of mixed white space.
            if type(e).__name__ != "PanicException":
                raise
            return None

    out = [quick(t) for t in texts]
    rest = [i for i, x in enumerate(out) if x is None]
    for i, ids in zip(rest, exact([texts[i] for i in rest]), strict=True):
        out[i] = ids
    probe = [i for i, t in enumerate(texts) if len(t) < 2000][:PROBES]
    if exact([texts[i] for i in probe]) != [out[i] for i in probe]:
        raise RuntimeError(f"the encoders disagree on {path}")
    return out


def _encode_all(path: str, end_id: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        chunk, begin = TaskContext.get().partitionId(), {}
        for batch in batches:
            for part in slices(batch, "text"):
                sources = part.column("source").to_pylist()
                ids = [x + end for x in encode(part.column("text").to_pylist(), path)]
                sizes, starts = np.array([len(x) // 4 for x in ids], dtype=np.int64), []
                for source, size in zip(sources, sizes.tolist(), strict=True):
                    at = begin.get(source, 0)
                    starts.append(at)
                    begin[source] = at + size
                yield {
                    "doc_id": part.column("doc_id"),
                    "source": part.column("source"),
                    "chunk": np.full(len(ids), chunk, dtype=np.int32),
                    "begin": np.array(starts, dtype=np.int64),
                    "doc_tokens": sizes,
                    "ids": pa.array(ids, type=pa.binary()),
                }

    return run


class Mixture:
    """Which tokens of which source a window holds.

    ``totals`` are the tokens of each source, ``weights`` whole-number weights of the
    sources (their totals if none are given: then each window holds the sources in
    the proportions of the corpus). Token ``k`` of source ``j`` is due at virtual time
    ``(k + 1/2) / g_j``; windows take tokens as they fall due, ties in the order of the sources.
    """

    def __init__(self, totals: Sequence[int], weights: Sequence[int], window: int):
        self.totals, self.weights, self.window = list(totals), list(weights), window
        self.scale = 2 * sum(weights)
        self.all = sum(totals)
        self._cuts = functools.lru_cache(maxsize=100_000)(self._cut)

    def served(self, t: int) -> list[int]:
        """Tokens served of each source up to virtual time ``t``: the credit, rounded, while the queue lasts."""
        s = self.scale // 2
        return [min(n, (2 * g * t + s) // (2 * s)) for n, g in zip(self.totals, self.weights, strict=True)]

    def _cut(self, w: int) -> tuple[int, ...]:
        """Tokens of each source before window ``w``."""
        want = min(w * self.window, self.all)
        low, high = 0, max(1, want)
        while sum(self.served(high)) < want:
            low, high = high, 2 * high
        # Where no source is used up yet, the time is close to the number of tokens.
        near = want - len(self.totals) - 1
        if low < near < high and sum(self.served(near)) < want:
            low = near
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if sum(self.served(mid)) < want else (low, mid)
        before, after = self.served(low), self.served(high)
        left, out = want - sum(before), []
        for a, b in zip(before, after, strict=True):
            take = min(b - a, left)
            out.append(a + take)
            left -= take
        return tuple(out)

    def cuts(self, w: int) -> tuple[int, ...]:
        return self._cuts(w) if w > 0 else tuple([0] * len(self.totals))

    def window_of(self, j: int, at: int, guess: int = 0) -> int:
        """The window that holds token ``at`` of source ``j``."""
        low, high = 0, -(-self.all // self.window)
        if self.cuts(guess)[j] <= at:
            if self.cuts(guess + 1)[j] > at:
                return guess
            low, step = guess + 1, 1
            while low + step < high and self.cuts(low + step)[j] <= at:
                low, step = low + step, 2 * step
            high = min(high, low + step)
        else:
            high = guess
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if self.cuts(mid)[j] <= at else (low, mid)
        return low

    def places(self, j: int, at: int, n: int, guess: int = 0) -> Iterator[tuple[int, int, int]]:
        """(window, place in the window, length) of the parts of ``n`` tokens of source ``j`` from ``at``."""
        w = self.window_of(j, at, guess)
        while n:
            start, stop = self.cuts(w), self.cuts(w + 1)
            take = min(n, stop[j] - at)
            if take:
                yield w, sum(stop[:j]) - sum(start[:j]) + at - start[j], take
            at, n, w = at + take, n - take, w + 1


def _cut_all(names: list[str | None], totals: list[int], weights: list[int], length: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        mixture = Mixture(totals, weights, length * window)
        index = {name: j for j, name in enumerate(names)}
        last = [0] * len(names)
        for batch in batches:
            for part in slices(batch, "ids"):
                out: dict[str, list] = {f.name: [] for f in PIECES}
                columns = [part.column(c).to_pylist() for c in ("doc_id", "source", "doc_tokens", "at", "ids")]
                for doc_id, source, n, at, ids in zip(*columns, strict=True):
                    j, start, data = index[source], 0, memoryview(ids)
                    for w, place, take in mixture.places(j, at, n, last[j]):
                        last[j] = w
                        while take:
                            size = min(take, length - place % length)
                            out["doc_id"].append(doc_id)
                            out["start"].append(start)
                            out["length"].append(size)
                            out["ids_crc32"].append(zlib.crc32(data[4 * start : 4 * (start + size)]))
                            out["doc_tokens"].append(n)
                            out["sequence_id"].append(w * window + place // length)
                            out["offset"].append(place % length)
                            out["source"].append(source)
                            start, place, take = start + size, place + size, take - size
                yield out

    return run


def encoded(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Ids of every document, stored once in the shared folder.

    ``chunk`` is the task that wrote the row and ``begin`` the tokens of the same
    source that this task wrote before it; both are part of the stored rows.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.col("source").cast("string").alias("source"),
    )
    return written(map_rows(rows, _encode_all(tokenizer, end_id), TOKENS), "ids")


def pack(
    docs: DataFrame,
    tokenizer: str,
    length: int = 1024,
    targets: dict[str, int] | None = None,
    window_sequences: int = WINDOW_SEQUENCES,
    end_id: int = 0,
) -> DataFrame:
    """Pack every document into sequences of ``length`` tokens, mixing the sources to target shares.

    ``docs`` has ``doc_id``, ``text`` and ``source``; other columns are ignored. The ids
    of a document are those of its text and then ``end_id``. ``targets`` are whole-number
    weights by source; without them (or for sources they don't name, in proportion)
    the weights are the tokens of each source. A window is ``window_sequences`` sequences; in
    it, each source has its share to within one token while its queue lasts, and lies
    in one stretch, so that documents are cut only where stretches and sequences end.

    Only the last sequence can be short, so padding is below ``length`` tokens in all.
    Null texts count as empty and give one piece of one id. Null is a source of its own, repeated
    rows and null ids are packed like others, an empty table gives no piece. A long text is cut over
    as many sequences as it needs.

    Returns a row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source``.
    """
    spark = docs.sparkSession
    ids = encoded(docs, tokenizer, end_id)
    chunks = ids.groupBy("chunk", "source").agg(F.sum("doc_tokens").alias("n"))
    # One row for each task and source: small against the ids, but it grows with them.
    chunks = written(chunks, "chunks")
    sources = [(r.source, int(r.n)) for r in chunks.groupBy("source").agg(F.sum("n").alias("n")).collect()]
    sources.sort(key=lambda x: (x[0] is not None, x[0] or ""))
    if not sources:
        return spark.createDataFrame([], PIECES)
    names, totals = [s for s, _ in sources], [n for _, n in sources]
    weights = totals if not targets else [targets.get(s, 0) * 1_000_000 if s in targets else 0 for s in names]
    if targets:
        named = sum(n for n, w in zip(totals, weights, strict=True) if w)
        scale = (sum(weights) or 1_000_000, named or 1)
        weights = [w or max(1, n * scale[0] // scale[1]) for n, w in zip(totals, weights, strict=True)]
    starts = small_side(_starts(chunks))
    on = (ids["chunk"] == starts["in_chunk"]) & ids["source"].eqNullSafe(starts["of_source"])
    placed = ids.join(starts, on).select(
        "doc_id", "source", "doc_tokens", (F.col("before") + F.col("begin")).alias("at"), "ids"
    )
    return map_rows(placed, _cut_all(names, totals, weights, length, window_sequences), PIECES)


def _starts(chunks: DataFrame) -> DataFrame:
    """Tokens of the source before each chunk, from sums over blocks of chunks and within them."""
    from pyspark.sql import Window

    block = F.floor(F.col("chunk") / 1000)
    inner = Window.partitionBy("source", "block").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("of").orderBy("at_block").rowsBetween(Window.unboundedPreceding, -1)
    rows = chunks.withColumn("block", block)
    blocks = rows.groupBy(F.col("source").alias("of"), F.col("block").alias("at_block")).agg(F.sum("n").alias("n"))
    ahead = blocks.select("of", "at_block", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("ahead"))
    within = rows.withColumn("within", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    on = within["source"].eqNullSafe(ahead["of"]) & (within["block"] == ahead["at_block"])
    return within.join(ahead, on).select(
        F.col("chunk").alias("in_chunk"),
        F.col("source").alias("of_source"),
        (F.col("ahead") + F.col("within")).alias("before"),
    )
