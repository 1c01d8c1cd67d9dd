"""Token counts through a cache of digests: only texts that no earlier run has counted are encoded."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from meterflow.llm.texts import map_rows, pieces
from meterflow.session import hint_if_small, scratch_path, written

#: Counts of pieces a worker remembers; beyond it new pieces are encoded each time.
MEMO_PIECES = 400_000

#: One row for each digest and tokenizer: what the cache holds.
CACHE_SCHEMA = StructType(
    [
        StructField("digest", StringType(), False),
        StructField("tokenizer", StringType(), False),
        StructField("n_tokens", LongType(), False),
    ]
)


def tokenizer_version(path: str) -> str:
    """The content of a vocabulary file as one short text; another file gives other counts."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:32]


@functools.cache
def _memo(path: str) -> dict[str, int]:
    return {}


@functools.cache
def _counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts, loaded once in a worker."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch(texts, add_special_tokens=False)]


def count_tokens(texts: list[str], path: str, by_piece: bool = True) -> list[int]:
    """Tokens of each text as the library gives them.

    ``by_piece``: parts between single spaces are counted once and remembered. That
    is exact for vocabularies without a token that goes on past a single space.
    """
    count = _counter(path)
    if not by_piece:
        return count(texts)
    memo = _memo(path)
    split = [pieces(t) for t in texts]
    whole = [t for t, p in zip(texts, split, strict=True) if p is None]
    new = list({x for p in split if p is not None for x in p if x not in memo})
    fresh = dict(zip(new, count(new), strict=True))
    if len(memo) < MEMO_PIECES:
        memo.update(fresh)
        known = memo
    else:
        known = {**{x: memo[x] for p in split if p is not None for x in p if x in memo}, **fresh}
    rest = iter(count(whole))
    return [next(rest) if p is None else (sum(map(known.__getitem__, p)) if t else 0) for t, p in zip(texts, split, strict=True)]


def _encode(path: str, version: str, by_piece: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from meterflow.llm.texts import slices

        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                yield {
                    "digest": part.column("digest"),
                    "tokenizer": pa.array([version] * len(texts)),
                    "n_tokens": np.array(count_tokens(texts, path, by_piece), dtype=np.int64),
                }

    return run


def token_counts(
    docs: DataFrame,
    tokenizer: str,
    cache: str | None = None,
    limit: int = 4096,
    by_piece: bool | None = None,
) -> DataFrame:
    """Token counts of every row of ``docs`` (columns ``doc_id``, ``text``).

    ``cache`` is a Parquet folder that all executors share; counts of earlier runs
    are read from it and new ones appended. Without it a new folder is begun below
    ``spark.checkpoint.dir``. A stored count is found by the SHA-256 of the text,
    where null counts as the empty text, together with the content of the
    vocabulary file. The text is not changed otherwise, since each of its
    characters may change the count.

    Returns ``doc_id, n_bytes, n_tokens, over_limit`` for each row, repeated rows
    and null ids included; an empty table gives an empty one, and other columns of any name are ignored. Texts of any length are
    encoded whole, one at a time. Texts whose digest is stored are neither encoded nor shuffled; with nothing new, none is. A run that dies while
    appending leaves no rows, and a run that repeats appended rows does no harm, as the
    cache is read with one row for each key.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    # byte_bpe splits at single spaces only when they lead the word, so its pieces would lose their space.
    by_piece = tokenizer.endswith(".model") if by_piece is None else by_piece
    cache = cache or scratch_path(spark, "token-cache")
    text = F.coalesce("text", F.lit(""))
    # Digests are made in the scan that reads the text; only they are shuffled to find what is new.
    keyed = docs.select("doc_id", text.alias("text")).withColumn("digest", F.sha2("text", 256))
    empty = spark.createDataFrame([], CACHE_SCHEMA)
    empty.write.mode("append").parquet(cache)  # the folder exists from here on

    def stored() -> DataFrame:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version)
        return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    # One text for each digest: the smallest id stands for it, so that no text is aggregated.
    chosen = keyed.groupBy("digest").agg(F.min(F.coalesce("doc_id", F.lit(0))).alias("doc_id"))
    misses = written(chosen.join(stored(), "digest", "left_anti").select(F.col("doc_id").alias("key"), F.col("digest").alias("miss")), "misses")
    if not misses.isEmpty():
        # Few misses go to the texts, which then stay where they are; many meet them in a shuffle.
        side = hint_if_small(misses)
        side = side.hint("shuffle_hash") if side is misses else side
        rows = keyed.withColumn("key", F.coalesce("doc_id", F.lit(0))).join(side, "key")
        todo = rows.where(F.col("digest") == F.col("miss")).select("digest", "text")
        map_rows(todo, _encode(tokenizer, version, by_piece), CACHE_SCHEMA).write.mode("append").parquet(cache)

    sizes = docs.select("doc_id", text.alias("text")).select(
        "doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast(LongType()).alias("n_bytes")
    )
    return sizes.join(stored(), "digest", "left").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


__all__ = ["CACHE_SCHEMA", "count_tokens", "token_counts", "tokenizer_version"]
