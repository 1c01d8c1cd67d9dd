"""Collocations from a weighted de Bruijn graph of words: nodes are four words, edges the five words that join two of them."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from meterflow.llm.texts import BREAKS, Words, bytes_column, map_rows, slices, split_words
from meterflow.session import hint_if_small, written

#: Bits of the table that tells pairs of words which may be frequent; 8 MB whatever the size of the corpus.
PAIR_BITS = 1 << 26

#: Factors of the places of pairs in that table; sums stay below 2**63.
_LEFT, _RIGHT = 1_000_003, 8_191

#: Bytes of text whose words are numbered and counted together.
SLICE_BYTES = 4 << 20

#: Parts in which the candidates of one language are ranked before the last ranking.
RANK_PARTS = 64

COUNTS = StructType(
    [StructField("lang", StringType(), False), StructField("gram", StringType(), False), StructField("n", LongType(), False)]
)
EDGES = StructType([*COUNTS.fields, StructField("words", IntegerType(), False)])


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Words]]:
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            langs, texts = part.column("lang").to_pylist(), bytes_column(part, "text")
            mine: dict[str, list] = {}
            for lang, text in zip(langs, texts, strict=True):
                mine.setdefault(lang, []).append(text)
            for lang, own in mine.items():
                yield lang, split_words(own, lower=True, breaks=BREAKS)


def _grams(words: Words, at: np.ndarray, k: int) -> pa.Array:
    """The ``k`` words from each place on, joined by spaces."""
    parts = [words.distinct.take(pa.array(words.codes[at + j])) for j in range(k)]
    return (parts[0] if k == 1 else pc.binary_join_element_wise(*parts, b" ")).cast(pa.string())


def _named(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys: the place of the first, the name of each key, and counts."""
    _, first, name, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    return first, name.astype(np.int64), count


def _rows(lang: str, gram: pa.Array, n: np.ndarray) -> dict:
    return {"lang": pa.array([lang] * len(gram), pa.string()), "gram": gram, "n": n}


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Words and pairs of words with their counts; the empty gram holds the number of all words."""
    for lang, words in _by_language(batches):
        codes, n = words.codes, len(words.codes)
        yield _rows(lang, pa.array([""]), np.array([n]))
        if not n:
            continue
        yield _rows(lang, words.distinct.cast(pa.string()), np.bincount(codes, minlength=len(words.distinct)))
        at = np.flatnonzero(words.piece[1:] == words.piece[:-1])
        first, _, count = _named(codes[at] * len(words.distinct) + codes[at + 1])
        yield _rows(lang, _grams(words, at[first], 2), count)


def _places(left, right, lang, bits: int):
    return (left * _LEFT + right * _RIGHT + lang) % bits


def _pair_table(pairs: DataFrame, bits: int) -> Broadcast:
    """One bit for each pair of ``pairs``; built in Spark, so the driver holds the table only."""
    crc = [F.crc32(F.substring_index("gram", " ", k)) for k in (1, -1)]
    bit = _places(crc[0], crc[1], F.crc32("lang"), bits) + 1  # the bitmap functions number buckets and positions from 1
    rows = (
        pairs.select(bit.alias("bit"))
        .groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
        .collect()
    )
    table = np.zeros(max(bits // 8, 4096), dtype=np.uint8)
    for row in rows:
        data = np.frombuffer(row["bits"], dtype=np.uint8)
        at = (row["bucket"] - 1) * len(data)
        table[at : at + len(data)] = data
    return pairs.sparkSession.sparkContext.broadcast(table.tobytes())


def _edges(table: Broadcast, bits: int, longest: int):
    """Edges of ``longest`` words, and of each piece its last words, one fewer or as many as it has, which no word follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        pairs = np.frombuffer(table.value, dtype=np.uint8)
        for lang, words in _by_language(batches):
            codes, n = words.codes, len(words.codes)
            if n < 2:
                continue
            crc = np.fromiter(map(zlib.crc32, words.distinct.to_pylist()), dtype=np.int64, count=len(words.distinct))
            of = crc[codes]
            bit = _places(of[:-1], of[1:], zlib.crc32(lang.encode()), bits)
            held = pairs[bit >> 3] >> (bit & 7).astype(np.uint8) & 1
            joined = (words.piece[1:] == words.piece[:-1]) & (held == 1)
            # A piece is cut where a pair is certainly too rare: no gram across it can be a candidate.
            piece = np.cumsum(np.concatenate([[True], ~joined]))
            at, name = np.arange(n), codes
            starts = np.concatenate([[True], piece[1:] != piece[:-1]])
            for k in range(2, longest + 1):
                inside = at + k - 1 < n
                at, name = at[inside], name[inside]
                inside = piece[at] == piece[at + k - 1]
                at, name = at[inside], name[inside]
                if not len(at):
                    break
                _, name, _ = _named(name * len(words.distinct) + codes[at + k - 1])
                if k == longest:
                    given = np.ones(len(at), dtype=bool)
                else:
                    given = (at + k >= n) | (piece[np.minimum(at + k, n - 1)] != piece[at])
                    if k < longest - 1:
                        given &= starts[at]
                first, _, count = _named(name[given])
                if k > 2 and len(first):
                    yield _rows(lang, _grams(words, at[given][first], k), count) | {"words": np.full(len(first), k)}

    return run


def _flow(docs: DataFrame, pairs: DataFrame, bits: int, longest: int) -> dict[int, DataFrame]:
    """Counts of all grams of 3 to ``longest`` words that have no rare pair, by their length.

    Only edges are counted. What flows through a node is the sum of the edges that leave it and of the pieces
    that end in it; the nodes of one length are in turn the edges between shorter ones, and what ends in a
    shorter node is a suffix of what ends in a longer one.
    """
    key = ["lang", "words", "gram"]
    found = map_rows(docs, _edges(_pair_table(pairs, bits), bits, longest), EDGES)
    table = written(found.groupBy(*key).agg(F.sum("n").alias("n")), "edges")
    counts = {longest: table.where(F.col("words") == longest).drop("words")}
    ends = table.where(F.col("words") < longest)
    for k in range(longest - 1, 2, -1):
        leaving = counts[k + 1].select("lang", F.substring_index("gram", " ", k).alias("gram"), "n")
        ending = ends.where(F.col("words") >= k).select("lang", F.substring_index("gram", " ", -k).alias("gram"), "n")
        counts[k] = written(leaving.unionByName(ending).groupBy("lang", "gram").agg(F.sum("n").alias("n")), f"nodes-{k}")
    return counts


def _without_compacted(frequent: DataFrame) -> DataFrame:
    """Grams that no unary path runs through: of those whose whole flow goes on into one longer gram, or comes from one,
    only the longer is kept. Longer grams that hold a gram with the same count do so word by word, so one more word is enough."""
    longer = frequent.where(F.col("words") > 2)
    ends = F.expr("array(substring_index(gram, ' ', words - 1), substring_index(gram, ' ', 1 - words))")
    through = longer.select("lang", F.explode(ends).alias("gram"), "n").groupBy("lang", "gram").agg(F.max("n").alias("most"))
    whole = frequent.join(through, ["lang", "gram"], "left")
    return whole.where(F.col("most").isNull() | (F.col("most") < F.col("n"))).drop("most")


def _exact(left: Column, right: Column) -> Column:
    """A product of two numbers in 38 digits."""
    return left.cast("decimal(19,0)") * right.cast("decimal(19,0)")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, longest: int = 5, pair_bits: int = PAIR_BITS) -> DataFrame:
    """The ``top`` phrases of each language by score, from all texts of ``docs`` (``text``, ``lang``; other columns are ignored).

    Texts are lower-cased (A-Z), cut at ``. , ; : ! ?`` and 0x0A to 0x0D into pieces and these at spaces and tabs into
    words. Candidates are phrases of 2 to ``longest`` words with a count a of ``least`` or more. A cut into two parts
    with counts l and r scores floor(1000 a n / (l r)), n being all words of the language; the lowest cut counts, the
    shorter first part of equal ones. A candidate inside a longer one of the same count is dropped. Returns ``lang,
    rank, phrase, a, l, r, n, score``; equal scores are ranked by a, then by the bytes of the phrase.

    Words and pairs of words are counted first. Phrases with a pair below ``least`` can't be candidates, so pieces are
    cut there before edges of ``longest`` words are made, from which all lengths between follow; a table of ``pair_bits`` bits (a power of two) may let rare pairs through, which
    only costs time.

    Null texts are empty, null languages ``und``. Repeated rows count each time. Without a candidate, as in an empty
    table, there are no rows. Long texts are worked on whole.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    enough = F.col("n") >= least
    paired = map_rows(rows, _count_pairs, COUNTS).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = written(paired.where(enough | (F.col("gram") == "")), "pairs")
    spaced = F.contains("gram", F.lit(" "))
    totals = counts.where(F.col("gram") == "").select("lang", F.col("n").alias("total"))
    words = counts.where((F.col("gram") != "") & ~spaced)

    frequent = counts.where(spaced).withColumn("words", F.lit(2))
    if longest > 2:
        for k, level in _flow(rows, counts.where(spaced), pair_bits, longest).items():
            frequent = frequent.unionByName(level.where(enough).withColumn("words", F.lit(k)))
    frequent = written(frequent, "frequent")

    parts = frequent.select("lang", "gram", "n").unionByName(words)
    cuts = (
        _without_compacted(frequent)
        .withColumnRenamed("n", "a")
        .select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
        .withColumn("begin", F.expr("substring_index(gram, ' ', k)"))
        .withColumn("rest", F.expr("substring_index(gram, ' ', k - words)"))
        .join(parts.select("lang", F.col("gram").alias("begin"), F.col("n").alias("l")), ["lang", "begin"])
        .join(parts.select("lang", F.col("gram").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
        .join(hint_if_small(totals), "lang")
        .withColumn("above", _exact(1000 * F.col("a"), F.col("total")))
        .withColumn("below", _exact(F.col("l"), F.col("r")))
        .withColumn("score", F.expr("above div below"))
    )
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", F.col("gram").alias("phrase"), "a", F.col("total").alias("n")).agg(lowest)
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    by = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # One language may hold nearly all phrases, so parts of it are ranked first.
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    ahead = scored.withColumn("part", part).withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*by)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("bigint")
    ranked = ahead.where(F.col("place") <= top).withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


__all__ = ["collocations"]
