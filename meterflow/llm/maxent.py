"""Texts scored by a hashed maximum-entropy model: n-gram and skip features, a softmax over classes and one inside each class."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

from meterflow.llm.texts import bytes_column, map_rows, slices, split_words
from meterflow.session import written

#: Outputs of either softmax: classes (the last one for words outside the vocabulary), and words of a class.
WIDTH = 64
#: Rows of the table of feature weights of either softmax; their numbers have 16 bits.
ROWS = 1 << 13
#: Features of a token: the word before, the two before, and the second before alone.
FEATURES = 3
#: Words whose counts every task holds; counts of all others are joined. Longer words are never held.
KNOWN_WORDS, KNOWN_BYTES = 1 << 17, 64
#: Tokens one task trains on at least before its weights are averaged with those of other tasks.
TASK_TOKENS = 4_000_000
#: Tokens of one gradient step, and of one step of scoring.
STEP_TOKENS = 8192
#: Rounds of training; each document is in one of them.
ROUNDS = 2
RATE = 0.05
#: Bytes of text that are split into words and scored at once.
PART_BYTES = 2 << 20
#: Logits whose exponentials can be summed as they are.
SAFE = 60.0
#: Heights of blocks of gradients: 1, 2, 3, 4, 6, 8, 12 and so on.
_HEIGHTS = np.array(sorted({h << k for k in range(30) for h in (1, 2, 3)}))

_COUNTS = StructType([StructField("word", StringType(), False), StructField("n", LongType(), False)])
_UPDATES = StructType(
    [
        StructField("factor", IntegerType(), False),
        StructField("row", IntegerType(), False),
        StructField("used", DoubleType(), False),
        StructField("change", ArrayType(FloatType(), False), False),
    ]
)
_PARTS = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("row", LongType(), False),
        StructField("n_tokens", LongType(), False),
        StructField("n_known", LongType(), False),
        StructField("n_outside", LongType(), False),
        StructField("base", DoubleType(), False),
        StructField("model", DoubleType(), False),
        StructField("rare", ArrayType(StringType(), False), False),
        StructField("times", ArrayType(LongType(), False), False),
    ]
)


@dataclass
class Vocabulary:
    """Words that every task knows, by falling count; the first of them are the words of the model."""

    places: dict[bytes, int]  #: place of a word; the end of a text is the empty word
    counts: np.ndarray
    size: int  #: words of the model
    bias: np.ndarray  #: log shares of the classes, then of the words of each class

    @cached_property
    def words(self) -> pa.Array:
        return pa.array(list(self.places), type=pa.binary())

    def find(self, words: pa.Array, first: int) -> np.ndarray:
        """Places of words given as bytes, -1 for those that aren't among the first ``first`` words."""
        return pc.fill_null(pc.index_in(words, value_set=self.words[:first]), -1).to_numpy(zero_copy_only=False).astype(np.int64)


@dataclass
class LanguageModel:
    counts: DataFrame  #: ``word``, ``n`` of all training tokens
    tokens: int
    distinct: int
    vocabulary: Vocabulary
    weights: np.ndarray  #: two tables of ``ROWS`` by ``WIDTH``

    @property
    def outside(self) -> float:
        """What counts of words outside the model's vocabulary are shared out over, one unseen word included."""
        inside = int(self.vocabulary.counts[: self.vocabulary.size].sum())
        return float(self.tokens - inside + self.distinct - self.vocabulary.size + 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for part in slices(batch, "text", 4 << 20):
            words = split_words(bytes_column(part, "text"), lower=True)
            n = np.bincount(words.codes, minlength=len(words.distinct))
            yield {"word": words.distinct.cast(pa.string()), "n": n}
            yield {"word": [""], "n": [len(part)]}


def vocabulary(counts: DataFrame, tokens: int) -> Vocabulary:
    """The most frequent words: all above the smallest count at which they are ``KNOWN_WORDS`` or fewer.

    That count is found from a histogram with a fixed number of bins, so the driver gets a bounded number of words.
    """
    short = F.octet_length("word") <= KNOWN_BYTES
    bins = counts.where(short).groupBy(F.floor(8 * F.log2("n")).alias("bin")).agg(F.count("*").alias("n")).collect()
    least, held = math.inf, 0
    for row in sorted(bins, key=lambda r: -r["bin"]):
        held += row["n"]
        if held > KNOWN_WORDS:
            break
        least = row["bin"]
    rows = [] if least == math.inf else counts.where(short & (F.floor(8 * F.log2("n")) >= least)).collect()
    # The end of a text comes first, whatever its count.
    rows = sorted(((r["word"].encode(), r["n"]) for r in rows), key=lambda r: (r[0] != b"", -r[1], r[0]))
    n = np.array([c for _, c in rows], dtype=np.int64)
    size = min(len(rows), (WIDTH - 1) * WIDTH)
    bias = np.full((WIDTH + 1, WIDTH), -np.inf)
    inside = np.full((WIDTH - 1) * WIDTH, -np.inf)
    inside[:size] = np.log(n[:size])
    bias[1:WIDTH] = inside.reshape(WIDTH - 1, WIDTH)
    share = np.zeros((WIDTH - 1) * WIDTH)
    share[:size] = n[:size]
    with np.errstate(divide="ignore"):
        bias[0, : WIDTH - 1] = np.log(share.reshape(WIDTH - 1, WIDTH).sum(axis=1))
    bias[0, WIDTH - 1] = math.log(max(tokens - int(n[:size].sum()), 0) + 1)
    return Vocabulary({w: i for i, (w, _) in enumerate(rows)}, n, size, bias.astype(np.float32))


def _tokens(words, known: Vocabulary, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all tokens, an end after each text (-1: not among the first words), the text of each token, and places of distinct words."""
    of_distinct = known.find(words.distinct, first)
    n_texts = len(words.first) - 1
    place = np.insert(of_distinct[words.codes], words.first[1:], known.places.get(b"", -1))
    return place, np.repeat(np.arange(n_texts), np.diff(words.first) + 1), of_distinct


def features(place: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed feature rows of the class of each token, its class and its place in the class."""
    symbol = np.where((place >= 0) & (place < size), place, size)
    back = []
    for d in (1, 2):
        h = np.full(len(symbol), size + 1, dtype=np.int64)  # before the text
        if len(symbol) > d:
            same = owner[d:] == owner[:-d]
            h[d:][same] = symbol[:-d][same]
        back.append(h)
    one, two = back
    span = size + 2
    keys = np.stack([one, one * span + two + span, two + span * (span + 1)], axis=1)
    group = np.where(symbol < size, symbol // WIDTH, WIDTH - 1)
    return keys, group, symbol % WIDTH


def _hashed(keys: np.ndarray) -> np.ndarray:
    x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(40)).astype(np.int64) & (ROWS - 1)


def _softmax(
    rows: np.ndarray, bias: np.ndarray, of_bias: np.ndarray, weights: np.ndarray, target: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token's softmax over the outputs of one factor: ``rows`` holds its feature rows, ``of_bias`` the line of
    ``bias`` that counts for it, ``target`` the output that came.

    Returns exponentials of the logits, their sums by token and the logits of the targets; a line of zeros follows the
    exponentials. Logits are shifted by their maxima only where exponentials could leave the range of the numbers.
    """
    lines = np.empty((len(rows) + 1, WIDTH), dtype=np.float32)
    lines[-1] = 0
    logits = lines[:-1]
    weights.take(rows[:, 0], axis=0, out=logits, mode="clip")
    for k in range(1, rows.shape[1]):
        logits += weights.take(rows[:, k], axis=0, mode="clip")
    logits += bias.take(of_bias, axis=0)
    at = np.arange(len(rows)), target
    if not (logits.max() < SAFE and logits[at].min() > -SAFE):
        logits -= logits.max(axis=1, keepdims=True)
    mine = logits[at]
    return lines, np.einsum("ij->i", np.exp(logits, out=logits)), mine


def _row_sums(grad: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of weights that tokens use, how often, and the sums of these tokens' lines of ``grad``.

    Rows used about equally often are summed at once, as blocks of one height: numpy adds along the middle of three
    axes far faster than over stretches of uneven length. The last line of ``grad`` is zeros and fills blocks up.
    """
    flat = rows.ravel().astype(np.uint16)
    order = np.argsort(flat, kind="stable")
    token = order // rows.shape[1]
    flat = flat[order]
    first = np.flatnonzero(np.diff(flat, prepend=flat[:1] + np.uint16(1)))
    count = np.diff(first, append=len(flat))
    total = np.empty((len(first), WIDTH), dtype=np.float32)
    height = np.searchsorted(_HEIGHTS, count)
    for h in np.unique(height):
        at = np.flatnonzero(height == h)
        steps = np.arange(_HEIGHTS[h])
        lines = token.take(first[at][:, None] + steps, mode="clip")
        lines[steps >= count[at][:, None]] = len(grad) - 1
        total[at] = grad.take(lines, axis=0, mode="clip").sum(axis=1)
    return flat[first].astype(np.int64), count, total


def _steps(place: np.ndarray, owner: np.ndarray, known: Vocabulary):
    """For slices of tokens and both factors: the factor, the tokens, their feature rows, lines of the bias and targets."""
    keys, group, slot = features(place, owner, known.size)
    for a in range(0, len(place), STEP_TOKENS):
        b = min(a + STEP_TOKENS, len(place))
        g = group[a:b]
        yield 0, np.arange(a, b), _hashed(keys[a:b]), np.zeros(b - a, dtype=np.int64), g
        at = np.flatnonzero(g < WIDTH - 1)
        if len(at):
            # Features of words count for each class apart.
            inner = _hashed(keys[a:b][at] * WIDTH + g[at][:, None] + 1)
            yield 1, a + at, inner, 1 + g[at], slot[a:b][at]


def _train(known: Broadcast, start: Broadcast):
    """Gradient steps over the texts of one task; comes out as weighted changes of the rows that were used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        weights = start.value.copy()
        squares = np.full((2, ROWS), 1e-2, dtype=np.float32)
        used = np.zeros((2, ROWS))
        for batch in batches:
            for part in slices(batch, "text"):
                words = split_words(bytes_column(part, "text"), lower=True)
                place, owner, _ = _tokens(words, known.value, known.value.size)
                for factor, at, rows, of_bias, target in _steps(place, owner, known.value):
                    grad, sums, _ = _softmax(rows, known.value.bias, of_bias, weights[factor], target)
                    grad[:-1] /= sums[:, None]
                    grad[np.arange(len(at)), target] -= 1
                    row, count, total = _row_sums(grad, rows)
                    squares[factor, row] += np.einsum("ij,ij->i", total, total) / WIDTH
                    total *= (RATE / np.sqrt(squares[factor, row]))[:, None]
                    weights[factor, row] -= total
                    used[factor, row] += count
        for factor in (0, 1):
            row = np.flatnonzero(used[factor])
            for part in np.array_split(row, max(1, len(row) // 1024)):
                change = (weights[factor, part] - start.value[factor, part]) * used[factor, part][:, None]
                yield {
                    "factor": np.full(len(part), factor),
                    "row": part,
                    "used": used[factor, part],
                    "change": pa.FixedSizeListArray.from_arrays(pa.array(change.astype(np.float32).ravel()), WIDTH).cast(pa.list_(pa.float32())),
                }

    return run


def train(docs: DataFrame) -> LanguageModel:
    """A model of all texts of ``docs`` (``text``); what it counts and learns covers every row.

    Words are counted in Spark. The model starts from the counts of classes and words. In each round the tasks take
    gradient steps from the same weights over their own documents, each on ``TASK_TOKENS`` or more if there are as
    many; the changes of a row of weights are averaged by how often each task used it.
    """
    spark = docs.sparkSession
    texts = docs.select("text")
    counts = written(map_rows(texts, _count, _COUNTS).groupBy("word").agg(F.sum("n").alias("n")).where("n > 0"), "words")
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = total["n"] or 0, total["v"]
    known = vocabulary(counts, tokens)
    weights = np.zeros((2, ROWS, WIDTH), dtype=np.float32)
    held = spark.sparkContext.broadcast(known)
    for k in range(ROUNDS):
        mine = texts.where(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == k) if ROUNDS > 1 else texts
        start = spark.sparkContext.broadcast(weights)
        tasks = mine.coalesce(1 + tokens // (ROUNDS * TASK_TOKENS))
        sums = (
            map_rows(tasks, _train(held, start), _UPDATES)
            .groupBy("factor", "row")
            .agg(F.sum("used"), *[F.sum(F.col("change")[i].cast("double")) for i in range(WIDTH)])
            .toArrow()
        )
        columns = [c.to_numpy() for c in sums.columns]
        weights = weights.copy()
        if len(sums):
            weights[columns[0], columns[1]] += (np.stack(columns[3:], axis=1) / columns[2][:, None]).astype(np.float32)
    return LanguageModel(counts, tokens, distinct, known, weights)


def _score(known: Broadcast, weights: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        vocab, tables = known.value, weights.value
        number = TaskContext.get().partitionId() << 40
        logs = np.log10(vocab.counts + 1.0)
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                n = len(part)
                words = split_words(bytes_column(part, "text"), lower=True)
                place, owner, of_distinct = _tokens(words, vocab, len(vocab.places))
                total = np.zeros(len(place))
                for factor, at, rows, of_bias, target in _steps(place, owner, vocab):
                    _, sums, mine = _softmax(rows, vocab.bias, of_bias, tables[factor], target)
                    total[at] += mine - np.log(sums)
                held = place >= 0
                outside = place >= vocab.size
                base = np.zeros(len(place))
                base[held] = logs[place[held]]
                model = total / math.log(10) + np.where(outside, base, 0)
                # Words that no task knows: each of a text once, with how often it is there.
                width = max(len(words.distinct), 1)
                text = np.repeat(np.arange(n), np.diff(words.first))
                unknown = of_distinct[words.codes] < 0
                key, times = np.unique(text[unknown] * width + words.codes[unknown], return_counts=True)
                ends = np.searchsorted(key // width, np.arange(n + 1)).astype(np.int32)
                rare = words.distinct.cast(pa.string()).take(pa.array(key % width))
                yield {
                    "doc_id": part.column("doc_id"),
                    "row": number + np.arange(n),
                    "n_tokens": np.bincount(owner, minlength=n),
                    "n_known": np.bincount(owner[held], minlength=n),
                    "n_outside": np.bincount(owner[outside | ~held], minlength=n),
                    "base": np.bincount(owner, weights=base, minlength=n),
                    "model": np.bincount(owner, weights=model, minlength=n),
                    "rare": pa.ListArray.from_arrays(pa.array(ends), rare),
                    "times": pa.ListArray.from_arrays(pa.array(ends), pa.array(times)),
                }
                number += n

    return run


def score(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Log10 probabilities of all texts of ``docs`` (``doc_id``, ``text``; other columns are ignored) under the model.

    Tokens are words (characters other than space and 0x09 to 0x0D; A-Z lower-cased) and one end for each text.
    Returns ``doc_id, n_tokens, n_known`` (tokens the training texts hold), ``train_tokens``, ``base_score`` (tokens
    by their counts, one added to each and one for unseen words) and ``score``. The model gives a class of words from
    the tokens before, then a word of the class; words outside its vocabulary share their class by counts plus one,
    one part being left for unseen words, so the probabilities of all tokens sum to one.

    Null and empty texts hold the end only. Rows are scored one by one: repeated rows get equal scores, null ids stay
    null, an empty table gives an empty one. A model without training texts gives 0 to everything. Long texts are
    scored whole, in steps of ``STEP_TOKENS``.
    """
    spark = docs.sparkSession
    known, weights = (spark.sparkContext.broadcast(x) for x in (model.vocabulary, model.weights))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    parts = written(map_rows(rows, _score(known, weights), _PARTS), "scores")
    rare = parts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), "x.times")
    counted = rare.join(model.counts, "word").groupBy("row")
    joined = counted.agg(F.sum("times").alias("found"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"))
    more = F.coalesce("more", F.lit(0.0))
    everything = math.log10(model.tokens + model.distinct + 1)
    return parts.join(joined, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * everything).alias("base_score"),
        (F.col("model") + more - F.col("n_outside") * math.log10(model.outside)).alias("score"),
    )


__all__ = ["LanguageModel", "Vocabulary", "features", "score", "train", "vocabulary"]
