"""Toxicity scores from bags of subwords: averaged embeddings under a linear softmax, trained jointly in numpy."""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from meterflow.llm.texts import map_rows, mix, powers, slices

#: Labelled rows a model is fitted on at most, and the longest text among them.
MAX_ROWS = 6_000
MAX_CHARS = 10_000

#: Words whose margin a worker remembers, and words that are looked up at once.
MEMO_WORDS = 100_000
WORD_BLOCK = 10_000

WORD = re.compile(r"\w+")

#: Words without a say that each text is taken to have besides its own, so that a few words alone decide little.
NEUTRAL = 10.0

#: Weight of a word by its number in a text: repetition adds, but ever less.
_DAMPED = [1 + math.log(max(1, c)) for c in range(1000)]


def damped(count: int) -> float:
    return _DAMPED[count] if count < 1000 else 1 + math.log(count)


SCORES = StructType([StructField("doc_id", LongType()), StructField("score", DoubleType(), False)])


def subwords(words: list[str], buckets: int, low: int = 3, high: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' subwords and the number of the word of each.

    Subwords are the word itself and its character n-grams, with marks at both
    ends. Their hashes come from running sums over the code points of all words.
    """
    marked = [f"<{w}>" for w in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    sizes = np.array([len(m) for m in marked], dtype=np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    up, down = powers(len(points) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(points) + 1, dtype=np.uint64)
        np.cumsum((points + np.uint64(1)) * up[: len(points)], out=total[1:], dtype=np.uint64)
        starts = ends - sizes
        hashes, of = [mix((total[ends] - total[starts]) * down[starts])], [np.arange(len(words))]
        for n in range(low, high + 1):
            at = np.flatnonzero(np.arange(len(points)) + n <= ends[owner])
            hashes.append(mix((total[at + n] - total[at]) * down[at] + np.uint64(n)))
            of.append(owner[at])
    return (np.concatenate(hashes) % np.uint64(buckets)).astype(np.int64), np.concatenate(of)


@dataclass
class SubwordModel:
    """Embeddings of subword buckets, class weights and bias.

    A word's vector is the mean of its subwords', a text's the mean of its words';
    the softmax over two classes is linear in it, so a text's margin is the mean of
    its words' margins and scoring needs one number for each word.
    """

    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    scale: float
    memo: dict[str, float] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        self.margins = (self.embeddings @ (self.weights[1] - self.weights[0])).astype(np.float64) * self.scale

    def __getstate__(self) -> dict:
        return {"margins": self.margins, "bias": self.bias}

    def __setstate__(self, state: dict) -> None:
        self.margins, self.bias, self.memo = state["margins"], state["bias"], {}

    def word_margins(self, words: list[str]) -> np.ndarray:
        out = []
        for i in range(0, len(words), WORD_BLOCK):
            part = words[i : i + WORD_BLOCK]
            index, of = subwords(part, len(self.margins))
            out.append(np.bincount(of, self.margins[index], len(part)) / np.bincount(of, minlength=len(part)))
        return np.concatenate(out) if out else np.zeros(0)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of the toxic class; a text without words gets that of the bias alone."""
        bags = [Counter(WORD.findall((t or "").lower())) for t in texts]
        memo = self.memo
        new = list({w for b in bags for w in b if w not in memo})
        fresh = dict(zip(new, self.word_margins(new).tolist(), strict=True)) if new else {}
        if len(memo) < MEMO_WORDS:
            memo.update(fresh)
            known = memo.__getitem__
        else:
            known = lambda w: memo[w] if w in memo else fresh[w]
        sums = []
        for b in bags:
            weights = list(map(damped, b.values()))
            sums.append(sum(map(mul, map(known, b), weights)) / (sum(weights) + NEUTRAL))
        z = np.array(sums, dtype=np.float64) + float(self.bias[1] - self.bias[0])
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class _Edges:
    """Weighted edges from rows to parts, sorted both ways, so that both directions are sums over stretches."""

    def __init__(self, rows: np.ndarray, parts: np.ndarray, weights: np.ndarray):
        self.there, self.back = (self._sorted(a, b, weights) for a, b in ((rows, parts), (parts, rows)))

    @staticmethod
    def _sorted(targets: np.ndarray, sources: np.ndarray, weights: np.ndarray):
        order = np.argsort(targets, kind="stable")
        starts = np.flatnonzero(np.diff(targets[order], prepend=-1))
        return sources[order].astype(np.int32), starts, weights[order].astype(np.float32)[:, None]

    @staticmethod
    def sums(way, table: np.ndarray) -> np.ndarray:
        sources, starts, weights = way
        return np.add.reduceat(table[sources] * weights, starts, axis=0)


def train(
    texts: list[str],
    labels: list[int],
    buckets: int = 1 << 17,
    dim: int = 4,
    epochs: int = 60,
    min_texts: int = 3,
    rate: float = 8.0,
    decay: float = 2e-5,
    scale: float = 60.0,
    toxic_weight: float = 1.2,
    seed: int = 7,
) -> SubwordModel:
    """Fit embeddings and softmax together by gradient descent with momentum over all given texts.

    All toxic texts together weigh ``toxic_weight`` times the others. Words of a single text tell nothing about others
    and are left to their shared n-grams. Without texts of both classes the model says 1/2 for any text.
    """
    rng = np.random.default_rng(seed)
    emb = (rng.standard_normal((buckets, dim)) * 1e-3).astype(np.float64)
    weights = np.stack([-np.ones(dim), np.ones(dim)]) / np.sqrt(dim) + rng.standard_normal((2, dim)) * 0.1
    bias = np.zeros(2)
    y = np.array(labels, dtype=np.int64)
    if len(set(labels)) < 2:
        return SubwordModel(emb * 0, weights, bias, scale)
    # Texts are read twice, so that their bags never stand in memory together.
    spread: Counter[str] = Counter()
    for t in texts:
        spread.update(set(WORD.findall(t.lower())))
    vocabulary = {w: i for i, w in enumerate(w for w, n in spread.items() if n >= min_texts)}
    del spread
    # Edges from texts to words (share of the text) and from words to subwords (mean).
    edge_text, edge_word, edge_share = array("l"), array("l"), array("d")
    for i, t in enumerate(texts):
        bag = Counter(WORD.findall(t.lower()))
        total = sum(map(damped, bag.values())) + NEUTRAL
        for w in sorted(bag.keys() & vocabulary.keys()):
            edge_text.append(i)
            edge_word.append(vocabulary[w])
            edge_share.append(damped(bag[w]) / total)
    if not edge_text:
        return SubwordModel(emb * 0, weights, bias, scale)
    with_words, t_of = np.unique(np.array(edge_text), return_inverse=True)
    y = y[with_words]
    if len(set(y.tolist())) < 2:
        return SubwordModel(emb * 0, weights, bias, scale)
    n_texts, n_words = len(y), len(vocabulary)
    s_of, v_of = subwords(list(vocabulary), buckets)
    used, s_of = np.unique(s_of, return_inverse=True)
    s_weight = 1.0 / np.bincount(v_of, minlength=n_words)[v_of]
    share = np.bincount(np.array(edge_word), np.array(edge_share), n_words)
    use = np.bincount(s_of, share[v_of] * s_weight, len(used))
    texts_words = _Edges(t_of, np.array(edge_word), np.array(edge_share))
    words_subwords = _Edges(v_of, s_of, s_weight)
    del edge_text, edge_word, edge_share
    part = emb[used].astype(np.float32)
    weights = weights.astype(np.float32)
    per_row = np.array([1.0, toxic_weight])[y] / (1.0 + toxic_weight) / np.bincount(y, minlength=2)[y]
    v_part, v_weights, v_bias = np.zeros_like(part), np.zeros_like(weights), np.zeros_like(bias)
    # A bucket's step is divided by the square root of its use, so that rare and frequent subwords learn alike.
    step = (rate * 0.1 / np.sqrt(use / use.sum() * 1e3 + 1e-3))[:, None].astype(np.float32)
    for _ in range(epochs):
        words = _Edges.sums(words_subwords.there, part)
        docs = _Edges.sums(texts_words.there, words)
        z = docs @ weights.T * scale + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = ((p - np.eye(2)[y]) * per_row[:, None]).astype(np.float32)
        d_words = _Edges.sums(texts_words.back, d @ weights * scale)
        d_part = _Edges.sums(words_subwords.back, d_words)
        v_part = 0.9 * v_part - step * (d_part + decay * part)
        v_weights = 0.9 * v_weights - 0.01 * (d.T @ docs * scale)
        v_bias = 0.9 * v_bias - 0.1 * d.sum(axis=0)
        part += v_part
        weights += v_weights
        bias += v_bias
    emb *= 0  # buckets that no text of the sample has say nothing
    emb[used] = part
    return SubwordModel(emb, weights, bias, scale)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    max_rows: int = MAX_ROWS,
    max_chars: int = MAX_CHARS,
    **training: float,
) -> SubwordModel:
    """Train on a bounded sample of labelled rows.

    The sample is the ``max_rows`` labelled ids with the smallest hash, without their texts
    longer than ``max_chars`` and without repeated texts, so a model takes the same time
    however large the corpus is. An id labelled twice is toxic if either label says so;
    null labels, ids and texts are left out.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    order = F.xxhash64("doc_id", F.lit(17))
    picked = known.select("doc_id", "label", order.alias("h")).orderBy("h", "doc_id").limit(max_rows)
    ids = [(r.doc_id, r.label) for r in picked.collect()]
    ids = spark.createDataFrame(ids, "doc_id bigint, label int")
    rows = (
        docs.select("doc_id", "text")
        .where(F.length("text") <= max_chars)
        .join(F.broadcast(ids), "doc_id")  # max_rows rows at most
        .groupBy("doc_id", "label")
        .agg(F.max("text").alias("text"))
        .orderBy("doc_id")
        .collect()
    )
    texts: dict[str, int] = {}
    for row in rows:
        texts[row.text] = max(int(row.label > 0), texts.get(row.text, 0))
    del rows
    return train(list(texts), list(texts.values()), **training)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own = model.value
        for batch in batches:
            for part in slices(batch, "text"):
                yield {"doc_id": part.column("doc_id"), "score": own.scores(part.column("text").to_pylist())}

    return run


def toxicity_scores(docs: DataFrame, model: SubwordModel, threshold: float = 0.7) -> DataFrame:
    """``doc_id, score, predicted`` for every row of ``docs``.

    Only the text is looked at, all of it. Null and empty texts, and texts without a
    word, get the score of the bias. Repeated rows get equal scores, an empty table gives none, other
    columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = map_rows(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), _score(shared), SCORES)
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast(IntegerType()))


def _reject(model, threshold: float, schema: StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own = model.value
        for batch in batches:
            for part in slices(batch, "text"):
                keep = pa.array(own.scores(part.column("text").to_pylist()) < threshold)
                kept = part.filter(keep)
                yield {f.name: kept.column(i) for i, f in enumerate(schema)}

    return run


def without_toxic(docs: DataFrame, model: SubwordModel, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with all their columns, in one pass and without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_rows(docs, _reject(shared, threshold, docs.schema), docs.schema)
