"""Language of a text by word-first backoff: known words by their frequency in each language, others by shorter and shorter n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from meterflow.llm.texts import map_rows, slices
from meterflow.session import small_side

#: Labelled rows of each language a model is fitted on.
MAX_ROWS = 2_000

#: Characters that words of a long text are counted by at once.
_PIECE = 20_000

#: Words and n-grams of each length that a model keeps at most, the most frequent ones.
MAX_UNITS = 20_000

#: Parts that hashes are dealt into for the sample.
_PARTS = 1_000_000

#: Longest n-gram an unseen word is looked up by.
LONGEST = 5

#: Words whose scores a worker remembers.
MEMO_WORDS = 300_000

#: Runs of letters, and of the few other signs (fractions, raised digits) that a word is parted by later.
WORD = r"[^\W\d_]+"

#: Label of texts without a letter.
UNKNOWN = "und"

PREDICTIONS = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("lang_pred", StringType(), False),
        StructField("score", DoubleType(), False),
    ]
)


@dataclass
class LanguageModel:
    """Log frequencies by language of words and of n-grams of each length.

    ``tables[0]`` has words, ``tables[n]`` n-grams of n characters; words are marked by a space at
    both ends before they are cut. All frequencies are smoothed by half a count.
    """

    languages: list[str]
    tables: list[dict[str, np.ndarray]]
    memo: dict[str, np.ndarray] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {"languages": self.languages, "tables": self.tables}

    def __setstate__(self, state: dict) -> None:
        self.languages, self.tables, self.memo = state["languages"], state["tables"], {}

    def word(self, word: str) -> np.ndarray:
        """A known word's log frequencies; else the mean over its n-grams of the longest length of which any is known."""
        got = self.tables[0].get(word)
        if got is None:
            marked = f" {word} "
            for n in range(min(len(self.tables) - 1, len(marked)), 0, -1):
                table = self.tables[n]
                found = [v for i in range(len(marked) - n + 1) if (v := table.get(marked[i : i + n])) is not None]
                if found:
                    got = np.mean(found, axis=0)
                    break
            else:
                got = np.zeros(len(self.languages))
        return got

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its share of the posterior, where each text counts as its words' mean times the root of their number."""
        words = words_of(text)
        if not words or not self.languages:
            return UNKNOWN, 0.0
        memo, rows = self.memo, []
        for w in words:
            v = memo.get(w)
            if v is None:
                v = self.word(w)
                if len(memo) < MEMO_WORDS:
                    memo[w] = v
            rows.append(v)
        counts = np.fromiter(words.values(), np.float64, len(words))
        total = counts.sum()
        z = counts @ np.array(rows) / np.sqrt(total)
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


_WORD = re.compile(WORD)


def words_of(text: str | None) -> Counter:
    """Runs of letters of a text in lower case, with their numbers; numerals such as one half or a circled one are no letters."""
    words = Counter(_WORD.findall((text or "").lower()))
    for mixed in [w for w in words if not w.isalpha()]:
        times = words.pop(mixed)
        for part in "".join(c if c.isalpha() else " " for c in mixed).split():
            words[part] += times
    return words


def fit(
    docs: DataFrame,
    lang: str = "lang",
    max_rows: int = MAX_ROWS,
    max_units: int = MAX_UNITS,
    longest: int = LONGEST,
) -> LanguageModel:
    """Count words and n-grams by language over a bounded sample of labelled rows.

    The sample has about ``max_rows`` rows of each language, those whose hash of id and text falls below a bound that follows from the
    rows of the language. Their texts count in full, long ones piece by piece, each of which ends where a word does. So every
    language weighs about the same and the model's size does not grow with the corpus. Counting runs in Spark; only the ``max_units`` most frequent units of each length
    come to the driver. Rows with null text or language are left out. Ties go to the unit that sorts first.
    """
    from pyspark.sql import Window

    rows = docs.select(F.col(lang).alias("lang"), "text", F.xxhash64("doc_id", "text").alias("h"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # A row is taken by its own hash and the number of rows of its language, so no text is shuffled or sorted.
    numbers = small_side(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("lang", "of"))
    share = F.ceil(F.lit(_PARTS * max_rows) / F.col("n"))
    rows = rows.join(numbers, rows["lang"] == numbers["of"]).where(F.pmod("h", F.lit(_PARTS)) < share)
    piece = F.lit(rf"(?s)(.{{1,{_PIECE}}}\p{{L}}*)")
    pieces = rows.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), piece)).alias("piece"))
    words = pieces.select("lang", F.explode(F.regexp_extract_all("piece", F.lit(r"(\p{L}+)"))).alias("w"))
    words = words.groupBy("lang", "w").agg(F.count(F.lit(1)).alias("c"))
    marked = F.concat(F.lit(" "), "w", F.lit(" "))
    lengths = F.sequence(F.lit(1), F.lit(longest))
    grams = F.flatten(
        F.transform(
            lengths,
            lambda n: F.transform(
                F.sequence(F.lit(1), F.greatest(F.length(marked) - n + 1, F.lit(1))),
                lambda i: F.struct(n.alias("n"), F.substr(marked, i, n).alias("u")),
            ),
        )
    )
    whole = F.array(F.struct(F.lit(0).alias("n"), F.col("w").alias("u")))
    units = words.select("lang", "c", F.explode(F.concat(whole, grams)).alias("x")).select("lang", "c", "x.n", "x.u")
    units = units.where((F.col("n") == 0) | (F.length("u") == F.col("n")))
    counted = units.groupBy("n", "u", "lang").agg(F.sum("c").alias("c"))
    by_unit = counted.groupBy("n", "u").agg(
        F.map_from_entries(F.collect_list(F.struct("lang", "c"))).alias("by"), F.sum("c").alias("all")
    )
    totals: dict[int, Counter] = {n: Counter() for n in range(longest + 1)}
    for r in counted.groupBy("n", "lang").agg(F.sum("c").alias("c")).collect():
        totals[r.n][r.lang] = int(r.c)
    languages = sorted(totals[0])
    top = Window.partitionBy("n").orderBy(F.desc("all"), "u")
    picked = by_unit.withColumn("k", F.row_number().over(top)).where(F.col("k") <= max_units)
    tables: list[dict[str, np.ndarray]] = [{} for _ in range(longest + 1)]
    for r in picked.select("n", "u", "by").collect():
        share = [(r.by.get(g, 0) + 0.5) / (totals[r.n][g] + 0.5) for g in languages]
        tables[r.n][r.u] = np.log(share)
    return LanguageModel(languages, tables)


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own = model.value
        for batch in batches:
            for part in slices(batch, "text"):
                got = [own.predict(t) for t in part.column("text").to_pylist()]
                yield {
                    "doc_id": part.column("doc_id"),
                    "lang_pred": [g[0] for g in got],
                    "score": np.array([g[1] for g in got], dtype=np.float64),
                }

    return run


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``docs``, from the whole text alone.

    Null texts and texts without a letter are ``und`` with score 0, as are all texts under a
    model that has seen no language. Letters of no known word or n-gram leave the languages equal; the first in
    order is named then, as of any languages of equal score. Texts of any length are read whole; a worker holds the distinct words of
    one. Repeated rows get equal results, an empty table none, other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_rows(rows, _predict(shared), PREDICTIONS)
