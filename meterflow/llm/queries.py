"""The operators of this subpackage as queries on the given tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the 32k piece vocabulary."""
    from meterflow.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


@_query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens, mixed by source."""
    from meterflow.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), 1024)


def _fold(of: int) -> Column:
    """The fold of a document: the checksum of its id as text."""
    return F.crc32(F.col("doc_id").cast("string")) % of


@_query
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the folds that are not held out."""
    from meterflow.llm.language import fit, predict

    docs = _table(spark, sf_dir, "documents")
    model = fit(docs.where(_fold(4) != 2))
    # A null id has no remainder, so its document is in no fold: it isn't learnt from, nor counted as held out.
    held_out = F.coalesce(_fold(4) == 2, F.lit(False))
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@_query
def op4_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word, line and repetition counts of every document and the verdict."""
    from meterflow.llm.repetition import repetition_rules

    return repetition_rules(_table(spark, sf_dir, "documents"))


@_query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels of the folds that are not held out."""
    from meterflow.llm.toxicity import fit, toxicity_scores

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(_fold(3) != 1))
    scores = toxicity_scores(docs, model, 0.7)
    return scores.select("doc_id", F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


@_query
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: five words, similarity 0.75."""
    from meterflow.llm.neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), 75)


@_query
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, with models trained on labelled strings of the documents."""
    from meterflow.llm.secrets import labelled_strings, secret_spans, train

    docs = _table(spark, sf_dir, "documents")
    return secret_spans(docs, train(labelled_strings(docs)))


@_query
def op6_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold items of the benchmark, as they are or with other values."""
    from meterflow.llm.templates import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from meterflow.llm.html import main_texts

    return main_texts(_table(spark, sf_dir, "pages"))


@_query
def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with personal values replaced by pseudonyms under the key of the session.

    Without ``spark.meterflow.pseudonymSecret`` the session gets a random key, which nobody has afterwards. The name of
    the setting is of those that Spark hides in its logs.
    """
    import secrets

    from meterflow.llm.pseudonyms import pseudonyms

    name = "spark.meterflow.pseudonymSecret"
    if not spark.conf.get(name, None):
        spark.conf.set(name, secrets.token_hex(32))
    return pseudonyms(_table(spark, sf_dir, "documents"), spark.conf.get(name).encode())


@_query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document; every tenth has a repeated tail."""
    from meterflow.llm.runs import periodic_runs

    docs = _table(spark, sf_dir, "documents")
    h = F.crc32(F.col("doc_id").cast("string"))
    found = periodic_runs(docs, F.when(h % 10 == 0, F.floor(h / 10)))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[n].cast("string") for n in ("start", "length", "period")]))
    # The longest; of equal ones the first, then the one of the shortest period.
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.n")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(1000 * -best.n) div best.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@_query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of two to five words of each language, over all documents."""
    from meterflow.llm.phrases import collocations

    return collocations(_table(spark, sf_dir, "documents"), 100, 2000)


ORACLES["op12_collocations"] = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS gram
      FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(ws) >= k),
f AS (SELECT lang, k, gram, count(*) AS f FROM g GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, gram, f AS a, string_split(gram, ' ') AS ws FROM f WHERE k >= 2 AND f >= 100),
inner_grams AS (SELECT lang, j, a, unnest(list_transform(range(1, k - j + 2), lambda i: array_to_string(ws[i:i + j - 1], ' '))) AS gram
          FROM c, (SELECT unnest([2, 3, 4]) AS j) WHERE j < k),
kept AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM inner_grams i WHERE i.lang = c.lang AND i.gram = c.gram AND 100 * i.a >= 100 * c.a)),
cut AS (SELECT lang, gram, a, x, array_to_string(ws[1:x], ' ') AS b, array_to_string(ws[x + 1:], ' ') AS e
        FROM kept, (SELECT unnest([1, 2, 3, 4]) AS x) WHERE x < k),
s AS (SELECT cut.lang, cut.gram, a, x, l.f AS l, r.f AS r, n,
             (1000::HUGEINT * a::HUGEINT * n::HUGEINT) // (l.f::HUGEINT * r.f::HUGEINT) AS score
      FROM cut JOIN f l ON l.lang = cut.lang AND l.gram = b JOIN f r ON r.lang = cut.lang AND r.gram = e JOIN total ON total.lang = cut.lang),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, gram ORDER BY score, x) AS o FROM s),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, gram) AS rank FROM best WHERE o = 1)
SELECT lang, CAST(rank AS BIGINT) AS rank, gram AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""


@_query
def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document, learnt from the folds that are not held out; a null id is not."""
    from meterflow.llm.maxent import score, train

    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(_fold(7) == 2, F.lit(False))
    scores = score(docs, train(docs.where(~held_out)))
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
