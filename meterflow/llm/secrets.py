"""Secrets by fixed patterns and by character Markov models of random strings and ordinary identifiers.

Everything here is DataFrame functions; texts are never handed to Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of spans in the order in which they are listed, and the pattern and shortest length of each.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_MIN = 6
#: Runs that are too short can't hold a longer run, so the length may stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")

#: Strings that the models judge.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Strings the ordinary model learns from.
IDENTIFIER = r"[A-Za-z][A-Za-z0-9_-]{3,}"

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"

#: Documents that labelled strings are taken from: for random strings, and for ordinary ones.
RANDOM_DOCS, ORDINARY_DOCS = 20_000, 2_000

#: Pairs of characters that a character's own frequency weighs as much as.
BACKOFF = 5.0

#: Elements that are added up in one go; keeps sums over long arrays from copying all that came before.
BLOCK = 256


@dataclass(frozen=True)
class MarkovModel:
    """Log-likelihood ratio, random against ordinary, of each pair of characters of ``ALPHABET``."""

    ratios: tuple[float, ...]
    threshold: float = 1.0

    def column(self) -> Column:
        # One text that the optimizer folds into a single array, rather than thousands of literals.
        return F.split(F.lit(",".join(f"{r:.5f}" for r in self.ratios)), ",").cast("array<double>")


def _bigrams(strings: DataFrame) -> DataFrame:
    """Weighted counts of pairs of characters of ``ALPHABET`` by label."""
    at = F.explode(F.sequence(F.lit(1), F.length("value") - 1))
    pairs = strings.where(F.length("value") > 1).select("label", "weight", "value", at.alias("i"))
    pairs = pairs.select("label", "weight", F.substr("value", F.col("i"), F.lit(2)).alias("pair"))
    return pairs.groupBy("label", "pair").agg(F.sum("weight").alias("n"))


def _log_likelihoods(counts: list[list[float]], uniform: float) -> list[float]:
    """Log probability of each character after each other one.

    Pairs back off to the character's own frequency, with the weight of ``BACKOFF`` pairs, and a share ``uniform`` of the
    probability is the same for all characters.
    """
    size = len(ALPHABET)
    single = [0.5 + sum(row[j] for row in counts) for j in range(size)]
    all_ = sum(single)
    out = []
    for row in counts:
        n = sum(row)
        out += [
            math.log((1 - uniform) * (row[j] + BACKOFF * single[j] / all_) / (n + BACKOFF) + uniform / size)
            for j in range(size)
        ]
    return out


def train(strings: DataFrame, threshold: float = 1.0) -> MarkovModel:
    """Models of both labels from ``label`` (``random`` or ``ordinary``), ``value`` and ``weight``.

    Half of the random model is the even distribution over the alphabet, so that random strings of other
    alphabets than the sample's are known too. What comes to the driver is at most two tables of pairs of characters.
    """
    size = len(ALPHABET)
    place = {c: i for i, c in enumerate(ALPHABET)}
    counts = {k: [[0.0] * size for _ in range(size)] for k in ("random", "ordinary")}
    pairs = _bigrams(strings).where(F.col("pair").rlike(f"^[{ALPHABET[:-5]}+/_=-]{{2}}$"))
    for r in pairs.collect():
        counts[r.label][place[r.pair[0]]][place[r.pair[1]]] += float(r.n)
    random, ordinary = _log_likelihoods(counts["random"], 0.5), _log_likelihoods(counts["ordinary"], 0.0)
    return MarkovModel(tuple(a - b for a, b in zip(random, ordinary, strict=True)), threshold)


def labelled_strings(docs: DataFrame, random_docs: int = RANDOM_DOCS, ordinary_docs: int = ORDINARY_DOCS) -> DataFrame:
    """Labelled strings of a bounded sample of documents: values of the fixed patterns, and identifiers.

    The sample has the documents whose hash lies below a bound that follows from the number of rows.
    """
    total = max(1, docs.count())
    place = F.pmod(F.xxhash64("text"), F.lit(1_000_000))
    some = docs.select("text", place.alias("p")).where(F.col("p") < math.ceil(1e6 * random_docs / total))
    values = F.concat(*[F.regexp_extract_all("text", F.lit(p), F.lit(g)) for p, g in ((ASSIGN, 2), (ACCESS, 0), (HEX, 0))])
    random = some.where(F.col("text").rlike(f"{ASSIGN}|{ACCESS}|{HEX}")).select(F.explode(values).alias("value"))
    # Copies of one text repeat its secrets; each counts once.
    random = random.where(F.length("value") >= 16).distinct().select(F.lit("random").alias("label"), "value", F.lit(1).alias("weight"))
    few = some.where(F.col("p") < math.ceil(1e6 * ordinary_docs / total))
    words = few.select(F.explode(F.regexp_extract_all("text", F.lit(f"({IDENTIFIER})"))).alias("value"))
    words = words.where(~F.col("value").rlike(f"{HEX}|{ACCESS}"))
    words = words.groupBy("value").agg(F.count(F.lit(1)).alias("weight")).select(F.lit("ordinary").alias("label"), "value", "weight")
    return random.unionByName(words.withColumn("weight", F.col("weight").cast("int")))


def _running(gaps: Column, lengths: Column) -> Column:
    """Start and end of each match, from the length of the text before it and its own."""
    items = F.zip_with(gaps, lengths, lambda g, n: F.struct(g.cast("long").alias("gap"), n.cast("long").alias("len")))
    zero, none = F.lit(0).cast("long"), F.array().cast("array<struct<start:bigint,end:bigint>>")
    blocks = F.sequence(F.lit(0), F.size(items) - 1, F.lit(BLOCK))
    sums = F.transform(
        blocks, lambda b: F.aggregate(F.slice(items, b + 1, BLOCK), zero, lambda s, x: s + x["gap"] + x["len"])
    )
    heads = F.aggregate(
        sums,
        F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out")),
        lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")),
    )["out"]
    return F.flatten(
        F.zip_with(
            blocks,
            heads,
            lambda b, head: F.aggregate(
                F.slice(items, b + 1, BLOCK),
                F.struct(head.alias("at"), none.alias("out")),
                lambda s, x: F.struct(
                    (s["at"] + x["gap"] + x["len"]).alias("at"),
                    F.concat(
                        s["out"],
                        F.array(
                            F.struct((s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + x["len"]).alias("end"))
                        ),
                    ).alias("out"),
                ),
            )["out"],
        )
    )


_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def _found(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Spans of the leftmost non-overlapping matches of ``pattern``, those that ``keep`` (of match and places) leaves."""
    parts = F.transform(F.split(text, pattern, -1), F.length)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    places = _running(F.slice(parts, F.lit(1), F.size(matches)), F.transform(matches, F.length))
    spans = F.transform(places, lambda p: F.struct(p["start"].alias("start"), F.lit(kind).alias("kind"), p["end"].alias("end")))
    if keep is not None:
        spans = F.transform(
            F.filter(F.arrays_zip(spans.alias("s"), keep(text, matches).alias("k")), lambda z: z["k"]), lambda z: z["s"]
        )
    return F.when(text.rlike(pattern), spans.cast(_SPANS)).otherwise(F.array().cast(_SPANS))


def _long_value(text: Column, _: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= ASSIGN_MIN)


def _random_looking(model: MarkovModel):
    """Mean log-likelihood ratio of a string's pairs of characters at or above the threshold."""
    table, size = model.column(), len(ALPHABET)

    def number(value: Column, i: Column) -> Column:
        return F.instr(F.lit(ALPHABET), F.substr(value, i, F.lit(1))) - 1

    def mean(value: Column) -> Column:
        total = F.aggregate(
            F.sequence(F.lit(1), F.length(value) - 1),
            F.lit(0.0),
            lambda s, i: s + F.get(table, number(value, i) * size + number(value, i + 1)),
        )
        return total / (F.length(value) - 1)

    return lambda _, matches: F.transform(matches, lambda v: mean(v) >= model.threshold)


def _text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))
    return F.array_join(shown, ",")


def with_spans(docs: DataFrame, model: MarkovModel, base_name: str = "_base", name: str = "_spans") -> DataFrame:
    """``docs`` with ``base_name`` (spans of the fixed patterns) and ``name`` (those and the models'), by start and then kind."""
    text = F.coalesce("text", F.lit(""))
    base = F.concat(_found(text, ASSIGN, 0, _long_value), _found(text, ACCESS, 1), _found(text, HEX, 2))
    out = docs.withColumn(base_name, F.sort_array(base))
    judged = _found(text, CANDIDATE, 3, _random_looking(model))
    # A judged string is known already only where fixed spans, which come by their start, leave no character of it.
    reach = lambda j: F.aggregate(
        base_name, j["start"], lambda at, b: F.when(b["start"] <= at, F.greatest(at, b["end"])).otherwise(at)
    )
    new = F.filter(judged, lambda j: reach(j) < j["end"])
    return out.withColumn(name, F.sort_array(F.concat(base_name, new)))


def secret_spans(docs: DataFrame, model: MarkovModel) -> DataFrame:
    """Secrets of every row of ``docs`` (``doc_id``, ``text``; other columns are ignored).

    Returns ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov``. Places are code
    points from 0, ends exclusive. Null texts count as empty and have no span; repeated rows get equal results, an
    empty table gives none.
    """
    rows = with_spans(docs.select("doc_id", "text"), model)
    count = lambda spans, kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        count("_base", 0).alias("n_assign"),
        count("_base", 1).alias("n_access"),
        count("_base", 2).alias("n_hex"),
        F.sha2(_text(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        _text(F.col("_spans")).alias("spans"),
        count("_spans", 3).alias("n_markov"),
    )


def free_name(columns: list[str], name: str) -> str:
    """``name``, with as many underscores in front as none of ``columns`` has it, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def redact(docs: DataFrame, model: MarkovModel, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each run of overlapping spans of its text replaced by ``mark``; all other rows and columns as they are.

    A column ``n_chars`` of the input is set to the new length where the text has changed. Null texts stay null. Columns of any
    name keep their values. Long texts are taken whole, their spans with them in one row.
    """
    columns = docs.columns
    base, spans = (free_name(columns, name) for name in ("_base", "_spans"))
    rows = with_spans(docs, model, base, spans)
    text = F.col("text")
    none = F.array().cast("array<string>")
    walked = F.aggregate(
        F.col(spans),
        F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")),
        lambda s, x: F.when(x["start"] < s["at"], F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out"))).otherwise(
            F.struct(
                x["end"].alias("at"),
                F.concat(
                    s["out"],
                    F.array(F.substr(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(mark)),
                ).alias("out"),
            )
        ),
    )
    clean = F.concat(F.array_join(walked["out"], ""), F.substr(text, (walked["at"] + 1).cast("int")))
    changed = F.size(spans) > 0
    rows = rows.withColumn("text", F.when(changed, clean).otherwise(text))
    if "n_chars" in columns:
        rows = rows.withColumn("n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return rows.select(*[F.col(f"`{c}`") for c in columns])
