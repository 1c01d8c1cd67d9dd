"""Near duplicates by a Hamming join of b-bit MinHash signatures with several indexes, confirmed on whole shingle sets.

A signature has ``SLOTS`` numbers of 16 bits, cut into chunks. By the pigeonhole
principle two signatures that differ in at most ``chunks * (errors + 1) - 1``
slots differ in at most ``errors`` slots of some chunk. Each way to leave out that many slots of a chunk
is an index; rows that agree in one of them are candidates.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from meterflow.llm.texts import map_rows, mix, slices, word_hashes
from meterflow.session import small_side, written

#: Words of a shingle.
WORDS = 5

#: Slots of a signature, slots of a chunk, and slots of a chunk that may differ.
SLOTS, CHUNK, ERRORS = 40, 4, 1

#: Slots in which two signatures may differ before the pair is dropped unseen. At a similarity of 0.75 more than 24 of
#: 40 differ in one pair of 800,000; the indexes themselves miss one of 600,000, and both far fewer above 0.75.
MAX_DISTANCE = 24

#: Blocks the partners of one node are dealt over, and rows held in memory and streamed in one task when signatures are compared.
BLOCKS = 64

HELD_ROWS, STREAMED_ROWS = 2_000, 20_000

#: Slots, of a byte each, of the longer signature that is made where a bucket holds several components, and in how many of them a
#: pair may differ. At a similarity of 0.75 more than 324 of 1,024 differ in one pair of three millions.
FINE_SLOTS, FINE_DISTANCE = 1_024, 324

SCAN = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("n_shingles", LongType(), False),
        StructField("digest", BinaryType()),
        StructField("signature", BinaryType()),
    ]
)
SET = StructType([StructField("node", LongType()), StructField("set", BinaryType(), False)])
FINE = StructType([StructField("node", LongType()), StructField("fine", BinaryType(), False)])
PAIR = StructType([StructField("a", LongType()), StructField("b", LongType())])
LINK = StructType([*PAIR.fields, StructField("shared", LongType(), False), StructField("union", LongType(), False)])

_rng = np.random.default_rng(20_240_601)
_PLACE = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TIMES = _rng.integers(1, 1 << 62, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(1, 1 << 63, 1024, dtype=np.uint64)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct shingles of each text; fewer words than a shingle's make one shingle."""
    words, first = word_hashes(texts, lower=True)
    n = len(words)
    with np.errstate(over="ignore"):
        rolled = np.zeros(n, dtype=np.uint64)
        for j in range(WORDS):
            if n > j:
                rolled[: n - j] += words[j:] * _PLACE[j]
        rolled = mix(rolled)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= WORDS:
                out.append(np.unique(rolled[a : b - WORDS + 1]))
            elif b > a:
                out.append(mix((words[a:b] * _PLACE[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out


def signatures(sets: list[np.ndarray], slots: int, kind: str = "<u2") -> list[bytes | None]:
    """Low bits of the smallest hash of each set under ``slots`` hash functions; None for an empty set."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    full = np.flatnonzero(sizes)
    out: list[bytes | None] = [None] * len(sets)
    if not len(full):
        return out
    values = np.concatenate([sets[i] for i in full])
    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    table = np.empty((len(full), slots), dtype=kind)
    low = np.uint64(np.iinfo(kind).max)
    with np.errstate(over="ignore"):
        for k in range(slots):
            lowest = np.minimum.reduceat((values ^ _PLUS[k]) * _TIMES[k], starts)
            table[:, k] = (mix(lowest) & low).astype(kind)
    for row, i in enumerate(full.tolist()):
        out[i] = table[row].tobytes()
    return out


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _scan(slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text").to_pylist())
                yield {
                    "doc_id": part.column("doc_id"),
                    "n_shingles": np.array([len(s) for s in sets], dtype=np.int64),
                    "digest": pa.array([_digest(s) if len(s) else None for s in sets], type=pa.binary()),
                    "signature": pa.array(signatures(sets, slots), type=pa.binary()),
                }

    return run


def _indexes(slots: int, chunk: int, errors: int) -> list[tuple[int, ...]]:
    """The slots each index looks at: a chunk without as many of its slots as may differ."""
    return [
        kept
        for start in range(0, slots, chunk)
        for kept in itertools.combinations(range(start, min(start + chunk, slots)), max(1, chunk - errors))
    ]


def _index_keys(slots: int, chunk: int, errors: int):
    """A column with the key of a signature in each index."""
    keys = [
        F.xxhash64(F.lit(i), *[F.substring("signature", 2 * s + 1, 2) for s in kept])
        for i, kept in enumerate(_indexes(slots, chunk, errors))
    ]
    return F.array(*keys)


def _close_pairs(slots: int, percent: int, max_distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            x, y = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(-1, slots)
                for c in ("sig_a", "sig_b")
            )
            ok = pa.array((x != y).sum(axis=1) <= max_distance)
            kept = batch.filter(ok)
            yield {"a": kept.column("a"), "b": kept.column("b")}

    return run


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for part in slices(batch, "text"):
            sets = shingle_sets(part.column("text").to_pylist())
            want = part.column("want").to_pylist()
            ok = [len(s) > 0 and _digest(s) == w for s, w in zip(sets, want, strict=True)]
            yield {
                "node": part.column("node").filter(pa.array(ok)),
                "set": pa.array([s.tobytes() for s, k in zip(sets, ok, strict=True) if k], type=pa.binary()),
            }


def _compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held, sets = None, []
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in LINK}
            columns = [batch.column(c).to_pylist() for c in ("a", "block", "role", "b", "set")]
            for a, block, role, b, raw in zip(*columns, strict=True):
                own = np.frombuffer(raw, dtype=np.uint64)
                if role == 0:
                    # One set, or several where different texts have this id.
                    sets = [*(sets if held == (a, block) else []), own]
                    held = (a, block)
                elif held == (a, block):
                    for held_set in sets:
                        at = np.minimum(np.searchsorted(held_set, own), len(held_set) - 1)
                        shared = int((held_set[at] == own).sum())
                        union = len(own) + len(held_set) - shared
                        if 100 * shared >= percent * union:
                            for name, value in (("a", a), ("b", b), ("shared", shared), ("union", union)):
                                out[name].append(value)
            yield out

    return run


def _stored_sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """The whole shingle sets of ``nodes``, made once from the texts and stored."""
    wanted = nodes.join(classes.select("node", F.col("digest").alias("want")), "node")
    texts = docs.join(wanted.hint("shuffle_hash"), docs["doc_id"] == wanted["node"]).select("node", "want", "text")
    # Rows that repeat an id with the same text give the same set; they lie together after the join.
    texts = texts.dropDuplicates()
    return written(map_rows(texts, _sets_of, SET), "sets")


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for part in slices(batch, "set"):
            sets = [np.frombuffer(x, dtype=np.uint64) for x in part.column("set").to_pylist()]
            yield {"node": part.column("node"), "fine": pa.array(signatures(sets, FINE_SLOTS, "u1"), type=pa.binary())}


def _confirm(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole shingle sets overlap by ``percent`` or more.

    The partners of a node are dealt over blocks; each block gets the node's own set first and its partners then pass
    by one at a time, so that a block takes the memory of two sets however many partners there are.
    """
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(BLOCKS)).alias("block"))
    partners = dealt.join(sets.withColumnRenamed("node", "b"), "b").select("a", "block", F.lit(1).alias("role"), "b", "set")
    own = dealt.select("a", "block").distinct().join(sets.withColumnRenamed("node", "a"), "a")
    own = own.select("a", "block", F.lit(0).alias("role"), F.col("a").alias("b"), "set")
    rows = own.unionByName(partners).repartition("a", "block").sortWithinPartitions("a", "block", "role")
    return map_rows(rows, _compare(percent), LINK)


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``node, component``: the smallest node reachable from each node of ``edges`` (``a``, ``b``).

    Labels take the smallest label of their neighbours and then that of their own label; rounds
    end when no label changes. Each round is a table in the shared folder.
    """
    both = written(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges"
    )
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
        near = near.agg(F.min("component").alias("least"))
        step = labels.join(near, "node").select(
            "node", F.col("component").alias("was"), F.least("component", "least").alias("component")
        )
        far = step.select(F.col("node").alias("component"), F.col("component").alias("jump"))
        new = step.join(far, "component", "left").select(
            "node", "was", F.least("component", "jump").alias("component")
        )
        new = written(new, "labels")
        labels = new.select("node", "component")
        if new.where("was <> component").limit(1).count() == 0:
            return labels
    raise RuntimeError(f"components not settled after {max_rounds} rounds")


def _within(slots: int, indexes: list[tuple[int, ...]], percent: int):
    """Close pairs of different components inside one bucket; the held rows come first, then all rows pass by.

    A pair that meets in several indexes is looked at in the first of them only, and one of two held rows once. The held row of a
    pair comes first.
    """
    looked = np.array(indexes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held_of, held, table = None, [], None
        ids = comps = sizes = fine = None
        names = ("key", "held", "streamed", "place", "role", "node", "component", "n_shingles", "signature", "fine", "stray")
        for batch in batches:
            out: dict[str, list] = {"a": [], "b": []}
            for row in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                group = row[:3]
                if row[4] == 0:
                    if held_of != group:
                        held_of, held, table = group, [], None
                    held.append(row)
                    continue
                if held_of != group:
                    continue
                if table is None:
                    ids, comps, sizes = (np.array([r[k] for r in held], dtype=np.int64) for k in (5, 6, 7))
                    table = np.frombuffer(b"".join(r[8] for r in held), dtype="<u2").reshape(-1, slots)
                    fine = np.frombuffer(b"".join(r[9] for r in held), dtype="u1").reshape(-1, FINE_SLOTS)
                near = (comps != row[6]) & (ids < row[5]) if row[10] else comps != row[6]
                near &= 100 * np.minimum(sizes, row[7]) >= percent * np.maximum(sizes, row[7])
                at = np.flatnonzero(near)
                at = at[(fine[at] != np.frombuffer(row[9], dtype="u1")).sum(axis=1) <= FINE_DISTANCE]
                if len(at):
                    same = table[at] == np.frombuffer(row[8], dtype="<u2")
                    at = at[same[:, looked].all(axis=2).argmax(axis=1) == row[3]]
                out["a"] += ids[at].tolist()
                out["b"] += [row[5]] * len(at)
            yield out

    return run


def _rest(
    buckets: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame, slots: int, indexes: list, percent: int
) -> DataFrame:
    """Pairs of one bucket that the comparison with its first node hasn't settled: both other nodes, of different components."""
    members = buckets.where((F.col("n") > 2) & (F.col("node") != F.col("hub"))).select("key", "place", "node")
    members = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    members = written(members.select("key", "place", "node", "component"), "members")
    counts = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = counts.groupBy("key").agg(
        F.sum("n").alias("n"), F.max("n").alias("most"), F.max(F.struct("n", "component"))["component"].alias("main")
    )
    mixed = mixed.where(F.col("n") > F.col("most")).select(
        "key",
        "main",
        F.ceil((F.col("n") - F.col("most")) / HELD_ROWS).cast("int").alias("h"),
        F.ceil(F.col("n") / STREAMED_ROWS).cast("int").alias("s"),
    )
    members = written(members.join(mixed, "key"), "mixed")
    fine = written(map_rows(sets.join(members.select("node").distinct(), "node"), _fine, FINE), "fine")
    rows = members.join(classes.select("node", "n_shingles", "signature"), "node").join(fine, "node")
    rows = rows.withColumn("stray", F.col("component") != F.col("main"))
    number = F.xxhash64("node")
    mine = {"held": F.pmod(number, F.col("h")).cast("int"), "streamed": F.pmod(number, F.col("s")).cast("int")}
    upto = {k: F.explode(F.sequence(F.lit(0), F.col(c) - 1)) for k, c in (("held", "h"), ("streamed", "s"))}
    held = rows.where("stray")
    held = held.withColumns({"held": mine["held"], "streamed": upto["streamed"], "role": F.lit(0)})
    streamed = rows.withColumns({"held": upto["held"], "streamed": mine["streamed"], "role": F.lit(1)})
    columns = ["key", "held", "streamed", "place", "role", "node", "component", "n_shingles", "signature", "fine", "stray"]
    both = held.select(columns).unionByName(streamed.select(columns))
    both = both.repartition("key", "held", "streamed").sortWithinPartitions("key", "held", "streamed", "role")
    return map_rows(both, _within(slots, indexes, percent), PAIR)


def near_duplicates(
    docs: DataFrame,
    percent: int = 75,
    slots: int = SLOTS,
    chunk: int = CHUNK,
    errors: int = ERRORS,
    max_distance: int = MAX_DISTANCE,
) -> DataFrame:
    """Groups of near duplicates among the rows of ``docs`` (``doc_id``, ``text``; other columns are ignored).

    A text's set has its distinct shingles of five words, with A to Z in lower case; a text of fewer words is one shingle.
    Texts are linked if ``100 * intersection >= percent * union``, checked on whole sets.

    Equal sets are one class, for which its smallest ``doc_id`` stands, so copies cost one row each. In each bucket of
    an index every class is compared with the smallest one; where a bucket holds several components after that,
    its other classes are compared across components, in blocks, by longer signatures first. No pair of one component needs to be compared again, so
    large groups cost about as many pairs as they have members.

    Returns a row for each row of ``docs``: ``doc_id, n_shingles, component_id, kept``. Null, empty and
    blank texts have no shingle, are linked with nothing and are kept. So are rows with a null id, whose
    ``component_id`` is null. Rows that share an id are one node, linked by any of their texts. Exact repetitions of a row get equal
    results. An empty table gives an empty one. Very long texts are worked on alone, in memory in proportion to the text.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = written(map_rows(docs, _scan(slots), SCAN), "shingles")
    classes = rows.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull()).groupBy("digest")
    classes = classes.agg(
        F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")
    )
    classes = written(classes, "classes")
    keyed = classes.select("node", F.posexplode(_index_keys(slots, chunk, errors)).alias("place", "key"))
    hubs = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = written(keyed.join(hubs, "key"), "buckets")
    sized = classes.select("node", "n_shingles", "signature")
    left = sized.select(F.col("node").alias("a"), F.col("n_shingles").alias("n_a"), F.col("signature").alias("sig_a"))
    right = sized.select(F.col("node").alias("b"), F.col("n_shingles").alias("n_b"), F.col("signature").alias("sig_b"))
    stars = buckets.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    stars = stars.join(left, "a").join(right, "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    stars = written(map_rows(stars.select("a", "b", "sig_a", "sig_b"), _close_pairs(slots, percent, max_distance), PAIR), "stars")
    sets = _stored_sets(docs, classes, buckets.select("node").distinct())
    links = written(_confirm(sets, stars, percent), "links")
    labels = components(links)
    rest = written(_rest(buckets, labels, classes, sets, slots, _indexes(slots, chunk, errors), percent), "rest")
    more = written(_confirm(sets, rest, percent), "links")
    if more.limit(1).count():
        labels = components(links.unionByName(more))
    named = classes.select("digest", "node").join(labels, "node", "left")
    named = named.select("digest", F.coalesce("component", "node").alias("found"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))
    return rows.join(named, "digest", "left").select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row of each group of near duplicates of ``docs``, with all its columns: the one with the smallest ``doc_id``.

    Of exact repetitions of a row one stays. Rows with a null id stay.
    """
    found = written(near_duplicates(docs, percent).where(F.col("doc_id").isNotNull()), "groups")
    by_id = found.groupBy(F.col("doc_id").alias("_id")).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    gone = small_side(by_id.where(~F.col("kept")).select("_id"))
    left = docs.join(gone, docs["doc_id"] == gone["_id"], "left_anti")
    again = small_side(by_id.where("kept and n > 1").select("_id"))
    if again.limit(1).count() == 0:
        return left
    same = left["doc_id"] == again["_id"]
    return left.join(again, same, "left_anti").unionByName(
        left.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
    )
