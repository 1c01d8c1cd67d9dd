"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterflow.llm import queries
from meterflow.llm.runs import follow, openings, periodic_runs
from meterflow.llm.texts import BREAKS, split_words


def brute_runs(w):
    """Every lag, every stretch, every shorter period."""
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            begin = i
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            start, length = begin - q, i - begin + q
            shorter = (all(w[x] == w[x - p] for x in range(start + p, start + length)) for p in range(1, q))
            if length >= max(6, 4 * q) and not any(shorter):
                found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {x for s, m, q in runs for x in range(s + q, s + m)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    tail = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc_id, len(runs), *tail, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_words_are_told_apart():
    texts = [b"A b  a\n", b"", None, b" x\x0by,z. ", "é É".encode()]
    got = split_words(texts, lower=True, breaks=BREAKS)
    words = [[got.distinct[int(c)].as_py().decode() for c in got.codes[a:b]] for a, b in zip(got.first, got.first[1:])]
    assert words == [["a", "b", "a"], [], [], ["x", "y", "z"], ["é", "É"]]
    assert len(set(got.piece[:3])) == 1 and len(set(got.piece[3:6])) == 3
    plain = split_words([b"x,y."], lower=False)
    assert plain.distinct.to_pylist() == [b"x,y."]


@pytest.mark.parametrize("seed", range(6))
def test_runs_against_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 4)):
            w = [rng.randint(0, rng.choice([1, 2, 5])) for _ in range(rng.randint(0, 70))]
            if w and rng.random() < 0.7:
                a, p = rng.randrange(len(w)), rng.randint(1, 12)
                w = w[:a] + w[a : a + p] * rng.randint(3, 9) + w[a:]
            texts.append(w)
        first = np.cumsum([0] + [len(w) for w in texts])
        place, lag = openings(np.array(sum(texts, []), dtype=np.int64), first)
        for k, w in enumerate(texts):
            mine = (place >= first[k]) & (place < first[k + 1])
            assert follow(w, list(zip((place[mine] - first[k]).tolist(), lag[mine].tolist()))) == brute_runs(w)


@pytest.mark.parametrize("words, runs", [
    ([0] * 50_000, [(0, 50_000, 1)]),
    ([0, 1, 2] * 20_000 + [7] + [5] * 6, [(0, 60_000, 3), (60_001, 6, 1)]),
    ([*range(20_000)], []),
    ([0, 0, 0, 0, 0], []),
    ([*range(9)] * 3, []),
])
def test_long_and_edge_texts(words, runs):
    place, lag = openings(np.array(words, dtype=np.int64), np.array([0, len(words)]))
    assert follow(words, list(zip(place.tolist(), lag.tolist()))) == runs


def test_runs_of_odd_rows(odd, none, docs):
    assert periodic_runs(none).count() == 0
    got = periodic_runs(odd).orderBy("n_words").collect()
    assert len(got) == 9 and got[0].runs == [] and got[0].collapsed == ""
    assert [(r.start, r.length, r.period) for r in got[-1].runs] == [(0, 120_000, 2)] and got[-1].collapsed == "long text"
    # The tail of a text without words, and of one word.
    tails = {r.doc_id: r for r in periodic_runs(docs((1, None), (2, "a"), (3, "a b c d e f g h")), F.lit(10**9)).collect()}
    assert (tails[1].n_words, tails[2].collapsed, tails[3].n_words) == (0, "a", 8)


def test_query_against_brute_force(spark, docs, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices("a b c Ü".split(), k=rng.randint(0, 60)))) for i in range(250)]
    rows += [(1000, None), (1001, ""), (None, "x " * 9), (1002, "x\x0by\t" * 40), (1002, "x\x0by\t" * 40), (1003, "u v w " * 500 + "u")]
    docs(*rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path))
    assert got.columns == "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    by = repr
    assert sorted((tuple(r) for r in got.collect()), key=by) == sorted((brute_row(*r) for r in rows), key=by)
    assert sum(r[1] for r in map(tuple, got.collect())) > 20
