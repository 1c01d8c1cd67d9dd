"""Collocations against brute force and SQL."""

import collections
import os
import random
import re

import pytest

import oracle
from meterflow.llm import phrases, queries
from meterflow.llm.phrases import collocations

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def brute(rows, least, top):
    counts, total = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 6):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    candidates = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    out = []
    for (lang, g), a in candidates.items():
        holds = lambda h, g=g: any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))
        if any(x == lang and len(h) > len(g) and b >= a and holds(h) for (x, h), b in candidates.items()):
            continue
        cuts = [(1000 * a * total[lang] // (counts[lang, g[:k]] * counts[lang, g[k:]]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        out.append((lang, " ".join(g), a, counts[lang, g[:k]], counts[lang, g[k:]], total[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    rank = collections.Counter()
    ranked = []
    for r in out:
        rank[r[0]] += 1
        if rank[r[0]] <= top:
            ranked.append((r[0], rank[r[0]], *r[1:]))
    return ranked


def texts(seed, n=60):
    rng = random.Random(seed)
    words = "a b B é the The of x1 '' (c)".split()
    ends = [" ", "  ", "\t", ", ", ". ", "\n", " ", " ", "\x0b", "?! "]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 40)))
        rows.append((text + "one long passage, that is here many times." * rng.randint(0, 2), rng.choice(["en", "de", None])))
    return rows


@pytest.mark.parametrize("least, top, bits", [(3, 2000, 1 << 26), (3, 5, 8), (9, 2000, 1 << 16)])
def test_against_brute_force(docs, least, top, bits):
    """Also with a table so small that rare pairs share a place with frequent ones."""
    rows = texts(least)
    got = collocations(docs(*[(i, t, lang) for i, (t, lang) in enumerate(rows)]), least, top, pair_bits=bits)
    want = brute(rows, least, top)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 4


def test_copies_over_many_partitions(docs):
    rows = texts(5, 20) * 3
    got = collocations(docs(*[(7, t, lang) for t, lang in rows]).repartition(9), 6)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, 6, 2000))


def test_odd_rows(odd, none, docs):
    assert collocations(none).count() == 0
    rows = [(r.text, r.lang) for r in odd.collect()]
    got = sorted(map(tuple, collocations(odd, 2).collect()))
    assert got == sorted(brute(rows, 2, 2000)) and {r[0] for r in got} == {"und"}
    assert collocations(docs((1, "A b", "x"), (2, "a B", "x")), 2).first()[2] == "a b"


def test_products_beyond_64_bits(spark):
    """Counts of a corpus of 10**13 words: the products pass 64 bits."""
    df = spark.sql("SELECT 10000000000L AS a, 10000000000000L AS n, 70000000000L AS l, 30000000001L AS r")
    score = df.select(phrases._exact(1000 * df.a, df.n).alias("u"), phrases._exact(df.l, df.r).alias("d")).selectExpr("u div d")
    assert score.first()[0] == 1000 * 10**10 * 10**13 // (70000000000 * 30000000001)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")
def test_query_gives_the_rows_of_its_sql(spark):
    con = oracle.connect(SF_DIR)
    query = queries.QUERIES["op12_collocations"](spark, SF_DIR)
    assert oracle.differences(con, query, queries.ORACLES["op12_collocations"]) == []
