"""The language model against a plain version, and its gain on held-out texts."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from meterflow.llm import maxent, queries
from meterflow.llm.maxent import score, train


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), ""]


def sentences(n, seed=1):
    """Each word allows only a few to come next, so the words before tell much."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    after = {w: rng.sample(words, 3) for w in words}
    rows = []
    for i in range(n):
        w, out = rng.choice(words), []
        for _ in range(rng.randint(0, 60)):
            out.append(w if rng.random() > 0.02 else f"rare{rng.randint(0, 300)}")
            w = rng.choice(after[w])
        rows.append((i, " ".join(out)))
    return rows


def log_share(model, symbols, target, factor, bias, group=0):
    """Log shares of one factor for one token, written out."""
    logits = bias.astype(float).copy()
    size = model.vocabulary.size
    one, two = symbols
    span = size + 2
    for key in (one, one * span + two + span, two + span * (span + 1)):
        key = key if factor == 0 else key * maxent.WIDTH + group + 1
        row = int(maxent._hashed(np.array([key]))[0])
        logits += model.weights[factor, row]
    return logits - np.log(np.exp(logits - logits.max()).sum()) - logits.max()


def brute_score(model, counts, text):
    """Sum of log10 probabilities, token by token; also checks that all probabilities sum to one."""
    v = model.vocabulary
    names = tokens(text)
    places = [v.places.get(w.encode(), -1) for w in names]
    symbols = [p if 0 <= p < v.size else v.size for p in places]
    total = 0.0
    for i, (w, s) in enumerate(zip(names, symbols)):
        before = (symbols[i - 1] if i > 0 else v.size + 1, symbols[i - 2] if i > 1 else v.size + 1)
        classes = log_share(model, before, None, 0, v.bias[0])
        group = s // maxent.WIDTH if s < v.size else maxent.WIDTH - 1
        if group < maxent.WIDTH - 1:
            inner = log_share(model, before, None, 1, v.bias[1 + group], group)
            assert np.exp(inner).sum() == pytest.approx(1)
            total += (classes[group] + inner[s % maxent.WIDTH]) / math.log(10)
        else:
            total += classes[group] / math.log(10) + math.log10((counts[w] + 1) / model.outside)
        assert np.exp(classes).sum() == pytest.approx(1)
    return total


def test_against_plain_version(docs, monkeypatch):
    rows = sentences(120)
    monkeypatch.setattr(maxent, "KNOWN_WORDS", 30)  # the others are joined
    model = train(docs(*rows))
    counts = collections.Counter(t for _, text in rows for t in tokens(text))
    assert model.tokens == sum(counts.values()) and model.distinct == len(counts)
    assert 0 < model.vocabulary.size <= 30 and np.abs(model.weights).max() > 0
    # Shares of the class of words outside the vocabulary sum to one with an unseen word.
    inside = [w.decode() for w, p in model.vocabulary.places.items() if p < model.vocabulary.size]
    assert model.outside == sum(n + 1 for w, n in counts.items() if w not in inside) + 1
    test = [*rows[:20], (500, "W1 never seen rare1 w2"), (501, None), (501, ""), (None, "w1\x0bw2")]
    for r in score(docs(*test), model).collect():
        text = next(t for i, t in test if i == r.doc_id and (i != 501 or True))
        names = tokens(text)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(names), sum(counts[w] > 0 for w in names), model.tokens)
        base = sum(math.log10((counts[w] + 1) / (model.tokens + model.distinct + 1)) for w in names)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(brute_score(model, counts, text), rel=1e-4)


def test_words_before_help_on_held_out_texts(docs):
    rows = sentences(1500)
    model = train(docs(*rows[:1200]))
    got = score(docs(*rows[1200:]), model).groupBy().sum("n_tokens", "score", "base_score").first()
    # Three in forty come next: at least half a bit a token better than counts alone.
    assert (got[1] - got[2]) / got[0] > 0.5 * math.log10(2)


def test_odd_rows(odd, none, docs):
    empty = train(none)
    assert (empty.tokens, empty.distinct, score(none, empty).count()) == (0, 0, 0)
    assert {(r.score, r.base_score) for r in score(docs((1, "a b"), (2, None)), empty).collect()} == {(0.0, 0.0)}
    model = train(odd)
    got = score(odd, model).collect()
    assert len(got) == 9 and all(r.score < 0 and math.isfinite(r.score) and r.n_known == r.n_tokens for r in got)
    assert max(r.n_tokens for r in got) == 120_001
    assert len({(r.score, r.base_score) for r in got if r.doc_id == 4}) == 1


def test_query(spark, docs, tmp_path):
    rows = sentences(200, 4) + [(None, "w1 w2"), (900, None), (900, None)]
    docs(*rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_language_model"](spark, str(tmp_path)).collect()
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    counts = collections.Counter(t for i, text in rows if not held[i] for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows) and {r.train_tokens for r in got} == {n}
    texts = dict(rows)
    for r in got:
        names = tokens(texts[r.doc_id])
        assert r.held_out == held[r.doc_id] and r.n_known == sum(counts[w] > 0 for w in names)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in names))


def test_sums_of_gradients():
    rng = np.random.default_rng(3)
    # Rows used once, a few times, very often, and three times by one token.
    rows = np.minimum(rng.zipf(1.3, (3000, maxent.FEATURES)) - 1, maxent.ROWS - 1)
    rows[7] = maxent.ROWS - 1
    grad = np.vstack([rng.standard_normal((3000, maxent.WIDTH)), np.zeros((1, maxent.WIDTH))]).astype(np.float32)
    wanted = np.zeros((maxent.ROWS, maxent.WIDTH))
    np.add.at(wanted, rows.ravel(), np.repeat(grad[:-1].astype(float), maxent.FEATURES, axis=0))
    row, count, total = maxent._row_sums(grad, rows)
    assert row.tolist() == np.unique(rows).tolist() and count.tolist() == np.unique(rows, return_counts=True)[1].tolist()
    assert np.abs(total - wanted[row]).max() < 1e-3
    row, count, total = maxent._row_sums(grad[[0, -1]], rows[:1] * 0)
    assert (row.tolist(), count.tolist()) == ([0], [3]) and np.allclose(total, 3 * grad[:1])


@pytest.mark.parametrize("size", [1.0, 60.0, 3000.0])
def test_softmax_of_any_size(size):
    """Shares are right also where exponentials of the logits would leave the range of the numbers."""
    rng = np.random.default_rng(5)
    weights = (rng.standard_normal((maxent.ROWS, maxent.WIDTH)) * size).astype(np.float32)
    bias = rng.standard_normal((3, maxent.WIDTH)).astype(np.float32)
    bias[:, -3:] = -np.inf  # outputs without a word
    rows = rng.integers(0, maxent.ROWS, (500, maxent.FEATURES))
    of_bias, target = rng.integers(0, 3, 500), rng.integers(0, maxent.WIDTH - 3, 500)
    lines, sums, mine = maxent._softmax(rows, bias, of_bias, weights, target)
    logits = weights[rows].astype(float).sum(axis=1) + bias[of_bias]
    logits -= logits.max(axis=1, keepdims=True)
    logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
    assert np.allclose(lines[:-1] / sums[:, None], np.exp(logits), atol=1e-3) and not lines[-1].any()
    assert np.allclose(mine - np.log(sums), logits[np.arange(500), target], rtol=1e-4, atol=1e-3)


def test_places_of_words():
    held = maxent.Vocabulary({b"": 0, b"a": 1, "\u00e5".encode(): 2}, np.array([3, 2, 1]), 3, np.zeros((65, 64), np.float32))
    words = maxent.split_words([b"b A \xc3\xa5 a", None], lower=True).distinct
    assert dict(zip(words.to_pylist(), held.find(words, 3))) == {b"b": -1, b"a": 1, "\u00e5".encode(): 2}
    assert sorted(held.find(words, 2)) == [-1, -1, 1]
    empty = maxent.Vocabulary({}, np.zeros(0, np.int64), 0, np.zeros((65, 64), np.float32))
    assert empty.find(words, 0).tolist() == [-1] * 3 and len(empty.find(words[:0], 0)) == 0
