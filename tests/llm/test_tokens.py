import zlib

import numpy as np
import public_tokenizers
import pytest

from meterflow.llm import packing, token_counts
from meterflow.llm.texts import pieces

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", " ", "a", "Hello, world! It's  two  spaces.", " leading", "trailing ", "tab\tand\nlines\n\n\nend", "don't, 's 'll",
    "été café ½ 3½a 12,5", "数字 и кириллица 😀", "x\x85y z\xa0w", "<|endoftext|> <s> </s> ▁under", "a" * 5000, " " * 3000,
    "\n \n" * 2000, "word&&& other### last%%%", "a_b, c_", "A\x00 b",
]


def library_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTES).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_the_librarys(text):
    assert np.frombuffer(packing.encode([text], BYTES)[0], "<u4").tolist() == library_ids(text)


def test_counts_are_the_librarys():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = [len(model.encode(t)) for t in TEXTS]
    assert token_counts.count_tokens(TEXTS, PIECES) == want == token_counts.count_tokens(TEXTS, PIECES, by_piece=False)
    assert pieces("a  b") is None and pieces("a b") == ["a", "b"]


def test_no_piece_goes_past_a_space():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert not [p for i in range(model.get_piece_size()) if "▁" in (p := model.id_to_piece(i)).lstrip("▁")]


def test_cache_is_filled_once(spark, docs, tmp_path):
    cache = str(tmp_path / "cache")
    first = docs((1, "same text"), (2, "same text"), (3, None), (4, ""), (None, "no id"))
    got = {r.doc_id: tuple(r)[1:] for r in token_counts.token_counts(first, PIECES, cache, limit=2).collect()}
    count = token_counts.count_tokens(["same text", "no id"], PIECES)
    assert got == {1: (9, count[0], count[0] > 2), 2: (9, count[0], count[0] > 2), 3: (0, 0, False), 4: (0, 0, False), None: (5, count[1], count[1] > 2)}
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == 3
    again = token_counts.token_counts(docs((9, "same text"), (8, "new")), PIECES, cache)
    assert again.count() == 2 and spark.read.parquet(cache).count() == 4
    other = token_counts.token_counts(docs((9, "same text")), BYTES, cache)
    assert other.first().n_tokens == len(library_ids("same text")) and spark.read.parquet(cache).count() == 5


def test_odd_rows_are_counted(odd, none):
    rows = token_counts.token_counts(odd, PIECES).collect()
    assert len(rows) == 9 and all(r.n_tokens is not None for r in rows)
    assert token_counts.token_counts(none, PIECES).count() == 0


def check(rows, texts, length):
    """Every id in one piece, sequences gapless, only the last short."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc_id, text in texts.items():
        ids = np.array([*library_ids(text or ""), 0], dtype="<u4")
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    sizes = {}
    for s, pieces_ in by_sequence.items():
        at = 0
        for r in sorted(pieces_, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        sizes[s] = at
    assert sorted(sizes) == list(range(len(sizes)))
    assert all(n == length for s, n in sizes.items() if s < len(sizes) - 1) and sizes[len(sizes) - 1] <= length


def test_packing_round_trip(docs):
    texts = {i: f"document {i} " * (i % 17 + 1) for i in range(120)} | {200: "long one " * 3000, 201: None, 202: ""}
    df = docs(*[(i, t, None, f"s{i % 5}" if i % 3 else "big") for i, t in texts.items()])
    check(packing.pack(df.repartition(5), BYTES, 32, window_sequences=4).collect(), texts, 32)


def test_windows_hold_target_shares(docs):
    df = docs(*[(i, "word " * 50, None, "abc"[i % 3]) for i in range(300)])
    rows = packing.pack(df, BYTES, 16, {"a": 6, "b": 3, "c": 1}, window_sequences=8).collect()
    total = {s: sum(r.length for r in rows if r.source == s) for s in "abc"}
    window = {}
    for r in rows:
        w = window.setdefault(r.sequence_id // 8, dict.fromkeys("abc", 0))
        w[r.source] += r.length
    # Until the first source is used up, each window has its share, and deficits never pass one token.
    run = dict.fromkeys("abc", 0)
    for w in range(int(total["a"] / 0.6 / 128)):
        for s, share in (("a", 0.6), ("b", 0.3), ("c", 0.1)):
            run[s] += window[w][s]
            assert abs(run[s] - share * 128 * (w + 1)) <= 1.5


def test_windows_of_a_mixture():
    totals, weights = [37, 5, 90, 1], [3, 2, 1, 1]
    mixture = packing.Mixture(totals, weights, 8)
    for w in range(sum(totals) // 8 + 2):
        cut = mixture.cuts(w)
        assert sum(cut) == min(8 * w, sum(totals))
        assert all(a <= b for a, b in zip(cut, mixture.cuts(w + 1), strict=True))
    for j, n in enumerate(totals):
        for at in range(n):
            w = mixture.window_of(j, at)
            assert mixture.cuts(w)[j] <= at < mixture.cuts(w + 1)[j]
            assert mixture.window_of(j, at, w // 2) == w == mixture.window_of(j, at, w + 3)


def test_odd_rows_are_packed(odd, none):
    rows = packing.pack(odd, BYTES, 64).collect()
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
    assert sum(r.start == 0 for r in rows) == 9
    assert packing.pack(none, BYTES, 64).count() == 0
