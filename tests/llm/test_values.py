"""Pseudonyms one to one and turned back, words told apart, links of rows that share an id."""

import datetime
import itertools
import random

import numpy as np
import pytest

from meterflow.llm import neardup, pseudonyms, queries
from meterflow.llm.texts import word_hashes

FORMS = {"dmy": "{d:02d}/{m:02d}/{y}", "mdy": "{m:02d}/{d:02d}/{y}", "iso": "{y}-{m:02d}-{d:02d}", "plain": "{d}.{m}.{y}", "short": "{m}/{d}/{y}"}


@pytest.mark.parametrize("form", FORMS)
def test_every_date_of_two_centuries(form):
    """One to one, turned back, and each pseudonym a date of the same written form."""
    f = pseudonyms.Feistel(b"key")
    to, back = (lambda x, n, t, b=b: f.permute(x, n, t, b) for b in (False, True))
    day, seen = datetime.date(1900, 1, 1), {}
    step = 1 if form == "dmy" else 5
    while day.year <= 2100:
        text = FORMS[form].format(d=day.day, m=day.month, y=day.year)
        new = pseudonyms._date(text, to)
        assert pseudonyms._date(new, back) == text and [len(p) for p in new.split("/")] == [len(p) for p in text.split("/")]
        assert seen.setdefault(new, text) == text
        day += datetime.timedelta(days=step)
    assert sum(a == b for a, b in seen.items()) < 5


@pytest.mark.parametrize("text", ["31/02/2020", "00/10/2020", "2020-13-13", "2020-02-30", "10/10/0000", "29.02.1900"])
def test_no_dates(text):
    assert pseudonyms._date(text, lambda x, n, t: x) is None


PHONES = [
    ["+33612345678", "+33 6 12 34 56 78", "+33 (0)6 12 34 56 78", "+33.6.12.34.56.78"],
    ["+442071234567", "+44 20 7123 4567", "+44 (0)20 7123 4567"],
    ["+1 (415) 555-2671", "(415) 555-2671", "415-555-2671", "+14155552671", "415.555.2671"],
    ["+358 40 1234567", "+358401234567"],
]


@pytest.mark.parametrize("same", PHONES)
def test_phones_are_linked_in_all_spacings(same):
    f = pseudonyms.Feistel(b"key")
    found = set()
    for text in same:
        new, counts = pseudonyms.pseudonymise(f"call {text} now", f)
        assert counts == {"phone": 1} and pseudonyms.pseudonymise(new, f, back=True)[0] == f"call {text} now"
        digits = pseudonyms._digits(new.replace("(0)", ""))
        found.add(digits if "+" in text else "1" + digits)
    assert len(found) == 1 and pseudonyms._digits(same[0]) not in found
    assert next(iter(found)).startswith(pseudonyms._digits(same[0])[: 3 if same[0].startswith("+358") else 1])


def test_all_of_a_long_key_counts():
    a, b = (pseudonyms.Feistel(b"k" * 64 + end) for end in (b"a", b"b"))
    assert [a.permute(x, 10**6, b"t") for x in range(20)] != [b.permute(x, 10**6, b"t") for x in range(20)]


def test_no_key_stands_in_the_source(spark, docs, tmp_path):
    docs((1, "born 16/01/1990"), (2, "16/01/1990")).write.parquet(f"{tmp_path}/documents.parquet")
    name = "spark.meterflow.pseudonymSecret"
    keys, texts = set(), set()
    for _ in range(2):
        spark.conf.unset(name)
        rows = {r.doc_id: r.text for r in queries.QUERIES["op5_pseudonyms"](spark, str(tmp_path)).collect()}
        assert rows[1] == f"born {rows[2]}" and rows[2] != "16/01/1990"
        keys.add(spark.conf.get(name))
        texts.add(rows[2])
    assert len(keys) == len(texts) == 2


def doubled(n):
    """Words of 2**n letters that polynomial hashes modulo 2**64 can't tell apart."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_words_that_polynomials_confuse(docs):
    a, b = doubled(10)
    hashes, _ = word_hashes([f"{a} {b}"], lower=False)
    assert hashes[0] != hashes[1]
    rows = [(1, f"{a} one two three four"), (2, f"{b} one two three four")]
    assert all(r.kept and r.component_id == r.doc_id for r in neardup.near_duplicates(docs(*rows)).collect())


def test_rows_that_share_an_id_are_linked_by_any_text(docs):
    rng = random.Random(7)
    texts = [" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=200)) for _ in range(4)]
    near = [t.replace(" ", " ", 1) + " tail" for t in texts]
    rows = [(1, texts[0]), (1, texts[1]), (2, near[0]), (3, near[1]), (4, texts[2]), (5, near[2]), (6, texts[3])]
    for order in itertools.islice(itertools.permutations(rows), 0, 5040, 1700):
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(*order)).collect()}
        assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}


def test_hashes_of_many_words_differ():
    words = [f"w{i}" for i in range(200_000)]
    hashes, first = word_hashes([" ".join(words), None], lower=True)
    assert len(np.unique(hashes)) == len(words) and first.tolist() == [0, 200_000, 200_000]
