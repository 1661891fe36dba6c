import hashlib
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import odd_rows
from windrow.llm import fill_in_middle as fim


def brute(doc_id, text, rate=100, suffix_first=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (lines[:lo], lines[lo:hi], lines[hi:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < suffix_first else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


texts = st.lists(st.sampled_from(["a", "\n", "\n\n", "é", "👩‍👩", "<", "<P", "P>", "\r\n", "<M>", "word " * 5]), max_size=30).map("".join)


@given(texts, st.integers(0, 10**6) | st.none(), st.sampled_from([3, 64, 4096]))
def test_transform_and_inverse_against_lists(text, doc_id, leaf):
    before, fim.LEAF = fim.LEAF, leaf
    try:
        n, form, prefix, middle, out = fim.transform(text, doc_id)
        assert (n, form, prefix, middle, str(out)) == brute(doc_id, text)
        assert str(fim.restore(str(out), form)) == text
    finally:
        fim.LEAF = before


@given(texts, st.data())
def test_ropes_split_at_any_rank(text, data):
    before, fim.LEAF = fim.LEAF, 4
    try:
        whole = fim.rope(text)
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        assert (whole.units, whole.chars, str(whole)) == (len(lines), len(text), text)
        k, c = data.draw(st.integers(0, len(lines))), data.draw(st.integers(0, len(text)))
        a, b = fim.split_units(whole, k)
        assert (str(a), str(b)) == ("".join(lines[:k]), "".join(lines[k:])) and (a.units, b.units) == (k, len(lines) - k)
        assert tuple(map(str, fim.split_chars(whole, c))) == (text[:c], text[c:])
    finally:
        fim.LEAF = before


def test_odd_rows(odd, clashing, none):
    got = fim.restored(fim.fill_in_middle(clashing)).collect()
    want = sorted(((i, *brute(i, t), t or "") for i, t in odd_rows()), key=str)
    assert sorted(map(tuple, got), key=str) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.restored(fim.fill_in_middle(none)).count() == 0


def test_rates(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc\nd").alias("text"))
    got = fim.fill_in_middle(df, rate=30, suffix_first=10).collect()
    assert sorted((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == sorted((i, *brute(i, "a\nb\nc\nd", 30, 10)) for i in range(400))


def test_long_texts_are_split_without_recursion_to_their_length():
    text = "line of words\n" * 300_000
    n, form, prefix, middle, out = fim.transform(text, 5)
    assert n == 300_000 and str(fim.restore(str(out), form)) == text
    with pytest.raises(ValueError):
        fim.restore("no sentinel", "psm")
