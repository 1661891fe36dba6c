import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrow.llm import vector_codes
from windrow.llm.vector_codes import Codebooks, advance, compressed, scan


def brute(vectors, parts=4, entries=256, rounds=4, scale=1024):
    """Plain Lloyd with Python integers: ({row: (code, error)}, final entries)."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts if kept else 0
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, v in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min((far(v, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        found = [[near(c[p], p)[1] for p in range(parts)] for c in cut]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [c[p] for c, f in zip(cut, found) if f[p] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    out = []
    for (i, _), c in zip(kept, cut):
        best = [near(c[p], p) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
    return sorted(out, key=str), books


def rows(n, width, seed=3, ties=True):
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 0.3, (n, width))
    if ties:  # coarse values, so that distances tie
        v = np.round(v * 4) / 4
    return [(int(i), [float(x) for x in r]) for i, r in zip(rng.permutation(n * 2)[:n], v)]


def frame(spark, data, slices=5):
    made = spark.createDataFrame([(i, v, None if k % 5 == 0 else k % 3) for k, (i, v) in enumerate(data)], "vec_id bigint, embedding array<double>, label int")
    return made.repartition(slices)


def run(df, **more):
    found, books = compressed(df, **more)
    return sorted((r.id, r.code, r.error) for r in found.collect()) if found.where("id IS NULL").count() == 0 else sorted(map(tuple, found.select("id", "code", "error").collect()), key=str), books


@pytest.mark.parametrize("ties", [True, False])
@pytest.mark.parametrize("block", [7, 4096])
def test_against_plain_lloyd(spark, ties, block, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    data = rows(300, 8, ties=ties)
    got, books = run(frame(spark, data), entries=16)
    want, entries = brute(data, entries=16)
    assert sorted(got, key=str) == want
    assert books.entries.tolist() == entries
    assert books.digest() == hashlib.sha256(",".join(str(x) for p in entries for e in p for x in e).encode()).hexdigest()


def test_odd_rows(spark):
    data = rows(40, 8) + [(1, None), (2, [1.0, None] * 4), (3, [math.nan] * 8), (4, [math.inf] * 8), (None, [0.5] * 8), (None, [-0.25] * 8), (7, [0.1] * 8), (7, [0.1] * 8)]
    df = frame(spark, data).withColumns({c: F.lit(1) for c in ("id", "block", "ids", "parts", "v", "code", "error", "keys", "rows")})
    for entries in (4, 256):  # fewer entries than rows, and more
        assert sorted(run(df, entries=entries)[0], key=str) == brute(data, entries=entries)[0]
    one = frame(spark, [(i, [0.5] * 8) for i in range(20)])
    assert {r[1:] for r in run(one)[0]} == {("00000000", 0)}
    assert compressed(frame(spark, []))[0].count() == 0 and compressed(frame(spark, [(1, None)]))[0].count() == 0


def test_vectors_that_do_not_fit_are_refused(spark):
    for data in ([(1, [0.0] * 8), (2, [0.0] * 4)], [(1, [0.0] * 6)], [(1, [1e9] * 8)]):
        with pytest.raises(ValueError):
            compressed(frame(spark, data))


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(5)
    data = [(i, [float(x) for x in rng.integers(-120_000, 120_000, 8)]) for i in range(60)]
    assert sorted(run(frame(spark, data), entries=8)[0], key=str) == brute(data, entries=8)[0]


def test_only_what_drift_has_violated_is_scanned(monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.integers(-4000, 4000, (16, 6))
    parts = (centres[rng.integers(0, 16, 2000)] + rng.integers(-40, 40, (2000, 6)))[None]
    books = Codebooks.of(centres[:, None, :] + 30, 5000)
    state, scanned = None, []

    def counted(rows_, entries, exact):
        scanned.append(len(rows_))
        return scan(rows_, entries, exact)

    monkeypatch.setattr(vector_codes, "scan", counted)
    for _ in range(4):
        changes = np.zeros((1, 16, 7), np.int64)
        state = advance(parts, state, books, changes)
        near = ((parts[0][:, None, :] - books.entries[0][None]) ** 2).sum(axis=2).argmin(axis=1)
        assert (state[0].codes(2000) == near).all()
        books = books.moved(changes)
    assert scanned[0] == 2000 and sum(scanned[1:]) < 400


def test_rounds_do_not_shuffle_vectors(spark, monkeypatch):
    plans = []
    before = vector_codes.with_state

    def seen(*a):
        plans.append(out := before(*a))
        return out

    monkeypatch.setattr(vector_codes, "with_state", seen)
    monkeypatch.setattr(vector_codes.Bucketed, "drop", lambda self: None)
    compressed(frame(spark, rows(200, 8)), entries=8)
    assert len(plans) == 5
    for p in plans:
        assert "Exchange" not in p._jdf.queryExecution().executedPlan().toString()


def test_nothing_is_left_in_the_catalog(spark):
    before = {t.name for t in spark.catalog.listTables()}
    compressed(frame(spark, rows(20, 8)), entries=4)
    assert {t.name for t in spark.catalog.listTables()} == before
