import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from windrow.operators import windows as win


def events(spark, seconds, key=None):
    return spark.createDataFrame([(s, key) for s in seconds], "sec bigint, k string")


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.window_start, r.window_end), []).append(r.sec)
    return {k: sorted(v) for k, v in out.items()}


def test_boundaries(spark):
    e = events(spark, [0, 59, 60, 61, 120])
    assert got(win.anchored_inclusive(e, 60)) == {(0, 60): [0, 59, 60], (60, 120): [60, 61, 120], (120, 180): [120]}
    assert got(win.half_open(e, 60)) == {(0, 60): [0, 59], (60, 120): [60, 61], (120, 180): [120]}


def test_anchor_is_the_first_event(spark):
    e = events(spark, [7, 67, 68])
    assert got(win.anchored_inclusive(e, 60)) == {(7, 67): [7, 67], (67, 127): [67, 68]}
    assert got(win.epoch_aligned(e, 60)) == {(0, 60): [7], (60, 120): [67, 68]}


def test_sliding_starts_at_the_anchor(spark):
    assert got(win.sliding(events(spark, [0, 60, 119, 120]), 120, 60)) == {(0, 120): [0, 60, 119], (60, 180): [60, 119, 120], (120, 240): [120]}


def test_sliding_with_gaps(spark):
    assert got(win.sliding(events(spark, [0, 29, 30, 59, 60]), 30, 60)) == {(0, 30): [0, 29], (60, 90): [60]}


def test_sessions_merge_at_the_gap(spark):
    rows = win.sessions(events(spark, [0, 300, 601], "a"), "k", 300).collect()
    assert sorted((r.window_start, r.window_end, r.events) for r in rows) == [(0, 300, 2), (601, 601, 1)]


def test_empty_input(spark):
    e = events(spark, [])
    for f in (win.anchored_inclusive, win.half_open, win.sliding):
        assert f(e, 60).count() == 0
    assert win.sessions(e, "k").count() == 0


def test_closed_and_retained(spark):
    e = events(spark, [0, 61, 200])
    assert got(win.closed(win.half_open(e, 60), 200)) == {(0, 60): [0], (60, 120): [61]}
    assert [r.sec for r in win.retained(e, 180, 60).collect()] == [61, 200]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 500), min_size=1, max_size=30, unique=True), st.integers(1, 90))
def test_inclusive_is_half_open_plus_boundaries(spark, seconds, size):
    e = events(spark, seconds)
    half, inclusive, t0 = got(win.half_open(e, size)), got(win.anchored_inclusive(e, size)), min(seconds)
    for s in seconds:
        if (s - t0) % size == 0 and s > t0:
            half.setdefault((s - size, s), []).append(s)
    assert {k: sorted(v) for k, v in half.items()} == inclusive


@pytest.mark.parametrize("size,slide", [(7, 3), (60, 60), (5, 20)])
def test_sliding_against_brute_force(spark, size, slide):
    seconds = [3, 4, 9, 10, 23, 24, 31, 60, 83]
    want = {}
    for k in range(40):
        start = 3 + k * slide
        inside = [s for s in seconds if start <= s < start + size]
        if inside:
            want[(start, start + size)] = inside
    assert got(win.sliding(events(spark, seconds), size, slide)) == want


def test_clock(spark):
    rows = spark.createDataFrame([(0,), (86_399,), (86_400 + 3_661,), (-1,)], "s bigint")
    assert [r.c for r in rows.select(win.clock(F.col("s")).alias("c")).collect()] == ["00:00:00", "23:59:59", "01:01:01", "23:59:59"]
