import random

import pytest
from pyspark.sql import functions as F

from windrow.operators import panes
from windrow.operators import windows as win

def everything():
    v = F.col("v")
    return {"n": panes.count(), "v": panes.total(v), "lo": panes.least(v), "hi": panes.most(v), "avg": panes.mean(v), "ids": panes.distinct(F.col("id")), "q": panes.quantiles(v, (0.0, 0.5, 1.0))}


def events(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [(rng.randrange(900) if k % 50 else None, f"i{rng.randrange(30)}", None if k % 7 == 0 else rng.randrange(100), rng.choice(["a", "b", None])) for k in range(n)]
    return spark.createDataFrame(rows, "sec bigint, id string, v bigint, kind string")


@pytest.mark.parametrize("size, slide", [(60, 40), (300, 7), (30, 45)])
@pytest.mark.parametrize("by", [(), ("kind",)])
def test_panes_equal_windows_over_events(spark, size, slide, by):
    rows = events(spark)
    got = panes.sliding_aggregate(rows, size, slide, everything(), by, anchor=100)
    keys = ("window_start", "window_end", *by)
    want = win.sliding(rows, size, slide, 100).groupBy(*keys).agg(F.count("*").alias("n"), F.sum("v").alias("v"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("avg"))
    order = lambda df: sorted((tuple(r) for r in df.select(*keys, "n", "v", "lo", "hi", "avg").collect()), key=str)
    assert order(got) == order(want) and got.count() > 3
    exact = {tuple(r[k] for k in keys): r for r in win.sliding(rows, size, slide, 100).groupBy(*keys).agg(F.count_distinct("id").alias("ids")).collect()}
    for r in got.collect():
        assert abs(r.ids - exact[tuple(r[k] for k in keys)].ids) <= 1  # few values: the sketch is all but exact
        assert (r.q is None) == (r.lo is None) and (r.q is None or (r.q[0], r.q[2]) == (r.lo, r.hi))


def test_nothing_gives_no_windows(spark):
    assert panes.sliding_aggregate(events(spark).limit(0), 60, 20, everything()).count() == 0


def test_sketches_keep_their_bounds(spark):
    rows = spark.range(200_000).select((F.col("id") % 6000).alias("sec"), F.concat(F.lit("v"), F.col("id") * 7919 % 50_000).alias("id"), (F.col("id") * 104729 % 200_000).alias("v"))
    got = panes.sliding_aggregate(rows, 3000, 1000, {"ids": panes.distinct(F.col("id")), "q": panes.quantiles(F.col("v"), (0.1, 0.5, 0.9))}, anchor=0).where("window_start BETWEEN 0 AND 3000").collect()
    exact = {r.window_start: r for r in win.sliding(rows, 3000, 1000, 0).groupBy("window_start").agg(F.count_distinct("id").alias("ids"), F.percentile("v", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q")).collect()}
    assert len(got) == 4
    for r in got:
        assert abs(r.ids / exact[r.window_start].ids - 1) < 4 * 1.04 / 2 ** (panes.HLL_LOG / 2)
        assert all(abs(a - b) / 200_000 < 0.03 for a, b in zip(r.q, exact[r.window_start].q))


def test_shuffled_rows_do_not_grow_with_the_windows_an_event_is_in(spark):
    """Rows written to shuffles, by the plan's own counters: as many panes, and windows at most twice over."""
    rows = spark.range(50_000).select((F.col("id") % 3600).alias("sec"))

    def shuffled(size):
        df = panes.sliding_aggregate(rows, size, 60, {"n": panes.count()}, anchor=0)
        df.collect()
        plan, found, waiting = df._jdf.queryExecution().executedPlan(), [], []
        waiting.append(plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan)
        while waiting:
            node = waiting.pop()
            if "QueryStage" in node.nodeName():
                waiting.append(node.plan())
                continue
            if node.nodeName() == "Exchange":
                found.append(node.metrics().apply("shuffleRecordsWritten").value())
            children = node.children()
            waiting += [children.apply(i) for i in range(children.size())]
        return found

    few, many = shuffled(120), shuffled(1200)
    assert len(few) == len(many) >= 3
    assert sum(many) < 2 * sum(few) and max(many) < 60 * 4 * 2


def test_streams_of_panes_agree_with_batch(spark, tmp_path):
    rows = [(f"2024-01-01 00:{s // 60:02}:{s % 60:02}", f"i{s % 7}", s % 11) for s in range(0, 1500, 13)]
    path = tmp_path / "in"
    for i in range(0, len(rows), 20):
        spark.createDataFrame(rows[i : i + 20], "ts string, id string, v int").coalesce(1).write.mode("append").json(f"file://{path}")
    typed = lambda df: df.select(F.to_timestamp("ts").alias("ts"), "id", "v")
    stream = typed(spark.readStream.schema("ts string, id string, v int").json(f"file://{path}"))
    wanted = {k: everything()[k] for k in ("n", "v", "ids")}
    counted = panes.streaming_sliding(stream, 300, 60, wanted)
    q = counted.writeStream.format("memory").queryName("paned").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = typed(spark.createDataFrame(rows, "ts string, id string, v int")).withColumn("sec", F.unix_timestamp("ts"))
    first = 1704067200 - 240
    want = {tuple(r) for r in panes.sliding_aggregate(batch, 300, 60, wanted, anchor=first).collect()}
    early = {tuple(r) for r in win.sliding(batch, 300, 60, first).where("window_start < 1704067200").select("window_start").distinct().collect()}
    got = {tuple(r) for r in spark.table("paned").collect()}
    assert got <= want and len(got) >= 18 and {(s,) for s, *_ in got} >= early
    with pytest.raises(ValueError):
        panes.streaming_sliding(stream, 100, 60, wanted)
