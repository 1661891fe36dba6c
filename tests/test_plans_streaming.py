import json

import pytest
from pyspark.sql import functions as F

from windrow.config import parse_config
from windrow.operators import relational, sinks
from windrow.operators import windows as win
from windrow.plans.lift import lifted, window_by_window
from windrow.sources import ingest
from windrow.streaming import engine

CONFIG = """
sources:
  s:
    timestamp_field: t
    timestamp_format: "2006-01-02 15:04:05"
    id_field: id
    columns: {id: {from_field: id, required: true}, v: {from_field: v, type: DOUBLE}}
    reference_tables: {kinds: {columns: {id: VARCHAR, kind: VARCHAR}, rows: [{id: a, kind: x}, {id: b, kind: y}]}}
queries:
  - {name: count, data_source: s, window_size: 60, query: "SELECT COUNT(DISTINCT id) AS n, SUM(v) AS v FROM events", return_type: aggregate}
  - {name: kinds, data_source: s, window_size: 60, query: "SELECT kind, COUNT(*) AS n FROM events JOIN kinds USING (id) GROUP BY kind ORDER BY n, kind LIMIT 1", return_type: aggregate}
  - {name: slide, data_source: s, window_type: sliding, window_size: 120, query: "SELECT COUNT(*) AS n FROM events", return_type: aggregate}
"""
SECONDS = [(0, "a"), (59, "b"), (60, "a"), (61, "b"), (150, "a"), (150, "c"), (310, "a"), (365, "b"), (500, "b"), (900, "a")]


def messages():
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    return [json.dumps({"_source": "s", "t": str(start + timedelta(seconds=s)), "id": i, "v": str(s)}) for s, i in SECONDS]


def windowed(spark):
    rows = spark.createDataFrame([(s, i, float(s)) for s, i in SECONDS], "sec bigint, id string, v double")
    return win.anchored_inclusive(rows, 60, 0)


@pytest.mark.parametrize("sql", ["SELECT id, COUNT(*) AS n FROM events GROUP BY id", "SELECT id FROM events ORDER BY v DESC, id LIMIT 2", "SELECT COUNT(*) AS n FROM events WHERE v > 1000", "WITH t AS (SELECT MAX(v) AS m FROM events) SELECT m FROM t", "SELECT id, ROW_NUMBER() OVER (ORDER BY v, id) AS k FROM events"])
def test_lifted_equals_window_by_window(spark, sql):
    w = windowed(spark)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(lifted(spark, w, sql)) == rows(window_by_window(spark, w, sql))


def test_rollup_falls_back(spark):
    got = lifted(spark, windowed(spark), "SELECT id, COUNT(*) AS n FROM events GROUP BY ROLLUP (id)")
    assert got.where("id IS NULL").agg(F.sum("n")).first()[0] == windowed(spark).count()
    with pytest.raises(ValueError):
        window_by_window(spark, windowed(spark), "SELECT 1 AS x FROM events", most_windows=2)


def test_bad_sql_is_an_error(spark):
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        lifted(spark, windowed(spark), "SELECT nothing FROM events")


def stream(spark, path, n=3):
    path.mkdir()
    for i in range(0, len(SECONDS), n):
        f = path / f"{i:03}.txt"
        f.write_text("\n".join(messages()[i : i + n]) + "\n")
        import os

        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    return engine.message_stream(spark, f"file://{path}", files_per_trigger=1)


def test_runner_gives_the_batch_results_of_closed_windows(spark, tmp_path):
    config = parse_config(CONFIG)
    engine.finish(engine.run_config(spark, config, stream(spark, tmp_path / "in"), f"file://{tmp_path}/out", f"file://{tmp_path}/state"))
    base = 1704067200
    df = ingest.typed_events(ingest.accepted(ingest.parse_messages(spark.createDataFrame([(m,) for m in messages()], "raw string"), config.sources)), config.sources["s"])
    kinds = {"kinds": ingest.reference_frame(spark, config.sources["s"].reference_tables["kinds"])}
    for q in config.queries:
        w = win.sliding(df, 120, 60, base) if q.window_type == "sliding" else win.anchored_inclusive(df, 60, base)
        want = sinks.result_rows(lifted(spark, win.closed(w, base + 900, win.LATENESS), q.query, kinds), q.name, q.return_type).select("window_start", "result")
        got = spark.read.parquet(f"file://{tmp_path}/out/{q.name}").select("window_start", "result")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 0


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    config = parse_config(CONFIG)
    runner = engine.WindowRunner(config, config.queries[0], f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    parts = [spark.createDataFrame([(m,) for m in messages()[a:b]], "raw string") for a, b in ((0, 5), (5, 10))]
    for part, batch in ((parts[0], 0), (parts[1], 1), (parts[1], 1)):
        runner.batch(part, batch)
    rows = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert len({r.window_start for r in rows}) == len(rows) == 6


def event(source, at, id, **more):
    from datetime import datetime, timedelta

    return json.dumps({"_source": source, "t": str(datetime(2024, 1, 1) + timedelta(seconds=at)), "id": id} | more)


def run_batches(spark, runner, batches):
    """Every batch twice, as after a failure; results by window."""
    for i, batch in enumerate(batches):
        for _ in range(2):
            runner.batch(spark.createDataFrame([(m,) for m in batch], "raw string"), i)
    return [(r.window_start - BASE, r.window_end - BASE, *(r[k] for k in ("entity", "data_source") if k in r), json.loads(r.result)) for r in spark.read.parquet(runner.results).collect()]


BASE = 1704067200


def runner_of(text, tmp_path, **more):
    return engine.WindowRunner(config := parse_config(text), config.queries[0], f"file://{tmp_path}/out", f"file://{tmp_path}/state", **more)


ONE = """
sources: {s: {timestamp_field: t, timestamp_format: "2006-01-02 15:04:05", id_field: id, columns: {id: {from_field: id}, v: {from_field: v, type: DOUBLE}}}}
queries: [{name: q, data_source: s, return_type: aggregate, %s}]
"""


def test_equal_messages_of_several_batches_are_one_event(spark, tmp_path):
    runner = runner_of(ONE % 'window_size: 60, query: "SELECT COUNT(*) AS n FROM events"', tmp_path)
    got = run_batches(spark, runner, [[event("s", 0, "a"), event("s", 1, "b")], [event("s", 0, "a"), event("s", 2, "c"), "no json"], [event("s", 200, "a")]])
    assert got == [(0, 60, {"n": 3})]
    counts = {r.window_start - BASE: r.records_processed for r in spark.read.parquet(f"{runner.results}/_windows").collect()}
    assert counts == {0: 3}
    assert {(r.batch, r.reason, r.messages) for r in spark.read.parquet(f"{runner.results}/_ingest").collect()} == {(0, "accepted", 2), (1, "accepted", 2), (1, "not JSON", 1), (2, "accepted", 1)}


def test_the_state_stays_that_of_open_windows(spark, tmp_path):
    runner = runner_of(ONE % 'window_size: 60, query: "SELECT COUNT(*) AS n FROM events"', tmp_path)
    got = run_batches(spark, runner, [[event("s", 60 * k + 5, "a")] for k in range(8)])
    assert sorted(r[0] for r in got) == [5 + 60 * k for k in range(6)] and all(r[2]["n"] == 2 for r in got)
    assert len(list((tmp_path / "state" / "events").glob("batch=*"))) <= 4 and len(list((tmp_path / "state" / "cursor").glob("of=*"))) <= 2
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("__lift")]


def test_session_queries_run_over_sessions(spark, tmp_path):
    runner = runner_of(ONE % 'window_type: session, query: "SELECT COUNT(*) AS n, MAX(v) AS top FROM events"', tmp_path, gap=100)
    batches = [[event("s", 0, "a", v="1"), event("s", 90, "a", v="7")], [event("s", 90, "a", v="7"), event("s", 180, "a"), event("s", 200, "b", v="2"), event("s", 10, "", v="9")], [event("s", 500, "b"), event("s", 501, "c")], [event("s", 1000, "d"), event("s", 0, "late")]]
    got = sorted(run_batches(spark, runner, batches), key=str)
    assert got == sorted([(0, 180, "a", "s", {"n": 3, "top": 7.0}), (200, 200, "b", "s", {"n": 1, "top": 2.0}), (500, 500, "b", "s", {"n": 1}), (501, 501, "c", "s", {"n": 1})], key=str)
    assert len(list((tmp_path / "state" / "open").glob("batch=*"))) <= 2
    with pytest.raises(ValueError, match="id_field"):
        runner_of((ONE % 'window_type: session, query: "SELECT 1 AS x FROM events"').replace("id_field: id", "id_field: x"), tmp_path).start(None)


def test_session_windows_agree_with_sessions(spark):
    rows = spark.createDataFrame([(s, i) for s, i in SECONDS] * 2 + [(5, None)], "sec bigint, id string")
    got = win.session_windows(rows, "id", 100).groupBy("id", "window_start", "window_end").agg(F.count("*").alias("events"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, win.sessions(rows, "id", 100).select("id", "window_start", "window_end", "events").collect()))


def test_generic_queries_use_the_names_of_each_source(spark, tmp_path):
    text = """
sources:
  s: {timestamp_field: t, timestamp_format: "2006-01-02 15:04:05", id_field: id, columns: {id: {from_field: id}}}
  r: {timestamp_field: t, timestamp_format: "2006-01-02 15:04:05", id_field: "the name", columns: {who: {from_field: "the name"}}}
queries: [{name: q, data_source: generic, return_type: aggregate, window_size: 60, query: "SELECT COUNT(DISTINCT {id_field}) AS n FROM events"}]
"""
    other = json.dumps({"_source": "r", "t": "2024-01-01 00:00:07", "the name": "x"})
    got = run_batches(spark, runner_of(text, tmp_path), [[event("s", 0, "a"), event("s", 1, "b"), other], [event("s", 100, "a")]])
    assert sorted(got, key=str) == [(0, 60, "r", {"n": 1}), (0, 60, "s", {"n": 2})]


def test_alerts_of_a_running_configuration(spark, tmp_path, capsys):
    text = (ONE % 'window_size: 60, query: "SELECT id, v FROM events ORDER BY id", is_alert: true, alert_format: "{id!r} at {v:.1f}"').replace("}]\n", "}, {name: bad, data_source: s, return_type: aggregate, window_type: hopping, window_size: 5, query: q}]\n")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.txt").write_text("\n".join([event("s", 0, "a", v="1.25"), event("s", 1, "b", v="2"), event("s", 100, "c", v="3")]))
    queries = engine.run_config(spark, parse_config(text), engine.message_stream(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    with pytest.raises(RuntimeError, match="^bad: .*hopping[^;]*$"):
        engine.finish(queries)
    said = capsys.readouterr().out
    assert "*** 2 Q WARNING(S) ***" in said and "  'a' at 1.2" in said and "  'b' at 2.0" in said


def test_duplicate_output_names(spark):
    got = lifted(spark, windowed(spark), "SELECT 1 AS x, id, 2 AS x, 3 AS window_end FROM events")
    assert got.columns == ["window_start", "window_end", "id", "x", "window_end_"] and {(r.x, r.window_end_) for r in got.collect()} == {(2, 3)}
    small = {"t": spark.createDataFrame([(5,)], "y int")}
    spark.createDataFrame([(9,)], "y int").createOrReplaceTempView("t")
    for sql in ("SELECT y FROM events, t GROUP BY y", "SELECT y FROM events, t GROUP BY ROLLUP (y) HAVING y IS NOT NULL"):
        assert {r.y for r in lifted(spark, windowed(spark), sql, small).collect()} == {5}
    assert spark.table("t").first().y == 9
    spark.catalog.dropTempView("t")


def test_native_streams_agree_with_batch(spark, tmp_path):
    config = parse_config(CONFIG)
    source = config.sources["s"]
    typed = ingest.typed_events(ingest.accepted(ingest.parse_messages(stream(spark, tmp_path / "in"), config.sources)), source)

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/{name}").start()
        q.awaitTermination()
        return spark.table(name).collect()

    counted = run(engine.streaming_distinct(typed, "id", 60), "counted")
    rows = spark.createDataFrame([(1704067200 + s, i) for s, i in SECONDS], "sec bigint, id string")
    want = {(r.window_start, r.n) for r in win.epoch_aligned(rows, 60).groupBy("window_start").agg(F.count_distinct("id").alias("n")).collect()}
    assert {(r.window_start, r.n) for r in counted} == want - {(1704067200 + 900, 1)}
    sessions = run(engine.streaming_sessions(typed, "id", 100), "sessions")
    every = {(r.id, r.window_start, r.window_end, r.events) for r in win.sessions(rows, "id", 100).collect()}
    got = {(r.id, r.window_start, r.window_end, r.events) for r in sessions}
    assert got <= every and len(every - got) == 1


def test_asof_range_and_topk(spark):
    left = spark.createDataFrame([(1, 10, "a"), (2, 20, "a"), (3, 5, "b"), (4, None, "a"), (5, 20, None)], "id int, t int, k string")
    right = spark.createDataFrame([(9, "a", "x"), (20, "a", "y"), (6, "b", "z")], "u int, k string, v string")
    assert {r.id: r.v for r in relational.asof_join(left, right, "k", "t", "u", ["v"]).collect()} == {1: "x", 2: "y", 3: None, 4: None, 5: None}
    spans = spark.createDataFrame([("p", 0.0, 12.0), ("q", 10.0, 10.0), ("r", 9.0, 1.0)], "name string, lo double, hi double")
    got = relational.range_join(left.select("id", F.col("t").cast("double").alias("t")), spans, "t", "lo", "hi", 4.0)
    assert sorted((r.id, r.name) for r in got.collect()) == [(1, "p"), (1, "q"), (3, "p")]
    assert relational.top_k(left, ["k"], [F.desc("t")], 1).count() == 3


@pytest.mark.parametrize("slices", [2, 5, 50])
def test_asof_in_slices_of_time(spark, slices):
    import random

    rng = random.Random(slices)
    at = lambda: rng.choice([None, *range(60)])
    left = spark.createDataFrame([(i, at(), rng.choice(["hot", "hot", "hot", "b", None])) for i in range(200)], "id int, t int, k string")
    right = spark.createDataFrame([(at(), rng.choice(["hot", "hot", "c", None]), str(i)) for i in range(60)], "u int, k string, v string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    sliced = relational.asof_join(left, right, "k", "t", "u", ["v"], slices)
    assert rows(sliced) == rows(relational.asof_join(left, right, "k", "t", "u", ["v"]))
    assert relational.asof_join(left.limit(0), right.limit(0), "k", "t", "u", ["v"], slices).count() == 0


def test_one_key_is_spread_over_tasks(spark):
    left = spark.range(20_000).select("id", F.lit(1).alias("k"), F.col("id").alias("t"))
    right = spark.range(0, 20_000, 7).select(F.lit(1).alias("k"), F.col("id").alias("u"), F.col("id").alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = relational.asof_join(left, right, "k", "t", "u", ["v"], 16).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(tasks) == 4 and max(r["count"] for r in tasks) < 12_000


def test_documents(spark):
    counted = windowed(spark).groupBy("window_start", "window_end").agg(F.count("*").alias("n"))
    docs = sinks.result_documents(counted, "q", "aggregate")
    first = json.loads(sinks.as_json(docs.orderBy("window_start")).first().value)
    assert first == {"results": [{"n": 3}], "window_start": 0, "window_end": 60, "query": "q", "return_type": "aggregate"}
