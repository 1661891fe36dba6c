import json
import os
import threading
import time
from datetime import datetime, timedelta
from functools import partial
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from windrow.config import parse_config
from windrow.operators import documents, sinks
from windrow.operators import windows as win
from windrow.plans.lift import lifted
from windrow.sources import ingest, pull
from windrow.streaming import engine, stateful

BASE = 1704067200
TEXT = """
sources:
  s: {timestamp_field: t, timestamp_format: "2006-01-02 15:04:05", id_field: id, columns: {id: {from_field: id}, v: {from_field: v, type: DOUBLE}},
      reference_tables: {kinds: {columns: {id: VARCHAR, kind: VARCHAR}, rows: [{id: a, kind: x}, {id: b, kind: y}]}}}
queries:
  - {name: anchored, data_source: s, return_type: aggregate, window_size: 60, query: "SELECT COUNT(*) AS n, SUM(v) AS v FROM events"}
  - {name: sliding, data_source: s, return_type: aggregate, window_type: sliding, window_size: 120, query: "SELECT kind, COUNT(*) AS n FROM events JOIN kinds USING (id) GROUP BY kind"}
  - {name: sessions, data_source: s, return_type: aggregate, window_type: session, query: "SELECT COUNT(*) AS n, MAX(v) AS top FROM events"}
"""


def message(sec, id, **more):
    return json.dumps({"_source": "s", "t": str(datetime(2024, 1, 1) + timedelta(seconds=sec)), "id": id, "v": str(sec)} | more)


def add(path, k, lines):
    path.mkdir(exist_ok=True)
    (path / f"{k:03}.txt").write_text("\n".join(lines) + "\n")
    os.utime(path / f"{k:03}.txt", (1_700_000_000 + k, 1_700_000_000 + k))


#: Messages by batch: out of order within the lateness of their window, twice in two batches, of no source, without an id.
BATCHES = [
    [message(0, "a"), message(59, "b"), message(60, "a")],
    [message(58, "c"), message(60, "a"), message(61, "b"), "no json"],
    [message(150, "a"), message(150, "c"), message(152, ""), json.dumps({"_source": "elsewhere"})],
    [message(310, "a"), message(365, "b"), message(308, "a")],
    [message(500, "b"), message(900, "a")],
]


def results(spark, path):
    return sorted((r.window_start - BASE, r.window_end - BASE, r.result) for r in spark.read.parquet(path).collect())


def expected(spark, query, config, gap, now):
    rows = [(m,) for m in dict.fromkeys(m for b in BATCHES for m in b)]
    df = ingest.typed_events(ingest.accepted(ingest.parse_messages(spark.createDataFrame(rows, "raw string"), config.sources)), config.sources["s"])
    session = query.window_type == "session"
    w = win.session_windows(df.where("id <> ''"), "id", gap) if session else win.sliding(df, 120, 60, BASE) if query.window_type == "sliding" else win.anchored_inclusive(df, 60, BASE)
    keys = ("window_start", "window_end", *(("entity",) if session else ()))
    ready = w.where(F.col("window_end") + (gap if session else 0) < BASE + now - win.LATENESS)
    refs = {r.name: ingest.reference_frame(spark, r) for r in config.sources["s"].reference_tables.values()}
    found = sinks.result_rows(lifted(spark, ready, query.text(config.sources["s"]), refs, keys=keys), query.name, "aggregate", keys)
    return sorted((r.window_start - BASE, r.window_end - BASE, r.result) for r in found.collect())


@pytest.mark.parametrize("name", ["anchored", "sliding", "sessions"])
def test_state_gives_the_batch_results_across_a_restart(spark, tmp_path, name):
    config = parse_config(TEXT)
    query = next(q for q in config.queries if q.name == name)
    runner = stateful.StatefulRunner(config, query, f"file://{tmp_path}/out", f"file://{tmp_path}/state", anchor=BASE, gap=100, shards=3)
    figures = stateful.Figures()
    spark.streams.addListener(figures)
    try:
        for part in (BATCHES[:3], BATCHES[3:]):
            done = len(list((tmp_path / "in").glob("*"))) if (tmp_path / "in").exists() else 0
            for k, lines in enumerate(part):
                add(tmp_path / "in", done + k, lines)
            runner.start(engine.message_stream(spark, f"file://{tmp_path}/in", 1)).awaitTermination()
        got = results(spark, runner.results)
        assert got == expected(spark, query, config, 100, 900) and len(got) >= 4
        for _ in range(50):
            if figures.total(name).get("messages") == 16:
                break
            time.sleep(0.1)
        assert figures.total(name) == {"messages": 16, "accepted": 14, "not_json": 1, "unknown_source": 1, "bad_time": 0}
    finally:
        spark.streams.removeListener(figures)


def test_a_configuration_runs_in_the_state_store(spark, tmp_path):
    add(tmp_path / "in", 0, [message(k, "ab"[k % 2]) for k in range(0, 400, 7)])
    queries = engine.run_config(spark, parse_config(TEXT), engine.message_stream(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/out", f"file://{tmp_path}/state", runner=partial(stateful.StatefulRunner, anchor=BASE, shards=2))
    engine.finish(queries)
    assert {s for s, *_ in results(spark, f"file://{tmp_path}/out/anchored")} == {0, 60, 120, 180, 240, 300}
    assert {s for s, *_ in results(spark, f"file://{tmp_path}/out/sliding")} >= {0, 60, 120, 180, 240}


def test_the_anchor_is_looked_up_once(spark, tmp_path):
    config = parse_config(TEXT)
    make = lambda **more: stateful.StatefulRunner(config, config.queries[0], f"file://{tmp_path}/out{len(more)}", f"file://{tmp_path}/state{len(more)}", shards=2, **more)
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="give an anchor"):
        make(lateness=win.LATENESS, gap=5).start(engine.message_stream(spark, f"file://{tmp_path}/none"))
    add(tmp_path / "in", 0, ["no json", message(7, "a"), message(9, "b")])
    add(tmp_path / "in", 1, [message(3, "before the anchor"), message(80, "a"), message(300, "a")])
    make().start(engine.message_stream(spark, f"file://{tmp_path}/in", 1)).awaitTermination()
    add(tmp_path / "in", 2, [message(600, "a")])
    make().start(engine.message_stream(spark, f"file://{tmp_path}/in", 1)).awaitTermination()
    assert [(s, json.loads(r)["n"]) for s, _, r in results(spark, f"file://{tmp_path}/out0")] == [(7, 2), (67, 1), (247, 1)]
    assert spark.read.parquet(f"file://{tmp_path}/state0/anchor").first().anchor == BASE + 7


def test_late_rows_are_divided_off(spark, tmp_path):
    config = parse_config(TEXT)
    runner = stateful.StatefulRunner(config, config.queries[0], f"file://{tmp_path}/out", f"file://{tmp_path}/state", anchor=BASE, shards=2)
    for k, lines in enumerate([[message(0, "a"), message(70, "a")], [message(200, "b")], [message(5, "late"), message(203, "b")], [message(400, "z")]]):
        add(tmp_path / "in", k, lines)
    runner.start(engine.message_stream(spark, f"file://{tmp_path}/in", 1)).awaitTermination()
    assert [(s, json.loads(r)["n"]) for s, _, r in results(spark, runner.results)] == [(0, 1), (60, 1), (180, 2)]
    late = spark.read.parquet(f"{runner.results}/_late").collect()
    assert [(r.window_start - BASE, json.loads(r.fields)["id"], r.behind) for r in late] == [(0, "late", 200 - win.LATENESS - 60)]


class Broker:
    """A log in shards behind HTTP, for tests: what is acknowledged is gone."""

    def __init__(self):
        self.shards, self.first, self.reads = {"0": [], "1": []}, {"0": 0, "1": 0}, 0
        broker = self

        class Handler(BaseHTTPRequestHandler):
            def answer(self, body):
                self.send_response(200)
                self.end_headers()
                self.wfile.write(body.encode())

            def do_GET(self):
                url = urlparse(self.path)
                if url.path == "/shards":
                    return self.answer(json.dumps({k: [broker.first[k], len(v)] for k, v in broker.shards.items()}))
                q = {k: v[0] for k, v in parse_qs(url.query).items()}
                start, end = int(q["from"]), int(q["to"])
                assert start >= broker.first[q["shard"]], "read after its acknowledgement"
                self.answer("".join(json.dumps(m) + "\n" for m in broker.shards[q["shard"]][start:end]))

            def do_POST(self):
                broker.first |= json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                self.answer("")

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}"


@pytest.fixture
def broker():
    b = Broker()
    yield b
    b.server.shutdown()


def test_pulled_messages_are_read_once_across_a_restart(spark, tmp_path, broker):
    spark.dataSource.register(pull.PullSource)

    def run(fail=False):
        def write(df, i):
            if fail:
                raise RuntimeError("no")
            df.write.mode("overwrite").parquet(f"file://{tmp_path}/out/batch={i}")

        stream = spark.readStream.format("windrow_pull").option("url", broker.url).option("messagesPerTask", 3).load()
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()

    for k in range(10):
        broker.shards[str(k % 2)].append(f"m{k}")
    run()
    broker.shards["0"] += ["m10", "m12"]
    broker.shards["2"], broker.first["2"] = ["new"], 0
    with pytest.raises(Exception, match="no"):
        run(fail=True)
    assert broker.first["0"] <= 5 and broker.first["2"] == 0  # what failed is not acknowledged
    run()
    got = [(r.shard, r.position, r.raw) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()]
    want = [(s, i, m) for s, v in broker.shards.items() for i, m in enumerate(v)]
    assert sorted(got) == sorted(want) and len(got) == 13
    broker.shards["1"].append("last")
    run()
    assert broker.first["0"] >= 5 and spark.read.parquet(f"file://{tmp_path}/out").count() == 14


def test_an_epoch_of_documents_is_there_once_or_not_at_all(spark, tmp_path):
    spark.dataSource.register(documents.DocumentSink)
    path = f"file://{tmp_path}/docs"
    add(tmp_path / "in", 0, ["a", "b", "b", "é"])
    stream = spark.readStream.text(f"file://{tmp_path}/in")
    run = lambda df, check: df.writeStream.format("windrow_documents").option("path", path).option("checkpointLocation", f"file://{tmp_path}/{check}").trigger(availableNow=True).start().awaitTermination()
    run(stream, "c")
    read = lambda: sorted(r.value for r in documents.documents_of(spark, path).collect())
    assert read() == ["a", "b", "é"]
    run(stream, "again")  # a new checkpoint: the same epoch runs again
    assert read() == ["a", "b", "é"] and len(list((tmp_path / "docs").glob("epoch=*"))) == 1
    add(tmp_path / "in", 1, ["c", "boom"])
    with pytest.raises(Exception):
        run(stream.withColumn("value", F.when(F.col("value") == "boom", F.raise_error(F.lit("boom")).cast("string")).otherwise(F.col("value"))), "c")
    assert read() == ["a", "b", "é"] and not list((tmp_path / "docs" / "_staged").glob("*"))
    run(stream, "c")
    assert read() == ["a", "b", "boom", "c", "é"]


def test_documents_from_columns_and_aborted_epochs(tmp_path):
    from pyspark.sql import Row

    w = documents.DocumentWriter({"path": f"file://{tmp_path}/d"})
    a = w.write(iter([Row(results=[Row(n=1)], window_start=0)]))
    w.abort([a, None], 0)
    assert not list((tmp_path / "d").rglob("*.json"))
    with pytest.raises(ValueError):
        w.write(x for x in [Row(value="x"), (_ for _ in ()).throw(ValueError())])
    assert not list((tmp_path / "d").rglob("*.json"))
    w.commit([w.write(iter([Row(results=[Row(n=1)], window_start=0)])), w.write(iter([]))], 3)
    assert [json.loads(f.read_text()) for f in (tmp_path / "d").rglob("*.json")] == [{"results": [{"n": 1}], "window_start": 0}]


def test_streaming_top_k_gives_the_batch_result(spark, tmp_path):
    from windrow.plans import positions as plans

    rows = [(k, f"2024-01-01 {k * 37 // 3600:02}:{k * 37 // 60 % 60:02}:{k * 37 % 60:02}", k % 9, ["view", "error", "buy"][k % 3], float(k % 7)) for k in range(1, 300)]
    schema = "event_id bigint, ts string, user_id int, event_type string, value double"
    for i in range(0, len(rows), 60):
        spark.createDataFrame(rows[i : i + 60], schema).coalesce(1).write.mode("append").json(f"file://{tmp_path}/in")
    stamped = lambda df: plans.positions(df.withColumn("ts", F.col("ts").cast("timestamp_ntz")))
    near = lambda df: df.where("lat IS NOT NULL").withColumn("approx_distance", plans.rounded(F.sqrt(F.pow(F.col("lat") - 57.25, 2) + F.pow(F.col("lon") - 10.25, 2)), 4))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
    timed = near(stamped(stream)).withColumn("time", F.timestamp_seconds("sec")).withWatermark("time", "0 seconds")
    found = stateful.streaming_top_k(win.epoch_aligned(timed, 600), [("approx_distance", True), ("event_id", True)], 5, ["event_id", "mmsi", "approx_distance"])
    with stateful.state_provider(spark):
        q = found.writeStream.format("memory").queryName("best").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = win.epoch_aligned(stamped(spark.createDataFrame(rows, schema)), 600)
    last = batch.agg(F.max("sec")).first()[0]
    want = {tuple(r) for r in plans.kattegat_knn(batch.where(F.col("window_end") < last)).collect()}
    assert {tuple(r) for r in spark.table("best").collect()} == want and len(want) > 50


def test_references_are_the_small_side_of_lifted_joins(spark):
    from windrow import queries

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    for name in ("configured_hazard_query", "lifted_spatial_sql"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastNestedLoopJoin BuildRight" in plan and "Cartesian" not in plan and "BroadcastNestedLoopJoin BuildLeft" not in plan
