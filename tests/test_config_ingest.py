import base64
import json

import pytest
from pyspark.sql import functions as F

from windrow.config import load_config, parse_config
from windrow.sources import ingest, replay
from windrow.types import spark_type, time_pattern

YAML = """
sources:
  ships:
    csv_delimiter: ","
    scale_factor: 2
    id_field: MMSI
    timestamp_field: "# Timestamp"
    timestamp_format: "02/01/2006 15:04:05"
    lat_field: Latitude
    lon_field: Longitude
    columns:
      MMSI: {from_field: MMSI}
      Latitude: {from_field: Latitude, type: DOUBLE, required: true}
      status: {from_field: "Navigational status", type: VARCHAR}
    reference_tables:
      zones: {columns: {zone: VARCHAR, limit: DOUBLE}, rows: [{zone: a, limit: 1}, {zone: b, limit: 2.5}]}
queries:
  - {name: n, data_source: ships, window_type: tumbling, window_size: 60, query: "SELECT COUNT(*) AS n FROM events", return_type: aggregate}
  - {name: g, data_source: generic, window_size: 60, query: "SELECT {id_field} FROM events WHERE {lat_field} > 1", return_type: aggregate}
"""


def message(**fields):
    return json.dumps(fields)


@pytest.fixture(scope="module")
def config():
    return parse_config(YAML)


def test_config(config, spark, tmp_path):
    source = config.sources["ships"]
    assert source.columns["Latitude"].required and source.scale_factor == 2
    assert config.queries[1].text(source) == "SELECT `MMSI` FROM events WHERE `Latitude` > 1"
    assert [s.name for s in config.sources_of(config.queries[1])] == ["ships"]
    assert [tuple(r) for r in ingest.reference_frame(spark, source.reference_tables["zones"]).collect()] == [("a", 1.0), ("b", 2.5)]
    (tmp_path / "c.yaml").write_text(YAML)
    assert load_config(spark, f"file://{tmp_path}/c.yaml") == config


@pytest.mark.parametrize("bad", ["name: a, query: q, window_type: hopping, window_size: 5", "name: a, window_size: 5", "name: a, query: q, window_size: 5, data_source: none", "name: a, query: q, window_size: 0", "name: a, query: q, window_size: 5, is_alert: true", "name: good, query: q, window_size: 5", "name: a, query: q, window_size: 5"])
def test_a_bad_query_is_rejected_by_itself(bad):
    returns = "" if bad == "name: a, query: q, window_size: 5" else ", return_type: aggregate"
    config = parse_config(f"queries: [{{name: good, query: q, window_size: 5, return_type: spatial}}, {{{bad}{returns}}}]")
    assert [q.name for q in config.queries] == ["good"] and len(config.rejected) == 1


def test_a_bad_source_is_an_error():
    with pytest.raises(ValueError):
        parse_config("sources: {s: {columns: {a: {type: WHAT}}}}")


def test_types():
    assert spark_type(None).simpleString() == "string"
    assert spark_type("decimal(10,2)").simpleString() == "decimal(10,2)"
    assert time_pattern("02/01/2006 15:04:05") == "dd/MM/yyyy HH:mm:ss"
    assert time_pattern("2006-01-02T15:04:05.000Z07:00") == "yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX"
    assert time_pattern("yyyy-MM-dd") == "yyyy-MM-dd"


def test_messages(spark, config):
    good = dict(_source="ships", MMSI="1", Latitude="57.5", extra="x")
    good["# Timestamp"] = "01/06/2024 00:00:07"
    rows = [message(**good), message(**good), message(**(good | {"Latitude": ""})), message(**(good | {"Latitude": "0.0", "MMSI": ""})), message(**(good | {"_source": "other"})), message(**(good | {"# Timestamp": "1/6/2024"})), "no json", None, message(**(good | {"Latitude": "far", "MMSI": "9"}))]
    df = spark.createDataFrame([(r,) for r in rows], "raw string")
    parsed = ingest.parse_messages(df, config.sources)
    assert {r.reason: r.messages for r in ingest.drop_counts(parsed).collect()} == {"accepted": 5, "unknown source": 1, "bad time": 1, "not JSON": 2}
    typed = ingest.typed_events(ingest.distinct_messages(ingest.accepted(parsed)), config.sources["ships"])
    assert typed.columns == ["Latitude", "MMSI", "status", "ts", "sec"]
    assert sorted((r.Latitude is None, r.Latitude or 0, r.MMSI or "", r.sec) for r in typed.collect()) == [(False, 0.0, "", 1717200007), (False, 57.5, "1", 1717200007), (True, 0, "9", 1717200007)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        ingest.typed_events(ingest.accepted(parsed), config.sources["ships"], strict=True).collect()


def test_push_envelope(spark):
    envelope = json.dumps({"message": {"data": base64.b64encode("{\"a\":\"é\"}".encode()).decode()}})
    rows = ingest.decode_push(spark.createDataFrame([(envelope,), ("{}",), ("x",), (json.dumps({"message": {"data": "%%"}}),)], "value string")).collect()
    assert [r.raw for r in rows] == ['{"a":"é"}', None, None, None]


def test_replay_and_import(spark, config, tmp_path):
    source = config.sources["ships"]
    (tmp_path / "a.csv").write_text("# Timestamp,MMSI,Latitude,Ship type\n01/06/2024 00:00:00,1,57,Cargo\n01/06/2024 00:00:10,2,,\nnever,3,1,x\n")
    messages = replay.replay_messages(spark, source, 1_700_000_000, f"file://{tmp_path}/a.csv")
    found = [json.loads(r.raw) for r in messages.orderBy("ts").collect()]
    assert [(m["# Timestamp"], m["MMSI"], m["Latitude"], m["_source"]) for m in found] == [("14/11/2023 22:13:20", "1", "57", "ships"), ("14/11/2023 22:13:25", "2", "", "ships")]
    imported = [json.loads(r.raw) for r in replay.import_csv(spark, source, f"file://{tmp_path}/a.csv").orderBy("ts").collect()]
    assert [m["shipType"] for m in imported] == ["Cargo", ""]


def test_quotes_are_read_lazily(spark, config, tmp_path):
    lines = ['# Timestamp,MMSI,Latitude,Name', '01/06/2024 00:00:00,1,57,the "Anna" II', '01/06/2024 00:00:01,2,57,"a "bare" one, quoted"', '01/06/2024 00:00:02,3,57,"doubled ""x"" and \\"', '01/06/2024 00:00:03,4,57,5" gun']
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    got = {r.MMSI: r.Name for r in replay.read_csv(spark, config.sources["ships"], f"file://{tmp_path}/a.csv").collect()}
    assert got == {"1": 'the "Anna" II', "2": 'a "bare" one, quoted', "3": 'doubled "x" and \\', "4": '5" gun'}
    (tmp_path / "b.csv").write_text('# Timestamp,MMSI\nx,"two\nlines"\n')
    assert replay.read_csv(spark, config.sources["ships"], f"file://{tmp_path}/b.csv", multiline=True).first().MMSI == "two\nlines"
    (tmp_path / "c.csv").write_text("# Timestamp,MMSI\nx,1,2\n")
    with pytest.raises(Exception, match="MALFORMED"):
        replay.read_csv(spark, config.sources["ships"], f"file://{tmp_path}/c.csv").collect()


def test_window_scan_is_inclusive(spark):
    rows = spark.range(10).withColumnRenamed("id", "sec")
    assert ingest.window_scan(rows, 2, 4).agg(F.sum("sec")).first()[0] == 9


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_window_scan_states_its_bounds_on_the_stored_column(spark, tmp_path, kind):
    spark.range(0, 1000).select("id", F.timestamp_seconds(F.col("id") * 60).cast(kind).alias("ts")).write.parquet(f"file://{tmp_path}/e")
    rows = spark.read.parquet(f"file://{tmp_path}/e").withColumn("sec", F.unix_timestamp(F.col("ts").cast("timestamp")))
    scan = ingest.window_scan(rows, 60 * 200, 60 * 205, "ts")
    assert sorted(r.id for r in scan.collect()) == list(range(200, 206))
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts," in plan and "LessThan(ts," in plan


def test_event_store_reads_only_a_window_s_files(spark, tmp_path):
    path = f"file://{tmp_path}/events"
    rows = spark.range(0, 10_000).select("id", (F.col("id") * 60).alias("sec"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    ingest.store_events(rows.unionByName(spark.createDataFrame([(-1, None, "a"), (-2, 5, None)], "id bigint, sec bigint, source string")), path)
    assert spark.read.parquet(path).count() == 10_000
    scan = ingest.stored_events(spark, path, 60 * 2000, 60 * 2005, ["b"])
    assert sorted(r.id for r in scan.collect()) == [2001, 2003, 2005]
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(period" in plan and "GreaterThanOrEqual(sec,120000)" in plan
    read = scan.select(F.input_file_name().alias("f")).distinct().collect()
    assert len(read) == 1 and "source=b/period=86400" in read[0].f and len(spark.read.parquet(path).inputFiles()) >= 14
    across = ingest.stored_events(spark, path, 86_400 - 60, 86_400)
    assert sorted(r.id for r in across.collect()) == [1439, 1440]


def test_observed_counts(spark, config):
    from pyspark.sql import Observation

    rows = [(message(**{"_source": "ships", "# Timestamp": "01/06/2024 00:00:07"}),), ("no json",), (message(_source="x"),)]
    seen = Observation()
    ingest.observed(ingest.parse_messages(spark.createDataFrame(rows, "raw string"), config.sources), seen).collect()
    assert seen.get == {"messages": 3, "accepted": 1, "not_json": 1, "unknown_source": 1, "bad_time": 0}


def test_published_messages_run_from_the_command_line(spark, config, tmp_path):
    from windrow.__main__ import main

    rows = [(message(**{"_source": "ships", "MMSI": str(k), "Latitude": "5", "# Timestamp": f"01/06/2024 00:{k:02}:00"}), k) for k in range(6)]
    replay.publish(spark.createDataFrame(rows, "raw string, ts int"), f"file://{tmp_path}/in", per_file=2)
    (tmp_path / "c.yaml").write_text(YAML)
    main([f"file://{tmp_path}/{x}" for x in ("c.yaml", "in", "out", "state")])
    got = spark.read.parquet(f"file://{tmp_path}/out/n").orderBy("window_start").collect()
    assert [json.loads(r.result)["n"] for r in got] == [2, 2, 2, 2]
