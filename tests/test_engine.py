"""Operators on small fixtures: NULL, NaN, types, rejections, plans, sources, handles and streams."""

import io
import os
import time

import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import datasource
from pyspark.sql import functions as F

from quillon import Catalog, EngineError, QueryState, submit
from quillon import functions as fn
from quillon import operators as ops
from quillon.operators import AggSpec
from quillon.operators.scan import parse_partition
from quillon.plans import executed_plan, pushed_filters, read_columns, shuffles
from quillon.sources import connector, from_rows, read_files, register, sample_table, summary, write_arrow_stream, write_parquet
from quillon.streaming import parquet_stream, run_to_memory, windowed_counts

DATA = "/root/testdata/sf0.001"
GROUPS = [(1, "a", 10.0), (2, "b", 20.0), (3, "a", 30.0), (4, "b", 40.0), (5, "a", 50.0), (6, "c", 60.0)]
SCHEMA = "id bigint, region string, amount double"


@pytest.fixture
def groups(spark):
    return from_rows(spark, GROUPS, SCHEMA)


def as_map(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_aggregates(groups):
    found = as_map(ops.aggregate(groups, ["region"], ops.parse_specs("count(); sum:amount;min:id;max:id")))
    assert found == {"a": (3, 90.0, 1, 5), "b": (2, 60.0, 2, 4), "c": (1, 60.0, 6, 6)}
    assert ops.aggregate(groups, ["region"], [AggSpec("sum", "amount")]).columns == ["region", "sum_amount"]
    assert ops.aggregate(groups, specs=[AggSpec("sum", "amount")]).first()[0] == 210.0


def test_count_of_a_column_skips_nulls(spark, groups):
    more = groups.union(from_rows(spark, [(7, "a", 70.0), (8, "a", None), (9, "b", 80.0), (10, "b", None)], SCHEMA))
    assert as_map(ops.aggregate(more, ["region"], [AggSpec("count", "amount")])) == {"a": (4,), "b": (3,), "c": (1,)}


def test_null_sums_and_compat(spark):
    df = from_rows(spark, [("a", None), ("a", None), ("b", 3)], "k string, v bigint")
    assert as_map(ops.aggregate(df, ["k"], [AggSpec("sum", "v"), AggSpec("min", "v")])) == {"a": (None, None), "b": (3, 3)}
    assert as_map(df.groupBy("k").agg(fn.sum_or_zero("v"))) == {"a": (0,), "b": (3,)}


def test_null_keys_are_a_group(spark):
    df = from_rows(spark, [(None, 1), (None, 2), ("x", 3)], "k string, v bigint")
    assert as_map(ops.aggregate(df, ["k"], [AggSpec("count")])) == {None: (2,), "x": (1,)}


def test_empty_input(groups):
    none = ops.filter_rows(groups, "id", ">", 100)
    assert ops.aggregate(none, ["region"], [AggSpec("count")]).collect() == []
    assert tuple(ops.aggregate(none, specs=[AggSpec("count"), AggSpec("sum", "amount")]).first()) == (0, None)


def test_floats(spark):
    df = from_rows(spark, [(x,) for x in (float("nan"), float("nan"), 1.0, -0.0, 0.0, float("inf"), None)], "x double")
    assert ops.filter_rows(df, "x", ">", 0).count() == 4
    assert df.where(fn.never_nan("x", F.col("x") > 0)).count() == 2
    assert df.agg(fn.max_ignoring_nan("x")).first()[0] == float("inf")
    assert ops.aggregate(df, ["x"]).count() == 5
    three = from_rows(spark, [(0.1 + 0.2,)], "x double")
    assert ops.filter_rows(three, "x", "=", 0.3).count() == 0
    assert three.where(fn.float_equals("x", 0.3)).count() == 1


def test_overflow_is_an_error(spark):
    df = from_rows(spark, [(9223372036854775807,), (1,)], "v bigint")
    with pytest.raises(Exception, match="OVERFLOW"):
        ops.aggregate(df, specs=[AggSpec("sum", "v")]).collect()


def test_strings_compare_by_bytes(spark):
    df = from_rows(spark, [("a",), ("B",), ("",), ("é",)], "s string")
    assert {r[0] for r in ops.filter_rows(df, "s", ">=", "a").collect()} == {"a", "é"}


def test_partition_filter(spark):
    df = spark.range(-3, 4)
    assert sorted(r[0] for r in ops.partition_filter(df, "id", 1, 2).collect()) == [1, 3]
    assert parse_partition("1|4") == (1, 4)
    for bad in ("1", "a|2", "1|2|3"):
        with pytest.raises(EngineError):
            parse_partition(bad)
    with pytest.raises(EngineError):
        ops.partition_filter(df, "id", 2, 2)


def test_exchange_keeps_rows_and_keys_together(spark):
    df = from_rows(spark, [(i, "abacbacb"[i], float(i + 1)) for i in range(8)], SCHEMA)
    found = ops.hash_exchange(df, 4, "region").withColumn("p", F.spark_partition_id()).collect()
    assert sorted(r.id for r in found) == list(range(8))
    assert len({(r.region, r.p) for r in found}) == 3
    with pytest.raises(EngineError):
        ops.hash_exchange(df, 4)


def test_rejections(groups, spark):
    for spec in (AggSpec("sum", "region"), AggSpec("sum"), AggSpec("nope", "id"), AggSpec("count", "zzz")):
        with pytest.raises(EngineError):
            ops.aggregate(groups, ["region"], [spec])
    for call in (lambda: ops.filter_rows(groups, "zzz", "=", 1), lambda: ops.filter_rows(groups, "id", "~", 1), lambda: ops.project(groups, "zzz"), lambda: ops.aggregate(groups), lambda: ops.parse_specs("sum"), lambda: ops.join(groups, groups, "id", "odd"), lambda: ops.ranked(groups, [], ["id"])):
        with pytest.raises(EngineError):
            call()
    catalog = Catalog(spark).add_frame("t", groups)
    for text in ("SELECT region, id FROM t GROUP BY region", "SELECT count(*) FROM t GROUP BY count(*)", "SELECT * FROM t GROUP BY region"):
        with pytest.raises(AnalysisException):
            catalog.sql(text)
    with pytest.raises(EngineError):
        catalog.table("other")


def test_plans_push_down_and_prune(spark):
    catalog = Catalog(spark, DATA)
    df = ops.project(ops.filter_rows(catalog.table("lineitem"), "l_quantity", ">", 45), "l_orderkey")
    assert read_columns(df) == [["l_orderkey", "l_quantity"]] and "GreaterThan(l_quantity" in pushed_filters(df)[0]
    through = catalog.sql("SELECT f, n FROM (SELECT l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY l_returnflag) WHERE f = 'A'")
    assert "EqualTo(l_returnflag,A)" in pushed_filters(through)[0]
    counted = ops.aggregate(catalog.table("lineitem"), ["l_returnflag"], [AggSpec("count")])
    assert shuffles(counted) == 1 and "partial_count" in executed_plan(counted)
    assert "BroadcastHashJoin" in executed_plan(ops.join(catalog.table("orders"), catalog.table("region"), F.col("o_orderkey") == F.col("r_regionkey")))


def test_sample_and_sink(spark, tmp_path):
    stats = write_parquet(ops.filter_rows(sample_table(spark), "amount", ">", 100000), str(tmp_path / "out"))
    assert stats.rows == 33333 and stats.bytes > 0
    assert summary(read_files(spark, str(tmp_path / "out")))["rows"] == 33333
    assert ops.scan(spark, str(tmp_path / "out"), "id").columns == ["id"]
    with pytest.raises(EngineError):
        read_files(spark, str(tmp_path), "csv")


def test_connector_round_trip(spark, groups, tmp_path):
    register(spark)
    path = str(tmp_path / "parts")
    groups.write.format("partfiles").mode("append").option("path", path).save()
    assert connector.stats(path).rows == 6
    back = spark.read.format("partfiles").schema(SCHEMA).option("path", path).load()
    assert sorted(map(tuple, back.collect())) == GROUPS


def test_connector_appends_overwrites_and_empty(spark, groups, tmp_path):
    register(spark)
    path = str(tmp_path / "parts")
    write = lambda df, mode: df.write.format("partfiles").mode(mode).option("path", path).save()
    read = lambda schema=SCHEMA, **o: spark.read.format("partfiles").schema(schema).options(path=path, **o).load()
    write(groups, "append")
    write(groups, "append")
    assert connector.stats(path).rows == 12 and sorted(map(tuple, read().collect())) == sorted(GROUPS * 2)
    write(groups.where("id < 5"), "overwrite")
    assert sorted(map(tuple, read().collect())) == GROUPS[:4]
    assert sum(f.endswith(".arrow") for f in os.listdir(path)) == len(connector.manifest(path)["parts"])
    write(groups.limit(0), "overwrite")
    assert read().collect() == [] and connector.stats(path).rows == 0
    with pytest.raises(Exception, match="not_found"):
        spark.read.format("partfiles").schema(SCHEMA).option("path", str(tmp_path / "none")).load().collect()
    failing = groups.withColumn("amount", F.raise_error(F.lit("stop")).cast("double"))
    with pytest.raises(Exception, match="stop"):
        write(failing, "append")
    assert read().collect() == []
    time.sleep(1)
    write(groups, "append")
    assert sorted(map(tuple, read().collect())) == GROUPS
    assert {f for f in os.listdir(path) if f.endswith(".arrow")} == {p["name"] for p in connector.manifest(path)["parts"]}


def test_connector_takes_filters_columns_and_limits(spark, groups, tmp_path):
    register(spark)
    path = str(tmp_path / "parts")
    groups.coalesce(1).write.format("partfiles").mode("append").option("path", path).save()
    read = lambda schema=SCHEMA, **o: spark.read.format("partfiles").schema(schema).options(path=path, **o).load()
    found = read().where("amount > 20 AND region = 'a' AND id % 2 = 1")
    assert sorted(r.id for r in found.collect()) == [3, 5]
    plan = executed_plan(found)
    assert "amount#" in plan and "> 20" not in plan.split("BatchScan")[0]
    assert sorted(map(tuple, read("amount double, id bigint").collect())) == sorted((a, i) for i, _, a in GROUPS)
    assert read(limit=2).count() == 2 and read(limit=2).where("id > 3").count() <= 2
    reader = connector.PartReader(path, read().schema)
    left = list(reader.pushFilters([datasource.GreaterThan(("amount",), 20.0), datasource.IsNotNull(("id",)), datasource.EqualTo(("s", "x"), 1)]))
    assert len(left) == 2 and sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 4


def test_files_of_every_kind(spark, groups, tmp_path):
    for kind in ("csv", "json", "orc", "parquet"):
        path = str(tmp_path / kind)
        groups.write.format(kind).save(path)
        back = read_files(spark, path, kind, SCHEMA if kind in ("csv", "json") else None)
        assert sorted(map(tuple, back.select("id", "region", "amount").collect())) == GROUPS
    groups.select("region").write.text(str(tmp_path / "text"))
    assert read_files(spark, str(tmp_path / "text"), "text").count() == 6


def test_arrow_stream(spark, groups):
    for df, rows in ((groups.repartition(3), 6), (groups.limit(0), 0)):
        out = io.BytesIO()
        assert write_arrow_stream(df, out) == rows
        back = pa.ipc.open_stream(out.getvalue()).read_all()
        assert back.num_rows == rows and back.column_names == ["id", "region", "amount"]


def test_gather_refuses_what_is_large(spark, groups):
    assert ops.gather(groups).rdd.getNumPartitions() == 1
    with pytest.raises(EngineError):
        ops.gather(spark.range(10**9))


def test_asof_join(spark):
    left = from_rows(spark, [(1, 5, "x"), (1, 1, "y"), (2, 9, "z"), (None, 3, "n")], "k bigint, t bigint, v string")
    right = from_rows(spark, [(1, 2, "old"), (1, 5, "new"), (1, 5, "newer"), (1, 6, "late"), (3, 1, "other")], "k bigint, t bigint, w string")
    got = {r.v: r.w for r in ops.asof_join(left, right, ["k"], "t", ["w"]).collect()}
    assert got == {"x": "newer", "y": None, "z": None, "n": None}


def test_catalogs_with_equal_names(spark):
    a, b = Catalog(spark).add_frame("t", spark.range(3)), Catalog(spark).add_frame("t", spark.range(5))
    spark.range(7).createOrReplaceTempView("t")
    one, two = a.sql("SELECT count(*) AS n FROM t"), b.sql("SELECT count(*) AS n FROM t")
    assert (one.first().n, two.first().n, spark.table("t").count()) == (3, 5, 7)
    spark.catalog.dropTempView("t")
    a.sql("SELECT * FROM t")
    assert not spark.catalog.tableExists("t")


def test_ddl_and_insert(spark):
    spark.sql("DROP TABLE IF EXISTS kept")
    spark.sql("CREATE TABLE kept (id BIGINT, region STRING) USING parquet")
    Catalog(spark).add_frame("t", from_rows(spark, GROUPS, SCHEMA)).sql("INSERT INTO kept SELECT id, region FROM t WHERE id > 3")
    assert spark.table("kept").count() == 3 and "kept" in [r.tableName for r in spark.sql("SHOW TABLES").collect()]
    spark.sql("DROP TABLE kept")


def test_registered_function(spark):
    fn.register_pure(spark, "twice", "bigint", lambda s: s * 2)
    assert [r[0] for r in spark.sql("SELECT twice(id) FROM range(3)").collect()] == [0, 2, 4]


def test_handles(spark, groups, tmp_path):
    catalog = Catalog(spark).add_frame("t", groups)
    done = submit(catalog, "SELECT region, count(*) AS n FROM t GROUP BY region", preview=2).wait()
    assert done.state is QueryState.DONE and done.rows_total == 3 and len(done.result()) == 2
    failed = submit(catalog, "SELECT nope FROM t").wait()
    assert failed.state is QueryState.FAILED and failed.error
    few = submit(catalog, "SELECT count(*) AS n, count(*) AS n FROM t", preview=2).wait()
    assert few.state is QueryState.DONE and few.rows_total == 1 and tuple(few.result()[0]) == (6, 6)
    kept = submit(catalog, "SELECT id, id AS id FROM t", preview=2, results=str(tmp_path)).wait()
    assert kept.state is QueryState.DONE and kept.rows_total == 6 and kept.result()[0].__fields__ == ["id", "id"]
    for _ in range(10):
        soon = submit(catalog, "SELECT count(*) AS n FROM t")
        soon.cancel()
        assert soon.wait(60).state is QueryState.CANCELLED and soon.rows_total is None
    slow = submit(catalog, "SELECT sum(a.id * b.id % 7) AS s FROM range(3000000) a CROSS JOIN range(100000) b")
    time.sleep(2)
    slow.cancel()
    assert slow.wait(60).state is QueryState.CANCELLED


def test_large_result(spark):
    assert ops.project(ops.filter_rows(sample_table(spark, 200_000), "id", ">=", 0), "id").count() == 200_000


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    found = run_to_memory(windowed_counts(parquet_stream(spark, str(tmp_path / "in")), "ts", ["event_type"]), "counts")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, windowed_counts(events, "ts", ["event_type"]).collect()))
    stream = parquet_stream(spark, str(tmp_path / "in"))
    sliding = run_to_memory(windowed_counts(stream, "ts", ["event_type"], slide="30 minutes"), "sliding")
    assert sorted(map(tuple, sliding.collect())) == sorted(map(tuple, windowed_counts(events, "ts", ["event_type"], slide="30 minutes").collect()))


def test_timestamps_without_zone_are_utc(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 00:30:00' AS ts, 1 AS k")
    hours = lambda: windowed_counts(df, "ts", ["k"]).select(F.unix_timestamp("window_start").alias("s")).first().s
    utc = hours()
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        assert hours() == utc == 1704067200
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
