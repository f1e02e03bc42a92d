"""Duplicate suppression with bounded state, and stored keys looked up by prefix."""

import datetime as dt
import os

from pyspark.sql import functions as F

from ledgerlake.operators import load as L
from ledgerlake.streaming import ingest as ST

SCHEMA = "event_id long, user_id long, ts timestamp_ntz, event_type string, value double"


def land(spark, folder, name, ids, day=dt.datetime(2024, 3, 1)):
    rows = [(i, i % 7, day + dt.timedelta(minutes=i % 50), "view", float(i)) for i in ids]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(os.path.join(folder, name))


def test_repeats_are_dropped_by_state_and_late_rows_load_once(spark, tmpdir_path):
    src, base = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "out")
    run = lambda suppress: ST.ingest_events(spark, src + "/*", base + "/t", base + "/ck", "*.parquet", 1, base + "/totals", suppress)
    land(spark, src, "a", range(0, 100))
    land(spark, src, "b", list(range(50, 150)) * 3)
    progress = run("1 hour")
    assert sum(p["numInputRows"] for p in progress) == 400
    state = [p["stateOperators"][0] for p in progress if p["stateOperators"]]
    assert state[-1]["numRowsTotal"] == 150 and "rocksdb" in str(state[-1]["customMetrics"]).lower()
    assert spark.conf.get(ST.PROVIDER, "") != ST.ROCKSDB
    # years older than everything seen: not late, since arrival counts, and stored once for all repeats
    land(spark, src, "c", list(range(200, 260)) * 2, dt.datetime(1999, 1, 1))
    run("1 hour")
    t = spark.read.parquet(base + "/t")
    assert t.count() == t.select("event_id").distinct().count() == 210
    assert t.filter(F.col("ts") < "2000-01-01").count() == 60
    totals = ST.stored_totals(spark, base + "/totals").collect()
    assert sum(r.n for r in totals) == 210


def test_state_is_bounded_and_the_stored_table_decides_beyond_it(spark, tmpdir_path):
    src, base = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "out")
    for k in range(4):
        land(spark, src, str(k), range(k * 100, k * 100 + 120))  # 20 ids of each file come again in the next
    progress = ST.ingest_events(spark, src + "/*", base + "/t", base + "/ck", "*.parquet", 1, suppress="0 seconds")
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert len(held) >= 4 and max(held) <= 360 and held[-1] < 420  # keys leave as time goes on
    t = spark.read.parquet(base + "/t")
    assert t.count() == t.select("event_id").distinct().count() == 420


def test_a_batch_reads_its_prefixes_only(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "t")
    rows = spark.range(400).select(F.sha2(F.col("id").cast("string"), 256).alias("hashcode"), F.col("id").alias("ingest_seq"),
                                   F.lit(dt.date(2024, 1, 5)).alias("txn_date"))
    assert L.append_by_prefix(rows, path, "01", prefix=2).count() == 400
    few = rows.filter("ingest_seq in (3, 5)").unionByName(rows.limit(1).withColumn("hashcode", F.lit("ab" * 32)).withColumn("ingest_seq", F.lit(999).cast("long")))
    prefixes = sorted({r.hashcode[:2] for r in few.collect()})
    schema = few.withColumn("month", F.lit("")).schema
    keys = L.stored_keys(L.stored_batches(spark, path, schema, ("prefix", "batch_id")), "hashcode", prefixes, "02")
    plan = keys._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters: ["):].split("]")[0]
    assert all(p in filters for p in prefixes) and "batch_id" in filters
    assert sorted({os.path.basename(os.path.dirname(os.path.dirname(f))) for f in keys.inputFiles()}) != []
    read = keys.select(F.input_file_name().alias("f")).distinct().collect()
    assert {r.f.split("prefix=")[1][:2] for r in read} <= set(prefixes)
    assert [r.ingest_seq for r in L.append_by_prefix(few, path, "02", prefix=2).collect()] == [999]
    assert L.append_by_prefix(few, path, "02", prefix=2).count() == 1  # a retry replaces its own rows
    assert spark.read.parquet(path).count() == 401


def test_files_carry_a_bloom_filter_on_the_key(spark, tmpdir_path):
    import glob

    path = os.path.join(tmpdir_path, "t")
    rows = spark.range(2000).select(F.sha2(F.col("id").cast("string"), 256).alias("hashcode"), F.col("id").alias("ingest_seq"),
                                    F.lit(dt.date(2024, 1, 5)).alias("txn_date"))
    L.append_by_prefix(rows, path, "b")
    file = spark._jvm.org.apache.hadoop.fs.Path(glob.glob(path + "/prefix=a/*/*.parquet")[0])
    conf = spark._jsc.hadoopConfiguration()
    reader = spark._jvm.org.apache.parquet.hadoop.ParquetFileReader.open(
        spark._jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(file, conf))
    block = reader.getFooter().getBlocks().get(0)
    offsets = {c.getPath().toDotString(): c.getBloomFilterOffset() for c in block.getColumns()}
    reader.close()
    assert offsets["hashcode"] > 0 and offsets["ingest_seq"] <= 0
