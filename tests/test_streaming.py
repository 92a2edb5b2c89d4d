from pyspark.sql import functions as F

from mosaiq.operators.cache import display, latest, load, pending, store
from mosaiq.rasters import tile_versions
from mosaiq.streaming.tile_cache import accepted_writes, append_to, compact, stored


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    writes = tile_versions(spark, sf_dir)
    writes.repartitionByRange(3, "arrival").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(writes.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = accepted_writes(stream).writeStream.outputMode("append").format("memory").queryName("accepted").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    want = {(r["tx"], r["ty"]): (r["version"], r["arrival"]) for r in latest(writes).collect()}
    taken = spark.table("accepted")
    got = {(r["tx"], r["ty"]): (r["version"], r["arrival"]) for r in latest(taken).collect()}
    assert got == want and taken.count() < writes.count()
    store = str(tmp_path / "store")
    assert stored(spark, store).count() == 0
    u = stream.writeStream.foreachBatch(append_to(store)).option("checkpointLocation", str(tmp_path / "c2")).start()
    u.processAllAvailable()
    u.stop()
    places = lambda: {(r["tx"], r["ty"]): (r["version"], r["arrival"]) for r in stored(spark, store).collect()}
    assert places() == want
    compact(spark, store)
    assert len(list((tmp_path / "store").iterdir())) == 2 and places() == want
    append_to(store)(writes.limit(5), 2)  # the last batch once more, now with less
    append_to(store)(writes.where("arrival % 3 = 0"), 3)
    compact(spark, store)
    assert len(list((tmp_path / "store").iterdir())) == 2 and len(places()) == len(want)


def test_a_range_is_read_by_its_files(spark, tmp_path):
    tiles = spark.range(40_000).select((F.col("id") % 200).cast("int").alias("tx"), (F.col("id") / 200).cast("int").alias("ty"), F.col("id").alias("payload"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        store(tiles, str(tmp_path / "s"))
        _check_range(spark, tmp_path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.maxMetadataStringLength")


def _check_range(spark, tmp_path):
    part = load(spark, str(tmp_path / "s"), 3, 5, 10, 12)
    plan = part._jdf.queryExecution().toString()
    pushed = plan[plan.index("PushedFilters") :].splitlines()[0]
    assert all(f in pushed for f in ("GreaterThanOrEqual(tx,3)", "LessThan(tx,5)", "GreaterThanOrEqual(ty,10)", "LessThan(ty,12)"))
    assert sorted(r.payload for r in part.collect()) == [2003, 2004, 2203, 2204]
    ends = spark.read.parquet(str(tmp_path / "s")).groupBy(F.input_file_name()).agg(F.min("ty").alias("lo"), F.max("ty").alias("hi")).orderBy("lo").collect()
    assert len(ends) > 1 and all(a.hi <= b.lo for a, b in zip(ends, ends[1:]))


def test_previews_of_the_active_generation(spark):
    log = [(0, 0, 0, 0, 1, 5, 1.0), (0, 0, 0, 0, 2, 4, 2.0), (0, 0, 0, 7, 3, 0, 3.0), (0, 0, 0, 8, 4, 0, 4.0), (0, 0, 0, 8, 5, 0, 5.0), (0, 1, 0, 0, 6, 1, 6.0), (1, 0, 0, 8, 7, 0, 7.0)]
    writes = spark.createDataFrame(log, "mip int, tx int, ty int, generation long, arrival long, version long, payload double")
    seen = lambda active: sorted(tuple(r) for r in display(writes, active).collect())
    assert seen(0) == [(0, 0, 0, 1.0), (0, 1, 0, 6.0)]
    assert seen(8) == [(0, 0, 0, 5.0), (0, 1, 0, 6.0), (1, 0, 0, 7.0)]
    assert seen(9) == seen(0)
    assert sorted(map(tuple, pending(writes, 0, 5).collect())) == [(1, 0)] and pending(writes, 1, 7).count() == 0
