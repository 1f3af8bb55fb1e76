import time

from marlstone.plans.content_queries import QUERIES
from marlstone.streaming.ingest import index, shared_folder, start
from marlstone.streaming.leases import run_available, track

from .conftest import DATA


def test_silent_keys_expire_and_progress_never_falls(spark):
    source, out, checkpoint = (shared_folder(spark, n) for n in ("beats", "updates", "lease-checkpoint"))

    def feed(rows):
        spark.createDataFrame(rows, "id long, progress long").coalesce(1).write.mode("append").parquet(source)
        beats = spark.readStream.schema("id long, progress long").parquet(source)
        run_available(track(beats, 500), lambda batch, n: batch.write.mode("append").parquet(out), checkpoint)
        return {(r.id, r.beats, r.progress, r.expired) for r in spark.read.parquet(out).collect()}

    assert feed([(1, 40), (1, 10), (2, 5)]) == {(1, 2, 40, False), (2, 1, 5, False)}
    time.sleep(1)
    assert feed([(3, 7)]) == {(1, 2, 40, False), (2, 1, 5, False), (3, 1, 7, False), (1, 2, 40, True), (2, 1, 5, True)}
    # an expired key begins anew
    assert (1, 1, 3, False) in feed([(1, 3)])


def test_the_bounded_lease_stream_ends(spark):
    before = spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled")
    assert QUERIES["t1_stream_leases"](spark, DATA).count() > 0
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == before


def test_redelivery_adds_nothing_and_batches_stay_flat(spark):
    inbox, target, checkpoint = (shared_folder(spark, n) for n in ("inbox", "index", "ingest-checkpoint"))
    rows = spark.range(5_000).selectExpr("id AS doc_id", "concat('text of ', id) AS text")
    rows.repartition(25).write.mode("append").parquet(inbox)
    rows.repartition(25).write.mode("append").parquet(inbox)  # delivered again, in other files
    query = start(spark, inbox, target, checkpoint, files=1)
    query.awaitTermination()
    times = [p["durationMs"]["triggerExecution"] for p in query.recentProgress if p["numInputRows"]]
    assert len(times) == 50 and sum(times[-10:]) < 2 * sum(times[5:15])
    found = index(spark, target)
    assert found.count() == 5_000 == found.select("id").distinct().count()
    # a restart knows what came before
    rows.limit(100).write.mode("append").parquet(inbox)
    spark.createDataFrame([(9_999, "new")], "doc_id long, text string").write.mode("append").parquet(inbox)
    start(spark, inbox, target, checkpoint).awaitTermination()
    assert index(spark, target).count() == 5_001 and spark.conf.get("spark.sql.streaming.stateStore.providerClass", "x").find("RocksDB") < 0
