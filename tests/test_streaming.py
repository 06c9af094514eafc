import pytest

from stelae.operators.change_feed import latest_changes
from stelae.operators.graph import LOG
from stelae.streaming.live import LateRecord, LiveLog, LiveTable

CHANGES = "kind string, id string, op string, at long, seq long, standing string"


def test_live_table_equals_one_batch(spark, tmp_path, rows):
    parts = [
        [("c", "a", "i", 1, 1, "x"), ("c", "b", "i", 2, 2, "y")], [("c", "a", "d", 5, 9, None), ("c", "a", "d", 5, 9, None)], [("c", "a", "u", 3, 4, "late"), ("c", "b", "u", None, 3, "untimed")],
    ]
    for n, part in enumerate(parts):
        spark.createDataFrame(part, CHANGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    live = LiveTable(spark, str(tmp_path / "live"), ["kind", "id"], ["at", "seq"], ["standing"])
    assert live.current() is None
    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))
    live.start(stream, str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination(120)
    whole = latest_changes(spark.createDataFrame(sum(parts, []), CHANGES), ["kind", "id"], ["at", "seq"], ["standing"])
    assert rows(live.current()) == rows(whole)
    before = rows(live.current())
    live.apply(spark.createDataFrame([("c", "z", "i", 1, 1, "x")], CHANGES), 0)  # a batch already applied
    assert rows(live.current()) == before


def test_live_log_refuses_late_records(spark, tmp_path):
    log = LiveLog(spark, str(tmp_path / "log"))
    record = lambda seq, name: (seq, "concept", "asserted", "", "", "", name, "", "", None)
    log.apply(spark.createDataFrame([record(1, "a"), record(3, "b")], LOG), 0)
    log.apply(spark.createDataFrame([record(1, "a"), record(3, "b")], LOG), 0)
    assert log.records().count() == 2
    with pytest.raises(LateRecord):
        log.apply(spark.createDataFrame([record(2, "c")], LOG), 1)
    with pytest.raises(LateRecord):
        log.apply(spark.createDataFrame([(4, "claim", "asserted", "", "", "0" * 64, "t", "", "", None)], LOG), 1)
    assert log.records().count() == 2


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path, rows):
    live = LiveTable(spark, str(tmp_path / "live"), ["kind", "id"], ["at", "seq"], ["standing"], buckets=8)
    whole = [("c", f"s{n}", "i", 1, n, "x") for n in range(40)]
    live.apply(spark.createDataFrame(whole, CHANGES), 0)
    before = live._manifest()[1]
    late = [("c", "s3", "u", 2, 100, "y"), ("c", "s3", "d", 0, 101, None)]
    live.apply(spark.createDataFrame(late, CHANGES), 1)
    after = live._manifest()[1]
    assert sum(after[b] != before.get(b) for b in after) == 1
    assert rows(live.current().drop("_bucket")) == rows(latest_changes(spark.createDataFrame(whole + late, CHANGES), ["kind", "id"], ["at", "seq"], ["standing"]))
    for n in range(2, 6):
        live.apply(spark.createDataFrame([("c", "s3", "u", n, 200 + n, f"v{n}")], CHANGES), n)
    assert rows(live.current().filter("id = 's3'").select("standing")) == [("v5",)] and live.current().count() == 40
    assert len(live._manifests()) == 2 and len([p for p in (tmp_path / "live").iterdir() if p.name.startswith("batch-")]) <= 3


def test_live_log_does_not_count_parents_of_a_failed_batch(spark, tmp_path):
    from stelae.functions.identity import concept_identity
    from pyspark.sql import functions as F

    log = LiveLog(spark, str(tmp_path / "log"))
    concept = spark.range(1).select(concept_identity(F.lit("a"))).first()[0]
    spark.createDataFrame([("claim", concept, 1)], "kind string, ref string, first long").write.mode("append").parquet(log.parents)
    claim = (5, "claim", "asserted", "", "", concept, "t", "", "", None)
    with pytest.raises(LateRecord):
        log.apply(spark.createDataFrame([claim], LOG), 0)
    log.apply(spark.createDataFrame([(1, "concept", "asserted", "", "", "", "a", "", "", None)], LOG), 1)
    log.apply(spark.createDataFrame([claim], LOG), 2)
    assert log.records().count() == 2
