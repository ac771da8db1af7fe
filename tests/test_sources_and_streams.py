from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skylag.operators.cumulative import page
from skylag.sources import branches, files
from skylag.streaming import records, scoring


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "table")


def _rows(spark, *rows):
    return spark.createDataFrame(rows, "flight_id string, minutes double")


def _content(df):
    return sorted((r["flight_id"], r["minutes"]) for r in df.collect())


def test_write_modes(spark, root):
    branches.write(_rows(spark, ("a", 1.0), ("b", 2.0)), root)
    branches.write(_rows(spark, ("c", 3.0)), root, mode="append")
    assert _content(branches.read_branch(spark, root)) == [("a", 1.0), ("b", 2.0), ("c", 3.0)]
    reader = branches.read_branch(spark, root)
    branches.write(_rows(spark, ("b", 9.0), ("d", 4.0)), root, mode="update", key="flight_id")
    assert _content(branches.read_branch(spark, root)) == [("a", 1.0), ("b", 9.0), ("c", 3.0), ("d", 4.0)]
    assert _content(reader) == [("a", 1.0), ("b", 2.0), ("c", 3.0)]  # an open reader keeps its version
    branches.write(_rows(spark, ("a", 0.0)), root, mode="delete", key="flight_id")
    assert _content(branches.read_branch(spark, root)) == [("b", 9.0), ("c", 3.0), ("d", 4.0)]
    branches.write(_rows(spark, ("z", 0.0)), root)
    assert _content(branches.read_branch(spark, root)) == [("z", 0.0)]
    with pytest.raises(ValueError):
        branches.write(_rows(spark, ("z", 0.0)), root, mode="merge")
    with pytest.raises(ValueError):
        branches.write(_rows(spark, ("z", 0.0)), root, mode="update")


def test_failed_write_is_not_read(spark, root):
    branches.write(_rows(spark, ("a", 1.0)), root)
    broken = _rows(spark, ("b", 2.0)).withColumn("minutes", F.raise_error(F.lit("stop")).cast("double"))
    with pytest.raises(Exception, match="stop"):
        branches.write(broken, root)
    assert _content(branches.read_branch(spark, root)) == [("a", 1.0)]
    branches.write(_rows(spark, ("c", 3.0)), root)
    assert _content(branches.read_branch(spark, root)) == [("c", 3.0)]


def test_branches_and_limit(spark, root):
    with pytest.raises(FileNotFoundError):
        branches.read_branch(spark, root)
    branches.write(_rows(spark, ("a", 1.0), ("b", 2.0)), root)
    branches.write(_rows(spark, ("a", 1.0)), root, "develop")
    assert branches.list_branches(spark, root) == ["develop", "master"]
    assert branches.read_branch(spark, root, limit=1).count() == 1


def test_prediction_log_skips_without_target(spark, root):
    assert branches.log_predictions(_rows(spark, ("a", 1.0)), None) is None
    branches.log_predictions(_rows(spark, ("a", 1.0)), root)
    branches.log_predictions(_rows(spark, ("b", 1.0)), root)
    log = branches.read_branch(spark, root)
    assert log.count() == 2 and log.where("logged_at IS NULL").isEmpty()


def test_append_many_fills_missing_columns(spark, root):
    branches.append_many([_rows(spark, ("a", 1.0)), _rows(spark, ("b", 2.0)).drop("minutes")], root)
    assert dict((r["flight_id"], r["minutes"]) for r in branches.read_branch(spark, root).collect()) == {"a": 1.0, "b": None}


def test_export_and_read_by_suffix(spark, root, tmp_path):
    branches.write(_rows(spark, ("a", 1.0)), root)
    csv = branches.export_branch(spark, root, str(tmp_path / "out.csv"), fmt="csv")
    assert spark.read.option("header", True).csv(csv).first()["flight_id"] == "a"
    parquet = branches.export_branch(spark, root, str(tmp_path / "out.parquet"))
    assert _content(files.read_flights(spark, parquet)) == [("a", 1.0)]
    with pytest.raises(ValueError):
        branches.export_branch(spark, root, str(tmp_path / "x"), fmt="xml")


def test_csv_types_come_from_the_header_not_the_position(spark, tmp_path):
    path = tmp_path / "flights.csv"
    path.write_text("distance_miles,flight_id,is_delayed,gate\n12.5,F1,1,A1\nNaN,F2,x,A2\n")
    rows = {r["flight_id"]: r for r in files.read_flights(spark, str(path)).collect()}
    assert rows["F1"]["distance_miles"] == 12.5 and rows["F1"]["is_delayed"] == 1 and rows["F1"]["gate"] == "A1"
    assert rows["F2"]["distance_miles"] is None and rows["F2"]["is_delayed"] is None


def test_filters_and_columns_reach_the_scan(spark, root):
    df = spark.range(10).selectExpr("cast(id AS string) AS flight_id", "cast(id AS double) AS dep_delay_minutes", "id AS other")
    path = branches.write(df, root)
    plan = (
        files.read_flights(spark, path).where("dep_delay_minutes >= 15").select("flight_id")
        ._jdf.queryExecution().executedPlan().toString()
    )
    assert "GreaterThanOrEqual(dep_delay_minutes,15.0)" in plan
    assert "other" not in plan.split("ReadSchema")[1]


def test_pages_stop_at_the_end(spark):
    df = spark.range(3)
    assert [r[0] for r in page(df, ["id"], 0, 2).collect()] == [0, 1]
    assert [r[0] for r in page(df, ["id"], 2, 2).collect()] == [2]
    assert page(df, ["id"], 4, 2).isEmpty()


def test_pages_of_tied_keys_fit_together(spark):
    df = spark.range(3_000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 7 = 0 THEN NULL ELSE id % 2 END AS k", "id")
    pages = [page(df, ["k"], start, 700).collect() for start in range(0, 3_500, 700)]
    assert [len(p) for p in pages] == [700, 700, 700, 700, 200]
    rows = [r for p in pages for r in p]
    assert len({r["id"] for r in rows}) == 3_000
    rank = lambda k: -1 if k is None else k
    assert [rank(r["k"]) for r in rows] == sorted(rank(r["k"]) for r in df.collect())
    double = df.unionAll(df)
    assert len([r for start in range(0, 6_000, 1_500) for r in page(double, ["k"], start, 1_500).collect()]) == 6_000


@pytest.mark.parametrize("bucket_by", [None, "flight_id"])
def test_a_commit_during_the_write_of_a_rewrite_is_not_dropped(spark, root, monkeypatch, bucket_by):
    branches.write(_rows(spark, ("a", 1.0)), root, bucket_by=bucket_by)
    put = branches._put

    def meanwhile(df, path, *rest, **how):
        put(df, path, *rest, **how)
        monkeypatch.setattr(branches, "_put", put)
        branches.write(_rows(spark, ("b", 2.0)), root, mode="append")

    monkeypatch.setattr(branches, "_put", meanwhile)
    with pytest.raises(RuntimeError, match="changed"):
        branches.write(_rows(spark, ("a", 9.0)), root, mode="update", key="flight_id")
    assert _content(branches.read_branch(spark, root)) == [("a", 1.0), ("b", 2.0)]
    branches.write(_rows(spark, ("a", 9.0)), root, mode="update", key="flight_id")
    assert _content(branches.read_branch(spark, root)) == [("a", 9.0), ("b", 2.0)]


def test_a_large_page_is_not_one_tasks_work(spark):
    df = spark.range(20_000).select((F.col("id") % 3 == 0).alias("k"), "id").repartition(4)
    one = page(df, ["k"], 3_333, 9_999)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert not [step for step in ("TakeOrdered", "GlobalLimit", "CollectLimit", "SinglePartition") if step in plan]
    whole = page(df, ["k"], 0, 20_000).collect()
    assert len(set(whole)) == 20_000 and one.collect() == whole[3_333:13_332]


def test_chunks_are_files_and_resume_where_they_stopped(spark, root, tmp_path):
    branches.write(spark.range(30).repartition(3), root)
    target = str(tmp_path / "copy")
    stream = records.stream_records(spark, root, files_per_chunk=1)
    assert len([p for p in records.write_all(stream, target).recentProgress if p["numInputRows"]]) == 3
    branches.write(spark.range(5).coalesce(1), root, mode="append")
    records.write_all(stream, target)
    records.write_all(stream, target)
    assert spark.read.parquet(target).count() == 35


def test_each_commit_is_heard_once(spark, root, tmp_path):
    seen, checkpoint = [], str(tmp_path / "subscriber")
    note = lambda rows, c: seen.append((c.version, c.number, rows.count()))
    branches.write(spark.range(30).repartition(16), root)
    assert records.subscribe(spark, root, note, checkpoint) == 0  # the baseline
    branches.write(spark.range(4).repartition(4), root)
    branches.write(spark.range(4, 6), root, mode="append")
    branches.write(spark.range(2), root, mode="delete", key="id")
    branches.write(spark.range(5, 8), root, mode="update", key="id")
    assert records.subscribe(spark, root, note, checkpoint) == 4
    assert seen == [(2, 0, 4), (2, 1, 2), (3, 0, 4), (4, 0, 6)]
    assert records.subscribe(spark, root, note, checkpoint) == 0
    fresh: list = []
    records.subscribe(spark, root, lambda rows, c: fresh.append(c.version), str(tmp_path / "other"), skip_initial=False)
    assert fresh == [1, 2, 2, 3, 4]


def test_update_refuses_repeated_keys(spark, root):
    branches.write(_rows(spark, ("a", 1.0)), root)
    with pytest.raises(ValueError, match="more than once"):
        branches.write(_rows(spark, ("a", 2.0), ("a", 3.0)), root, mode="update", key="flight_id")


def test_unfinished_appends_are_not_read(spark, root):
    path = branches.write(_rows(spark, ("a", 1.0)), root)
    broken = _rows(spark, ("b", 2.0)).withColumn("minutes", F.raise_error(F.lit("stop")).cast("double"))
    with pytest.raises(Exception, match="stop"):
        branches.write(broken, root, mode="append")
    assert path.endswith("version=1/commit=0") and _content(branches.read_branch(spark, root)) == [("a", 1.0)]
    branches.write(_rows(spark, ("c", 3.0)), root, mode="append")
    assert _content(branches.read_branch(spark, root)) == [("a", 1.0), ("c", 3.0)]


def test_running_tiers(spark, root):
    branches.write(spark.createDataFrame([(0.9,), (0.6,), (0.3,), (0.1,), (0.8,)], "delay_probability double"), root)
    latest = {}
    query = (
        scoring.running_tiers(records.stream_records(spark, root))
        .writeStream.outputMode("complete")
        .foreachBatch(lambda rows, i: latest.update({r["delay_tier"]: r["n"] for r in rows.collect()}))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert latest == {"SEVERE": 2, "MODERATE": 1, "MINOR": 1, "ON_TIME": 1}


def test_auto_holiday_is_refused_on_a_stream(spark, root):
    from skylag.operators.features import temporal_features

    branches.write(spark.createDataFrame([("2024-01-01T00:00:00", True)], "scheduled_departure string, is_holiday boolean"), root)
    with pytest.raises(ValueError):
        temporal_features(records.stream_records(spark, root), "auto")


def _of_carriers(spark, *rows):
    return spark.createDataFrame(rows, "carrier_code string, flight_id string, minutes double")


def _files_of(path):
    from pathlib import Path

    return {str(p) for p in Path(path).rglob("*.parquet")}


def test_an_update_of_one_carrier_rewrites_its_bucket_only(spark, root):
    rows = [(c, f"{c}{i}", float(i)) for c in ("AA", "DL", "UA", "WN", None) for i in range(20)]
    branches.write(_of_carriers(spark, *rows), root, bucket_by="carrier_code", buckets=16)
    before = _files_of(root)
    assert len({p.split("_bucket=")[1].split("/")[0] for p in before}) > 1
    reader = branches.read_branch(spark, root)
    key = ["carrier_code", "flight_id"]
    path = branches.write(_of_carriers(spark, ("DL", "DL3", 99.0), ("DL", "new", 1.0)), root, mode="update", key=key)
    written = _files_of(root) - before
    assert len({p.split("_bucket=")[1].split("/")[0] for p in written}) == 1 and all(p.startswith(path) for p in written)
    want = {(c, f, m) for c, f, m in rows if f != "DL3"} | {("DL", "DL3", 99.0), ("DL", "new", 1.0)}
    read = lambda: sorted(map(tuple, branches.read_branch(spark, root).collect()), key=str)
    assert read() == sorted(want, key=str) and reader.count() == 100
    branches.write(_of_carriers(spark, ("UA", "UA99", 5.0)), root, mode="append")
    branches.write(_of_carriers(spark, *[r for r in rows if r[0] == "WN"]), root, mode="delete", key=key)
    want = {r for r in want if r[0] != "WN"} | {("UA", "UA99", 5.0)}
    assert read() == sorted(want, key=str)
    branches.write(_of_carriers(spark, (None, "None3", 7.0)), root, mode="update", key="flight_id")  # all buckets
    want = {r for r in want if r[1] != "None3"} | {(None, "None3", 7.0)}
    assert read() == sorted(want, key=str)
    branches.write(_of_carriers(spark, *want), root, mode="delete", key="flight_id")
    assert read() == []
    with pytest.raises(ValueError, match="bucket"):
        branches.write(_of_carriers(spark, *want), root)
        records.stream_records(spark, root)


def test_the_second_writer_of_one_folder_fails(spark, root, monkeypatch):
    branches.write(_rows(spark, ("a", 1.0)), root)
    same = branches._next_path(spark, root, "master")
    monkeypatch.setattr(branches, "_next_path", lambda *_, **__: same)
    branches.write(_rows(spark, ("b", 1.0)), root)
    with pytest.raises(RuntimeError, match="another writer"):
        branches.write(_rows(spark, ("c", 1.0)), root)
    assert _content(branches.read_branch(spark, root)) == [("b", 1.0)]


def test_a_subscriber_killed_after_its_callback_delivers_once(spark, root, tmp_path):
    checkpoint, sink = str(tmp_path / "subscriber"), {}
    branches.write(spark.range(3), root)
    records.subscribe(spark, root, lambda rows, c: None, checkpoint)  # the baseline
    branches.write(_of_carriers(spark, ("AA", "1", 1.0), ("DL", "2", 2.0)), root, bucket_by="carrier_code")
    branches.write(_of_carriers(spark, ("AA", "3", 3.0)), root, mode="append")
    branches.write(_of_carriers(spark, ("AA", "1", 1.0)), root, mode="delete", key=["carrier_code", "flight_id"])
    heard = []

    def deliver(rows, commit):
        heard.append(commit[:2])
        sink[commit[:2]] = rows.count()
        if len(heard) == 2:
            raise KeyError("killed between callback and note")

    with pytest.raises(Exception, match="killed"):
        records.subscribe(spark, root, deliver, checkpoint)
    assert records.subscribe(spark, root, deliver, checkpoint) == 3
    assert heard == [(2, 0), (2, 1), (2, 0), (2, 1), (3, 0)] and sink == {(2, 0): 2, (2, 1): 1, (3, 0): 2}
    assert records.subscribe(spark, root, deliver, checkpoint) == 0
