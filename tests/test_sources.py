from __future__ import annotations

import glob
from datetime import date, datetime

import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException

from habitus.config import SERVED_COLUMNS
from habitus.operators.serving import top_threats, user_timeline
from habitus.plans.detection import score_days
from habitus.session import cut_lineage, scratch_path, shared_folder
from habitus.sources import logs, tables


def put(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_log_columns_by_name_whatever_else_is_there(spark, tmp_path):
    path = put(
        tmp_path / "logon.csv",
        "id,date,user,pc,activity",
        "{X1},01/02/2010 06:49:00,NGF0157,PC-6056,Logon",
        "{X2},1/2/2010 7:5:3,LRR0148,PC-4275,Logoff",
    )
    df = logs.scan_log(spark, path)
    assert df.columns == ["date", "user", "pc", "activity"]
    assert [tuple(r) for r in df.collect()] == [
        (datetime(2010, 1, 2, 6, 49), "NGF0157", "PC-6056", "Logon"),
        (datetime(2010, 1, 2, 7, 5, 3), "LRR0148", "PC-4275", "Logoff"),
    ]
    scan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<date:string,user:string,pc:string,activity:string>" in scan


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("bad", ["2010-01-02 06:49:00", "13/02/2010 06:49:00", "soon"])
def test_a_malformed_log_date_fails_the_load(spark, tmp_path, bad, ansi):
    path = put(tmp_path / "logon.csv", "date,user,pc,activity", f"{bad},u,p,Logon")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(PySparkException):
            logs.scan_log(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_a_malformed_user_date_becomes_null(spark, tmp_path):
    path = put(
        tmp_path / "users.csv",
        "name,user_id,role,department,team,supervisor,start_date,end_date",
        "A,U1,r,1 - Executive,t,s,2010-01-02,never",
        "B,U2,r,,t,s,01/31/2010,",
    )
    first, second = logs.scan_users(spark, path).orderBy("user_id").collect()
    assert (first.start_date, first.end_date) == (datetime(2010, 1, 2), None)
    assert (second.start_date, second.end_date, second.department) == (
        datetime(2010, 1, 31),
        None,
        None,
    )


def test_missing_columns_and_files_are_named(spark, tmp_path):
    path = put(tmp_path / "logon.csv", "date,user,activity", "01/02/2010 06:49:00,u,Logon")
    with pytest.raises(ValueError, match="pc"):
        logs.scan_log(spark, path)
    with pytest.raises(tables.MissingSource, match="nowhere.csv"):
        logs.scan_log(spark, str(tmp_path / "nowhere.csv"))
    with pytest.raises(tables.MissingSource, match="run the features step"):
        tables.read_table(spark, str(tmp_path / "none.parquet"), "run the features step")


@pytest.fixture(scope="module")
def scores(spark, make_days):
    series = {f"U{i:03d}": [1 + (i * k) % 4 for k in range(60)] + [30] for i in range(80)}
    days = make_days(series).selectExpr("*", "'r' as role", "'d' as department", "'t' as team")
    return score_days(days)


def test_layout_is_lossless_clustered_and_prunable(spark, scores, tmp_path):
    path = str(tmp_path / "serving")
    from habitus.config import Settings

    settings = Settings(row_group_rows=500)
    tables.write_serving(scores, path, settings, partitions=3)
    back = tables.read_served(spark, path)
    kept = scores.select(*SERVED_COLUMNS)
    assert sorted(map(str, back.collect())) == sorted(map(str, kept.collect()))

    files = sorted(glob.glob(f"{path}/*.parquet"))
    assert len(files) == 3
    groups, ranges = 0, []
    for name in files:
        meta = pq.ParquetFile(name).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            assert group.num_rows <= 500 and group.column(0).compression == "ZSTD"
            stats = group.column(0).statistics
            ranges.append((stats.min, stats.max))
    assert all(a[1] <= b[0] for a, b in zip(sorted(ranges), sorted(ranges)[1:]))
    assert sum(low <= "U040" <= high for low, high in ranges) <= 2

    totals = tables.layout_totals(spark, path).first()
    assert (totals.rows, totals.files, totals.row_groups) == (80 * 61, 3, groups)
    found = tables.lookup(spark, path, "U040")
    assert found.count() == 61
    assert "EqualTo(user,U040)" in found._jdf.queryExecution().executedPlan().toString()


def test_a_bucketed_lookup_reads_one_folder(spark, scores, tmp_path):
    path = str(tmp_path / "serving")
    tables.write_serving(scores, path, partitions=3, buckets=8)
    assert len(glob.glob(f"{path}/actor_bucket_of_8=*")) == 8
    files = {f"file:{name}": pq.ParquetFile(name).metadata for name in glob.glob(f"{path}/*/*.parquet")}
    report = {r.file: (r.rows, r.row_groups) for r in tables.layout_report(spark, path).collect()}
    assert report == {name: (m.num_rows, m.num_row_groups) for name, m in files.items()}
    assert tables.read_served(spark, path).columns == list(SERVED_COLUMNS)
    assert tables.read_served(spark, path).count() == 80 * 61
    found = tables.lookup(spark, path, "U040", buckets=8)
    folders = {name.rsplit("/", 2)[1] for name in found.inputFiles()}
    assert len(folders) == 1
    timeline = user_timeline(found, "U040", one_task=True)
    days = [d.day for d in timeline.days.collect()]
    assert days == sorted(days) and len(days) == timeline.header.first().total_days == 61
    assert "Exchange" not in timeline.days._jdf.queryExecution().executedPlan().toString()
    for buckets in (None, 8, 7):
        for i in range(0, 80, 9):
            assert tables.lookup(spark, path, f"U{i:03d}", buckets=buckets).count() == 61
    assert tables.lookup(spark, path, "nobody", buckets=8).count() == 0


def test_the_clustered_table_is_preferred(spark, scores, tmp_path):
    folder = str(tmp_path)
    with pytest.raises(tables.MissingSource, match="detection"):
        tables.resolve_scores(spark, folder)
    tables.write_table(scores, f"{folder}/{tables.SCORE_TABLE}")
    assert tables.resolve_scores(spark, folder).count() == 80 * 61
    tables.write_serving(scores.limit(7), f"{folder}/{tables.SERVING_TABLE}")
    assert tables.resolve_scores(spark, folder).count() == 7


def test_preview_is_one_csv_part(spark, scores, tmp_path):
    path = str(tmp_path / "top.csv")
    tables.write_preview(top_threats(scores), path)
    parts = glob.glob(f"{path}/*.csv")
    assert len(parts) == 1
    lines = open(parts[0], encoding="utf-8").read().splitlines()
    assert lines[0] == "user,day,severity,severity_score,role,department,reasons"
    assert len(lines) == 21
    assert "logon count unusually high for this user (z=" in lines[1] and " — would not" in lines[1]


class FakeSession:
    """A session with a given master and settings."""

    def __init__(self, master, configured=None, context_dir=None):
        self.master, self.context_dir = master, context_dir
        self.values = {"spark.checkpoint.dir": configured} if configured else {}
        self.conf = self.sparkContext = self

    def get(self, key, default):
        return self.values.get(key, default)

    def getCheckpointDir(self):  # noqa: N802
        return self.context_dir

    def setCheckpointDir(self, folder):  # noqa: N802
        self.context_dir = folder


def test_the_shared_folder_is_the_one_the_session_names():
    named = FakeSession("spark://host", "hdfs://shared/cp/")
    assert shared_folder(named) == "hdfs://shared/cp/"
    assert scratch_path(named, "x").startswith("hdfs://shared/cp/x-")
    assert shared_folder(FakeSession("yarn", None, "hdfs://set/in/code")) == "hdfs://set/in/code"


def test_no_machine_local_folder_on_a_cluster():
    cluster = FakeSession("yarn")
    assert shared_folder(cluster) is None
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(cluster, "x")


def test_cutting_the_lineage_needs_a_folder(spark, monkeypatch):
    monkeypatch.setattr("habitus.session.shared_folder", lambda session: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        cut_lineage(spark.range(5))


def test_a_local_session_gets_its_own_folder_once():
    local = FakeSession("local[2]")
    first = shared_folder(local)
    assert first and shared_folder(local) == first


def test_cut_lineage_keeps_the_rows(spark):
    df = cut_lineage(spark.range(5))
    assert df.count() == 5
    assert "Range" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_days_survive_the_round_trip(spark, make_days, tmp_path):
    path = str(tmp_path / "t")
    tables.write_table(make_days({"u": [1]}), path)
    assert tables.read_table(spark, path).first().day == date(2020, 1, 1)
