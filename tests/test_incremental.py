from __future__ import annotations

import os
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from habitus import registry, samples
from habitus.config import FEATURES
from habitus.operators import baseline, drift, moments, search, serving
from habitus.operators.access import AUDIT_SCHEMA, audit_pairs
from habitus.plans import incremental
from habitus.plans.detection import score_days
from habitus.sources import generations, logs, manifest, tables
from habitus.streaming import access as live
from habitus.streaming import drift as live_drift

FOLDER = "/root/testdata/sf0.001"
START = date(2020, 1, 1)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df) -> list:
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def days(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("days") / "days")
    samples.shipping_days(spark, FOLDER).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def scores(spark, days, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("scores") / "scores")
    score_days(days.selectExpr("*", "'r' AS role", "'d' AS department", "'t' AS team")).write.parquet(path)
    return tables.read_served(spark, path)


# ------------------------------------------------------------------ moments


def test_slices_add_up_and_read_only_themselves(spark, days, tmp_path):
    path = str(tmp_path / "moments")
    cuts = registry.cuts(days, 5)
    for until in cuts[:3]:
        incremental.advance(spark, path, days, until)
    following = incremental.next_moments(spark, path, days, cuts[3])
    read = plan(following)
    assert f"GreaterThan(day,{cuts[2]})" in read and f"LessThanOrEqual(day,{cuts[3]})" in read
    assert read.count("Scan parquet") == 2 and f"generation={cuts[2]}" in read
    assert rows(incremental.advance(spark, path, days, cuts[3])) == rows(following)
    whole = incremental.advance(spark, path, days, cuts[4])
    assert rows(moments.baseline_of(whole)) == rows(baseline.actor_baseline(days))
    assert generations.committed(spark, path) == [str(c) for c in cuts[3:]]  # older ones are gone


def test_a_repeated_or_lost_run_counts_once(spark, days, tmp_path):
    path = str(tmp_path / "moments")
    cuts = registry.cuts(days, 3)
    for until in (cuts[0], cuts[1], cuts[1], cuts[0]):
        incremental.advance(spark, path, days, until)
    assert incremental.last_day(spark, path) == cuts[1]
    # A run that was lost before its marker: the folder is there, and is not read.
    days.limit(1).write.parquet(f"{path}/generation={cuts[2]}")
    os.remove(f"{path}/generation={cuts[2]}/_SUCCESS")
    assert incremental.last_day(spark, path) == cuts[1]
    whole = incremental.advance(spark, path, days, cuts[2])
    assert rows(moments.baseline_of(whole)) == rows(baseline.actor_baseline(days))


def test_moments_of_odd_days(spark, make_days):
    found = make_days({"a": [1, None, 3], "b": [5]}).unionByName(make_days({None: [9]}))
    assert rows(moments.baseline_of(moments.moments(found))) == rows(baseline.actor_baseline(found))
    assert moments.moments(found.where("false")).count() == 0
    with pytest.raises(ValueError):
        moments.moments(make_days({"a": [0.5]}, kind="double"))


# -------------------------------------------------------------------- drift


def arrive(spark, source, rows_, settings="user string, day date, " + ", ".join(f"{f} long" for f in FEATURES)):
    spark.createDataFrame(rows_, settings).coalesce(1).write.mode("append").parquet(source)


def streamed(spark, source, out, checkpoint, schema, history=None):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    with live_drift.list_state(spark):
        run = live_drift.recent_means_stream(stream, history).writeStream.format("parquet")
        run = run.option("path", out).option("checkpointLocation", checkpoint)
        run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def test_state_goes_on_between_runs(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    rng = random.Random(4)
    made = [
        (user, START + timedelta(days=k * step), *(rng.choice((None, *range(9))) for _ in FEATURES))
        for user, step, n in (("a", 1, 40), ("b", 3, 30), ("c", 1, 5)) for k in range(n)
    ]
    all_days = spark.createDataFrame(made, "user string, day date, " + ", ".join(f"{f} long" for f in FEATURES))
    cuts = [START + timedelta(days=n) for n in (10, 17, 18, 40, 200)]
    history = all_days.where(F.col("day") <= F.lit(cuts[0]))
    for after, until in zip(cuts[:-1], cuts[1:], strict=True):
        part = [r for r in made if after < r[1] <= until]
        rng.shuffle(part)
        arrive(spark, source, part)
        found = streamed(spark, source, out, checkpoint, all_days.schema, live_drift.last_days(history))
    names = ["user", "day", *[f"recent_{f}" for f in FEATURES]]
    want = drift.recent_means(all_days).where(F.col("day") > F.lit(cuts[0])).select(names)
    assert rows(found.select(names)) == rows(want)
    assert found.where("late").count() == 0
    # A day that is older than the newest known one is marked and changes nothing.
    arrive(spark, source, [("a", START + timedelta(days=20), 1, 1, 1, 1, 1), ("a", START + timedelta(days=300), 2, 2, 2, 2, 2)])
    found = streamed(spark, source, out, checkpoint, all_days.schema, live_drift.last_days(history))
    late = found.where("late").collect()
    assert [(r["user"], r["day"], r["recent_logon_count"]) for r in late] == [("a", START + timedelta(days=20), None)]
    assert found.where(F.col("day") == F.lit(START + timedelta(days=300))).count() == 1


# ----------------------------------------------------------------- manifest


def test_the_manifest_names_the_files_of_an_actor(spark, scores, tmp_path):
    path = str(tmp_path / "serving")
    tables.write_serving(scores, path, partitions=6)
    found = manifest.write_manifest(spark, path)
    assert found.count() == len([n for n in os.listdir(path) if n.endswith(".parquet")])
    assert {r["row_groups"] for r in found.collect()} == {1}
    served = manifest.ServedTable(spark, path, scores.schema)
    for actor in [r[0] for r in scores.select("user").distinct().collect()] + ["0", "zz", "", "é"]:
        own = scores.where(F.col("user") == actor)
        assert rows(served.lookup(actor)) == rows(own)
        holding = {r[0] for r in spark.read.parquet(path).where(F.col("user") == actor)
                   .select(F.col("_metadata.file_path")).distinct().collect()}
        assert {f.removeprefix("file:") for f in served.files(actor)} >= {h.removeprefix("file:") for h in holding}
        assert len(served.files(actor)) <= max(2, len(holding))
    assert rows(tables.read_served(spark, path)) == rows(scores)  # scans pass the manifest over
    tables.write_serving(scores, path, partitions=2)  # a rewritten table has none until it is made anew
    with pytest.raises(tables.MissingSource):
        manifest.read_manifest(spark, path)


def test_a_manifest_too_long_for_the_driver_is_asked(spark, scores, tmp_path, monkeypatch):
    path = str(tmp_path / "serving")
    tables.write_serving(scores, path, partitions=6)
    manifest.write_manifest(spark, path)
    monkeypatch.setattr(manifest, "HELD_FILES", 2)
    served = manifest.ServedTable(spark, path, scores.schema)
    assert not served.held and rows(served.lookup("7")) == rows(scores.where("user = '7'"))


def test_groups_of_many_actors_carry_bloom_filters(spark, scores, tmp_path):
    """The writer adds them where a group's actors do not fit a dictionary, which serves as well."""
    import pyarrow.parquet as pq

    path = str(tmp_path / "serving")
    name = F.concat_ws("-", "user", "day", F.repeat(F.sha2(F.concat("user", F.col("day").cast("string")), 256), 6))
    tables.write_serving(scores.withColumn("user", name), path, partitions=1)
    file = next(str(tmp_path / "serving" / n) for n in os.listdir(path) if n.endswith(".parquet"))
    groups = pq.ParquetFile(file).metadata
    used = sum(groups.row_group(k).column(c).total_compressed_size
               for k in range(groups.num_row_groups) for c in range(groups.num_columns))
    assert os.path.getsize(file) - used - groups.serialized_size > 20_000


# ------------------------------------------------------ days, totals, search


def test_rewriting_a_day_leaves_the_other_files(spark, scores, tmp_path):
    path = str(tmp_path / "days")
    picked = [r[0] for r in scores.select("day").distinct().orderBy("day").limit(4).collect()]
    some = scores.where(F.col("day").isin(picked))
    tables.write_days(some, path)

    def files():
        return {(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}

    before = files()
    day = picked[1]
    tables.write_days(some.where(F.col("day") == F.lit(day)).withColumn("role", F.lit("new")), path)
    changed = before ^ files()
    assert changed and all(d.endswith(f"day={day}") for d, _ in changed)
    got = tables.read_served(spark, path, schema=scores.schema)
    assert rows(got) == rows(some.withColumn("role", F.when(F.col("day") == F.lit(day), "new").otherwise(F.col("role"))))


def test_totals_come_with_the_write(spark, scores, tmp_path):
    path = str(tmp_path / "compact")
    totals = serving.write_compact(scores, path)
    want = serving.stats(scores).first().asDict()
    assert totals == {k: v for k, v in want.items() if k != "total_users"}
    passing, _ = serving.observed_totals(scores)
    assert plan(serving.compact(serving.threat_base(passing))).count("Scan parquet") == 1
    assert spark.read.parquet(path).count() == serving.threat_base(scores).count()
    none = serving.write_compact(scores.where("false"), path)
    assert none["total_user_days"] == 0 and none["first_day"] is None


def test_search_pushes_the_names(spark, scores, tmp_path):
    path = str(tmp_path / "actors")
    search.distinct_actors(scores).write.parquet(path)
    actors = spark.read.parquet(path)
    for user, options in (("7", {}), ("^[1-3].$", {"regex": True}), ("no one", {}), ("1", {"min_severity": "High"})):
        found = search.search_threats(scores, actors, user, **options)
        assert rows(found) == rows(serving.matching_threats(scores, user=user, **options))
        read = plan(found)
        assert found.isEmpty() or "In(user, [" in read or "EqualTo(user" in read
        assert "Contains" not in read and "RLIKE" not in read
    beyond = search.search_threats(scores, actors, "1", most=0)
    assert "contains(lower(user" in plan(beyond).lower() and rows(beyond) == rows(serving.matching_threats(scores, user="1"))


# ------------------------------------------------------------------- audits


def test_batches_are_merged_once(spark, tmp_path):
    lines, pairs, checkpoint = (str(tmp_path / n) for n in ("lines", "pairs", "cp"))
    made = [
        ("user_timeline_access", f"2024-01-01T00:{k // 60:02d}:{k % 60:02d}+00:00", f"ip{k % 2}", None, f"U{k % 4}", k % 5 > 0)
        for k in range(200)
    ]
    for k in range(0, 200, 10):
        spark.createDataFrame(made[k : k + 10], AUDIT_SCHEMA).coalesce(1).write.mode("append").json(lines)
    run = live.write_audit_pairs(live.stream_audit(spark, lines, 1), pairs, checkpoint, merge_every=4)
    run.trigger(availableNow=True).start().awaitTermination()
    assert len([n for n in os.listdir(pairs) if "=" in n]) <= 2 + 4
    want = rows(audit_pairs(live.lookups(spark.createDataFrame(made, AUDIT_SCHEMA))))
    assert rows(live.read_audit_pairs(spark, pairs)) == want
    # A merge repeated, also one that was lost behind its commit, with a batch folder left.
    audit_pairs(live.lookups(spark.createDataFrame(made[:10], AUDIT_SCHEMA))).write.parquet(f"{pairs}/batch=0")
    assert rows(live.read_audit_pairs(spark, pairs)) == want
    live.merge_audit_pairs(spark, pairs, 19)
    assert rows(live.read_audit_pairs(spark, pairs)) == want
    assert not [n for n in os.listdir(pairs) if n.startswith("batch=")]


# ------------------------------------------------------------------ rejects


def test_rejected_lines_name_their_file(spark, tmp_path):
    folder = tmp_path / "logon"
    folder.mkdir()
    (folder / "a.csv").write_text("id,date,user,pc,activity\n1,01/02/2010 07:00:00,u,p,Logon\n2,not a date,u,p,Logon\n3,,u,p,Logon\n")
    (folder / "b.csv").write_text("id,date,user,pc,activity\n4,1/2/2010 7:0:0,u,p,Logon\n5,13/45/2010 07:00:00,u,p,Logon\n6,01/02/2010 07:00:00,u\n")
    scan = logs.scan_log_parts(spark, str(folder))
    assert [(str(r["date"]), r["user"]) for r in scan.rows.orderBy("date").collect()] == [
        ("None", "u"), ("2010-01-02 07:00:00", "u"), ("2010-01-02 07:00:00", "u")]
    found = {(r["file"].rsplit("/", 1)[1], r["line"]) for r in scan.rejects.collect()}
    assert found == {("a.csv", "2,not a date,u,p,Logon"), ("b.csv", "5,13/45/2010 07:00:00,u,p,Logon"), ("b.csv", "6,01/02/2010 07:00:00,u")}
    counts = {r["file"].rsplit("/", 1)[1]: r["lines"] for r in logs.reject_counts(scan.rejects).collect()}
    assert counts == {"a.csv": 1, "b.csv": 2}
    with pytest.raises(Exception, match="(?i)timestamp|parse"):
        logs.scan_log(spark, str(folder)).collect()  # the strict scan fails as before
