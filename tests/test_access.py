from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from habitus.functions.clients import client_key
from habitus.operators.access import (
    AdmissionLog,
    audit_pairs,
    audit_report,
    epoch_micros,
    lookups,
    merge_pairs,
    micros_to_ts,
    stretches,
    throttle_decisions,
    trailing_request_count,
    trailing_requests,
    requests_per_instant,
)

START = datetime(2024, 1, 1)


def frame(spark, times):
    """Requests at so many seconds after START, per client."""
    rows = [(c, START + timedelta(seconds=s)) for c, seconds in times.items() for s in seconds]
    return spark.createDataFrame(rows, "client string, ts timestamp_ntz")


def by_hand(seconds, limit, window):
    """Each request on its own, against the list of all that were let in before it."""
    micros = sorted(round(s * 1_000_000) for s in seconds)
    reach, let_in, rows = window * 1_000_000, [], {}
    for at in micros:
        row = rows.setdefault(at, [0, 0, 0, None])
        row[0] += 1
        in_window = [t for t in let_in if at - reach <= t <= at]
        if limit <= 0 or len(in_window) < limit:
            let_in.append(at)
            row[1] += 1
        else:  # the first whole second at which the oldest one is out of the window
            row[2] += 1
            row[3] = next(w for w in range(1, window + 2) if min(in_window) < at + w * 1_000_000 - reach)
    return {at: tuple(row) for at, row in rows.items()}


def decided(df):
    return {
        (r.client, round((r.ts - START) / timedelta(microseconds=1))): (
            r.requests,
            r.admitted,
            r.refused,
            r.retry_after,
        )
        for r in df.collect()
    }


def us(seconds):
    return round(seconds * 1_000_000)


def expected(times, limit, window):
    return {
        (c, s): e for c, seconds in times.items() for s, e in by_hand(seconds, limit, window).items()
    }


def test_the_sixth_request_is_refused(spark):
    rows = decided(throttle_decisions(frame(spark, {"c": range(6)}), limit=5, window=60))
    assert [rows["c", us(s)][1] for s in range(6)] == [1, 1, 1, 1, 1, 0]
    assert rows["c", us(5)] == (1, 0, 1, 56)


def test_zero_disables_the_limit(spark):
    rows = decided(throttle_decisions(frame(spark, {"c": [0] * 50}), limit=0))
    assert rows == {("c", 0): (50, 50, 0, None)}


def test_clients_are_independent(spark):
    rows = decided(throttle_decisions(frame(spark, {"noisy": [0, 1, 2, 3], "quiet": [3]}), 3, 60))
    assert rows["noisy", us(3)][2] == 1 and rows["quiet", us(3)][1] == 1


def test_an_entry_counts_until_it_is_strictly_older(spark):
    rows = decided(throttle_decisions(frame(spark, {"c": [0, 60, 61]}), limit=1, window=60))
    assert [rows["c", us(s)][1] for s in (0, 60, 61)] == [1, 0, 1]


def test_parts_of_seconds_count(spark):
    """A request 60.8 seconds after the one before is let in, whatever the whole seconds say."""
    rows = decided(throttle_decisions(frame(spark, {"c": [0.1, 60.9], "d": [0.9, 60.1]}), 1, 60))
    assert rows["c", us(60.9)] == (1, 1, 0, None) and rows["d", us(60.1)] == (1, 0, 1, 1)


def test_each_burst_is_a_stretch_of_its_own(spark):
    """Bursts every few minutes for two days, many of them within one bucket."""
    bursts = [300 * k for k in range(576)]
    times = {"c": [b + 0.25 * k for b in bursts for k in range(5)]}
    counted = trailing_requests(requests_per_instant(frame(spark, times)), 60)
    found = stretches(counted, 60, 3).collect()
    assert len(found) == len(bursts) and all(r.last - r.first == us(0.25) for r in found)
    assert decided(throttle_decisions(frame(spark, times), 3, 60)) == expected(times, 3, 60)


def test_refused_requests_are_not_recorded(spark):
    """A client that hammers on is let in again as soon as its first entry is gone."""
    rows = decided(throttle_decisions(frame(spark, {"c": range(200)}), limit=10, window=60))
    assert rows == expected({"c": list(range(200))}, 10, 60)
    assert rows["c", us(61)][1] == 1


@pytest.mark.parametrize("seed", range(6))
def test_matches_the_plain_procedure(spark, seed):
    """Bursts, lulls, gaps of exactly one window and a hot client across buckets."""
    rng = random.Random(seed)
    window = rng.choice([30, 3600, 5000])
    limit = rng.choice([1, 2, 7])
    times = {}
    for c in range(12):
        now, seconds = rng.randrange(4000), []
        for _ in range(rng.choice([5, 60, 200])):
            now += rng.choice([0, 0, 0.3, 1, 3, window // 3, window, window + 0.000001, 2 * window])
            seconds.append(now)
        times[f"c{c}"] = seconds
    times["hot"] = [rng.randrange(80_000) / 4 for _ in range(1500)]
    found = decided(throttle_decisions(frame(spark, times), limit, window))
    assert found == expected(times, limit, window)


def test_trailing_counts(spark):
    rng = random.Random(3)
    times = {f"c{i}": [rng.randrange(30_000) for _ in range(300)] for i in range(3)}
    times["edge"] = [3599, 3600, 7199, 7200, 7201, 10800]
    for window in (60, 3600, 9000):
        rows = trailing_request_count(frame(spark, times), window).collect()
        assert len(rows) == sum(len(set(s)) for s in times.values())
        for r in rows:
            now = (r.ts - START).total_seconds()
            assert r.requests == times[r.client].count(now)
            assert r.trailing == sum(now - window <= s <= now for s in times[r.client])


def test_time_is_independent_of_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    stamps = [datetime(2024, 3, 10, 2, 30, 5, 123456), datetime(2024, 11, 3, 1, 30), datetime(1969, 12, 31, 23, 59, 59, 1)]
    df = spark.createDataFrame([(t,) for t in stamps], "ts timestamp_ntz")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        at = epoch_micros(F.col("ts"))
        rows = df.select(at.alias("s"), micros_to_ts(at).alias("back")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [r.s for r in rows] == [(t - datetime(1970, 1, 1)) // timedelta(microseconds=1) for t in stamps]
    assert [r.back for r in rows] == stamps


def test_admission_log_resumes_from_its_entries():
    log = AdmissionLog(60, 2)
    assert log.decide([0, us(1), us(2)], [1, 1, 1]) == ([1, 1, 0], [0, 0, 59])
    again = AdmissionLog(60, 2, list(log.entries))
    assert again.decide([us(60), us(60) + 1], [1, 1]) == ([0, 1], [1, 0])


def test_client_key(spark):
    df = spark.createDataFrame(
        [
            ("192.0.2.33,10.9.8.7", "h"),
            ("\t 192.0.2.34\u00a0 ,10.9.8.7", "h"),
            ("", "192.0.2.35"),
            (None, "192.0.2.36"),
            (None, None),
        ],
        "xff string, host string",
    )
    keys = df.select(client_key(F.col("xff"), F.col("host"))).collect()
    assert [k[0] for k in keys] == [f"192.0.2.{n}" for n in range(33, 37)] + ["unknown"]


def test_audit_report(spark):
    line = "event string, timestamp string, client string, analyst string, user_id string, found boolean"
    lines = spark.createDataFrame(
        [
            ("user_timeline_access", "2024-01-01T00:00:00+00:00", "ip1", "alice", "U1", True),
            ("user_timeline_access", "2024-01-01T00:00:05+00:00", "ip2", "alice", "U1", True),
            ("user_timeline_access", "2024-01-01T00:00:03+00:00", "ip1", "alice", "NOPE", False),
            ("user_timeline_access", "2024-01-02T00:00:00+00:00", "ip9", None, "U2", True),
            ("stats", "2024-01-02T00:00:00+00:00", "ip9", None, None, True),
        ],
        line,
    )
    accesses = lookups(lines)
    parts = [audit_pairs(accesses.where(c)) for c in ("found", "not found")]
    whole = audit_report(audit_pairs(accesses)).collect()
    merged = audit_report(merge_pairs(parts[0].unionByName(parts[1]))).collect()
    assert Counter(map(str, whole)) == Counter(map(str, merged))
    rows = {r.accessor: r for r in whole}
    assert set(rows) == {"alice", "ip9"}
    alice = rows["alice"]
    assert (alice.lookups, alice.distinct_users) == (3, 2)
    assert alice.not_found_share == pytest.approx(1 / 3)
    assert (alice.last_access - alice.first_access).total_seconds() == 5
