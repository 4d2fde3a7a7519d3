from __future__ import annotations

from pyspark.sql import functions as F

from habitus.config import FEATURES
from habitus.operators.baseline import zscores
from habitus.operators.drift import drift_signal, drift_zscores

CREEP = [2] * 40 + [5] * 40


def flags(df):
    return [r.drift_flag for r in df.orderBy("user", "day").collect()]


def test_slow_rise_drifts_though_no_day_stands_out(make_days):
    scored = zscores(make_days({"creeper": CREEP}))
    assert scored.agg(F.max("z_logon_count")).first()[0] < 2.5
    drifted = drift_signal(scored).where("drift_flag").orderBy("day").collect()
    assert drifted
    text = drifted[0].drift_reasons
    assert text.startswith("sustained rise in logon count over the trailing 14 days (recent avg ")
    assert " vs personal baseline 3.5, trend z=" in text


def test_one_spike_is_no_drift(make_days):
    assert not any(flags(drift_signal(zscores(make_days({"s": [2] * 40 + [20] + [2] * 40})))))


def test_needs_a_full_window(make_days):
    assert not any(flags(drift_signal(zscores(make_days({"n": [5] * 13})))))
    rows = drift_zscores(zscores(make_days({"n": list(range(14))}))).orderBy("day").collect()
    assert [r.recent_logon_count for r in rows] == [None] * 13 + [6.5]


def test_no_baseline_no_drift(make_days):
    rows = drift_signal(make_days({"u": [2] * 20})).collect()
    assert all(not r.drift_flag and r.drift_reasons == "" for r in rows)


def test_no_day_column_no_drift(make_days):
    rows = drift_signal(zscores(make_days({"u": CREEP})).drop("day")).collect()
    assert not any(r.drift_flag for r in rows)


def test_window_counts_rows_not_calendar_days(make_days):
    days = make_days({"u": CREEP})
    sparse = days.withColumn("day", F.expr("date_add(date'2020-01-01', datediff(day, date'2020-01-01') * 30)"))
    assert flags(drift_signal(zscores(days))) == flags(drift_signal(zscores(sparse)))


def test_matches_a_plain_recomputation(make_days):
    series = {f"u{i}": [(k * k + i) % (2 + k // 10) for k in range(60)] for i in range(6)}
    rows = drift_signal(zscores(make_days(series))).orderBy("user", "day").collect()
    assert any(r.drift_flag for r in rows)
    history: dict[str, list] = {}
    for r in rows:
        past = history.setdefault(r.user, [])
        past.append(r)
        expected = []
        for f in FEATURES:
            if len(past) < 14 or r[f"std_{f}"] is None:
                continue
            recent = sum(p[f] for p in past[-14:]) / 14
            z = (recent - r[f"mean_{f}"]) / (r[f"std_{f}"] / 14**0.5)
            if z > 3:
                expected.append(
                    f"sustained rise in {f.replace('_', ' ')} over the trailing 14 days (recent avg "
                    f"{recent:.1f} vs personal baseline {r[f'mean_{f}']:.1f}, trend z={z:.1f})"
                )
        assert r.drift_reasons == "; ".join(expected)
        assert r.drift_flag == bool(expected)
