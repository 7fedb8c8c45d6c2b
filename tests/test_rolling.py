"""Trailing figures of requests: running sums from both sides of a bucket's edge."""

from __future__ import annotations

import datetime as dt
import random

from tessera.operators import aggregate


def test_rolling_figures_match_brute_force(spark):
    rnd, start = random.Random(5), dt.datetime(2024, 1, 1)
    rows = [(k, rnd.choice("ab"), start + dt.timedelta(seconds=rnd.randrange(0, 400), microseconds=rnd.choice([0, 0, 1, 999_999])), rnd.choice([None, 1.5, 2.25, 8.0]), rnd.choice([None, True, False])) for k in range(300)]
    rows += [(300, "a", None, 4.0, True), (301, "a", None, None, False), (302, "b", None, 2.0, True), (303, None, start, 2.0, None), (304, "c", start, None, None)]
    requests = spark.createDataFrame(rows, "event_id int, tool string, ts timestamp_ntz, duration double, error boolean")
    rolled = aggregate.rolling(requests, ["tool"], 60)
    assert rolled.columns == ["event_id", "tool", "ts", "duration", "error", "n", "avg_duration", "error_rate"]
    got = {r["event_id"]: (r["n"], r["avg_duration"], r["error_rate"]) for r in rolled.collect()}
    mean = lambda xs: sum(xs) / len(xs) if xs else None
    for k, tool, ts, _, _ in rows:
        own = [r for r in rows if r[1] == tool and (r[2] is None if ts is None else r[2] is not None and ts - dt.timedelta(seconds=60) <= r[2] <= ts)]
        assert got[k] == (len(own), mean([r[3] for r in own if r[3] is not None]), mean([float(r[4]) for r in own if r[4] is not None])), k
    assert len(got) == len(rows)


def test_no_range_is_summed_anew_for_each_request(spark):
    requests = spark.createDataFrame([], "tool string, ts timestamp, duration double, error boolean")
    plan = aggregate.rolling(requests, ["tool"], 60)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("windowframe(") > 0 and plan.count("windowframe(") == plan.count("unboundedpreceding")
