"""Alert rules on streams against their batch twins and exact values."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from matchspark.queries.stream_queries import _with_timers
from matchspark.streaming import alerts as A
from matchspark.streaming import held as H
from matchspark.streaming import jobs as J

EVENTS = "event_id bigint, ts timestamp, target string, predicted double, actual double"
START = datetime.datetime(2024, 1, 1)


def run(spark, tmp_path, files, rule, schema):
    """Land the files one after the other, run what is there each time, read what was sent."""
    root = str(tmp_path)
    for rows in files:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(root + "/in")
        stream = J.read_stream(spark, root + "/in", spark.createDataFrame([], EVENTS).schema)
        J.run_available(rule(stream), root + "/cp", sink=root + "/out")
    return sorted(tuple(r) for r in spark.read.schema(schema).parquet(root + "/out").collect())


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def wrong(i, target, minute, miss):
    return (i, at(minute), target, 10.0, 10.0 + miss)


def test_a_breach_fires_after_its_hold_and_ends_without_rows_of_its_own(spark, tmp_path):
    """Five targets: one recovers, one falls silent, one is too short, one is broken by a gap, one never breaks."""
    rows = [wrong(i, "recovers", 5 * i, 9.0 if i < 4 else 0.0) for i in range(6)]
    rows += [wrong(i, "silent", 5 * i, 9.0) for i in range(3)]
    rows += [wrong(i, "short", 5 * i, 9.0 if i == 1 else 0.0) for i in range(4)]
    rows += [wrong(0, "gap", 0, 9.0), wrong(1, "gap", 10, 9.0), (2, at(0), "gap", None, 1.0), (3, at(5), "gap", 1.0, None)]
    rows += [wrong(i, None, 5 * i, 9.0) for i in range(2)]
    clock = [[wrong(0, "clock", 200, 0.0)]]

    def rule(df):
        return H.accuracy_steps(df, 1.0, 0.7, "5 minutes", "10 minutes")

    sent = _with_timers(spark, lambda: run(
        spark, tmp_path, [[r for r in rows if r[1] < at(10)], [r for r in rows if r[1] >= at(10)], *clock],
        lambda s: H.held_stream(rule(s), 2, 300).withColumn("target", F.coalesce("target", F.lit("none"))), H.EVENT,
    ))
    want = sorted([
        ("recovers", "firing", at(0), at(10), 2), ("recovers", "resolved", at(0), at(20), 4),
        ("silent", "firing", at(0), at(10), 2), ("silent", "resolved", at(0), at(15), 3),
        ("none", "firing", at(0), at(10), 2), ("none", "resolved", at(0), at(10), 2),
    ])
    assert sent == want
    batch = H.held_batch(rule(spark.createDataFrame(rows, EVENTS)), 2, 300)
    assert sorted(tuple(r) for r in batch.fillna("none", ["target"]).collect()) == want


def test_the_end_of_a_breach_is_sent_only_when_the_next_step_is_over(spark):
    rows = [wrong(i, "a", 5 * i, 9.0) for i in range(3)]
    steps = H.accuracy_steps(spark.createDataFrame(rows, EVENTS), 1.0, 0.7)
    for minutes, states in [(9, []), (10, ["firing"]), (19, ["firing"]), (20, ["firing", "resolved"])]:
        until = F.lit(at(minutes)).cast("timestamp")
        assert sorted(r.state for r in H.held_batch(steps, 2, 300, until).collect()) == states


def test_random_breaches_in_stream_and_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, at(rng.uniform(0, 600)), rng.choice("abc"), rng.gauss(50, 20), 0.0) for i in range(900)]
    rows.sort(key=lambda r: r[1])
    history = spark.createDataFrame([("a", 50.0, 20.0), ("b", 60.0, 15.0), ("c", 20.0, 10.0)], "target string, hm double, hs double")
    late = [(10_000, at(2000), "none", 1.0, 1.0)]  # moves the time on, has no history

    def rule(df):
        return H.drift_steps(df, history, 0.3, "10 minutes", "30 minutes")

    frame = spark.createDataFrame(rows, EVENTS)
    want = sorted(tuple(r) for r in H.held_batch(rule(frame), 2, 600).collect())
    assert len(want) > 20
    sent = _with_timers(spark, lambda: run(
        spark, tmp_path, [rows[:400], rows[400:], late], lambda s: H.held_stream(rule(s), 2, 600), H.EVENT
    ))
    assert sent == want


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("error", [0.01, 0.2])
def test_p95_of_the_sketch_is_within_its_error(spark, error):
    rng = random.Random(7)
    values = [rng.lognormvariate(0, 3) for _ in range(500)] + [0.0, -1.0, None]
    rows = [(i, at(i % 90), "a", v, 0.0) for i, v in enumerate(values)]
    got = A.p95_sketch(spark.createDataFrame(rows, EVENTS), -1.0, "30 minutes", "30 minutes", error=error).collect()
    assert len(got) == 3
    for r in got:
        own = sorted(v for _, ts, _, v, _ in rows if v is not None and r.window_start <= ts < r.window_end)
        exact = own[math.ceil(0.95 * len(own)) - 1]
        assert abs(r.p95 - exact) <= error * exact * (1 + 1e-9)
    low = spark.createDataFrame([(1, at(0), "a", 0.0, 0.0), (2, at(0), "a", -5.0, 0.0)], EVENTS)
    assert [r.p95 for r in A.p95_sketch(low, -1.0, "30 minutes", "30 minutes").collect()] == [0.0]
    assert A.p95_sketch(low.limit(0), -1.0, "30 minutes", "30 minutes").count() == 0
