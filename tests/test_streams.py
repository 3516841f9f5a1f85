"""Ordered state of streams: any arrival order inside the delay gives the batch result, and the end of the input is reached."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from skyledger.functions.columns import MINUTE
from skyledger.streaming import jobs

SCHEMA = "principal STRING, us LONG, seq LONG, geo STRING, event STRING, event_id STRING, ts TIMESTAMP"
START = 1_700_000_000_000_000


def rows_of(n: int, people: list[str]) -> list[tuple]:
    rnd = random.Random(7)
    out, us = [], START
    for i in range(n):
        us += rnd.randint(0, 4) * MINUTE // 2
        out.append((rnd.choices(people, [n, *[1] * (len(people) - 1)])[0], us, i, rnd.choice(["DE", "FR", ""]), rnd.choice(["ListRoles", "ListUsers", "GetPolicy", "PutObject", "DescribeTrails"]), f"e{i}"))
    return out


def travels(rows, gap):
    last, out = {}, set()
    for who, us, _, geo, _, eid in sorted(rows, key=lambda r: r[1:3]):
        if geo:
            if who in last and last[who][0] != geo and us - last[who][1] <= gap:
                out.add((who, eid))
            last[who] = (geo, us)
    return out


def bursts(rows, window, least):
    seen, firing, out = {}, {}, set()
    for who, us, _, _, event, eid in sorted(rows, key=lambda r: r[1:3]):
        if event == "PutObject":
            continue
        latest = seen.setdefault(who, {})
        latest[event] = us
        hit = sum(us - t <= window for t in latest.values()) >= least
        if hit and not firing.get(who):
            out.add((who, eid))
        firing[who] = hit
    return out


def streamed(spark, rows, job):
    """Shuffled over several files, one a batch: the rows of a slice come in different batches."""
    random.Random(1).shuffle(rows)
    frame = lambda part: spark.createDataFrame([(*r, None) for r in part], SCHEMA).withColumn("ts", F.timestamp_micros("us"))
    marker = frame([("nobody", START + 10**14, 10**9, "DE", "ListRoles", "end")])
    arrived = frame(rows)
    build = lambda path: job(jobs.read_events(spark, path, arrived.schema, files_per_trigger=1))
    return {(r["principal"], r["event_id"]) for r in jobs.drain_to_the_end(build, arrived.repartition(5), marker, "test").collect()}


def test_travel_in_any_order_to_the_end(spark):
    rows = rows_of(600, ["busy", "a", "b"])
    assert streamed(spark, rows, lambda s: jobs.stream_impossible_travel(s, 60, '30 days')) == travels(rows, 60 * MINUTE)


def test_bursts_in_any_order_to_the_end(spark):
    rows = rows_of(600, ["busy", "a", "b"])
    assert streamed(spark, rows, lambda s: jobs.stream_enumeration_bursts(s, 5, 3, '30 days')) == bursts(rows, 5 * MINUTE, 3)
