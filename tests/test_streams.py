"""Streams whose state ends: document states, and sketches of windows."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from docgrid.operators import catalog
from docgrid.streaming import jobs


def put(folder, name, rows):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def time(minutes):
    return (datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)).strftime("%Y-%m-%dT%H:%M:%SZ")


def test_status_machine(spark, tmp_path):
    """Legal, illegal and late events over three batches; the state of ended documents goes, that of open ones stays."""
    source, target = tmp_path / "in", str(tmp_path / "out")
    event = lambda d, seq, status, at: {"document_id": d, "seq": seq, "status": status, "at": time(at)}

    def run():
        events = spark.readStream.schema("document_id string, seq long, status string, at timestamp").json(str(source))
        job = jobs.status_machine(events, "1 minute", 60_000).writeStream.outputMode("update").foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{target}/batch={n}"))
        q = job.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        q.awaitTermination()
        return q.lastProgress.stateOperators[0].numRowsTotal

    first = [event("a", 1, "pending", 0), event("a", 3, "embedding", 2), event("a", 2, "parsing", 1), event("b", 1, "pending", 0), event("b", 2, "ready", 1), event("c", 1, "failed", 1)]
    put(source, "1.json", first)
    assert run() == 3
    second = [event("a", 4, "ready", 3), event("b", 2, "parsing", 3), event("d", 1, "pending", 3)]
    put(source, "2.json", second)
    assert run() == 4
    third = [event("d", 2, "parsing", 100), event("e", 1, "pending", 100)]
    put(source, "3.json", third)
    assert run() == 2  # d and e are open; the others have ended, and the watermark has passed them
    got = [tuple(r) for r in spark.read.parquet(target).select("document_id", "seq", "before", "status", "kind").collect()]
    assert sorted(r for r in got if r[4] == "illegal") == [("b", 2, "pending", "ready", "illegal")]
    assert sorted(r for r in got if r[4] == "late") == [("b", 2, "ready", "parsing", "late")]
    last = {d: s for d, q, _, s, k in sorted(got, key=lambda r: r[1]) if k == "status"}
    assert last == {"a": "ready", "b": "ready", "c": "failed", "d": "parsing", "e": "pending"}


def test_legal_steps_equal_the_batch_rule(spark):
    pairs = [(a, b) for a in jobs.STATES for b in jobs.STATES]
    events = spark.createDataFrame([(f"{a}.{b}", k, s) for a, b in pairs for k, s in enumerate((a, b))], "document_id string, seq int, status string")
    illegal = {r.document_id for r in catalog.illegal_transitions(events).collect()}
    assert {f"{a}.{b}" for a, b in pairs if not jobs.legal_step(a, b)} == illegal


@pytest.mark.parametrize("parts", [1, 3])
def test_sketches_are_near_exact_percentiles(spark, parts):
    """Within one part in a hundred of the nearest-rank percentile; sums of sketches are the sketch of all; zeros and less."""
    r = random.Random(parts)
    rows = [(r.choice("ab"), int(r.lognormvariate(5, 2)) if r.random() < 0.9 else r.choice([0, -3, 1, 2]), r.randrange(5), 1) for _ in range(3000)] + [("c", 0, 1, 1), ("d", 7, 1, 1), ("d", 10**9, 1, 1)]
    df = spark.createDataFrame(rows, "name string, latency_ms long, tok_in long, tok_out long")
    cells = [jobs.latency_cells(df.filter(F.pmod(F.xxhash64("latency_ms", "tok_in"), F.lit(parts)) == k), "name") for k in range(parts)]
    merged = cells[0]
    for c in cells[1:]:
        merged = merged.unionByName(c)
    for x in jobs.sketch_stats(merged, "name").collect():
        own = sorted(v for n, v, _, _ in rows if n == x.name)
        for p, got in ((0.5, x.p50), (0.95, x.p95)):
            exact = own[-(-int(p * 100) * len(own) // 100) - 1]
            assert abs(got - max(exact, 0)) <= max(exact, 0) / 100, (x.name, p, got, exact)
        assert (x.n, x.max_ms) == (len(own), own[-1]) and x.tok_out == len(own)


def test_window_sketches(spark, tmp_path):
    """Windows of an hour, a late trace that still counts, one that is too late and is counted as dropped, a state that ends."""
    source, target = tmp_path / "in", str(tmp_path / "out")
    trace = lambda at, name, ms: {"start_time": time(at), "name": name, "latency_ms": ms, "tok_in": 1, "tok_out": 2}

    def run():
        stream = spark.readStream.schema("start_time timestamp, name string, latency_ms long, tok_in long, tok_out long").json(str(source))
        q = jobs.window_sketches(stream, target, "1 hour", "10 minutes").trigger(availableNow=True).start()
        q.awaitTermination()
        return q.recentProgress

    put(source, "1.json", [trace(5, "x", 10), trace(50, "x", 20), trace(65, "y", 5)])
    run()
    put(source, "2.json", [trace(58, "x", 30), trace(300, "x", 40)])
    run()
    put(source, "3.json", [trace(10, "x", 99), trace(301, "x", 50)])
    progress = run()
    assert sum(p.stateOperators[0].numRowsDroppedByWatermark for p in progress) == 1
    assert progress[-1].stateOperators[0].numRowsTotal == 2  # two cells of the last window
    cells = jobs.read_sketches(spark, target)
    got = {(r.start.hour, r.name): (r.n, r.max_ms, r.tok_out) for r in jobs.sketch_stats(cells, "start", "name").collect()}
    assert got == {(0, "x"): (3, 30, 6), (1, "y"): (1, 5, 2), (5, "x"): (2, 50, 4)}
    whole = {r.name: (r.n, round(r.p50), r.max_ms) for r in jobs.sketch_stats(cells, "name").collect()}
    assert whole == {"x": (5, 30, 50), "y": (1, 5, 5)}
