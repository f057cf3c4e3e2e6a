"""Streams with list and value state, timers, late rows and restarts."""

import datetime
import random
import time
from collections import defaultdict

from pyspark.sql import functions as F

from corpusloom.plans import catalogue
from corpusloom.sources.scratch import few_rows
from corpusloom.streaming import control, flows

SF = "/root/testdata/sf0.001"
RULE = control.Rule(window=20, baseline_n=10, pause_ms=60_000, errors=20, least_errors=10, in_a_row=6)
SCHEMA = "event_id long, domain string, ts timestamp, latency double, status int"


def log(seed, n=240):
    """Requests of three domains in order of time, one every two seconds: calm, limited now and then, and one that dies."""
    rng, out = random.Random(seed), []
    for k in range(n):
        domain = rng.choice(["calm", "limited", "dying"])
        status = 200
        if domain == "limited" and rng.random() < 0.06:
            status = 429
        if domain == "dying" and k > n // 2:
            status = rng.choice([500, 503, None])
        out.append((k, domain, datetime.datetime(2024, 1, 1) + datetime.timedelta(milliseconds=2000 * k + rng.randrange(900)), round(rng.uniform(0.1, 0.4), 3), status))
    return out


def millis(ts):
    return int(ts.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)


def plain(rows, mark, rule=RULE):
    """The events of a log up to ``mark``, folded in one go."""
    out = []
    by = defaultdict(list)
    for event_id, domain, ts, latency, status in rows:
        if millis(ts) <= mark:
            by[domain].append((millis(ts), event_id, latency, status))
    for domain, requests in by.items():
        c, latencies, errors = control.Control(), [], []
        for at, _, latency, status in sorted(requests, key=lambda r: r[:2]):
            out += [(domain, *e) for e in control.step(rule, c, latencies, errors, at, latency, status)]
        out += [(domain, *e) for e in control.resume(c, mark)]
    return sorted(out)


def write(spark, folder, k, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/part")
    return k


def stream(spark, folder, files=1):
    schema = spark.createDataFrame([], SCHEMA).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(folder)


def collected(df):
    return sorted((r.domain, r.at, r.event, r.value) for r in df.collect())


def test_rates_of_a_stream_are_those_of_a_fold_and_survive_a_restart_in_a_pause(spark, tmp_path):
    rows, folder = log(3), str(tmp_path / "in")
    mark = lambda some: (millis(max(r[2] for r in some)) - 10_000) // control.TICK_MS * control.TICK_MS
    events = plain(rows, mark(rows))
    kinds = {e[2] for e in events}
    assert {"baseline", "pause", "resume", "halt"} <= kinds
    pause = next(e for e in events if e[2] == "pause")
    inside = [k for k, r in enumerate(rows) if pause[1] < millis(r[2]) < pause[1] + RULE.pause_ms][10]  # the first run ends here, within the pause
    run = lambda: flows.drain(control.rate_control(stream(spark, folder), "domain", "string", "10 seconds", RULE), str(tmp_path / "out"), str(tmp_path / "check"))
    step = max(1, inside // 2)
    for k in range(0, inside, step):
        write(spark, folder, k, rows[k : min(k + step, inside)])
    first = collected(run())
    assert first == plain(rows, mark(rows[:inside]))
    shuffled = rows[inside:]
    random.Random(1).shuffle(shuffled)  # in one file no order is needed
    write(spark, folder, 9, shuffled)
    assert collected(run()) == events


def test_late_rows_change_nothing_and_are_counted(spark, tmp_path):
    rows, folder = log(5, 120), str(tmp_path / "in")
    write(spark, folder, 0, rows)
    run = lambda: flows.drain(control.rate_control(stream(spark, folder), "domain", "string", "10 seconds", RULE), str(tmp_path / "out"), str(tmp_path / "check"))
    first = collected(run())
    late = [(1000 + k, "calm", rows[0][2] + datetime.timedelta(seconds=k), 0.1, 429) for k in range(20)]
    write(spark, folder, 1, late)
    query = control.rate_control(stream(spark, folder), "domain", "string", "10 seconds", RULE).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "check"))
    found = query.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")).trigger(availableNow=True).start()
    found.awaitTermination()
    assert control.dropped(found) == 20
    assert collected(flows.written(spark, str(tmp_path / "out"), "batch", run().schema)) == first


def test_timers_and_state_go_by_keys_and_not_by_rows(spark, tmp_path):
    nothing = {3: None, 5: float("nan")}
    rows = [(k, *r[1:3], nothing.get(k % 7, r[3]), r[4]) for k, r in enumerate(log(3))]
    want = plain([(*r[:3], 0.0 if r[0] % 7 in nothing else r[3], r[4]) for r in rows], (millis(max(r[2] for r in rows)) - 10_000) // control.TICK_MS * control.TICK_MS)
    rows[11] = (None, *rows[11][1:])
    folder = str(tmp_path / "in")
    write(spark, folder, 0, rows)
    rates, alive = control.rate_control(stream(spark, folder), "domain", "string", "10 seconds", RULE), control.liveness(stream(spark, folder), "domain", "string", "10 seconds", 60_000)
    for name, made in (("rates", rates), ("alive", alive)):
        out = str(tmp_path / name)
        with few_rows(spark, 50):  # a key's rows come in more than one batch of Arrow
            query = made.writeStream.outputMode("append").option("checkpointLocation", f"{out}-check").foreachBatch(lambda b, n, out=out: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).trigger(availableNow=True).start()
            query.awaitTermination()
        timers = [s["customMetrics"]["numRegisteredTimers"] for p in query.recentProgress for s in p["stateOperators"]]
        assert timers[0] == 3 and max(timers) <= 6, timers
    assert collected(flows.written(spark, str(tmp_path / "rates"), "batch", rates.schema)) == want


def test_silence_is_noticed_by_event_time(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    folder = str(tmp_path / "in")
    rows = [(1, "a", at(0)), (2, "a", at(30)), (3, "b", at(40)), (4, "a", at(200)), (5, "c", at(1000))]
    for k, r in enumerate(rows):
        write(spark, folder, k, [(*r, None, None)])
    got = flows.drain(control.liveness(stream(spark, folder), "domain", "string", "5 seconds", 60_000), str(tmp_path / "out"), str(tmp_path / "check"))
    base = millis(at(0))
    want = [("a", 0, "RUNNING"), ("a", 90, "DEAD"), ("a", 200, "RUNNING"), ("a", 260, "DEAD"), ("b", 40, "RUNNING"), ("b", 100, "DEAD")]
    assert sorted((r.domain, (r.at - base) / 1000, r.event) for r in got.collect()) == want


def test_death_is_told_without_input(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, folder, 0, [(1, "a", datetime.datetime(2024, 1, 1), None, None)])
    rows = control.heartbeats(stream(spark, folder), "domain", "string", 2000)
    query = rows.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "check")).foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).trigger(processingTime="1 second").start()
    try:
        for _ in range(90):
            time.sleep(1)
            events = [r.event for r in flows.written(spark, out, "batch", rows.schema).collect()]
            if "DEAD" in events:
                break
    finally:
        query.stop()
    assert sorted(events) == ["DEAD", "RUNNING"]


def test_rows_of_former_batches_and_repeats_are_left_out(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = log(2, 30)
    write(spark, folder, 0, rows[:20])
    write(spark, folder, 1, rows[10:])
    earlier = spark.createDataFrame([(k,) for k in (0, 5, 29)], "event_id long")
    got = flows.drain(control.unseen(stream(spark, folder), earlier, ["event_id"], "1 hour"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert sorted(r.event_id for r in got.collect()) == [k for k in range(30) if k not in (0, 5, 29)]


def test_query_of_rates(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), "value", "event_type").collect()
    rule = control.Rule(window=20, baseline_n=10, pause_ms=6 * 3_600_000, errors=20, least_errors=10)
    mark = (max(r.t for r in events) - 3_600_000) // control.TICK_MS * control.TICK_MS
    want, by = [], defaultdict(list)
    for r in events:
        if r.t <= mark:
            by[r.user_id].append((r.t, r.event_id, r.value, 503 if r.event_type == "error" else 200))
    for user, rows in by.items():
        c, latencies, errors = control.Control(), [], []
        for at, _, latency, status in sorted(rows, key=lambda r: r[:2]):
            want += [(user, *e) for e in control.step(rule, c, latencies, errors, at, latency, status)]
        want += [(user, *e) for e in control.resume(c, mark)]
    got = [(r.user_id, r.at, r.event, r.value) for r in catalogue.QUERIES["stream_rate_control"](spark, SF).collect()]
    assert len(got) > 20 and sorted(got) == sorted(want)
