"""Ingestion jobs against a plain-Python twin, over several runs on one checkpoint."""

from __future__ import annotations

import datetime
import random

from quarrystone.streaming import jobs

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
STAGES = ["queued", "downloading", "chunking", "embedding", "done"]


def by_hand(batches, patience, late):
    held, mark = {}, None
    for events in batches:
        late_from = mark
        for job, seq, at, kind in sorted(set(events)):
            if late_from is not None and at <= late_from:
                continue
            state, asked, last, moved = held.get(job, ("queued", False, -1, at))
            if seq <= last or state in ("done", "failed", "cancelled"):
                continue
            if kind == "cancel":
                asked = True
            elif kind == "fail":
                state = "failed"
            elif kind == "advance":
                state = "cancelled" if asked else STAGES[STAGES.index(state) + 1]
            held[job] = (state, asked, seq, at)
        top = max((at for _, _, at, _ in events), default=None)
        if top is not None:
            mark = top - late if mark is None else max(mark, top - late)
        for job, (state, asked, last, at) in held.items():
            if state not in ("done", "failed", "cancelled") and at + patience < mark:
                held[job] = ("cancelled" if asked else "failed", asked, last, at)
    return {j: (s, q) for j, (s, _, q, _) in held.items()}


def test_jobs_over_runs_with_cancels_and_timeouts(spark, tmp_path):
    r = random.Random(6)
    seqs, batches = {}, []
    for b in range(4):
        events = []
        for _ in range(120):
            job = r.randrange(40)
            seqs[job] = seqs.get(job, -1) + 1
            kind = "submit" if not seqs[job] else r.choices(["advance", "cancel", "fail"], [8, 1, 1])[0]
            events.append((job, seqs[job], 3001 * b + 7 * seqs[job] + job / 100, kind))
        events += r.sample(events, 10)  # repeated
        r.shuffle(events)
        batches.append(events)
    batches.append([(999, 0, 60_000.5, "submit")])  # time goes on: all that is open is given up
    for b, events in enumerate(batches):
        rows = [(j, s, START + datetime.timedelta(seconds=at), k) for j, s, at, k in events]
        spark.createDataFrame(rows, jobs.EVENTS).write.parquet(f"{tmp_path}/in/{b}")
        stream = spark.readStream.schema(jobs.EVENTS).parquet(f"{tmp_path}/in/*")
        jobs.run(spark, stream, f"{tmp_path}/out", patience=3600, late=600)
        got = {x["job_id"]: (x["state"], x["seq"]) for x in jobs.states(spark, f"{tmp_path}/out").collect()}
        assert got == by_hand(batches[: b + 1], 3600, 600)
    assert {s for s, _ in got.values()} == {"done", "failed", "cancelled", "queued"}


def test_rules_of_one_event():
    assert jobs.after("queued", True, "advance")[0] == "cancelled"
    assert jobs.after("embedding", False, "advance")[0] == "done"
    assert jobs.after("done", False, "fail")[0] == "done"
    assert jobs.after("chunking", False, "cancel")[:2] == ("chunking", True)
