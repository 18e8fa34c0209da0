"""Second receives, dead letters, the schedule and signed requests as streams, with restarts."""

import hashlib
import hmac
import os

from pyspark.sql import functions as F

from grafloom.jobs import JobLog
from grafloom.streaming import schedule
from grafloom.streaming.deliveries import LEFT, Deliveries
from tests.test_jobs import at, log_at


def messages(spark, *names):
    return spark.createDataFrame([(n, f"body of {n}") for n in names], "id string, body string")


def state(box):
    return {r.id: (r.status, r.attempts) for r in box.table().collect()}


def test_second_receive_and_dead_letters(spark, tmp_path):
    root = f"file://{tmp_path}"
    box = Deliveries(spark, root)
    done = []

    def work(rows):
        names = [r.id for r in rows.collect()]
        done.append(sorted(names))
        return rows.select("id", F.when(F.col("id").startswith("bad"), F.lit("no luck")).alias("error"))

    box.run(work, messages(spark, "a", "bad", "b"), at("2024-01-01 00:00:00"))
    assert state(box) == {"a": ("done", 1), "b": ("done", 1), "bad": ("waiting", 1)}
    box.run(work, messages(spark, "a", "c"), at("2024-01-01 00:15:59"))  # a is known, bad is hidden
    assert done[-1] == ["c"]
    box = Deliveries(spark, root)
    box.run(work, None, at("2024-01-01 00:16:00"))
    assert done[-1] == ["bad"] and state(box)["bad"] == ("dead", 2)
    box.run(work, messages(spark, "bad"), at("2024-01-02 00:00:00"))
    assert done[-1] == [] and [(r.id, r.body, r.attempts, r.error) for r in box.table("dead_letters").collect()] == [("bad", "body of bad", 2, "no luck")]
    box.prune(at("2024-01-16 00:00:00"))
    assert box.table("dead_letters").count() == 0 and "bad" not in state(box) and len(state(box)) == 3


def test_a_worker_that_dies(spark, tmp_path):
    """What was received and not settled comes again, then goes to the dead letters."""
    box = Deliveries(spark, f"file://{tmp_path}")
    assert [r.attempts for r in box.receive(messages(spark, "x"), at("2024-01-01 00:00:00")).collect()] == [1]
    assert box.receive(None, at("2024-01-01 00:10:00")).count() == 0
    assert [r.attempts for r in box.receive(None, at("2024-01-01 00:20:00")).collect()] == [2]
    assert box.receive(None, at("2024-01-01 00:40:00")).count() == 0
    assert [(r.id, r.error) for r in box.table("dead_letters").collect()] == [("x", LEFT)]


def test_stream_goes_on(spark, tmp_path):
    """Work that raises twice lands in the dead letters once; the stream goes on, and a restart repeats nothing."""
    box, seen, hour = Deliveries(spark, f"file://{tmp_path}/box"), [], [0]

    def work(rows):
        names = sorted(r.id for r in rows.collect())
        seen.append(names)
        if any(n.startswith("bad") for n in names):
            raise RuntimeError("broken")
        return rows.select("id", F.lit(None).cast("string").alias("error"))

    def run(*names):
        hour[0] += 1
        if names:
            messages(spark, *names).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream = spark.readStream.schema("id string, body string").json(f"{tmp_path}/in")
        clock = lambda: at(f"2024-01-01 {hour[0]:02d}:00:00")
        query = stream.writeStream.foreachBatch(box.each(work, clock)).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert query.exception() is None

    run("bad")
    run("good")  # received with the bad one, whose error takes both
    assert state(box) == {"bad": ("dead", 2), "good": ("waiting", 1)}
    run("fine")
    run()
    assert state(box) == {"bad": ("dead", 2), "good": ("done", 2), "fine": ("done", 1)}
    assert seen == [["bad"], ["bad", "good"], ["fine", "good"]] and box.table("dead_letters").count() == 1


def test_missed_ticks_are_made_up_once(spark, tmp_path):
    log = log_at(spark, f"file://{tmp_path}/log")
    clock = tmp_path / "clock"

    def run(now):
        clock.write_text(str(now))
        times = schedule.ticks(spark, 0, schedule.DAY, str(clock))
        query = schedule.daily(times, log, f"{tmp_path}/cp", availableNow=True)
        query.awaitTermination(240)
        assert query.exception() is None
        return sorted((r.repo_name, str(r.created_at)) for r in log.table().collect())

    day = schedule.DAY
    assert run(20_000 * day + 100) == []  # nothing is due when it begins
    first = run(20_001 * day + 5)
    assert first == [("a", "2024-10-05 00:00:00"), ("d", "2024-10-05 00:00:00")]
    assert run(20_001 * day + 500) == first
    log.claim(log.table().select("id"), at("2024-10-05 00:01:00"))
    assert run(20_004 * day + 9) == sorted([*first, ("a", "2024-10-08 00:00:00"), ("d", "2024-10-08 00:00:00")])
    assert run(20_004 * day + 99) == run(20_004 * day + 100)


def test_requests_stream(spark, tmp_path):
    log = log_at(spark, f"file://{tmp_path}/log")
    sign = lambda body: "v1=" + hmac.new(b"m", f"enqueue:1000.{body}".encode(), hashlib.sha256).hexdigest()
    body = '{"tenant_id": 1, "repo_name": "a"}'

    def run(*rows):
        spark.createDataFrame([(i, b, "1000", s) for i, b, s in rows], schedule.REQUESTS).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        query = schedule.answered(schedule.read_requests(spark, f"{tmp_path}/in"), log, "m", f"{tmp_path}/cp", lambda: 1001, availableNow=True)
        query.awaitTermination(240)
        assert query.exception() is None
        return {r.id: r.status for r in JobLog(spark, f"file://{tmp_path}/log").table("outcomes").collect()}

    assert run(("x", body, sign(body)), ("y", body, "v1=0")) == {"x": 202, "y": 401}
    assert run(("z", body, sign(body))) == {"x": 202, "y": 401, "z": 200}
    # Offsets lost: all is delivered again and nothing changes.
    os.rename(f"{tmp_path}/cp", f"{tmp_path}/gone")
    assert run(("w", "{}", sign("{}"))) == {"x": 202, "y": 401, "z": 200, "w": 400}
    assert log.table().count() == 1
