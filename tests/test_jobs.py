"""The stored job log and its references, against plain rules."""

import hashlib
import hmac
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from grafloom.jobs import GONE, REFERENCES, JobLog
from grafloom.operators import control as C
from grafloom.operators import references as R

T0 = "2024-05-01 12:00:00"


def at(text):
    return F.lit(text).cast("timestamp")


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    return f"file://{tmp_path_factory.mktemp('jobs')}"


def log_at(spark, root):
    log = JobLog(spark, root)
    put = log.store.put
    put("tenants", rows(spark, [(1, "one", "tenant_one", None, "active", None), (2, "two", "tenant_two", None, "suspended", None), (3, "three", "tenant_three", None, "active", None)], log.store.tables["tenants"].schema))
    put("users", rows(spark, [(10, "ann", "active", None), (11, "bo", "active", None)], log.store.tables["users"].schema))
    put("members", rows(spark, [(1, 10, "owner"), (1, 11, "member"), (3, 11, "owner")], log.store.tables["members"].schema))
    put("tokens", rows(spark, [(7, 1, 10, "t", "x"), (8, 3, 11, "u", "y")], log.store.tables["tokens"].schema))
    put("connections", rows(spark, [(1, "a", "org/a", None, "s0", 7, True, True, None), (1, "b", "org/b", "dev", None, 8, False, True, None), (2, "c", "org/c", None, None, None, True, True, None), (3, "d", "org/d", None, None, 8, True, False, None)], log.store.tables["connections"].schema))
    put("second_factors", rows(spark, [(10, None), (11, None)], log.store.tables["second_factors"].schema))
    put("backup_codes", spark.createDataFrame([(1, 10, "h", None), (2, 10, "h", None), (3, 11, "h", None)], log.store.tables["backup_codes"].schema).withColumn("used_at", F.when(F.col("id") == 2, at(T0))))
    return log


def requests(spark, *names):
    return spark.createDataFrame([(*n.split("/"), "push") for n in names], "tenant_id string, repo_name string, trigger string").withColumn("tenant_id", F.col("tenant_id").cast("long"))


def ids(spark, *numbers):
    return spark.createDataFrame([(n,) for n in numbers], "id long")


def test_life_of_a_job(spark, tmp_path):
    log = log_at(spark, f"file://{tmp_path}")
    made = {(r.tenant_id, r.repo_name): r for r in log.enqueue(requests(spark, "1/a", "1/b", "1/a", "2/c"), at(T0)).collect()}
    assert {k: r.id for k, r in made.items()} == {(1, "a"): 1, (1, "b"): 2, (2, "c"): 3}
    assert {(r.status, r.attempts, r.trigger, str(r.created_at)) for r in made.values()} == {("queued", 0, "push", T0)}
    assert log.enqueue(requests(spark, "1/a"), at(T0)).count() == 0  # a burst collapses
    assert [r.id for r in log.enqueue(requests(spark, "1/a", "3/d"), at(T0)).collect()] == [5]  # 4 is left out for good

    taken = {r.id: r for r in log.claim(ids(spark, 1, 2, 3), at("2024-05-01 12:01:00")).collect()}
    assert sorted(taken) == [1, 2] and (taken[1].slug, taken[1].token_ciphertext, taken[1].git_ref) == ("one", "x", "s0") and taken[2].token_ciphertext is None
    now = {r.id: r for r in log.table().collect()}
    assert (now[1].status, now[1].attempts, str(now[1].started_at), now[1].finished_at) == ("running", 1, "2024-05-01 12:01:00", None)
    assert (now[3].status, now[3].error, str(now[3].finished_at)) == ("failed", GONE, "2024-05-01 12:01:00")
    assert log.claim(ids(spark, 1), at("2024-05-01 12:21:00")).count() == 0
    assert [r.id for r in log.claim(ids(spark, 1), at("2024-05-01 12:21:01")).collect()] == [1]  # silent for over 20 minutes
    assert [r.id for r in log.enqueue(requests(spark, "1/a"), at("2024-05-01 12:22:00")).collect()] == [7]  # one may wait while one runs

    results = spark.createDataFrame([(1, True, "s9", "", "{}"), (2, False, None, "e" * 3000, None)], "id long, ok boolean, commit_sha string, error string, stats string")
    done = {r.id: r for r in log.finish(results, at("2024-05-01 13:00:00")).collect()}
    assert (done[1].status, done[1].commit_sha, done[1].error, done[1].stats, str(done[1].finished_at)) == ("succeeded", "s9", None, "{}", "2024-05-01 13:00:00")
    assert (done[2].status, len(done[2].error)) == ("failed", C.MAX_ERROR_CHARS)
    pins = {r.repo_name: (r.git_ref, str(r.last_indexed_at)) for r in log.table("connections").collect()}
    assert pins == {"a": ("s9", "2024-05-01 13:00:00"), "b": (None, "None"), "c": (None, "None"), "d": (None, "None")}

    log.claim(ids(spark, 5, 7), at("2024-05-01 13:00:00"))
    assert log.fail_stale(at("2024-05-01 15:00:00")).count() == 0
    stale = log.fail_stale(at("2024-05-01 15:00:01")).collect()
    assert sorted((r.id, r.status, str(r.finished_at)) for r in stale) == [(n, "failed", "2024-05-01 15:00:01") for n in (5, 7)] and all(r.error for r in stale)
    assert sorted(r.id for r in log.prune("jobs", "finished_at", at("2024-05-02 13:00:00"), "1 day").collect()) == [3]
    assert sorted(r.id for r in log.table().collect()) == [1, 2, 5, 7]


def test_one_of_two_gets_it(spark, tmp_path):
    """Claims and requests of several writers at once: each job is taken, and each repository queued, by one of them."""
    root = f"file://{tmp_path}"
    log = log_at(spark, root)
    with ThreadPoolExecutor(3) as pool:
        queued = list(pool.map(lambda _: [r.id for r in JobLog(spark, root).enqueue(requests(spark, "1/a", "1/b"), at(T0)).collect()], range(3)))
        assert sorted(map(len, queued))[-1] > 0 and sum(map(len, queued)) == 2
        job = next(i for x in queued for i in x)
        taken = list(pool.map(lambda _: JobLog(spark, root).claim(ids(spark, job), at(T0)).count(), range(3)))
    assert sorted(taken) == [0, 0, 1]
    assert {r.id: r.attempts for r in log.table().collect()}[job] == 1


def test_deletes_follow_references(spark, tmp_path):
    log = log_at(spark, f"file://{tmp_path}")
    log.enqueue(requests(spark, "1/a", "1/b", "3/d"), at(T0))
    assert log.delete("tokens", F.col("id") == 8)["tokens"].count() == 1
    tokens = {r.repo_name: (r.tenant_id, r.github_token_id) for r in log.table("connections").collect()}
    assert tokens == {"a": (1, 7), "b": (1, 8), "c": (2, None), "d": (3, None)}  # b names a token of another tenant: no reference
    gone = {t: df.count() for t, df in log.delete("tenants", F.col("slug") == "one").items() if df.count()}
    assert gone == {"tenants": 1, "members": 2, "tokens": 1, "connections": 2, "jobs": 2}
    assert [r.repo_name for r in log.table().collect()] == ["d"] and log.table("users").count() == 2
    log.store.put("tokens", rows(spark, [(9, 3, 11, "v", "z")], log.store.tables["tokens"].schema))
    log.delete("users", F.col("login") == "bo")
    assert [(r.id, r.created_by) for r in log.table("tokens").collect()] == [(9, None)] and log.table("members").count() == 0
    assert [tuple(r) for r in C.unused_codes(log.table("second_factors"), log.table("backup_codes")).collect()] == [(10, False, 1)]


def test_reference_rules(spark):
    a = rows(spark, [(1, "x"), (2, "y")], "id long, n string")
    b = rows(spark, [(1, 1, "p"), (2, None, "p"), (3, 2, "q"), (4, 5, "q")], "id long, a long, v string")
    refs = [R.Reference("b", ("a",), "a", ("id",), "forbid")]
    with pytest.raises(R.ForbiddenDelete):
        R.deleted({"a": a, "b": b}, refs, {"a": F.col("id") == 1})
    assert R.deleted({"a": a, "b": b}, refs, {"a": F.col("id") == 1, "b": F.col("v") == "p"}).left["b"].count() == 2
    assert [(r.child, r.row) for r in R.orphans({"a": a, "b": b}, refs).collect()] == [("b", '{"a":5}')]
    assert sorted(tuple(r) for r in R.duplicates(b, ["v"]).collect()) == [("p", 2), ("q", 2)]
    with pytest.raises(ValueError):
        R.in_order(["a", "b"], [*refs, R.Reference("a", ("id",), "b", ("id",))])
    order = R.in_order(sorted({r.child for r in REFERENCES} | {r.parent for r in REFERENCES}), REFERENCES)
    assert all(order.index(r.parent) < order.index(r.child) for r in REFERENCES)


def test_ways_in(spark, tmp_path):
    log = log_at(spark, f"file://{tmp_path}")
    first = log.on_schedule(at(T0))
    assert sorted((r.tenant_id, r.repo_name, r.trigger) for r in first["queued"].collect()) == [(1, "a", "schedule"), (3, "d", "schedule")] and first["failed"].count() == 0
    sign = lambda body: "v1=" + hmac.new(b"m", f"enqueue:1000.{body}".encode(), hashlib.sha256).hexdigest()
    bodies = ['{"tenant_id": 1, "repo_name": "b"}', '{"tenant_id": "1", "repo_name": "b"}', '{"tenant_id": 1, "repo_name": "a"}', '{"tenant_id": 2, "repo_name": "c"}', '{"repo_name": "b"}', "no", '{"tenant_id": "x", "repo_name": "b"}']
    asked = [(i, b, "1000", sign(b)) for i, b in enumerate(bodies)] + [(7, bodies[0], "1000", "v1=no"), (8, bodies[0], None, sign(bodies[0]))]
    told = {int(r.id): (r.status, r.job_id is not None) for r in log.on_app(spark.createDataFrame(asked, "id long, body string, stamp string, signature string"), "m", at(T0), 1100).collect()}
    assert told == {0: (202, True), 1: (200, False), 2: (200, False), 3: (404, False), 4: (400, False), 5: (400, False), 6: (400, False), 7: (401, False), 8: (401, False)}
    again = log.on_app(spark.createDataFrame(asked[:1], "id long, body string, stamp string, signature string"), "m", at(T0), 1100).collect()
    assert [(r.status, r.job_id is not None) for r in again] == [(202, True)] and log.table().filter("trigger = 'manual'").count() == 1
