"""Streams against their batch forms, and the control plane against plain Python."""

import hashlib
import hmac
import json
import random

from pyspark.sql import functions as F

from grafloom.operators import control as C
from grafloom.operators import events as E
from grafloom.sinks.store import GraphStore, provision
from grafloom.streaming import jobs, limits, route


def batches(spark, folder, rows, schema, n):
    """A file stream that reads ``rows`` in n micro-batches."""
    size = -(-len(rows) // n)
    for k in range(n):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").json(f"{folder}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{folder}/in")


def drained(stream, folder, name):
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    query.awaitTermination(240)
    return sorted(tuple(r) for r in stream.sparkSession.table(name).collect())


def job_events():
    rng = random.Random(4)
    return [(rng.randint(1, 2), f"r{rng.randint(0, 2)}", rng.choice(["request", "request", "claim", "succeeded", "failed", "sweep"]), rng.choice(["push", "manual"]), 600 * (i // 2 + 1), i) for i in range(240)]


def test_job_stream_equals_fold(spark, tmp_path):
    """The stream with timers against the batch fold and single steps in plain order."""
    rows = job_events()
    stream = batches(spark, tmp_path, rows, jobs.EVENTS, 4)
    got = drained(jobs.job_transitions(stream, "0 seconds"), tmp_path, "job_transitions")
    table = spark.createDataFrame(rows, jobs.EVENTS)
    whole = sorted(tuple(r) for r in jobs.fold(table).collect())
    # The last timers may be open when the input ends.
    end = max(r[4] for r in rows)
    assert set(got) <= set(whole) and all(r[6] + jobs.DEAD_AFTER > end - 600 or r in got for r in whole) and len(got) == len(set(got))
    assert {r[3] for r in got} == {"queued", "running", "succeeded", "failed"}
    plain = []
    for key in {r[:2] for r in rows}:
        state = jobs._EMPTY
        for r in sorted((r for r in rows if r[:2] == key), key=lambda r: (r[4], r[5])):
            state, made = jobs.step(state, r[2], r[3], r[4])
            plain += [(*key, *m) for m in made]
        plain += [(*key, *m) for m in jobs.expired(state, end)[1]]
    assert whole == sorted(plain)


def test_order_within_a_second(spark):
    """A request and a claim of one second: by number where they have one, else the request first."""
    rows = [(1, "a", "claim", None, 5, None), (1, "a", "request", "push", 5, None), (2, "a", "claim", None, 5, 1), (2, "a", "request", "push", 5, 2)]
    got = sorted(tuple(r)[:4] for r in jobs.fold(spark.createDataFrame(rows, jobs.EVENTS)).collect())
    assert got == [(1, "a", 1, "queued"), (1, "a", 1, "running"), (2, "a", 1, "queued")]


def test_silent_jobs_fail_by_a_timer(spark, tmp_path):
    """A running job fails two hours after its start although its key has no more events, in a stream that is stopped
    and started again in between; once."""
    put = lambda rows: spark.createDataFrame(rows, jobs.EVENTS).coalesce(1).write.mode("append").json(f"{tmp_path}/in")

    def run():
        out = jobs.job_transitions(spark.readStream.schema(jobs.EVENTS).json(f"{tmp_path}/in"), "0 seconds")
        query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination(240)
        return sorted(tuple(r)[1:] for r in spark.read.parquet(f"{tmp_path}/out").collect())

    put([(1, "silent", "request", "push", 100, 1), (1, "silent", "claim", None, 110, 2), (1, "busy", "request", "push", 100, 1), (1, "busy", "claim", None, 110, 2)])
    first = run()
    assert {r[0]: r[2] for r in first if r[5] == 110} == {"silent": "running", "busy": "running"}
    put([(1, "busy", "claim", None, 7000, 3)])
    assert run() == sorted([*first, ("busy", 1, "running", "push", 2, 7000)])
    put([(1, "other", "request", "push", 7400, 1)])  # another key's event moves the clock
    third = run()
    assert [r for r in third if r[2] == "failed"] == [("silent", 1, "failed", "push", 1, 7311)]
    put([(1, "other", "claim", None, 7500, 2), (1, "silent", "succeeded", None, 7500, 3)])  # too late
    assert [r for r in run() if r[0] == "silent"] == [r for r in third if r[0] == "silent"]


def test_job_rules():
    state, made = jobs.step(jobs._EMPTY, "request", "push", 0)
    assert made == [(1, "queued", "push", 0, 0)] and jobs.step(state, "request", "push", 1) == (state, [])
    state, made = jobs.step(state, "claim", None, 5)
    assert made == [(1, "running", "push", 1, 5)] and jobs.step(state, "claim", None, 5 + 1200)[1] == []
    assert jobs.step(state, "claim", None, 6 + 1200)[1] == [(1, "running", "push", 2, 1206)]
    assert jobs.step(state, "other", None, 5 + 7200)[1] == [] and jobs.step(state, "other", None, 6 + 7200)[1] == [(1, "failed", "push", 1, 7206)]
    again, made = jobs.step(state, "request", "manual", 7)
    assert made == [(2, "queued", "manual", 0, 7)]
    assert jobs.step(jobs.step(again, "succeeded", None, 8)[0], "claim", None, 9)[1] == [(2, "running", "manual", 1, 9)]


def test_limit_streams_equal_batch(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.choice("abc"), t) for t in sorted(rng.randint(0, 4000) for _ in range(120))]
    table = spark.createDataFrame(rows, limits.HITS)
    for name, f in (("hits", lambda d: limits.rate_windows(d, 5, 300)), ("locks", lambda d: limits.failure_locks(d, 3600, 6, 60)), ("touches", lambda d: limits.throttled(d, 120))):
        folder = tmp_path / name
        got = drained(f(batches(spark, folder, rows, limits.HITS, 3)), folder, f"limit_{name}")
        assert got == sorted(tuple(r) for r in f(table).collect()) and got, name
    last = {r.key: r.hits for r in E.rate_window_fold(table.select("key", F.col("at").alias("t")), 300).collect()}
    hits = limits.rate_windows(table, 5, 300).groupBy("key").agg(F.max_by("hits", F.struct("at", "hits")).alias("n")).collect()
    assert {r.key: r.n for r in hits} == last
    folded = sorted((r.key, r.window_start) for r in E.window_starts(table.select("key", F.col("at").alias("t")), 120).collect())
    assert folded == sorted(tuple(r) for r in limits.throttled(table, 120).collect())


def test_lock_rules():
    state, told = None, []
    for t in range(12):
        state, (n, wait, _) = limits.failure(state, t, 3600, 10, 900)
        told.append((n, wait))
    assert told[:4] == [(1, 0), (2, 0), (3, 0), (4, 2)] and told[8] == (9, 64) and told[9] == (10, 900) and told[10] == (1, 0)
    for _ in range(40):
        state, (_, wait, _) = limits.failure(state, 20, 3600, 1, 900)
    assert wait == limits.MOST_LOCK
    assert limits.hit((0, 5), 300, 5, 300) == ((0, 6), (6, False, 1)) and limits.hit((0, 5), 301, 5, 300)[0] == (301, 1)


def control_tables(spark):
    tenants = spark.createDataFrame([(1, "one", "tenant_one", "active"), (2, "two", "tenant_two", "closed"), (3, "three", "tenant_three", "active")], "id long, slug string, schema_name string, status string")
    connections = spark.createDataFrame([(1, "a", "Org/A", None, "s1", True, True, 7), (1, "b", "org/a", "dev", None, False, True, 8), (2, "c", "org/a", None, None, True, True, None), (3, "d", "org/d", None, None, True, False, 7)], "tenant_id long, repo_name string, external_repo string, branch string, git_ref string, index_daily boolean, index_on_push boolean, github_token_id long")
    tokens = spark.createDataFrame([(7, 1, b"x"), (8, 3, b"y")], "id long, tenant_id long, token_ciphertext binary")
    return tenants, connections, tokens


def test_signed_pushes_become_requests(spark, tmp_path):
    tenants, connections, _ = control_tables(spark)

    def delivery(master, tenant, repo, ref, event="push", full="ORG/a"):
        body = json.dumps({"ref": ref, "repository": {"full_name": full, "default_branch": "main"}})
        secret = hmac.new(master.encode(), f"webhook:{tenant}:{repo}".encode(), hashlib.sha256).hexdigest()
        return (event, "sha256=" + hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest(), body)

    rows = [delivery("m", 1, "a", "refs/heads/main"), delivery("m", 1, "b", "refs/heads/main"), delivery("m", 1, "b", "refs/heads/dev"), delivery("m", 2, "c", "refs/heads/main"), delivery("wrong", 1, "a", "refs/heads/main"), delivery("m", 1, "a", "refs/heads/main", "ping"), ("push", None, rows_body()), ("push", "sha256=", "not json"), delivery("m", 3, "d", "refs/heads/main", full="org/d")]
    table = spark.createDataFrame(rows, route.PUSH)
    want = [(1, "a", "push"), (1, "b", "push")]
    assert sorted(tuple(r) for r in route.requests(route.parsed(table), connections, tenants, "m").collect()) == want
    body = F.from_json("body", "ref string, repository struct<full_name:string,default_branch:string>")
    numbered = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, " + route.PUSH).withColumn("x", body).select("id", "event", "signature", "body", F.col("x.repository.full_name").alias("full_name"), F.coalesce("x.ref", F.lit("")).alias("ref"), F.col("x.repository.default_branch").alias("default_branch"))
    told = [(r.status, r.connections, r.requests) for r in C.delivery_outcomes(numbered, connections, tenants, "m").orderBy("id").collect()]
    assert told == [(202, 1, 1), (202, 1, 0), (202, 1, 1), (401, 0, 0), (401, 0, 0), (200, 1, 0), (401, 0, 0), (400, 0, 0), (401, 0, 0)]
    table.coalesce(1).write.json(f"{tmp_path}/in")
    stream = route.requests(route.read_pushes(spark, f"{tmp_path}/in"), connections, tenants, "m")
    assert drained(stream, tmp_path, "push_requests") == want


def rows_body():
    return json.dumps({"ref": "refs/heads/main", "repository": {"full_name": "org/a", "default_branch": "main"}})


def test_app_requests(spark):
    sign = lambda t, b: "v1=" + hmac.new(b"m", f"enqueue:{t}.{b}".encode(), hashlib.sha256).hexdigest()
    rows = [("x", "1000", sign(1000, "x")), ("x", "600", sign(600, "x")), ("y", "1000", sign(1000, "x")), ("x", None, "v1="), ("x", "soon", "v1="), ("x", "1300", sign(1300, "x"))]
    df = spark.createDataFrame(rows, "body string, stamp string, signature string")
    assert [r.ok for r in df.select(C.app_verified("m", 1000)("body", "stamp", "signature").alias("ok")).collect()] == [True, False, False, False, False, True]


def test_control_joins(spark):
    tenants, connections, tokens = control_tables(spark)
    assert [tuple(r) for r in C.scheduled_connections(connections, tenants).collect()] == [(1, "a"), (3, "d")]
    jobs_in = spark.createDataFrame([(1, 1, "a", "push"), (2, 1, "b", "push"), (3, 2, "c", "push"), (4, 3, "gone", "push")], "id long, tenant_id long, repo_name string, trigger string")
    details = {r.id: (r.slug, r.token_ciphertext) for r in C.claim_details(jobs_in, connections, tenants, tokens).collect()}
    assert details == {1: ("one", bytearray(b"x")), 2: ("one", None)}
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    table = spark.createDataFrame([(1, 1, "a", "push", "queued", 0, "old", None), (2, 1, "b", "push", "running", 1, None, "2024-01-01 11:39:59"), (3, 1, "c", "push", "running", 1, None, "2024-01-01 11:40:00"), (4, 3, "d", "push", "running", 1, None, "2024-01-01 09:00:00"), (5, 3, "e", "push", "failed", 1, "no", None)], "id long, tenant_id long, repo_name string, trigger string, status string, attempts int, error string, started_at string").withColumn("started_at", F.col("started_at").cast("timestamp"))
    got = {r.id: (r.claimed, r.status, r.attempts, r.error) for r in C.claimed(table, spark.createDataFrame([(1,), (2,), (3,), (5,)], "id long"), now).collect()}
    assert got == {1: (True, "running", 1, None), 2: (True, "running", 2, None), 3: (False, "running", 1, None), 4: (False, "running", 1, None), 5: (False, "failed", 1, "no")}
    closed, queue = C.daily_run(table, connections, tenants, now)
    assert {r.id: r.status for r in closed.collect()} == {1: "queued", 2: "running", 3: "running", 4: "failed", 5: "failed"}
    assert [tuple(r) for r in queue.collect()] == [(3, "d", "schedule")]
    claims = spark.createDataFrame([(1, "org/x", None, "s1", "push", True), (2, "org/x", None, "s1", "manual", True), (3, "org/x", None, "s0", "push", True), (4, "org/x", None, "s1", "push", False), (5, "org/x", "dev", "s1", "push", True)], "id long, external_repo string, branch string, git_ref string, trigger string, indexed boolean")
    heads = spark.createDataFrame([("org/x", "main", "s1", True), ("org/x", "dev", "s2", False)], "external_repo string, branch string, sha string, is_default boolean")
    assert {r.id: r.sha for r in C.needs_run(claims, heads).collect()} == {2: "s1", 3: "s1", 4: "s1", 5: "s2"}


def test_members_and_sets(spark):
    tenants, _, _ = control_tables(spark)
    users = spark.createDataFrame([(1, "ann"), (2, "bo")], "id long, login string")
    members = spark.createDataFrame([(1, 1, "member"), (1, 3, "owner"), (2, 2, "owner")], "user_id long, tenant_id long, role string")
    rows = C.memberships(users, members, tenants)
    assert sorted(tuple(r) for r in rows.collect()) == [(1, "ann", 1, "one", "member"), (1, "ann", 3, "three", "owner")]
    assert [tuple(r) for r in C.primary_membership(rows).collect()] == [(1, "three", "owner")]
    a, b = (spark.createDataFrame([(x,) for x in t], "n string") for t in ("aab", "bc"))
    assert sorted(tuple(r) for r in C.compared(a, b, ["n"]).collect()) == [("a", "left"), ("b", "both"), ("c", "right")]
    assert [r.x for r in a.select(C.any_of(F.col("n"), ["a"]).alias("x")).collect()] == [True, True, False] and a.filter(C.any_of(F.col("n"), [])).count() == 0


def test_retention_and_touches(spark):
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    rows = spark.createDataFrame([("2024-01-08 23:59:59",), ("2024-01-09 00:00:00",)], "t string").withColumn("t", F.col("t").cast("timestamp"))
    kept = C.pruned({"sessions": rows, "other": rows}, {"sessions": ("t", "1 day")}, now)
    assert {k: v.count() for k, v in kept.items()} == {"sessions": 1, "other": 2}
    uses = spark.createDataFrame([("a", s) for s in (0, 30, 60, 61, 100, 122)], "key string, s long").select("key", F.timestamp_seconds("s").alias("at"))
    assert sorted(r.s for r in C.touched(uses).select(F.unix_seconds("at").alias("s")).collect()) == [0, 61, 122]


def test_batches_are_committed_once(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/s")
    seen = []
    run = route.once(store, lambda _, number: seen.append(number))
    for number in (0, 0, 1, 0, 1):
        run(spark.range(1), number)
    assert seen == [0, 1]


def test_changes_with_null_hashes(spark):
    old, new = (spark.createDataFrame(rows, "repo string, path string, hash string") for rows in ([("r", "a", None), ("r", "b", "x"), ("r", "c", "x"), ("r", "e", None)], [("r", "a", None), ("r", "b", None), ("r", "d", None), ("r", "e", "y")]))
    assert {r.path: r.change for r in E.change_set(old, new).collect()} == {"a": "same", "b": "changed", "c": "deleted", "d": "added", "e": "changed"}


def test_several_repositories_in_one_plan(spark, tmp_path):
    """The same graphs as one by one, in one commit; an invalid name or folder takes only its own answer."""
    from grafloom.api import CodeGraph

    for name, text in (("a", "import b\n\n\ndef f():\n    return g()\n"), ("b", "def g():\n    return 1\n"), ("c", "x = 1\n")):
        (tmp_path / "work" / name).mkdir(parents=True)
        (tmp_path / "work" / name / "m.py").write_text(text)
    (tmp_path / "work" / "empty").mkdir()
    one, many = (CodeGraph(spark, GraphStore(spark, f"file://{tmp_path}/{s}"), str(tmp_path / "work")) for s in ("one", "many"))
    told = many.index_repositories({n: n for n in ("a", "b", "c", "empty", "gone")} | {"no/name": "a"})
    assert "error" in told["gone"] and "error" in told["no/name"] and many.store.version() == 1
    assert {n: told[n] for n in "abc"} == {n: one.index_repository(n, n) for n in "abc"}
    assert told["empty"]["nodes"] == 0 and many.store.repos() == ["a", "b", "c", "empty"]
    same = lambda t: sorted(map(str, one.store.read(t).collect())) == sorted(map(str, many.store.read(t).collect()))
    assert all(same(t) for t in ("nodes", "edges", "files", "imports"))
    (tmp_path / "work" / "b" / "n.py").write_text("def h():\n    return 2\n")
    (tmp_path / "work" / "c" / "m.py").unlink()
    told = many.reindex_repositories(["a", "b", "c", "none"])
    assert "error" in told["none"] and {n: told[n] for n in "abc"} == {n: one.reindex_repository(n) for n in "abc"}
    assert all(same(t) for t in ("nodes", "edges", "files", "imports")) and told["c"]["files_deleted"] == 1 and told["c"]["nodes"] == 0


def test_running_jobs_index_their_repository(spark, tmp_path):
    """A running job indexes its repository in its tenant's graph, a second one re-indexes it; queued ones do nothing, and
    two tenants' repositories of one name stay apart. One that fails is told as failed and holds nobody up."""
    from grafloom.api import CodeGraph

    for name in ("1/a", "1/b", "2/a"):
        (tmp_path / "work" / name).mkdir(parents=True)
        (tmp_path / "work" / name / "m.py").write_text("def f():\n    return 1\n")
    (tmp_path / "work" / "2" / "a" / "k.py").write_text("def g():\n    return 2\n")
    graphs = {t: CodeGraph(spark, provision(spark, f"file://{tmp_path}/stores", f"t{t}"), str(tmp_path / "work" / str(t))) for t in (1, 2)}
    rows = [(1, "a", 1, "running", "push", 1, 5), (1, "b", 1, "queued", "push", 0, 5), (2, "a", 1, "running", "push", 1, 5), (2, "none", 1, "running", "push", 1, 5), (3, "a", 1, "running", "push", 1, 5)]
    stream = batches(spark, tmp_path, rows, jobs.TRANSITIONS, 1)

    def run():
        route.index_on_change(stream, graphs.__getitem__, f"{tmp_path}/results", f"{tmp_path}/cp").awaitTermination(240)
        told = spark.read.schema(route.RESULTS).json(f"{tmp_path}/results").collect()
        return sorted((r.tenant_id, r.repo_name, r.job, r.kind) for r in told)

    first = run()
    assert first == [(1, "a", 1, "succeeded"), (2, "a", 1, "succeeded"), (2, "none", 1, "failed"), (3, "a", 1, "failed")]
    assert [[(r["name"], r["file_count"]) for r in graphs[t].list_repositories()] for t in (1, 2)] == [[("a", 1)], [("a", 2)]]
    (tmp_path / "work" / "1" / "a" / "n.py").write_text("def g():\n    return 2\n")
    spark.createDataFrame([(1, "a", 2, "running", "push", 1, 9)], jobs.TRANSITIONS).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    assert run() == sorted([*first, (1, "a", 2, "succeeded")])
    assert [r["file_count"] for r in graphs[1].list_repositories()] == [2]


def test_worker_runs_stored_jobs(spark, tmp_path):
    """Claimed jobs are indexed in their tenants' graphs and finished: new ones, an unchanged one, one without a branch."""
    from grafloom.api import CodeGraph
    from tests.test_jobs import at, ids, log_at, requests

    log = log_at(spark, f"file://{tmp_path}/log")
    for name in ("1/a", "1/b", "3/d"):
        (tmp_path / "work" / name).mkdir(parents=True)
        (tmp_path / "work" / name / "m.py").write_text("def f():\n    return 1\n")
    graphs = {t: CodeGraph(spark, provision(spark, f"file://{tmp_path}/stores", f"t{t}"), str(tmp_path / "work" / str(t))) for t in (1, 3)}
    heads = spark.createDataFrame([("org/a", "main", "s1", True), ("org/b", "main", "s1", True), ("org/b", "dev", "s2", False)], "external_repo string, branch string, sha string, is_default boolean")

    def run(*names, trigger="push"):
        made = log.enqueue(requests(spark, *names).withColumn("trigger", F.lit(trigger)), at("2024-05-01 12:00:00"))
        done = route.run_jobs(log, made.select("id"), graphs.__getitem__, heads, at("2024-05-01 12:05:00")).collect()
        return {r.repo_name: (r.status, r.commit_sha, "unchanged" in (r.stats or ""), r.error) for r in done}

    assert run("1/a", "1/b", "3/d") == {"a": ("succeeded", "s1", False, None), "b": ("succeeded", "s2", False, None), "d": ("failed", None, False, "the branch to index isn't there")}
    assert sorted(r["name"] for r in graphs[1].list_repositories()) == ["a", "b"] and graphs[3].list_repositories() == []
    assert {r.repo_name: r.git_ref for r in log.table("connections").collect() if r.tenant_id == 1} == {"a": "s1", "b": "s2"}
    assert run("1/a") == {"a": ("succeeded", "s1", True, None)}
    (tmp_path / "work" / "1" / "a" / "n.py").write_text("def g():\n    return 2\n")
    assert run("1/a", trigger="manual") == {"a": ("succeeded", "s1", False, None)}
    assert {r["name"]: r["file_count"] for r in graphs[1].list_repositories()} == {"a": 2, "b": 1}
    assert log.claim(ids(spark, 1), at("2024-05-01 12:06:00")).count() == 0
