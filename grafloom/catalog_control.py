"""Registered queries of the control plane: tenants from nations, connections from customers, jobs from orders and
events, members from suppliers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import safe_relative
from .operators import control as C
from .operators import events as E

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_VIEWS = {
    "tenants": "SELECT CAST(n_nationkey AS BIGINT) AS id, lower(n_name) AS slug, 'tenant_' || lower(n_name) AS schema_name, CASE WHEN n_nationkey % 3 = 0 THEN 'closed' ELSE 'active' END AS status FROM nation",
    "connections": """SELECT CAST(c_nationkey AS BIGINT) AS tenant_id, c_name AS repo_name, 'Org/' || c_mktsegment AS external_repo, CASE WHEN c_custkey % 5 = 0 THEN 'dev' END AS branch, 's' || CAST(c_custkey % 3 AS STRING) AS git_ref,
  c_acctbal > 0 AS index_daily, c_custkey % 2 = 0 AS index_on_push, c_custkey % 100 AS github_token_id FROM customer""",
    "tokens": "SELECT s_suppkey AS id, CAST(s_nationkey AS BIGINT) AS tenant_id, s_name AS token_ciphertext FROM supplier",
    "runs": """SELECT o_orderkey AS id, CAST(c_nationkey AS BIGINT) AS tenant_id, c_name AS repo_name, CASE WHEN o_orderkey % 11 = 0 THEN 'manual' ELSE 'push' END AS trigger,
  CASE o_orderkey % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'succeeded' ELSE 'failed' END AS status, 1 AS attempts, CAST(NULL AS STRING) AS error, o_orderdate AS started_at FROM orders JOIN customer ON c_custkey = o_custkey""",
    "members": "SELECT s_suppkey % 40 AS user_id, CAST(s_nationkey AS BIGINT) AS tenant_id, CASE WHEN s_suppkey % 3 = 0 THEN 'owner' ELSE 'member' END AS role FROM supplier",
}
_NOW = "1996-06-01 00:00:00"


def _with(*names: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({_VIEWS[n]})" for n in names) + "\n"


def _view(spark: SparkSession, d: str, name: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{d}/{t}.parquet") for t in ("nation", "customer", "supplier", "orders")}
    text = _VIEWS[name]
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(text, **{t: df for t, df in tables.items() if f"{{{t}}}" in text})


def _now():
    return F.lit(_NOW).cast("timestamp")


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@_query(_with("tenants", "connections") + "SELECT c.tenant_id, c.repo_name FROM connections c JOIN tenants t ON t.id = c.tenant_id WHERE c.index_daily AND t.status = 'active'")
def scheduled_connections(spark, d):
    return C.scheduled_connections(_view(spark, d, "connections"), _view(spark, d, "tenants"))


@_query(_with("tenants", "connections") + """, pushes AS (SELECT DISTINCT upper(external_repo) AS full_name, 'refs/heads/main' AS ref, 'main' AS default_branch FROM connections UNION ALL SELECT DISTINCT lower(external_repo), 'refs/heads/dev', 'main' FROM connections)
SELECT p.full_name, p.ref, c.tenant_id, c.repo_name FROM pushes p JOIN connections c ON lower(c.external_repo) = lower(p.full_name) AND c.index_on_push JOIN tenants t ON t.id = c.tenant_id AND t.status = 'active'
WHERE p.ref = 'refs/heads/' || CASE WHEN coalesce(c.branch, '') <> '' THEN c.branch ELSE p.default_branch END""")
def push_routing(spark, d):
    connections = _view(spark, d, "connections")
    names = connections.select("external_repo").distinct()
    pushes = names.select(F.upper("external_repo").alias("full_name"), F.lit("refs/heads/main").alias("ref"), F.lit("main").alias("default_branch"))
    pushes = pushes.unionByName(names.select(F.lower("external_repo").alias("full_name"), F.lit("refs/heads/dev").alias("ref"), F.lit("main").alias("default_branch")))
    return C.on_branch(C.push_candidates(pushes, connections, _view(spark, d, "tenants"))).select("full_name", "ref", "tenant_id", "repo_name")


@_query(_with("tenants", "connections", "tokens", "runs") + """SELECT r.id, r.tenant_id, r.repo_name, t.slug, c.external_repo, c.branch, k.token_ciphertext FROM runs r JOIN connections c ON c.tenant_id = r.tenant_id AND c.repo_name = r.repo_name
JOIN tenants t ON t.id = r.tenant_id AND t.status = 'active' LEFT JOIN tokens k ON k.id = c.github_token_id AND k.tenant_id = c.tenant_id WHERE r.status = 'queued'""")
def claim_details(spark, d):
    jobs = _view(spark, d, "runs").filter("status = 'queued'")
    rows = C.claim_details(jobs, _view(spark, d, "connections"), _view(spark, d, "tenants"), _view(spark, d, "tokens"))
    return rows.select("id", "tenant_id", "repo_name", "slug", "external_repo", "branch", "token_ciphertext")


_FREE = f"(status = 'queued' OR (status = 'running' AND started_at < TIMESTAMP '{_NOW}' - INTERVAL 20 MINUTE)) AND id % 2 = 0"


@_query(_with("runs") + f"SELECT id, CASE WHEN {_FREE} THEN 'running' ELSE status END AS status, CASE WHEN {_FREE} THEN attempts + 1 ELSE attempts END AS attempts, {_FREE} AS claimed FROM runs")
def claim_jobs(spark, d):
    jobs = _view(spark, d, "runs")
    return C.claimed(jobs, jobs.filter("id % 2 = 0").select("id"), _now()).select("id", "status", "attempts", "claimed")


@_query(_with("runs") + f"SELECT id FROM runs WHERE status = 'queued' OR (status = 'running' AND started_at < TIMESTAMP '{_NOW}' - INTERVAL 20 MINUTE)")
def claimable_jobs(spark, d):
    return E.claimable(_view(spark, d, "runs"), _now()).select("id")


@_query(_with("runs") + f"SELECT id, CASE WHEN status = 'running' AND started_at < TIMESTAMP '{_NOW}' - INTERVAL 2 HOUR THEN 'failed' ELSE status END AS status FROM runs")
def fail_stale_jobs(spark, d):
    return E.fail_stale(_view(spark, d, "runs"), _now()).select("id", "status")


@_query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 5 DAY")
def retention_rows(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return E.retention(events, "ts", F.lit("2024-01-20 00:00:00").cast("timestamp"), "5 days").select("event_id")


@_query("SELECT event_id, CAST(CASE WHEN f >= 10 THEN least(900 * pow(2, v), 86400) WHEN f > 3 THEN least(pow(2, f - 3), 900) ELSE 0 END AS BIGINT) AS seconds FROM (SELECT event_id, event_id % 16 AS f, event_id % 9 AS v FROM events) x")
def lockout_seconds(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", E.lockout(F.col("event_id") % 16, F.col("event_id") % 9).alias("seconds"))


@_query(_with("connections", "runs") + """, heads AS (SELECT DISTINCT external_repo, 's' || CAST(length(external_repo) % 3 AS STRING) AS sha FROM connections)
SELECT r.id, h.sha FROM runs r JOIN connections c ON c.tenant_id = r.tenant_id AND c.repo_name = r.repo_name JOIN heads h ON h.external_repo = c.external_repo WHERE c.branch IS NULL AND NOT (r.id % 7 <> 0 AND h.sha = c.git_ref AND r.trigger <> 'manual')""")
def unchanged_skip(spark, d):
    connections = _view(spark, d, "connections")
    heads = connections.select("external_repo", F.lit("main").alias("branch"), F.concat(F.lit("s"), (F.length("external_repo") % 3).cast("string")).alias("sha"), F.lit(True).alias("is_default")).distinct()
    claims = _view(spark, d, "runs").select("id", "tenant_id", "repo_name", "trigger", (F.col("id") % 7 != 0).alias("indexed")).join(connections, ["tenant_id", "repo_name"])
    return C.needs_run(claims, heads).select("id", "sha")


@_query(_with("tenants", "connections", "runs") + "SELECT DISTINCT c.tenant_id, c.repo_name, 'schedule' AS trigger FROM connections c JOIN tenants t ON t.id = c.tenant_id WHERE c.index_daily AND t.status = 'active' AND NOT EXISTS (SELECT 1 FROM runs r WHERE r.status = 'queued' AND r.tenant_id = c.tenant_id AND r.repo_name = c.repo_name)")
def daily_fan_out(spark, d):
    return C.daily_run(_view(spark, d, "runs"), _view(spark, d, "connections"), _view(spark, d, "tenants"), _now())[1]


def _members(spark: SparkSession, d: str) -> DataFrame:
    users = _view(spark, d, "members").select(F.col("user_id").alias("id")).distinct().withColumn("login", F.concat(F.lit("u"), F.col("id").cast("string")))
    return C.memberships(users, _view(spark, d, "members"), _view(spark, d, "tenants"))


@_query(_with("tenants", "members") + "SELECT m.user_id, 'u' || m.user_id AS login, m.tenant_id, t.slug, m.role FROM members m JOIN tenants t ON t.id = m.tenant_id AND t.status = 'active'")
def member_list(spark, d):
    return _members(spark, d)


@_query(_with("tenants", "members") + "SELECT user_id, slug, role FROM (SELECT m.user_id, t.slug, m.role, row_number() OVER (PARTITION BY m.user_id ORDER BY CASE m.role WHEN 'owner' THEN 0 ELSE 1 END, m.tenant_id) AS rn FROM members m JOIN tenants t ON t.id = m.tenant_id AND t.status = 'active') x WHERE rn = 1")
def first_tenant(spark, d):
    return C.primary_membership(_members(spark, d))


@_query("SELECT n, CASE WHEN a AND b THEN 'both' WHEN a THEN 'left' ELSE 'right' END AS side FROM (SELECT n, bool_or(s = 1) AS a, bool_or(s = 2) AS b FROM (SELECT p_name AS n, 1 AS s FROM part WHERE p_size < 10 UNION ALL SELECT p_name, 2 FROM part WHERE p_size > 40) x GROUP BY n) y")
def name_sets(spark, d):
    parts = spark.read.parquet(f"{d}/part.parquet").withColumn("n", F.col("p_name"))
    return C.compared(parts.filter("p_size < 10"), parts.filter("p_size > 40"), ["n"])


@_query("SELECT event_id FROM events WHERE event_type = ANY(['click', 'view']) OR event_type IN (SELECT max(event_type) FROM events)")
def any_filter(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    last = events.agg(F.max("event_type")).first()[0]
    return events.filter(C.any_of(F.col("event_type"), ["click", "view", last])).select("event_id")


@_query(_with("connections") + "SELECT tenant_id, repo_name FROM connections WHERE external_repo NOT IN ('Org/BUILDING', 'Org/MACHINERY')")
def excluded_repositories(spark, d):
    return _view(spark, d, "connections").filter(~F.col("external_repo").isin("Org/BUILDING", "Org/MACHINERY")).select("tenant_id", "repo_name")


@_query(_with("runs") + """SELECT id, CASE WHEN id % 3 = 0 THEN CASE WHEN id % 2 = 0 THEN 'succeeded' ELSE 'failed' END ELSE status END AS status, CASE WHEN id % 6 = 0 THEN 'new' ELSE 'old' END AS commit_sha,
CASE WHEN id % 3 = 0 THEN CASE WHEN id % 2 = 0 THEN NULL ELSE repeat('e', 2000) END END AS error FROM runs""")
def finish_jobs(spark, d):
    jobs = _view(spark, d, "runs").withColumn("commit_sha", F.lit("old")).withColumn("stats", F.lit(None).cast("string")).withColumn("finished_at", F.lit(None).cast("timestamp"))
    even = F.col("id") % 2 == 0
    results = jobs.filter("id % 3 = 0").select("id", even.alias("ok"), F.when(even, F.lit("new")).alias("commit_sha"), F.when(even, F.lit("")).otherwise(F.repeat(F.lit("e"), 2500)).alias("error"), F.lit("{}").alias("stats"))
    return C.finished(jobs, results, _now()).select("id", "status", "commit_sha", "error")


@_query(_with("connections", "runs") + "SELECT c.tenant_id, c.repo_name, coalesce(r.sha, c.git_ref) AS git_ref FROM connections c LEFT JOIN (SELECT tenant_id, repo_name, arg_max('c' || id, id) AS sha FROM runs WHERE status = 'succeeded' GROUP BY 1, 2) r ON r.tenant_id = c.tenant_id AND r.repo_name = c.repo_name")
def pinned_commits(spark, d):
    jobs = _view(spark, d, "runs").withColumn("commit_sha", F.concat(F.lit("c"), F.col("id").cast("string"))).withColumn("finished_at", _now())
    return C.pinned(_view(spark, d, "connections"), jobs).select("tenant_id", "repo_name", "git_ref")


@_query("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'x' ELSE c_mktsegment END AS segment FROM customer")
def patch_rows(spark, d):
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    patches = rows.select("id", F.when(F.col("id") % 4 == 2, F.lit("x")).alias("segment"), (F.col("id") % 4 == 0).alias("clear"))
    return C.patched(rows, patches, ["id"], "clear")


@_query("SELECT event_id FROM events WHERE event_id % 5 NOT IN (1, 2, 3)")
def valid_connections(spark, d):
    k = F.col("event_id") % 5
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.when(k == 1, F.lit("a b")).otherwise(F.lit("a.b_c-1")).alias("repo_name"), F.when(k == 2, F.lit("org/..")).otherwise(F.lit("org-1/na.me")).alias("external_repo"), F.when(k == 3, F.lit("Bad")).otherwise(F.lit("0_ok")).alias("slug"))
    return C.valid_rows(events).select("event_id")


@_query("SELECT event_id, event_id % 6 IN (0, 1) AS safe FROM events")
def safe_paths(spark, d):
    path = F.element_at(F.array(*map(F.lit, ["a/b.py", "x", "../x", "a//b", "./a", ""])), (F.col("event_id") % 6 + 1).cast("int"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", safe_relative(path).alias("safe"))


_FOLD = """WITH RECURSIVE h AS (SELECT user_id AS key, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f(key, k, start) AS (SELECT key, k, t FROM h WHERE k = 1 UNION ALL SELECT h.key, h.k, CASE WHEN f.start < h.t - 86400000000 THEN h.t ELSE f.start END FROM f JOIN h ON h.key = f.key AND h.k = f.k + 1)
"""


@_query(_FOLD + "SELECT key, start AS window_start, CAST(count(*) AS INT) AS hits FROM f GROUP BY key, start")
def throttled_touches(spark, d):
    """The uses that are written down when two of a key must be over a day apart."""
    hits = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return E.window_starts(hits, 86_400_000_000)
