"""Registered queries over stored tables: the job log with its transitions and references, deliveries, the graph store, and
the folds of job events and failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from .catalog_control import _NOW, Query, _now, _view, _with
from .jobs import REFERENCES, JobLog
from .jobs import TABLES as CONTROL
from .operators import control as C
from .operators import events as E
from .operators import references as R
from .plans.staging import new_folder
from .sinks.store import GraphStore
from .sources.adapters import cte, table
from .streaming import deliveries as D
from .streaming import jobs as J
from .streaming import limits as L

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _control(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The control plane's tables: tenants of nations, connections of customers, jobs of orders, tokens and members of
    suppliers, users of the members, codes of parts."""
    null = lambda kind: F.lit(None).cast(kind)
    members = _view(spark, d, "members").groupBy("tenant_id", "user_id").agg(F.max("role").alias("role"))
    users = members.select(F.col("user_id").alias("id")).distinct()
    codes = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 50).alias("user_id"), F.col("p_name").alias("code_hash"), F.when(F.col("p_size") > 25, _now()).alias("used_at"))
    jobs = _view(spark, d, "runs").withColumns({"commit_sha": null("string"), "stats": null("string"), "created_at": F.col("started_at"), "finished_at": null("timestamp")})
    return {
        "tenants": _view(spark, d, "tenants").withColumns({"display_name": F.col("slug"), "created_at": _now()}),
        "users": users.withColumns({"login": F.concat(F.lit("u"), F.col("id").cast("string")), "status": F.lit("active"), "created_at": _now()}),
        "members": members,
        "access_tokens": _view(spark, d, "tokens").select("id", "tenant_id", F.col("token_ciphertext").alias("token_hash"), F.lit("").alias("label"), null("timestamp").alias("last_used_at"), null("timestamp").alias("revoked_at")),
        "tokens": _view(spark, d, "tokens").select("id", "tenant_id", (F.col("id") % 40).alias("created_by"), F.lit("t").alias("label"), "token_ciphertext"),
        "connections": _view(spark, d, "connections").withColumn("last_indexed_at", null("timestamp")),
        "jobs": jobs,
        "second_factors": users.select(F.col("id").alias("user_id"), F.when(F.col("id") % 2 == 0, _now()).alias("enabled_at")),
        "backup_codes": codes,
    }


def _log(spark: SparkSession, d: str, *names: str) -> JobLog:
    """A stored job log with these tables in it."""
    log, tables = JobLog(spark, new_folder(spark, "job-log")), _control(spark, d)
    log.store.update(lambda _: {n: (tables[n], None) for n in names})
    if "jobs" in names:
        log.store.set_last("jobs", log.table().agg(F.max("id")).first()[0] or 0)
    return log


_JOB = "id, tenant_id, repo_name, trigger, status, commit_sha, attempts, error, stats, created_at, started_at, finished_at"
_STORED = _with("tenants", "connections", "tokens", "runs").rstrip() + ", stored AS (SELECT id, tenant_id, repo_name, trigger, status, CAST(NULL AS VARCHAR) AS commit_sha, CAST(attempts AS INTEGER) AS attempts, error, CAST(NULL AS VARCHAR) AS stats, CAST(started_at AS TIMESTAMP) AS created_at, CAST(started_at AS TIMESTAMP) AS started_at, CAST(NULL AS TIMESTAMP) AS finished_at FROM runs)"


def _times(df: DataFrame) -> DataFrame:
    """Times without a zone, as the other engine has them."""
    return df.select(*(F.col(f.name).cast("timestamp_ntz").alias(f.name) if f.dataType.typeName() == "timestamp" else F.col(f.name) for f in df.schema))


@_query(_STORED + f""" SELECT {_JOB} FROM stored UNION ALL
SELECT (SELECT max(id) FROM stored) + row_number() OVER (ORDER BY c.tenant_id, c.repo_name), c.tenant_id, c.repo_name, 'manual', 'queued', NULL, 0, NULL, NULL, TIMESTAMP '{_NOW}', NULL, NULL FROM connections c
WHERE c.index_on_push AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.status = 'queued' AND s.tenant_id = c.tenant_id AND s.repo_name = c.repo_name)""")
def job_enqueue(spark, d):
    """The job table after a request, made twice, for every connection that indexes on push."""
    log = _log(spark, d, "connections", "jobs")
    wanted = log.table("connections").filter("index_on_push").select("tenant_id", "repo_name", F.lit("manual").alias("trigger"))
    log.enqueue(wanted.unionByName(wanted), _now())
    return _times(log.table())


_TAKEN = f"id % 2 = 0 AND (status = 'queued' OR (status = 'running' AND started_at < TIMESTAMP '{_NOW}' - INTERVAL 20 MINUTE))"


@_query(_STORED + f""", taken AS (SELECT *, EXISTS (SELECT 1 FROM connections c JOIN tenants t ON t.id = c.tenant_id AND t.status = 'active' WHERE c.tenant_id = s.tenant_id AND c.repo_name = s.repo_name) AS able FROM stored s WHERE {_TAKEN})
SELECT {_JOB} FROM stored WHERE id NOT IN (SELECT id FROM taken) UNION ALL
SELECT id, tenant_id, repo_name, trigger, CASE WHEN able THEN 'running' ELSE 'failed' END, commit_sha, attempts + 1, CASE WHEN NOT able THEN 'connection or tenant is gone' END, stats, created_at, TIMESTAMP '{_NOW}', CASE WHEN NOT able THEN TIMESTAMP '{_NOW}' END FROM taken""")
def job_claim(spark, d):
    """The job table after a claim of the even jobs, made twice: the second takes none."""
    log = _log(spark, d, "tenants", "connections", "tokens", "jobs")
    for _ in range(2):
        log.claim(log.table().filter("id % 2 = 0").select("id"), _now())
    return _times(log.table())


@_query(_STORED + f""" SELECT id, tenant_id, repo_name, trigger, CASE WHEN id % 3 <> 0 THEN status WHEN id % 2 = 0 THEN 'succeeded' ELSE 'failed' END AS status, CASE WHEN id % 6 = 0 THEN 'c' || id END AS commit_sha, attempts,
CASE WHEN id % 3 <> 0 THEN error WHEN id % 2 = 1 THEN repeat('e', 2000) END AS error, CASE WHEN id % 3 = 0 THEN '{{}}' END AS stats, created_at, started_at, CASE WHEN id % 3 = 0 THEN TIMESTAMP '{_NOW}' END AS finished_at FROM stored""")
def job_finish(spark, d):
    """The job table after results for a third of the jobs."""
    return _times(_finished(spark, d).table())


@_query(_STORED + f""", last AS (SELECT tenant_id, repo_name, max(id) AS id FROM stored WHERE id % 6 = 0 GROUP BY 1, 2)
SELECT c.tenant_id, c.repo_name, c.external_repo, c.branch, coalesce('c' || l.id, c.git_ref) AS git_ref, c.github_token_id, c.index_daily, c.index_on_push, CASE WHEN l.id IS NOT NULL THEN TIMESTAMP '{_NOW}' END AS last_indexed_at
FROM connections c LEFT JOIN last l ON l.tenant_id = c.tenant_id AND l.repo_name = c.repo_name""")
def job_finish_pins(spark, d):
    """The connections after the same: pinned to the commit of their last success."""
    return _times(_finished(spark, d).table("connections"))


def _finished(spark: SparkSession, d: str) -> JobLog:
    log, even = _log(spark, d, "connections", "jobs"), F.col("id") % 2 == 0
    log.finish(log.table().filter("id % 3 = 0").select("id", even.alias("ok"), F.when(even, F.concat(F.lit("c"), F.col("id").cast("string"))).alias("commit_sha"), F.when(~even, F.repeat(F.lit("e"), 2500)).alias("error"), F.lit("{}").alias("stats")), _now())
    return log


_DEAD = f"(status = 'running' AND started_at < TIMESTAMP '{_NOW}' - INTERVAL 2 HOUR)"


@_query(_STORED + f" SELECT id, tenant_id, repo_name, trigger, CASE WHEN {_DEAD} THEN 'failed' ELSE status END AS status, commit_sha, attempts, CASE WHEN {_DEAD} THEN '{E.STALE_ERROR}' ELSE error END AS error, stats, created_at, started_at, CASE WHEN {_DEAD} THEN TIMESTAMP '{_NOW}' END AS finished_at FROM stored")
def job_fail_stale(spark, d):
    log = _log(spark, d, "jobs")
    log.fail_stale(_now())
    return _times(log.table())


@_query(_STORED + f" SELECT {_JOB} FROM stored WHERE NOT started_at < TIMESTAMP '{_NOW}' - INTERVAL 365 DAY")
def job_prune(spark, d):
    log = _log(spark, d, "jobs")
    log.prune("jobs", "started_at", _now(), "365 days")
    return _times(log.table())


@_query(_with("tenants", "connections", "tokens", "runs", "members").rstrip() + """, t AS (SELECT id FROM tenants WHERE id % 5 <> 0)
SELECT 'tenants' AS table_name, CAST(id AS VARCHAR) AS k FROM t
UNION ALL SELECT DISTINCT 'members', tenant_id || '/' || user_id FROM members WHERE tenant_id IN (SELECT id FROM t)
UNION ALL SELECT 'tokens', CAST(id AS VARCHAR) FROM tokens WHERE tenant_id IN (SELECT id FROM t)
UNION ALL SELECT 'access_tokens', CAST(id AS VARCHAR) FROM tokens WHERE tenant_id IN (SELECT id FROM t)
UNION ALL SELECT 'connections', tenant_id || '/' || repo_name FROM connections WHERE tenant_id IN (SELECT id FROM t)
UNION ALL SELECT 'jobs', CAST(r.id AS VARCHAR) FROM runs r WHERE tenant_id IN (SELECT id FROM t)
UNION ALL SELECT DISTINCT 'users', CAST(user_id AS VARCHAR) FROM members""")
def tenant_delete(spark, d):
    """What is left in the stored tables after a fifth of the tenants are deleted."""
    names = ["tenants", "users", "members", "tokens", "access_tokens", "connections", "jobs"]
    log, out = _log(spark, d, *names), None
    log.delete("tenants", F.col("id") % 5 == 0)
    for n in names:
        rows = log.table(n).select(F.lit(n).alias("table_name"), F.concat_ws("/", *(F.col(c).cast("string") for c in CONTROL[n].key)).alias("k"))
        out = rows if out is None else out.unionByName(rows)
    return out


@_query(_with("connections", "tokens").rstrip() + """ SELECT c.tenant_id, c.repo_name, CASE WHEN k.id IS NULL THEN c.github_token_id END AS github_token_id FROM connections c LEFT JOIN tokens k ON k.id = c.github_token_id AND k.tenant_id = c.tenant_id AND k.id % 3 = 0""")
def token_delete(spark, d):
    """Connections after a third of the tokens are deleted: only the token's column of those that referred to one, by token
    and tenant, is null."""
    log = _log(spark, d, "tokens", "connections")
    log.delete("tokens", F.col("id") % 3 == 0)
    return log.table("connections").select("tenant_id", "repo_name", "github_token_id")


@_query(_with("tenants", "connections", "tokens", "members", "runs").rstrip() + """ SELECT 'connections' AS child, 'tokens' AS parent, c.tenant_id, c.github_token_id AS other FROM connections c WHERE NOT EXISTS (SELECT 1 FROM tokens k WHERE k.id = c.github_token_id AND k.tenant_id = c.tenant_id)
UNION ALL SELECT 'backup_codes', 'users', NULL, p_partkey % 50 FROM part WHERE p_partkey % 50 NOT IN (SELECT user_id FROM members)""")
def reference_orphans(spark, d):
    """Rows that refer to what isn't there, over all declared references."""
    tables = _control(spark, d)
    found = R.orphans(tables | {"sessions": spark.createDataFrame([], CONTROL["sessions"].schema)}, REFERENCES)
    # Fields by name, as the order of a reference's columns is its own.
    told = F.from_json("row", "tenant_id long, github_token_id long, user_id long")
    return found.withColumn("x", told).select("child", "parent", F.col("x.tenant_id").alias("tenant_id"), F.coalesce("x.github_token_id", "x.user_id").alias("other"))


@_query(f"""WITH codes AS (SELECT p_partkey % 50 AS user_id, p_size <= 25 AS free FROM part), factors AS (SELECT DISTINCT s_suppkey % 40 AS user_id FROM supplier)
SELECT f.user_id, f.user_id % 2 = 0 AS enabled, (SELECT count(*) FROM codes b WHERE b.user_id = f.user_id AND b.free) AS "left" FROM factors f""")
def unused_backup_codes(spark, d):
    tables = _control(spark, d)
    return C.unused_codes(tables["second_factors"], tables["backup_codes"])


_MESSAGES = """m AS (SELECT CAST(event_id AS VARCHAR) AS id, event_type AS body, CASE event_id % 5 WHEN 0 THEN 'done' WHEN 1 THEN 'dead' ELSE 'waiting' END AS status, CAST(event_id % 3 AS INTEGER) AS attempts,
  CASE WHEN event_id % 4 > 0 THEN CAST(ts AS TIMESTAMP) END AS visible_at, CASE WHEN event_id % 7 = 0 THEN 'e' END AS error FROM events)"""
_SEEN = "2024-01-15 00:00:00"


def _messages(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    return spark.read.parquet(f"{d}/events.parquet").select(k.cast("string").alias("id"), F.col("event_type").alias("body"), F.when(k % 5 == 0, "done").when(k % 5 == 1, "dead").otherwise("waiting").alias("status"), (k % 3).cast("int").alias("attempts"), F.when(k % 4 > 0, F.col("ts").cast("timestamp")).alias("visible_at"), F.when(k % 7 == 0, "e").alias("error"))


@_query(f"""WITH {_MESSAGES} SELECT id, body, CASE WHEN attempts >= 2 THEN 'dead' ELSE 'waiting' END AS status, CASE WHEN attempts >= 2 THEN attempts ELSE attempts + 1 END AS attempts,
CASE WHEN attempts >= 2 THEN visible_at ELSE TIMESTAMP '{_SEEN}' + INTERVAL 960 SECOND END AS visible_at, CASE WHEN attempts >= 2 THEN coalesce(error, '{D.LEFT}') ELSE error END AS error
FROM m WHERE status = 'waiting' AND (visible_at IS NULL OR visible_at <= TIMESTAMP '{_SEEN}')""")
def delivery_receive(spark, d):
    """Messages of a ledger as they are received: hidden with one more attempt, or dead."""
    return _times(D.received(_messages(spark, d), F.lit(_SEEN).cast("timestamp")))


@_query(f"""WITH {_MESSAGES}, o AS (SELECT id, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 'broken' END AS error FROM m WHERE CAST(id AS BIGINT) % 3 > 0)
SELECT m.id, body, CASE WHEN o.error IS NULL THEN 'done' WHEN attempts >= 2 THEN 'dead' ELSE 'waiting' END AS status, attempts, visible_at, o.error FROM m JOIN o ON o.id = m.id WHERE status = 'waiting'""")
def delivery_settle(spark, d):
    rows, k = _messages(spark, d), F.col("id").cast("long")
    return _times(D.settled(rows, rows.filter(k % 3 > 0).select("id", F.when(k % 2 == 0, "broken").alias("error"))))


# -- the graph store -------------------------------------------------------
def _supply(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The five tables of the supply graph."""
    nodes = table(spark, d, "s_nodes")
    files = nodes.filter("kind = 'File'").select("repo", F.col("file_path").alias("path"), F.sha2(F.col("qualified_name").cast("binary"), 256).alias("hash")).distinct()
    repos = nodes.groupBy(F.col("repo").alias("name")).agg(F.count("*").cast("int").alias("node_count")).select("name", F.col("name").alias("path"), F.lit("").alias("indexed_at"), "node_count", F.lit(0).alias("edge_count"), F.lit(0).alias("file_count"))
    return {"repos": repos, "nodes": nodes, "edges": table(spark, d, "s_raw"), "files": files, "imports": table(spark, d, "s_imports")}


_FILES = "SELECT DISTINCT repo, file_path AS path, sha256(qualified_name) AS hash FROM s_nodes WHERE kind = 'File'"


@_query(f"""{cte("s_nodes", "s_raw", "s_imports")} SELECT 'repos' AS table_name, count(DISTINCT repo) AS n FROM s_nodes UNION ALL SELECT 'nodes', count(*) FROM s_nodes UNION ALL SELECT 'edges', count(*) FROM s_raw
UNION ALL SELECT 'files', count(*) FROM ({_FILES}) f UNION ALL SELECT 'imports', count(*) FROM s_imports""")
def parity_counts(spark, d):
    """Rows of all five tables that a load into a store wrote, which are those that it read."""
    told = GraphStore(spark, new_folder(spark, "loaded")).load(_supply(spark, d))
    return spark.createDataFrame(sorted(told.items()), "table_name string, n long")


@_query(f"""{cte("s_nodes")} SELECT repo, path, CASE WHEN path LIKE '%1.py' THEN 'second' ELSE hash END AS hash FROM ({_FILES}) f WHERE path NOT LIKE '%2.py'
UNION ALL SELECT DISTINCT repo, 'new/' || file_path, 'appended' FROM s_nodes WHERE kind = 'File'""")
def store_appends(spark, d):
    """The stored files of every repository after an append, an upsert, deletes by file, and compaction."""
    tables = _supply(spark, d)
    store = GraphStore(spark, new_folder(spark, "appended"))
    store.load(tables)
    for repo in store.repos():  # a handful
        own = tables["files"].filter(F.col("repo") == repo)
        store.append(repo, "files", own.withColumns({"path": F.concat(F.lit("new/"), "path"), "hash": F.lit("appended")}))
        store.upsert(repo, "files", own.filter("path like '%1.py'").withColumn("hash", F.lit("second")))
        store.delete_files(repo, own.filter("path like '%2.py'"))
        store.append(repo, "files", own.limit(0))
        store.compact(repo, "files")
    return store.read("files")


# -- folds -----------------------------------------------------------------
_JOB_LOG = f"""WITH RECURSIVE e AS (
  SELECT user_id AS u, CASE event_id % 6 WHEN 1 THEN 'claim' WHEN 2 THEN 'succeeded' WHEN 4 THEN 'failed' WHEN 5 THEN 'sweep' ELSE 'request' END AS kind, event_type AS why,
         CAST(floor(epoch(ts)) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS k FROM events),
f(u, k, job, queued, running, started, who, tries, fj, fw, fa, ft, oj, os, ow, oa, ot) AS (
  SELECT DISTINCT u, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), 0, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), 0, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 0, CAST(0 AS BIGINT) FROM e
  UNION ALL
  SELECT u, k, CASE WHEN asks THEN job + 1 ELSE job END, CASE WHEN asks THEN why WHEN takes THEN NULL ELSE queued END, CASE WHEN takes THEN job WHEN ends THEN NULL ELSE running END,
         CASE WHEN takes OR again THEN t WHEN ends THEN NULL ELSE started END, CASE WHEN takes THEN queued WHEN ends THEN NULL ELSE who END, CASE WHEN takes THEN 1 WHEN again THEN tries + 1 WHEN ends THEN 0 ELSE tries END,
         fj, fw, fa, ft, CASE WHEN asks THEN job + 1 WHEN again OR ends THEN running WHEN takes THEN job END, CASE WHEN asks THEN 'queued' WHEN again OR takes THEN 'running' WHEN ends THEN kind END,
         CASE WHEN asks THEN why WHEN takes THEN queued ELSE who END, CASE WHEN asks THEN 0 WHEN again THEN tries + 1 WHEN takes THEN 1 ELSE tries END, t
  FROM (SELECT *, kind = 'request' AND queued IS NULL AS asks, kind = 'claim' AND running IS NOT NULL AND started < t - {J.CLAIM_AFTER} AS again,
               kind = 'claim' AND running IS NULL AND queued IS NOT NULL AS takes, kind IN ('succeeded', 'failed') AND running IS NOT NULL AS ends
        FROM (SELECT u, k, kind, why, t, job, queued, CASE WHEN NOT dead THEN running END AS running, CASE WHEN NOT dead THEN started END AS started, CASE WHEN NOT dead THEN who END AS who, CASE WHEN dead THEN 0 ELSE tries END AS tries,
                     CASE WHEN dead THEN running END AS fj, who AS fw, tries AS fa, started + {J.DEAD_AFTER + 1} AS ft
              FROM (SELECT e.u, e.k, e.kind, e.why, e.t, f.job, f.queued, f.running, f.started, f.who, f.tries, f.running IS NOT NULL AND f.started + {J.DEAD_AFTER} < e.t AS dead FROM f JOIN e ON e.u = f.u AND e.k = f.k + 1) x) y) z),
ends AS (SELECT f.* FROM f JOIN (SELECT u, max(k) AS k FROM f GROUP BY u) m ON m.u = f.u AND m.k = f.k WHERE running IS NOT NULL AND started + {J.DEAD_AFTER} < (SELECT max(t) FROM e)),
told AS (SELECT u, fj AS job, 'failed' AS status, fw AS trigger, fa AS attempts, ft AS spot FROM f WHERE fj IS NOT NULL UNION ALL SELECT u, oj, os, ow, oa, ot FROM f WHERE oj IS NOT NULL
         UNION ALL SELECT u, running, 'failed', who, tries, started + {J.DEAD_AFTER + 1} FROM ends)
SELECT u % 5 AS tenant_id, 'r' || u AS repo_name, job, status, trigger, attempts, spot AS at FROM told"""


@_query(_JOB_LOG)
def job_log(spark, d):
    """Transitions of jobs from a replayed log, timers and all."""
    kinds = F.array(*map(F.lit, ["request", "claim", "succeeded", "request", "failed", "sweep"]))
    events = spark.read.parquet(f"{d}/events.parquet")
    rows = events.select((F.col("user_id") % 5).cast("long").alias("tenant_id"), F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("repo_name"), F.element_at(kinds, (F.col("event_id") % 6 + 1).cast("int")).alias("kind"), F.col("event_type").alias("trigger"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"))
    return J.fold(rows)


@_query("""WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS key, CAST(floor(epoch(ts)) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT)) AS k FROM events),
f(key, k, t, start, failures, till, level, told, wait) AS (
  SELECT DISTINCT key, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM e
  UNION ALL
  SELECT key, k, t, CASE WHEN n >= 10 THEN t ELSE start END, CASE WHEN n >= 10 THEN 0 ELSE n END, CASE WHEN wait > 0 THEN greatest(till, t + wait) ELSE till END, CASE WHEN n >= 10 THEN level + 1 ELSE level END, n, wait
  FROM (SELECT *, CAST(CASE WHEN n >= 10 THEN least(900 * pow(2, least(level, 20)), 86400) WHEN n > 3 THEN least(pow(2, n - 3), 900) ELSE 0 END AS BIGINT) AS wait
        FROM (SELECT key, k, t, CASE WHEN anew THEN t ELSE start END AS start, CASE WHEN anew THEN 1 ELSE failures + 1 END AS n, till, level
              FROM (SELECT e.key, e.k, e.t, f.start, f.failures, f.till, f.level, f.start IS NULL OR (f.start < e.t - 86400 AND f.till < e.t) AS anew FROM f JOIN e ON e.key = f.key AND e.k = f.k + 1) x) y) z)
SELECT key, t AS at, told AS failures, wait AS locked_for, till AS locked_until FROM f WHERE k > 0""")
def failure_locks(spark, d):
    """Locks that failures set."""
    events = spark.read.parquet(f"{d}/events.parquet")
    return L.failure_locks(events.select(F.col("user_id").cast("string").alias("key"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at")), 86_400, 10, 900)


