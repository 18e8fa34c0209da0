"""The stored job log: requests are queued, claimed, finished, closed when dead, and pruned.

All of it are merges into keyed tables (``sinks.tables``) that return the rows they changed; the rules themselves are the
DataFrame operators of ``operators.control`` and ``operators.events``. Several writers may work at once: of two that claim
one job one gets it, and of two that queue one repository one queues it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import control as C
from .operators import events as E
from .operators.references import Reference
from .plans.staging import staged
from .sinks.store import with_ids
from .sinks.tables import KeyedTables, Table

_OF_TENANT = ("tenant_id",)
TABLES = {
    "tenants": Table("id long, slug string, schema_name string, display_name string, status string, created_at timestamp", ("id",), ("id",)),
    "users": Table("id long, login string, status string, created_at timestamp", ("id",), ("id",)),
    "members": Table("tenant_id long, user_id long, role string", ("tenant_id", "user_id"), _OF_TENANT),
    "access_tokens": Table("id long, tenant_id long, token_hash string, label string, last_used_at timestamp, revoked_at timestamp", ("id",), _OF_TENANT),
    "tokens": Table("id long, tenant_id long, created_by long, label string, token_ciphertext string", ("id",), _OF_TENANT),
    "connections": Table("tenant_id long, repo_name string, external_repo string, branch string, git_ref string, github_token_id long, index_daily boolean, index_on_push boolean, last_indexed_at timestamp", ("tenant_id", "repo_name"), ("tenant_id", "repo_name")),
    "jobs": Table("id long, tenant_id long, repo_name string, trigger string, status string, commit_sha string, attempts int, error string, stats string, created_at timestamp, started_at timestamp, finished_at timestamp", ("id",), ("tenant_id", "repo_name")),
    "outcomes": Table("id string, status int, job_id long", ("id",), ("id",)),
    "sessions": Table("id_hash string, user_id long, last_seen_at timestamp", ("id_hash",), ("id_hash",)),
    "second_factors": Table("user_id long, enabled_at timestamp", ("user_id",), ("user_id",)),
    "backup_codes": Table("id long, user_id long, code_hash string, used_at timestamp", ("id",), ("user_id",)),
}
REFERENCES = [
    Reference("members", ("tenant_id",), "tenants", ("id",)),
    Reference("members", ("user_id",), "users", ("id",)),
    Reference("access_tokens", ("tenant_id",), "tenants", ("id",)),
    Reference("tokens", ("tenant_id",), "tenants", ("id",)),
    Reference("tokens", ("created_by",), "users", ("id",), "clear"),
    Reference("connections", ("tenant_id",), "tenants", ("id",)),
    # The token must be of the connection's own tenant; when it goes, the tenant stays.
    Reference("connections", ("github_token_id", "tenant_id"), "tokens", ("id", "tenant_id"), "clear", ("github_token_id",)),
    Reference("jobs", ("tenant_id", "repo_name"), "connections", ("tenant_id", "repo_name")),
    Reference("sessions", ("user_id",), "users", ("id",)),
    Reference("second_factors", ("user_id",), "users", ("id",)),
    Reference("backup_codes", ("user_id",), "users", ("id",)),
]
GONE = "connection or tenant is gone"
JOB = [c.split()[0] for c in TABLES["jobs"].schema.split(", ")]


def new_jobs(jobs: DataFrame, requests: DataFrame, first_id: int, now: Column) -> DataFrame:
    """Rows of the job table for the requests (tenant_id, repo_name, trigger) that queue one, numbered from ``first_id`` in
    order of tenant and repository."""
    numbered = with_ids(C.enqueued(jobs, requests), first_id - 1, ["tenant_id", "repo_name"])
    rest = dict.fromkeys(JOB) | {"status": "queued", "attempts": 0, "created_at": now}
    return numbered.select(*(c if c in numbered.columns else F.lit(v).alias(c) for c, v in rest.items()))


class JobLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.store = KeyedTables(spark, root, TABLES, REFERENCES)

    def table(self, name: str = "jobs") -> DataFrame:
        return self.store.read(name)

    def enqueue(self, requests: DataFrame, now: Column) -> DataFrame:
        """The jobs queued: one for each repository in ``requests`` that has none queued."""
        count = requests.select("tenant_id", "repo_name").distinct().count()
        first = self.store.reserve("jobs", count)
        return self.store.update(lambda t: {"jobs": (new_jobs(t["jobs"], requests, first, now), None)})["jobs"][0]

    def claim(self, wanted: DataFrame, now: Column) -> DataFrame:
        """Jobs in ``wanted`` (id) that now run, with all that is needed to run them. A job whose connection or active
        tenant is gone is closed as failed and not among them."""

        def change(t: dict[str, DataFrame]) -> dict:
            taken = C.claimed(t["jobs"], wanted, now).filter("claimed").drop("claimed")
            able = C.claim_details(taken.select("id", "tenant_id", "repo_name"), t["connections"], t["tenants"], t["tokens"]).select("id", F.lit(True).alias("able"))
            dead = F.col("able").isNull()
            closed = {"status": F.when(dead, "failed").otherwise(F.col("status")), "error": F.when(dead, GONE), "finished_at": F.when(dead, now).otherwise(F.col("finished_at"))}
            return {"jobs": (taken.join(able, "id", "left").withColumns(closed).select(*JOB), None)}

        mine = self.store.update(change)["jobs"][0].filter("status = 'running'")
        return C.claim_details(mine, self.table("connections"), self.table("tenants"), self.table("tokens"))

    def finish(self, results: DataFrame, now: Column) -> DataFrame:
        """Jobs after their ``results`` (id, ok, commit_sha, error, stats); a success with a commit pins its connection to it
        in the same commit."""

        def change(t: dict[str, DataFrame]) -> dict:
            own = t["jobs"].join(results.select("id"), "id", "left_semi").select(*JOB)
            good = results.filter("ok and commit_sha is not null").select("id", F.col("commit_sha").alias("sha"))
            pins = own.join(good, "id").groupBy("tenant_id", "repo_name").agg(F.max_by("sha", "id").alias("sha"))
            pinned = t["connections"].join(pins, ["tenant_id", "repo_name"]).withColumns({"git_ref": F.col("sha"), "last_indexed_at": now})
            return {"jobs": (C.finished(own, results, now), None), "connections": (pinned.drop("sha"), None)}

        return self.store.update(change)["jobs"][0]

    def fail_stale(self, now: Column) -> DataFrame:
        """Running jobs that have been silent for two hours, now failed."""

        def change(t: dict[str, DataFrame]) -> dict:
            return {"jobs": (E.fail_stale(t["jobs"].filter(E.dead(now)), now), None)}

        return self.store.update(change)["jobs"][0]

    def prune(self, table: str, column: str, now: Column, keep: str) -> DataFrame:
        """Takes out rows of a table that are older than ``keep``."""
        return self.store.delete(table, F.col(column) < now - F.expr(f"INTERVAL '{keep}'"))[table]

    def delete(self, table: str, where: Column) -> dict[str, DataFrame]:
        """Takes out rows of a table and what refers to them; what went, by table."""
        return self.store.delete(table, where)

    def connect(self, tenant_id: int, triples: list[tuple[str, str, str | None]], repos: set[str]) -> DataFrame:
        """Connections (repo_name, owner/name, commit or None) of a tenant's repositories, ``repos``: new ones are indexed
        daily and on push, known ones get their new place and commit and stay as they are else. Any that isn't valid, or
        names none of ``repos``, refuses them all."""
        absent = sorted({t[0] for t in triples} - repos)
        if absent:
            raise ValueError(f"connections to repositories that aren't in the graph: {absent}")
        rows = self.spark.createDataFrame([(tenant_id, *t) for t in triples], "tenant_id long, repo_name string, external_repo string, git_ref string")
        valid = C.valid_rows(rows.withColumn("slug", F.lit("x"))).count()
        if valid != len(triples):
            raise ValueError(f"{len(triples) - valid} connections have no valid name")

        def change(t: dict[str, DataFrame]) -> dict:
            known = t["connections"].drop("external_repo", "git_ref").withColumn("known", F.lit(True))
            merged = rows.join(known, ["tenant_id", "repo_name"], "left")
            new = F.col("known").isNull()
            return {"connections": (merged.withColumns({c: F.when(new, F.lit(True)).otherwise(F.col(c)) for c in ("index_daily", "index_on_push")}).drop("known"), None)}

        return self.store.update(change)["connections"][0]

    # -- the three ways in -------------------------------------------------
    def on_schedule(self, now: Column) -> dict[str, DataFrame]:
        """The daily run: dead jobs are closed, then each daily connection is queued; ``failed`` and ``queued`` jobs."""
        failed = self.fail_stale(now)
        wanted = C.scheduled_connections(self.table("connections"), self.table("tenants"))
        return {"failed": failed, "queued": self.enqueue(wanted.withColumn("trigger", F.lit("schedule")), now)}

    def on_push(self, deliveries: DataFrame, master: str, now: Column) -> DataFrame:
        """(id, status, queued) of signed deliveries (``control.delivery_outcomes``), queueing what they ask for."""
        connections, tenants = self.table("connections"), self.table("tenants")
        self.enqueue(C.verified_pushes(deliveries, connections, tenants, master), now)
        return C.delivery_outcomes(deliveries, connections, tenants, master)

    def on_app(self, requests: DataFrame, master: str, now: Column, clock: int) -> DataFrame:
        """(id, status, job_id) of requests to index at once (id, body, stamp, signature): 401 where the signature is wrong
        or old, 400 where the body isn't {tenant_id, repo_name}, 404 without such a connection, 200 where a run waits
        already, 202 and the job where one was queued; of several for one repository the first by id queues it. Outcomes
        are kept, and a request that has one is answered by it."""
        requests = requests.withColumn("id", F.col("id").cast("string"))
        judged = C.app_requests(requests.join(self.table("outcomes").select("id"), "id", "left_anti"), self.table("connections"), self.table("tenants"), master, clock)
        judged = staged(judged, "requests")
        wanted = judged.filter("status = 202").select("tenant_id", "repo_name", F.lit("manual").alias("trigger"))
        first = self.store.reserve("jobs", wanted.distinct().count())

        def change(t: dict[str, DataFrame]) -> dict:
            made = new_jobs(t["jobs"], wanted, first, now)
            return {"jobs": (made, None), "outcomes": (C.app_outcomes(judged, made), None)}

        self.store.update(change)
        return self.table("outcomes").join(requests.select("id"), "id", "left_semi")
