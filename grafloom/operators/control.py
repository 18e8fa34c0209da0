"""Control-plane operators: connections and tenants, claims, signatures, the daily run, members."""

from __future__ import annotations

import hashlib
import hmac

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import TENANT_SLUG, valid_repo_name
from .events import fail_stale, retention

# Labels that signatures are derived with, how old a signed request may be, the text of a dead job.
WEBHOOK_LABEL, APP_LABEL, HEADER = "webhook", "enqueue", "sha256="
MAX_SKEW_SECONDS = 300
MAX_ERROR_CHARS = 2000
OWNER_NAME = r"^[A-Za-z0-9-]+/[A-Za-z0-9._-]+$"
REQUESTS = "tenant_id long, repo_name string, trigger string"


def active_connections(connections: DataFrame, tenants: DataFrame) -> DataFrame:
    """Connections whose tenant is active."""
    active = tenants.filter("status = 'active'").select(F.col("id").alias("tenant_id"))
    return connections.join(active, "tenant_id", "left_semi")


def scheduled_connections(connections: DataFrame, tenants: DataFrame) -> DataFrame:
    """What the daily run refreshes."""
    return active_connections(connections, tenants).filter("index_daily").select("tenant_id", "repo_name").orderBy("tenant_id", "repo_name")


def push_candidates(pushes: DataFrame, connections: DataFrame, tenants: DataFrame) -> DataFrame:
    """Connections of active tenants that a push concerns, by repository in any case, with the push's own columns."""
    wanted = active_connections(connections, tenants).filter("index_on_push").select("tenant_id", "repo_name", "branch", F.lower("external_repo").alias("pushed"))
    return pushes.withColumn("pushed", F.lower("full_name")).join(wanted, "pushed").drop("pushed")


def on_branch(candidates: DataFrame) -> DataFrame:
    """Candidates whose push is to the branch that is indexed, the repository's default where none is named."""
    named = F.when(F.coalesce("branch", F.lit("")) != "", F.col("branch")).otherwise(F.coalesce("default_branch", F.lit("")))
    return candidates.filter(F.col("ref") == F.concat(F.lit("refs/heads/"), named))


def claim_details(jobs: DataFrame, connections: DataFrame, tenants: DataFrame, tokens: DataFrame) -> DataFrame:
    """Jobs with all that is needed to run them: an inner join with connection and active tenant, an outer one with the
    token of that tenant. A job without a connection or active tenant gives no row."""
    tenant = tenants.filter("status = 'active'").select(F.col("id").alias("tenant_id"), "slug", "schema_name")
    token = tokens.select(F.col("id").alias("github_token_id"), "tenant_id", "token_ciphertext")
    own = connections.select("tenant_id", "repo_name", "external_repo", "branch", "git_ref", "github_token_id")
    return jobs.join(own, ["tenant_id", "repo_name"]).join(tenant, "tenant_id").join(token, ["github_token_id", "tenant_id"], "left")


def claimed(jobs: DataFrame, wanted: DataFrame, now: Column, stale: str = "20 minutes") -> DataFrame:
    """The job table after the jobs in ``wanted`` (id) were claimed: those queued, or running for longer than
    ``stale``, run from now with one more attempt and no error; any other stays as it is."""
    ask = wanted.select("id").distinct().withColumn("asked", F.lit(True))
    free = F.col("asked").isNotNull() & ((F.col("status") == "queued") | ((F.col("status") == "running") & (F.col("started_at") < now - F.expr(f"INTERVAL '{stale}'"))))
    free = F.coalesce(free, F.lit(False))
    changed = {"attempts": F.when(free, F.col("attempts") + 1).otherwise(F.col("attempts")), "error": F.when(~free, F.col("error")), "started_at": F.when(free, now).otherwise(F.col("started_at")), "status": F.when(free, F.lit("running")).otherwise(F.col("status"))}
    return jobs.join(ask, "id", "left").withColumns(changed | {"claimed": free}).select(*jobs.columns, "claimed")


def finished(jobs: DataFrame, results: DataFrame, now: Column, most: int = MAX_ERROR_CHARS) -> DataFrame:
    """The job table after ``results`` (id, ok, commit_sha, error, stats): a result without a commit keeps the one that
    the job has, an error is cut to ``most`` characters, and an empty one counts as none."""
    told = results.select("id", "ok", F.col("commit_sha").alias("new_sha"), F.col("error").alias("new_error"), F.col("stats").alias("new_stats"))
    cut = F.substring("new_error", 1, most)
    done = F.col("ok").isNotNull()
    changed = {
        "status": F.when(done, F.when(F.col("ok"), "succeeded").otherwise("failed")).otherwise(F.col("status")),
        "finished_at": F.when(done, now).otherwise(F.col("finished_at")),
        "commit_sha": F.coalesce("new_sha", "commit_sha"),
        "error": F.when(done, F.when(cut != "", cut)).otherwise(F.col("error")),
        "stats": F.when(done, F.col("new_stats")).otherwise(F.col("stats")),
    }
    return jobs.join(told, "id", "left").withColumns(changed).select(*jobs.columns)


def pinned(connections: DataFrame, jobs: DataFrame) -> DataFrame:
    """Connections at the commit of their last successful job, where that has one."""
    good = jobs.filter("status = 'succeeded' and commit_sha is not null")
    last = good.groupBy("tenant_id", "repo_name").agg(F.max_by("commit_sha", F.struct("finished_at", "id")).alias("indexed_sha"))
    return connections.join(last, ["tenant_id", "repo_name"], "left").withColumn("git_ref", F.coalesce("indexed_sha", "git_ref")).select(*connections.columns)


def patched(rows: DataFrame, patches: DataFrame, keys: list[str], clear: str | None = None) -> DataFrame:
    """Rows with the values of their patch put in: a null keeps what is there. With ``clear`` the patch has a boolean
    column of that name for each key, and where it is true nulls are put in too."""
    fields = [c for c in rows.columns if c not in keys and c in patches.columns]
    new = patches.select(*keys, *(F.col(c).alias(f"new_{c}") for c in fields), *([clear] if clear else []))
    force = F.coalesce(F.col(clear), F.lit(False)) if clear else F.lit(False)
    put = {c: F.when(force, F.col(f"new_{c}")).otherwise(F.coalesce(f"new_{c}", c)) for c in fields}
    return rows.join(new, keys, "left").withColumns(put).select(*rows.columns)


def valid_rows(connections: DataFrame) -> DataFrame:
    """Connections that the table's checks admit: a name of known characters, an ``owner/name`` whose second part isn't
    a folder's own name, and a slug."""
    name = valid_repo_name(F.col("repo_name"))
    second = F.split_part("external_repo", F.lit("/"), F.lit(2))
    outside = F.col("external_repo").rlike(OWNER_NAME) & ~second.isin(".", "..")
    return connections.filter(name & outside & F.col("slug").rlike(TENANT_SLUG))


def needs_run(claims: DataFrame, heads: DataFrame) -> DataFrame:
    """Claims whose branch has moved since the last run: all but those at the commit that was indexed, unless asked
    for by hand. ``heads``: (external_repo, branch, sha); ``indexed`` tells whether the repository has a graph."""
    head = heads.select("external_repo", F.col("branch").alias("head_branch"), "sha", "is_default")
    at = claims.join(head, "external_repo").filter(F.when(F.col("branch").isNotNull(), F.col("branch") == F.col("head_branch")).otherwise(F.col("is_default")))
    same = F.col("indexed") & F.col("sha").eqNullSafe(F.col("git_ref")) & (F.col("trigger") != "manual")
    return at.filter(~same).drop("head_branch", "is_default")


def enqueued(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests that queue a job: one for each (tenant, repository) that has none queued, the first by trigger."""
    waiting = jobs.filter("status = 'queued'").select("tenant_id", "repo_name")
    return requests.groupBy("tenant_id", "repo_name").agg(F.min("trigger").alias("trigger")).join(waiting, ["tenant_id", "repo_name"], "left_anti")


def daily_run(jobs: DataFrame, connections: DataFrame, tenants: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(the job table with dead jobs closed, the jobs to queue): a scheduled request for each daily connection."""
    closed = fail_stale(jobs, now)
    requests = scheduled_connections(connections, tenants).withColumn("trigger", F.lit("schedule"))
    return closed, enqueued(closed, requests)


def pruned(tables: dict[str, DataFrame], columns: dict[str, tuple[str, str]], now: Column) -> dict[str, DataFrame]:
    """Each table without the rows that are older than it keeps them: name -> (column, interval)."""
    return {name: retention(df, *[columns[name][0], now, columns[name][1]]) if name in columns else df for name, df in tables.items()}


def touched(uses: DataFrame, every: str = "1 minute") -> DataFrame:
    """(key, at): the uses that are written down, so that two of a key are at least ``every`` apart from the one
    written before: the first of each anchored window, as ``rate_window_fold`` draws them."""
    from .events import window_starts

    seconds = F.expr(f"INTERVAL '{every}'")
    width = uses.sparkSession.range(1).select((F.unix_micros(F.timestamp_seconds(F.lit(0)) + seconds)).alias("w")).first()["w"]
    return window_starts(uses.select("key", F.unix_micros("at").alias("t")), width).select("key", F.timestamp_micros("window_start").alias("at"))


# -- members ---------------------------------------------------------------
def memberships(users: DataFrame, members: DataFrame, tenants: DataFrame) -> DataFrame:
    """(user_id, login, tenant_id, slug, role) of every member of an active tenant."""
    tenant = tenants.filter("status = 'active'").select(F.col("id").alias("tenant_id"), "slug")
    return members.join(tenant, "tenant_id").join(users.select(F.col("id").alias("user_id"), "login"), "user_id").select("user_id", "login", "tenant_id", "slug", "role")


def primary_membership(rows: DataFrame) -> DataFrame:
    """Of each user's memberships the first: as an owner before others, then by tenant."""
    pick = F.min_by(F.struct("slug", "role"), F.struct(F.when(F.col("role") == "owner", 0).otherwise(1), F.col("tenant_id")))
    return rows.groupBy("user_id").agg(pick.alias("m")).select("user_id", "m.*")


# -- signatures ------------------------------------------------------------
def _hmac(key: str, message: bytes) -> str:
    return hmac.new(key.encode(), message, hashlib.sha256).hexdigest()


def webhook_secret(master: str, tenant_id: int, repo_name: str) -> str:
    return _hmac(master, f"{WEBHOOK_LABEL}:{int(tenant_id)}:{repo_name}".encode())


def push_verified(master: str):
    """A function of (tenant_id, repo_name, body, header): whether the body is signed with that connection's secret."""

    @F.arrow_udf("boolean")
    def run(tenant: pa.Array, repo: pa.Array, body: pa.Array, header: pa.Array) -> pa.Array:
        out = []
        for t, r, b, h in zip(tenant.to_pylist(), repo.to_pylist(), body.to_pylist(), header.to_pylist(), strict=True):
            good = t is not None and r is not None and h is not None and h.startswith(HEADER)
            data = b if isinstance(b, bytes) else (b or "").encode()
            out.append(good and hmac.compare_digest(_hmac(webhook_secret(master, t, r), data), h[len(HEADER) :]))
        return pa.array(out, pa.bool_())

    return run


def app_verified(master: str, now: int):
    """A function of (body, timestamp, signature): whether the master secret signed it within the last five minutes."""

    @F.arrow_udf("boolean")
    def run(body: pa.Array, stamp: pa.Array, signature: pa.Array) -> pa.Array:
        out = []
        for b, t, s in zip(body.to_pylist(), stamp.to_pylist(), signature.to_pylist(), strict=True):
            good = bool(t and s) and t.strip().lstrip("+-").isdigit() and abs(now - int(t)) <= MAX_SKEW_SECONDS
            out.append(good and hmac.compare_digest("v1=" + _hmac(master, f"{APP_LABEL}:{int(t)}.{b}".encode()), s))
        return pa.array(out, pa.bool_())

    return run


def verified_pushes(pushes: DataFrame, connections: DataFrame, tenants: DataFrame, master: str) -> DataFrame:
    """Push events (event, body, signature, full_name, ref, default_branch) become requests: of the connections that the
    repository has, those with whose own secret the body is signed and whose branch was pushed to."""
    matching = push_candidates(pushes.filter("event = 'push'"), connections, tenants)
    signed = matching.filter(push_verified(master)("tenant_id", "repo_name", "body", "signature"))
    return on_branch(signed).select("tenant_id", "repo_name", F.lit("push").alias("trigger"))


def delivery_outcomes(deliveries: DataFrame, connections: DataFrame, tenants: DataFrame, master: str) -> DataFrame:
    """(id, status, connections, requests) of deliveries (id, event, body, signature, full_name, ref, default_branch): 400
    where the body names no repository, 401 where no connection's secret signed it, 200 for a ping, 202 for anything
    else; ``requests`` counts the connections whose branch was pushed to."""
    matching = push_candidates(deliveries.filter("full_name is not null"), connections, tenants)
    signed = matching.filter(push_verified(master)("tenant_id", "repo_name", "body", "signature"))
    branch = on_branch(signed.filter("event = 'push'")).groupBy("id").agg(F.count("*").alias("requests"))
    counts = signed.groupBy("id").agg(F.count("*").alias("connections"))
    told = deliveries.select("id", "event", "full_name").join(counts, "id", "left").join(branch, "id", "left")
    status = F.when(F.col("full_name").isNull(), 400).when(F.col("connections").isNull(), 401).when(F.col("event") == "ping", 200).otherwise(202)
    return told.select("id", status.alias("status"), F.coalesce("connections", F.lit(0)).alias("connections"), F.coalesce("requests", F.lit(0)).alias("requests"))


def app_requests(requests: DataFrame, connections: DataFrame, tenants: DataFrame, master: str, now: int) -> DataFrame:
    """(id, tenant_id, repo_name, status) of signed requests (id, body, stamp, signature) to index a repository: 401, 400,
    404 or, where there is such a connection of an active tenant, 202."""
    good = app_verified(master, now)("body", "stamp", "signature")
    told = requests.withColumn("good", good).withColumn("x", F.from_json("body", "tenant_id string, repo_name string"))
    told = told.select("id", "good", F.expr("try_cast(x.tenant_id as bigint)").alias("tenant_id"), F.col("x.repo_name").alias("repo_name"))
    known = active_connections(connections, tenants).select("tenant_id", "repo_name").withColumn("known", F.lit(True))
    status = F.when(~F.col("good"), 401).when(F.col("tenant_id").isNull() | F.col("repo_name").isNull(), 400).when(F.col("known").isNull(), 404).otherwise(202)
    return told.join(known, ["tenant_id", "repo_name"], "left").select("id", "tenant_id", "repo_name", status.alias("status"))


def app_outcomes(judged: DataFrame, made: DataFrame) -> DataFrame:
    """(id, status, job_id) from ``app_requests`` and the jobs that were made: of the requests for one repository the first
    has the job, the others, and those whose repository had a run queued, 200."""
    first = judged.filter("status = 202").groupBy("tenant_id", "repo_name").agg(F.min("id").alias("id"))
    won = first.join(made.select("tenant_id", "repo_name", F.col("id").alias("job_id")), ["tenant_id", "repo_name"]).select("id", "job_id")
    status = F.when((F.col("status") == 202) & F.col("job_id").isNull(), 200).otherwise(F.col("status"))
    return judged.join(won, "id", "left").select("id", status.alias("status"), "job_id")


def unused_codes(factors: DataFrame, codes: DataFrame) -> DataFrame:
    """(user_id, enabled, left): for each second factor whether it is on, and its backup codes that nobody has used."""
    left = codes.filter("used_at is null").groupBy("user_id").agg(F.count("*").alias("left"))
    return factors.join(left, "user_id", "left").select("user_id", F.col("enabled_at").isNotNull().alias("enabled"), F.coalesce("left", F.lit(0)).alias("left"))


# -- sets ------------------------------------------------------------------
def compared(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """(keys, side): distinct keys that both have (``both``) and the symmetric difference (``left``, ``right``)."""
    tagged = left.select(*on, F.lit(1).alias("s")).unionByName(right.select(*on, F.lit(2).alias("s")))
    sides = F.bit_or("s")
    return tagged.groupBy(*on).agg(F.when(sides == 3, "both").when(sides == 1, "left").otherwise("right").alias("side"))


def any_of(column: Column, values: list) -> Column:
    """``column = ANY(values)``: false for an empty list, null for a null column."""
    return F.array_contains(F.array(*map(F.lit, values)) if values else F.array().cast("array<string>"), column)
