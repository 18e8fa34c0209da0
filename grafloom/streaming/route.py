"""Push events from a folder of JSON to job requests, and re-indexing from job transitions."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..api import CodeGraph
from ..jobs import JobLog
from ..operators import control as C
from ..sinks.store import GraphStore

PUSH = "event string, signature string, body string"
_BODY = "ref string, repository struct<full_name:string,default_branch:string>"


def read_pushes(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of deliveries: each line has the event's name, its signature and its body as text."""
    return parsed(spark.readStream.schema(PUSH).json(folder))


def parsed(deliveries: DataFrame) -> DataFrame:
    """Deliveries with full_name, ref and default_branch of their bodies; those of no repository fall away."""
    body = F.from_json("body", _BODY)
    return deliveries.withColumn("x", body).filter("x.repository.full_name is not null").select("event", "signature", "body", F.col("x.repository.full_name").alias("full_name"), F.coalesce("x.ref", F.lit("")).alias("ref"), F.col("x.repository.default_branch").alias("default_branch"))


def requests(deliveries: DataFrame, connections: DataFrame, tenants: DataFrame, master: str) -> DataFrame:
    """Job requests of a stream of deliveries: a stream-static join, then signature and branch."""
    return C.verified_pushes(deliveries, connections, tenants, master)


def once(store: GraphStore, work: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """``work`` as a foreachBatch function that passes over batches which the store has committed: a batch that is
    delivered again after a failure changes nothing, and one whose work raises isn't noted."""

    def run(batch: DataFrame, number: int) -> None:
        if number > store.batch():
            work(batch, number)
            store.mark(number)

    return run


def indexed(graph: CodeGraph, names: list[str]) -> dict[str, dict]:
    """The answers of re-indexing repositories, or of indexing those that the store hasn't got from folders of their names:
    in one plan each, and one by one if a plan fails, so that a repository's failure is its own."""
    known = set(graph.store.repos())
    old, new = [n for n in names if n in known], [n for n in names if n not in known]
    try:
        return (graph.reindex_repositories(old) if old else {}) | (graph.index_repositories({n: n for n in new}) if new else {})
    except Exception as e:  # noqa: BLE001 - told with the repository that it belongs to
        if len(names) == 1:
            return {names[0]: {"error": f"{type(e).__name__}: {e}"[:2000]}}
        return {n: answer for name in names for n, answer in indexed(graph, [name]).items()}


def of_tenant(graphs: Callable[[int], CodeGraph], tenant: int, names: list[str]) -> dict[str, dict]:
    """The same in a tenant's graph; where that can't be had, its error for all."""
    try:
        graph = graphs(tenant)
    except Exception as e:  # noqa: BLE001 - one tenant's failure is its own
        return dict.fromkeys(names, {"error": f"{type(e).__name__}: {e}"[:2000]})
    return indexed(graph, names)


RESULTS = "tenant_id long, repo_name string, job long, kind string, error string, nodes long, edges long"


def index_on_change(transitions: DataFrame, graphs: Callable[[int], CodeGraph], results: str, checkpoint: str) -> StreamingQuery:
    """Indexes the repositories whose jobs started to run, each in the graph of its tenant, and writes for each a result
    (succeeded, or failed with its error) to the folder ``results``, a subfolder for each batch: read as a stream they are
    events of the job log. A batch that is delivered again is indexed again from what is there and replaces its results."""
    spark = transitions.sparkSession

    def work(batch: DataFrame, number: int) -> None:
        out = []
        running = batch.filter("status = 'running'").groupBy("tenant_id", "repo_name").agg(F.max("job").alias("job"))
        for row in running.groupBy("tenant_id").agg(F.map_from_entries(F.collect_list(F.struct("repo_name", "job"))).alias("jobs")).toLocalIterator():
            # A tenant's repositories of one batch, which are indexed together.
            for name, answer in of_tenant(graphs, row["tenant_id"], sorted(row["jobs"])).items():
                kind = "failed" if "error" in answer else "succeeded"
                out.append((row["tenant_id"], name, row["jobs"][name], kind, answer.get("error"), answer.get("nodes"), answer.get("edges")))
        spark.createDataFrame(out, RESULTS).coalesce(1).write.mode("overwrite").json(f"{results.rstrip('/')}/batch={number}")

    return transitions.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_jobs(log: JobLog, wanted: DataFrame, graphs: Callable[[int], CodeGraph], heads: DataFrame, now: Column) -> DataFrame:
    """Claims jobs of the stored log (id), indexes what has moved since its last run, and finishes them; the jobs after it.
    ``heads`` (external_repo, branch, sha, is_default) tells where branches stand: a job whose branch stands at the commit
    that was indexed succeeds without a run unless asked for by hand, and one whose branch isn't there fails."""
    claims = log.claim(wanted, now)
    branch = heads.select("external_repo", F.col("branch").alias("at_branch"), "sha", "is_default")
    on = (F.col("c.external_repo") == F.col("h.external_repo")) & F.when(F.col("c.branch").isNotNull(), F.col("c.branch") == F.col("h.at_branch")).otherwise(F.col("h.is_default"))
    placed = claims.alias("c").join(branch.alias("h"), on, "left").select("c.id", "c.tenant_id", "c.repo_name", "c.trigger", "c.git_ref", "h.sha")
    rows = placed.collect()  # a worker's few jobs
    answers: dict[int, dict] = {}
    for tenant in {r["tenant_id"] for r in rows}:
        own = [r for r in rows if r["tenant_id"] == tenant]
        answers |= {r["id"]: {"error": "the branch to index isn't there"} for r in own if r["sha"] is None}
        try:
            known = set(graphs(tenant).store.repos())
        except Exception:  # noqa: BLE001 - told by of_tenant
            known = set()
        still = {r["id"] for r in own if r["sha"] is not None and r["repo_name"] in known and r["sha"] == r["git_ref"] and r["trigger"] != "manual"}
        answers |= dict.fromkeys(still, {"unchanged": True})
        todo = {r["repo_name"]: r["id"] for r in own if r["id"] not in answers}
        answers |= {todo[name]: answer for name, answer in of_tenant(graphs, tenant, sorted(todo)).items()} if todo else {}
    out = []
    for r in rows:
        answer = answers[r["id"]]
        ok = "error" not in answer
        out.append((r["id"], ok, r["sha"] if ok else None, answer.get("error"), json.dumps(answer, sort_keys=True) if ok else None))
    results = log.spark.createDataFrame(out, "id long, ok boolean, commit_sha string, error string, stats string")
    return log.finish(results, now)
