"""Resolution of raw symbol references as set-based joins, most precise rule first.

Rules: import map; self, cls or this in the enclosing class; same module; a name that is unique in its
repository. Prefixes are expanded for distinct sources, never for edges. A rule's lookup tables are
distinct keys, so no join multiplies edges. An edge is moved once, whatever the number of rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..plans.staging import staged

RULES = ["import_map", "enclosing", "same_module", "unique_name"]
#: Rows of a lookup that every task may hold; more are joined as the planner likes.
LOOKUP_ROWS = 200_000
#: Lengths of module names, in parts, that are looked up one by one; with more, prefixes of sources are expanded.
MODULE_DEPTHS = 8


def _prefixes(names: DataFrame, proper: bool) -> DataFrame:
    parts = F.split("src_qname", r"\.")
    top = F.size(parts) - (1 if proper else 0)
    return names.withColumn("_n", F.explode(F.when(top >= 1, F.sequence(F.lit(1), top)).otherwise(F.array().cast("array<int>")))).withColumn("prefix", F.array_join(F.slice(parts, F.lit(1), F.col("_n")), "."))


def longest_prefix(names: DataFrame, nodes: DataFrame, kinds: list[str], proper: bool, out: str) -> DataFrame:
    """(repo, src_qname, out): the longest dotted prefix that names a node of ``kinds``."""
    keys = nodes.filter(F.col("kind").isin(kinds)).select("repo", F.col("qualified_name").alias("prefix")).distinct()
    return _prefixes(names, proper).join(keys, ["repo", "prefix"]).groupBy("repo", "src_qname").agg(F.max_by("prefix", "_n").alias(out))


def _last(name: str) -> Column:
    return F.substring_index(name, ".", -1)


def _dealt(rows: DataFrame, tasks: int | None) -> DataFrame:
    """Rows by repository and ``_last``: what a name and its lookups have in common, so that they meet without being moved again."""
    return rows.repartition(tasks, "repo", "_last") if tasks else rows.repartition("repo", "_last")


def _lookup(rows: DataFrame, label: str) -> DataFrame:
    """Rows written once; few enough, they go to all tasks, else how they are met is the planner's choice."""
    rows = staged(rows, label)
    return F.broadcast(rows) if rows.count() <= LOOKUP_ROWS else rows


def _members(refs: DataFrame, nodes: DataFrame, there: DataFrame, tasks: int | None) -> DataFrame:
    """(repo, src_qname, _mine, _own): the enclosing class's member of a name, for references through self, cls or this.

    Members of any prefix are found first, by their name; only sources that have one are placed in their class.
    """
    asked = _dealt(refs.filter("_mine is not null").select("repo", "src_qname", F.col("_mine").alias("_last")), tasks).distinct()
    maybe = _prefixes(asked, True).withColumn("_q", F.concat("prefix", F.lit("."), "_last")).join(there.hint("shuffle_hash"), ["repo", "_last", "_q"], "left_semi")
    maybe = staged(maybe.select("repo", "src_qname", F.col("_last").alias("_mine"), "prefix", F.col("_q").alias("_own")), "maybe-members")
    return maybe.join(longest_prefix(maybe.select("repo", "src_qname").distinct(), nodes, S.TYPE_TARGETS, True, "prefix"), ["repo", "src_qname", "prefix"]).drop("prefix")


def resolve_edges(edges: DataFrame, nodes: DataFrame, imports: DataFrame, tasks: int | None = None) -> DataFrame:
    """Edges with dst_qname and resolved set anew, and ``rule`` (null: unresolved or not resolvable).

    ``edges`` are raw: what an earlier run resolved is derived again from dst_raw. IMPORTS are flagged by
    existence; other types are passed on. Edges are moved once, to ``tasks`` tasks (null: as many as a shuffle has
    partitions): a candidate's name ends in the last part of the reference, and so do the nodes that may bear it. Lookups
    by anything else are made small before, and are read by all tasks.
    """
    # Rows dealt by a part of a join's keys meet where they are; the session keeps this, as the plan is made when it runs.
    edges.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    imported, dotted = F.col("edge_type") == "IMPORTS", F.contains("dst_raw", F.lit("."))
    refs = edges.filter(F.col("edge_type").isin([*S.RESOLVABLE, "IMPORTS"])).select("repo", "edge_type", "src_qname", "dst_raw", "src_file", F.when(imported, F.col("dst_qname")).alias("_q0"))
    refs = refs.withColumn("_last", F.when(imported, _last("_q0")).otherwise(_last("dst_raw"))).withColumn("_head", F.when(~imported & dotted, F.substring_index("dst_raw", ".", 1)))
    refs = refs.withColumn("_mine", F.when(F.col("_head").isin("self", "cls", "this"), F.substring_index(F.substring_index("dst_raw", ".", 2), ".", -1)))
    there = _dealt(nodes.select("repo", _last("qualified_name").alias("_last"), F.col("qualified_name").alias("_q")), tasks).distinct().withColumn("_in", F.lit(1))
    names = imports.groupBy("repo", F.col("file_path").alias("src_file"), F.col("local_name").alias("_head")).agg(F.max("target").alias("_target"))

    # A reference of several parts needs its head's target, and few heads have any; one of a single part needs a target that is there.
    heads = refs.filter("_head is not null").select("repo", "src_file", "_head").distinct()
    refs = refs.join(_lookup(names.join(heads, ["repo", "src_file", "_head"], "left_semi"), "aliases"), ["repo", "src_file", "_head"], "left")
    refs = refs.join(_lookup(_members(refs, nodes, there, tasks), "members"), ["repo", "src_qname", "_mine"], "left")
    files = staged(nodes.filter("kind = 'File'").select("repo", F.col("qualified_name").alias("_file")).distinct(), "modules")
    depths = [r[0] for r in files.filter("_file is not null").select(F.size(F.split("_file", r"\."))).distinct().collect()]
    placed = len(depths) <= MODULE_DEPTHS and files.count() <= LOOKUP_ROWS
    if not placed:
        refs = refs.join(longest_prefix(refs.filter(~imported).select("repo", "src_qname").distinct(), nodes, ["File"], False, "_module"), ["repo", "src_qname"], "left")
    refs = refs.withColumn("_q0", F.coalesce("_q0", F.concat("_target", F.expr("substring(dst_raw, length(_head) + 1)"))))
    refs = _dealt(refs.select("repo", "_last", "edge_type", "src_qname", "dst_raw", "src_file", "_q0", "_own", *([] if placed else ["_module"])), tasks)
    if placed:
        for n in depths:
            at = F.broadcast(files.filter(F.size(F.split("_file", r"\.")) == n).select("repo", F.col("_file").alias(f"_at{n}")))
            refs = refs.withColumn(f"_at{n}", F.substring_index("src_qname", ".", n)).join(at.withColumn(f"_file{n}", F.col(f"_at{n}")), ["repo", f"_at{n}"], "left")
        refs = refs.withColumn("_module", F.coalesce(*(F.col(f"_file{n}") for n in sorted(depths, reverse=True)), F.lit(None).cast("string")))
    refs = refs.withColumn("_q2", F.when(F.col("_module") == "", F.col("_last")).otherwise(F.concat("_module", F.lit("."), "_last")))

    known = _dealt(names.filter(~F.contains("_head", F.lit("."))).withColumn("_last", _last("_target")), tasks).join(there.withColumnRenamed("_q", "_target").hint("shuffle_hash"), ["repo", "_last", "_target"], "left_semi")
    bare = _dealt(known.select("repo", F.col("_head").alias("_last"), "src_file", F.col("_target").alias("_whole")), tasks)
    named = _dealt(nodes.filter(F.col("kind").isin({*S.CALL_TARGETS, *S.TYPE_TARGETS})).select("repo", F.col("name").alias("_last"), "kind", "qualified_name"), tasks)
    lone = named.groupBy("repo", "_last").agg(*(F.when(F.count_if(F.col("kind").isin(kinds)) == 1, F.min(F.when(F.col("kind").isin(kinds), F.col("qualified_name")))).alias(to) for to, kinds in (("_call", S.CALL_TARGETS), ("_type", S.TYPE_TARGETS))))
    refs = refs.join(bare.hint("shuffle_hash"), ["repo", "_last", "src_file"], "left").join(lone.hint("shuffle_hash"), ["repo", "_last"], "left")
    for q in ("_q0", "_q2"):
        refs = refs.join(there.withColumnsRenamed({"_q": q, "_in": f"{q}_in"}).hint("shuffle_hash"), ["repo", "_last", q], "left")
    single = F.col("dst_raw") == F.col("_last")
    found = [F.coalesce(F.when(F.col("_q0_in") == 1, F.col("_q0")), F.when(single, F.col("_whole"))), F.col("_own"), F.when(F.col("_q2_in") == 1, F.col("_q2")), F.when(F.col("edge_type") == "CALLS", F.col("_call")).otherwise(F.col("_type"))]
    rule = F.when(~imported, F.coalesce(*(F.when(q.isNotNull(), F.lit(r)) for r, q in zip(RULES, found, strict=True))))
    met = F.when(imported, F.col("_q0_in") == 1).otherwise(F.coalesce(*found).isNotNull())
    out = refs.select("repo", "edge_type", "src_qname", F.when(imported, F.col("_q0")).otherwise(F.coalesce(*found, "dst_raw")).alias("dst_qname"), "dst_raw", "src_file", F.coalesce(met.cast("int"), F.lit(0)).alias("resolved"), rule.alias("rule"))
    return out.unionByName(edges.filter(~F.col("edge_type").isin([*S.RESOLVABLE, "IMPORTS"])).withColumn("rule", F.lit(None).cast("string")).select(*out.columns))


def flag_imports(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """IMPORTS edges, resolved where a node bears the name."""
    there = nodes.select("repo", F.col("qualified_name").alias("dst_qname")).distinct().withColumn("_in", F.lit(1))
    return edges.join(there, ["repo", "dst_qname"], "left").select("repo", "edge_type", "src_qname", "dst_qname", "dst_raw", "src_file", F.coalesce("_in", F.lit(0)).alias("resolved"))


def rooted_assets(imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo, file_path, local_name, target, target_resolved) for rooted assets and templates whose target is
    absent: the one file whose path is the reference or ends in it. All path suffixes are expanded once and
    joined by equality."""
    absent = imports.filter((F.col("kind") == "template") | ((F.col("kind") == "asset") & F.col("local_name").startswith("/")))
    absent = absent.join(nodes.select("repo", F.col("qualified_name").alias("target")).distinct(), ["repo", "target"], "left_anti")
    ref = F.regexp_replace(F.regexp_replace("local_name", "^/+", ""), r"[?#].*$", "")
    files = nodes.filter("kind = 'File'").select("repo", "file_path", "qualified_name")
    parts = F.split("file_path", "/")
    ends = files.select("repo", "qualified_name", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("ref"))
    one = ends.groupBy("repo", "ref").agg(F.count("*").alias("c"), F.first("qualified_name").alias("target_resolved")).filter("c = 1").drop("c")
    return absent.withColumn("ref", ref).filter("ref <> ''").join(one, ["repo", "ref"]).select("repo", "file_path", "local_name", "target", "target_resolved")


def apply_rooted(imports: DataFrame, edges: DataFrame, fixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Imports and IMPORTS edges with the targets that ``rooted_assets`` found."""
    new_imports = imports.join(fixes.select("repo", "file_path", "local_name", "target_resolved"), ["repo", "file_path", "local_name"], "left").withColumn("target", F.coalesce("target_resolved", "target")).select(*imports.columns)
    by_raw = fixes.select("repo", F.col("file_path").alias("src_file"), F.col("local_name").alias("dst_raw"), "target_resolved", F.lit("IMPORTS").alias("edge_type")).distinct()
    new_edges = edges.join(by_raw, ["repo", "src_file", "dst_raw", "edge_type"], "left").withColumn("dst_qname", F.coalesce("target_resolved", "dst_qname")).select(*edges.columns)
    return new_imports, new_edges


def unresolved(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("edge_type").isin(S.RESOLVABLE) & (F.col("resolved") == 0))
