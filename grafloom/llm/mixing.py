"""Mixing sources to target weights by capped water-filling.

Targets share ``budget`` times the corpus size by weight; no source exceeds ``epochs`` times its own size,
and what a cap cuts off is shared again by weight until no target is above its cap. In closed form: sources
sorted by cap over weight fill up first, and the level of the rest is (total - caps so far) / (weights
left). A document is then taken floor(target / size) times, and once more if its place in a seeded order of
its source falls into the fraction that is left. The order is by a hash of id and text, so that an id which many rows
have, or none, is spread too. Places are prefix sums of sizes over hash bins in each source, as many as leave a hot
source about 250,000 rows in one, and taken sizes meet the target within half a document.

Everything is DataFrame operations. Defined cases: null text has size 0 and is taken 0 times; a null source
is a source of its own, last in order; of rows with one id and text any may be taken; a source of
size 0 has target 0; ``mix_sources`` ignores extra columns and ``mixed`` returns all as they are, whatever their
names; an empty table gives an empty result. The table of sources, a row each, is put in order in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
_LEAST_DIGITS = 3
_BIN_ROWS = 250_000


def seeded_order(seed: int, id_col: Column, text_col: Column) -> Column:
    """A hexadecimal hash of seed, id and text, the same in any engine that has MD5."""
    text = F.coalesce(F.md5(text_col.cast("binary")), F.lit(""))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))


def water_fill(sources: DataFrame, weights: tuple[int, ...], budget: tuple[int, int], epochs: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size); a row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    cycle = F.array(*(F.lit(w) for w in weights))
    weighed = sources.withColumn("w", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(n)) + 1).cast("int"))).withColumn("cap", F.lit(epochs) * F.col("source_size"))
    fill = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(whole) * budget[0] / F.lit(budget[1])
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(rest)
    levelled = weighed.withColumn("level", level).withColumn("open", F.col("level") * F.col("w") < F.col("cap"))
    settled = levelled.withColumn("final", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return settled.select("source", "source_size", F.coalesce(F.col("final") * F.col("w"), F.col("cap").cast("double")).alias("target"))


def _taken(rows: DataFrame, weights: tuple[int, ...], budget: tuple[int, int], epochs: int, seed: int) -> DataFrame:
    """Rows (id, source, text, ...) with size, source_size, target and times in place of the text."""
    order = seeded_order(seed, F.col("id"), F.col("text"))
    digits = max(_LEAST_DIGITS, math.ceil(math.log(max(1, rows.count() / (3 * _BIN_ROWS)), 16)))
    sized = rows.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")).withColumn("place", order).drop("text")
    # One key of source and bin: the window and the join below deal by it once.
    key = F.concat(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")), F.lit("|"), F.substring("place", 1, digits))
    sized = sized.withColumn("key", key)
    bins = sized.select("source", "key", F.substring("place", 1, digits).alias("bin"), "size").groupBy("source", "bin", "key").agg(F.sum("size").alias("bin_size"))
    plan = water_fill(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, budget, epochs)
    within = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("bin_start", F.coalesce(F.sum("bin_size").over(within), F.lit(0)))
    table = bins.alias("b").join(plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source"))).select("b.key", "bin_start", "source_size", "target")
    line = Window.partitionBy("key").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, -1)
    joined = sized.withColumn("before", F.coalesce(F.sum("size").over(line), F.lit(0))).join(table, "key", "left")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    part = F.col("target") - whole * F.col("source_size")
    more = (F.col("size") > 0) & (2 * (F.col("bin_start") + F.col("before")) + F.col("size") <= 2 * part)
    return joined.withColumn("times", F.when(F.col("size") > 0, whole + more.cast("long")).otherwise(F.lit(0).cast("long"))).drop("key", "place", "before", "bin_start")


def _named(id_col: str, text_col: str, source_col: str) -> list[Column]:
    return [F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text")]


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: tuple[int, int] = (3, 2), epochs: int = 2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, times) of every row; the words taken are times x size."""
    return _taken(docs.select(*_named(id_col, text_col, source_col)), weights, budget, epochs, seed).withColumnsRenamed({"id": id_col, "source": source_col})


def mixed(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: tuple[int, int] = (3, 2), epochs: int = 2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row as often as it is taken, in the columns of ``docs``, whatever their names."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *_named(id_col, text_col, source_col))
    return _taken(rows, weights, budget, epochs, seed).filter("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


#: The same mix in DuckDB SQL; seed 17, weights 3, 1, 2, 150 % and two epochs.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')) AS o
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, 2 * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM sources),
filled AS (
  SELECT *, row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST) AS k FROM weighed),
levels AS (
  SELECT *, ((SELECT CAST(sum(source_size) AS BIGINT) FROM sources) * 3 / 2.0
             - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / CAST(sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM filled),
level AS (SELECT arg_min(level, k) AS l, min(k) AS k FROM levels WHERE level * w < cap),
targets AS (
  SELECT source, source_size, CASE WHEN l.k IS NULL OR t.k < l.k THEN CAST(cap AS DOUBLE) ELSE l.l * w END AS target
  FROM levels t CROSS JOIN level l),
placed AS (
  SELECT s.*, coalesce(CAST(sum(size) OVER (PARTITION BY source ORDER BY o, size
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before
  FROM sized s),
cut AS (
  SELECT p.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       size * (CASE WHEN size = 0 THEN 0 ELSE whole + CASE WHEN 2 * before + size <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END END) AS taken
FROM cut
"""
