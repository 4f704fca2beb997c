"""Mixing sources to target weights by systematic sampling.

Documents of a source are laid end to end, each as long as its expected number of copies; with one random offset the
line is cut at whole numbers, and a document is emitted once for each cut inside it. Laying documents out by size
makes the words taken follow the target closely. Prefix sums go in two levels (blocks, then rows inside a block), so
no source has to fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_null_safe, staged, table, word_count

#: Rows in one block of the prefix sum, about.
BLOCK_ROWS = 500
#: No source gets more than this many times its size, and no document more copies.
MOST_COPIES = 3
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)


def source_targets(sizes: DataFrame, most: int = MOST_COPIES, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sizes``: source, source_size. Adds target: the sum of all sizes shared out by weight, where no source gets
    more than ``most`` times its size and what it can't take is shared again among the others.

    Sources fill up in order of capacity per weight; the water level is the one at which the full ones and the
    weighted rest add up to the whole. One row per source goes through one task."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    order = [F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (
        sizes.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("limit"))
        .withColumns({
            "level": (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0)))
            / F.sum("weight").over(onward),
        })
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("limit"))
    )
    final = F.min(F.when(F.col("fits"), F.struct(F.col("limit") / F.col("weight"), F.col("level").alias("at")))).over(every)["at"]
    return filled.select(
        "source", "source_size",
        F.when(F.col("limit") <= final * F.col("weight"), F.col("limit").cast("double"))
        .otherwise(final * F.col("weight")).alias("target"),
    )


def offset_of(source: Column, seed: int) -> Column:
    """The one offset in [0, 1) of a source, from the seed and its name."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null")))
    return _hash32(named) / F.lit(float(1 << 32))


def _hash32(name: Column) -> Column:
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long")


def mixed(docs: DataFrame, seed: int = 17, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken.

    A null text has size 0, and a null source is a source of its own, after all others. Each document's expected
    copies are its source's target over its size, so at most ``MOST_COPIES``; a source whose documents are all empty
    takes nothing. Rows repeated with the same id and size are interchangeable. Reruns agree, for the order is by size, a hash of the
    id, and the id. An empty table gives no rows; other columns are ignored."""
    rows = staged(
        docs.select(
            F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
            _hash32(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null")))).alias("lot"),
        ), "sizes",
    )
    known = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    targets = source_targets(known.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    targets = targets.withColumns({
        "rate": F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)),
        "start": offset_of(F.col("source"), seed),
    })
    earlier = lambda n, keys, order: F.coalesce(
        F.sum(n).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    sizes = known.select("source", "size", F.ceil(F.col("n") / BLOCK_ROWS).alias("parts"), earlier("n", ["source"], "size").alias("before"))
    placed = join_null_safe(rows, sizes, ["source", "size"]).withColumn(
        "part", F.floor(F.col("lot") * F.col("parts") / float(1 << 32))
    ).drop("parts")
    blocks = placed.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("n"))
    blocks = blocks.select("source", "size", "part", earlier("n", ["source", "size"], "part").alias("skipped"))
    inside = Window.partitionBy("source", "size", "part").orderBy("lot", "doc_id")
    ranked = placed.withColumn("place", F.row_number().over(inside))
    joined = join_null_safe(ranked, blocks, ["source", "size", "part"]).withColumn(
        "place", (F.col("before") + F.col("skipped") + F.col("place")).cast("double")
    )
    cut = lambda i: F.floor(F.col("rate") * i + F.col("start"))
    return (
        join_null_safe(joined, targets, ["source"])
        .select("doc_id", "source", "size", "source_size", "target", (cut(F.col("place")) - cut(F.col("place") - 1)).alias("copies"))
        .withColumn("taken", F.col("copies") * F.col("size"))
    )


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).drop("copies", "source")


ORACLE = """
WITH rows_ AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS lot
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM rows_ GROUP BY source
), weighed AS (
  SELECT source, source_size, (source_size * 3)::BIGINT AS limit_,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT AS weight
  FROM sources
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(limit_) OVER (ORDER BY limit_ / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY limit_ / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), settled AS (
  SELECT *, (SELECT level FROM levels WHERE level * weight <= limit_ ORDER BY limit_ / weight, level LIMIT 1) AS final FROM levels
), targets AS (
  SELECT source, source_size, CASE WHEN limit_ <= final * weight THEN limit_::DOUBLE ELSE final * weight END AS target,
         ('0x' || substr(md5('17:' || coalesce('s' || source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start
  FROM settled
), placed AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, t.start,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         (row_number() OVER (PARTITION BY r.source ORDER BY r.size, r.lot, r.doc_id))::DOUBLE AS place
  FROM rows_ r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       ((floor(rate * place + start) - floor(rate * (place - 1) + start))::BIGINT * size)::BIGINT AS taken
FROM placed
"""
