"""Importance resampling towards a target's distribution of hashed word n-grams.

Counting: every task adds up the bucket counts of its texts and gives out one array; the sums over all tasks (as many
numbers as buckets) make an array of gains, with which a second pass scores each document. Drawing the best is a
parallel sort by regular sampling: every task sorts its scores into a run and writes it with each row's place; a fixed
number of regular places of each run give regular splitters; the runs' segments between splitters are exchanged and
merged where they meet; prefix counts over the segments give exact ranks. Only segments that can hold a drawn rank
are exchanged.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import byte_slices, shuffle_partitions, staged, table

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Words of a text whose features are held at once; ranges of the sort at most; samples of all runs together, about.
STEP_WORDS, RANGES, SAMPLES = 200_000, 512, 1 << 20

#: Bytes as they count in words: A-Z lower-cased; what isn't a letter, a digit or beyond ASCII parts words.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def features(text: bytes, longest: int = LONGEST) -> Iterator[np.ndarray]:
    """The unsigned CRC-32 of every run of 1 to ``longest`` words, joined by one space, in arrays of bounded size."""
    words = text.translate(_WORD_BYTES).split()
    for at in range(0, len(words), STEP_WORDS):
        here = words[at : at + STEP_WORDS + longest - 1]
        own = min(STEP_WORDS, len(words) - at)
        spaced = [b" " + w for w in here[1:]]
        checks = list(map(crc32, here[:own]))
        yield np.array(checks, np.uint32)
        for n in range(1, longest):
            checks = list(map(crc32, spaced[n - 1 :], checks[: max(0, min(own, len(here) - n))]))
            yield np.array(checks, np.uint32)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """``texts``: one text column. How many features of all texts fall into each bucket. Each task sends one row a
    bucket it met; the driver gets one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for part in features((text.as_py() or "").encode()):
                    total += np.bincount(part % np.uint32(buckets), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], ["bucket", "n"])

    rows = texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(buckets, np.int64)
    for bucket, n in rows:
        counts[bucket] = n
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, thousandths of the log of its smoothed share in the target to that in the source, rounded down."""
    b, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([
        math.floor(1000 * math.log((float(t) + 1) * (s_all + b) / ((float(s) + 1) * (t_all + b)))) for s, t in zip(source.tolist(), target.tolist())
    ], np.int64)


def noise(doc_id: object, seed: int = SEED) -> int:
    """Thousandths of a Gumbel draw from the hash of seed and id (nothing, where it is null), rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = np.uint32(len(gain))
        for whole in batches:
            for batch in byte_slices(whole, 1, 16 << 20):
                rows = []
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    sizes, weight = [], 0
                    for part in features((text.as_py() or "").encode()):
                        sizes.append(len(part))
                        weight += int(gain[part % many].sum())
                    rows.append((sum(sizes[::LONGEST]), sum(sizes), weight, weight + noise(i, seed)))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows))], schema.names)

    schema = StructType([docs.select("doc_id").schema.fields[0], *(StructField(c, LongType(), False) for c in ("n_words", "n_features", "weight", "score"))])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _best_first() -> list[Column]:
    return [F.desc("score"), F.asc_nulls_last("doc_id")]


def _runs(rows: DataFrame) -> DataFrame:
    """Every partition in order, with its number as run and each row's place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            places = pa.array(np.arange(at, at + n), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, number), pa.int64()), places], [*batch.schema.names, "run", "place"])
            at += n

    ordered = rows.sortWithinPartitions(F.desc("able"), *_best_first())
    return ordered.mapInArrow(run, StructType([*rows.schema.fields, StructField("run", LongType()), StructField("place", LongType())]))


def _splitters(runs: DataFrame, ranges: int) -> list[tuple[int, int | None]]:
    """Of ``ranges`` regular places of each run (fewer, beyond SAMPLES in all): those at equal steps, in order. Between
    two splitters lie no more rows than two parts in ``ranges`` of all (with fewer places p: one part in ``ranges`` and
    one in p)."""
    sizes = runs.groupBy("run").agg((F.max("place") + 1).alias("size"))
    each = F.greatest(F.lit(1), F.least(F.lit(ranges), F.floor(F.lit(SAMPLES) / F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))))
    sizes = sizes.withColumn("step", F.greatest(F.lit(1), F.ceil(F.col("size") / each)))
    taken = runs.join(F.broadcast(sizes), "run").where("place % step = 0").select("score", "doc_id", "step")
    # A sample stands for ``step`` rows, so that small runs don't weigh as much as large ones.
    by_size = Window.orderBy(*_best_first()).rowsBetween(Window.unboundedPreceding, -1)
    placed = taken.withColumn("before", F.coalesce(F.sum("step").over(by_size), F.lit(0)))
    total = sizes.agg(F.sum("size").alias("rows"))
    cut = lambda c: F.floor(c * ranges / F.greatest(F.lit(1), F.col("rows")))
    chosen = placed.crossJoin(F.broadcast(total)).withColumn("range", cut(F.col("before"))).groupBy("range").agg(
        F.min_by(F.struct("score", "doc_id"), F.col("before")).alias("s")
    )
    return [(r.s.score, r.s.doc_id) for r in chosen.where("range > 0").orderBy("range").collect()]


_LAST = np.iinfo(np.int64).max


def _with_range(runs: DataFrame, splitters: list[tuple[int, int | None]]) -> DataFrame:
    """Adds range: how many splitters come no later than the row."""
    scores = np.array([s for s, _ in splitters], np.int64)
    ids = np.array([_LAST if i is None else i for _, i in splitters], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(scores)
        for batch in batches:
            own = np.concatenate([scores, batch.column("score").to_numpy()])
            keys = np.concatenate([ids, batch.column("doc_id").fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64)])
            order = np.lexsort((np.arange(len(own)), keys, ~own))
            found = np.empty(len(own), np.int64)
            found[order] = np.cumsum(order < m)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found[m:], pa.int64())], [*batch.schema.names, "range"])

    return runs.mapInArrow(run, StructType([*runs.schema.fields, StructField("range", LongType())]))


def _ranked_ranges(segments: DataFrame, first: DataFrame) -> DataFrame:
    """Adds rank: rows of a range in order, counted on from the rows of all ranges before. ``first``: range, before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, 0
        for batch in batches:
            ranges, n = batch.column("range").to_numpy(), batch.num_rows
            if not n:
                continue
            begins = np.concatenate([[last is None or ranges[0] != last], ranges[1:] != ranges[:-1]])
            here = np.arange(n) - np.maximum.accumulate(np.where(begins, np.arange(n), -at))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(batch.column("before").to_numpy() + here + 1, pa.int64())], [*batch.schema.names, "rank"]
            )
            last, at = ranges[-1], int(here[-1]) + 1

    merged = segments.join(F.broadcast(first), "range").repartition("range").sortWithinPartitions("range", *_best_first())
    return merged.mapInArrow(run, StructType([*merged.schema.fields, StructField("rank", LongType())]))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, ranges: int | None = None) -> DataFrame:
    """``docs``: doc_id (an integer), text; ``target``: text. Draws floor(``percent`` / 100 of the documents with at least
    ``least_words`` words) without replacement, by the highest sum of log weights and Gumbel noise. doc_id, n_features,
    weight, score and rank of every row; rank is null where not drawn.

    A null text has no features and weight 0; a null id hashes as nothing and comes after equal scores; rows that repeat
    count each for itself, in any order among themselves; an empty table gives none; an empty target makes every
    bucket of the source lose."""
    own = docs.select("doc_id", "text")
    gain = gains(bucket_counts(own.select("text")), bucket_counts(target.select("text")))
    able = (F.col("n_words") >= least_words).alias("able")
    runs = staged(_runs(scored(own, gain, seed).select("doc_id", "n_features", "weight", "score", able)), "runs")
    entered, out = runs.where("able"), ["doc_id", "n_features", "weight", "score"]
    splitters = _splitters(entered, ranges or min(RANGES, shuffle_partitions(docs.sparkSession)))
    ranged = _with_range(entered, splitters)
    # One row a range from here: the counts and what lies before each of them.
    counts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()
    counts.sort()
    draws, at, first = sum(n for _, n in counts) * percent // 100, 0, []
    for r, n in counts:
        if at < draws:
            first.append((r, at))
        at += n
    spark = docs.sparkSession
    reached = first[-1][0] if first else -1
    ranked = _ranked_ranges(ranged.where(F.col("range") <= reached), spark.createDataFrame(first, "range long, before long"))
    drawn = ranked.select(*out, F.when(F.col("rank") <= draws, F.col("rank")).alias("rank"))
    rest = ranged.where(F.col("range") > reached).select(*out).unionByName(runs.where("NOT able").select(*out))
    return drawn.unionByName(rest.withColumn("rank", F.lit(None).cast("long")))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CRC-32 goes byte by byte through its table: first over single words, then on over a space and the next word.
ORACLE = r"""
WITH bits AS (
  SELECT list_transform(range(0, 256), lambda n: list_reduce(
    [n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END)) AS tab
), docs AS MATERIALIZED (SELECT row_number() OVER () AS row_, doc_id, text FROM documents
), texts AS (SELECT 0 AS kind, row_, text FROM docs UNION ALL SELECT 1, row_number() OVER (), text FROM benchmark
), words AS (
  SELECT kind, row_, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (
    SELECT kind, row_, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts)
), runs AS (
  SELECT kind, row_, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY kind, row_ ORDER BY i)
), spelled AS (
  SELECT w, flatten(list_transform(string_split(' ' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT]
    WHEN unicode(c) < 2048 THEN [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)]
    WHEN unicode(c) < 65536 THEN [224 + (unicode(c) >> 12), 128 + ((unicode(c) >> 6) & 63), 128 + (unicode(c) & 63)]
    ELSE [240 + (unicode(c) >> 18), 128 + ((unicode(c) >> 12) & 63), 128 + ((unicode(c) >> 6) & 63), 128 + (unicode(c) & 63)] END)) AS bytes
  FROM (SELECT DISTINCT w FROM words)
), one AS (
  SELECT w, list_reduce(list_prepend(4294967295::BIGINT, bytes[2:]), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])) AS c FROM spelled, bits
), two AS (
  SELECT d.w, d.w2, list_reduce(list_prepend(one.c, s.bytes), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])) AS c
  FROM (SELECT DISTINCT w, w2 FROM runs WHERE w2 IS NOT NULL) d JOIN one USING (w) JOIN spelled s ON s.w = d.w2, bits
), three AS (
  SELECT d.w, d.w2, d.w3, list_reduce(list_prepend(two.c, s.bytes), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])) AS c
  FROM (SELECT DISTINCT w, w2, w3 FROM runs WHERE w3 IS NOT NULL) d JOIN two USING (w, w2) JOIN spelled s ON s.w = d.w3, bits
), features AS (
  SELECT kind, row_, xor(c, 4294967295) % 10000 AS bucket FROM runs JOIN one USING (w) UNION ALL
  SELECT kind, row_, xor(c, 4294967295) % 10000 FROM runs JOIN two USING (w, w2) UNION ALL
  SELECT kind, row_, xor(c, 4294967295) % 10000 FROM runs JOIN three USING (w, w2, w3)
), counts AS (
  SELECT bucket, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM features GROUP BY 1
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain
  FROM counts, (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM counts)
), weights AS (
  SELECT row_, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM features JOIN gains USING (bucket) WHERE kind = 0 GROUP BY 1
), sizes AS (SELECT row_, count(*) AS n_words FROM words WHERE kind = 0 GROUP BY 1
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(n_words, 0) AS n_words, coalesce(weight, 0)
    + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (row_) LEFT JOIN sizes USING (row_)
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS able FROM scored WHERE n_words >= 20
)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= 5 * able // 100 THEN place END AS rank FROM scored s LEFT JOIN ranked r ON r.doc_id IS NOT DISTINCT FROM s.doc_id
"""
