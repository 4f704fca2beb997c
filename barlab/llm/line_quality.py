"""Quality rules from line frequency across documents, all in native expressions.

Normalised lines are hashed, the distinct documents that hold a line are counted per source, lines above the limit are
taken out, and a document with too little left is rejected. The limit is a number of documents, whatever the size of
the source. op3_line_limit counts distinct texts in place of documents, so that copies of one text count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, join_null_safe, staged, table, word_count

#: A line is boilerplate in more than this many documents (texts, for op3_line_limit) of a source.
LIMIT = 20
#: A document must keep this many words, and this part of its words.
LEFT_WORDS, LEFT_PART = 10, 0.2

_WINDOW = 5


def base_metrics(docs: DataFrame) -> DataFrame:
    """``docs``: t (text, not null) and other columns. Adds n_words, word_chars, n_symbols, n_dup_lines and
    n_repeat_words (words inside five-word windows found more than once in the text), drops t."""
    lines = F.filter(F.split("t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.withColumns({"w": F.array_remove(F.split("t", SPACES), ""), "lines": lines}).withColumns({
        "n_words": F.size("w").cast("long"), "word_chars": F.length(F.array_join("w", "")).cast("long"),
        "n_symbols": F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
    })
    shifted = [F.slice("w", i + 1, F.greatest(F.col("n_words") - _WINDOW + 1, F.lit(0)).cast("int")).alias(f"w{i}") for i in range(_WINDOW)]
    # Each argument of a lambda's array is worked out once a row; a lambda's body is worked out for every element.
    rows = rows.withColumn("g", F.transform(F.arrays_zip(*shifted), lambda z: F.xxhash64(*(z[f"w{i}"] for i in range(_WINDOW)))))
    rows = rows.withColumn("g", F.when(F.size(F.array_distinct("g")) < F.size("g"), F.col("g")))
    rows = rows.withColumn("s", F.when(F.col("g").isNotNull(), F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    n = F.size("s")
    # Neighbours in the sorted list that are equal: the place of the later one, and of the one before it.
    twins = lambda keep: F.zip_with(F.slice("s", 1, n - 1), F.slice("s", 2, n - 1), lambda a, b: F.when(a["h"] == b["h"], keep(a, b)))
    places = F.array_sort(F.array_distinct(F.array_compact(F.concat(twins(lambda a, b: a["i"]), twins(lambda a, b: b["i"])))))
    rows = rows.withColumn("places", F.when(F.col("s").isNotNull(), F.sort_array(places)))
    covered = F.aggregate(
        "places", F.struct(F.lit(0).cast("long").alias("total"), F.lit(-_WINDOW).alias("last")),
        lambda a, i: F.struct((a["total"] + F.least(F.lit(_WINDOW), i - a["last"])).alias("total"), i.alias("last")),
        lambda a: a["total"],
    )
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("t", "w", "lines", "g", "s", "places")


def held_lines(docs: DataFrame) -> DataFrame:
    """``docs``: host, holder, text_hash, t. Per source, holder, text and line: host, holder, text_hash, line_hash and
    words (of all the line's places in the text)."""
    lines = docs.select("host", "holder", "text_hash", F.posexplode(F.split("t", "\n")).alias("place", "line"))
    norm: Column = F.trim(F.regexp_replace(ascii_lower(F.col("line")), SPACES, " "))
    return (
        lines.select("host", "holder", "text_hash", "place", F.xxhash64(norm).alias("line_hash"), word_count(F.col("line")).alias("words"))
        .where("words > 0")
        .groupBy("host", "holder", "text_hash", "line_hash").agg(F.max("words").alias("once"), F.count_distinct("place").alias("places"))
        .select("host", "holder", "text_hash", "line_hash", (F.col("once") * F.col("places")).alias("words"))
    )


def judged(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", by_text: bool = False, limit: int = LIMIT) -> DataFrame:
    """Per row of ``docs``: doc_id, the base metrics, base_failed, n_removed_words and kept.

    A null text is empty, so it fails the base rules; a null source is a source of its own. Rows with one id are one
    document; a row without an id is told from others by its text. Repeated rows are answered alike. With ``by_text``
    distinct texts are counted in place of documents. Other columns are ignored; an empty table gives no rows."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("host"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("text_hash", F.xxhash64("t"))
    named = F.col("text_hash") if by_text else F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text_hash")))
    lines = staged(held_lines(rows.withColumn("holder", named)), "lines")
    common = lines.groupBy("host", "line_hash").agg(F.count_distinct("holder").alias("n")).where(F.col("n") > limit)
    removed = (
        join_null_safe(lines.drop("holder"), common.select("host", "line_hash"), ["host", "line_hash"]).distinct()
        .groupBy("host", "text_hash").agg(F.sum("words").alias("n_removed_words"))
    )
    out = join_null_safe(base_metrics(rows), removed, ["host", "text_hash"], "left").withColumns({
        "n_removed_words": F.coalesce("n_removed_words", F.lit(0).cast("long")),
        "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    })
    left = F.col("n_words") - F.col("n_removed_words")
    return out.withColumn("kept", ~F.col("base_failed") & (left >= LEFT_WORDS) & (left >= LEFT_PART * F.col("n_words"))).drop("host", "text_hash")


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))


def op3_line_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), by_text=True)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, w[i:i+4] AS g FROM d, unnest(range(1, len(w) - 3)) AS u(i)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1
), cover AS (
  SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM rep, unnest(range(0, 5)) AS u(k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, source, t, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
         trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm
  FROM d, unnest(string_split(t, chr(10))) AS u(line)
), common AS (
  SELECT source, norm FROM lines WHERE words > 0 GROUP BY source, norm HAVING count(DISTINCT doc_id) > 20
), dup AS (
  SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM lines WHERE words > 0 GROUP BY doc_id
), removed AS (
  SELECT doc_id, sum(words)::BIGINT AS n_removed_words FROM lines l JOIN common c ON l.source IS NOT DISTINCT FROM c.source AND l.norm = c.norm
  WHERE words > 0 GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_removed_words, 0) AS n_removed_words
  FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN removed USING (doc_id)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - n_removed_words >= 10
       AND n_words - n_removed_words >= 0.2 * n_words AS kept
FROM m
"""

#: The same by distinct texts.
ORACLE_LIMIT = ORACLE.replace("count(DISTINCT doc_id) > 20", "count(DISTINCT t) > 20")
