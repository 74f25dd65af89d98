"""Sources: table and dataset readers, document discovery, and adapters that give the library's relations.

Adapters only rename and derive columns, so filters and column selections reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def table_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table, or an empty one of the schema where the path doesn't exist (IO8)."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def discovered(spark: SparkSession, folder: str, pattern: str = "*", name_regex: str = r"(\d{4})[^\d]+(\d)") -> DataFrame:
    """(path, length, year, round) of files under a folder, by name (IO1, IO4); content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    part = lambda i: F.nullif(F.regexp_extract(name, name_regex, i), F.lit("")).cast("int")
    return files.select("path", "length", part(1).alias("year"), part(2).alias("round"))


def content_addressed(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(sha256, path) with one path, the least, of each different content (IO14)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.sha2("content", 256).alias("sha256")).groupBy("sha256").agg(F.min("path").alias("path"))


def verified(spark: SparkSession, folder: str, expected: DataFrame, pattern: str = "*") -> DataFrame:
    """(name, state) of a lock list (name, sha256) against a folder's files: ok, changed, missing, or unlisted (IO18). Files of one name count as ok if one of them is."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    found = files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.sha2("content", 256).alias("_found"))
    state = F.when(F.col("sha256").isNull(), "unlisted").when(F.col("_found").isNull(), "missing").when(F.col("sha256") == F.col("_found"), "ok").otherwise("changed")
    rows = expected.select("name", "sha256").join(found, "name", "full").select("name", state.alias("state"))
    return rows.groupBy("name").agg(F.max("state").alias("state"))  # ok is the last by name of ok, missing and changed


def text_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of JSON arrays (IO3); a record that isn't one fails the read."""
    return spark.read.schema("file string, text string").option("multiLine", "true").option("mode", "FAILFAST").json(path)


def exam_questions(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A row per question of nested exam documents (IO5), with the exam's own columns."""
    exams = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    return exams.select(*[c for c in exams.columns if c != "questions"], F.explode("questions").alias("q")).select("*", "q.*").drop("q")


def by_exam(questions: DataFrame) -> DataFrame:
    """(exam_id, questions): questions grouped by exam, in order of number (IO6)."""
    exam = F.coalesce(F.col("exam_id"), F.concat(F.lit("unknown_"), F.coalesce(F.col("exam_year").cast("string"), F.lit("")), F.lit("_r"), F.coalesce(F.col("exam_round").cast("string"), F.lit(""))))
    own = F.struct("number", *[c for c in questions.columns if c not in ("number", "exam_id")])
    return questions.withColumn("exam_id", exam).groupBy("exam_id").agg(F.sort_array(F.collect_list(own)).alias("questions"))


def topic_days(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse topic x period counts (domain, topic, year, cnt): users by event type and day of month."""
    e = table(spark, folder, "events").filter(F.col("ts").isNotNull())
    return e.groupBy(F.col("event_type").alias("domain"), F.col("user_id").alias("topic"), F.dayofmonth("ts").alias("year")).agg(F.count("*").alias("cnt"))


#: Lines from which the fact relation is dealt by order to parts of so many lines, whatever the session's number of partitions.
MANY, PART_LINES = 4_000_000, 250_000


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """The fact relation: a row per line of an order, with the part's kind and the order's date.

    Of many lines, the last join is by order in parts whose number grows with the lines, so that what a task holds doesn't;
    what then groups by exam_id stays in these parts.
    """
    line = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_shipdate")
    order = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    part = table(spark, folder, "part").select("p_partkey", "p_type", "p_brand", "p_size", "p_name")
    by_order, by_part = F.col("l_orderkey") == F.col("o_orderkey"), F.col("l_partkey") == F.col("p_partkey")
    lines = line.count()
    if lines < MANY:
        rows = line.join(order, by_order).join(part, by_part)
    else:
        parts = -(-lines // PART_LINES)
        rows = line.join(part.hint("shuffle_hash"), by_part).repartition(parts, "l_orderkey").join(order.repartition(parts, "o_orderkey"), by_order)
    return rows.select(
        F.col("l_orderkey").alias("exam_id"),
        F.col("o_custkey").alias("student"),
        F.col("p_type").alias("domain"),
        F.col("p_brand").alias("topic"),
        F.col("p_name").alias("name"),
        F.year("o_orderdate").alias("exam_year"),
        F.when(F.month("o_orderdate") <= 6, 1).otherwise(2).alias("exam_round"),
        F.col("l_linenumber").alias("number"),
        F.col("p_size").alias("difficulty"),
        (F.lit(1.0) - F.col("l_discount")).alias("confidence"),
        F.col("l_returnflag").alias("error_type"),
        F.col("l_quantity").alias("weight"),
        F.col("o_orderpriority").alias("format"),
        F.col("o_orderdate").alias("date"),
        F.col("l_shipdate").alias("shipped"),
    )


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    """(student, topic, ts, correct, value) of a learner's answers."""
    e = table(spark, folder, "events")
    return e.select(F.col("user_id").alias("student"), F.col("event_type").alias("topic"), "ts", (F.col("event_type") != "error").alias("correct"), "value", "event_id")


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """(student, exam, date, score), an exam result per row."""
    o = table(spark, folder, "orders")
    return o.select(F.col("o_custkey").alias("student"), F.col("o_orderkey").alias("exam"), F.col("o_orderdate").alias("date"), F.col("o_totalprice").alias("score"))


def month_index(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date)


#: The adapters as SQL common table expressions, for the queries' equivalents.
SQL = {
    "matrix": "matrix AS (SELECT event_type AS domain, user_id AS topic, CAST(day(ts) AS INTEGER) AS year, count(*) AS cnt FROM events WHERE ts IS NOT NULL GROUP BY ALL)",
    "questions": "questions AS (SELECT l_orderkey AS exam_id, o_custkey AS student, p_type AS domain, p_brand AS topic, p_name AS name, CAST(year(o_orderdate) AS INTEGER) AS exam_year, "
    "CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 2 END AS exam_round, l_linenumber AS number, p_size AS difficulty, 1.0 - l_discount AS confidence, "
    "l_returnflag AS error_type, l_quantity AS weight, o_orderpriority AS format, o_orderdate AS date, l_shipdate AS shipped "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)",
    "attempts": "attempts AS (SELECT user_id AS student, event_type AS topic, ts, event_type <> 'error' AS correct, value, event_id FROM events)",
    "scores": "scores AS (SELECT o_custkey AS student, o_orderkey AS exam, o_orderdate AS date, o_totalprice AS score FROM orders)",
}
