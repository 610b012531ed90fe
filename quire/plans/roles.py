"""The driver's tables in the roles that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as books."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages of their customer's book."""
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("flagged")
    failed = F.when(F.col("o_orderpriority").startswith("1"), 2).otherwise(0)
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("page_no"), status.alias("status"), failed.alias("attempts"), F.lit("e").alias("last_error"), F.lit("r").alias("flag_reason"), F.lit(1.0).alias("claimed_at"), F.lit(1.0).alias("updated_at"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as page results: the source is the book, the id the page."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("book"), book_of("source").alias("book_id"), F.col("doc_id").alias("page_no"), F.lit("text").alias("page_type"), F.col("text").alias("transcription"), F.lit("").alias("footnotes"), "n_chars", "lang")


def book_of(source: str):
    return F.regexp_extract(source, "[0-9]+", 0).cast("long")


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages numbered 1, 2, ... in each book, without their texts."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("book_id").orderBy("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", book_of("source").alias("book_id"), "n_chars").withColumn("page_no", n)


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as outcomes of their user's key."""
    from pyspark.sql import Window as W

    kind = F.when(F.col("event_type") == "error", "rate_limited").when(F.col("event_type") == "signup", "transient").otherwise("success")
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key_id"), seq.cast("long").alias("seq"), "ts", "event_id", kind.alias("outcome"), F.when(F.col("value") > 45, "Requests per day").otherwise("slow down").alias("message"), F.when(F.col("value") > 10, F.col("value")).alias("retry_after"), F.lit(None).cast("long").alias("rpd"))


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as keys: what they did on the last day of the table, with limits from their id."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", F.to_date("ts").alias("day"))
    last = e.agg(F.max("day").alias("last"))
    per = e.crossJoin(F.broadcast(last)).groupBy("user_id").agg(F.count_if(F.col("day") == F.col("last")).alias("used_today"), (F.unix_micros(F.max("ts").cast("timestamp")) / 1e6).alias("last_used_at"))
    u = F.col("user_id")
    state = F.when(u % 11 == 3, "dead").when(u % 7 == 2, "exhausted").when(u % 5 == 1, "cooldown").otherwise("active")
    return per.select(u.alias("key_id"), F.concat(F.lit("key-"), u.cast("string")).alias("label"), F.concat(F.lit("secret-"), (u % 97).cast("string")).alias("secret"), (u % 4 * 10).cast("int").alias("rpm_limit"), (u % 5 + 1).alias("rpd_limit"), state.alias("state"), (u % 6 != 0).alias("enabled"), "used_today", F.when(state == "cooldown", F.col("last_used_at") + 40.0).otherwise(0.0).alias("cooldown_until"), "last_used_at")


#: The same roles for DuckDB.
SQL = {
    "books": "SELECT c_custkey AS id, c_name AS title FROM customer",
    "pages": "SELECT o_custkey AS book_id, o_orderkey AS page_no, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'flagged' END AS status, CASE WHEN o_orderpriority LIKE '1%' THEN 2 ELSE 0 END AS attempts FROM orders",
    "docs": "SELECT doc_id, source AS book, CAST(regexp_extract(source, '[0-9]+') AS BIGINT) AS book_id, doc_id AS page_no, 'text' AS page_type, text AS transcription, n_chars, lang FROM documents",
    "numbered": "SELECT doc_id, CAST(regexp_extract(source, '[0-9]+') AS BIGINT) AS book_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_no, n_chars FROM documents",
    "outcomes": "SELECT user_id AS key_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, ts, CASE event_type WHEN 'error' THEN 'rate_limited' WHEN 'signup' THEN 'transient' ELSE 'success' END AS outcome, value > 45 AS daily, CASE WHEN value > 10 THEN value END AS retry_after FROM events",
    "keys": """SELECT user_id AS key_id, 'key-' || user_id AS label, 'secret-' || user_id % 97 AS secret, CAST(user_id % 4 * 10 AS INTEGER) AS rpm_limit, user_id % 5 + 1 AS rpd_limit,
      CASE WHEN user_id % 11 = 3 THEN 'dead' WHEN user_id % 7 = 2 THEN 'exhausted' WHEN user_id % 5 = 1 THEN 'cooldown' ELSE 'active' END AS state, user_id % 6 <> 0 AS enabled, used_today, last_used_at,
      CASE WHEN user_id % 11 <> 3 AND user_id % 7 <> 2 AND user_id % 5 = 1 THEN last_used_at + 40.0 ELSE 0.0 END AS cooldown_until
      FROM (SELECT user_id, count(*) FILTER (CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)) AS used_today, epoch_us(max(ts)) / 1e6 AS last_used_at FROM events GROUP BY user_id)""",
}


def with_roles(sql: str, *names: str) -> str:
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + (", " if sql.lstrip().startswith("--") else " ") + sql.lstrip().removeprefix("--")
