"""The engine's tables laid over the generic star schema: orders as messages, events as events, nations and parts as organizations.

Each has a DataFrame and the SQL that defines the same rows, for comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text


#: Tables of texts, on which Python and regular expressions work long.
TEXTS = ("documents", "pages", "conversations")
DEALT_BYTES = 256 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. One of texts, of DEALT_BYTES at most, that lies in fewer pieces than there are cores is dealt to all of them."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name not in TEXTS or rows.rdd.getNumPartitions() >= cores:
        return rows
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size <= DEALT_BYTES else rows


#: Rows that one task of a step in Python gets, about, and the bytes of a row in its file, at least.
DEALT_ROWS, DEALT_BYTES_A_ROW = 50_000, 2


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt to tasks of about DEALT_ROWS, one for each core at least: a compressed table of short rows lies in few pieces, whatever work each row makes."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(max(cores, min(size // (DEALT_ROWS * DEALT_BYTES_A_ROW), 10_000)))


def list_of(status: Column) -> Column:
    return F.when(status == "F", "WHITMANWIRE").when(status == "O", "BUTLERBUZZ").otherwise("FREEFOOD")


LIST_SQL = "CASE o_orderstatus WHEN 'F' THEN 'WHITMANWIRE' WHEN 'O' THEN 'BUTLERBUZZ' ELSE 'FREEFOOD' END"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as messages: a customer's orders of one day are copies of the first."""
    orders, customers, nations = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    first = F.min("o_orderkey").over(Window.partitionBy("o_custkey", "o_orderdate"))
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("first", first)
    none = F.lit(None).cast("string")
    return rows.select(
        F.col("o_orderkey").cast("string").alias("id"), list_of(F.col("o_orderstatus")).alias("listserv"), F.col("o_orderkey").cast("string").alias("archive_id"), none.alias("source_url"), F.col("o_orderpriority").alias("subject"),
        F.col("c_name").alias("sender_name"), F.concat(F.lower("c_mktsegment"), F.lit("@example.edu")).alias("sender_email"), none.alias("via"), none.alias("sender_attribution"), F.col("o_orderdate").cast("timestamp").alias("sent_at"), F.lit("").alias("preview"),
        F.concat_ws(" ", "o_orderpriority", "c_mktsegment", "n_name").alias("body_text"), none.alias("body_html"), (F.col("o_totalprice") >= 150000).alias("complete"), F.array().cast("array<string>").alias("links"),
        F.array().cast("array<struct<id: string, url: string, kind: string, name: string, alt: string, width: int, height: int>>").alias("media"), none.alias("rfc_message_id"), none.alias("delivery_key"), F.lit(False).alias("headers_complete"),
        F.when(F.col("first") != F.col("o_orderkey"), F.col("first").cast("string")).alias("canonical_id"), F.col("c_mktsegment").alias("category"), F.concat(F.lit("mpu:"), F.col("n_nationkey").cast("string")).alias("organization_id"),
        F.col("n_name").alias("organization_name"), F.lit("high").alias("org_confidence"), F.lit(None).cast("struct<evidence: array<string>, hash: string>").alias("org_evidence"), F.lit("2.4").alias("classifier_version"), none.alias("extraction_version"),
        F.lit(None).cast("boolean").alias("is_event"), F.col("o_orderdate").cast("timestamp").alias("ingested_at"), F.col("o_orderkey").cast("long").alias("revision"),
    )


MESSAGES_SQL = f"""messages AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, {LIST_SQL} AS listserv, o_orderpriority AS subject, c_name AS sender_name, lower(c_mktsegment) || '@example.edu' AS sender_email, o_orderdate AS sent_at,
 o_orderpriority || ' ' || c_mktsegment || ' ' || n_name AS body_text, o_totalprice >= 150000 AS complete,
 CASE WHEN min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderdate) <> o_orderkey THEN CAST(min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderdate) AS VARCHAR) END AS canonical_id,
 c_mktsegment AS category, 'mpu:' || n_nationkey AS organization_id, n_name AS organization_name, CAST(o_orderkey AS BIGINT) AS revision
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
bridge AS (SELECT DISTINCT coalesce(canonical_id, id) AS message_id, listserv FROM messages)"""


def bridge(rows: DataFrame) -> DataFrame:
    return rows.select(F.coalesce("canonical_id", "id").alias("message_id"), "listserv").distinct()


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as events: signups are official, the rest come from lists; a user is a host, a key of props a place."""
    e = table(spark, sf_dir, "events")
    none = F.lit(None).cast("string")
    starts = F.col("ts").cast("timestamp")
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").cast("string").alias("id"), F.when(kind == "signup", "myprincetonu").otherwise("listserv").alias("source"), (F.col("event_id") % 15000 + 1).cast("string").alias("message_id"), F.lit(0).alias("idx"),
        F.col("event_id").cast("string").alias("external_id"), none.alias("external_url"), none.alias("image_url"), F.when(kind == "error", "withdrawn").otherwise("active").alias("status"), none.alias("duplicate_of"),
        F.concat(kind, F.lit(" for item "), "props").alias("title"), F.concat(kind, F.lit(" of user "), F.col("user_id").cast("string")).alias("summary"), starts.alias("starts_at"),
        F.when(F.col("value") > 50, starts + F.make_dt_interval(F.lit(0), F.lit(2))).alias("ends_at"), F.lit("exact").alias("time_precision"), none.alias("location_text"), F.get_json_object("props", "$.k").alias("location_id"), none.alias("location_name"),
        F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"), none.alias("room"), F.lit(False).alias("online"), F.array(kind, F.concat(F.lit("k"), F.get_json_object("props", "$.k"))).alias("tags"),
        (kind == "purchase").alias("free_food"), none.alias("rsvp_url"), F.concat(F.lit("mpu:"), F.col("user_id").cast("string")).alias("host_org_id"), F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("host_org_name"),
        F.lit(1.0).alias("confidence"), (F.col("value") > 20).alias("publishable"), F.lit("rules-1").alias("extraction_version"), none.alias("series_id"), F.lit(None).cast("int").alias("series_size"), starts.alias("created_at"), starts.alias("updated_at"),
        F.col("event_id").cast("long").alias("revision"),
    )


EVENTS_SQL = """ev AS (SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_type = 'signup' THEN 'myprincetonu' ELSE 'listserv' END AS source, CAST(event_id % 15000 + 1 AS VARCHAR) AS message_id,
 CASE WHEN event_type = 'error' THEN 'withdrawn' ELSE 'active' END AS status, event_type || ' for item ' || props AS title, event_type || ' of user ' || user_id AS summary, ts AS starts_at,
 CASE WHEN value > 50 THEN ts + INTERVAL 2 HOUR END AS ends_at, json_extract_string(props, '$.k') AS location_id, event_type AS tag, 'k' || json_extract_string(props, '$.k') AS ktag, event_type = 'purchase' AS free_food,
 'mpu:' || user_id AS host_org_id, 'User ' || user_id AS host_org_name, value > 20 AS publishable, ts AS created_at, CAST(event_id AS BIGINT) AS revision FROM events)"""


def organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as organizations; their regions are group types and categories."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    profile = F.from_json(F.to_json(F.struct(F.lower("n_name").alias("acronym"))), "tagline string, description string, whatWeDo string, goals string, website string, email string, instagram string, facebook string, linkedin string, twitter string, youtube string, acronym string, memberCount int")
    return rows.select(
        F.concat(F.lit("mpu:"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.array(F.concat(F.lit("Club of "), "n_name")).alias("aliases"), F.col("r_name").alias("group_type"), F.array("r_name").alias("categories"),
        F.array().cast("array<string>").alias("urls"), F.lit(True).alias("url_subdomains"), F.array().cast("array<string>").alias("sources"), profile.alias("profile"),
    )


def phrased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with one of several known phrases put before the text, so that keyword rules have something to find."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "text", "source", F.concat(F.element_at(text.any_of(PHRASES), (F.col("doc_id") % len(PHRASES) + 1).cast("int")), F.lit("\n"), F.col("text")).alias("phrased"), F.element_at(text.any_of(PHRASES), (F.col("doc_id") % len(PHRASES) + 1).cast("int")).alias("phrase"))


PHRASES = (
    "Free pizza at the study break", "Apply for the summer internship", "Jazz concert tonight", "Guest lecture by a professor", "RSVP for the game night tournament", "Nothing special here",
    "Machine learning hackathon", "Selling my desk", "Volunteer for community service", "Yoga and mindfulness in the garden", "[CLUB] Re: Board games THIS Tuesday @4:30 in Hall 207", "TONIGHT: Free boba",
)
PHRASED_SQL = "phrased AS (SELECT doc_id, text, source, (list_value(" + ", ".join(f"'{p}'" for p in PHRASES) + f"))[CAST(doc_id % {len(PHRASES)} + 1 AS INT)] AS phrase FROM documents)"
