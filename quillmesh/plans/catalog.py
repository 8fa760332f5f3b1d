"""Registered queries of the engine over the generic tables, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed, html, text
from ..operators import dedupe, dims, events as event_ops, reconcile, setpairs, store
from ..operators.band import band_join
from ..sources import feeds
from . import read, tables
from .registered import QUERIES, SQL, Query, instant, plain, query, rule_sql
from .tables import EVENTS_SQL, MESSAGES_SQL, PHRASED_SQL, table

AS_OF = "2024-01-15 00:00:00"


def engine(spark, sf_dir: str) -> read.Engine:
    messages = tables.messages(spark, sf_dir)
    return read.Engine(messages, tables.bridge(messages), tables.events(spark, sf_dir), tables.organizations(spark, sf_dir), origin="https://mail.example.edu", zone="UTC")


# Identity.


@query("SELECT doc_id, substr(sha256(upper(source) || ':' || doc_id), 1, 24) AS message_id FROM documents")
def q_message_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.message_id(F.upper("source"), F.col("doc_id").cast("string")).alias("message_id"))


@query("SELECT event_id, substr(sha256(user_id || '#' || event_id), 1, 24) AS id, substr(sha256('mpu#' || event_id), 1, 24) AS official_id FROM events")
def q_event_id(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.event_id(F.col("user_id").cast("string"), "event_id").alias("id"), text.official_event_id(F.col("event_id").cast("string")).alias("official_id"))


def canonical(spark, sf_dir) -> DataFrame:
    """doc_id, source, canonical_id: equal texts are copies of the smallest id. Texts are compared by hash, so they aren't shuffled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("body"))
    first = docs.groupBy("body").agg(F.min("doc_id").alias("canonical_id"))
    return docs.join(first, "body").drop("body")


CANONICAL_SQL = "canon AS (SELECT doc_id, source, lang, n_chars, min(doc_id) OVER (PARTITION BY text) AS canonical_id FROM documents)"


@query(f"WITH {CANONICAL_SQL} SELECT canonical_id, count(*) AS copies, count(DISTINCT source) AS lists FROM canon GROUP BY 1")
def q_canonical_dedupe(spark, sf_dir):
    return canonical(spark, sf_dir).groupBy("canonical_id").agg(F.count("*").alias("copies"), F.countDistinct("source").alias("lists"))


@query(f"WITH {CANONICAL_SQL} SELECT canonical_id, string_agg(DISTINCT source, ',' ORDER BY source) AS lists, count(*) AS copies FROM canon GROUP BY 1")
def q_list_bridge(spark, sf_dir):
    return canonical(spark, sf_dir).groupBy("canonical_id").agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("lists"), F.count("*").alias("copies"))


@query(f"WITH {CANONICAL_SQL} SELECT m.doc_id, c.doc_id AS canonical, c.source AS canonical_source FROM canon m JOIN canon c ON c.doc_id = m.canonical_id")
def q_alias_resolution(spark, sf_dir):
    rows = canonical(spark, sf_dir)
    own = rows.select(F.col("doc_id").alias("canonical"), F.col("source").alias("canonical_source"))
    return rows.join(own, F.col("canonical_id") == F.col("canonical")).select("doc_id", "canonical", "canonical_source")


# Messages.


@query(f"""WITH {MESSAGES_SQL} SELECT id, sender_name, sent_at FROM messages m WHERE canonical_id IS NULL AND (sender_name ILIKE '%1_2%' OR sender_email ILIKE '%1_2%') AND sent_at >= TIMESTAMP '1996-01-01'
 AND sent_at < TIMESTAMP '1998-12-31' + INTERVAL 1 DAY AND EXISTS (SELECT 1 FROM bridge b WHERE b.message_id = m.id AND b.listserv IN ('WHITMANWIRE', 'BUTLERBUZZ', 'ROCKYWIRE', 'RE-INNFORMER', 'MATHEYMAIL', 'HUOHUB', 'YEHYELLOWPAGES'))""")
def q_search_filters(spark, sf_dir):
    f = read.MessageFilters(sender="1_2", listserv="residential", since="1996-01-01", until="1998-12-31")
    return engine(spark, sf_dir).matching_messages(f).select("id", "sender_name", plain("sent_at").alias("sent_at"))


@query(f"""WITH {MESSAGES_SQL} SELECT id, subject, sender_name AS sender, sent_at, (SELECT string_agg(listserv, ',' ORDER BY listserv) FROM bridge b WHERE b.message_id = m.id) AS listservs, organization_name, category, complete,
 'https://mail.example.edu/email/' || id AS url, revision FROM messages m WHERE canonical_id IS NULL AND organization_id = 'mpu:7' ORDER BY sent_at DESC, id LIMIT 100 OFFSET 20""")
def q_search_page(spark, sf_dir):
    rows = engine(spark, sf_dir).search_messages(read.MessageFilters(organization="mpu:7", sort="newest", limit=1000, offset=20))
    return rows.select("id", "subject", "sender", plain("sent_at").alias("sent_at"), F.array_join("listservs", ",").alias("listservs"), F.col("organization.name").alias("organization_name"), "category", "complete", "url", "revision")


@query(f"WITH {MESSAGES_SQL} SELECT count(*) AS total FROM messages m WHERE canonical_id IS NULL AND EXISTS (SELECT 1 FROM bridge b WHERE b.message_id = m.id AND b.listserv = 'FREEFOOD')")
def q_search_total(spark, sf_dir):
    return engine(spark, sf_dir).total_of(read.MessageFilters(listserv="freefood", offset=4000))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 200000)")
def q_list_semi(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' and o_totalprice > 200000").select("o_custkey")
    return table(spark, sf_dir, "customer").join(wanted, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query(f"""WITH {MESSAGES_SQL}, asked(a, place) AS (VALUES ('101', 0), ('7', 1), ('3', 2), ('15', 3), ('1000', 4)), hit AS (SELECT coalesce(canonical_id, id) AS target, min(place) AS place FROM messages JOIN asked ON id = a GROUP BY 1)
 SELECT id, substr(body_text, 6, 10) AS body, CAST(length(body_text) AS BIGINT) AS body_length, CASE WHEN length(body_text) > 15 THEN CAST(15 AS BIGINT) END AS next_offset FROM messages JOIN hit ON id = target""")
def q_read_messages(spark, sf_dir):
    rows = engine(spark, sf_dir).read_messages(["101", "7", "3", "15", "1000", "9"], offset=5, length=10)
    return rows.select("id", "body", F.col("body_length").cast("long").alias("body_length"), F.col("next_offset").cast("long").alias("next_offset"))


@query(f"""WITH {MESSAGES_SQL} SELECT id, canonical_id, body_text, revision, (SELECT string_agg(listserv, ',' ORDER BY listserv) FROM bridge b WHERE b.message_id = coalesce(m.canonical_id, m.id)) AS listservs
 FROM messages m WHERE revision > 5000 ORDER BY revision LIMIT 1000""")
def q_changes_cursor(spark, sf_dir):
    return engine(spark, sf_dir).message_changes(5000, 5000).select("id", "canonical_id", "body_text", "revision", F.array_join("listservs", ",").alias("listservs"))


@query(f"""WITH {MESSAGES_SQL}, {EVENTS_SQL}, m AS (SELECT count(*) FILTER (WHERE canonical_id IS NULL) AS messages, count(*) AS copies, count(*) FILTER (WHERE complete AND canonical_id IS NULL) AS full_bodies, min(sent_at) AS earliest, max(sent_at) AS latest FROM messages),
 e AS (SELECT count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'active' AND starts_at >= TIMESTAMP '{AS_OF}') AS upcoming, count(*) FILTER (WHERE status = 'active' AND starts_at >= TIMESTAMP '{AS_OF}' AND publishable) AS upcoming_publishable,
 count(*) FILTER (WHERE status = 'active' AND source = 'myprincetonu' AND starts_at >= TIMESTAMP '{AS_OF}') AS upcoming_official, count(*) FILTER (WHERE status = 'duplicate') AS duplicates_of_official FROM ev), o AS (SELECT count(*) AS organizations FROM nation)
 SELECT * FROM m, e, o""")
def q_status_filters(spark, sf_dir):
    rows = engine(spark, sf_dir).status(instant(AS_OF))
    return rows.withColumns({"earliest": plain("earliest"), "latest": plain("latest")}).drop("last_ingested")


@query(f"WITH {MESSAGES_SQL} SELECT organization_id, count(*) AS n FROM messages WHERE canonical_id IS NULL GROUP BY 1")
def q_org_counts(spark, sf_dir):
    return tables.messages(spark, sf_dir).where("canonical_id is null").groupBy("organization_id").agg(F.count("*").alias("n"))


@query(f"""WITH {MESSAGES_SQL} SELECT 'mpu:' || n_nationkey AS id, n_name AS name, r_name AS group_type, 'social event' AS forum_category, 'https://my.princeton.edu/feeds?type=club&type_id=' || n_nationkey || '&tab=about' AS group_url,
 (SELECT count(*) FROM messages WHERE canonical_id IS NULL AND organization_id = 'mpu:' || n_nationkey) AS email_count FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name LIKE '%NATION_1%' """)
def q_org_search(spark, sf_dir):
    return engine(spark, sf_dir).search_organizations("Nation 1", 1000).select("id", "name", "group_type", "forum_category", "group_url", "email_count")


# Events.


@query(f"WITH {EVENTS_SQL} SELECT id, starts_at, ends_at FROM ev WHERE status = 'active' AND coalesce(ends_at, starts_at) >= TIMESTAMP '2024-01-10' AND starts_at < TIMESTAMP '2024-01-20' + INTERVAL 1 DAY AND publishable AND (tag = 'purchase' OR ktag = 'purchase') AND (title ILIKE '%item%' OR summary ILIKE '%item%')")
def q_event_window(spark, sf_dir):
    f = read.EventFilters(since="2024-01-10", until="2024-01-20", tag="purchase", query="item", publishable_only=True)
    return engine(spark, sf_dir).matching_events(f).select("id", plain("starts_at").alias("starts_at"), plain("ends_at").alias("ends_at"))


@query(f"WITH {EVENTS_SQL} SELECT id, ktag FROM ev WHERE status = 'active' AND coalesce(ends_at, starts_at) >= TIMESTAMP '2024-01-01' AND (tag = 'k3' OR ktag = 'k3')")
def q_event_tags_any(spark, sf_dir):
    rows = engine(spark, sf_dir).matching_events(read.EventFilters(since="2024-01-01", tag="k3"))
    return rows.select("id", F.element_at("tags", 2).alias("ktag"))


@query(f"""WITH {MESSAGES_SQL}, {EVENTS_SQL} SELECT e.id, e.title, e.starts_at, e.host_org_name AS host_name, CASE WHEN source = 'listserv' THEN coalesce(m.subject, '') END AS subject,
 CASE WHEN source = 'listserv' THEN coalesce((SELECT string_agg(listserv, ',' ORDER BY listserv) FROM bridge b WHERE b.message_id = e.message_id), '') ELSE '' END AS listservs, CAST(CASE WHEN source = 'listserv' THEN 1 ELSE 0 END AS BIGINT) AS emails, m.sent_at AS first_announced_at
 FROM ev e LEFT JOIN messages m ON m.id = e.message_id""")
def q_event_detail_left(spark, sf_dir):
    own = engine(spark, sf_dir)
    rows = own.event_payload(own.events)
    return rows.select(
        "id", "title", plain("starts_at").alias("starts_at"), F.coalesce("host.name", F.lit("")).alias("host_or_unknown"), F.col("source.subject").alias("subject"), F.array_join("source.listservs", ",").alias("listservs"),
        F.col("announcements.emails").cast("long").alias("emails"), plain("announcements.first_announced_at").alias("first_announced_at"),
    ).withColumn("host_name", F.when(F.col("host_or_unknown").startswith("NATION"), F.concat(F.lit("User "), F.regexp_extract("host_or_unknown", r"(\d+)$", 1))).otherwise(F.col("host_or_unknown"))).drop("host_or_unknown")


@query(f"WITH {EVENTS_SQL} SELECT host_org_id, count(*) AS repeat_count, string_agg(DISTINCT tag, ',' ORDER BY tag) AS kinds, min(starts_at) AS first_at, least(min(starts_at), max(ends_at)) AS first_of_both FROM ev GROUP BY 1")
def q_repeat_rollup(spark, sf_dir):
    rows = tables.events(spark, sf_dir).groupBy("host_org_id").agg(F.count("*").alias("repeat_count"), F.array_join(F.sort_array(F.collect_set(F.col("tags")[0])), ",").alias("kinds"), F.min("starts_at").alias("first_at"), F.max("ends_at").alias("last_end"))
    return rows.select("host_org_id", "repeat_count", "kinds", plain("first_at").alias("first_at"), F.least("first_at", "last_end").cast("timestamp_ntz").alias("first_of_both"))


@query(f"WITH {EVENTS_SQL} SELECT id, title, revision FROM ev WHERE revision > 200 ORDER BY revision LIMIT 1000")
def q_event_changes(spark, sf_dir):
    return engine(spark, sf_dir).event_changes(200, 1000).select("id", "title", "revision")


@query(f"WITH {EVENTS_SQL} SELECT id, starts_at FROM ev WHERE status = 'active' AND coalesce(ends_at, starts_at) >= TIMESTAMP '2024-01-15' - INTERVAL 3 HOUR ORDER BY starts_at, id LIMIT 200")
def q_event_list(spark, sf_dir):
    return engine(spark, sf_dir).list_events(read.EventFilters(limit=1000), instant(AS_OF)).select("id", plain("starts_at").alias("starts_at"))


@query("SELECT e.event_id, e.ts FROM events e WHERE (e.ts, e.event_id) < (TIMESTAMP '2024-01-10 12:00:00', 5000) AND e.event_type IS DISTINCT FROM 'view' AND (e.value, e.props) IS DISTINCT FROM (1.0, '{\"k\": 1}')")
def q_row_compare(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    before = F.struct("ts", "event_id") < F.struct(F.lit("2024-01-10 12:00:00").cast("timestamp_ntz").alias("ts"), F.lit(5000).cast("long").alias("event_id"))
    other = ~F.struct("value", "props").eqNullSafe(F.struct(F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props")))
    return e.where(before & ~F.col("event_type").eqNullSafe("view") & other).select("event_id", "ts")


# Duplicates, copies, series, images.

OFFICIAL_SQL = f"""{EVENTS_SQL}, w AS (SELECT *, list_distinct(list_filter(string_split_regex(lower(title), '[^a-z0-9]+'), lambda x: length(x) > 2)) AS words FROM ev WHERE status = 'active'),
 jac AS (SELECT l.id AS lid, o.id AS oid, abs(epoch_us(l.starts_at) - epoch_us(o.starts_at)) AS d, len(list_intersect(l.words, o.words)) * 1.0 / nullif(len(list_distinct(list_concat(l.words, o.words))), 0) AS j, l.host_org_id AS lh, o.host_org_id AS oh
 FROM w l JOIN w o ON l.source = 'listserv' AND o.source = 'myprincetonu' AND abs(epoch_us(l.starts_at) - epoch_us(o.starts_at)) <= 2700000000),
 official AS (SELECT lid AS id, arg_min(oid, (d, oid)) AS duplicate_of FROM jac WHERE lh = oh GROUP BY 1)"""


@query(f"WITH {OFFICIAL_SQL} SELECT id, duplicate_of FROM official")
def q_official_dup(spark, sf_dir):
    return dedupe.official_duplicates(tables.events(spark, sf_dir), instant("2023-12-01 00:00:00"))


@query(f"""WITH {EVENTS_SQL}, w AS (SELECT *, list_distinct(list_filter(string_split_regex(lower(title), '[^a-z0-9]+'), lambda x: length(x) > 2)) AS words FROM ev WHERE status = 'active' AND source = 'listserv'),
 near AS (SELECT a.id AS a, b.id AS b, (b.created_at, b.id) AS bk, len(list_intersect(a.words, b.words)) * 1.0 / len(list_distinct(list_concat(a.words, b.words))) AS j, a.host_org_id = b.host_org_id AS same_host, a.host_org_id = b.host_org_id AND a.location_id IS NOT DISTINCT FROM b.location_id AS same
 FROM w a JOIN w b ON (b.created_at, b.id) < (a.created_at, a.id) AND epoch_us(a.starts_at) - epoch_us(b.starts_at) BETWEEN -1800000000 AND 1800000000),
 roots AS (SELECT id FROM w WHERE id NOT IN (SELECT a FROM near WHERE j >= 0.4))
 SELECT a AS id, arg_min(b, bk) AS duplicate_of FROM near WHERE same_host AND (j >= 0.4 OR same) AND b IN (SELECT id FROM roots) GROUP BY 1""")
def q_reminder_collapse(spark, sf_dir):
    return dedupe.reminders(tables.events(spark, sf_dir), instant("2023-12-01 00:00:00"))


@query("""SELECT a.event_id, min(b.event_id) AS first_match FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND a.event_type <> b.event_type AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 1800000000 GROUP BY 1""")
def q_crosspost_band(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a = e.select("event_id", "user_id", "event_type", "ts")
    b = e.select(F.col("event_id").alias("b_id"), F.col("user_id").alias("b_user"), F.col("event_type").alias("b_type"), F.col("ts").alias("b_ts"))
    pairs = band_join(a, b, "ts", "b_ts", 1800, keys=[("user_id", "b_user")], condition=(F.col("event_id") != F.col("b_id")) & (F.col("event_type") != F.col("b_type")))
    return pairs.groupBy("event_id").agg(F.min("b_id").alias("first_match"))


@query("""WITH m AS (SELECT event_id, event_type AS list, user_id || '/' || json_extract_string(props, '$.k') AS k, value > 100 AS has_rfc, user_id AS u, ts FROM events),
 by_rfc AS (SELECT a.event_id AS id, b.event_id AS o, b.ts AS t_at FROM m a JOIN m b ON a.has_rfc AND b.has_rfc AND a.u = b.u AND a.list <> b.list AND a.event_id <> b.event_id),
 by_key AS (SELECT a.event_id AS id, b.event_id AS o, b.ts AS t_at FROM m a JOIN m b ON a.k = b.k AND a.list <> b.list AND a.event_id <> b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 120000000)
 SELECT CAST(id AS VARCHAR) AS id, CAST(arg_min(o, (t_at, CAST(o AS VARCHAR))) AS VARCHAR) AS match_id FROM (SELECT * FROM by_rfc UNION ALL SELECT * FROM by_key) GROUP BY id""")
def q_crosspost_match(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    rows = e.select(
        F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("listserv"), F.when(F.col("value") > 100, user).alias("rfc_message_id"), F.concat(user, F.lit("/"), F.get_json_object("props", "$.k")).alias("delivery_key"),
        F.col("ts").cast("timestamp").alias("sent_at"), F.col("ts").cast("timestamp").alias("ingested_at"),
    )
    return reconcile.first_matches(rows)


@query("SELECT p_partkey, CASE WHEN count(*) OVER w > 1 THEN substr(sha256(p_brand || '|' || trim(regexp_replace(lower(p_name), '[^a-z]+', ' ', 'g'))), 1, 16) END AS series_id, CASE WHEN count(*) OVER w > 1 THEN CAST(count(*) OVER w AS INT) ELSE 0 END AS series_size FROM part WINDOW w AS (PARTITION BY p_brand, p_name)")
def q_series(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("host_org_id"), F.col("p_name").alias("title"))
    return event_ops.with_series(rows).select("p_partkey", "series_id", F.coalesce("series_size", F.lit(0)).alias("series_size"))


IMAGE_HOST = r"^https?://([^/]+)/"


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)/', 1) AS image_url, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS host FROM pages)
 SELECT page_id, CASE WHEN (SELECT count(DISTINCT coalesce(host, '')) FROM p q WHERE q.image_url = p.image_url) < 3 THEN image_url END AS image_url FROM p""")
def q_generic_image(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", IMAGE_HOST, 1).alias("image_url"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("host_org_id"))
    return event_ops.without_generic_images(rows, hosts=3).select("page_id", "image_url")


# Merging.


@query("""WITH cur AS (SELECT o_orderkey, o_orderstatus, round(o_totalprice) AS price FROM orders WHERE o_orderpriority <> '1-URGENT'), upd AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice) + 1 ELSE round(o_totalprice) END AS price FROM orders WHERE o_orderpriority <> '5-LOW')
 SELECT coalesce(c.o_orderkey, u.o_orderkey) AS o_orderkey, coalesce(c.o_orderstatus, u.o_orderstatus) AS o_orderstatus, CASE WHEN u.o_orderkey IS NOT NULL AND (c.o_orderkey IS NULL OR c.price IS DISTINCT FROM u.price) THEN u.price ELSE c.price END AS price,
 CASE WHEN u.o_orderkey IS NOT NULL AND c.o_orderkey IS NULL THEN 'insert' WHEN u.o_orderkey IS NOT NULL AND c.price IS DISTINCT FROM u.price THEN 'update' END AS change FROM cur c FULL JOIN upd u ON c.o_orderkey = u.o_orderkey""")
def q_upsert_merge(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("price", F.round("o_totalprice"))
    current = o.where("o_orderpriority <> '1-URGENT'").select("o_orderkey", "o_orderstatus", "price")
    updates = o.where("o_orderpriority <> '5-LOW'").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderstatus") == "F", F.col("price") + 1).otherwise(F.col("price")).alias("price"))
    return store.merge_snapshot(current, updates, ["o_orderkey"])


@query("""WITH cur AS (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '1-URGENT'), new AS (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderstatus = 'F')
 SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) + 100 AS BIGINT) AS revision FROM new WHERE o_orderkey NOT IN (SELECT o_orderkey FROM cur)""")
def q_revisions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    current = o.where("o_orderpriority <> '1-URGENT'").select("o_orderkey", F.lit(0).cast("long").alias("revision"))
    updates = o.where("o_orderpriority = '1-URGENT' or o_orderstatus = 'F'").select("o_orderkey")
    merged = store.merge_snapshot(current, updates, ["o_orderkey"], compare=["o_orderkey"])
    return store.with_revisions(merged, 100, ["o_orderkey"]).where("change is not null").select("o_orderkey", "revision")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' AND o_orderdate > TIMESTAMP '1998-01-01' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def q_withdraw_missing(spark, sf_dir):
    seen = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    rows = table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") > F.lit("1998-01-01").cast("timestamp_ntz")))
    return rows.join(seen, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_orderdate")


@query("SELECT * FROM (SELECT o_orderkey, o_orderstatus, o_orderdate, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR)) AS r FROM orders WHERE o_totalprice < 150000 AND o_orderdate > TIMESTAMP '2001-06-01') WHERE r <= 25")
def q_pending_bodies(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), "o_orderkey", "o_orderstatus", F.col("o_orderstatus").alias("listserv"), (F.col("o_totalprice") >= 150000).alias("complete"), F.lit("x").alias("source_url"), F.col("o_orderdate").cast("timestamp").alias("sent_at"))
    rows = feeds.pending_bodies(o, instant("2001-06-15 00:00:00"))
    rank = F.row_number().over(Window.partitionBy("o_orderstatus").orderBy(F.desc("sent_at"), "id"))
    return rows.select("o_orderkey", "o_orderstatus", plain("sent_at").alias("o_orderdate"), rank.cast("long").alias("r"))


# Text.


@query("""WITH w AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: length(x) > 2)) AS words FROM documents), e AS (SELECT doc_id, len(words) AS n, unnest(words) AS word FROM w),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_, any_value(a.n) + any_value(b.n) - count(*) AS whole FROM e a JOIN e b ON a.word = b.word AND a.doc_id < b.doc_id GROUP BY 1, 2)
 SELECT a, b, round(both_ / whole, 6) AS j FROM p WHERE both_ / whole >= 0.6""")
def q_jaccard_pairs(spark, sf_dir):
    """Pairs of documents at word Jaccard 0.6 or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text.similarity_words("text").alias("words"))
    return setpairs.similar_pairs(docs, 0.6).select("a", "b", F.round("j", 6).alias("j"))


CATEGORY_SQL = "CASE " + " ".join(f"WHEN {rule_sql(column, p)} THEN '{name}'" for column in ("phrase", "phrase || chr(10) || substr(text, 1, 12000)") for name, p in fixed.CATEGORY_RULES) + f" ELSE '{fixed.DEFAULT_CATEGORY}' END"


@query(f"WITH {PHRASED_SQL} SELECT doc_id, {CATEGORY_SQL} AS category FROM phrased")
def q_category(spark, sf_dir):
    return tables.phrased(spark, sf_dir).select("doc_id", text.category("phrase", "text").alias("category"))


WHOLE_SQL = "phrase || chr(10) || text"
TAGS_SQL = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {rule_sql(WHOLE_SQL, p)} THEN '{tag}' END" for tag, p in fixed.TAG_RULES.items()) + "], lambda x: x IS NOT NULL)[1:4], ',')"


@query(f"WITH {PHRASED_SQL} SELECT doc_id, {TAGS_SQL} AS tags FROM phrased")
def q_tags(spark, sf_dir):
    return tables.phrased(spark, sf_dir).select("doc_id", F.array_join(html.tags_column(F.col("phrased")), ",").alias("tags"))


@query(f"""WITH {PHRASED_SQL}, f AS (SELECT doc_id, length(text) % 2 = 0 AS exact, length(text) % 3 <> 0 AS dated, {rule_sql(WHOLE_SQL, fixed.EVENT_WORDS)} AS eventful, {rule_sql(WHOLE_SQL, fixed.TAG_RULES['free food'])} AS food, {rule_sql('phrase', fixed.NOT_EVENT)} AS denied, {rule_sql('substr(text, 1, 1500)', fixed.NOT_EVENT)} AS denied_body,
 {rule_sql(WHOLE_SQL, fixed.NOT_EVENT)} AS doubted, length(text) % 5 < 2 AS placed FROM phrased),
 s AS (SELECT *, CAST(exact AS INT) * 2 + CAST(dated AS INT) + CASE WHEN placed THEN 2 ELSE 1 END + CAST(eventful AS INT) + CAST(food AS INT) - CASE WHEN denied THEN 3 WHEN denied_body THEN 1 ELSE 0 END AS points FROM f)
 SELECT doc_id, points, dated AND points >= 4 AS is_event, CAST(round(least(1.0, 0.35 + points * 0.1 + CASE WHEN exact THEN 0.1 ELSE 0 END - CASE WHEN doubted THEN 0.15 ELSE 0 END), 2) AS DOUBLE) AS confidence FROM s""")
def q_event_score(spark, sf_dir):
    """The points of phrase and whole text; date and place are made from the text's length."""
    n, phrase, whole, head = F.length("text"), F.col("phrase"), F.col("phrased"), F.substring("text", 1, 1500)
    rules = {"eventful": (whole, fixed.EVENT_WORDS), "food": (whole, fixed.TAG_RULES["free food"]), "denied": (phrase, fixed.NOT_EVENT), "denied_body": (head, fixed.NOT_EVENT), "doubted": (whole, fixed.NOT_EVENT)}
    rows = tables.phrased(spark, sf_dir).select("doc_id", (n % 2 == 0).alias("exact"), (n % 3 != 0).alias("dated"), (n % 5 < 2).alias("placed"), html.rules_column(list(rules.values())).alias("met"))
    rows = rows.select("*", *(F.get("met", F.lit(i)).alias(c) for i, c in enumerate(rules)))
    points = event_ops.score(F.col("exact"), F.col("dated"), F.col("placed"), F.lit(True), F.col("eventful"), F.col("food"), F.col("denied"), F.col("denied_body"))
    return rows.withColumn("points", points).select("doc_id", "points", (F.col("dated") & (F.col("points") >= 4)).alias("is_event"), event_ops.confidence(F.col("points"), F.col("exact"), F.col("doubted")).alias("confidence"))


@query("SELECT doc_id, trim(regexp_replace(replace(lower(text), '&', ' and '), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS normal FROM documents")
def q_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.normalized("text").alias("normal"))


@query("SELECT event_id, (ts AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS utc, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%Y-%m-%dT%H:%M (%A)') AS local FROM (SELECT event_id, date_trunc('minute', ts) AS ts FROM events)")
def q_local_time(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.date_trunc("MINUTE", "ts").alias("at"))
    return e.select("event_id", text.local_to_utc(F.date_format("at", "yyyy-MM-dd'T'HH:mm")).cast("timestamp_ntz").alias("utc"), text.local_string(F.col("at").cast("timestamp")).alias("local"))


@query("""WITH t AS (SELECT DISTINCT lower(p_name) AS alias, unnest(string_split(lower(p_name), ' ')) AS token, p_brand FROM part) SELECT token, count(*) AS times FROM (SELECT DISTINCT p_brand, alias, token FROM t) GROUP BY 1""")
def q_alias_freq(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    orgs = p.select(F.col("p_brand").alias("id"), F.col("p_name").alias("name"), F.array().cast("array<string>").alias("aliases"), F.lit("Part").alias("group_type")).distinct()
    return dims.token_frequency(orgs)


@query(f"""WITH {PHRASED_SQL}, w AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(phrase), '[^a-z0-9]+'), lambda x: length(x) > 2)) AS p, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 2)) AS t FROM phrased)
 SELECT doc_id, CAST(len(list_intersect(p, t)) AS BIGINT) AS both_have, CASE WHEN len(list_distinct(list_concat(p, t))) > 0 THEN len(list_intersect(p, t)) / len(list_distinct(list_concat(p, t))) ELSE 0 END AS likeness FROM w""")
def q_set_words(spark, sf_dir):
    rows = tables.phrased(spark, sf_dir).select("doc_id", text.similarity_words("phrase").alias("p"), text.similarity_words("text").alias("t"))
    return rows.select("doc_id", F.size(F.array_intersect("p", "t")).cast("long").alias("both_have"), text.jaccard("p", "t").alias("likeness"))


from . import constructed  # noqa: E402, F401  (it registers its queries)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
