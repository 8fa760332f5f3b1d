"""Registered queries over rows that are made from the generic tables so that their results are known: mail with known notices, footers, headers, links, dates and places.

Each query calls the engine; its SQL says what must come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import dates, fixed, fts, html, text
from ..operators import classify, dedupe, dims, events as event_ops, reconcile, store
from ..sources import feeds
from . import read, tables
from .registered import instant, plain, query, rule_sql
from .tables import EVENTS_SQL, MESSAGES_SQL, dealt, table

SENT = "2024-01-15 14:00:00"
FOOTER = "This email was instantly sent to all college listservs with Hoagie Mail. Email composed by Pat Lee (plee@example.edu) - if inappropriate, please report it to hoagie@princeton.edu."
NOTICE = "This email was sent to you as a subscriber of WHITMANWIRE@princeton.edu."


def letters(column: str = "text") -> Column:
    """A text's words: letters only, single spaces between."""
    return F.trim(F.regexp_replace(F.coalesce(column, F.lit("")), r"[^\p{L}]+", " "))


LETTERS = r"trim(regexp_replace(coalesce(text, ''), '[^\p{L}]+', ' ', 'g'))"


def joined(*parts: Column | str) -> Column:
    """Texts put together; strings are literal."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def cast(column: str) -> Column:
    return F.col(column).cast("string")


# Bodies, senders, media, headers.


@query(f"WITH d AS (SELECT doc_id, {LETTERS} AS w FROM documents) SELECT doc_id, w AS from_page, w AS from_text, substr(w, 1, 230) AS preview, CASE WHEN w = '' THEN '<p></p>' ELSE '<p>' || w || '</p>' END AS shown, true AS footer, false AS footer_alone FROM d")
def q_readable(spark, sf_dir):
    """Notices and the relay's footer go, from markup and from text; what is shown is safe."""
    rows = table(spark, sf_dir, "documents").select("doc_id", letters().alias("w"))
    page = joined(f"<div>{NOTICE}</div><p>", F.col("w"), f"</p><div>{FOOTER}</div>")
    body = joined(NOTICE + "\n", F.col("w"), "\n\n", FOOTER)
    return rows.select(
        "doc_id", html.readable_text_column(F.lit(None).cast("string"), page).alias("from_page"), html.readable_text_column(body, F.lit(None).cast("string")).alias("from_text"), html.preview_column(F.lit(""), page).alias("preview"),
        html.display_html_column(joined('<script>x("<p>")</script><p onclick="y()">', F.col("w"), "</p><img src=x>")).alias("shown"), text.is_relay_footer(F.lit(FOOTER)).alias("footer"), text.is_relay_footer(F.col("w")).alias("footer_alone"),
    )


#: Markup that pages have: tags, and five entities.
ARTICLE_SQL = r"regexp_extract(html, '<article>.*?<h1>.*?</h1>(.*)</article>', 1, 's')"
for _entity, _sign in (("&middot;", "·"), ("&copy;", "©")):
    ARTICLE_SQL = f"replace({ARTICLE_SQL}, '{_entity}', '{_sign}')"
ARTICLE_SQL = f"regexp_replace({ARTICLE_SQL}, '<[^>]*>', ' ', 'g')"
for _entity, _sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&amp;", "&")):
    ARTICLE_SQL = f"replace({ARTICLE_SQL}, '{_entity}', '{_sign}')"
ARTICLE_SQL = f"trim(regexp_replace({ARTICLE_SQL}, '\\s+', ' ', 'g'))"


def articles(spark, sf_dir) -> DataFrame:
    inside = F.regexp_extract("html", r"(?s)<article>.*?<h1>.*?</h1>(.*)</article>", 1)
    return table(spark, sf_dir, "pages").select("page_id", inside.alias("inside"))


@query(f"SELECT page_id, {ARTICLE_SQL} AS article FROM pages")
def q_html_text(spark, sf_dir):
    """Text of the pages' articles, without their headline, in one line. Markup that isn't closed is closed."""
    return articles(spark, sf_dir).select("page_id", F.trim(F.regexp_replace(html.html_to_text_column(F.col("inside")), r"\s+", " ")).alias("article"))


@query(f"SELECT page_id, substr(trim(regexp_replace({ARTICLE_SQL}, '[-_]{{5,}}', '', 'g')), 1, 230) AS preview FROM pages")
def q_preview(spark, sf_dir):
    return articles(spark, sf_dir).select("page_id", html.preview_column(F.lit(""), F.col("inside")).alias("preview"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN 'Princeton community' ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 2 THEN '' ELSE 'c' || c_custkey || '@example.edu' END AS email,
 CASE WHEN c_custkey % 3 = 0 THEN 'HoagieMail' END AS via, CASE c_custkey % 3 WHEN 0 THEN 'hoagiemail-footer' WHEN 1 THEN 'archive-metadata' ELSE 'display-name-only' END AS attribution FROM customer""")
def q_sender(spark, sf_dir):
    """Authors: named by the relay's footer, by the archive, or not at all."""
    c, kind = table(spark, sf_dir, "customer"), F.col("c_custkey") % 3
    email = joined("C", cast("c_custkey"), "@Example.edu")
    who = html.sender_column(
        F.when(kind == 0, "HoagieMail").when(kind == 1, joined(F.col("c_name"), " <x@y.edu>")), F.when(kind == 0, "hoagie@princeton.edu").when(kind == 1, email),
        F.when(kind == 0, joined("Hello\n\nEmail composed by ", F.col("c_name"), " (", email, ")")), F.lit(None).cast("string"), F.lit(False),
    )
    return c.select("c_custkey", who["name"].alias("name"), who["email"].alias("email"), who["via"].alias("via"), who["attribution"].alias("attribution"))


@query("""WITH p AS (SELECT p_partkey, 'https://img.example.org/p' || p_partkey || '.png' AS url, 'https://lists.princeton.edu/cgi-bin/wa?A3=ind' || p_partkey || '&T=application%2Fpdf&N=plan.pdf' AS file FROM part)
 SELECT p_partkey, CAST(2 AS BIGINT) AS n, substr(sha256(url), 1, 24) AS id, url, 'p' || p_partkey || '.png' AS name, CAST(200 AS INT) AS width, file, 'file' AS kind, 'plan.pdf' AS file_name FROM p""")
def q_media(spark, sf_dir):
    """Images and attachments, each once, without small ones, inline ones and parts that are the message itself; session data out of links."""
    p = dealt(table(spark, sf_dir, "part").select("p_partkey"))
    image = joined('<img src="https://img.example.org/p', cast("p_partkey"), '.png" alt="A picture" width="200" height="90px">')
    page = joined('<p>Hi <img src="cid:1"><img src="https://img.example.org/dot.gif" width="1" height="1">', image, image, '<img src="javascript:x"></p>')
    part = lambda kind, extra: F.struct(joined("https://lists.princeton.edu/cgi-bin/wa?A3=ind", cast("p_partkey"), extra).alias("url"), F.lit(kind).alias("type"))
    found = html.media_column(page, F.array(part("text/html", "&T=text%2Fhtml"), part("application/pdf", "&T=application%2Fpdf&N=plan.pdf&X=SECRET&Y=me"), part("View Message", "&T=")))
    rows = p.select("p_partkey", found.alias("m"))
    a, b = F.get("m", F.lit(0)), F.get("m", F.lit(1))
    return rows.select("p_partkey", F.size("m").cast("long").alias("n"), a["id"].alias("id"), a["url"].alias("url"), a["name"].alias("name"), a["width"].alias("width"), b["url"].alias("file"), b["kind"].alias("kind"), b["name"].alias("file_name"))


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 4 AS k, strftime(o_orderdate + to_minutes(o_orderkey % 1440), '%Y-%m-%dT%H:%M:00.000Z') AS moment FROM orders)
 SELECT o_orderkey, 'm' || o_orderkey || '@example.edu' AS rfc_message_id, CASE k WHEN 0 THEN 'BUTLERBUZZ,WHITMANWIRE' WHEN 1 THEN 'BUTLERBUZZ' WHEN 2 THEN 'BUTLERBUZZ,WHITMANWIRE' ELSE '' END AS lists, k <> 3 AS headers_complete, moment AS date,
 CASE WHEN k IN (0, 2) THEN sha256('["Pat <p' || o_orderkey || '@example.edu>","","Hello ' || o_orderkey || '","' || 'LISTS' || '"]') END IS NOT NULL AS has_key,
 CASE WHEN k IN (0, 2) THEN sha256('["Pat <p' || o_orderkey || '@example.edu>","","Hello ' || o_orderkey || '",["BUTLERBUZZ","WHITMANWIRE"],"[[\\"Order\\",\\"' || o_orderkey || '\\",\\"is\\",\\"here\\",\\".\\"],[[\\"a\\",\\"href\\",\\"https://shop.example.org/' || o_orderkey || '\\"]]]"]') END AS delivery_key,
 CASE WHEN k IN (0, 2) THEN '[["Order","' || o_orderkey || '","is","here","."],[["a","href","https://shop.example.org/' || o_orderkey || '"]]]' END AS content FROM o""")
def q_headers_and_keys(spark, sf_dir):
    """Archive headers, canonical content without transport's wrapping, and delivery keys, which only whole headers of several residential lists give."""
    key = F.col("o_orderkey").cast("string")
    kind = F.col("o_orderkey") % 4
    moment = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("o_orderkey") % 1440).cast("int"))
    field = lambda name, value: joined(f'<div class="c archive x"><b>{name}:</b> ', value, "</div>")
    to = F.when(kind == 0, "whitmanwire@PRINCETON.EDU, BUTLERBUZZ@princeton.edu, OTHER@princeton.edu").when(kind == 1, "butlerbuzz@princeton.edu").when(kind == 2, "ButlerBuzz@Princeton.EDU; whitmanwire@princeton.edu").otherwise("friends@example.edu")
    page = F.concat(field("From", joined("Pat &lt;p", key, "@example.edu&gt;")), field("Message-ID", joined("&lt;m", key, "@example.edu&gt;")), field("To", to), field("Date", F.date_format(moment, "EEE, d MMM yyyy HH:mm:ss +0000")), field("Subject", joined("Hello   ", key)))
    link = joined("https://shop.example.org/", key)
    wrapped = joined("https://nam12.safelinks.protection.outlook.com/?url=", F.url_encode(link), "&amp;data=05")
    footer = '<p>To unsubscribe from the butlerbuzz list, click the following link: <a href="https://lists.princeton.edu/cgi-bin/wa?SUBED1=butlerbuzz&amp;A=1">https://lists.princeton.edu/cgi-bin/wa?SUBED1=butlerbuzz&amp;A=1</a></p>'
    body = joined("<p>Order ", key, "  is<br>", F.when(kind == 2, joined('<a href="', wrapped, '">here</a>')).otherwise(joined('<a href="', link, '">here</a>')), ".</p>", F.when(kind == 0, F.lit(footer)).otherwise(F.lit("")))
    rows = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")).select("o_orderkey", html.archive_headers_column(page).alias("h"), body.alias("body"))
    rows = rows.withColumn("delivery_key", html.delivery_key_column(F.col("h"), F.col("body"))).withColumn("content", html.canonical_content_column(F.col("body")))
    return rows.select("o_orderkey", F.col("h.rfc_message_id").alias("rfc_message_id"), F.array_join("h.recipient_lists", ",").alias("lists"), F.col("h.headers_complete").alias("headers_complete"), F.element_at("h.identity_fields", 4).alias("date"), F.col("delivery_key").isNotNull().alias("has_key"), "delivery_key", F.when(F.col("delivery_key").isNotNull(), F.col("content")).alias("content"))


@query("SELECT p_partkey, 'https://a.example.org/' || p_partkey || '?x=1&y=2,https://c.example.org/?q=' || p_partkey AS links, 'https://lists.princeton.edu/cgi-bin/wa?A2=ind' || p_partkey || '&L=X#top' AS archive_url FROM part")
def q_links(spark, sf_dir):
    """Distinct targets in order, unwrapped, without the list host's own; archive links without session data."""
    key = cast("p_partkey")
    one = joined('<a href="https://a.example.org/', key, '?x=1&amp;y=2">')
    page = joined(one, "1</a>", one, '2</a><a HREF=\'https://n.safelinks.protection.outlook.com/?url=https%3A%2F%2Fc.example.org%2F%3Fq%3D', key, "&data=1'>3</a>", '<a href="/rel">4</a><a href="https://lists.princeton.edu/cgi-bin/wa?A=1">5</a>')
    archive = joined("https://lists.princeton.edu/cgi-bin/wa?A2=ind", key, "&X=ab%20c&L=X&Y=me@x&P=9#top")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.extract_links(page), ",").alias("links"), text.clean_archive_url(archive).alias("archive_url"))


@query(f"WITH d AS (SELECT doc_id, upper(source) AS l, substr({LETTERS}, 1, 60) AS w FROM documents) SELECT doc_id, CASE WHEN doc_id % 3 = 2 OR trim(w) = '' THEN '(No subject)' WHEN doc_id % 3 = 0 THEN trim(w) ELSE '[X' || l || '] ' || trim(w) END AS subject FROM d WHERE trim(w) <> ''")
def q_subject(spark, sf_dir):
    """The list's own tag goes, another stays; nothing left is no subject."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.upper("source").alias("l"), F.trim(F.substring(letters(), 1, 60)).alias("w")).where("w <> ''")
    subject = F.when(F.col("doc_id") % 3 == 2, joined("[", F.lower("l"), "]  ")).when(F.col("doc_id") % 3 == 0, joined("[", F.lower("l"), "]  ", F.col("w"))).otherwise(joined("[X", F.col("l"), "] ", F.col("w")))
    return rows.select("doc_id", text.subject_of(subject, "l").alias("subject"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 1 THEN '' ELSE c_name END AS name, CASE c_custkey % 3 WHEN 2 THEN '' ELSE lower(c_mktsegment) || c_custkey || '@example.edu' END AS email FROM customer")
def q_parse_address(spark, sf_dir):
    c, kind = table(spark, sf_dir, "customer"), F.col("c_custkey") % 3
    email = F.concat(F.lower("c_mktsegment"), cast("c_custkey"), F.lit("@example.edu"))
    who = text.parse_address(F.when(kind == 0, joined('"', F.col("c_name"), '" <', email, ">")).when(kind == 1, joined(" ", email, " ")).otherwise(joined("  ", F.col("c_name"), " ")))
    return c.select("c_custkey", who["name"].alias("name"), who["email"].alias("email"))


# Titles, summaries, words, fingerprints.


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN 'Untitled event' ELSE p_name END AS title FROM part""")
def q_title(spark, sf_dir):
    """Tags, replies, urgent leads and logistics go; two words stay at least."""
    name = F.col("p_name")
    subject = F.when(F.col("p_partkey") % 5 == 0, joined("[CLUB] Re: ", name, " THIS Tuesday @4:30 in Hall 207")).when(F.col("p_partkey") % 5 == 1, joined("FWD: [a] [b] TONIGHT: ", name, "!")).when(F.col("p_partkey") % 5 == 2, joined("REMINDER - ", name, " (10/3) at 7pm")).when(F.col("p_partkey") % 5 == 3, joined("  ", name, "  ")).otherwise(F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", text.clean_title(subject).alias("title"))


@query(f"""WITH d AS (SELECT doc_id, {LETTERS} AS w FROM documents), p AS (SELECT doc_id, w, trim(substr(w, 1, 300)) AS a, trim(substr(w, 11, 200)) AS b, trim(substr(w, 3, 300)) AS c FROM d WHERE length(w) > 320)
 SELECT doc_id, CASE WHEN length(a) + 2 + length(b) + 1 + length(c) <= 600 THEN a || chr(10) || chr(10) || b || chr(10) || chr(10) || c WHEN length(a) + 1 + length(b) <= 600 THEN a || chr(10) || chr(10) || b ELSE a END AS summary, substr(w, 1, 600) AS whole FROM p""")
def q_summary(spark, sf_dir):
    """Whole paragraphs while they fit, else the beginning."""
    rows = table(spark, sf_dir, "documents").select("doc_id", letters().alias("w")).where("length(w) > 320")
    part = lambda start, n: F.trim(F.substring("w", start, n))
    whole = F.when(F.length("w") >= 600, text.summarize(F.col("w"))).otherwise(F.col("w"))
    return rows.select("doc_id", text.summarize(joined(part(1, 300), "\n  \n", part(11, 200), "\n\n\n", part(3, 300))).alias("summary"), whole.alias("whole"))


@query("SELECT o_orderkey, sha256('[\"' || o_orderpriority || '\",\"' || o_orderstatus || '\",\"\"]') AS print FROM orders")
def q_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.fingerprint("o_orderpriority", "o_orderstatus", F.lit(None).cast("string")).alias("print"))


@query("SELECT region.r_regionkey, CASE r_regionkey WHEN 0 THEN 'academics' WHEN 1 THEN 'religion' WHEN 2 THEN 'athletics' WHEN 3 THEN 'affinity' ELSE 'social event' END AS category, CASE r_regionkey WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS residential, CASE WHEN r_regionkey = 2 THEN 'FreeFood' ELSE r_name END AS label, r_regionkey <> 4 AS valid, r_regionkey = 3 AS relay FROM region")
def q_kinds(spark, sf_dir):
    """Forum categories, residential and valid list names, labels, the relay's address."""
    k, pick = F.col("r_regionkey"), lambda *values: F.element_at(F.array(*map(F.lit, values)), (F.col("r_regionkey") + 1).cast("int"))
    group = pick("Academic Department", "ORL Chaplaincies", "Student organization", "Graduate Student Organizations", "Student organization")
    categories = F.when(k == 2, F.array(F.lit("Sports/Recreation"))).when(k == 3, F.array(F.lit("Cultural/Identity"))).otherwise(dims.empty_list())
    return table(spark, sf_dir, "region").select(
        "r_regionkey", text.forum_category(group, categories).alias("category"), text.is_residential(pick("whitmanwire", "RE-INNFORMER", "FREEFOOD", "X", "")).alias("residential"),
        text.list_label(F.when(k == 2, "FREEFOOD").otherwise(F.col("r_name"))).alias("label"), text.is_valid_list(pick("AB", "A_B-1", "LIST", "XY9", "a b")).alias("valid"), text.is_relay_address(pick("a@b.c", "hoagie@x.edu", "", " Hoagie@Princeton.edu ", "x")).alias("relay"),
    )


# Places, dates, events.

PLACES = "id string, name string, aliases array<string>, category string, latitude double, longitude double, source string"


def places(spark) -> DataFrame:
    return spark.createDataFrame([("garden-hall", "Garden Hall", ["Garden", "GH"], "social", 40.3, -74.6, "test"), ("chapel", "Old Chapel", [], "other", 40.1, -74.5, "test"), ("online", "Online", ["Zoom"], "other", 0.0, 0.0, "test")], PLACES)


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'garden-hall' WHEN 1 THEN 'chapel' WHEN 2 THEN 'online' WHEN 3 THEN 'garden-hall' END AS location_id, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 900 > 0 THEN CAST(o_orderkey % 900 AS VARCHAR) END AS room,
 CASE o_orderkey % 5 WHEN 0 THEN 'garden hall' WHEN 1 THEN 'old chapel' WHEN 2 THEN 'zoom' WHEN 3 THEN 'gh' END AS matched, CASE o_orderkey % 5 WHEN 0 THEN 40.3 WHEN 1 THEN 40.1 WHEN 3 THEN 40.3 END AS latitude FROM orders WHERE o_orderkey % 5 < 4""")
def q_places(spark, sf_dir):
    """Phrases and the places they name: by the longest alias, with room numbers; short aliases only in short phrases."""
    k, key = F.col("o_orderkey") % 5, (F.col("o_orderkey") % 900).cast("string")
    phrase = F.when(k == 0, joined("the Garden Hall, Room ", key)).when(k == 1, "by the Old Chapel steps").when(k == 2, "Zoom").when(k == 3, "GH lobby").otherwise("a place we call gh or something")
    rows = dealt(table(spark, sf_dir, "orders").select("o_orderkey")).select("o_orderkey", F.col("o_orderkey").alias("key"), phrase.alias("phrase"))
    return dims.resolve_locations(rows, places(spark)).select(F.col("key").alias("o_orderkey"), "location_id", "room", "matched", "latitude")


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Room ' || o_orderkey WHEN 1 THEN 'Hall ' || o_orderkey END AS label, CASE o_orderkey % 3 WHEN 0 THEN 'Room ' || o_orderkey || '|Frist' WHEN 1 THEN 'Hall ' || o_orderkey || '|Hall ' || o_orderkey ELSE 'McCosh ' || o_orderkey % 1000 END AS candidates FROM orders""")
def q_place_phrases(spark, sf_dir):
    """Labelled places first, then pinned ones, then those after a preposition."""
    k, key = F.col("o_orderkey") % 3, cast("o_orderkey")
    body = F.when(k == 0, joined("Talk at Frist today\nWhere: Room ", key, ".\nbring friends")).when(k == 1, joined("📍 Hall ", key, "\nsee you")).otherwise(joined("We meet in McCosh ", (F.col("o_orderkey") % 1000).cast("string"), " as ever"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.location_label(body).alias("label"), F.array_join(text.location_candidates(body), "|").alias("candidates"))


#: The day and the minute of each document's event, in campus time.
WHEN_SQL = "e AS (SELECT doc_id, doc_id % 7 AS form, DATE '2024-01-20' + CAST(doc_id % 150 AS INT) AS day, CAST(doc_id % 10 AS INT) + 1 AS hour, CAST(doc_id % 6 AS INT) * 10 AS minute FROM documents)"


def when_of(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 7).alias("form"), F.date_add(F.lit("2024-01-20").cast("date"), (F.col("doc_id") % 150).cast("int")).alias("day"), (F.col("doc_id") % 10 + 1).alias("hour"), (F.col("doc_id") % 6 * 10).alias("minute"))


@query(f"""WITH {WHEN_SQL}, l AS (SELECT doc_id, form, CASE WHEN form = 5 THEN day + INTERVAL 12 HOUR WHEN form = 6 THEN TIMESTAMP '2024-01-16 18:00:00' ELSE day + to_hours(hour + 12) + to_minutes(minute) END AS local, CASE WHEN form = 4 THEN day + to_hours(hour + 12) + to_minutes(minute) + INTERVAL 90 MINUTE END AS until FROM e)
 SELECT doc_id, (local AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS starts_at, (until AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS ends_at, true AS exact FROM l""")
def q_pick_date(spark, sf_dir):
    """Dates and times in several forms, before and after the clocks change; deadlines and relative spans don't count."""
    e = when_of(spark, sf_dir)
    clock = F.concat(cast("hour"), F.lit(":"), F.lpad(cast("minute"), 2, "0"))
    whole = F.concat(F.lpad((F.col("hour") + 12).cast("string"), 2, "0"), F.lit(":"), F.lpad(cast("minute"), 2, "0"))
    start = F.col("day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("hour") + 12).cast("int"), F.col("minute").cast("int"))
    until = F.date_format(start + F.make_dt_interval(F.lit(0), F.lit(1), F.lit(30)), "h:mma")
    day = lambda f: F.date_format("day", f)
    body = (
        F.when(F.col("form") == 0, joined("Join us on ", day("MMMM d"), " at ", clock, "pm.")).when(F.col("form") == 1, joined("On ", day("M/d"), " ", clock, " pm we meet")).when(F.col("form") == 2, joined("When: ", day("yyyy-MM-dd"), " ", whole))
        .when(F.col("form") == 3, joined("Come at ", clock, "pm on ", day("d MMM"), "!")).when(F.col("form") == 4, joined("It runs ", day("MMM d, yyyy"), " from ", clock, "pm to ", until)).when(F.col("form") == 5, joined("See you at noon on ", day("MMM d"))).otherwise(F.lit("Tomorrow, 6pm. Sign up by 11:59pm tonight, within 2 days"))
    )
    found = dates.pick_column(F.lit(""), body, instant(SENT))
    return e.select("doc_id", found.alias("w")).select("doc_id", plain("w.starts_at").alias("starts_at"), plain("w.ends_at").alias("ends_at"), F.col("w.exact").alias("exact"))


_BODY_SQL = "CASE doc_id % 4 WHEN 3 THEN 'Come to a concert some day in Garden Hall 12' ELSE 'Join us on ' || strftime(day, '%B ') || day(day) || ' at ' || hour || ':' || lpad(CAST(minute AS VARCHAR), 2, '0') || 'pm' || CASE doc_id % 4 WHEN 1 THEN '' ELSE ' in Garden Hall 12' END || ' for a concert.' END"
_SUBJECT_SQL = "CASE doc_id % 4 WHEN 2 THEN 'Selling my desk' ELSE 'Spring concert' END"
_EVENT_TAGS_SQL = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {rule_sql('both_', p)} THEN '{tag}' END" for tag, p in fixed.TAG_RULES.items()) + "], lambda x: x IS NOT NULL)[1:4], ',')"


@query(f"""WITH {WHEN_SQL}, m AS (SELECT *, {_BODY_SQL} AS body, {_SUBJECT_SQL} AS subject, {_SUBJECT_SQL} || chr(10) || {_BODY_SQL} AS both_ FROM e)
 SELECT CAST(doc_id AS VARCHAR) AS id, doc_id % 4 < 2 AS is_event, CASE WHEN doc_id % 4 < 2 THEN 'Spring concert' END AS title, CASE WHEN doc_id % 4 < 2 THEN body END AS summary, CASE WHEN doc_id % 4 < 2 THEN ((day + to_hours(hour + 12) + to_minutes(minute)) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' END AS starts_at,
 CASE WHEN doc_id % 4 = 0 THEN 'garden-hall' END AS location_id, CASE WHEN doc_id % 4 = 0 THEN '12' END AS room, CASE WHEN doc_id % 4 < 2 THEN {_EVENT_TAGS_SQL} END AS tags, CASE doc_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.85 END AS confidence, doc_id % 4 = 0 AS publishable,
 CASE WHEN doc_id % 4 = 3 THEN 'no future date or time found' ELSE '' END AS notes FROM m""")
def q_extract_events(spark, sf_dir):
    """Events with and without a place, and messages that are none: something for sale, and one without a date."""
    k = F.col("doc_id") % 4
    body = F.when(k == 3, "Come to a concert some day in Garden Hall 12").otherwise(joined("Join us on ", F.date_format("day", "MMMM d"), " at ", cast("hour"), ":", F.lpad(cast("minute"), 2, "0"), "pm", F.when(k == 1, "").otherwise(" in Garden Hall 12"), " for a concert."))
    rows = when_of(spark, sf_dir).select(
        cast("doc_id").alias("id"), F.when(k == 2, "Selling my desk").otherwise("Spring concert").alias("subject"), body.alias("body"), instant(SENT).alias("sent_at"), dims.empty_list().alias("links"), F.lit("WHITMANWIRE").alias("listserv"), F.lit(None).cast("string").alias("organization_id"), F.lit(None).cast("string").alias("organization_name"),
    )
    found = event_ops.extract(rows, places(spark))
    e = F.get("events", F.lit(0))
    return found.select("id", "is_event", e["title"].alias("title"), e["summary"].alias("summary"), plain_of(e["starts_at"]).alias("starts_at"), e["location_id"].alias("location_id"), e["room"].alias("room"), F.array_join(e["tags"], ",").alias("tags"), e["confidence"].alias("confidence"), F.coalesce(e["publishable"], F.lit(False)).alias("publishable"), F.array_join("notes", ",").alias("notes"))


def plain_of(column: Column) -> Column:
    return column.cast("timestamp_ntz")


@query(f"""WITH v AS (SELECT event_id, ts, value, event_id % 4 AS k FROM events WHERE ts + INTERVAL 1 HOUR >= TIMESTAMP '{SENT}')
 SELECT event_id, CASE WHEN k = 0 THEN 'https://ok.example.org' END AS rsvp_url, CAST(round(0.6 + CASE WHEN k < 3 THEN 0.15 ELSE 0 END + CASE WHEN k = 0 THEN 0.15 WHEN k = 1 THEN 0.05 ELSE 0 END + CASE WHEN k = 2 THEN 0.05 ELSE 0 END, 2) AS DOUBLE) AS confidence, k < 2 AS publishable FROM v""")
def q_validate_extracted(spark, sf_dir):
    """What an outside extractor found: past events go, foreign sign-up links too, confidence is given anew."""
    k = F.col("event_id") % 4
    base = F.get(F.from_json(F.lit('[{"title": "t", "summary": "", "online": false, "free_food": false, "confidence": 0.1, "publishable": true}]'), schemas.EXTRACTED), F.lit(0))
    one = base.withField("starts_at", F.col("ts").cast("timestamp")).withField("ends_at", F.col("ts").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(1))).withField("time_precision", F.when(k < 3, "exact").otherwise("date"))
    one = one.withField("location_id", F.when(k == 0, "hall")).withField("location_text", F.when(k < 2, "Hall")).withField("host_org_id", F.when(k == 2, "mpu:1")).withField("rsvp_url", F.when(k == 0, "https://ok.example.org").otherwise("https://foreign.example.org"))
    rows = table(spark, sf_dir, "events").select("event_id", F.array(F.lit("https://ok.example.org")).alias("links"), F.array(one).alias("events"))
    found = event_ops.validate_extracted(rows, instant(SENT)).select("event_id", F.explode("events").alias("e"))
    return found.select("event_id", F.col("e.rsvp_url").alias("rsvp_url"), F.col("e.confidence").alias("confidence"), F.col("e.publishable").alias("publishable"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 AND o_orderdate >= TIMESTAMP '1998-01-01' AND (o_orderkey % 4 <> 1 OR o_orderkey % 7 = 0)")
def q_needs_extraction(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(cast("o_orderkey").alias("id"), F.when(k % 5 == 0, "x").alias("canonical_id"), (k % 3 != 0).alias("complete"), F.col("o_orderdate").cast("timestamp").alias("sent_at"), F.when(k % 4 == 0, "model-3").when(k % 4 == 1, "rules-1").alias("extraction_version"), F.when(k % 7 == 0, True).alias("changed"))
    return event_ops.needs_extraction(rows, instant("1998-02-15 00:00:00"), 45).select("id")


# Organizations.

ORG_SQL = "org AS (SELECT 'mpu:' || n_nationkey AS org_id, n_nationkey AS k, lower(replace(n_name, '_', ' ')) AS name, 'club of ' || lower(replace(n_name, '_', ' ')) AS club FROM nation)"


def org_mail(spark, sf_dir) -> DataFrame:
    """Orders as mail: the sender, the subject and the body name nations' clubs in turn, some of them others' than the sender's."""
    k, name = F.col("o_orderkey"), F.concat(F.lit("NATION_"), (F.col("o_orderkey") % 25).cast("string"))
    other = F.concat(F.lit("Club of NATION_"), (F.floor(F.col("o_orderkey") / 25) % 25).cast("string"))
    return dealt(table(spark, sf_dir, "orders").select("o_orderkey")).select(
        cast("o_orderkey").alias("id"), F.when(k % 3 == 0, joined("Meeting of the ", other)).otherwise("News").alias("subject"), F.when(k % 5 == 0, joined("All from ", other, " are welcome. Powered by Hoagie. Club of NATION_1")).otherwise("Welcome").alias("body"),
        F.when(k % 4 == 0, joined("Club of ", name)).when(k % 4 == 1, "HoagieMail").when(k % 4 == 2, joined("Friends of the Club of ", name)).otherwise("Pat").alias("sender"), F.lit("").alias("sender_email"), F.lit("WHITMANWIRE").alias("listserv"),
    )


@query(f"""WITH {ORG_SQL}, m AS (SELECT o_orderkey AS k, 'mpu:' || o_orderkey % 25 AS own, 'mpu:' || (o_orderkey // 25) % 25 AS other FROM orders),
 s AS (SELECT k, own AS org_id, 'sender' AS signal, CASE k % 4 WHEN 0 THEN 110 ELSE 85 END AS score FROM m WHERE k % 4 IN (0, 2) UNION ALL SELECT k, other, 'subject', 80 FROM m WHERE k % 3 = 0 UNION ALL SELECT k, other, 'body', 65 FROM m WHERE k % 5 = 0),
 t AS (SELECT k, org_id, sum(score) AS score FROM s GROUP BY 1, 2), r AS (SELECT k, org_id, score, lead(score) OVER (PARTITION BY k ORDER BY score DESC, org_id DESC) AS second, row_number() OVER (PARTITION BY k ORDER BY score DESC, org_id DESC) AS place FROM t),
 b AS (SELECT k, org_id, score FROM r WHERE place = 1 AND score >= 65 AND (second IS NULL OR score - second >= 20))
 SELECT CAST(m.k AS VARCHAR) AS id, b.org_id AS organization_id, CASE WHEN b.k IS NULL THEN 'unresolved' WHEN b.score >= 100 THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN m.k % 3 = 0 THEN 'Events & socials' ELSE 'Campus life' END AS category,
 CASE WHEN b.k IS NULL THEN 'Campus community' ELSE 'NATION_' || substr(b.org_id, 5) END AS organization FROM m LEFT JOIN b ON m.k = b.k""")
def q_classifier(spark, sf_dir):
    """Evidence of sender, subject and body; the winner needs its points and its lead, and words after the boilerplate don't count."""
    found = classify.classify(org_mail(spark, sf_dir), tables.organizations(spark, sf_dir))
    return found.select("id", "organization_id", "confidence", "category", "organization")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, 'mpu:' || o_orderkey % 25 AS org_id, CASE WHEN o_orderkey % 3 = 2 THEN 'group page link' ELSE 'organization URL: site' || o_orderkey % 25 || '.example.org/' END AS detail FROM orders WHERE o_orderkey % 4 < 3")
def q_url_evidence(spark, sf_dir):
    """Links to organizations' sites, at the site or below it, and to their group pages; other links say nothing."""
    k, key = F.col("o_orderkey"), (F.col("o_orderkey") % 25).cast("string")
    url = F.when(k % 3 == 0, joined("https://site", key, ".example.org/events/1.")).when(k % 3 == 1, joined("http://WWW.site", key, ".example.org")).otherwise(joined("https://my.princeton.edu/feeds?type=club&club_id=", key))
    rows = table(spark, sf_dir, "orders").select(cast("o_orderkey").alias("id"), F.lit("see").alias("subject"), F.when(k % 4 < 3, joined("look at ", url, ", please")).otherwise(joined("https://elsewhere.example.org/site", key)).alias("content"))
    orgs = tables.organizations(spark, sf_dir).withColumn("urls", F.array(F.concat(F.lit("https://site"), F.regexp_extract("id", r"\d+", 0), F.lit(".example.org/"))))
    return classify.url_matches(rows, orgs)


@query("SELECT 'mpu:' || n_nationkey AS id, CASE WHEN n_nationkey % 5 = 0 THEN 'Twin (' || r_name || ')' WHEN n_nationkey % 5 = 1 THEN 'Renamed ' || n_nationkey ELSE n_name END AS name, CASE WHEN n_nationkey % 5 = 1 THEN 'more,' || 'Renamed ' || n_nationkey ELSE '' END AS curated, CASE WHEN n_nationkey % 5 = 2 THEN 'https://www.n' || n_nationkey || '.example.org' ELSE '' END AS urls, CASE WHEN n_nationkey % 5 = 1 THEN 'directory,curated' ELSE 'directory' END AS sources FROM nation JOIN region ON n_regionkey = r_regionkey")
def q_registry(spark, sf_dir):
    """The registry: overrides win field by field, shared names get their group, shared sites belong to nobody."""
    rows, k = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")), F.col("n_nationkey")
    site = F.when(k % 5 == 2, joined("https://www.n", cast("n_nationkey"), ".example.org")).when(k % 5 == 3, "https://instagram.com/")
    profile = F.from_json(F.to_json(F.struct(site.alias("website"))), schemas.PROFILE)
    directory = rows.select(joined("mpu:", cast("n_nationkey")).alias("id"), F.when(k % 5 == 0, "Twin").otherwise(F.col("n_name")).alias("name"), F.col("r_name").alias("group_type"), F.array(F.lit("x")).alias("categories"), profile.alias("profile"))
    own = rows.where(k % 5 == 1)
    none = F.lit(None)
    overrides = own.select(joined("mpu:", cast("n_nationkey")).alias("id"), joined("Renamed ", cast("n_nationkey")).alias("name"), F.array(F.lit("more")).alias("aliases"), none.cast("string").alias("group_type"), none.cast("array<string>").alias("categories"), none.cast("array<string>").alias("urls"), none.cast("boolean").alias("url_subdomains"), F.array(F.lit("curated")).alias("sources"))
    curated = F.filter("aliases", lambda a: (a == "more") | a.startswith("Renamed"))
    return dims.registry(directory, overrides).select("id", "name", F.array_join(curated, ",").alias("curated"), F.array_join("urls", ",").alias("urls"), F.array_join("sources", ",").alias("sources"))


@query("SELECT 'by id' AS how, 'mpu:3' AS id UNION ALL SELECT 'by name', 'mpu:7' UNION ALL SELECT 'by alias', 'mpu:12' UNION ALL SELECT 'search', 'mpu:' || n_nationkey FROM nation WHERE n_name LIKE 'NATION_2%'")
def q_find_organization(spark, sf_dir):
    """By id, by name, by an alias that one has alone, and by a part of a name."""
    orgs = tables.organizations(spark, sf_dir)
    out = dims.search_directory(orgs, "nation-2").select(F.lit("search").alias("how"), "id")
    for how, value in (("by id", "mpu:3"), ("by name", "Nation 7"), ("by alias", "CLUB of nation_12"), ("by nothing", "nation")):
        out = out.unionByName(dims.find_organization(orgs, value).select(F.lit(how).alias("how"), "id"))
    return out


@query("SELECT 'spot-' || n_nationkey || CASE WHEN n_nationkey % 3 = 1 THEN '-hall' ELSE '' END AS id, 'Spot ' || n_nationkey || CASE WHEN n_nationkey % 3 = 1 THEN ' Hall' ELSE '' END AS name, CASE WHEN n_nationkey % 3 = 1 THEN 'Spot ' || n_nationkey ELSE '' END AS aliases, CASE WHEN n_nationkey % 2 = 0 THEN 'library' ELSE 'academic' END AS category, round(40 + n_nationkey / 7.0, 6) AS latitude FROM nation WHERE n_nationkey % 5 < 4")
def q_points_of_interest(spark, sf_dir):
    """Named venues of the map: the fuller name, the other as an alias; unknown kinds and numbers go."""
    k, key = F.col("n_nationkey"), cast("n_nationkey")
    short = F.when(k % 5 < 4, joined("Spot  ", key)).otherwise(joined("#", key))
    rows = table(spark, sf_dir, "nation").select(k.cast("int").alias("id"), short.alias("name"), F.when(k % 3 == 1, joined("Spot ", key, " Hall")).alias("alt_name"), F.lit("c").alias("class"), F.when(k % 2 == 0, "library").otherwise("university").alias("type"), (k / 7.0 + 40).alias("lat"), F.lit(-74.0).alias("long"), F.lit(None).cast("int").alias("parent_id"))
    rows = rows.unionByName(rows.where("id < 5").withColumns({"type": F.lit("bench"), "name": F.lit("A bench")}))
    return dims.locations_from_pois(rows).select("id", "name", F.array_join("aliases", ",").alias("aliases"), "category", "latitude")


# Sources.


@query("SELECT 'ind' || o_orderkey AS archive_id, 'https://lists.princeton.edu/cgi-bin/wa?A2=ind' || o_orderkey || '&L=X' AS source_url, CASE WHEN o_orderkey % 3 = 0 THEN '(No subject)' ELSE 'Note ' || o_orderkey END AS subject, CASE WHEN o_orderkey % 2 = 0 THEN 'Pat' ELSE '' END AS author_name, 'p' || o_orderkey || '@example.edu' AS author_email, CASE WHEN o_orderkey % 5 = 4 THEN TIMESTAMP '2024-01-15 14:00:00' ELSE o_orderdate + INTERVAL 4 HOUR END AS sent_at, false AS complete FROM orders WHERE o_orderkey % 7 <> 6")
def q_listing(spark, sf_dir):
    """Items of an archive's listing as previews: those without an archive id go, bad dates are now."""
    k, key = F.col("o_orderkey"), cast("o_orderkey")
    items = table(spark, sf_dir, "orders").select(
        F.when(k % 3 == 0, " ").otherwise(joined("Note ", key)).alias("title"), F.when(k % 7 == 6, "https://x.example.org/").otherwise(joined("https://lists.princeton.edu/cgi-bin/wa?A2=ind", key, "&L=X&P=", key)).alias("link"), F.when(k % 2 == 0, joined('"Pat" <p', key, "@example.edu>")).otherwise(joined("p", key, "@example.edu")).alias("author"),
        F.when(k % 5 == 4, "some day").otherwise(F.concat(F.date_format("o_orderdate", "EEE, d MMM yyyy"), F.lit("  00:00:00 -0400"))).alias("pubDate"), F.lit("d").alias("description"),
    )
    return feeds.listing_items(items, "WHITMANWIRE", instant(SENT)).select("archive_id", "source_url", "subject", "author_name", "author_email", plain("sent_at").alias("sent_at"), "complete")


@query("SELECT 'u' || p_partkey AS source_url, CASE WHEN p_partkey % 2 = 0 THEN '<p>' || p_name || '</p>' ELSE '<pre>' || p_name || ' &lt;3</pre>' END AS body_html, CAST(CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 2 END AS BIGINT) AS attachments, 'm' || p_partkey || '@example.edu' AS rfc_message_id FROM part")
def q_message_pages(spark, sf_dir):
    """Whole messages from stored pages and parts: the html part, else the plain one in pre."""
    k, key = F.col("p_partkey"), cast("p_partkey")
    link = lambda n, kind: joined('<a href="/cgi-bin/wa?A3=', key, n, '&amp;header=1" class="x"> ', kind, " </a>")
    page = F.concat(joined('<div class="archive"><b>Message-ID:</b> &lt;m', key, "@example.edu&gt;</div>"), link("a", "text/plain"), F.when(k % 2 == 0, link("b", "text/html")).otherwise(""), link("c", "image/png"), link("a", "text/plain"))
    p = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name"))
    pages = p.select(joined("u", key).alias("source_url"), page.alias("page"))
    url = lambda n: joined("https://lists.princeton.edu/cgi-bin/wa?A3=", key, n)
    parts = p.select(url("a").alias("url"), joined(F.col("p_name"), " <3").alias("content")).unionByName(p.select(url("b").alias("url"), joined("<p>", F.col("p_name"), "</p>").alias("content")))
    return feeds.message_pages(pages, parts).select("source_url", "body_html", F.size("attachments").cast("long").alias("attachments"), F.col("headers.rfc_message_id").alias("rfc_message_id"))


@query("""SELECT CAST(event_id AS VARCHAR) AS external_id, substr(sha256('mpu#' || event_id), 1, 24) AS id, CASE WHEN event_id % 5 = 4 THEN 'withdrawn' ELSE 'active' END AS status, 'Session ' || event_id AS title, 'About it & more' AS summary, date_trunc('second', ts) AS starts_at, CASE WHEN event_id % 3 = 0 THEN date_trunc('second', ts) + INTERVAL 2 HOUR WHEN event_id % 3 = 1 THEN date_trunc('second', ts) + INTERVAL 48 HOUR END AS ends_at,
 CASE event_id % 4 WHEN 0 THEN 'garden-hall' WHEN 1 THEN 'online' END AS location_id, CASE event_id % 4 WHEN 0 THEN '12' END AS room, event_id % 4 = 1 AS online, CASE WHEN event_id % 2 = 0 THEN 'free food,career,research' ELSE 'career,research' END AS tags, CASE WHEN user_id < 25 THEN 'NATION_' || user_id ELSE 'Some group' END AS host_org_name,
 event_id % 5 <> 4 AND event_id % 3 <> 1 AS publishable FROM events""")
def q_feed(spark, sf_dir):
    """Items of the official feed as events: places, hosts, tags of topics and text; long and deleted ones aren't publishable."""
    k, key = F.col("event_id"), cast("event_id")
    moment = lambda hours: F.date_format(F.col("ts") + F.make_dt_interval(F.lit(0), hours), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    given = {
        "eventId": key, "title": joined("Session ", key), "groupId": cast("user_id"), "group": F.lit("Some group"), "eventStartDateTime": moment(F.lit(0)), "eventEndDateTime": F.when(k % 3 == 0, moment(F.lit(2))).when(k % 3 == 1, moment(F.lit(48))), "eventLocation": F.when(k % 4 == 0, "Garden Hall 12").when(k % 4 == 1, "on Zoom at nine").when(k % 4 == 2, "Private Location (sign in to display)"),
        "fullDescription": F.lit("<p>About it &amp; more</p>"), "eventTopics": F.lit("Networking; Research,Nothing"), "foodProvided": F.when(k % 2 == 0, "1"), "eventDelete": F.when(k % 5 == 4, "1"),
    }
    names = [c.split()[0].strip("`") for c in schemas.FEED_ITEM.split(", ")]
    items = dealt(table(spark, sf_dir, "events").select("event_id", "user_id", "ts")).select(*(given.get(n, F.lit(None)).cast("string").alias(n) for n in names))
    found = event_ops.map_feed(items.unionByName(items.limit(5).withColumn("eventId", F.lit(" "))), places(spark), tables.organizations(spark, sf_dir))
    return found.select("external_id", "id", "status", "title", "summary", plain("starts_at").alias("starts_at"), plain("ends_at").alias("ends_at"), "location_id", "room", "online", F.array_join("tags", ",").alias("tags"), "host_org_name", "publishable")


@query("SELECT 'FREEFOOD' AS listserv, CAST(o_orderkey AS VARCHAR) AS archive_id FROM orders WHERE o_orderkey % 3 <> 0")
def q_unseen(spark, sf_dir):
    """Listed items that aren't stored yet."""
    items = table(spark, sf_dir, "orders").select(F.lit("FREEFOOD").alias("listserv"), cast("o_orderkey").alias("archive_id"))
    known = items.where("cast(archive_id as long) % 3 = 0").select(text.message_id("listserv", "archive_id").alias("id"))
    return feeds.unseen(items, known).select("listserv", "archive_id")


# The store.


@query("""WITH c AS (SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS complete FROM orders WHERE o_orderkey % 10 <> 0), u AS (SELECT o_orderkey AS k, o_orderkey % 3 = 0 AS complete, o_orderkey % 4 = 0 AS other FROM orders WHERE o_orderkey % 10 <> 9)
 SELECT CAST(coalesce(c.k, u.k) AS VARCHAR) AS id, CASE WHEN u.k IS NULL THEN 'old' WHEN c.k IS NULL THEN 'new' WHEN c.complete AND NOT u.complete THEN 'old' WHEN u.other OR u.complete <> c.complete THEN 'new' ELSE 'old' END AS body_text, coalesce(c.complete, false) OR coalesce(u.complete, false) AS complete,
 CASE WHEN u.k IS NULL THEN 'subject' WHEN u.other THEN 'changed' ELSE 'subject' END AS subject, CASE WHEN c.k IS NULL THEN 'rfc-new' ELSE 'rfc-old' END AS rfc_message_id, CASE WHEN u.k IS NULL THEN NULL WHEN c.k IS NULL THEN 'insert' WHEN u.other OR (u.complete AND NOT c.complete) OR (u.complete AND c.complete AND u.other) THEN 'update' END AS change
 FROM c FULL JOIN u ON c.k = u.k""")
def q_upsert_messages(spark, sf_dir):
    """A whole body is never replaced by a preview, unchanged messages are left, the first identity stays."""
    orders, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    fields = [c.split(" ")[0] for c in schemas.MESSAGES.split(", ")]
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], schemas.MESSAGES).schema.fields}
    shape = lambda rows, given: rows.select(*(given.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in kinds))
    current = shape(orders.where(k % 10 != 0), {"id": cast("o_orderkey"), "complete": k % 2 == 0, "subject": F.lit("subject"), "body_text": F.lit("old"), "rfc_message_id": F.lit("rfc-old"), "classifier_version": F.lit("2.4")})
    # A message that is whole on both sides has the same body unless it changed.
    same = (k % 10 != 0) & (k % 4 != 0) & ((k % 2 == 0) == (k % 3 == 0))
    incoming = shape(orders.where(k % 10 != 9), {"id": cast("o_orderkey"), "complete": k % 3 == 0, "subject": F.when(k % 4 == 0, "changed").otherwise("subject"), "body_text": F.when(same, "old").otherwise("new"), "rfc_message_id": F.when(k % 10 == 0, "rfc-new"), "classifier_version": F.lit("2.4")})
    assert set(fields) >= {"id", "complete"}
    return store.upsert_messages(current, incoming).select("id", "body_text", "complete", "subject", "rfc_message_id", "change")


@query("""WITH e AS (SELECT event_id AS k, CAST(event_id // 4 AS VARCHAR) AS m, event_id % 4 AS idx, CASE WHEN event_id % 7 = 0 THEN 'duplicate' WHEN event_id % 7 = 1 THEN 'withdrawn' ELSE 'active' END AS status FROM events)
 SELECT m AS message_id, CAST(idx AS INT) AS idx, CASE WHEN idx < 2 THEN CASE WHEN status = 'duplicate' THEN 'duplicate' ELSE 'active' END WHEN status = 'active' THEN 'withdrawn' ELSE status END AS status, CASE WHEN idx < 2 THEN 'new' ELSE 'old' END AS title, idx < 2 OR status = 'active' AS changed FROM e""")
def q_save_extraction(spark, sf_dir):
    """What a message says now: its events are upserted, a duplicate stays one, the active ones beyond are withdrawn."""
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events")
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], schemas.EVENTS).schema.fields}
    given = {"id": cast("event_id"), "source": F.lit("listserv"), "message_id": F.floor(k / 4).cast("string"), "idx": k % 4, "status": F.when(k % 7 == 0, "duplicate").when(k % 7 == 1, "withdrawn").otherwise("active"), "title": F.lit("old")}
    current = rows.select(*(given.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))
    event = F.from_json(F.lit('[{"title": "new"}, {"title": "new"}]'), schemas.EXTRACTED)
    extracted = current.select(F.col("message_id").alias("id")).distinct().select("id", F.lit("rules-1").alias("version"), event.alias("events"))
    out = store.save_extraction(current, extracted, instant(SENT)).join(current.select(F.col("message_id").alias("h_m"), F.col("idx").alias("h_i")), (F.col("message_id") == F.col("h_m")) & (F.col("idx") == F.col("h_i")), "left_semi")
    return out.select("message_id", "idx", "status", "title", F.col("change").isNotNull().alias("changed"))


@query(f"""SELECT CAST(event_id AS VARCHAR) AS external_id, CASE WHEN event_id % 6 = 0 AND ts > TIMESTAMP '{SENT}' THEN 'withdrawn' ELSE 'active' END AS status, CASE WHEN event_id % 6 = 1 THEN 'new title' ELSE 'title' END AS title, CASE WHEN event_id % 6 = 5 THEN 'insert' WHEN event_id % 6 = 1 OR event_id % 6 = 0 AND ts > TIMESTAMP '{SENT}' THEN 'update' END AS change FROM events""")
def q_sync_official(spark, sf_dir):
    """A pull of the official feed: new and changed events, and coming ones that it no longer has."""
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events")
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], schemas.EVENTS).schema.fields}
    given = {"id": cast("event_id"), "source": F.lit("myprincetonu"), "external_id": cast("event_id"), "status": F.lit("active"), "title": F.lit("title"), "starts_at": F.col("ts"), "publishable": F.lit(True)}
    shaped = lambda some, more: some.select(*((given | more).get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))
    feed = shaped(rows.where(k % 6 != 0), {"title": F.when(k % 6 == 1, "new title").otherwise("title")})
    return store.sync_official(shaped(rows.where(k % 6 != 5), {}), feed, instant(SENT)).select("external_id", "status", "title", "change")


@query("SELECT 'L' || n_nationkey AS listserv, CAST(CASE WHEN n_nationkey % 3 = 0 THEN 3 WHEN n_nationkey % 3 = 1 THEN 0 ELSE 2 END AS INT) AS failures, CASE WHEN n_nationkey % 3 = 0 THEN repeat('x', 500) WHEN n_nationkey % 3 = 2 THEN 'before' END AS last_error, CASE WHEN n_nationkey % 3 = 1 THEN TIMESTAMP '2024-01-15 14:00:00' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS last_success_at, CAST(least(1800, 60 * power(2, CASE WHEN n_nationkey % 3 = 0 THEN 3 WHEN n_nationkey % 3 = 1 THEN 0 ELSE 2 END)) AS BIGINT) AS wait FROM nation")
def q_source_health(spark, sf_dir):
    """Lists after a round of polls: success clears failures, an error adds one and is cut; how long each is then left alone."""
    n, k = table(spark, sf_dir, "nation").select(joined("L", cast("n_nationkey")).alias("listserv"), "n_nationkey"), F.col("n_nationkey")
    old = instant("2024-01-01 00:00:00")
    current = n.select("listserv", old.alias("last_polled_at"), old.alias("last_success_at"), F.lit("before").alias("last_error"), F.lit(2).alias("failures"))
    polls = n.where(k % 3 < 2).select("listserv", instant(SENT).alias("polled_at"), F.when(k % 3 == 0, F.repeat(F.lit("x"), 600)).alias("error"))
    return store.source_health(current, polls).select("listserv", "failures", "last_error", plain("last_success_at").alias("last_success_at"), feeds.backoff("failures", 60).alias("wait"))


@query(f"""WITH {MESSAGES_SQL}, b AS (SELECT canonical_id AS c, arg_min(id, (sent_at, id)) AS best FROM messages WHERE complete AND canonical_id IS NOT NULL GROUP BY 1)
 SELECT m.id, m.complete OR b.best IS NOT NULL AS complete, CASE WHEN NOT m.complete AND b.best IS NOT NULL THEN 'of ' || b.best ELSE 'of ' || m.id END AS body_text FROM messages m LEFT JOIN b ON b.c = m.id""")
def q_inherit_bodies(spark, sf_dir):
    """A canonical message without a whole body takes that of its first whole copy."""
    rows = tables.messages(spark, sf_dir).withColumn("body_text", joined("of ", F.col("id")))
    return reconcile.inherit_bodies(rows).select("id", "complete", "body_text")


@query(f"WITH {MESSAGES_SQL} SELECT DISTINCT coalesce(canonical_id, id) AS message_id, l AS listserv FROM (SELECT canonical_id, id, unnest(CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN [listserv, 'HUOHUB'] ELSE [listserv] END) AS l FROM messages)")
def q_bridge(spark, sf_dir):
    """The lists that each message reached: its copies' own, and the residential ones that their headers name."""
    named = F.when(F.col("id").cast("long") % 3 == 0, F.array(F.lit("HUOHUB"), F.lit("STRANGERS")))
    return reconcile.bridge(tables.messages(spark, sf_dir).select("id", "canonical_id", "listserv", named.alias("recipient_lists")))


@query(f"""WITH {MESSAGES_SQL}, {EVENTS_SQL} SELECT ev.id, CASE WHEN m.canonical_id IS NOT NULL AND ev.status = 'active' THEN 'withdrawn' ELSE ev.status END AS status, CASE WHEN m.canonical_id IS NOT NULL AND ev.status = 'active' THEN 'update' END AS change FROM ev LEFT JOIN messages m ON m.id = ev.message_id""")
def q_withdraw_merged(spark, sf_dir):
    """Events of messages that turned out to be copies are withdrawn."""
    return store.withdraw_merged(tables.events(spark, sf_dir), tables.messages(spark, sf_dir)).select("id", "status", "change")


@query(f"""WITH {MESSAGES_SQL}, {EVENTS_SQL}, d AS (SELECT *, CASE WHEN CAST(id AS BIGINT) % 4 > 0 AND source = 'listserv' THEN CAST(CAST(id AS BIGINT) - CAST(id AS BIGINT) % 4 AS VARCHAR) END AS duplicate_of FROM ev),
 r AS (SELECT d.duplicate_of AS o, count(*) AS n, min(m.sent_at) AS first, list(b.listserv) FILTER (WHERE b.listserv IS NOT NULL) AS ls FROM d LEFT JOIN messages m ON m.id = d.message_id LEFT JOIN (SELECT message_id, min(listserv) AS listserv FROM bridge GROUP BY 1) b ON b.message_id = d.message_id WHERE duplicate_of IS NOT NULL GROUP BY 1)
 SELECT e.id, CAST(CASE WHEN e.source = 'listserv' THEN 1 ELSE 0 END + coalesce(r.n, 0) AS BIGINT) AS emails, least(m.sent_at, r.first) AS first_announced_at FROM d e LEFT JOIN messages m ON m.id = e.message_id LEFT JOIN r ON r.o = e.id""")
def q_announcements(spark, sf_dir):
    """How often an event was announced, and when first, repeats included."""
    k = F.col("id").cast("long")
    events = tables.events(spark, sf_dir).withColumn("duplicate_of", F.when((k % 4 > 0) & (F.col("source") == "listserv"), (k - k % 4).cast("string")))
    messages = tables.messages(spark, sf_dir)
    engine = read.Engine(messages, tables.bridge(messages), events, tables.organizations(spark, sf_dir), zone="UTC")
    rows = engine.event_payload(engine.events)
    return rows.select("id", F.col("announcements.emails").cast("long").alias("emails"), plain("announcements.first_announced_at").alias("first_announced_at"))


@query(f"""WITH {EVENTS_SQL}, w AS (SELECT *, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN NULL ELSE host_org_id END AS h, list_distinct(list_filter(string_split_regex(lower(title), '[^a-z0-9]+'), lambda x: length(x) > 2)) AS words FROM ev WHERE status = 'active'),
 jac AS (SELECT l.id AS lid, o.id AS oid, abs(epoch_us(l.starts_at) - epoch_us(o.starts_at)) AS d FROM w l JOIN w o ON l.source = 'listserv' AND o.source = 'myprincetonu' AND abs(epoch_us(l.starts_at) - epoch_us(o.starts_at)) <= 2700000000
 AND (l.h = o.h OR l.h IS NULL AND len(list_intersect(l.words, o.words)) * 1.0 / len(list_distinct(list_concat(l.words, o.words))) >= 0.5))
 SELECT lid AS id, arg_min(oid, (d, oid)) AS duplicate_of FROM jac GROUP BY 1""")
def q_official_dup_without_host(spark, sf_dir):
    """Repeats of official events, of which a third has no host and is known by its words."""
    rows = tables.events(spark, sf_dir).withColumn("host_org_id", F.when(F.col("id").cast("long") % 3 != 0, F.col("host_org_id")))
    return dedupe.official_duplicates(rows, instant("2023-12-01 00:00:00"))


@query("""WITH m AS (SELECT event_id AS id, event_type AS list, CASE WHEN value > 100 THEN user_id END AS rfc, user_id || '/' || strftime(ts, '%Y-%m-%d %H') AS key, ts FROM events),
 near AS (SELECT a.id, b.id AS o, b.ts AS came FROM m a JOIN m b ON a.rfc = b.rfc AND a.list <> b.list AND (b.ts, CAST(b.id AS VARCHAR)) < (a.ts, CAST(a.id AS VARCHAR)) UNION ALL SELECT a.id, b.id, b.ts FROM m a JOIN m b ON a.key = b.key AND a.list <> b.list AND (b.ts, CAST(b.id AS VARCHAR)) < (a.ts, CAST(a.id AS VARCHAR)) AND epoch_us(a.ts) - epoch_us(b.ts) <= 120000000),
 parent AS MATERIALIZED (SELECT id, arg_min(o, (came, CAST(o AS VARCHAR))) AS up FROM near GROUP BY 1), climb(id, at_, depth) AS (SELECT id, up, 1 FROM parent UNION ALL SELECT climb.id, parent.up, depth + 1 FROM climb JOIN parent ON parent.id = climb.at_),
 root AS (SELECT id, arg_max(at_, depth) AS r FROM climb GROUP BY 1) SELECT CAST(m.id AS VARCHAR) AS id, CAST(root.r AS VARCHAR) AS canonical_id FROM m LEFT JOIN root ON root.id = m.id""".replace("WITH m", "WITH RECURSIVE m", 1))
def q_reconcile(spark, sf_dir):
    """All events as messages, kinds as lists: replayed in order of arrival, each is a copy of the first that it matches, or of what that is a copy of."""
    kinds = {"view": "WHITMANWIRE", "click": "BUTLERBUZZ", "purchase": "ROCKYWIRE", "signup": "RE-INNFORMER", "error": "MATHEYMAIL"}
    lists = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))
    user, at = F.col("user_id").cast("string"), F.col("ts").cast("timestamp")
    rows = table(spark, sf_dir, "events").select(
        cast("event_id").alias("id"), lists[F.col("event_type")].alias("listserv"), F.when(F.col("value") > 100, user).alias("rfc_message_id"), F.concat_ws("/", user, F.date_format("ts", "yyyy-MM-dd HH")).alias("delivery_key"),
        at.alias("sent_at"), at.alias("ingested_at"), F.lit(None).cast("string").alias("canonical_id"),
    )
    return reconcile.reconcile(rows)


# Search.

#: Chess in one word of the subject, pizza 1 to 4 times in the body, from some place on.
MAIL_SQL = "m AS (SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS chess, 1 + o_orderkey % 4 AS times, o_orderkey % 30 AS gap, o_orderkey % 7 = 0 AS denied FROM orders)"


def mail_to_search(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    body = F.concat(F.repeat(F.lit("and "), (k % 30).cast("int")), F.repeat(F.lit("Pizzas "), (k % 4 + 1).cast("int")), F.when(k % 7 == 0, "only for members").otherwise("for everybody"))
    return dealt(table(spark, sf_dir, "orders").select("o_orderkey")).select(cast("o_orderkey").alias("id"), F.when(k % 2 == 0, "Chess").otherwise("Night").alias("subject"), F.lit(None).cast("string").alias("sender_name"), F.lit(None).cast("string").alias("organization_name"), body.alias("body_text"))


@query(f"""WITH {MAIL_SQL}, near AS (SELECT k, unnest(range(1, times + 1)) + gap AS d FROM m WHERE chess AND NOT denied),
 far AS (SELECT k, 1 - product(1 - sqrt(1.0 * 0.2 * (CASE WHEN d > 100 THEN 1e-30 ELSE 1 / (1.005 + 0.05 * exp(d / 1.5 - 2)) END))) AS r FROM near GROUP BY 1)
 SELECT 'all' AS asked, CAST(k AS VARCHAR) AS id, round(r, 6) AS rank FROM far UNION ALL SELECT 'any', CAST(k AS VARCHAR), round((CASE WHEN chess THEN 1.0 / 1.64493406685 ELSE 0 END + 0.2 * (1 + CASE WHEN times > 1 THEN 0.25 ELSE 0 END + CASE WHEN times > 2 THEN 1 / 9.0 ELSE 0 END + CASE WHEN times > 3 THEN 1 / 16.0 ELSE 0 END) / 1.64493406685) / 2, 6) FROM m
 UNION ALL SELECT 'phrase', CAST(k AS VARCHAR), NULL FROM m WHERE times >= 2""")
def q_fts(spark, sf_dir):
    """All words but one, any word, and a phrase, from postings; ranks by closeness and by weights."""
    rows = mail_to_search(spark, sf_dir)
    found = fts.search_each(fts.postings(rows), {"all": "chess pizza -members", "any": "the chess OR pizzas", "phrase": '"pizza pizzas"'})
    return found.select("asked", "id", F.when(F.col("asked") != "phrase", F.round("rank", 6)).alias("rank"))


@query(f"""WITH {MAIL_SQL} SELECT CAST(k AS VARCHAR) AS id, CASE WHEN chess THEN 'Chess' ELSE 'Night' END AS subject FROM m WHERE NOT chess AND times = 4 AND denied""")
def q_search_text(spark, sf_dir):
    """The read model's search over stored text, newest first where ranks tie."""
    rows = tables.messages(spark, sf_dir).drop("subject", "body_text", "sender_name", "organization_name").withColumn("canonical_id", F.lit(None).cast("string")).join(mail_to_search(spark, sf_dir), "id")
    engine = read.Engine(rows, tables.bridge(rows), tables.events(spark, sf_dir), tables.organizations(spark, sf_dir), zone="UTC")
    return engine.matching_messages(read.MessageFilters(query='"pizzas pizzas pizzas pizza" member night')).select("id", "subject")
