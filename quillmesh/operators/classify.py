"""Resolving the organization behind a message from its sender, subject, body and links.

Each piece of evidence scores; for each organization the best score of each
signal counts, and the signals add up. The winner needs LEAST points and a lead
of MARGIN; otherwise nobody is named. Aliases are found by an equi-join of the
texts' tokens with the aliases' rarest tokens and a containment check, links by
an equi-join on hosts and their parent domains: nothing is compared with the
whole directory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, html, text
from . import dims

VERSION = "2.4"
LEAST, MARGIN, HIGH = 65, 20, 100
NOBODY = "Campus community"
URL = r"""(?i)https?://[^\s<>\[\]"]+"""


def _contains(outer: Column, inner: Column) -> Column:
    pad = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    return pad(outer).contains(pad(inner))


def alias_matches(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """id, field, org_id, group_type, alias, strong from texts (id, field, raw). An alias inside a longer one of another organization doesn't count."""
    bare = texts.withColumn("bare", F.regexp_replace("raw", URL, " "))
    rows = dims.with_normal(bare, "bare", "normal").select("id", "field", "normal")
    # Tokens meet anchors without their text, which then meets the few aliases found.
    tokens = rows.select("id", "field", F.explode(F.array_distinct(F.split("normal", " "))).alias("anchor")).where("anchor <> ''")
    near = tokens.join(aliases, "anchor").select("id", "field", "org_id", "group_type", "alias", "strong")
    found = near.join(rows, ["id", "field"]).where(_contains(F.col("normal"), F.col("alias")))
    each = found.groupBy("id", "field").agg(F.collect_set(F.struct("org_id", "group_type", "alias", "strong")).alias("all"))
    longer = lambda a: F.exists("all", lambda b: (b["org_id"] != a["org_id"]) & (F.length(b["alias"]) > F.length(a["alias"])) & _contains(b["alias"], a["alias"]))
    return each.select("id", "field", F.explode(F.filter("all", lambda a: ~longer(a))).alias("a")).select("id", "field", "a.*")


def url_matches(messages: DataFrame, organizations: DataFrame) -> DataFrame:
    """id, org_id, detail of links to sites that organizations own, or to their group pages."""
    found = messages.select("id", F.explode(F.regexp_extract_all(F.concat("subject", F.lit("\n"), "content"), F.lit(URL), F.lit(0))).alias("raw"))
    url = F.regexp_replace("raw", "[),.;]+$", "")
    part = lambda u, p, *more: F.try_parse_url(u, F.lit(p), *map(F.lit, more))
    path = lambda u: F.coalesce(F.nullif(part(u, "PATH"), F.lit("")), F.lit("/"))
    links = found.select("id", F.lower(part(url, "HOST")).alias("host"), path(url).alias("path"), part(url, "QUERY", "club_id").alias("club")).where("host is not null").distinct()
    labels = F.split("host", "\\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    owned = organizations.select(F.col("id").alias("org_id"), "url_subdomains", F.explode("urls").alias("own")).select(
        "org_id", "url_subdomains", F.lower(part(F.col("own"), "HOST")).alias("parent"), path(F.col("own")).alias("own_path")
    )
    sites = links.select("id", "host", "path", F.explode(parents).alias("parent")).join(owned, "parent")
    sites = sites.where(((F.col("host") == F.col("parent")) | (F.col("url_subdomains") & (F.col("own_path") == "/"))) & F.col("path").startswith(F.col("own_path")))
    pages = links.where("host = 'my.princeton.edu' and club is not null").select("id", F.concat(F.lit("mpu:"), "club").alias("org_id")).join(organizations.select(F.col("id").alias("org_id")), "org_id", "left_semi")
    return sites.select("id", "org_id", F.concat(F.lit("organization URL: "), "parent", "own_path").alias("detail")).unionByName(pages.select("id", "org_id", F.lit("group page link").alias("detail"))).distinct()


def signals(messages: DataFrame, organizations: DataFrame, aliases: DataFrame | None = None, powered_by: tuple[str, ...] = fixed.POWERED_BY) -> DataFrame:
    """id, org_id, signal, score, detail: every piece of evidence. messages: id, subject, body, sender, sender_email."""
    aliases = dims.aliases(organizations) if aliases is None else aliases
    clean = messages.select("id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("subject", "body", "sender", "sender_email"))).withColumn("content", text.message_content("body", powered_by))
    fields = clean.select("id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(c).alias("raw")) for f, c in (("sender", "sender"), ("subject", "subject"), ("body", "content"))))).alias("x")).select("id", "x.*")
    senders = dims.with_normal(clean.select("id", "sender"), "sender", "normal").withColumn("transport", F.col("normal").rlike(fixed.TRANSPORT_SENDER))
    matched = alias_matches(fields, aliases).join(senders.where("transport").select("id", F.lit("sender").alias("field")), ["id", "field"], "left_anti")
    residential, strong = F.col("group_type") == "Residential Colleges", F.col("strong")
    score = (
        F.when(F.col("field") == "sender", F.when(strong, 85)).when(F.col("field") == "subject", F.when(strong, 80).otherwise(30))
        .otherwise(F.when(residential, 20).when(strong, 65).otherwise(15))
    )
    by_alias = matched.withColumn("score", score).where("score is not null").select("id", "org_id", F.col("field").alias("signal"), "score", F.concat("field", F.lit(": "), "alias").alias("detail"))
    exact = senders.where("not transport").join(aliases.select("org_id", F.col("alias").alias("normal")), "normal")
    by_sender = exact.select("id", "org_id", F.lit("sender").alias("signal"), F.lit(110).alias("score"), F.lit("exact sender alias").alias("detail"))
    by_email = clean.select("id", F.lower(F.trim("sender_email")).alias("email")).join(dims.contacts(organizations), "email")
    by_email = by_email.select("id", "org_id", F.lit("sender").alias("signal"), F.lit(110).alias("score"), F.lit("organization contact email").alias("detail"))
    word = fixed.ascii_words(r"\bplaintext\b")
    title = html.nfkc_column(F.col("subject")).rlike(word) & F.col("subject").rlike(r"(?i)kickoff|meeting|wrap up|acm\s*[-:]\s*plaintext|^\[?\d{1,2}/\d{1,2}\s+plaintext")
    special = clean.where(title).select("id", F.lit("plaintext").alias("org_id")).join(organizations.select(F.col("id").alias("org_id")), "org_id", "left_semi")
    special = special.select("id", "org_id", F.lit("subject").alias("signal"), F.lit(80).alias("score"), F.lit("plaintext event title").alias("detail"))
    by_url = url_matches(clean, organizations).select("id", "org_id", F.lit("url").alias("signal"), F.lit(85).alias("score"), "detail")
    out = by_alias
    for more in (by_sender, by_email, special, by_url):
        out = out.unionByName(more)
    return out


def ranked(found: DataFrame) -> DataFrame:
    """id, org_id, score, second, evidence: the best organization of each message and the runner-up's score."""
    best_of = found.groupBy("id", "org_id", "signal").agg(F.max("score").alias("score"), F.collect_set("detail").alias("details"))
    total = best_of.groupBy("id", "org_id").agg(F.sum("score").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("details")))).alias("evidence"))
    top = total.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("score", "org_id", "evidence")), asc=False).alias("all"))
    return top.select("id", F.col("all")[0]["org_id"].alias("org_id"), F.col("all")[0]["score"].alias("score"), F.try_element_at("all", F.lit(2))["score"].alias("second"), F.col("all")[0]["evidence"].alias("evidence"))


def classify(messages: DataFrame, organizations: DataFrame, version: str = VERSION, powered_by: tuple[str, ...] = fixed.POWERED_BY) -> DataFrame:
    """id, category, organization, organization_id, confidence, evidence, version, input_hash of each message.

    messages: id, subject, body, sender, sender_email, listserv. powered_by: see fixed.POWERED_BY.
    """
    best = ranked(signals(messages, organizations, powered_by=powered_by))
    orgs = organizations.select(F.col("id").alias("org_id"), "name", "group_type", "categories")
    rows = messages.join(best, "id", "left").join(orgs, "org_id", "left")
    resolved = F.coalesce((F.col("score") >= LEAST) & (F.col("second").isNull() | (F.col("score") - F.col("second") >= MARGIN)), F.lit(False))
    subject, body = F.coalesce("subject", F.lit("")), F.coalesce("body", F.lit(""))
    plain = F.when(F.col("listserv") == "FREEFOOD", F.lit("Free food")).otherwise(text.category(subject, body))
    refined = F.when(F.col("group_type") == "Academic Department", F.lit("Academics")).when(F.arrays_overlap("categories", text.any_of(fixed.ARTS)), F.lit("Arts & culture"))
    rows = rows.withColumn("resolved", resolved).withColumn("plain", plain)
    return rows.select(
        "id", F.when((F.col("plain") == fixed.DEFAULT_CATEGORY) & F.col("resolved"), F.coalesce(refined, F.col("plain"))).otherwise(F.col("plain")).alias("category"),
        F.when(F.col("resolved"), F.col("name")).otherwise(F.lit(NOBODY)).alias("organization"), F.when(F.col("resolved"), F.col("org_id")).alias("organization_id"),
        F.when(F.col("resolved"), F.when(F.col("score") >= HIGH, F.lit("high")).otherwise(F.lit("medium"))).otherwise(F.lit("unresolved")).alias("confidence"),
        F.when(F.col("resolved"), F.col("evidence")).when(F.col("score").isNotNull(), F.array(F.lit("Ambiguous or weak organization evidence"))).otherwise(F.array(F.lit("No directory match"))).alias("evidence"),
        F.lit(version).alias("version"), text.fingerprint("subject", "body", "sender", "sender_email", "listserv").alias("input_hash"),
    )


def reclassify(messages: DataFrame, organizations: DataFrame, version: str = VERSION) -> DataFrame:
    """classify() of the messages whose classifier version isn't the present one."""
    stale = messages.where(~F.col("classifier_version").eqNullSafe(F.lit(version)))
    return classify(stale.select("id", "subject", F.col("body_text").alias("body"), F.col("sender_name").alias("sender"), "sender_email", "listserv"), organizations, version)
