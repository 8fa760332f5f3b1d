"""Dimensions: the organization registry, its aliases, and the gazetteer. All are built as plans over supplied tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed, html, text



def empty_list() -> Column:
    return F.array().cast("array<string>")


def registry(directory: DataFrame, overrides: DataFrame | None = None, source: str = "directory") -> DataFrame:
    """Organizations from the directory (schemas.DIRECTORY) and curated overrides, which win field by field.

    An override of an unknown id without a name is an error, raised when the plan runs.
    """
    name, acronym = F.col("name"), F.col("profile.acronym")
    inverted = r"^(.+), (Princeton(?: University)?)$"
    in_brackets = F.regexp_extract(name, r"\(([A-Z][A-Za-z]{2,9})\)", 1)
    site = F.col("profile.website")
    base = directory.select(
        "id", "name", "group_type", "categories", "profile",
        F.array_compact(F.array(
            name,
            F.when(name.rlike(inverted), F.concat(F.regexp_extract(name, inverted, 2), F.lit(" "), F.regexp_extract(name, inverted, 1))),
            F.when(name.startswith("Princeton "), F.substring(name, 11, 1000)),
            F.nullif(in_brackets, F.lit("")),
            F.when(acronym.rlike("^[A-Za-z][A-Za-z0-9&-]{2,11}$"), acronym),
        )).alias("aliases"),
        F.when(site.rlike("(?i)^https?://") & ~site.rlike(fixed.SHARED_SITES), F.array(site)).otherwise(empty_list()).alias("urls"),
        F.lit(True).alias("url_subdomains"), F.array(F.lit(source)).alias("sources"),
    )
    if overrides is None:
        merged = base
    else:
        own, new = base.alias("b"), overrides.alias("o")
        full_name = F.coalesce(F.nullif(F.col("o.name"), F.lit("")), F.col("b.name"))
        merged = own.join(new, F.col("b.id") == F.col("o.id"), "full").select(
            F.coalesce("b.id", "o.id").alias("id"),
            F.when(full_name.isNull(), F.raise_error(F.concat(F.lit("Override needs a name: "), F.col("o.id")))).otherwise(full_name).alias("name"),
            F.coalesce("o.group_type", "b.group_type", F.lit("Student organization")).alias("group_type"),
            F.coalesce("o.categories", "b.categories", empty_list()).alias("categories"), "b.profile",
            F.when(F.col("o.id").isNull(), F.col("b.aliases")).otherwise(F.array_distinct(F.concat(F.coalesce("b.aliases", empty_list()), F.coalesce("o.aliases", empty_list()), F.array(full_name)))).alias("aliases"),
            F.coalesce("o.urls", "b.urls", empty_list()).alias("urls"), F.coalesce("o.url_subdomains", "b.url_subdomains", F.lit(True)).alias("url_subdomains"),
            F.concat(F.coalesce("b.sources", empty_list()), F.coalesce("o.sources", empty_list())).alias("sources"),
        )
    shared = F.count("*").over(Window.partitionBy("name")) > 1
    return merged.withColumn("shared", shared).withColumn("name", F.when(F.col("shared"), F.concat("name", F.lit(" ("), "group_type", F.lit(")"))).otherwise(F.col("name"))).drop("shared").select(
        "id", "name", "aliases", "group_type", "categories", "urls", "url_subdomains", "sources", "profile"
    )


def with_normal(df: DataFrame, source: str, to: str) -> DataFrame:
    """df with the normalised form of a text column; compatibility forms are folded first."""
    return df.withColumn(to, text.normalized(html.nfkc_column(F.col(source))))


def aliases(organizations: DataFrame, strong: tuple[str, ...] = fixed.STRONG_ALIASES) -> DataFrame:
    """org_id, name, group_type, alias, strong, anchor: the anchor is the alias's rarest token among all aliases."""
    exploded = organizations.select("id", "name", "group_type", F.explode(F.array_distinct(F.concat(F.array("name"), "aliases"))).alias("raw"))
    named = with_normal(exploded, "raw", "alias").where("alias <> ''").select(F.col("id").alias("org_id"), "name", "group_type", "alias").distinct()
    tokens = F.split("alias", " ")
    named = with_normal(named.withColumn("short", F.when(F.col("name").startswith("Princeton "), F.substring("name", 11, 1000))), "short", "short_name")
    generic = F.col("short_name").isNotNull() & (F.col("alias") == F.col("short_name")) & (F.size(tokens) < 3)
    shape = F.col("alias").isin(*strong) | ((F.size(tokens) >= 2) & (F.length("alias") >= 10) & ~F.col("alias").rlike(r"^(princeton|university) \w+$"))
    named = named.withColumn("strong", shape & ~F.col("alias").isin(*fixed.WEAK_ALIASES) & ~F.coalesce(generic, F.lit(False)))
    by_token = named.select("org_id", "alias", F.posexplode(tokens).alias("place", "token"))
    frequency = by_token.select("org_id", "alias", "token").distinct().groupBy("token").agg(F.count("*").alias("times"))
    anchors = by_token.join(frequency, "token").groupBy("org_id", "alias").agg(F.min_by("token", F.struct("times", "place")).alias("anchor"))
    return named.join(anchors, ["org_id", "alias"]).select("org_id", "name", "group_type", "alias", "strong", "anchor")


def token_frequency(organizations: DataFrame) -> DataFrame:
    """token, times: in how many aliases each token occurs."""
    found = aliases(organizations)
    return found.select("org_id", "alias", F.explode(F.array_distinct(F.split("alias", " "))).alias("token")).groupBy("token").agg(F.count("*").alias("times"))


def contacts(organizations: DataFrame) -> DataFrame:
    """email, org_id of the contact addresses that belong to one organization."""
    email = F.lower("profile.email")
    return organizations.where(email.rlike("@princeton\\.edu$")).groupBy(email.alias("email")).agg(F.min("id").alias("org_id"), F.count("*").alias("n")).where("n = 1").select("email", "org_id")


def find_organization(organizations: DataFrame, value: str) -> DataFrame:
    """The organization of that id, else of that name, else the only one of that alias: one row or none."""
    spark = organizations.sparkSession
    key = with_normal(spark.createDataFrame([(value,)], "value string"), "value", "key")
    names = with_normal(organizations.select("id", F.explode(F.concat(F.array("name"), "aliases")).alias("raw"), (F.lit(False)).alias("x")), "raw", "normal").drop("x")
    by_name = with_normal(organizations.select("id", "name"), "name", "normal").join(F.broadcast(key), F.col("normal") == F.col("key")).agg(F.min("id").alias("id")).select("id", F.lit(2).alias("order"))
    by_alias = names.join(F.broadcast(key), F.col("normal") == F.col("key")).agg(F.min("id").alias("id"), F.countDistinct("id").alias("n")).where("n = 1").select("id", F.lit(3).alias("order"))
    by_id = organizations.where(F.col("id") == value).select("id", F.lit(1).alias("order"))
    best = by_id.unionByName(by_name).unionByName(by_alias).where("id is not null").agg(F.min_by("id", "order").alias("id"))
    return organizations.join(best, "id", "left_semi")


def search_directory(organizations: DataFrame, query: str = "") -> DataFrame:
    """Organizations whose name, an alias or a category contains the query, both normalised."""
    if not query.strip():
        return organizations
    spark = organizations.sparkSession
    key = with_normal(spark.createDataFrame([(query,)], "value string"), "value", "key").select("key")
    parts = organizations.select("id", F.explode(F.concat(F.array("name"), "aliases", "categories")).alias("raw"))
    hits = with_normal(parts, "raw", "normal").join(F.broadcast(key), F.col("normal").contains(F.col("key")))
    return organizations.join(hits.select("id").distinct(), "id", "left_semi")


def gazetteer(locations: DataFrame, overrides: DataFrame | None = None, additions: DataFrame | None = None) -> DataFrame:
    """Locations with overrides (name, category, more aliases, drop) and additions of new ids."""
    out = locations
    if overrides is not None:
        o = overrides.select("id", F.col("name").alias("o_name"), F.col("category").alias("o_category"), F.col("aliases").alias("o_aliases"), F.col("drop").alias("o_drop"))
        name = F.coalesce("o_name", "name")
        out = locations.join(o, "id", "left").where("not coalesce(o_drop, false)").select(
            "id", name.alias("name"),
            F.array_distinct(F.concat("aliases", F.coalesce("o_aliases", empty_list()), F.when(name != F.col("name"), F.array("name")).otherwise(empty_list()))).alias("aliases"),
            F.coalesce("o_category", "category").alias("category"), "latitude", "longitude", "source",
        )
    if additions is not None:
        out = out.unionByName(additions.join(out.select("id"), "id", "left_anti"))
    return out


def locations_from_pois(pois: DataFrame) -> DataFrame:
    """A gazetteer from points of interest (schemas.POIS): named venues only, the first of each slug, by name."""
    squeezed = lambda c: text.collapse(F.coalesce(c, F.lit("")))
    kinds = F.create_map(*(F.lit(x) for pair in fixed.POI_CATEGORIES.items() for x in pair))
    rows = pois.select("id", "type", "lat", "long", squeezed("name").alias("short"), squeezed("alt_name").alias("full"), kinds[F.col("type")].alias("category"))
    club = F.col("short").isin(*fixed.EATING_CLUBS)
    rows = rows.where((F.col("short") != "") & F.col("short").rlike("[A-Za-z]{3}") & ~F.col("short").rlike(r"^[#\d]") & F.col("category").isNotNull())
    rows = rows.where((F.col("type") != "building") | club | F.col("short").rlike("Club|Inn|Church|Swim|Morven"))
    fuller = (F.length("full") > F.length("short")) & F.col("full").contains(F.split("short", " ")[0])
    rows = rows.withColumn("name", F.when(fuller, F.col("full")).otherwise(F.col("short")))
    slug = F.regexp_replace(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-"), "^-|-$", "")
    first = Window.partitionBy("slug").orderBy("id")
    rows = rows.withColumn("slug", slug).where("slug <> ''").withColumn("rank", F.row_number().over(first)).where("rank = 1")
    others = F.filter(F.array_distinct(F.array("short", "full")), lambda a: (a != "") & (a != F.col("name")))
    return rows.select(
        F.col("slug").alias("id"), F.when(club & ~F.col("name").contains("Club"), F.concat("name", F.lit(" Club"))).otherwise(F.col("name")).alias("name"),
        F.when(club, F.concat(others, F.array("short"))).otherwise(others).alias("aliases"), F.when(club, F.lit("social")).otherwise(F.col("category")).alias("category"),
        F.round("lat", 6).alias("latitude"), F.round("long", 6).alias("longitude"), F.concat(F.lit("campus-map:poi:"), F.col("id").cast("string")).alias("source"),
    ).orderBy("name")


def location_aliases(locations: DataFrame) -> DataFrame:
    """location_id, alias, anchor (its first token) of every name of at least two characters."""
    rows = with_normal(locations.select(F.col("id").alias("location_id"), F.explode(F.concat(F.array("name"), "aliases")).alias("raw")), "raw", "alias")
    return rows.where(F.length("alias") >= 2).select("location_id", "alias", F.split("alias", " ")[0].alias("anchor")).distinct()


def resolve_locations(phrases: DataFrame, locations: DataFrame, key: str = "key", phrase: str = "phrase") -> DataFrame:
    """key, phrase -> location_id, location_name, latitude, longitude, matched, room; the longest alias in the phrase wins, and phrases without one don't appear.

    Tokens of the phrases meet the aliases at their first token, so nothing is compared with the whole gazetteer.
    """
    rows = with_normal(phrases.select(key, phrase), phrase, "normal").where(F.length("normal") >= 2)
    tokens = rows.select(key, "normal", F.explode(F.array_distinct(F.split("normal", " "))).alias("anchor"))
    inside = lambda a: F.concat(F.lit(" "), F.col("normal"), F.lit(" ")).contains(F.concat(F.lit(" "), a, F.lit(" ")))
    found = tokens.join(location_aliases(locations), "anchor").where(inside(F.col("alias")) & ((F.length("alias") > 3) | (F.size(F.split("normal", " ")) <= 3)))
    best = found.groupBy(key).agg(F.max_by(F.struct("location_id", "alias", "normal"), F.struct(F.length("alias"), F.col("alias"), "location_id")).alias("best")).select(key, "best.*")
    padded = F.concat(F.lit(" "), F.col("normal"), F.lit(" "))
    after = F.substr(padded, F.expr("instr(concat(' ', normal, ' '), concat(' ', alias, ' '))") + F.length("alias") + 2)
    room = F.regexp_extract(after, r"^(?:room |rm )?([a-z]?\d{1,4}[a-z]?)(?![A-Za-z0-9_])", 1)
    names = locations.select(F.col("id").alias("location_id"), F.col("name").alias("location_name"), F.nullif("latitude", F.lit(0.0)).alias("latitude"), F.nullif("longitude", F.lit(0.0)).alias("longitude"))
    return best.join(names, "location_id").select(key, "location_id", "location_name", "latitude", "longitude", F.col("alias").alias("matched"), F.when(room.rlike("[1-9]"), F.upper(room)).alias("room"))
