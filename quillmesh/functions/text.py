"""Scalar functions as column expressions: identity, cleaning, links, tags, titles, times, similarity.

Lengths count code points. Nulls give null unless a default is named.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

C = Column | str


def col(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim(x: C) -> Column:
    """White space of every kind off both ends."""
    return F.regexp_replace(col(x), r"^[\s ]+|[\s ]+$", "")


def collapse(x: C) -> Column:
    return trim(F.regexp_replace(col(x), r"[\s ]+", " "))


# Identity.


def short_hash(x: C, length: int = 24) -> Column:
    return F.substring(F.sha2(col(x).cast("binary"), 256), 1, length)


def message_id(list_name: C, archive_id: C) -> Column:
    return short_hash(F.concat(col(list_name), F.lit(":"), col(archive_id)))


def event_id(message: C, idx: C) -> Column:
    return short_hash(F.concat(col(message), F.lit("#"), col(idx).cast("string")))


def official_event_id(external_id: C) -> Column:
    return short_hash(F.concat(F.lit("mpu#"), col(external_id)))


def subject_of(subject: C, list_name: C) -> Column:
    """The subject without its list's tag; `(No subject)` when nothing is left."""
    none = "(No subject)"
    given = F.coalesce(F.nullif(col(subject), F.lit("")), F.lit(none))
    bare = trim(F.regexp_replace(given, F.concat(F.lit(r"(?i)^\[\Q"), col(list_name), F.lit(r"\E\]\s*")), F.lit("")))
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit(none))


# Lists and addresses.


def is_residential(list_name: C) -> Column:
    return F.upper(col(list_name)).isin(*fixed.RESIDENTIAL_LISTS)


def is_valid_list(list_name: C) -> Column:
    return col(list_name).rlike("^[A-Z0-9_-]{2,40}$")


def list_label(list_name: C) -> Column:
    return F.when(col(list_name) == "FREEFOOD", F.lit("FreeFood")).otherwise(col(list_name))


def is_relay_address(email: C) -> Column:
    return trim(email).rlike(fixed.RELAY_ADDRESS)


def parse_address(raw: C) -> Column:
    """struct(name, email) of `Name <email>`, a bare address, or a bare name."""
    pattern = r'^\s*"?(.*?)"?\s*<([^<>]+)>\s*$'
    value, bare = F.coalesce(col(raw), F.lit("")), trim(F.coalesce(col(raw), F.lit("")))
    address = bare.contains("@") & ~bare.rlike(r"\s")
    return F.when(
        value.rlike(pattern), F.struct(trim(F.regexp_extract(value, pattern, 1)).alias("name"), trim(F.regexp_extract(value, pattern, 2)).alias("email"))
    ).otherwise(F.struct(F.when(address, F.lit("")).otherwise(bare).alias("name"), F.when(address, bare).otherwise(F.lit("")).alias("email")))


# Bodies.


def clean_whitespace(x: C) -> Column:
    out = F.replace(F.replace(col(x), F.lit("\r\n"), F.lit("\n")), F.lit(" "), F.lit(" "))
    return trim(F.regexp_replace(F.regexp_replace(out, r"\n[ \t]+", "\n"), r"\n{3,}", "\n\n"))


def notices(x: C) -> Column:
    """struct(body, has_forms_warning, changed): leading delivery notices removed."""
    first = F.regexp_replace(col(x), fixed.SUBSCRIBER_NOTICE, "")
    body = F.regexp_replace(F.regexp_replace(first, fixed.FORMS_WARNING, ""), fixed.SUBSCRIBER_NOTICE, "")
    return F.struct(body.alias("body"), first.rlike(fixed.FORMS_WARNING).alias("has_forms_warning"), (body != col(x)).alias("changed"))


def is_relay_footer(x: C) -> Column:
    flat = collapse(x)
    # The mark without blanks is looked for first, most texts need not be collapsed; parts of a plain `&` would all be worked out.
    marked = col(x).contains(fixed.RELAY_MARKS[2])
    return F.when(marked, flat.startswith(fixed.RELAY_FOOTER) & flat.rlike(fixed.RELAY_MARKS[0]) & flat.contains(fixed.RELAY_MARKS[1])).otherwise(marked)



def _trim_end(x: Column) -> Column:
    return F.regexp_replace(x, r"[\s ]+$", "")


def display_text(x: C) -> Column:
    """Unsubscribe lines and a whole relay footer removed; what follows the footer stays."""
    # One form of the lines has a link, the other a quotation mark.
    marked = col(x).contains("://") | col(x).contains('"') | col(x).contains("“")
    body = _trim_end(F.when(marked, F.regexp_replace(col(x), fixed.UNSUBSCRIBE, "")).otherwise(col(x)))
    start = F.instr(body, fixed.RELAY_FOOTER)
    tail = F.substr(body, start)
    end = F.regexp_instr(tail, F.lit(fixed.RELAY_END))
    head = _trim_end(F.regexp_replace(F.substr(body, F.lit(1), F.greatest(start - 1, F.lit(0))), r"[-_]{3,}\s*$", ""))
    rest = F.substr(tail, end + F.length(F.regexp_substr(tail, F.lit(fixed.RELAY_END))))
    return F.when((start > 0) & is_relay_footer(tail) & (end > 0), _trim_end(F.concat(head, rest))).otherwise(body)


def looks_like_html(x: C) -> Column:
    return col(x).rlike(fixed.HTML_TAG)


def readable(text: C) -> Column:
    """What readers and extractors read, from text whose markup is gone already."""
    return trim(notices(display_text(text))["body"])


def message_content(body: C, powered_by: tuple[str, ...] = fixed.POWERED_BY) -> Column:
    """The author's own words: up to the first boilerplate (that of the named applications too) or quoted message, 24,000 at most."""
    return F.substring(F.split(col(body), fixed.content_end(powered_by), 2)[0], 1, 24000)


def extract_links(html: C) -> Column:
    """Distinct http links in order; safe links unwrapped, the list host's own dropped."""
    found = F.regexp_extract_all(F.coalesce(col(html), F.lit("")), F.lit(r"""(?i)href\s*=\s*["'](https?://[^"']+)["']"""), F.lit(1))

    def unwrapped(url: Column) -> Column:
        plain = F.replace(url, F.lit("&amp;"), F.lit("&"))
        target = F.try_url_decode(F.try_parse_url(plain, F.lit("QUERY"), F.lit("url")))
        return F.when(F.lower(F.try_parse_url(plain, F.lit("HOST"))).endswith(fixed.SAFELINKS) & target.rlike("(?i)^https?://"), target).otherwise(plain)

    host = lambda url: F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.array_distinct(F.filter(F.transform(found, unwrapped), lambda u: host(u).isNotNull() & (host(u) != fixed.LIST_HOST)))


def clean_archive_url(url: C) -> Column:
    """The URL without its session parameters X, Y and P."""
    bare = F.regexp_replace(col(url), r"(?i)(?<=[?&])(?:X|Y|P)=[^&#]*(?:&|(?=#|$))", "")
    return F.regexp_replace(bare, r"[?&](?=#|$)", "")


# Words, tags and titles.


def normalized(x: C) -> Column:
    """Letters and numbers in lower case, single spaces between; `&` is `and`. Compatibility forms are the caller's matter (see html.nfkc)."""
    return F.trim(F.regexp_replace(F.replace(F.lower(col(x)), F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}]+", " "))


def similarity_words(x: C) -> Column:
    """Distinct lower-case words of more than two ASCII letters or digits."""
    words = F.split(F.lower(F.coalesce(col(x), F.lit(""))), "[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 2))


def jaccard(a: C, b: C) -> Column:
    """Of two word arrays; 0 where both are empty."""
    both = F.size(F.array_intersect(col(a), col(b)))
    union = F.size(col(a)) + F.size(col(b)) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def tags_from_text(x: C, limit: int = 4) -> Column:
    found = F.array(*(F.when(col(x).rlike(fixed.ascii_words(p)), F.lit(tag)) for tag, p in fixed.TAG_RULES.items()))
    return F.slice(F.array_compact(found), 1, limit)


def is_event_tag(x: C) -> Column:
    return col(x).isin(*fixed.EVENT_TAGS)


def category(subject: C, body: C) -> Column:
    """The first rule that the subject meets, else that subject and body meet."""
    text = F.concat(col(subject), F.lit("\n"), F.substring(col(body), 1, 12000))
    return F.coalesce(*(F.when(x.rlike(fixed.ascii_words(p)), F.lit(name)) for x in (col(subject), text) for name, p in fixed.CATEGORY_RULES), F.lit(fixed.DEFAULT_CATEGORY))


def clean_title(subject: C) -> Column:
    title = collapse(subject)
    for _ in range(4):
        title = trim(F.regexp_replace(F.regexp_replace(title, r"^\s*\[[^\]]{1,40}\]\s*", ""), r"(?i)^\s*(?:re|fwd?|fw)\s*:\s*", ""))
    title = F.regexp_replace(title, "(?i)" + fixed.TITLE_LEAD, "")
    logistics = F.lit(fixed.ascii_words(fixed.TITLE_LOGISTICS))
    head = F.substr(title, F.lit(1), F.regexp_instr(title, logistics) - 1)
    title = F.when((F.regexp_instr(title, logistics) > 0) & (F.size(F.split(trim(head), r"\s+")) >= 2), head).otherwise(title)
    title = trim(F.regexp_replace(title, r"[\s!:,\-–—|(]+$", ""))
    return F.substring(F.coalesce(F.nullif(title, F.lit("")), F.nullif(col(subject), F.lit("")), F.lit("Untitled event")), 1, 200)


def summarize(body: C, most: int = 600) -> Column:
    """Whole paragraphs while they fit, else the beginning."""
    paragraphs = F.filter(F.transform(F.split(col(body), r"\n\s*\n"), collapse), lambda p: F.length(p) > 0)

    def add(state: Column, p: Column) -> Column:
        fits = ~state["full"] & (F.length(state["out"]) + 1 + F.length(p) <= most)
        grown = F.when(F.length(state["out"]) > 0, F.concat(state["out"], F.lit("\n\n"), p)).otherwise(p)
        return F.struct(F.when(fits, grown).otherwise(state["out"]).alias("out"), (~fits).alias("full"))

    out = F.aggregate(paragraphs, F.struct(F.lit("").alias("out"), F.lit(False).alias("full")), add)["out"]
    return F.substring(F.coalesce(F.nullif(out, F.lit("")), collapse(body)), 1, most)


def series_key(host: C, title: C) -> Column:
    """Same host and same title once weekdays, months and numbers are gone."""
    out = F.lower(col(title))
    for p in (r"\b(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\b", r"\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\b"):
        out = F.regexp_replace(out, fixed.ascii_words(p, ""), " ")
    return short_hash(F.concat(F.coalesce(col(host), F.lit("")), F.lit("|"), F.trim(F.regexp_replace(out, "[^a-z]+", " "))), 16)


def location_candidates(text: C) -> Column:
    """Phrases that may name a place: labelled ones, pinned ones, then those after a preposition."""
    find = lambda p: F.regexp_extract_all(col(text), F.lit(p), F.lit(1))
    phrases = F.concat(find(fixed.ascii_words(fixed.LOCATION_LABEL)), find(fixed.LOCATION_PIN), find(fixed.ascii_words(fixed.LOCATION_PHRASE, "")))
    return F.filter(F.transform(phrases, lambda p: trim(F.regexp_replace(trim(p), r"[\s.,;:!]+$", ""))), lambda p: F.length(p) > 0)


def location_label(text: C) -> Column:
    """The first labelled place, or null."""
    found = F.regexp_extract(col(text), fixed.ascii_words(fixed.LOCATION_LABEL), 1)
    return F.nullif(trim(F.regexp_replace(found, r"[\s.,;:!]+$", "")), F.lit(""))


def forum_category(group_type: C, categories: C) -> Column:
    g, has = col(group_type), lambda *names: F.arrays_overlap(col(categories), F.array(*map(F.lit, names)))
    return (
        F.when(g.isin("Academic Department", "McGraw Center"), "academics")
        .when(g.startswith("ORL") | has("Religious", "Chaplaincies"), "religion")
        .when((g == "Campus Rec") | has("Sports/Recreation"), "athletics")
        .when(g.startswith("Pace Center") | has("Service", "Sustained Volunteering", "Community Immersion"), "community service")
        .when(has("Performing Arts", "Dance", "Music", "A Cappella", "Arts"), "performing arts")
        .when(has("Political", "Advocacy & Activism", "Student Government", "Social Justice", "Racial Justice"), "politics")
        .when(has("Career Opportunity", "Professional", "Finance", "Entrepreneurship/Innovation", "Professional Development"), "career")
        .when(has("Cultural/Identity"), F.when(g == "Graduate Student Organizations", "affinity").otherwise("culture"))
        .when(has("Academic", "Educational", "Research", "Public Lectures"), "academics")
        .otherwise("social event")
    )


def fingerprint(*fields: C) -> Column:
    """Hash of several texts; null is the empty text."""
    return F.sha2(F.to_json(F.array(*(F.coalesce(col(f), F.lit("")) for f in fields))).cast("binary"), 256)


# Times.


def micros(ts: C) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))


def within_seconds(a: C, b: C, seconds: int) -> Column:
    """Whether two times differ by at most so many seconds, to the microsecond."""
    return F.abs(micros(a) - micros(b)) <= seconds * 1_000_000


def local_to_utc(local: C, zone: str = fixed.TIME_ZONE) -> Column:
    """UTC timestamp_ntz of a local `YYYY-MM-DD[THH:MM]`: the offset is taken at the guess, then at the first result."""
    pattern = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}))?"
    text = trim(local)
    clock = F.coalesce(F.nullif(F.regexp_extract(text, pattern, 2), F.lit("")), F.lit("00:00"))
    guess = F.try_to_timestamp(F.concat(F.regexp_extract(text, pattern, 1), F.lit(" "), clock), F.lit("yyyy-MM-dd HH:mm"))
    offset = lambda t: F.unix_micros(F.from_utc_timestamp(t, zone)) - F.unix_micros(t)
    first = F.timestamp_micros(F.unix_micros(guess) - offset(guess))
    return F.when(text.rlike(pattern), F.timestamp_micros(F.unix_micros(guess) - offset(first)))


def local_string(ts: C, zone: str = fixed.TIME_ZONE) -> Column:
    return F.date_format(F.from_utc_timestamp(col(ts), zone), "yyyy-MM-dd'T'HH:mm '('EEEE')'")


def sorted_list(x: C) -> Column:
    """Aggregate: sorted values, null for none."""
    return F.nullif(F.sort_array(F.collect_list(col(x))), F.array().cast("array<string>"))


def any_of(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values))
