"""Full-text search: stored postings, a web query language, and a rank.

Terms are lower-case words of letters and digits without English stop words,
stemmed by the Snowball rules for English. Weights are A for the subject, B for
sender and organization, C for the body (100,000 characters of it); positions run
on from field to field, as far as 16,383, and a term has 255 at most.

Queries: words must all occur, "quoted words" in that order, `or` between
alternatives, `-word` not at all. The rank is the usual weighted one: of a
single word or of alternatives the sum over terms of their weights, each further
occurrence counting less; of several words the closeness of their occurrences.

``postings`` makes the table that search reads: a row for each term of each
message, in PARTS parts by the term. ``search`` reads only its terms' rows, and
no text. ``evaluate_column`` does the same for rows that have no postings.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Stop words, weights, and the bounds of positions.
STOP = frozenset("i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split())
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2}
BODY_MOST, LAST_PLACE, MOST_PLACES = 100_000, 16_383, 255
PARTS = 64
_WORD = re.compile(r"[^\W_]+")

# Stemming.

_VOWELS = frozenset("aeiouy")
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# Words that the rules would treat wrongly, and those that end after the first step.
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
_AS_THEY_ARE = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
# Endings and what they become, the longest that fits first.
_SECOND = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al",
    "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
_THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
_FOURTH = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _vowel(c: str) -> bool:
    return c in _VOWELS


def _region(word: str, start: int) -> int:
    """Where the part after the first consonant that follows a vowel begins."""
    for i in range(start + 1, len(word)):
        if not _vowel(word[i]) and _vowel(word[i - 1]):
            return i + 1
    return len(word)


def _short_end(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    if len(word) == 2:
        return _vowel(word[0]) and not _vowel(word[1])
    return len(word) > 2 and not _vowel(word[-3]) and _vowel(word[-2]) and not _vowel(word[-1]) and word[-1] not in "wxY"


@lru_cache(200_000)
def stem(word: str) -> str:
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    # A y that is a consonant is written Y.
    letters = list(word)
    for i, c in enumerate(letters):
        if c == "y" and (i == 0 or _vowel(letters[i - 1])):
            letters[i] = "Y"
    word = "".join(letters)
    first = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    first = _region(word, 0) if first is None else first
    second = _region(word, first) if first < len(word) else len(word)

    def ends(endings) -> str | None:
        return next((e for e in endings if word.endswith(e)), None)

    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and any(map(_vowel, word[:-2])):
        word = word[:-1]
    if word in _AS_THEY_ARE:
        return word
    end = ends(("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if end in ("eedly", "eed"):
        if len(word) - len(end) >= first:
            word = word[: -len(end)] + "ee"
    elif end and any(map(_vowel, word[: -len(end)])):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(_DOUBLES):
            word = word[:-1]
        elif len(word) <= first and _short_end(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and not _vowel(word[-2]):
        word = word[:-1] + "i"
    end = ends(_SECOND)
    if end and len(word) - len(end) >= first:
        before = word[: -len(end)]
        if end == "li":
            word = before if before[-1:] and before[-1] in "cdeghkmnrt" else word
        elif end != "ogi" or before.endswith("l"):
            word = before + _SECOND[end]
    end = ends(_THIRD)
    if end and len(word) - len(end) >= (second if end == "ative" else first):
        word = word[: -len(end)] + _THIRD[end]
    end = ends(_FOURTH)
    if end and len(word) - len(end) >= second and (end != "ion" or word[: -len(end)].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e"):
        if len(word) - 1 >= second or len(word) - 1 >= first and not _short_end(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= second:
        word = word[:-1]
    return word.replace("Y", "y")


# Documents.

Places = dict[str, list[tuple[int, float]]]


def terms(text: str) -> list[tuple[str, int]]:
    """Terms and the places of their words, from 1; stop words take places."""
    return [(stem(w), i) for i, w in enumerate(_WORD.findall(text.lower()), 1) if w not in STOP]


def places(subject: str | None, people: str | None, body: str | None, only: frozenset[str] | None = None) -> Places:
    """Of each term its places, with weights; only: the terms that matter."""
    out: Places = {}
    base = 0
    for weight, text in ((WEIGHTS["A"], subject or ""), (WEIGHTS["B"], people or ""), (WEIGHTS["C"], (body or "")[:BODY_MOST])):
        found = terms(text)
        for term, at in found:
            if only is None or term in only:
                own = out.setdefault(term, [])
                if len(own) < MOST_PLACES and (not own or own[-1][0] < LAST_PLACE):
                    own.append((min(base + at, LAST_PLACE), weight))
        base += found[-1][1] if found else 0
    return out


# Queries.

Query = list[list[tuple[bool, list[tuple[str, int]]]]]


def parse(query: str) -> Query:
    """Alternatives; each is a list of (wanted, terms with their places)."""
    out: Query = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if not minus and not phrase and word.lower() == "or":
            if out[-1]:
                out.append([])
            continue
        found = terms(phrase or word)
        if found:
            out[-1].append((not minus, found))
    return [a for a in out if a]


def terms_of(asked: Query) -> frozenset[str]:
    return frozenset(t for parts in asked for _, found in parts for t, _ in found)


def meets(asked: Query, own: Places) -> bool:
    """Whether a document meets the query; one without terms meets none."""

    def has(found: list[tuple[str, int]]) -> bool:
        if any(t not in own for t, _ in found):
            return False
        at = {t: {p for p, _ in own[t]} for t, _ in found}
        (term, start), *rest = found
        return any(all(p + place - start in at[t] for t, place in rest) for p in at[term])

    return any(all(has(found) == wanted for wanted, found in parts) for parts in asked)


def _near(distance: int) -> float:
    return 1e-30 if distance > 100 else 1 / (1.005 + 0.05 * math.exp(distance / 1.5 - 2))


def rank_of(asked: Query, own: Places) -> float:
    """The weighted rank, above 0 for documents that have a term."""
    wanted = sorted(terms_of(asked))
    if len(asked) == 1 and len(wanted) > 1:
        apart, met = 1.0, False
        for i, a in enumerate(wanted):
            for b in wanted[:i]:
                for p, v in own.get(a, ()):
                    for q, w in own.get(b, ()):
                        if p != q:
                            met, apart = True, apart * (1 - math.sqrt(v * w * _near(abs(p - q))))
        return 1 - apart if met else 1e-20
    total = 0.0
    for term in wanted:
        weights = [w for _, w in own.get(term, ())]
        if weights:
            best = max(weights)
            at = weights.index(best)
            total += (best + sum(w / (j + 1) ** 2 for j, w in enumerate(weights)) - best / (at + 1) ** 2) / 1.64493406685
    return total / len(wanted) if wanted else 0.0


FOUND = T.StructType([T.StructField("matches", T.BooleanType()), T.StructField("rank", T.DoubleType())])


def evaluate_column(subject, people, body, query: str) -> Column:
    """struct(matches, rank) of rows without postings."""
    asked = parse(query)
    only = terms_of(asked)

    @F.pandas_udf(FOUND)
    def run(subjects: pd.Series, names: pd.Series, bodies: pd.Series) -> pd.DataFrame:
        own = [places(s, n, b, only) for s, n, b in zip(subjects, names, bodies)]
        met = [meets(asked, p) for p in own]
        return pd.DataFrame({"matches": met, "rank": [rank_of(asked, p) if m else 0.0 for p, m in zip(own, met)]})

    return run(subject, people, body)


# Stored postings.

POSTINGS = "id string, term string, places array<struct<at: int, weight: double>>, part int"


def part_of(term: str) -> int:
    import zlib

    return zlib.crc32(term.encode()) % PARTS


def postings(messages: DataFrame) -> DataFrame:
    """A row for each term of each message (id, subject, sender_name, organization_name, body_text); write it partitioned by part."""

    @F.pandas_udf("array<struct<term: string, places: array<struct<at: int, weight: double>>>>")
    def run(subjects: pd.Series, names: pd.Series, bodies: pd.Series) -> pd.Series:
        return pd.Series([[{"term": t, "places": [{"at": a, "weight": w} for a, w in own]} for t, own in places(s, n, b).items()] for s, n, b in zip(subjects, names, bodies)])

    found = run(F.col("subject"), F.concat_ws(" ", "sender_name", "organization_name"), F.col("body_text"))
    return messages.select("id", F.explode(found).alias("x")).select("id", "x.term", "x.places", F.pmod(F.crc32(F.col("x.term").cast("binary")), F.lit(PARTS)).cast("int").alias("part"))


def search_each(table: DataFrame, queries: dict[str, str]) -> DataFrame:
    """asked, id, rank of the messages that meet each named query, from postings that are read once for all. Each query needs a wanted term in every alternative."""
    asked = {name: parse(query) for name, query in queries.items()}
    if any(not any(wanted for wanted, _ in parts) for q in asked.values() for parts in q):
        raise ValueError("a query that only excludes words needs the ids of all messages")
    only = sorted(frozenset().union(*map(terms_of, asked.values())))

    @F.pandas_udf("array<struct<asked: string, rank: double>>")
    def run(held: pd.Series) -> pd.Series:
        known: dict = {}  # messages with the same places have the same answers

        def answers(xs) -> list[dict]:
            key = tuple(sorted((x["term"], tuple((p["at"], p["weight"]) for p in x["places"])) for x in xs))
            if key not in known:
                own = {t: list(at) for t, at in key}
                known[key] = [{"asked": name, "rank": rank_of(q, own)} for name, q in asked.items() if meets(q, own)]
            return known[key]

        return pd.Series([answers(xs) for xs in held])

    hits = table.where(F.col("part").isin(sorted({part_of(t) for t in only})) & F.col("term").isin(only)).groupBy("id").agg(F.collect_list(F.struct("term", "places")).alias("held"))
    return hits.select("id", F.explode(run("held")).alias("f")).select("f.asked", "id", "f.rank")


def search(table: DataFrame, query: str, ids: DataFrame | None = None) -> DataFrame:
    """id, rank of the messages that meet the query, from postings. ids: all messages' ids, needed only where an alternative has no wanted term."""
    asked = parse(query)
    only = sorted(terms_of(asked))

    @F.pandas_udf(FOUND)
    def run(held: pd.Series) -> pd.DataFrame:
        own = [{x["term"]: [(p["at"], p["weight"]) for p in x["places"]] for x in ([] if xs is None else xs)} for xs in held]
        met = [meets(asked, p) for p in own]
        return pd.DataFrame({"matches": met, "rank": [rank_of(asked, p) if m else 0.0 for p, m in zip(own, met)]})

    hits = table.where(F.col("part").isin([part_of(t) for t in only]) & F.col("term").isin(only)).groupBy("id").agg(F.collect_list(F.struct("term", "places")).alias("held"))
    if any(not any(wanted for wanted, _ in parts) for parts in asked):
        if ids is None:
            raise ValueError("a query that only excludes words needs the ids of all messages")
        hits = ids.select("id").join(hits, "id", "left")
    return hits.select("id", run("held").alias("f")).where("f.matches").select("id", F.col("f.rank").alias("rank"))
