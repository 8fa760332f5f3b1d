"""Personal data: exact patterns, and a semi-Markov conditional random field for what they miss.

The patterns give the base: e-mail addresses, IPv4 addresses, payment cards and
phone numbers in their usual forms. The field finds other forms (phone numbers
without a plus sign, addresses with "at" and "dot" spelt out, cards and
addresses with unusual separators). It scores whole candidate segments of up to
LONGEST tokens by features of the segment and of the words around it, and picks
the best segmentation of a region, boundaries and kinds together, by dynamic
programming. A segment is a candidate for a kind if it passes that kind's check
(digits, Luhn, parts at most 255, a domain). Regions are the tokens around
digits, at-signs and spelt-out signs; all other text is outside by construction.

A region is as long as it happens to be and isn't cut: its tokens are read in
blocks, and the program carries the states that a segment can reach back to,
each with the entities on its best path. So time and memory follow the text.

The field is trained by conditional likelihood on EXAMPLES generated lines, its
labelled sample; the generator's seed fixes the model. A found segment is kept
if it overlaps no base span. Base spans always stay.

Null texts are empty: no spans. Positions are code points, ends exclusive. Every
row gives one row, repeated ones and those with a null doc_id too; texts of any
length are read whole. ``redact`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

KINDS = ("email", "ip", "card", "phone")
ORDER = {k: i for i, k in enumerate(KINDS)}
Span = tuple[str, int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
DIGITS_RUN = re.compile(r"[0-9]+")
#: str.isdigit also holds for superscripts and circled numbers, which int() rejects.
DIGITS = frozenset("0123456789")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(DIGIT.findall(text))


def emails(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping addresses: from each at-sign back over the local part, but not into the match before."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield "email", start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def small_parts(match: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match.split("."))


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by start and then kind."""
    found = list(emails(text)) if "@" in text else []
    if DIGIT.search(text):
        found += [("ip", *m.span()) for m in IP.finditer(text) if small_parts(m.group())]
        found += [("card", *m.span()) for m in CARD.finditer(text) if 14 <= len(d := digits_of(m.group())) <= 19 and luhn(d)]
        if "+" in text:
            found += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m.group())) <= 15]
    return sorted(found, key=lambda s: (s[1], ORDER[s[0]]))


# The field.

TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\s\w]|[^\W]")
TRIGGER = re.compile(r"[0-9]+|@|[\[({<]\s*(?:at|dot)\s*[\])}>]|\b(?:at|dot)\b(?=\s+[\w-]+\s+(?:at|dot)\b)", re.I)
LONGEST = 24
#: Characters around a trigger that belong to its region.
REACH = 64
#: Tokens read at once, and how many before and after a segment its features may look at.
BLOCK = 2048
BEFORE, AFTER = 4, 8
#: The longest address that mail allows.
LONGEST_EMAIL = 254
CUES = {
    "mail": "email", "email": "email", "write": "email", "contact": "email", "reach": "email", "ip": "ip", "host": "ip", "server": "ip", "address": "ip", "ping": "ip", "gateway": "ip",
    "card": "card", "visa": "card", "pay": "card", "credit": "card", "mastercard": "card", "call": "phone", "phone": "phone", "tel": "phone", "mobile": "phone", "fax": "phone", "cell": "phone", "dial": "phone", "text": "phone", "number": "phone", "ring": "phone",
}
#: Endings of mail addresses that people write most.
ENDINGS = tuple("com org net edu gov info biz io app dev ai co uk de fr es it nl be ch at pl ru eu us ca au in jp cn br mx se no dk fi pt ie nz".split())
ARTICLES = ("the", "a", "an", "this", "our", "your")
LABELS = ("", *KINDS)
EMAIL, ADDRESS, PAYMENT, NUMBER = (LABELS.index(k) for k in KINDS)
EXAMPLES = 1500
ROUNDS = 5
SEED = 20240607

_DOT = r"(?:\.|[\[({<]\s*dot\s*[\])}>]|\bdot\b)"
_AT = r"(?:@|[\[({<]\s*at\s*[\])}>]|\bat\b)"
SPELT_EMAIL = re.compile(rf"[\w%+-]+(?:\s*{_DOT}\s*[\w%+-]+)*\s*{_AT}\s*[\w-]+(?:\s*{_DOT}\s*[\w-]+)*\s*{_DOT}\s*[A-Za-z]{{2,6}}", re.I | re.A)
SPELT_IP = re.compile(rf"[0-9]+(?:\s?(?:\[?\s?\.\s?\]?|{_DOT})\s?[0-9]+){{3}}", re.I)
SPACED_CARD = re.compile(r"[0-9]{4,6}(?:[ ./_-]?[0-9]{2,7}){2,4}")
SPACED_PHONE = re.compile(r"(?:\+|00)?[0-9]{0,3}[ .-]?\(?[0-9]{1,5}\)?(?:(?:\s?[./-]\s?| )?\(?[0-9]{2,8}\)?){1,6}")


def sound(label: int, text: str) -> bool:
    """The check that a segment of a kind must pass."""
    if label == EMAIL:
        return len(text) <= LONGEST_EMAIL and bool(SPELT_EMAIL.fullmatch(text))
    if label == ADDRESS:
        return small_parts(".".join(DIGITS_RUN.findall(text))) and bool(SPELT_IP.fullmatch(text))
    digits = digits_of(text)
    if label == PAYMENT:
        return 14 <= len(digits) <= 19 and luhn(digits) and bool(SPACED_CARD.fullmatch(text))
    return 10 <= len(digits) <= 15 and len(DIGITS_RUN.findall(text)) > 1 and bool(SPACED_PHONE.fullmatch(text))


class Region:
    """Some tokens of a text, as (token, start, end)."""

    def __init__(self, text: str, tokens: list[tuple[str, int, int]]):
        self.text, self.tokens = text, tokens
        self.lower = [t[0].lower() for t in tokens]

    def near_sign(self, i: int) -> bool:
        """Whether an at-sign, plain or spelt out, follows within a few tokens."""
        return any(t in ("@", "at") for t in self.lower[i + 1 : i + 1 + AFTER])

    def segments(self, done: int = 0, upto: int | None = None) -> Iterator[tuple[int, int, list[int]]]:
        """Candidates that end after token `done` and not after `upto`: first token, token after the last, labels."""
        n = len(self.tokens) if upto is None else upto
        for i in range(max(0, done + 1 - LONGEST), n):
            first = self.lower[i]
            if not (first[0] in DIGITS or first in "+(" or first.isalpha() and self.near_sign(i)):
                continue
            wordy = first[0] not in "+(" and self.near_sign(i)
            digits = groups = letters = signs = dots = 0
            for j in range(i + 1, min(n, i + LONGEST) + 1):
                t = self.lower[j - 1]
                if j - i > 1 and "\n" in self.text[self.tokens[j - 2][2] : self.tokens[j - 1][1]]:
                    break
                if t[0] in DIGITS:
                    digits, groups = digits + len(t), groups + 1
                elif t.isalpha():
                    letters += t != "dot"
                    dots += t == "dot" and signs > 0
                    signs += t == "at"
                    if letters and not wordy:
                        break
                elif t == "@":
                    signs += 1
                elif t == ".":
                    dots += signs > 0
                elif t not in "+()-/[]{}<>_%":
                    break
                if signs > 1 or digits > 19 and not letters:
                    break
                labels = []
                if t[0] in DIGITS and not letters:
                    labels = [k for k, fits in ((ADDRESS, groups == 4), (PAYMENT, 14 <= digits <= 19), (NUMBER, groups > 1 and 10 <= digits <= 15)) if fits]
                elif letters and signs == 1 and dots and t.isalpha() and 2 <= len(t) <= 6:
                    labels = [EMAIL]
                if j > done and labels:
                    raw = self.text[self.tokens[i][1] : self.tokens[j - 1][2]]
                    labels = [k for k in labels if sound(k, raw)]
                    if labels:
                        yield i, j, labels

    def features(self, i: int, j: int) -> tuple[str, ...]:
        """Whole-segment features."""
        words = self.lower[i:j]
        raw = self.text[self.tokens[i][1] : self.tokens[j - 1][2]]
        groups = [w for w in words if w[0] in DIGITS]
        digits = "".join(groups)
        letters = sum(w.isalpha() for w in words)
        marks = "".join(sorted({w for w in words if not w.isalnum()}))
        sizes = "-".join(str(min(9, len(g))) for g in groups[:6])
        signs = sum(w in ("@", "at") for w in words)
        dots = sum(w in (".", "dot") for w in words)
        out = [f"n{min(20, len(digits))}", f"g{len(groups)}", f"s{sizes}", f"m{marks}", f"l{min(6, letters)}", f"a{min(2, signs)}d{min(4, dots)}", f"first{words[0] if not words[0].isalnum() else 'x' if words[0].isalpha() else '9'}"]
        if letters and signs == 1 and dots and words[-1].isalpha():
            out.append(f"ends{min(5, len(words[-1]))}")
            known, article = words[-1] in ENDINGS, any(w in ARTICLES for w in words)
            form = "bare" if " " in raw and not {"@", "[", "(", "{", "<"} & set(words) else "signed"
            out += [form, f"ending{known}", f"{form}|{known}|{article}"]
        if not letters:
            if 14 <= len(digits) <= 19:
                out.append(f"luhn{luhn(digits)}")
            if len(groups) == 4:
                out.append(f"parts{all(len(g) <= 3 and int(g) < 256 for g in groups)}")
            out.append("spaced" if " " in raw else "close")
            lead = "00" if digits.startswith("00") else digits[0] if digits[0] in "01" else "2-9"
            out += [f"lead{lead}", f"lead{lead}|{sizes}"]
        cue = next((CUES[w] for w in reversed(self.lower[max(0, i - 3) : i]) if w in CUES), "none")
        out.append(f"cue{cue}")
        out.append(f"beside{'9' if i and self.lower[i - 1][0] in DIGITS else ''}{'9' if j < len(self.tokens) and self.lower[j][0] in DIGITS else ''}")
        edge = self.lower[i - 1] if i and self.tokens[i - 1][2] == self.tokens[i][1] else ""
        out.append(f"before{'9' if edge and edge[0] in DIGITS else 'x' if edge.isalpha() else edge}")
        edge = self.lower[j] if j < len(self.tokens) and self.tokens[j][1] == self.tokens[j - 1][2] else ""
        out.append(f"after{'9' if edge and edge[0] in DIGITS else 'x' if edge.isalpha() else edge}")
        out.append(f"joined{min(len(digits), 20)}|{sizes}|{marks}")
        return tuple(out)


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around triggers, as places in the text; those that touch are one."""
    start = end = -1
    for m in TRIGGER.finditer(text):
        if m.start() - REACH > end:
            if end >= 0:
                yield start, end
            start = max(0, m.start() - REACH)
        end = min(len(text), m.end() + REACH)
    if end >= 0:
        yield start, end


class Field:
    """Weights of (feature, kind), and of transitions between labels."""

    def __init__(self):
        self.weights: dict[tuple[str, int], float] = {}
        self.moves = [[0.0] * len(LABELS) for _ in LABELS]

    def score(self, features: tuple[str, ...], label: int) -> float:
        get = self.weights.get
        return sum(get((f, label), 0.0) for f in features)

    def lattice(self, region: Region) -> list[list[tuple[int, int, tuple[str, ...], float]]]:
        """For each end: (start, label, features, score) of the segments that end there."""
        out: list[list] = [[] for _ in range(len(region.tokens) + 1)]
        for j in range(1, len(out)):
            out[j].append((j - 1, 0, (), 0.0))
        for i, j, labels in region.segments():
            features = region.features(i, j)
            for label in labels:
                out[j].append((i, label, features, self.score(features, label)))
        return out

    def best(self, text: str, start: int, end: int) -> list[tuple[str, int, int]]:
        """The entities of the best segmentation of a stretch, in order.

        A column holds, for each label that the last segment may have, its best
        score and the entities so far as a linked list. Only the columns that a
        segment can begin at are kept.
        """
        source = TOKEN.finditer(text, start, end)
        tokens: list[tuple[str, int, int]] = []
        columns: list[dict[int, tuple[float, tuple | None]]] = [{0: (0.0, None)}]
        done, stay, moves = 0, self.moves[0][0], self.moves

        def into(column: dict, label: int) -> tuple[float, tuple | None]:
            return max(((score + moves[before][label], path) for before, (score, path) in column.items()), key=lambda x: x[0])

        while True:
            block = [(m.group(), m.start(), m.end()) for m in islice(source, BLOCK)]
            tokens += block
            upto = len(tokens) - AFTER if len(block) == BLOCK else len(tokens)
            region = Region(text, tokens)
            ending: dict[int, list] = {}
            for i, j, labels in region.segments(done, upto):
                ending.setdefault(j, []).append((i, labels, region.features(i, j)))
            base = done - len(columns) + 1
            for j in range(done + 1, upto + 1):
                last = columns[-1]
                column = {0: (last[0][0] + stay, last[0][1]) if len(last) == 1 else into(last, 0)}
                for i, labels, features in ending.get(j, ()):
                    for label in labels:
                        score, path = into(columns[i - base], label)
                        score += self.score(features, label)
                        if label not in column or score > column[label][0]:
                            column[label] = (score, (path, LABELS[label], tokens[i][1], tokens[j - 1][2]))
                columns.append(column)
            if len(block) < BLOCK:
                break
            cut = max(0, upto - LONGEST - BEFORE)
            tokens, done, columns = tokens[cut:], upto - cut, columns[-LONGEST - 1 :]
        path = max(columns[-1].values(), key=lambda x: x[0])[1]
        out = []
        while path:
            path, *entity = path
            out.append(tuple(entity))
        return out[::-1]

    def learn(self, region: Region, truth: list[tuple[int, int, int]], rate: float) -> None:
        """One step up the gradient of the log likelihood: observed less expected features."""
        lattice, n, size = self.lattice(region), len(region.tokens), len(LABELS)
        forward = [[0.0] * size for _ in range(n + 1)]
        backward = [[0.0] * size for _ in range(n + 1)]
        forward[0][0] = 1.0
        moves = [[math.exp(x) for x in row] for row in self.moves]
        weight = [[(i, label, f, math.exp(min(30.0, s))) for i, label, f, s in x] for x in lattice]
        for j in range(1, n + 1):
            for i, label, _, w in weight[j]:
                forward[j][label] += w * sum(forward[i][b] * moves[b][label] for b in range(size))
        backward[n] = [1.0] * size
        for j in range(n, 0, -1):
            for i, label, _, w in weight[j]:
                for b in range(size):
                    backward[i][b] += moves[b][label] * w * backward[j][label]
        total = sum(forward[n])
        gold, before = {}, 0
        steps, at = [], 0
        for i, j, label in [*truth, (n, n, 0)]:
            steps += [(k, k + 1, 0) for k in range(at, i)]
            if j > i:
                steps.append((i, j, label))
            at = j
        for i, j, label in steps:
            gold[i, j, label] = before
            self.moves[before][label] += rate
            before = label
        for j in range(1, n + 1):
            for i, label, features, w in weight[j]:
                share = 0.0
                for b in range(size):
                    p = forward[i][b] * moves[b][label] * w * backward[j][label] / total
                    if p > 1e-6:
                        self.moves[b][label] -= rate * p
                        share += p
                if label:
                    step = rate * ((1.0 if (i, j, label) in gold else 0.0) - share)
                    if abs(step) > 1e-6:
                        for f in features:
                            self.weights[f, label] = self.weights.get((f, label), 0.0) + step


# Generated lines to learn from.


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _word(rng: random.Random) -> str:
    return "".join(rng.choice(("er", "th", "on", "an", "re", "la", "chen", "mi", "so", "el")) for _ in range(rng.randint(1, 3)))


def _card(rng: random.Random) -> str:
    body = rng.choice("345") + _digits(rng, 14)
    return next(body + c for c in "0123456789" if luhn(body + c))


def _entity(rng: random.Random) -> tuple[str, str]:
    kind = rng.choice(KINDS)
    if kind == "email":
        at = rng.choice(("@", " at ", " at ", " AT ", " [at] ", " (at) ", "(at)", "[at]", " {at} "))
        dots = (" dot ", " [dot] ", " (dot) ", "(dot)", "[dot]", " DOT ", " {dot} ", ".", ".") if at != "@" else (".", ".", " dot ")
        dot = rng.choice(dots) if at not in (" at ", " AT ") else at.replace("at", "dot").replace("AT", "DOT")
        name = _word(rng) + rng.choice(("", "", dot + _word(rng), _digits(rng, 2), "_" + _word(rng), "-" + _word(rng)))
        domain = _word(rng) + rng.choice(("", "", "-" + _word(rng), dot + _word(rng)))
        return name + at + domain + dot + rng.choice(("com", "com", "org", "net", "edu", "de", "fr", "es", *ENDINGS)), kind
    if kind == "ip":
        sep = rng.choice((".", ".", "[.]", " . ", "(.)", " dot ", "[dot]", "(dot)"))
        if sep == "(.)":
            sep = "."
        return sep.join(str(rng.randint(0, 255)) for _ in range(4)), kind
    if kind == "card":
        number, sep = _card(rng), rng.choice(("", " ", "-", ".", "/"))
        if rng.random() < 0.2:
            body = "37" + _digits(rng, 12)
            number = next(body + c for c in "0123456789" if luhn(body + c))
            return sep.join((number[:4], number[4:10], number[10:])), kind
        return sep.join(number[i : i + 4] for i in range(0, 16, 4)), kind
    a, b, c, two = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4), lambda: _digits(rng, 2)
    return rng.choice((
        f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"1 ({a}) {b}-{c}", f"({a}){b}-{c}", f"+{two()} {a} {b} {c}", f"00{rng.choice('1234')}{rng.choice('0123')} {a} {b} {c}", f"00{two()} {two()} {_digits(rng, 4)} {c}",
        f"0{two()} {c} {_digits(rng, 4)}", f"0{a}/{_digits(rng, 7)}", f"0{a} {_digits(rng, 7)}", f"0{_digits(rng, 1)} {two()} {two()} {two()} {two()}", f"0{two()}-{_digits(rng, 8)}", f"00{two()}-{a}-{b}-{c}", f"0{_digits(rng, 4)} {_digits(rng, 6)}", f"({a}) {b} {c}",
    )), kind


def _other(rng: random.Random) -> str:
    """Numbers and words that are nobody's data."""
    year, month, day, hour = rng.randint(1950, 2030), rng.randint(1, 12), rng.randint(1, 28), rng.randint(0, 23)
    return rng.choice((
        f"{year}-{month:02d}-{day:02d}", f"{month}/{day}/{year}", f"{year}-{month:02d}-{day:02d} {hour:02d}:{_digits(rng, 2)}", f"{day:02d}.{month:02d}.{year} {hour:02d}:{_digits(rng, 2)}", f"{year}{month:02d}{day:02d}-{_digits(rng, 6)}", f"{year}/{month:02d}/{day:02d}/{_digits(rng, 4)}", f"{year}-{month:02d}-{day:02d} {_digits(rng, 4)}", f"{year}-{year + 4}-{_digits(rng, 4)}",
        f"{hour}:{_digits(rng, 2)}", f"v{rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}", _digits(rng, rng.randint(1, 12)), f"${_digits(rng, 3)}.{_digits(rng, 2)}", f"{_digits(rng, 3)}.{_digits(rng, 3)}.{_digits(rng, 3)},{_digits(rng, 2)}",
        f"{_digits(rng, 1)},{_digits(rng, 3)},{_digits(rng, 3)}", f"978-{_digits(rng, 1)}-{_digits(rng, 4)}-{_digits(rng, 4)}-{_digits(rng, 1)}", f"isbn 978-{_digits(rng, 1)}-{_digits(rng, 2)}-{_digits(rng, 6)}-{_digits(rng, 1)}", f"id={''.join(rng.choice('0123456789abcdef') for _ in range(20))}",
        f"{_word(rng)} at {_word(rng)} and {_word(rng)}", f"{_digits(rng, 3)}-{_digits(rng, 4)}", f"{_digits(rng, 4)} {_digits(rng, 4)}", f"{_digits(rng, 4)}-{_digits(rng, 4)}", f"{rng.randint(256, 999)}.{rng.randint(256, 999)}.{_digits(rng, 2)}.{_digits(rng, 1)}",
        f"{_digits(rng, 2)} | {_digits(rng, 3)} | {_digits(rng, 4)} | {_digits(rng, 3)}", "AKIA" + _digits(rng, 8), f"section {rng.randint(1, 9)}.{rng.randint(1, 9)}", f"section {rng.randint(1, 9)}.{rng.randint(1, 9)}.{rng.randint(1, 9)}.{rng.randint(1, 9)}", f"{_digits(rng, 20)}", f"{_digits(rng, 5)}-{_digits(rng, 4)}",
        f"{_word(rng)} at {_word(rng)} dot {_word(rng)}", f"{_digits(rng, 4)} {_digits(rng, 4)} {_digits(rng, 4)} {_digits(rng, 4)}", f"{_digits(rng, 1)} {_digits(rng, 2)} {_digits(rng, 2)} {_digits(rng, 3)} {_digits(rng, 2)} {_digits(rng, 1)}",
        " ".join(_digits(rng, rng.randint(1, 3)) for _ in range(rng.randint(5, 9))), " ".join(str(rng.randint(10, 99)) for _ in range(rng.randint(5, 7))), f"no. {_digits(rng, 6)}/{_digits(rng, 6)}", f"order {_digits(rng, 4)}-{_digits(rng, 8)}", f"DE{_digits(rng, 2)} {_digits(rng, 4)} {_digits(rng, 4)} {_digits(rng, 4)} {_digits(rng, 4)} {_digits(rng, 2)}", f"1Z {_digits(rng, 3)} AA{_digits(rng, 1)} {_digits(rng, 2)} {_digits(rng, 4)} {_digits(rng, 4)}", f"{_word(rng)} at {rng.choice(('the', 'a', 'our'))} dot com", f"{_digits(rng, 5)} {_digits(rng, 5)} {_digits(rng, 5)}",
    ))


def example(rng: random.Random) -> tuple[str, list[Span]]:
    text, spans = "", []
    for _ in range(rng.randint(1, 3)):
        text += " ".join(_word(rng) for _ in range(rng.randint(1, 4))) + " "
        if rng.random() < 0.5:
            entity, kind = _entity(rng)
            if rng.random() < 0.3:
                text += rng.choice([c for c, k in CUES.items() if k == kind]) + rng.choice((" ", ": "))
            spans.append((kind, len(text), len(text) + len(entity)))
            text += entity
        else:
            text += _other(rng)
        text += rng.choice((" ", ". ", ", "))
    return text + _word(rng), spans


def train(examples: int = EXAMPLES, rounds: int = ROUNDS, seed: int = SEED) -> Field:
    rng, field, data = random.Random(seed), Field(), []
    for _ in range(examples):
        text, spans = example(rng)
        region = Region(text, [(m.group(), m.start(), m.end()) for m in TOKEN.finditer(text)])
        starts, ends = {t[1]: i for i, t in enumerate(region.tokens)}, {t[2]: i + 1 for i, t in enumerate(region.tokens)}
        allowed = {(i, j, label) for i, j, labels in region.segments() for label in labels}
        truth = [t for kind, a, b in spans if a in starts and b in ends and (t := (starts[a], ends[b], LABELS.index(kind))) in allowed]
        data.append((region, truth))
    for k in range(rounds):
        for region, truth in data:
            field.learn(region, truth, 0.3 / (1 + k))
        rng.shuffle(data)
    return field


def added_spans(text: str, base: list[Span], field: Field) -> list[Span]:
    """Entities that the field finds, in order, none of which overlaps another or a base span."""
    starts, ends = [a for _, a, _ in base], list(accumulate((b for _, _, b in base), max))
    out = []
    for start, end in regions(text):
        for kind, a, b in field.best(text, start, end):
            before = bisect_left(starts, b)  # base spans that begin before this one ends
            if not before or ends[before - 1] <= a:
                out.append((kind, a, b))
    return out


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, by start and then kind."""
    base = base_spans(text)
    if not TRIGGER.search(text):
        return base, base
    return base, sorted(base + added_spans(text, base, field), key=lambda s: (s[1], ORDER[s[0]]))


def as_string(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_FIELDS: dict[tuple, Field] = {}


def trained(examples: int = EXAMPLES, rounds: int = ROUNDS, seed: int = SEED) -> Field:
    key = (examples, rounds, seed)
    if key not in _FIELDS:
        _FIELDS[key] = train(*key)
    return _FIELDS[key]


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """Counts of base spans by kind, the digest of the base spans, and all spans, of every row."""
    sent = df.sparkSession.sparkContext.broadcast(field or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            doc_ids, texts = common.ids_and_texts(batch)
            found = [all_spans(t, sent.value) for t in texts]
            counts = [[sum(s[0] == kind for s in base) for base, _ in found] for kind in KINDS]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_ids, pa.int64()), *(pa.array(c, pa.int64()) for c in counts),
                    pa.array([hashlib.sha256(as_string(base).encode()).hexdigest() for base, _ in found], pa.string()), pa.array([as_string(spans) for _, spans in found], pa.string()),
                ],
                [c.split()[0] for c in SCHEMA.split(", ")],
            )

    return common.documents(df, id_col, text_col).mapInArrow(common.trimmed(run), SCHEMA)


def masked(text: str, spans: list[Span]) -> str:
    """The text with a mark of its kind for each span; overlapping spans are one, named by the first."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text_col: str = "text", field: Field | None = None) -> DataFrame:
    """df with the spans of every text masked. Null texts stay null; all columns stay."""
    common.small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(field or trained())
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            texts = [t if t is None else masked(t, all_spans(t, sent.value)[1]) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return df.mapInArrow(common.trimmed(run), df.schema)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text."""
    return find(common.table(spark, sf_dir, "documents"))
