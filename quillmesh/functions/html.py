"""Functions that have to walk HTML or URLs, as Arrow-batched pandas UDFs.

Everything that a column expression can do is in ``text``; these are the rest:
markup to text, previews, safe markup, media, link targets, delivery content
and keys, archive headers, and compatibility normalisation (NFKC).
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import unicodedata
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from functools import lru_cache
from html.parser import HTMLParser
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed

BLOCKS = {"p", "div", "table", "tr", "ul", "ol", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "section", "article", "header", "footer", "figure", "center"}
SILENT = {"script", "style", "head", "title", "iframe", "svg", "noscript", "math", "textarea", "option", "xmp"}
VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "area", "base", "col", "source"}
HEADINGS = {"h1", "h2", "h3"}


class _TextWriter(HTMLParser):
    """Text of a page: blocks apart, items marked, links followed by their target unless hidden."""

    def __init__(self, targets: bool, shout: bool):
        super().__init__(convert_charrefs=True)
        self.targets, self.shout = targets, shout
        self.out: list[str] = []
        self.silent = self.verbatim = self.heading = 0
        self.links: list[tuple[str, int]] = []
        self.lists: list[int | None] = []

    def _break(self, lines: int) -> None:
        self.out.append("\n" * lines)

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent += tag not in VOID
        if self.silent:
            return
        if tag == "br":
            self._break(1)
        elif tag == "hr":
            self.out.append("\n" + "-" * 40 + "\n")
        elif tag in BLOCKS:
            self._break(2 if tag in ("p", "ul", "ol", "blockquote", "table", "h1", "h2", "h3") else 1)
        if tag == "ol":
            self.lists.append(0)
        elif tag == "ul":
            self.lists.append(None)
        elif tag == "li":
            if self.lists and self.lists[-1] is not None:
                self.lists[-1] += 1
                self.out.append(f" {self.lists[-1]}. ")
            else:
                self.out.append(" * ")
        elif tag in ("td", "th"):
            self.out.append(" ")
        elif tag == "pre":
            self.verbatim += 1
        elif tag in HEADINGS:
            self.heading += 1
        elif tag == "a":
            self.links.append((dict(attrs).get("href") or "", len(self.out)))

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
            return
        if self.silent:
            return
        if tag in BLOCKS:
            self._break(2 if tag in ("p", "ul", "ol", "blockquote", "table", "h1", "h2", "h3") else 1)
        if tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        elif tag == "pre":
            self.verbatim = max(0, self.verbatim - 1)
        elif tag in HEADINGS:
            self.heading = max(0, self.heading - 1)
        elif tag == "a" and self.links:
            href, at = self.links.pop()
            label = "".join(self.out[at:]).strip()
            target = href.removeprefix("mailto:")
            if self.targets and href and target != label:
                self.out.append(f" [{href}]" if label else f"[{href}]")

    def handle_data(self, data):
        if self.silent:
            return
        if not self.verbatim:
            if "  " in data or any(c in data for c in "\t\r\n\f"):
                data = re.sub(r"[ \t\r\n\f]+", " ", data)
            if data.startswith(" ") and (not self.out or self.out[-1].endswith(("\n", " "))):
                data = data[1:]
        self.out.append(data.upper() if self.heading and self.shout else data)


def page_text(source: str, targets: bool = True, shout: bool = True) -> str:
    writer = _TextWriter(targets, shout)
    writer.feed(source)
    writer.close()
    lines = [line.rstrip(" \t") for line in "".join(writer.out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip("\n")


_TAG = re.compile(fixed.HTML_TAG)


def clean_whitespace(value: str) -> str:
    value = re.sub(r"\n[ \t]+", "\n", value.replace("\r\n", "\n").replace(" ", " "))
    return re.sub(r"\n{3,}", "\n\n", value).strip()


def looks_like_html(value: str) -> bool:
    return bool(_TAG.search(value))


def drop_notices(text: str) -> str:
    for pattern in (fixed.SUBSCRIBER_NOTICE, fixed.FORMS_WARNING, fixed.SUBSCRIBER_NOTICE):
        found = re.match(pattern, text)  # they begin with the text; a search would try every place
        text = text[found.end() :] if found else text
    return text


def may_unsubscribe(text: str) -> bool:
    """Whether a line of UNSUBSCRIBE can be there: one form has a link, the other a quotation mark, neither of which has cases."""
    return "://" in text or '"' in text or "“" in text


def is_relay_footer(text: str) -> bool:
    flat = " ".join(text.split())
    return flat.startswith(fixed.RELAY_FOOTER) and bool(re.search(fixed.RELAY_MARKS[0], flat)) and all(m in flat for m in fixed.RELAY_MARKS[1:])


def drop_footer(text: str) -> str:
    text = (re.sub(fixed.UNSUBSCRIBE, "", text) if may_unsubscribe(text) else text).rstrip()
    start = text.find(fixed.RELAY_FOOTER)
    if start < 0 or not is_relay_footer(text[start:]):
        return text
    end = re.search(fixed.RELAY_END, text[start:])
    if not end:
        return text
    head = text[:start].rstrip()
    bare = head.rstrip("-_")
    return ((bare.rstrip() if len(head) - len(bare) >= 3 else head) + text[start + end.end() :]).rstrip()


def readable_text(body: str | None, body_html: str | None = None) -> str:
    text = clean_whitespace(page_text(body_html)) if body_html and looks_like_html(body_html) else clean_whitespace(body or "")
    return drop_notices(drop_footer(text)).strip()


def preview(body: str | None, body_html: str | None = None, most: int = 230) -> str:
    """One line; markup that was escaped once or twice is decoded too."""
    text = body_html or body or ""
    if not looks_like_html(text):
        text = page_text(text.replace("<", "&lt;").replace(">", "&gt;"), targets=False, shout=False)
    for _ in range(3):
        if not looks_like_html(text):
            break
        text = page_text(text, targets=False, shout=False)
    text = re.sub(r"[-_]{5,}", "", re.sub(r"\[https?://[^\]]+\]", "", drop_notices(drop_footer(text))))
    return " ".join(text.split())[:most]


# Safe markup.

SAFE_TAGS = {"p", "div", "span", "br", "hr", "a", "strong", "b", "em", "i", "u", "s", "blockquote", "ul", "ol", "li", "h1", "h2", "h3", "h4", "pre", "code", "sub", "sup", "table", "thead", "tbody", "tr", "th", "td"}
SAFE_TARGET = re.compile(r"(?i)^(?:https?://|mailto:|tel:)")
BARE_URL = re.compile(r"""(?i)\bhttps?://[^\s<>"']*[^\s<>"'.,;:!?)\]}]""")
SHOWABLE = re.compile(r"(?i)<(?:p|div|span|br|a|pre|html|body|table|h[1-6]|ul|ol|b|strong|em|img)\b")


class _Node:
    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)


class _TreeBuilder(HTMLParser):
    """The allowed part of a page as a tree; other tags give way to their content, silent ones to nothing."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("")
        self.open = [self.root]
        self.silent: list[str] = []

    def handle_starttag(self, tag, attrs):
        if self.silent or tag in SILENT - {"head", "title"}:
            if tag not in VOID:
                self.silent.append(tag)
            return
        if tag not in SAFE_TAGS:
            return
        given = {k: v or "" for k, v in attrs}
        node = _Node(tag)
        if tag == "a":
            if SAFE_TARGET.match(given.get("href", "")):
                node.attrs = {k: given[k] for k in ("href", "title") if k in given} | {"target": "_blank", "rel": "noopener noreferrer"}
            else:
                node = _Node("span")
        self.open[-1].children.append(node)
        if tag not in VOID:
            node.opened = tag
            self.open.append(node)

    def handle_endtag(self, tag):
        if self.silent:
            if tag in self.silent:
                del self.silent[self.silent.index(tag) :]
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].opened == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        if not self.silent:
            self.open[-1].children.append(data)


def _drop_boilerplate(node: _Node) -> bool:
    """Remove blocks that are nothing but a notice or the relay's footer; whether a footer went."""
    removed, kept = False, []
    for child in node.children:
        if isinstance(child, _Node):
            removed |= _drop_boilerplate(child)
            if child.tag in ("div", "p"):
                text = child.text()
                bare = drop_notices(text)
                if bare != text and not bare.strip():
                    continue
                if is_relay_footer(text):
                    removed = True
                    continue
        kept.append(child)
    node.children = kept
    return removed


def _cut_unsubscribe(root: _Node) -> None:
    """Cut unsubscribe lines out of the text that runs through the tree."""
    spans: list[tuple[_Node, int, int, int]] = []
    text = ""

    def gather(node: _Node) -> None:
        nonlocal text
        for i, child in enumerate(node.children):
            if isinstance(child, str):
                spans.append((node, i, len(text), len(text) + len(child)))
                text += child
            elif child.tag == "a" and re.fullmatch("(?i)" + fixed.UNSUBSCRIBE_URL, child.attrs.get("href", "")):
                spans.append((node, i, len(text), len(text) + len(child.attrs["href"])))
                text += child.attrs["href"]
            else:
                gather(child)
                if child.tag in ("br", "p", "div", "hr"):
                    text += "\n"

    gather(root)
    gone = [m.span() for m in re.finditer(fixed.UNSUBSCRIBE, text)] if may_unsubscribe(text) else []
    for node, i, a, b in spans:
        for x, y in reversed(gone):
            low, high = max(a, x), min(b, y)
            if low < high:
                child = node.children[i]
                node.children[i] = child[: low - a] + child[high - a :] if isinstance(child, str) else ""


def _render(node: _Node, linked: bool = False) -> str:
    out = []
    for child in node.children:
        if isinstance(child, str):
            at = 0
            for m in [] if linked or "://" not in child else BARE_URL.finditer(child):
                out.append(entities.escape(child[at : m.start()], quote=False))
                url = entities.escape(m.group())
                out.append(f'<a href="{url}" target="_blank" rel="noopener noreferrer">{entities.escape(m.group(), quote=False)}</a>')
                at = m.end()
            out.append(entities.escape(child[at:], quote=False))
            continue
        attrs = "".join(f' {k}="{entities.escape(v)}"' for k, v in child.attrs.items())
        out.append(f"<{child.tag}{attrs}>")
        if child.tag not in VOID:
            out.append(_render(child, linked or child.tag in ("a", "pre", "code")) + f"</{child.tag}>")
    return "".join(out)


def display_html(source: str | None) -> str:
    """Original links and basic formatting; nothing that runs or loads from elsewhere. Empty if the source isn't markup."""
    if not source or not SHOWABLE.search(source):
        return ""
    builder = _TreeBuilder()
    builder.feed(source)
    builder.close()
    removed = _drop_boilerplate(builder.root)
    _cut_unsubscribe(builder.root)
    out = _render(builder.root)
    if removed:
        out = re.sub(r"(?i)(?:\s*<(?:hr|br)\s*/?>)+(?=\s*(?:</(?:div|p|span)>\s*)*$)", "", out).rstrip()
    found = re.match(fixed.SUBSCRIBER_NOTICE, out)
    return out[found.end() :] if found else out


# Media.


_WHOLE_URL = re.compile(r"(?i)https?://[^/?#\s]")


@lru_cache(1000)
def clean_media_url(raw: str | None) -> str | None:
    value = (raw or "").replace("&amp;", "&").strip()
    try:
        url = urlsplit(value if _WHOLE_URL.match(value) else urljoin(fixed.ARCHIVE_BASE, value))
        if (url.hostname or "").endswith("googleusercontent.com") and re.match("https?://", url.fragment):
            url = urlsplit(url.fragment)
        if url.scheme not in ("http", "https") or not url.hostname or url.username or url.password:
            return None
        query = url.query
        if url.hostname == fixed.LIST_HOST:
            pairs = parse_qsl(query, keep_blank_values=True)
            if url.path != "/cgi-bin/wa" or not any(k.upper() == "A3" for k, _ in pairs):
                return None
            query = urlencode([(k, v) for k, v in pairs if k.upper() not in ("X", "Y", "PASSWORD", "HEADER", "XSS")])
        return urlunsplit((url.scheme, url.netloc.lower(), url.path or "/", query, ""))
    except ValueError:
        return None


class _Images(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[dict[str, str]] = []

    def handle_starttag(self, tag, attrs):
        if tag == "img":
            self.found.append({k: v or "" for k, v in attrs})


def _number(value: str | None) -> int | None:
    m = re.match(r"\d+", value or "")
    return int(m.group()) if m else None


def media_of(body_html: str | None, attachments: list[dict] | None = None, most: int = 40) -> list[dict]:
    """Images of the page and attachments, each once, without small and transport-only ones."""
    parser = _Images()
    parser.feed(body_html or "")
    out: dict[str, dict] = {}
    ignored: set[str] = set()
    for a in parser.found:
        url = None if re.match("(?i)(?:cid|data):", a.get("src", "")) else clean_media_url(a.get("src"))
        if not url:
            continue
        width, height = _number(a.get("width")), _number(a.get("height"))
        if 0 < (width or 99) <= 24 or 0 < (height or 99) <= 24 or urlsplit(url).hostname == "fonts.gstatic.com":
            ignored.add(url)
            continue
        out.setdefault(url, {"kind": "image", "name": urlsplit(url).path.split("/")[-1] or "image", "alt": (a.get("alt") or "Email image")[:300], "width": width, "height": height})
    for a in attachments or []:
        url = clean_media_url(a["url"])
        if not url or url in out or url in ignored:
            continue
        query = dict(reversed(parse_qsl(urlsplit(url).query)))
        mime = query.get("T", "").split(";")[0].lower()
        if mime in ("text/plain", "text/html", "message/rfc822") or a.get("type") == "View Message":
            continue
        name = (query.get("N") or a.get("type") or "Attachment")[:200]
        out[url] = {"kind": "image" if mime.startswith("image/") else "file", "name": name, "alt": name, "width": None, "height": None}
    return [{"id": hashlib.sha256(url.encode()).hexdigest()[:24], "url": url, **x} for url, x in list(out.items())[:most]]


# Delivery identity.

_HEADER = re.compile(r'(?is)<div\b[^>]*class="[^"]*archive[^"]*"[^>]*>\s*<b>([^<]+):</b>(.*?)</div>')


def archive_headers(page: str | None) -> dict:
    """identity_fields (from, reply-to, subject, date), rfc_message_id, recipient_lists, headers_complete of a rendered header block."""
    fields = {name.lower(): " ".join(entities.unescape(re.sub("<[^>]*>", "", value)).split()) for name, value in _HEADER.findall(page or "")}
    identity = re.search(r"<([^<>\s]+@[^<>\s]+)>", fields.get("message-id", ""))
    recipients = " ".join(fields.get(k, "") for k in ("to", "cc", "x-to", "x-cc")).upper()
    lists = sorted(set(re.findall(r"([A-Z0-9_-]+)@PRINCETON\.EDU", recipients)) & set(fixed.RESIDENTIAL_LISTS))
    try:
        moment = parsedate_to_datetime(fields.get("date", ""))
        date = moment.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.000Z") if moment.tzinfo else moment.strftime("%Y-%m-%dT%H:%M:%S.000Z")
    except (ValueError, TypeError, IndexError):
        date = ""
    return {
        "identity_fields": [fields.get("from", ""), fields.get("reply-to", ""), fields.get("subject", ""), date],
        "rfc_message_id": identity.group(1) if identity else None, "recipient_lists": lists, "headers_complete": bool(identity and lists),
    }


def _site_root(url: str) -> str:
    u = urlsplit(url)
    return urlunsplit((u.scheme, u.netloc.lower(), "/", u.query, u.fragment)) if u.scheme in ("http", "https") and u.netloc and u.path in ("", "/") else url


def unwrap_target(value: str, original: str | None) -> str:
    """A link's own target: without a gateway around it, or a share link's session data."""
    try:
        url = urlsplit(value)
        host = url.hostname or ""
        if original and host.endswith(".sharepoint.com"):
            source = urlsplit(original)
            rest = [p for p in parse_qsl(url.query, keep_blank_values=True) if p[0] not in ("xsdata", "sdata")]
            if (source.scheme, source.netloc, source.path, source.fragment) == (url.scheme, url.netloc, url.path, url.fragment) and rest == parse_qsl(source.query, keep_blank_values=True):
                value, url, host = original, source, source.hostname or ""
        if url.scheme == "https" and host.endswith(fixed.SAFELINKS):
            target = dict(reversed(parse_qsl(url.query))).get("url", "")
            if re.match("(?i)https?://", target):
                return target
        return value
    except ValueError:
        return value


class _Content(HTMLParser):
    SPACED = {"p", "div", "li", "tr", "td", "h1", "h2", "h3", "blockquote"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.resources: list[list[str]] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("head", "style", "script")
        if self.skip:
            return
        if tag in self.SPACED or tag == "br":
            self.text.append(" ")
        given = dict(attrs)
        for name in ("href", "src", "srcset", "poster"):
            if given.get(name):
                self.resources.append([tag, name, _site_root(unwrap_target(given[name], given.get("originalsrc")))])

    def handle_endtag(self, tag):
        if tag in ("head", "style", "script"):
            self.skip = max(0, self.skip - 1)
        if tag in self.SPACED:
            self.text.append(" ")

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


_TOKENS = re.compile(r"\w+|[^\w\s]")


def canonical_content(body_html: str | None) -> str:
    """Words, marks and targets of a message, without transport's wrapping and list footers, as JSON."""
    names = "|".join(fixed.RESIDENTIAL_LISTS)
    content = (body_html or "").replace("\r\n", "\n").strip()
    content = re.sub(fixed.SUBSCRIBER_NOTICE, "", content, count=1)
    content = re.sub(rf'(?i)\s*If you would like to unsubscribe from this listserv, please send a "SIGNOFF (?:{names})" command to LISTSERV@PRINCETON\.EDU\s*$', "", content)
    content = re.sub(rf"(?i)\s*To unsubscribe, click the following link:\s*https://lists\.princeton\.edu/cgi-bin/wa\?SUBED1=(?:{names})\s*$", "", content)
    flat = lambda block: " ".join(entities.unescape(re.sub("<[^>]+>", " ", block)).split())
    content = re.sub(r"(?is)<div\b[^>]*>\s*<strong>⚠ SECURITY WARNING</strong>.*?</div>", lambda m: "" if flat(m.group()) == fixed.FORMS_WARNING_TEXT else m.group(), content)
    parser = _Content()
    parser.feed(content)
    parser.close()
    tokens, resources = _TOKENS.findall("".join(parser.text)), parser.resources
    for name in map(str.lower, fixed.RESIDENTIAL_LISTS):
        url = f"{fixed.ARCHIVE_BASE}?SUBED1={name}&A=1"
        footer = _TOKENS.findall(f"To unsubscribe from the {name} list, click the following link: {url}")
        if tokens[-len(footer) :] == footer and resources and resources[-1] == ["a", "href", url]:
            tokens, resources = tokens[: -len(footer)], resources[:-1]
    return json.dumps([tokens, resources], ensure_ascii=False, separators=(",", ":"))


def delivery_key(headers: dict | None, body_html: str | None) -> str | None:
    """Key of a delivery, only from whole headers that name at least two residential lists."""
    if not headers or not headers["headers_complete"] or len(headers["recipient_lists"] or []) < 2 or not (body_html or "").strip():
        return None
    sender, reply_to, subject, date = ([f or "" for f in headers["identity_fields"] or []] + [""] * 4)[:4]  # records from elsewhere can have fewer
    if not sender or not date:
        return None
    parts = [sender, reply_to, subject, list(headers["recipient_lists"]), canonical_content(body_html)]
    return hashlib.sha256(json.dumps(parts, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def resolve_sender(name: str | None, email: str | None, body: str | None, body_html: str | None, relayed: bool | None = False) -> dict:
    """The author: named by the relay's footer if the relay sent it, else by the archive."""
    email = (email or "").strip()
    is_relay = lambda e: bool(re.match(fixed.RELAY_ADDRESS, e.strip()))
    through = bool(relayed) or is_relay(email)
    author = None
    for content in (body_html, body) if through else ():
        m = re.search(fixed.RELAY_AUTHOR, " ".join(page_text(content, targets=False).split())) if content else None
        if m and not is_relay(m.group(2)):
            author = m.group(1).strip(), m.group(2).lower()
            break
    address = author[1] if author else "" if is_relay(email) else email.lower()
    shown = (author[0] if author else re.sub("<[^>]*>", "", name or "").strip()) or fixed.DEFAULT_SENDER
    return {"name": shown, "email": address, "via": fixed.RELAY_NAME if through else None, "attribution": "hoagiemail-footer" if author else "archive-metadata" if address else "display-name-only"}


# The same as columns.

MEDIA = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType() if n in ("width", "height") else T.StringType()) for n in ("id", "url", "kind", "name", "alt", "width", "height")]))
HEADERS = T.StructType([T.StructField("identity_fields", T.ArrayType(T.StringType())), T.StructField("rfc_message_id", T.StringType()), T.StructField("recipient_lists", T.ArrayType(T.StringType())), T.StructField("headers_complete", T.BooleanType())])
SENDER = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "email", "via", "attribution")])


def _none(x):
    return None if x is None or x is pd.NA or (isinstance(x, float) and x != x) else x


def _text_udf(function, *columns) -> Column:
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([function(*(_none(x) for x in row)) for row in zip(*series)], dtype=object)

    # The hints tell pandas_udf what it is given; how many columns there are varies.
    kinds = {1: lambda a: run(a), 2: lambda a, b: run(a, b)}
    wrapped = kinds[len(columns)]
    wrapped.__annotations__ = {n: pd.Series for n in "ab"[: len(columns)]} | {"return": pd.Series}
    return F.pandas_udf(wrapped, T.StringType())(*columns)


def html_to_text_column(source) -> Column:
    return _text_udf(lambda s: None if s is None else clean_whitespace(page_text(s)), source)


def readable_text_column(body, body_html) -> Column:
    return _text_udf(readable_text, body, body_html)


def preview_column(body, body_html) -> Column:
    return _text_udf(preview, body, body_html)


def display_html_column(source) -> Column:
    return _text_udf(display_html, source)


def canonical_content_column(source) -> Column:
    return _text_udf(canonical_content, source)


def nfkc_column(x) -> Column:
    return _text_udf(lambda s: None if s is None else unicodedata.normalize("NFKC", s), x)


def clean_media_url_column(x) -> Column:
    return _text_udf(clean_media_url, x)


def media_column(body_html, attachments) -> Column:
    @F.pandas_udf(MEDIA)
    def run(pages: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([media_of(_none(p), None if a is None else list(a)) for p, a in zip(pages, lists)])

    return run(body_html, attachments)


def rules_column(rules: list[tuple[Column, str]]) -> Column:
    """array<boolean>: of each rule (text, pattern) whether the text meets it, case aside; null texts meet none.

    RE2 reads a text once for each pattern, whatever its alternatives; the JVM's
    expressions try every alternative at every place.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    texts: list[Column] = []
    places = []
    for column, _ in rules:
        at = next((i for i, c in enumerate(texts) if c is column), len(texts))
        texts += [column] * (at == len(texts))
        places.append(at)
    patterns = [p for _, p in rules]

    def run(*given: pa.Array) -> pa.Array:
        hits = [pc.fill_null(pc.match_substring_regex(given[i], p, ignore_case=True), False) for i, p in zip(places, patterns)]
        rows, n = len(given[0]), len(hits)
        table = np.stack([h.to_numpy(zero_copy_only=False) for h in hits], axis=1) if rows else np.empty((0, n), bool)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, rows * n + 1, n), pa.int32()), pa.array(table.reshape(-1)))

    kinds = {1: lambda a: run(a), 2: lambda a, b: run(a, b), 3: lambda a, b, c: run(a, b, c)}
    wrapped = kinds[len(texts)]
    wrapped.__annotations__ = {n: pa.Array for n in "abc"[: len(texts)]} | {"return": pa.Array}
    return F.arrow_udf(wrapped, T.ArrayType(T.BooleanType()))(*texts)


def tags_column(x: Column, limit: int = 4) -> Column:
    """The same as text.tags_from_text, for long texts."""
    found = rules_column([(x, p) for p in fixed.TAG_RULES.values()])
    names = F.array(*map(F.lit, fixed.TAG_RULES))
    return F.slice(F.transform(F.filter(F.arrays_zip(found.alias("met"), names.alias("tag")), lambda z: z["met"]), lambda z: z["tag"]), 1, limit)


def archive_headers_column(page) -> Column:
    @F.pandas_udf(HEADERS)
    def run(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([archive_headers(_none(p)) for p in pages], columns=HEADERS.names)

    return run(page)


def sender_column(name, email, body, body_html, relayed) -> Column:
    @F.pandas_udf(SENDER)
    def run(names: pd.Series, emails: pd.Series, bodies: pd.Series, pages: pd.Series, flags: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([resolve_sender(*(_none(x) for x in row)) for row in zip(names, emails, bodies, pages, flags)], columns=SENDER.names)

    return run(name, email, body, body_html, relayed)


def delivery_key_column(headers, body_html) -> Column:
    """headers: struct as archive_headers_column gives it; it reaches the UDF as JSON."""

    def run(text: str | None, page: str | None) -> str | None:
        return delivery_key(json.loads(text) if text else None, page)

    return _text_udf(run, F.to_json(headers), body_html)


def same_delivery(a_rfc, a_key, a_date: datetime, b_rfc, b_key, b_date: datetime) -> bool:
    """Whether two copies may be one delivery: the same message id, or the same key within two minutes."""
    if a_rfc and a_rfc == b_rfc:
        return True
    return bool(a_key) and a_key == b_key and abs((a_date - b_date).total_seconds()) <= 120
