"""Removal of repeated byte strings by column-wise suffix-array construction.

A byte goes if a string of SPAN bytes that covers it also starts in a document
with a smaller id. The suffixes of many short texts are put in order together:
in each round every text gives one more symbol, going from its end to its
beginning, and the suffix that it makes is inserted where it belongs. The place
is found from the collection's Burrows-Wheeler transform, by counting the
symbol before the place of the shorter suffix; the common prefixes with both
neighbours are one longer than the least between the symbol's occurrences. At
the end suffixes that agree on SPAN bytes are neighbours.

Whole documents aren't put into one collection. Of the grams of GRAM bytes in a
string of SPAN bytes, the one of the least hash is its anchor; equal strings
have equal anchors. First it is found which anchors occur in several documents
(hashes only, packed by bucket). Around those, the pieces of text whose strings
have that anchor go to the anchor's bucket; pieces of equal content become one,
with the smallest of their documents. Each bucket's pieces, in blocks by
anchor, are the collections. So every string is compared with all its equals in
one place, the work follows the repeated text, and the rounds are few.

Rows with a null id count as after all others; null texts are empty. Rows that
share an id don't remove from each other, nor do rows with a null id. Texts of
any length are read whole. ``clean`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .jaccard import bucket_of, packed, runs, unpacked

SPAN = 50
GRAM = 20
LAST_ID = (1 << 63) - 1
BUCKET_BYTES = 12 << 20
#: Text whose anchors are found at once.
ANCHORED_BYTES = 1 << 19
#: Pieces put in order together, roughly.
BLOCK_PIECES = 4096
PLACE = np.uint64((1 << 24) - 1)


class Anchors:
    """The anchors of some texts: document, first and last string of each, and hash of its gram."""

    def __init__(self, texts: list[bytes]):
        # A long text is cut so that places fit PLACE; parts overlap, so that every string starts in one of them.
        parts = [(d, a, t[a : a + ANCHORED_BYTES + SPAN - 1]) for d, t in enumerate(texts) for a in range(0, max(1, len(t) - SPAN + 1), ANCHORED_BYTES)]
        found, at = [], 0
        while at < len(parts):
            end, size = at, 0
            while end < len(parts) and (end == at or size + len(parts[end][2]) <= ANCHORED_BYTES):
                size += len(parts[end][2])
                end += 1
            found.append(Block([t for _, _, t in parts[at:end]], at))
            at = end
        part, self.first, self.last, self.hash = (np.concatenate([getattr(b, name) for b in found]) if found else np.zeros(0, kind) for name, kind in (("doc", np.int64), ("first", np.int64), ("last", np.int64), ("hash", np.uint64)))
        shift = np.array([a for _, a, _ in parts], np.int64)[part]
        self.doc, self.first, self.last = np.array([d for d, _, _ in parts], np.int64)[part], self.first + shift, self.last + shift


class Block:
    """The anchors of a few texts, the first of which has the given number."""

    def __init__(self, texts: list[bytes], number: int):
        symbols = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([0, *map(len, texts)])
        self.doc = self.first = self.last = np.zeros(0, np.int64)
        self.hash = np.zeros(0, np.uint64)
        if len(symbols) < SPAN:
            return
        words = symbols.astype(np.uint64)
        for k in (1, 2, 4):
            words = words[:-k] | words[k:] << np.uint64(8 * k)
        with np.errstate(over="ignore"):
            count = len(symbols) - GRAM + 1
            hashes = np.zeros(count, np.uint64)
            for k in (*range(0, GRAM - 8, 8), GRAM - 8):
                hashes = common.mix64(hashes * np.uint64(0x9E3779B97F4A7C15) ^ words[k : k + count])
        least = hashes & ~PLACE | np.arange(len(hashes), dtype=np.uint64)
        width, grams = 1, SPAN - GRAM + 1
        while width * 2 <= grams:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < grams:
            least = np.minimum(least[: -(grams - width)], least[grams - width :])
        inside = np.ones(len(least), bool)
        for end in ends[1:-1].tolist():
            inside[max(0, end - SPAN + 1) : end] = False
        strings = np.flatnonzero(inside)
        start, length = runs(least[strings] & PLACE)
        self.first, self.last = strings[start], strings[start + length - 1]
        self.hash = hashes[(least[self.first] & PLACE).astype(np.int64)]
        self.doc = np.searchsorted(ends, self.first, "right") - 1
        self.first, self.last = self.first - ends[self.doc], self.last - ends[self.doc]
        self.doc = self.doc + number


ANCHORS = "bucket int, rows binary, ids binary, counts binary, keys binary"


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], [c for c, _ in fields])


def bodies(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    return [(t or "").encode() for t in batch.column(column).to_pylist()]


def anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """All anchors, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            found = Anchors(bodies(batch))
            rows, ids = batch.column("row").to_numpy(), batch.column("id").to_numpy()
            place = bucket_of(found.hash, buckets)
            order = np.argsort(place, kind="stable")
            doc, keys, place = found.doc[order], found.hash[order] & np.uint64((1 << 48) - 1), place[order]
            out = []
            for a, length in zip(*runs(place)):
                whose, times = runs(doc[a : a + length])
                own = doc[a + whose]
                out.append((int(place[a]), rows[own].tobytes(), ids[own].tobytes(), times.astype(np.uint32).tobytes(), packed(keys[a : a + length])))
            yield batch_of(out, ANCHORS)

    return docs.select("row", "id", "text").mapInArrow(common.trimmed(run), ANCHORS)


SHARED = "chunk int, bucket int, rows binary, counts binary, keys binary"


def full_keys(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return hashes & np.uint64((1 << 48) - 1) | (bucket_of(hashes, buckets).astype(np.uint64) & np.uint64(0xFFFF)) << np.uint64(48)


def shared_anchors(found: DataFrame, chunks: int) -> DataFrame:
    """To each chunk of documents the anchors of its rows that occur in several documents."""

    def count(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        read = lambda name, kind: [np.frombuffer(b, kind) for b in group.column(name).to_pylist()]
        rows, ids, counts = np.concatenate(read("rows", np.int64)), np.concatenate(read("ids", np.int64)), np.concatenate(read("counts", np.uint32))
        keys = np.concatenate([unpacked(b) for b in group.column("keys").to_pylist()])
        of = np.repeat(np.arange(len(rows)), counts)
        order = np.argsort(keys, kind="stable")
        keys, of = keys[order], of[order]
        start, length = runs(keys)
        whose = ids[of]
        several = np.repeat(np.minimum.reduceat(whose, start) < np.maximum.reduceat(whose, start), length) if len(keys) else np.zeros(0, bool)
        keys, of = keys[several], of[several]
        chunk = np.mod(rows[of], chunks)
        order = np.lexsort((of, chunk))
        keys, of, chunk = keys[order], of[order], chunk[order]
        out = []
        for a, n in zip(*runs(chunk)):
            first, times = runs(of[a : a + n])
            out.append((int(chunk[a]), bucket, rows[of[a + first]].tobytes(), times.astype(np.uint32).tobytes(), packed(keys[a : a + n])))
        return pa.Table.from_batches([batch_of(out, SHARED)])

    return found.groupBy("bucket").applyInArrow(common.trimmed_group(count), SHARED)


#: Columns of key, id for comparison, text and chunk.
NAMES = ("row", "id", "text", "chunk")
PIECES = "bucket int, text binary, lengths binary, anchors binary, piece binary, docs binary, rows binary, ids binary, starts binary"


def pieces(docs: DataFrame, shared: DataFrame, buckets: int, names: tuple[str, str, str, str] = NAMES) -> DataFrame:
    """The text around shared anchors, to the anchors' buckets; equal pieces of a slice once. names: of the columns of docs."""
    row_name, id_name, text_name, chunk_name = names

    def cut(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        with np.errstate(over="ignore"):
            wanted = np.zeros(0, np.uint64)
            if right.num_rows:
                rows = np.concatenate([np.repeat(np.frombuffer(r, np.uint64), np.frombuffer(c, np.uint32)) for r, c in zip(right.column("rows").to_pylist(), right.column("counts").to_pylist())])
                keys = np.concatenate([unpacked(k) | np.uint64(b & 0xFFFF) << np.uint64(48) for b, k in zip(right.column("bucket").to_pylist(), right.column("keys").to_pylist())])
                wanted = np.unique(common.mix64(keys ^ common.mix64(rows)))
            out: list[tuple] = []
            press = zstandard.ZstdCompressor(level=1)
            for batch in common.slices(left.to_batches()) if len(wanted) else ():
                texts = bodies(batch, text_name)
                found = Anchors(texts)
                rows, ids = batch.column(row_name).to_numpy(), batch.column(id_name).to_numpy()
                code = common.mix64(full_keys(found.hash, buckets) ^ common.mix64(rows[found.doc].view(np.uint64)))
                at = np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)
                keep = np.flatnonzero(wanted[at] == code)
                place = bucket_of(found.hash[keep], buckets)
                order = np.argsort(place, kind="stable")
                keep, place = keep[order], place[order]
                for a, n in zip(*runs(place)):
                    own = keep[a : a + n]
                    known: dict[bytes, int] = {}
                    anchors_of: list[int] = []
                    piece = np.empty(n, np.uint32)
                    docs_of, doc_index = np.unique(found.doc[own], return_inverse=True)
                    for i, (d, s, e, h) in enumerate(zip(found.doc[own].tolist(), found.first[own].tolist(), found.last[own].tolist(), (found.hash[own] & np.uint64(0xFFFFFFFF)).tolist())):
                        content = texts[d][s : e + SPAN]
                        k = known.setdefault(content, len(known))
                        if k == len(anchors_of):
                            anchors_of.append(h)
                        piece[i] = k
                    out.append((
                        int(place[a]), press.compress(b"".join(known)), bytes(map(len, known)), np.array(anchors_of, np.uint32).tobytes(), piece.tobytes(),
                        doc_index.astype(np.uint32).tobytes(), rows[docs_of].tobytes(), ids[docs_of].tobytes(), found.first[own].astype(np.uint32).tobytes(),
                    ))
        return pa.Table.from_batches([batch_of(out, PIECES)])

    return docs.groupBy(chunk_name).cogroup(shared.groupBy("chunk")).applyInArrow(common.trimmed_pair(cut), PIECES)


def ordered_suffixes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all suffixes of all texts, in order: text, length, and common prefix with the one before.

    State: the transform (each suffix's preceding symbol plus one, 0 at the
    beginning of a text), the common prefixes, and which suffix stands where.
    """
    count = len(texts)
    lengths = np.array([len(t) for t in texts])
    most = int(lengths.max(initial=0))
    # Column k holds the symbol before the last k; 0 where a text has none.
    columns = np.zeros((most + 1, count), np.int16)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    of = np.repeat(np.arange(count), lengths)
    place = np.repeat(np.cumsum(lengths), lengths) - 1 - np.arange(len(flat))
    columns[place, of] = flat.astype(np.int16) + 1
    # Symbols numbered densely in one byte, their order kept.
    used = np.unique(columns)
    columns = np.searchsorted(used, columns).astype(np.uint8) + np.uint8(used[0] != 0) if len(used) <= 255 else columns.astype(np.uint16)
    before = columns[0].copy()
    common_prefix = np.zeros(count, np.uint8)
    suffix = np.arange(count, dtype=np.int64) << 8
    newest, active = np.arange(count), np.arange(count)
    for size in range(1, most + 1):
        going = before[newest] > 0
        newest, active = newest[going], active[going]
        if not len(active):
            break
        order = np.argsort(before, kind="stable")
        beginnings = int(np.count_nonzero(before == 0))
        is_newest = np.zeros(len(order), bool)
        is_newest[newest] = True
        target = np.flatnonzero(is_newest[order])
        # The texts in the order of their new suffixes.
        at = np.empty(len(order), np.int32)
        at[newest] = np.arange(len(newest), dtype=np.int32)
        active = active[at[order[target]]]
        # Common prefixes change for the new suffixes and for those right after them.
        near = np.zeros(len(order) + 1, bool)
        near[target] = near[target + 1] = True
        touched = np.flatnonzero(near[:-1])
        current, previous = order[touched], order[touched - 1]
        joined = (touched > beginnings) & (before[current] == before[previous])
        low, high = previous[joined] + 1, current[joined] + 1
        falling = np.argsort(-low, kind="stable")
        pairs = np.empty(2 * len(low), np.int64)
        pairs[::2], pairs[1::2] = low[falling], np.minimum(high[falling], len(common_prefix))
        value = np.zeros(len(touched), np.uint8)
        if len(low):
            between = np.minimum.reduceat(np.r_[common_prefix, np.uint8(0)], pairs)[::2]
            own = np.empty(len(low), np.uint8)
            own[falling] = between
            value[joined] = own + 1
        # Insertion: what was there keeps its order around the new suffixes.
        positions = count + target - beginnings
        total = len(before) + len(active)
        old = np.ones(total, bool)
        old[positions] = False
        grown_before, grown_common, grown_suffix = np.empty(total, before.dtype), np.empty(total, np.uint8), np.empty(total, np.int64)
        grown_before[old], grown_common[old], grown_suffix[old] = before, common_prefix, suffix
        grown_before[positions] = columns[size, active] if size <= most else 0
        grown_suffix[positions] = active << 8 | size
        changed = count + touched - beginnings
        grown_common[changed] = value
        before, common_prefix, suffix, newest = grown_before, grown_common, grown_suffix, positions
    return suffix >> 8, suffix & 255, common_prefix


def smallest_owners(texts: list[bytes], owners: np.ndarray) -> list[np.ndarray]:
    """For each string of SPAN bytes of each text, the smallest owner of a text that has it."""
    text, length, common_prefix = ordered_suffixes(texts)
    group = np.cumsum(common_prefix < SPAN) - 1
    least = np.minimum.reduceat(owners[text], np.flatnonzero(common_prefix < SPAN))
    out = [np.empty(max(0, len(t) - SPAN + 1), np.int64) for t in texts]
    whole = length >= SPAN
    bounds = np.cumsum([0, *map(len, out)])
    flat = np.empty(bounds[-1], np.int64)
    sizes = np.array([len(t) for t in texts])
    flat[bounds[text[whole]] + sizes[text[whole]] - length[whole]] = least[group[whole]]
    return [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


SPANS = "chunk int, rows binary, begins binary, ends binary"


def repeated_spans(found: DataFrame, chunks: int) -> DataFrame:
    """To each chunk the spans of its rows that repeat a smaller document's strings."""

    def search(group: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        anchor_of: list[int] = []
        occurrences = []
        for r in group.to_pylist():
            sizes = np.frombuffer(r["lengths"], np.uint8)
            text = zstandard.decompress(r["text"])
            bounds = np.cumsum([0, *sizes.tolist()]).tolist()
            names = np.empty(len(sizes), np.int64)
            for i, anchor in enumerate(np.frombuffer(r["anchors"], np.uint32).tolist()):
                k = known.setdefault(text[bounds[i] : bounds[i + 1]], len(known))
                if k == len(anchor_of):
                    anchor_of.append(anchor)
                names[i] = k
            docs = np.frombuffer(r["docs"], np.uint32)
            occurrences.append((names[np.frombuffer(r["piece"], np.uint32)], np.frombuffer(r["rows"], np.int64)[docs], np.frombuffer(r["ids"], np.int64)[docs], np.frombuffer(r["starts"], np.uint32)))
        contents = list(known)
        owner = np.full(len(contents), LAST_ID, np.int64)
        for piece, _, ids, _ in occurrences:
            np.minimum.at(owner, piece, ids)
        least: list[np.ndarray] = [None] * len(contents)
        # An anchor whose pieces are all one text is a collection of one: its strings have that text's owner.
        order = np.argsort(np.array(anchor_of, np.uint32), kind="stable")
        start, length = runs(np.array(anchor_of, np.uint32)[order])
        for i in order[start[length == 1]].tolist():
            least[i] = np.full(len(contents[i]) - SPAN + 1, owner[i])
        # The others are put in order in blocks of whole anchors.
        several = order[np.repeat(length > 1, length)]
        block = np.repeat(np.cumsum(length[length > 1]) // BLOCK_PIECES, length[length > 1])
        for a, n in zip(*runs(block)):
            some = several[a : a + n]
            for i, values in zip(some.tolist(), smallest_owners([contents[i] for i in some], owner[some])):
                least[i] = values
        strings = np.array([len(v) for v in least])
        begin_of = np.cumsum([0, *strings.tolist()])[:-1]
        flat = np.concatenate(least)
        rows_out, begins_out, ends_out = [], [], []
        for piece, rows, ids, starts in occurrences:
            times = strings[piece]
            of = np.repeat(np.arange(len(piece)), times)
            offset = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
            again = flat[begin_of[piece][of] + offset] < ids[of]
            of, offset = of[again], offset[again]
            # Runs of neighbouring strings of one piece make one span.
            new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (offset[1:] != offset[:-1] + 1)]) if len(of) else np.zeros(0, np.int64)
            last = np.r_[new[1:], len(of)] - 1 if len(of) else new
            rows_out.append(rows[of[new]])
            begins_out.append(starts[of[new]] + offset[new])
            ends_out.append(starts[of[new]] + offset[last] + SPAN)
        rows, begins, ends = np.concatenate(rows_out), np.concatenate(begins_out).astype(np.uint32), np.concatenate(ends_out).astype(np.uint32)
        chunk = np.mod(rows, chunks)
        order = np.argsort(chunk, kind="stable")
        out = []
        for a, n in zip(*runs(chunk[order])):
            part = order[a : a + n]
            out.append((int(chunk[part[0]]), rows[part].tobytes(), begins[part].tobytes(), ends[part].tobytes()))
        return pa.Table.from_batches([batch_of(out, SPANS)])

    return found.groupBy("bucket").applyInArrow(common.trimmed_group(search), SPANS)


def union_spans(table: pa.Table) -> dict[int, list[tuple[int, int]]]:
    """Disjoint maximal spans of each row, in order."""
    if not table.num_rows:
        return {}
    rows, begins, ends = (np.concatenate([np.frombuffer(b, kind) for b in table.column(name).to_pylist()]) for name, kind in (("rows", np.int64), ("begins", np.uint32), ("ends", np.uint32)))
    order = np.lexsort((begins, rows))
    rows, begins, ends = rows[order], begins[order].astype(np.int64), ends[order].astype(np.int64)
    start, length = runs(rows)
    shift = np.repeat(np.arange(len(start), dtype=np.int64) << 33, length)
    begins, ends = begins + shift, np.maximum.accumulate(ends + shift)
    new = np.flatnonzero(np.r_[True, begins[1:] > ends[:-1]])
    out: dict[int, list[tuple[int, int]]] = {}
    for row, s, b, e in zip(rows[new].tolist(), shift[new].tolist(), begins[new].tolist(), ends[np.r_[new[1:], len(ends)] - 1].tolist()):
        out.setdefault(row, []).append((b - s, e - s))
    return out


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    if not spans:
        return text
    borders = [0, *(x for span in spans for x in span), len(text)]
    return b"".join(text[a:b] for a, b in zip(borders[::2], borders[1::2]))


def keyed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int, int]:
    """Rows with their key and chunk; the number of chunks and of buckets."""
    docs = common.documents(df, id_col, text_col)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = common.spread(df.sparkSession, size, common.PART_BYTES // 2)
    buckets = common.spread(df.sparkSession, size * 6 / 18, BUCKET_BYTES)
    row = F.xxhash64("doc_id", "text")
    return docs.select(row.alias("row"), "doc_id", F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), "text").withColumn("chunk", F.pmod("row", F.lit(chunks)).cast("int")), chunks, buckets


def spans_of(docs: DataFrame, chunks: int, buckets: int, full: DataFrame | None = None, names: tuple[str, str, str, str] = NAMES) -> DataFrame:
    """Spans of all rows. full: the same rows as they are dealt to chunks afterwards, so that they are shuffled once."""
    shared = shared_anchors(anchors(docs, buckets), chunks)
    return repeated_spans(pieces(docs if full is None else full, shared, buckets, names), chunks)


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes of every row. Bytes are cut without regard to code points."""
    return _removed(df, id_col, text_col, REMOVED, lambda kept: kept, pa.binary())


def _removed(df: DataFrame, id_col: str, text_col: str, schema: str, last, kind) -> DataFrame:
    docs, chunks, buckets = keyed(df, id_col, text_col)

    def remove(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        spans = union_spans(right)
        out: list[list] = [[] for _ in range(5)]
        for row, doc_id, text in zip(left.column("row").to_pylist(), left.column("doc_id").to_pylist(), left.column("text").to_pylist()):
            body, own = (text or "").encode(), spans.get(row, [])
            for column, value in zip(out, (doc_id, len(body), sum(b - a for a, b in own), len(own), last(kept_bytes(body, own)))):
                column.append(value)
        names = [c.split()[0] for c in schema.split(", ")]
        return pa.table({c: pa.array(v, pa.int64() if i < 4 else kind) for i, (c, v) in enumerate(zip(names, out))})

    return docs.groupBy("chunk").cogroup(spans_of(docs, chunks, buckets).groupBy("chunk")).applyInArrow(common.trimmed_pair(remove), schema)


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans less the characters that they cover in part."""
    out = []
    for a, b in spans:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if b > a:
            out.append((a, b))
    return out


def clean(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with repeats cut from its texts, whole characters only. Null texts stay null; other columns stay as they are."""
    row_name, id_name, chunk_name = common.free_names(df, "__row", "__id", "__chunk")
    names = (row_name, id_name, text_col, chunk_name)
    docs, chunks, buckets = keyed(df, id_col, text_col)
    row = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    full = df.withColumns({row_name: row, id_name: F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)), chunk_name: F.pmod(row, F.lit(chunks)).cast("int")})
    spans = spans_of(docs, chunks, buckets, full, names)
    at, width = df.columns.index(text_col), len(df.columns)

    def remove(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        own = union_spans(right)
        out = []
        for key, text in zip(left.column(row_name).to_pylist(), left.column(at).to_pylist()):
            found = own.get(key)
            if found and text is not None:
                body = text.encode()
                text = kept_bytes(body, whole_characters(body, found)).decode()
            out.append(text)
        left = left.set_column(at, left.schema.field(at), pa.array(out, left.schema.field(at).type))
        return left.select(list(range(width)))

    return full.groupBy(chunk_name).cogroup(spans.groupBy("chunk")).applyInArrow(common.trimmed_pair(remove), df.schema)


def op5_suffixarray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every whole text when strings of 50 bytes that a smaller document has are gone."""
    digest = lambda kept: hashlib.sha256(kept).hexdigest()
    return _removed(common.table(spark, sf_dir, "documents"), "doc_id", "text", REMOVED.replace("kept binary", "kept_sha256 string"), digest, pa.string())
