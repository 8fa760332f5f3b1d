"""Improbable-feature digests of documents, and their likeness.

Features are the byte windows of WINDOW bytes. Each has an entropy; a window is
the more telling the rarer its entropy is in the whole corpus, so windows are
ranked by how often their entropy (in BINS steps) occurs, rarest first. Windows
of very low entropy (runs, padding) are never taken. In every run of NEIGHBOURS
windows the leftmost of the lowest rank gets a vote; windows of LEAST_VOTES
votes are the document's features. A document too short to reach that needs as
many votes as it has runs.

Features are hashed into Bloom filters of FILTER_BITS bits with PROBES bits
each; after PER_FILTER features the next filter of the chain begins. The
likeness of two filters is their number of common bits, less what chance gives,
over what the sparser one could have, less chance again. For digests, each
filter of the shorter chain takes its best partner, weighted by its features.

A text of fewer than WINDOW bytes, or of no window that can be taken, is itself
its only feature. The empty (or null) text has the empty digest, which is like
another empty one (1.0) and nothing else. Equal texts have equal digests.

In ``compare_with_edits`` the next document is that of the next larger doc_id;
of rows that share an id, each is followed by the next in order of their texts.
Rows with a null doc_id follow one another, in the order of the hash of their
texts, the last by the first. Texts of any length are read whole; other columns
go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 64
BINS = 1000
LEAST_BIN = 100
NEIGHBOURS = 64
LEAST_VOTES = 16
FILTER_BITS = 2048
PER_FILTER = 160
PROBES = 5
BLOCK = 1 << 16
#: Bytes of documents in a range of ids: small, so that ranges spread evenly over tasks.
RANGE_BYTES = 8 << 20
#: Bound of the ranges (beyond 512 GB they grow instead), and of the keys that their borders are found from.
MOST_RANGES = 1 << 16
SAMPLED = 4_000_000

SCALE = 1 << 16
_LOGS = np.array([0] + [round(SCALE * c * np.log2(c)) for c in range(1, WINDOW + 2)], np.int64)
_STEP = np.diff(_LOGS)
_MOST = int(_LOGS[WINDOW])


def entropy_bins(symbols: np.ndarray) -> np.ndarray:
    """The entropy step of each window, by its start.

    Sliding a window changes its entropy by what the byte that leaves and the
    byte that enters do to their counts, so it takes only, for each byte, how
    often it occurs in the WINDOW - 1 bytes before and after it.
    """
    n = len(symbols)
    if n < WINDOW:
        return np.zeros(0, np.int16)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for start in range(0, n, BLOCK):
        for k in range(1, WINDOW):
            end = min(start + BLOCK, n - k)
            if end <= start:
                break
            same = (symbols[start:end] == symbols[start + k : end + k]).view(np.uint8)
            after[start:end] += same
            before[start + k : end + k] += same
    total = np.empty(n - WINDOW + 1, np.int64)
    total[0] = _LOGS[np.bincount(symbols[:WINDOW])].sum()
    np.cumsum(_STEP[before[WINDOW:]] - _STEP[after[: n - WINDOW]], out=total[1:])
    total[1:] += total[0]
    return ((_MOST - total) * ((BINS - 1) / _MOST)).astype(np.int16)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def own_windows(ends: np.ndarray, count: int) -> np.ndarray:
    """Which windows lie within one text."""
    edge = np.zeros(count + WINDOW + 1, np.int32)
    for end in ends[1:-1]:  # windows that start in the last WINDOW - 1 bytes of a text reach into the next
        edge[max(0, end - WINDOW + 1)] += 1
        edge[end] -= 1
    return np.cumsum(edge)[:count] == 0


def histogram(df: DataFrame) -> np.ndarray:
    """How often each entropy step occurs in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(BINS, np.int64)
        for batch in common.slices(batches):
            symbols, ends = joined([t.encode() for t in common.ids_and_texts(batch)[1]])
            bins = entropy_bins(symbols)
            found += np.bincount(bins[own_windows(ends, len(bins))], minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array(range(BINS), pa.int32()), pa.array(found)], ["bin", "n"])

    out = np.zeros(BINS, np.int64)
    for row in common.documents(df).mapInArrow(common.trimmed(count), "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        out[row.bin] = row.n
    return out


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """Rank of each entropy step, 0 the rarest; BINS for steps that are never taken."""
    ranks = np.empty(BINS, np.uint64)
    ranks[np.lexsort((np.arange(BINS), counts))] = np.arange(BINS, dtype=np.uint64)
    ranks[:LEAST_BIN] = BINS
    return ranks


def features(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """Hashes of the features of each text, in order."""
    symbols, ends = joined(texts)
    bins = entropy_bins(symbols)
    none = np.uint64(1 << 63)
    chosen = np.zeros(0, np.int64)
    if len(bins):
        own = own_windows(ends, len(bins))
        rank = ranks[bins]
        keys = np.full(len(bins) + NEIGHBOURS, none, np.uint64)
        keys[: len(bins)] = np.where(own & (rank < BINS), rank << np.uint64(40) | np.arange(len(bins), dtype=np.uint64), none)
        width = 1
        while width < NEIGHBOURS:
            keys = np.minimum(keys[:-width], keys[width:])
            width *= 2
        # A run counts if it lies within its text, or is the first of a text that has no whole run.
        keys = keys[: len(bins)]
        counts = np.zeros(len(bins), bool)
        least = np.full(len(bins), LEAST_VOTES, np.uint8)
        for start, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
            windows = end - start - WINDOW + 1
            if windows > 0:
                runs = max(1, windows - NEIGHBOURS + 1)
                counts[start : start + runs] = True
                if runs < LEAST_VOTES:
                    least[start : start + windows] = runs
        voted = keys[counts & (keys < none)] & np.uint64((1 << 40) - 1)
        place, votes = np.unique(voted, return_counts=True)
        place = place.astype(np.int64)
        chosen = place[votes >= least[place]]
    hashes = hashed(symbols, chosen)
    borders = np.searchsorted(chosen, ends)
    out = [hashes[a:b] for a, b in zip(borders[:-1], borders[1:])]
    for i, text in enumerate(texts):
        if text and not len(out[i]):
            out[i] = np.frombuffer(hashlib.blake2b(text, digest_size=8).digest(), np.uint64)
    return out


def hashed(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each window."""
    out = np.full(len(starts), 0x9E3779B97F4A7C15, np.uint64)
    if len(starts):
        windows = np.lib.stride_tricks.sliding_window_view(symbols, WINDOW)
        for at in range(0, len(starts), 8192):
            words = np.ascontiguousarray(windows[starts[at : at + 8192]]).view(np.uint64)
            for column in words.T:
                out[at : at + 8192] = common.mix64(out[at : at + 8192] ^ column)
    return out


def filters_of(hashes: np.ndarray) -> np.ndarray:
    """The chain of Bloom filters: filters x bits."""
    chain = np.zeros((-(-len(hashes) // PER_FILTER), FILTER_BITS), bool)
    link = np.arange(len(hashes)) // PER_FILTER
    for k in range(PROBES):
        chain[link, (hashes >> np.uint64(11 * k) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    return chain


def digest_string(hashes: np.ndarray, chain: np.ndarray) -> str:
    """Number of features, and the filters in hexadecimal."""
    return f"{len(hashes)}:{np.packbits(chain).tobytes().hex()}" if len(hashes) else ""


def likeness(n: int, a: np.ndarray, m: int, b: np.ndarray) -> float:
    """Of two chains with n and m features, 0 to 1."""
    if not n or not m:
        return float(n == m)
    if len(a) > len(b) or len(a) == len(b) and n > m:
        n, a, m, b = m, b, n, a
    x, y = a.astype(np.float32), b.astype(np.float32)
    common_bits, set_x, set_y = x @ y.T, x.sum(1)[:, None], y.sum(1)[None]
    chance, most = set_x * set_y / FILTER_BITS, np.minimum(set_x, set_y)
    score = np.clip((common_bits - chance) / np.maximum(most - chance, 1e-9), 0, 1).max(1)
    weights = np.full(len(a), PER_FILTER)
    weights[-1] = n - PER_FILTER * (len(a) - 1)
    return float((score * weights).sum() / n)


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_features and fingerprint of each row."""
    ranks = ranks_of(histogram(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))) if counts is None else counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            doc_ids, texts = common.ids_and_texts(batch)
            found = features([t.encode() for t in texts], ranks)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array([len(f) for f in found], pa.int32()), pa.array([digest_string(f, filters_of(f)) for f in found], pa.string())], ["doc_id", "n_features", "fingerprint"]
            )

    return common.documents(df, id_col, text_col).mapInArrow(common.trimmed(run), "doc_id long, n_features int, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many of the text that follows."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(docs: DataFrame) -> DataFrame:
    """Rows by ranges of ids, each range ended by a copy of the first rows of the next (of the first range, after the last).

    Rows without an id have an order of their own, by the hash of their text. Texts are shuffled once.
    """
    rows, nulls = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    out = _ring(docs.where("doc_id is not null").withColumn("key", F.col("doc_id")), rows - nulls)
    return out.unionByName(_ring(docs.where("doc_id is null").withColumn("key", F.xxhash64(F.coalesce("text", F.lit("")))), nulls)) if nulls else out


def _ring(keyed: DataFrame, count: int) -> DataFrame:
    """The driver sees MOST_RANGES borders at most; those are quantiles of the keys, or of about SAMPLED of them: ranges needn't be equal, only alike."""
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(MOST_RANGES, common.partitions_for(size, RANGE_BYTES))
    some = keyed.select("key") if count <= SAMPLED else keyed.select("key").sample(SAMPLED / count, 1)
    cuts = some.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)] or [0.5], max(10_000, 20 * ranges))).first()[0] or []
    borders = np.array(sorted(set(cuts)), np.int64) if ranges > 1 else np.zeros(0, np.int64)

    def first_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for batch in batches:
            keys = batch.column("key").to_numpy()
            place = np.searchsorted(borders, keys, "right")
            for r in np.unique(place).tolist():
                least = int(keys[place == r].min())
                found[r] = min(found.get(r, least), least)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())], ["range", "first"])

    firsts = sorted((r.range, r.first) for r in keyed.select("key").mapInArrow(common.trimmed(first_keys), "range int, first long").groupBy("range").agg(F.min("first").alias("first")).collect())
    used, starts = [r for r, _ in firsts], np.array([f for _, f in firsts], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            place = np.searchsorted(starts, keys, "right") - 1
            head = np.flatnonzero(starts[place] == keys) if len(keys) else np.zeros(0, np.int64)
            rows = pa.Table.from_batches([batch])
            for part, where, copy in ((rows, place, False), (rows.take(pa.array(head)), (place[head] - 1) % len(used), True)):
                out = part.append_column("range", pa.array(where.astype(np.int32))).append_column("copy", pa.array([copy] * len(where)))
                yield from out.combine_chunks().to_batches()

    dealt = keyed.select("doc_id", "text", "key").mapInArrow(common.trimmed(deal), "doc_id long, text string, key long, range int, copy boolean")
    return dealt.repartition("range").sortWithinPartitions("range", "copy", "key", "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_edits(df: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness; the document that follows in order of id lends the edit."""
    docs = common.documents(df)
    ranks = ranks_of(histogram(docs))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int | None, str, bool]]:
        for batch in common.slices(batches):
            yield from zip(*(batch.column(c).to_pylist() for c in ("range", "doc_id", "text", "copy")))

    def rate(pairs: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
        edits = [edited(text, following) for _, text, following in pairs]
        texts = [text.encode() for _, text, _ in pairs]
        # Each text is followed by the next row's, save where a range ends.
        extra = [following.encode() for (_, _, following), (_, after, _) in zip(pairs, [*pairs[1:], (None, None, None)]) if following is not after]
        own = features([*texts, *extra], ranks)
        changed = features([e.encode() for e in edits], ranks)
        chains, other = [filters_of(f) for f in own], [filters_of(f) for f in changed]
        spare = iter(range(len(texts), len(own)))
        follow = [i + 1 if i + 1 < len(pairs) and pairs[i][2] is pairs[i + 1][1] else next(spare) for i in range(len(pairs))]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([p[0] for p in pairs], pa.int64()),
                pa.array([len(p[1]) for p in pairs], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits], pa.string()),
                pa.array([digest_string(own[i], chains[i]) for i in range(len(pairs))], pa.string()),
                pa.array([digest_string(f, c) for f, c in zip(changed, other)], pa.string()),
                pa.array([likeness(len(own[i]), chains[i], len(f), c) for i, (f, c) in enumerate(zip(changed, other))], pa.float64()),
                pa.array([likeness(len(own[i]), chains[i], len(own[j]), chains[j]) for i, j in enumerate(follow)], pa.float64()),
            ],
            [c.split()[0] for c in SCHEMA.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple[int | None, str, str]] = []
        held, size = None, 0
        for place, doc_id, text, copy in rows_of(batches):
            text = text or ""
            if held is not None:
                pairs.append((held[1], held[2], text))
                size += len(held[2])
            # Of several copies (rows that share an id) the first is the one that follows.
            held = None if copy else (place, doc_id, text)
            if size > common.SLICE_BYTES // 2:
                yield rate(pairs)
                pairs, size = [], 0
        if pairs:
            yield rate(pairs)

    return in_order(docs).mapInArrow(common.trimmed(run), SCHEMA)


def op10_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and of its edited text."""
    return compare_with_edits(common.table(spark, sf_dir, "documents"))
