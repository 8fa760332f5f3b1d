"""Language-model scoring with a probabilistic suffix tree, beside a unigram base.

A text is a sequence of words (runs of anything but ASCII white space, A-Z in
lower case) and one end. As symbols it is the words' bytes, a space after each
word, and the end symbol: so the tree's probabilities are over token sequences.

Contexts of up to DEPTH bytes are counted over all training documents. A
context stays in the tree if it occurs LEAST_COUNT times and its distribution of
the next symbol saves LEAST_BITS over that of its longest proper suffix: count *
KL divergence in bits. Both are absolute, so the tree grows with the corpus.
Suffixes of what stays stay, and contexts of one byte do that occur LEAST_COUNT
times. Distributions are smoothed towards the suffix's: (n(s, x) + K p(x |
suffix)) / (n(s) + K), and the root's towards the uniform one. A symbol is scored
in the longest suffix of what precedes it that is in the tree.

The tree is never in one place. Only the counts of pairs of bytes (65,536 at most)
go to the driver and are broadcast; contexts of two bytes and more are dealt to
buckets by their last two bytes, so that a bucket has whole branches. A chunk of
documents sends its distinct grams (DEPTH bytes and the next) with their training
counts to the buckets, and gets their log probabilities back.

The base needs the count of every word. Its vocabulary grows with the corpus,
so it goes the same way: a chunk sends each distinct word once to the word's
bucket, and gets the words' counts back.

SuffixTree is the same kind of tree in one piece, for contexts that fit a driver.

A pair of chunk and bucket has a row only if the chunk has a word or gram for the
bucket. So the rows are at most as many as the distinct words and grams of all
chunks, what a join on them would have; chunks are of bounded size, hence those
are in proportion to the input.

Null or empty texts have one token, the end. With no training document the base
has c = N = V = 0 and every symbol is equally likely. Every row is scored, and
learnt from as often as it occurs; rows with a null doc_id are never held out.
Texts of any length are read whole; a text is in one chunk. Other columns go.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DEPTH = 5
LEAST_COUNT = 2
LEAST_BITS = 6.0
#: For a tree in one piece.
LEAST_SHARE = 6e-6
DIVERGENCE = 2.5e-7
#: K, the weight of the suffix's distribution.
PRIOR = 4.0
#: Bytes scored in one lane of a batch.
LANE = 512
END = 10
SYMBOLS = 256
END_WORD = b"\n"


def words_of(text: str) -> list[bytes]:
    """bytes.lower changes A-Z only; bytes.split cuts at the six ASCII white-space bytes only."""
    return text.encode().lower().split()


def stream_of(words: list[bytes]) -> bytes:
    return b" ".join(words) + b" \n" if words else b"\n"


def padded(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each after DEPTH end symbols; where each text's own symbols start."""
    pad = bytes([END]) * DEPTH
    parts = [pad + stream_of(w) for w in words]
    ends = np.cumsum([0, *map(len, parts)])
    return np.frombuffer(b"".join(parts), np.uint8), ends


def keys_of(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The gram that ends at each place from DEPTH on; whether it ends in a text and not in padding; where each text starts, padding included."""
    symbols, ends = padded(words)
    keys = np.zeros(max(0, len(symbols) - DEPTH), np.uint64)
    for k in range(DEPTH + 1):
        keys = keys << np.uint64(8) | symbols[k : len(symbols) - DEPTH + k]
    own = np.ones(len(keys), bool)
    starts = ends[1:-1]
    for k in range(DEPTH):
        own[starts - DEPTH + k] = False
    return keys, own, ends


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.diff(np.r_[first, len(keys)]).astype(np.int64)


def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams in order, and the sums of their counts."""
    keys, counts = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


def grams(df: DataFrame) -> DataFrame:
    """Counts of every symbol with the DEPTH symbols before it: gram long, n long."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def table(keys, counts):
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], ["gram", "n"])

        size = 0
        for batch in common.slices(batches):
            _, texts = common.ids_and_texts(batch)
            keys, own, _ = keys_of([words_of(t) for t in texts])
            held.append(counted(keys[own]))
            size += len(held[-1][0])
            if len(held) > 1 and size > 3_000_000:
                keys, counts = merged(held)
                held, size = [(keys, counts)], len(keys)
                if size > 2_000_000:
                    yield table(keys, counts)
                    held, size = [], 0
        if held:
            yield table(*merged(held))

    return df.mapInArrow(common.trimmed(count), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def frequent_contexts(counted: DataFrame, least_share: float = LEAST_SHARE) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(length, context, [(symbol, n)]) of the contexts that make up least_share of all places; at most 1 / least_share of a length."""
    total = counted.agg(F.sum("n")).first()[0] or 0
    by_length = counted.select(F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("length"), "gram", "n").select(
        "length", F.expr("gram & (shiftleft(1L, 8 * (length + 1)) - 1)").alias("gram"), "n"
    )
    contexts = (
        by_length.groupBy("length", "gram").agg(F.sum("n").alias("n"))
        .groupBy("length", F.shiftright("gram", 8).alias("context")).agg(F.sum("n").alias("total"), F.collect_list(F.struct((F.col("gram") % 256).alias("symbol"), "n")).alias("next"))
        .where(F.col("total") >= total * least_share)
    )
    return [(r.length, r.context, [(x.symbol, x.n) for x in r.next]) for r in contexts.select("length", "context", "next").collect()]


class SuffixTree:
    """The retained contexts as an automaton: next state and log10 probability for each state and symbol class."""

    def __init__(self, contexts: list[tuple[int, int, list[tuple[int, int]]]], divergence: float = DIVERGENCE, prior: float = PRIOR):
        counts = {(length, context): following for length, context, following in contexts}
        root_counts = dict(counts.get((0, 0), []))
        total = sum(root_counts.values())
        seen = sorted(root_counts)
        # Symbols that training never met share a class, and its probability equally.
        self.classes = np.full(SYMBOLS, len(seen), np.int64)
        self.classes[seen] = np.arange(len(seen))
        width = len(seen) + 1
        uniform = np.r_[np.full(len(seen), 1 / SYMBOLS), (SYMBOLS - len(seen)) / SYMBOLS]
        place = {x: i for i, x in enumerate(seen)}

        def numbers(key):
            out = np.zeros(width)
            for symbol, n in counts[key]:
                out[place[symbol]] = n
            return out

        root = numbers((0, 0)) if total else np.zeros(width)
        smooth = {b"": (root + prior * uniform) / (total + prior)}
        kept = {b""}
        for length, context in sorted(k for k in counts if k[0]):
            key = context.to_bytes(length, "big")
            suffix = key[1:]
            if suffix not in smooth:
                continue  # rarer than the least share, which its extension then is too
            n = numbers((length, context))
            p = n / n.sum()
            smooth[key] = (n + prior * smooth[suffix]) / (n.sum() + prior)
            where = p > 0
            if n.sum() / total * float((p[where] * np.log2(p[where] / smooth[suffix][where])).sum()) >= divergence:
                kept |= {key[i:] for i in range(length)}
        states = {key[:i] for key in kept for i in range(len(key) + 1)}
        self.contexts = len(kept)
        ordered = sorted(states, key=lambda k: (len(k), k))
        index = {k: i for i, k in enumerate(ordered)}
        self.logs = np.zeros((len(ordered), width), np.float32)
        self.follow = np.zeros((len(ordered), width), np.int32)
        longest = lambda k, among: next(k[i:] for i in range(len(k) + 1) if k[i:] in among)
        for key, i in index.items():
            self.logs[i] = np.log10(smooth[longest(key, kept)])
            if i:
                self.follow[i] = self.follow[index[longest(key[1:], states)]]
            for j, symbol in enumerate(seen):
                grown = index.get(key + bytes([symbol]))
                if grown is not None:
                    self.follow[i, j] = grown
        self.logs[:, -1] -= math.log10(max(1, SYMBOLS - len(seen)))

    def score(self, words: list[list[bytes]]) -> np.ndarray:
        """log10 probability of each text. All texts are scored side by side in lanes; a lane starts DEPTH symbols early, after which its state is exact."""
        symbols, ends = padded(words)
        classes = self.classes[symbols]
        n, width = len(symbols), self.logs.shape[1]
        lanes = -(-n // LANE)
        room = np.zeros(lanes * LANE + DEPTH, np.int64)
        room[DEPTH : DEPTH + n] = classes
        room[:DEPTH] = self.classes[END]
        found = np.zeros((LANE, lanes))
        logs, follow = self.logs.ravel(), self.follow.ravel()
        state = np.zeros(lanes, np.int64)
        starts = np.arange(lanes) * LANE
        for step in range(LANE + DEPTH):
            at = state * width + room[starts + step]
            if step >= DEPTH:
                found[step - DEPTH] = logs[at]
            state = follow[at].astype(np.int64)
        by_place = found.T.ravel()[:n]
        for k in range(DEPTH):
            by_place[ends[:-1] + k] = 0
        return np.add.reduceat(by_place, ends[:-1]) if len(words) else np.zeros(0)


def branch_logs(keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray, least: int = LEAST_COUNT, bits: float = LEAST_BITS) -> np.ndarray:
    """log10 probability of each gram's last symbol after the others. keys: distinct, all that end in the same two-byte contexts; pairs: of all training texts, how often a byte (row) is followed by another."""
    symbol, last = (keys & np.uint64(255)).astype(np.int64), (keys >> np.uint64(8) & np.uint64(255)).astype(np.int64)
    p = (pairs.sum(0)[symbol] + PRIOR / SYMBOLS) / (pairs.sum() + PRIOR)
    times = pairs.sum(1)[last]
    p = np.where(times >= least, (pairs[last, symbol] + PRIOR * p) / (times + PRIOR), p)
    best, levels = p, []
    for length in range(2, DEPTH + 1):
        own, first, of = np.unique(keys & np.uint64((1 << 8 * (length + 1)) - 1), return_index=True, return_inverse=True)
        _, context = np.unique(own >> np.uint64(8), return_inverse=True)
        n, before = np.bincount(of, counts), p[first]
        total = np.bincount(context, n)
        seen = n > 0
        gain = np.bincount(context[seen], n[seen] * np.log2(n[seen] / total[context[seen]] / before[seen]), len(total))
        p = np.where(total[context] >= least, (n + PRIOR * before) / (total[context] + PRIOR), before)[of]
        levels.append((context[of], (total >= least) & (gain >= bits), p))
    # What stays keeps its suffixes.
    longer = np.zeros(len(keys), bool)
    stays = []
    for context, kept, p in reversed(levels):
        longer = (kept | (np.bincount(context, longer, len(kept)) > 0))[context]
        stays.append((longer, p))
    for own, p in reversed(stays):
        best = np.where(own, p, best)
    return np.log10(best).astype(np.float32)


def cuts(words: Iterator[tuple[bool, list[bytes]]]) -> Iterator[tuple[bool, list[list[bytes]]]]:
    """Texts of one flag each, put together up to about a quarter of a slice."""
    some: dict[bool, list] = {False: [], True: []}
    size = {False: 0, True: 0}
    for flag, own in words:
        some[flag].append(own)
        size[flag] += sum(map(len, own)) + len(own) + 1
        if size[flag] >= common.SLICE_BYTES // 4:
            yield flag, some[flag]
            some[flag], size[flag] = [], 0
    yield from ((flag, left) for flag, left in some.items() if left)


def dealt(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each gram, by the last two bytes of its context."""
    return (common.mix64(keys >> np.uint64(8) & np.uint64(0xFFFF)) % np.uint64(buckets)).astype(np.int64)


def pair_counts(lists: DataFrame) -> np.ndarray:
    """How often each byte is followed by each other in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for keys, counts in zip(batch.column("grams").to_pylist(), batch.column("times").to_pylist()):
                np.add.at(total, (np.frombuffer(keys, "<u8") & np.uint64(0xFFFF)).astype(np.int64), np.frombuffer(counts, "<u4").astype(np.int64))
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int32)), pa.array(total[pair])], ["pair", "n"])

    out = np.zeros(1 << 16, np.int64)
    for r in lists.select("grams", "times").mapInArrow(common.trimmed(run), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r.pair] = r.n
    return out.reshape(SYMBOLS, SYMBOLS)


def bucketed(words, buckets: int) -> dict[int, list[bytes]]:
    """Distinct words by bucket."""
    out: dict[int, list[bytes]] = {}
    for word in words:
        out.setdefault(zlib.crc32(word) % buckets, []).append(word)
    return out


def chunked(df: DataFrame, folds: int) -> tuple[DataFrame, int, int]:
    """Documents with their flag and chunk; the number of chunks and of buckets."""
    docs = common.documents(df).withColumn("held_out", F.coalesce(common.crc32_of_id() % folds == 0, F.lit(False)))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, buckets = common.spread(df.sparkSession, size, common.PART_BYTES // 2), common.partitions_for(size, common.PART_BYTES // 2)
    return docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")), chunks, buckets


LISTS = "bucket int, chunk int, words binary, counts binary, grams binary, times binary"


def lists_of(docs: DataFrame, buckets: int) -> DataFrame:
    """Of each chunk and bucket: the distinct words and grams, and their counts in the chunk's training documents."""

    def collect(group: pa.Table) -> pa.Table:
        counts: Counter = Counter()

        def read() -> Iterator[tuple[bool, list[bytes]]]:
            for held, text in zip(group.column("held_out").to_pylist(), group.column("text").to_pylist()):
                own = words_of(text or "")
                words = [*own, END_WORD]
                counts.update(dict.fromkeys(words, 0) if held else words)
                yield held, own

        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for held, words in cuts(read()):
            keys, own, _ = keys_of(words)
            keys, times = counted(keys[own])
            parts.append((keys, times * (not held)))
        keys, times = merged(parts)
        place = dealt(keys, buckets)
        order = np.argsort(place, kind="stable")
        found, first = np.unique(place[order], return_index=True)
        grams_of = dict(zip(found.tolist(), np.split(order, first[1:])))
        words_in = bucketed(counts, buckets)
        # Only buckets that get something: never more rows than the chunk has distinct words and grams.
        used, none = sorted(words_in.keys() | grams_of.keys()), order[:0]
        press = zstandard.ZstdCompressor(level=1)
        lists, own, n = [words_in.get(b, []) for b in used], [grams_of.get(b, none) for b in used], len(used)
        return pa.table({
            "bucket": pa.array(used, pa.int32()), "chunk": pa.array([group.column("chunk")[0].as_py()] * n, pa.int32()), "words": pa.array([press.compress(b" ".join(ws)) for ws in lists], pa.binary()), "counts": pa.array([np.array([counts[w] for w in ws], "<u4").tobytes() for ws in lists], pa.binary()),
            "grams": pa.array([keys[o].astype("<u8").tobytes() for o in own], pa.binary()), "times": pa.array([times[o].astype("<u4").tobytes() for o in own], pa.binary()),
        })

    return docs.select("chunk", "held_out", "text").groupBy("chunk").applyInArrow(common.trimmed_group(collect), LISTS)


def split_words(blob: bytes) -> list[bytes]:
    words = zstandard.decompress(blob)
    return words.split(b" ") if words else []


ANSWERS = "bucket int, chunk int, words binary, counts binary, tokens long, distinct long, grams binary, logs binary"


def answers(lists: DataFrame, pairs: np.ndarray) -> DataFrame:
    """To each chunk the counts of its words and the log probabilities of its grams; a row with a null chunk has the bucket's total and distinct words."""
    sent = lists.sparkSession.sparkContext.broadcast(pairs)

    def add(group: pa.Table) -> pa.Table:
        total: dict[bytes, int] = {}
        blobs, counts, chunks = (group.column(c).to_pylist() for c in ("words", "counts", "chunk"))
        for blob, numbers in zip(blobs, counts):
            for word, n in zip(split_words(blob), np.frombuffer(numbers, "<u4").tolist()):
                total[word] = total.get(word, 0) + n
        get = total.__getitem__
        replies = [np.fromiter(map(get, split_words(b)), "<i8").tobytes() for b in blobs]
        asked = [np.frombuffer(b, "<u8") for b in group.column("grams").to_pylist()]
        times = [np.frombuffer(b, "<u4").astype(np.int64) for b in group.column("times").to_pylist()]
        keys, sums = merged(list(zip(asked, times))) if any(map(len, asked)) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        logs = branch_logs(keys, sums, sent.value) if len(keys) else np.zeros(0, np.float32)
        found = [logs[np.searchsorted(keys, k)].astype("<f4").tobytes() for k in asked]
        bucket, rows = group.column("bucket")[0].as_py(), len(chunks) + 1
        return pa.table({
            "bucket": pa.array([bucket] * rows, pa.int32()), "chunk": pa.array([*chunks, None], pa.int32()), "words": pa.array([*blobs, None], pa.binary()), "counts": pa.array([*replies, None], pa.binary()),
            "tokens": pa.array([0] * len(chunks) + [sum(total.values())], pa.int64()), "distinct": pa.array([0] * len(chunks) + [sum(1 for n in total.values() if n)], pa.int64()),
            "grams": pa.array([*group.column("grams").to_pylist(), None], pa.binary()), "logs": pa.array([*found, None], pa.binary()),
        })

    return lists.groupBy("bucket").applyInArrow(common.trimmed_group(add), ANSWERS)


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(df: DataFrame, folds: int = 10) -> DataFrame:
    """Base and suffix-tree scores of every document; those whose id's crc32 is divisible by folds are not learnt from."""
    docs, _, buckets = chunked(df, folds)
    lists = common.written(lists_of(docs, buckets), "lists")
    replies = common.written(answers(lists, pair_counts(lists)), "answers")
    totals = replies.where("chunk is null").agg(F.sum("tokens"), F.sum("distinct")).first()
    tokens, distinct = totals[0] or 0, totals[1] or 0

    def rate(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        doc_ids, held = left.column("doc_id").to_pylist(), left.column("held_out").to_pylist()
        known: dict[bytes, int] = {}
        texts = left.column("text").to_pylist()
        for blob, numbers in zip(right.column("words").to_pylist(), right.column("counts").to_pylist()):
            known.update(zip(split_words(blob), np.frombuffer(numbers, "<i8").tolist()))
        rows = {w: i for i, w in enumerate(known)}
        counts = np.fromiter(known.values(), np.float64, len(known))
        logs = np.log10((counts + 0.1) / (tokens + 0.1 * (distinct + 1)))
        read = lambda name, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(b, kind) for b in right.column(name).to_pylist())])
        grams_of, gram_logs = pa.array(read("grams", "<u8")), read("logs", "<f4")
        out: list[list] = [[] for _ in range(7)]
        at = 0
        while at < len(texts):
            # The words of some texts at a time: as lists they take several times the room of the text.
            words, size = [], 0
            while at + len(words) < len(texts) and (not words or size < common.SLICE_BYTES // 4):
                words.append(words_of(texts[at + len(words)] or ""))
                size += sum(map(len, words[-1])) + len(words[-1])
            keys, own, ends = keys_of(words)
            by_place = np.zeros(ends[-1])
            by_place[DEPTH:][own] = gram_logs[pc.index_in(pa.array(keys[own]), grams_of).to_numpy()]
            scores = np.add.reduceat(by_place, ends[:-1])
            for k, ws in enumerate(words):
                own = np.fromiter(map(rows.__getitem__, [*ws, END_WORD]), np.int64, len(ws) + 1)
                for column, value in zip(out, (doc_ids[at + k], held[at + k], len(own), int((counts[own] > 0).sum()), tokens, float(logs[own].sum()), float(scores[k]))):
                    column.append(value)
            at += len(words)
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table({c.split()[0]: pa.array(v, t) for c, v, t in zip(SCHEMA.split(", "), out, kinds)})

    return docs.groupBy("chunk").cogroup(replies.where("chunk is not null").select("chunk", "words", "counts", "grams", "logs").groupBy("chunk")).applyInArrow(common.trimmed_pair(rate), SCHEMA)


def op9_suffixtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all whole texts under the unigram base and the suffix tree."""
    return score(common.table(spark, sf_dir, "documents"))
