"""Hierarchical packing of documents into sequences of several lengths.

A document gives as many full windows as it has, and a rest. Rests are routed
to tiers, the powers of two that hold them. Tier by tier, from the longest on,
each rest opens a sequence of its tier's length; the gap behind it is filled
with rests of shorter tiers, the longest that fits first, and at last with a
piece cut off the shortest rest that is too long. What is left when nothing
remains to fill with is cut at powers of two, so no sequence needs padding.

Sequences are then dealt to step groups of equal tokens: taken from long to
short, powers of two fill each group exactly, save the last of a slice.

Everything happens within slices of an input partition, so there is no shuffle
and no state that grows; sequence ids hold the partition's number, and a task
that runs again gives the same rows.

Null or empty texts are documents of one token, the end token. Repeated rows
(also those that share an id) are packed as often as they occur, a null doc_id
stays null. Texts of any length are encoded whole: a run of LONG_BLANKS blanks or
more, at which the fast encoder's pattern gives up, is left to the trie encoder,
which gives the same ids. Other columns than the two that are named go.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import bpe, common

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SPECIAL = {"<|endoftext|>": 50256}
WINDOW = 1024
END = np.zeros(1, dtype="<u4")
#: Tokens of a step group, in windows.
STEP_WINDOWS = 8
SHORTEST_TIER = 64
#: The fast encoder fails at about a million blanks in a row.
LONG_BLANKS = 100_000
BLANKS = re.compile(r"\s+")

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, context int, step_group long"

_ENCODINGS: dict[str, tiktoken.Encoding] = {}


def encoding(path: str = RANKS) -> tiktoken.Encoding:
    """The vocabulary of the rank file: the same ids as its twin for the tokenizers library."""
    if path not in _ENCODINGS:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        _ENCODINGS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return _ENCODINGS[path]


def ids_with_end(text: str, path: str = RANKS) -> np.ndarray:
    if len(text) >= LONG_BLANKS and any(m.end() - m.start() >= LONG_BLANKS for m in BLANKS.finditer(text)):
        found = np.frombuffer(bpe.encoder(path.removesuffix(".tiktoken") + ".json").encode([text])[0], "<u4")
    else:
        found = encoding(path).encode_to_numpy(text, allowed_special="all")
    return np.concatenate([found, END]).astype("<u4", copy=False)


def tier_of(length: int, window: int = WINDOW) -> int:
    return min(window, max(SHORTEST_TIER, 1 << (length - 1).bit_length()))


def pack(lengths: list[int], window: int = WINDOW) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences as (tokens, pieces); a piece is (document, start, length)."""
    sequences: list[tuple[int, list[tuple[int, int, int]]]] = []
    pool: list[tuple[int, int, int]] = []  # (length, document, start), ascending
    for k, n in enumerate(lengths):
        whole = n - n % window
        sequences += [(window, [(k, at, window)]) for at in range(0, whole, window)]
        if n > whole:
            pool.append((n - whole, k, whole))
    pool.sort()
    while pool:
        length, k, start = pool.pop()
        tier = tier_of(length, window)
        pieces, gap = [(k, start, length)], tier - length
        while gap and pool:
            at = bisect_right(pool, (gap, 1 << 62, 0))
            if at:
                length, k, start = pool.pop(at - 1)
                pieces.append((k, start, length))
                gap -= length
            else:
                length, k, start = pool.pop(0)
                pieces.append((k, start, gap))
                insort(pool, (length - gap, k, start + gap))
                gap = 0
        if gap:
            sequences += cut_at_powers(pieces)
        else:
            sequences.append((tier, pieces))
    return sequences


def cut_at_powers(pieces: list[tuple[int, int, int]]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Pieces dealt to sequences whose lengths are the powers of two in their total."""
    total, out, left = sum(p[2] for p in pieces), [], list(reversed(pieces))
    for bit in range(total.bit_length() - 1, -1, -1):
        if not total >> bit & 1:
            continue
        room, taken = 1 << bit, []
        while room:
            k, start, length = left.pop()
            took = min(room, length)
            taken.append((k, start, took))
            room -= took
            if took < length:
                left.append((k, start + took, length - took))
        out.append((1 << bit, taken))
    return out


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = RANKS, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row for each piece: where it comes from, its sequence and place there, the sequence's length and step group; with_ids: and its token ids, array<int>."""
    schema = SCHEMA + ", ids array<int>" if with_ids else SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        first = (context.partitionId() if context else 0) << 36
        sequence, group = first, first
        for batch in common.slices(batches):
            doc_ids, texts = common.ids_and_texts(batch)
            ids = [ids_with_end(t, path) for t in texts]
            raw = [memoryview(x).cast("B") for x in ids]
            columns: list[list] = [[] for _ in range(9)]
            held: list[np.ndarray] = []
            filled = 0
            for tokens, pieces in sorted(pack([len(x) for x in ids], window), key=lambda s: -s[0]):
                offset = 0
                for k, start, length in pieces:
                    row = (doc_ids[k], start, length, zlib.crc32(raw[k][4 * start : 4 * (start + length)]), len(ids[k]), sequence, offset, tokens, group + filled // (STEP_WINDOWS * window))
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                    if with_ids:
                        held.append(ids[k][start : start + length])
                    offset += length
                sequence += 1
                filled += tokens
            group += -(-filled // (STEP_WINDOWS * window))
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            if with_ids:
                arrays.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, held)]), pa.int32()), pa.array(np.concatenate(held).astype(np.int32))))
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in schema.split(", ")])

    return common.documents(df, id_col, text_col).mapInArrow(common.trimmed(run), schema)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return pack_documents(common.table(spark, sf_dir, "documents"))
