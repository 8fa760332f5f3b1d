"""BPE encoding and decoding by traversing a prefix-sharing trie of the distinct words.

The encoding of a word is a chain: the encoding of each prefix ends in one
token, and taking that token away leaves the encoding of a shorter prefix. So a
trie node (a prefix) needs one state, its last token. The state of a node is
found from the states above it: it is the token t ending there whose
predecessor p, the state at the node where t starts, can stand beside it, that
is, the merges of p + t give p, t again. Words that share a prefix share those
states, which are computed once.

The distinct words of a batch, in byte order, are the leaves of their trie in
depth-first order. ``TrieEncoder.encode_words`` walks them so, with a stack of
the states from the root to the present node.

Texts are cut into chunks (white space, then a run without any), at which no
word of the byte-level pattern crosses; each worker keeps the encodings of the
chunks that it has met, up to a bound.

Null texts count as empty: no ids, and an empty decoded text. Each row, also a
repeated one or one with a null doc_id, gives one row; texts of any length are
encoded whole; other columns go.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

#: Encodings of chunks kept by a worker.
KEPT_CHUNKS = 1_000_000
#: Longer chunks (words of a long text without blanks) aren't kept.
KEPT_LENGTH = 100
#: Answers about neighbouring tokens kept by a worker.
KEPT_PAIRS = 1_000_000

CHUNK = re.compile(r"\s*\S+|\s+")
#: Counted as white space by ``re`` but not by the pattern of the vocabulary.
SEPARATORS = re.compile("[\x1c-\x1f]")
WORD = regex.compile(public_tokenizers.PATTERN)


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use: symbol to byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieEncoder:
    """Byte-level BPE of one vocabulary file."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        symbols = byte_symbols()
        as_bytes = lambda s: bytes(symbols[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        self.token_of = {as_bytes(s): i for s, i in vocab.items() if s not in self.special}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for b, i in self.token_of.items():
            self.bytes_of[i] = b
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.decimal = [str(i) for i in range(size)]
        # How each token is made, and when: the rank of its merge, -1 for single bytes.
        self.rank, self.left, self.right = [-1] * size, [0] * size, [0] * size
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (vocab[s] for s in (pair.split(" ") if isinstance(pair, str) else pair))
            made = self.token_of[self.bytes_of[a] + self.bytes_of[b]]
            self.merges[a << 20 | b] = (rank, made)
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = rank, a, b
        # The longest token that ends in two given bytes bounds the search for a node's last token.
        self.longest: dict[bytes, int] = {}
        for b in self.token_of:
            end = b[-2:]
            self.longest[end] = max(len(b), self.longest.get(end, 1))
        self.whole: dict[int, bool] = {}
        self.beside: dict[int, bool] = {}
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def merged(self, word: bytes) -> list[int]:
        """Plain BPE of a few bytes: join the pair of the lowest rank, leftmost first, till none is left."""
        ids = [self.token_of[word[i : i + 1]] for i in range(len(word))]
        while len(ids) > 1:
            found = [(self.merges[key][0], i) for i in range(len(ids) - 1) if (key := ids[i] << 20 | ids[i + 1]) in self.merges]
            if not found:
                break
            _, i = min(found)
            ids[i : i + 2] = [self.merges[ids[i] << 20 | ids[i + 1]][1]]
        return ids

    def stands_alone(self, token: int) -> bool:
        """Whether the merges of a token's own bytes end in that token."""
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = self.merged(self.bytes_of[token]) == [token]
        return known

    def stand_together(self, a: int, b: int) -> bool:
        """Whether the merges of a + b end in a, b.

        Going back from the end, of the two tokens that meet at the border the
        one made later is replaced by its part at the border. If a merge joins
        two parts while both are there, a and b don't stay apart.
        """
        key = a << 20 | b
        known = self.beside.get(key)
        if known is not None:
            return known
        merges, rank = self.merges, self.rank
        until_a = until_b = 1 << 30
        x, y, apart = a, b, True
        while True:
            joined = merges.get(x << 20 | y)
            if joined is not None and joined[0] < until_a and joined[0] <= until_b:
                apart = False
                break
            if rank[x] > rank[y]:
                until_a, x = rank[x], self.right[x]
            elif rank[y] >= 0:
                until_b, y = rank[y], self.left[y]
            else:
                break
        if len(self.beside) >= KEPT_PAIRS:
            self.beside.clear()
        self.beside[key] = apart
        return apart

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """Ids, as little-endian 32-bit words, of each distinct word, by walking their trie."""
        token_of, longest, together, alone = self.token_of, self.longest, self.stand_together, self.stands_alone
        out: dict[bytes, bytes] = {}
        last: list[int] = [0]  # the state of each node from the root on
        starts: list[int] = [0]  # where that token starts
        before = b""
        for word in sorted(words):
            n, shared, most = len(word), 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], starts[shared + 1 :]
            for i in range(shared + 1, n + 1):
                reach = longest.get(word[i - 2 : i], 1) if i > 1 else 1
                for at in range(max(0, i - reach), i):
                    token = token_of.get(word[at:i])
                    if token is not None and (together(last[at], token) if at else alone(token)):
                        break
                last.append(token)
                starts.append(at)
            ids, i = [], n
            while i:
                ids.append(last[i])
                i = starts[i]
            ids.reverse()
            out[word] = array("I", ids).tobytes()
            before = word
        return out

    def _learn(self, chunks: set[str]) -> None:
        """Add chunks that aren't kept yet."""
        if len(self.chunks) + len(chunks) > KEPT_CHUNKS:
            self.chunks.clear()
        parts = {c: WORD.findall(c) for c in chunks}
        encoded = self.encode_words({w.encode() for ws in parts.values() for w in ws})
        for c, ws in parts.items():
            self.chunks[c] = b"".join([encoded[w.encode()] for w in ws])

    def _plain(self, texts: list[str]) -> list[bytes]:
        cut = [CHUNK.findall(t) if not SEPARATORS.search(t) else WORD.findall(t) for t in texts]
        kept = self.chunks
        new = set().union(*cut).difference(kept) if cut else set()
        if new:
            if len(new) + len(kept) > KEPT_CHUNKS and kept:
                new = set().union(*cut)
            self._learn(new)
        get = self.chunks.__getitem__
        out = [b"".join(map(get, c)) for c in cut]
        for chunk in new:
            if len(chunk) > KEPT_LENGTH:
                del self.chunks[chunk]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit words. The string of a special token becomes that token."""
        if self.split_special is None or not any(s in t for s in self.special for t in texts):
            return self._plain(texts)
        pieces = [self.split_special.split(t) for t in texts]
        plain = iter(self._plain([p for ps in pieces for p in ps[::2]]))
        return [b"".join(array("I", [self.special[p]]).tobytes() if i % 2 else next(plain) for i, p in enumerate(ps)) for ps in pieces]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_ENCODERS: dict[str, TrieEncoder] = {}


def encoder(path: str = VOCABULARY) -> TrieEncoder:
    """One encoder for each vocabulary and worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieEncoder(path)
    return _ENCODERS[path]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """doc_id and ids array<int> of each row; no shuffle. Null or empty text: no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(path)
        for batch in common.slices(batches):
            doc_ids, texts = common.ids_and_texts(batch)
            ids = [np.frombuffer(b, dtype="<i4") for b in codec.encode(texts)]
            ends = np.cumsum([0, *(len(x) for x in ids)], dtype=np.int32)
            values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), values)], ["doc_id", "ids"])

    return common.documents(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """doc_id and text of each row of ids; null or no ids: the empty text. Bytes that aren't UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(path)
        for batch in common.slices(batches):
            texts = [codec.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return df.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{ids_col}` as array<int>) ids").mapInArrow(run, "doc_id long, text string")


def digests(df: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Encode, decode what was encoded, and return digests of both; ids and texts don't leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(path)
        decimal = codec.decimal.__getitem__
        for batch in common.slices(batches):
            doc_ids, texts = common.ids_and_texts(batch)
            counts, shas, decoded = [], [], []
            for raw in codec.encode(texts):
                ids = memoryview(raw).cast("I").tolist()
                counts.append(len(ids))
                shas.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return common.documents(df).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded again; null counts as empty."""
    return digests(common.table(spark, sf_dir, "documents"))
