"""Language identification by segmentation-marginalised unigrams.

Over a fixed public vocabulary of pieces each language has a probability for
every piece. The probability of a word is the sum, over all ways to cut it into
pieces, of the product of their probabilities; a forward pass over the word
gives that sum. A text's log probability in a language is that of its words.

The piece probabilities are learnt by expectation maximisation from the words
of at most PER_LANGUAGE labelled documents of each language, those of the
smallest id hashes among the documents that aren't held out.

Words are runs of letters in lower case, with a mark for their beginning. All
pieces of the vocabulary count, and all segmentations of a word of any length:
words of more than SHORT characters are summed as logarithms, with only the
sums that the longest piece can reach back to in memory. A text that is null or
has no letter is ``und`` with score 0, as is every text when nothing was learnt.
The score of a prediction is its posterior probability, languages being equally
likely beforehand; ties go to the first language in order.

Every row gives one row, repeated ones and those with a null doc_id too (which
are never held out). ``annotate`` keeps all columns; where the table has columns
of the names that it adds, the added ones get a number after theirs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
#: Bound of the training sample: documents of each language.
PER_LANGUAGE = 150
ROUNDS = 4
SMOOTHING = 0.05
#: Probability of a character that is no piece.
UNKNOWN = 1e-7
#: Words up to this many characters, the mark included, are scored side by side.
SHORT = 40
#: Characters of a longer word whose pieces are looked up at once.
WINDOW = 4096
WORD = re.compile(r"[^\W\d_]+")
START = "▁"
#: Text whose languages are told at once.
SLICE_BYTES = 2 << 20
#: Words whose scores a worker keeps.
KEPT_WORDS = 120_000
UND = "und"
BASE = np.uint64(0x100000001B3)
SLOTS = 20


class Pieces:
    """The vocabulary as a hash table that arrays of characters are looked up in, of all pieces and all their beginnings.

    Entry 0 is none, 1 any single character that is no piece.
    """

    def __init__(self, path: str = VOCABULARY):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = sorted({model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))})
        self.count, self.longest = len(pieces) + 2, max(map(len, pieces))
        entry_of = {p: i + 2 for i, p in enumerate(pieces)}
        longer = {p[:n] for p in pieces for n in range(1, len(p))}
        known = sorted(longer | entry_of.keys())
        lengths = np.array([len(p) for p in known])
        codes = np.zeros((len(known), self.longest), np.uint64)
        for i, p in enumerate(known):
            codes[i, : len(p)] = [ord(c) for c in p]
        keys = np.zeros(len(known), np.uint64)
        with np.errstate(over="ignore"):
            for at in range(self.longest):
                keys = np.where(at < lengths, self.step(keys, codes[:, at]), keys)
        # Open addressing: each key lies at its slot or in the few after it.
        self.keys, self.entries, self.more = np.zeros(1 << SLOTS, np.uint64), np.zeros(1 << SLOTS, np.int32), np.zeros(1 << SLOTS, bool)
        entries, more = np.array([entry_of.get(p, 0) for p in known], np.int32), np.array([p in longer for p in known])
        used, left, self.probes = np.zeros(1 << SLOTS, bool), np.arange(len(known)), 0
        while len(left):
            slots = (self.slot(keys[left]) + self.probes) & ((1 << SLOTS) - 1)
            open_ = np.flatnonzero(~used[slots])
            _, first = np.unique(slots[open_], return_index=True)
            chosen = open_[first]
            used[slots[chosen]] = True
            self.keys[slots[chosen]], self.entries[slots[chosen]], self.more[slots[chosen]] = keys[left[chosen]], entries[left[chosen]], more[left[chosen]]
            left = np.delete(left, chosen)
            self.probes += 1

    @staticmethod
    def step(keys: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return (keys ^ codes) * BASE + (codes << np.uint64(32)) + np.uint64(1)

    @staticmethod
    def slot(keys):
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry of each key, and whether a longer piece begins so."""
        home = self.slot(keys)
        found, more = np.zeros(len(keys), np.int32), np.zeros(len(keys), bool)
        left = np.arange(len(keys))
        for probe in range(self.probes):
            slot = (home[left] + probe) & ((1 << SLOTS) - 1)
            same = self.keys[slot] == keys[left]
            found[left[same]], more[left[same]] = self.entries[slot[same]], self.more[slot[same]]
            left = left[~same & (self.keys[slot] != 0)]
            if not len(left):
                break
        return found, more

    def edges(self, words: list[str]) -> list[list[tuple[int, np.ndarray | None, np.ndarray]]]:
        """For words of one length: for each end the pieces that end there, as (length, words or None for all, entries)."""
        n = len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n).astype(np.uint64)
        out: list[list] = [[] for _ in range(n + 1)]
        with np.errstate(over="ignore"):
            for start in range(n):
                rows, keys = np.arange(len(words)), np.zeros(len(words), np.uint64)
                for size in range(1, min(self.longest, n - start) + 1):
                    keys = self.step(keys, codes[rows, start + size - 1])
                    entry, more = self.find(keys)
                    if size == 1:
                        out[start + 1].append((1, None, np.where(entry == 0, 1, entry)))
                    else:
                        hit = np.flatnonzero(entry)
                        if len(hit):
                            out[start + size].append((size, rows[hit], entry[hit]))
                    going = np.flatnonzero(more)
                    if not len(going):
                        break
                    rows, keys = rows[going], keys[going]
        return out

    def places(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ends, lengths and entries of all pieces in one text, by end."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        rows, keys = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        found = []
        with np.errstate(over="ignore"):
            for size in range(1, self.longest + 1):
                keys = self.step(keys, codes[rows + size - 1])
                entry, more = self.find(keys)
                if size == 1:
                    entry = np.where(entry == 0, 1, entry)
                hit = np.flatnonzero(entry)
                found.append((rows[hit] + size, np.full(len(hit), size), entry[hit]))
                going = np.flatnonzero(more & (rows + size < len(codes)))
                if not len(going):
                    break
                rows, keys = rows[going], keys[going]
        ends, sizes, entries = (np.concatenate([f[i] for f in found]) for i in range(3))
        order = np.argsort(ends, kind="stable")
        return ends[order], sizes[order], entries[order]


Edges = list[list[tuple[int, np.ndarray | None, np.ndarray]]]


def forward(edges: Edges, p: np.ndarray, words: int) -> np.ndarray:
    """Sums over the segmentations of each prefix: words x characters + 1 x languages."""
    alpha = np.zeros((words, len(edges), p.shape[1]))
    alpha[:, 0] = 1
    for j, pieces in enumerate(edges):
        for size, rows, entry in pieces:
            if rows is None:
                alpha[:, j] += alpha[:, j - size] * p[entry]
            else:
                alpha[rows, j] += alpha[rows, j - size] * p[entry]
    return alpha


def backward(edges: Edges, p: np.ndarray, words: int) -> np.ndarray:
    beta = np.zeros((words, len(edges), p.shape[1]))
    beta[:, -1] = 1
    for j in range(len(edges) - 1, 0, -1):
        for size, rows, entry in edges[j]:
            if rows is None:
                beta[:, j - size] += beta[:, j] * p[entry]
            else:
                beta[rows, j - size] += beta[rows, j] * p[entry]
    return beta


def long_log(word: str, pieces: Pieces, logs: np.ndarray) -> np.ndarray:
    """Log of the sum over all segmentations of a word of any length, in each language.

    The sums are kept as logarithms, and only those of the last `pieces.longest` prefixes: memory doesn't grow with the word.
    """
    reach = pieces.longest
    state = [np.zeros(logs.shape[1])]
    for at in range(0, len(word), WINDOW):
        begin, end = max(0, at - reach + 1), min(len(word), at + WINDOW)
        ends, sizes, entries = pieces.places(word[begin:end])
        bounds = np.searchsorted(ends, np.arange(at + 1 - begin, end - begin + 2)).tolist()
        sizes, costs = sizes.tolist(), logs[entries]
        for a, b in zip(bounds[:-1], bounds[1:]):
            total = state[-sizes[a]] + costs[a]
            for i in range(a + 1, b):
                total = np.logaddexp(total, state[-sizes[i]] + costs[i])
            state.append(total)
        state = state[-reach:]
    return state[-1]


def long_expected(word: str, pieces: Pieces, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of all pieces in a word, and how often each of them is expected in each language."""
    ends, sizes, entries = pieces.places(word)
    starts, costs = ends - sizes, logs[entries]
    alpha, beta = np.full((len(word) + 1, logs.shape[1]), -np.inf), np.full((len(word) + 1, logs.shape[1]), -np.inf)
    alpha[0] = beta[-1] = 0
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
        alpha[b] = np.logaddexp(alpha[b], alpha[a] + costs[i])
    for i, (a, b) in reversed(list(enumerate(zip(starts.tolist(), ends.tolist())))):
        beta[a] = np.logaddexp(beta[a], beta[b] + costs[i])
    return entries, np.exp(alpha[starts] + costs + beta[ends] - alpha[-1])


def by_length(words: list[str], most: int = 4096) -> Iterator[list[str]]:
    ordered = sorted(words, key=len)
    at = 0
    while at < len(ordered):
        end = at
        while end < len(ordered) and end - at < most and len(ordered[end]) == len(ordered[at]):
            end += 1
        yield ordered[at:end]
        at = end


def words_of(text: str) -> list[str]:
    """Runs of letters; none if all of them are other signs that count as word characters (superscripts, fractions)."""
    found = WORD.findall(text.lower())
    return found if any(c.isalpha() for w in found for c in w) else []


def learn(counts: dict[str, Counter], pieces: Pieces, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and entries x languages of probabilities, by expectation maximisation."""
    langs = sorted(counts)
    weights: dict[str, np.ndarray] = {}
    for k, lang in enumerate(langs):
        for word, n in counts[lang].items():
            weights.setdefault(START + word, np.zeros(len(langs)))[k] += n
    p = np.full((pieces.count, len(langs)), 1 / pieces.count)
    p[0], p[1] = 0, UNKNOWN
    groups = [(g, pieces.edges(g), np.array([weights[w] for w in g])) for g in by_length([w for w in weights if len(w) <= SHORT])]
    long = [w for w in weights if len(w) > SHORT]
    for _ in range(rounds):
        expected = np.zeros_like(p)

        def add(entry: np.ndarray, share: np.ndarray) -> None:
            for k in range(len(langs)):
                expected[:, k] += np.bincount(entry, share[:, k], pieces.count)

        for words, edges, weight in groups:
            alpha, beta = forward(edges, p, len(words)), backward(edges, p, len(words))
            scale = weight / alpha[:, -1]
            found = [(entry, alpha[slice(None) if rows is None else rows, j - size] * p[entry] * beta[slice(None) if rows is None else rows, j] * scale[slice(None) if rows is None else rows]) for j, ends in enumerate(edges) for size, rows, entry in ends]
            add(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
        if long:
            with np.errstate(divide="ignore"):
                logs = np.log(p)
            for word in long:
                entry, share = long_expected(word, pieces, logs)
                add(entry, share * weights[word])
        expected[:2] = 0
        p = (expected + SMOOTHING) / (expected.sum(0) + SMOOTHING * pieces.count)
        p[0], p[1] = 0, UNKNOWN
    return langs, p


class Scorer:
    """Log probabilities of words in every language, kept by a worker up to a bound."""

    def __init__(self, model: tuple[list[str], np.ndarray, Pieces]):
        self.langs, self.p, self.pieces = model
        with np.errstate(divide="ignore"):
            self.logs = np.log(self.p)
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, len(self.langs)))

    def learn(self, words: set[str]) -> None:
        if len(self.rows) + len(words) > KEPT_WORDS:
            self.rows.clear()
            self.table = self.table[:0]
        names, logs = [], []
        for group in by_length([START + w for w in words if len(w) < SHORT]):
            logs.append(np.log(forward(self.pieces.edges(group), self.p, len(group))[:, -1]))
            names += [w[1:] for w in group]
        for word in words:
            if len(word) >= SHORT:
                logs.append(long_log(START + word, self.pieces, self.logs)[None])
                names.append(word)
        self.rows.update(zip(names, range(len(self.table), len(self.table) + len(names))))
        self.table = np.concatenate([self.table, *logs])

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        words = [words_of(t) for t in texts]
        if not self.langs:
            return [(UND, 0.0)] * len(texts)
        met = set().union(*words) if words else set()
        new = met.difference(self.rows)
        if new:
            self.learn(met if len(self.rows) + len(new) > KEPT_WORDS else new)
        get = self.rows.__getitem__
        out = []
        for own in words:
            if not own:
                out.append((UND, 0.0))
                continue
            logs = self.table[np.fromiter(map(get, own), np.int64, len(own))].sum(0)
            best = int(np.argmax(logs))
            out.append((self.langs[best], float(1 / np.exp(logs - logs[best]).sum())))
        return out


_SCORERS: dict[int, Scorer] = {}


def training_counts(labelled: DataFrame, per_language: int) -> dict[str, Counter]:
    """Word counts of the sample: of each language the per_language documents of the smallest id hashes."""
    ranked = labelled.select("lang", "doc_id", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")).alias("rank"))
    sample = ranked.where(F.col("rank") <= per_language).select("doc_id").distinct()  # bounded: per_language ids of each language

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            found: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                found.setdefault(lang, Counter()).update(words_of(text))
            rows = [(lang, word, n) for lang, c in found.items() for word, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    chosen = labelled.join(F.broadcast(sample), "doc_id", "left_semi").select("lang", "text")
    counts: dict[str, Counter] = {}
    for row in chosen.mapInArrow(common.trimmed(count), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).collect():
        counts.setdefault(row.lang, Counter())[row.word] = row.n
    return counts


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, path: str = VOCABULARY):
    """A model from doc_id, text, lang of the documents to learn from; rows with a null text or lang are left out."""
    pieces = Pieces(path)
    langs, p = learn(training_counts(labelled.where("text is not null and lang is not null"), per_language), pieces)
    return langs, p, pieces


def predict(df: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of each row; the model is sent to the executors once (its size is that of the vocabulary times the languages)."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = scorer_of(sent)
        for batch in common.slices(batches, SLICE_BYTES):
            doc_ids, texts = common.ids_and_texts(batch)
            found = judge.predict(texts)
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return common.documents(df, id_col, text_col).mapInArrow(common.trimmed(run), "doc_id long, lang_pred string, score double")


def annotate(df: DataFrame, model, text_col: str = "text") -> DataFrame:
    """df with two more columns, lang_pred and score, under free names (the last two columns of the result)."""
    common.small_batches(df.sparkSession)
    names = common.free_names(df, "lang_pred", "score")
    sent, at = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = scorer_of(sent)
        for batch in common.slices(batches, SLICE_BYTES):
            found = judge.predict([t or "" for t in batch.column(at).to_pylist()])
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])

    schema = T.StructType([*df.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return df.mapInArrow(common.trimmed(run), schema)


def scorer_of(sent) -> Scorer:
    model = sent.value
    key = id(model)
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(model)
    return _SCORERS[key]


def held_out(folds: int = 5):
    return common.crc32_of_id() % folds == 0


def model_of(docs: DataFrame):
    """The model learnt from the documents that aren't held out."""
    return fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(~held_out()))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, by a model learnt from the documents that aren't held out."""
    docs = common.table(spark, sf_dir, "documents")
    found = predict(docs, model_of(docs))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
