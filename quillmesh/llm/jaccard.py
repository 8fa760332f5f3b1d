"""N-gram Jaccard join: exact, by prefix trees over globally ordered shingle sets.

Documents whose shingle sets are equal are one member, known by 64 bits of a
hash of the set. 64 more bits tell sets apart that share those: all but the
first get a name of their own. Members go through these steps.

1. Frequencies. Every shingle goes to the bucket of its hash, which tells each
   member which of its shingles others have too, and in how many members.
   Shingles go packed, six bytes each. The very frequent ones (about a
   thousandth of all documents or more) aren't sent: they are found beforehand
   by merging local counts, are few (at most 2000 times the mean set size,
   whatever the input), and are broadcast. So no bucket gets a list longer than
   that share of the documents.
2. Prefix. In ascending order of frequency, two linked members share one of the
   first n - ceil(t n) + 1 shingles, t being the threshold. A member in which all of those are its
   own is linked with nothing and goes. The rest fall into groups: members that
   share a shingle of both prefixes, and so on, are in one group, so links never
   leave a group.
3. Segments. Groups that are too large for one task, as chance meetings chain up
   in a large corpus, are told apart by a stronger sign. Shingles are dealt by hash to one
   segment more than two linked sets can differ in, so one segment is equal in
   both. Members that share a whole segment, and so on, are a group.
4. Trie. In each group the sets, most frequent shingle first, are inserted into
   a path-compressed trie, smaller sets first. A set walks the trie before it is
   inserted; the overlap with a path is counted once for all sets that share
   the path, and a subtree is left when the overlap so far and the shingles that
   remain, on either side, can't reach the threshold. Subtrees that are already
   known to be in the walker's component are left too.
5. Groups beyond GROUP_MEMBERS or GROUP_BYTES still are cut into chunks, each
   joined on its own; then representatives of the chunks' components are joined,
   and last the members outside a group's largest component, in blocks, meet
   every chunk. This loses no pair that isn't connected already, and a task never
   holds more than a chunk and a block.

A document without words (or null) has an empty set and is linked with nothing;
its component is itself. One with fewer words than a shingle has the whole
sequence as its one shingle. Every row is linked by its own text, also if its id
occurs again or is null; a component is named after the smallest id in it (null
if it has none). Texts of any length are read whole; other columns go, but in
``one_of_each`` stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .components import components

WORDS = 4
THRESHOLD = (85, 100)
#: Text hashed at once.
HASHED_BYTES = 2 << 20
#: Shingles whose frequencies are counted together when looking for the very frequent ones.
COUNTED = 2_000_000
FREQUENT_SHARE = 1000
FREQUENT_LEAST = 64
BUCKET_BYTES = 24 << 20
#: A group up to this many members and bytes of sets is joined by one task.
GROUP_MEMBERS = 2000
GROUP_BYTES = 64 << 20
#: Empty segments that a set may have before it is dealt to segments anew, and how often it is.
EMPTY_SEGMENTS, DEALS = 3, 4
KEY_BYTES = 6
KEY_MASK = np.uint64((1 << 8 * KEY_BYTES) - 1)

_BASE = 0xD6E8FEB86659FD93
_powers: dict[str, np.ndarray] = {}
_TABLE = common.mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_COMBINE = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, HASHED_BYTES + (HASHED_BYTES >> 2))
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def shingle_hashes(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text (its bytes, already in lower case)."""
    joined = b"\n".join(texts) + b"\n"
    symbols = np.frombuffer(joined, np.uint8)
    blank = (symbols == 32) | ((symbols >= 9) & (symbols <= 13))
    edge = np.diff(np.r_[True, blank].view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _power_table(len(symbols) + 1)
    prefix = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(_TABLE[symbols] * up[: len(symbols)], out=prefix[1:])
    hashes = common.mix64((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    rolled = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for k in range(words):
        rolled += hashes[k : len(hashes) - words + 1 + k] * _COMBINE[k]
    rolled = common.mix64(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            short = np.uint64(b - a)
            for k in range(b - a):
                short = short * _COMBINE[4] + hashes[a + k]
            out.append(common.mix64(np.array([short])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_hash(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that tell the set: 64 that name it, and 64 to check the name."""
    raw = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def shingled(batches: Iterator[pa.RecordBatch], words: int, bits: int, renamed: dict[tuple[int, int], int]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[int], list[int]]]:
    """The rows, and their sets, members and checks, some documents at a time. bits: of the first hash that name a set (fewer only in tests)."""
    with np.errstate(over="ignore"):
        for batch in common.slices(batches, HASHED_BYTES):
            _, texts = common.ids_and_texts(batch)
            sets = shingle_hashes([t.encode().lower() for t in texts], words)
            hashes = [(m & (1 << bits) - 1 if bits < 64 else m, c) for m, c in map(set_hash, sets)]
            yield batch, sets, [renamed.get(h, h[0]) for h in hashes], [h[1] for h in hashes]


ROWS = "doc_id long, hash long, n long, member long, check long, shingle long, local long"


def members_and_counts(docs: DataFrame, words: int, bits: int = 64) -> DataFrame:
    """Rows (doc_id, hash of the text, n, member, check) of all documents, and rows (shingle, local count) of what is frequent in some part of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        size = count = 0

        def rows(*columns):
            length = max(map(len, columns))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) if len(c) else pa.nulls(length, pa.int64()) for c in columns], [c.split()[0] for c in ROWS.split(", ")])

        def frequent():
            keys = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            times = np.diff(np.r_[first, len(keys)])
            many = times >= max(8, count // FREQUENT_SHARE)
            return rows([], [], [], [], [], keys[first[many]].astype(np.int64), times[many].astype(np.int64))

        for batch, sets, members, checks in shingled(batches, words, bits, {}):
            yield rows(batch.column("doc_id").to_pylist(), batch.column("hash").to_pylist(), [len(s) for s in sets], members, checks, [], [])
            for own, member in zip(sets, members):
                if len(own) and member not in seen:
                    seen.add(member)
                    held.append(own)
                    size += len(own)
                    count += 1
            if size > COUNTED:
                yield frequent()
                held, size, count = [], 0, 0
                seen.clear()
        if held:
            yield frequent()

    return docs.mapInArrow(common.trimmed(run), ROWS)


def names_of(members: DataFrame) -> dict[tuple[int, int], int]:
    """New names of sets whose name another set has: none, but for about one pair in 2^64."""
    members = members.where("n > 0")
    taken = members.groupBy("member").agg(F.min("check").alias("first"), F.max("check").alias("last")).where("first <> last").select("member", "first").collect()
    if not taken:
        return {}
    names = members.sparkSession.createDataFrame([(r['member'], r['first']) for r in taken], "member long, first long")
    again = members.join(F.broadcast(names), "member").where("check <> first").select("member", "check").distinct()
    return {(r.member, r.check): r.member ^ r.check for r in again.collect()}


def packed(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, KEY_BYTES)
    return out.view(np.uint64).ravel()


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return first, np.diff(np.r_[first, len(values)])


#: kind 0: shingles for a bucket; kind 1: sizes and frequent shingles for a bucket of members.
POSTINGS = "bucket int, kind int, members binary, counts binary, keys binary, sizes binary"


def postings(docs: DataFrame, words: int, buckets: int, frequent, renamed: dict[tuple[int, int], int], bits: int = 64) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = frequent.value
        seen: set[int] = set()
        for _, sets, hashes, _ in shingled(batches, words, bits, renamed):
            own = []
            for s, m in zip(sets, hashes):
                if len(s) and m not in seen:
                    seen.add(m)
                    own.append((s, m))
            if not own:
                continue
            members = np.array([m for _, m in own], np.int64)
            sizes = np.array([len(s) for s, _ in own], np.uint32)
            flat = np.concatenate([s for s, _ in own])
            of = np.repeat(np.arange(len(own)), sizes)
            at = np.searchsorted(hot, flat)
            is_hot = hot[np.minimum(at, len(hot) - 1)] == flat if len(hot) else np.zeros(len(flat), bool)
            out = []
            cold, cold_of = flat[~is_hot], of[~is_hot]
            place = bucket_of(cold, buckets)
            order = np.argsort(place, kind="stable")
            cold, cold_of, place = cold[order], cold_of[order], place[order]
            for a, length in zip(*runs(place)):
                whose, times = runs(cold_of[a : a + length])
                out.append((int(place[a]), 0, members[cold_of[a + whose]].tobytes(), times.astype(np.uint32).tobytes(), packed(cold[a : a + length] & KEY_MASK), b""))
            hot_of, hot_keys = of[is_hot], flat[is_hot]
            times = np.bincount(hot_of, minlength=len(own)).astype(np.uint32)
            begin = np.r_[0, np.cumsum(times)]
            home = (members.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(home, kind="stable")
            for a, length in zip(*runs(home[order])):
                some = order[a : a + length]
                keys = np.concatenate([hot_keys[begin[i] : begin[i + 1]] for i in some])
                out.append((int(home[some[0]]), 1, members[some].tobytes(), times[some].tobytes(), keys.tobytes(), sizes[some].tobytes()))
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], [c.split()[0] for c in POSTINGS.split(", ")])

    return docs.mapInArrow(common.trimmed(run), POSTINGS)


#: A shingle's frequency is told as at most this; the very frequent ones come last in the order.
MOST = 65535


def shared(posted: DataFrame, buckets: int) -> DataFrame:
    """From each bucket to the members' home buckets: their shingles that others have too, with the frequency. Rows of kind 1 pass."""

    def count(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        bucket = rows[0]["bucket"]
        out = [(bucket, 1, r["members"], r["counts"], r["keys"], r["sizes"]) for r in rows if r["kind"] == 1]
        posts = [r for r in rows if r["kind"] == 0]
        del rows
        if posts:
            members = np.concatenate([np.frombuffer(r["members"], np.int64) for r in posts])
            times = np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in posts])
            keys = np.concatenate([unpacked(r["keys"]) for r in posts])
            # A member that several tasks sent is counted once.
            _, first = np.unique(members, return_index=True)
            once = np.zeros(len(members), bool)
            once[first] = True
            of = np.repeat(np.arange(len(members)), times)
            keep = once[of]
            keys, of = keys[keep], of[keep]
            order = np.argsort(keys, kind="stable")
            keys, of = keys[order], of[order]
            start, length = runs(keys)
            several = np.repeat(length > 1, length)
            degree = np.minimum(np.repeat(length, length), MOST - 1).astype(np.uint16)[several]
            keys, of = keys[several] | np.uint64(bucket & 0xFFFF) << np.uint64(48), of[several]
            home = (members[of].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((of, home))
            keys, of, degree, home = keys[order], of[order], degree[order], home[order]
            for a, length in zip(*runs(home)):
                part = slice(a, a + length)
                whose, counts = runs(of[part])
                out.append((int(home[a]), 0, members[of[part][whose]].tobytes(), counts.astype(np.uint32).tobytes(), keys[part].tobytes(), degree[part].tobytes()))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({c.split()[0]: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate(zip(POSTINGS.split(", "), kinds))})

    return posted.groupBy("bucket").applyInArrow(common.trimmed_group(count), POSTINGS)


def least_overlap(n: int, threshold: tuple[int, int] = THRESHOLD) -> int:
    """The smallest intersection that a set of n can have with one that it is linked with."""
    a, b = threshold
    return -(-a * n // b)


def candidates(told: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """member, n, prefix array<long>, shingles binary of the members whose prefix has a shingle that others have."""

    def gather(group: pa.Table) -> pa.Table:
        size: dict[int, int] = {}
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        hot_done: set[int] = set()
        for r in group.to_pylist():
            members = np.frombuffer(r["members"], np.int64)
            counts = np.frombuffer(r["counts"], np.uint32)
            keys = np.frombuffer(r["keys"], np.uint64)
            if r["kind"] == 0:
                parts.append((np.repeat(members, counts), keys, np.frombuffer(r["sizes"], np.uint16)))
                continue
            new = np.array([m not in hot_done for m in members.tolist()], bool)
            hot_done.update(members.tolist())
            size.update(zip(members.tolist(), np.frombuffer(r["sizes"], np.uint32).tolist()))
            keep = np.repeat(new, counts)
            whose = np.repeat(members, counts)[keep]
            parts.append((whose, keys[keep], np.full(len(whose), MOST, np.uint16)))
        out: list[tuple[int, int, list[int], bytes]] = []
        if parts:
            members, keys, degree = (np.concatenate([p[i] for p in parts]) for i in range(3))
            order = np.lexsort((keys, degree, members))
            members, keys = members[order], keys[order]
            for a, length in zip(*runs(members)):
                member = int(members[a])
                n = size[member]
                first = n - least_overlap(n, threshold) + 1 - (n - int(length))
                if first > 0:
                    own = keys[a : a + length]
                    out.append((member, n, own[:first].view(np.int64).tolist(), own.tobytes()))
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
        return pa.table({c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate(zip(("member", "n", "prefix", "shingles"), kinds))})

    return told.groupBy("bucket").applyInArrow(common.trimmed_group(gather), "member long, n long, prefix array<long>, shingles binary")


class Trie:
    """Path-compressed trie of sorted sets. Each node: its run of elements, children by first element, the bounds of the sets below, and their component where it is one."""

    def __init__(self):
        self.run, self.children, self.ends = [np.zeros(0, np.int64)], [{}], [[]]
        self.smallest, self.deepest, self.label = [1 << 60], [0], [-1]

    def _node(self, run, children, ends, smallest, deepest, label) -> int:
        for column, value in zip((self.run, self.children, self.ends, self.smallest, self.deepest, self.label), (run, children, ends, smallest, deepest, label)):
            column.append(value)
        return len(self.run) - 1

    def insert(self, elements: np.ndarray, n: int, who: int, root) -> None:
        node, at = 0, 0
        while True:
            self.smallest[node] = min(self.smallest[node], n)
            self.deepest[node] = max(self.deepest[node], len(elements) - at)
            if self.label[node] == -1:
                self.label[node] = who
            elif self.label[node] >= 0 and root(self.label[node]) != root(who):
                self.label[node] = -2
            if at == len(elements):
                self.ends[node].append((n, who))
                return
            child = self.children[node].get(int(elements[at]))
            if child is None:
                self.children[node][int(elements[at])] = self._node(elements[at:], {}, [(n, who)], n, 0, who)
                return
            run = self.run[child]
            length = min(len(run), len(elements) - at)
            differs = np.flatnonzero(run[:length] != elements[at : at + length])
            same = int(differs[0]) if len(differs) else length
            if same < len(run):
                lower = self._node(run[same:], self.children[child], self.ends[child], self.smallest[child], self.deepest[child], self.label[child])
                self.run[child], self.children[child], self.ends[child] = run[:same], {int(run[same]): lower}, []
                self.deepest[child] += len(run) - same
            node, at = child, at + same

    def walk(self, elements: np.ndarray, n: int, member: np.ndarray, own, root, threshold: tuple[int, int] = THRESHOLD) -> Iterator[int]:
        """Sets that are linked with this one and not yet in its component; member[e] tells whether e is in it."""
        a, b = threshold
        total = len(elements)
        stack = [(0, 0)]
        while stack:
            node, overlap = stack.pop()
            label = self.label[node]
            if label >= 0 and root(label) == root(own):
                continue
            run = self.run[node]
            left = total
            if len(run):
                overlap += int(np.count_nonzero(member[run]))
                left = total - int(np.searchsorted(elements, run[-1], "right"))
            least = a * (n + self.smallest[node])
            if (overlap + min(left, self.deepest[node])) * (a + b) < least:
                continue
            for size, who in self.ends[node]:
                if overlap * (a + b) >= a * (n + size) and root(who) != root(own):
                    yield who
            for child in self.children[node].values():
                stack.append((child, overlap))


def join_group(members: list[int], sizes: list[int], sets: list[np.ndarray], labels: list[int] | None = None, threshold: tuple[int, int] = THRESHOLD) -> list[tuple[int, int]]:
    """Links that connect the linked members of a group. labels: components known already."""
    if len(members) < 2:
        return []
    parent = list(range(len(members)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    if labels is not None:
        first: dict[int, int] = {}
        for i, label in enumerate(labels):
            parent[i] = first.setdefault(label, i)
    # Elements numbered by falling frequency in the group: sets share long beginnings.
    names, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.empty(len(names), np.int64)
    number[np.lexsort((names, -count))] = np.arange(len(names))
    flat = number[inverse.ravel()]
    bounds = np.cumsum([0, *map(len, sets)])
    trie, links, member = Trie(), [], np.zeros(len(names), bool)
    for i in np.argsort(sizes, kind="stable").tolist():
        own = np.sort(flat[bounds[i] : bounds[i + 1]])
        member[own] = True
        for other in trie.walk(own, sizes[i], member, i, root, threshold):
            links.append((members[i], members[other]))
            parent[root(i)] = root(other)
        member[own] = False
        trie.insert(own, sizes[i], i, root)
    return links


def join_groups(rows: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Links a, b from rows (key, member, n, shingles, label): each key's members are joined by one task at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, found = None, [], []

        def done():
            unique = {r[0]: r for r in held}
            held[:] = unique.values()
            found.extend(join_group([r[0] for r in held], [r[1] for r in held], [np.frombuffer(r[2], np.uint64) for r in held], [r[3] for r in held], threshold))
            held.clear()

        def links():
            out = pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(2)], ["a", "b"])
            found.clear()
            return out

        for batch in batches:
            for k, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "member", "n", "shingles", "label"))):
                if k != key:
                    done()
                    key = k
                    if len(found) > 10_000:
                        yield links()
                held.append(row)
        done()
        yield links()

    return rows.select("key", "member", "n", "shingles", "label").repartition("key").sortWithinPartitions("key").mapInArrow(common.trimmed(run), "a long, b long")


def segment_counts(n: int, threshold: tuple[int, int]) -> tuple[int, int]:
    """The size class of a set of n, and the number of segments for pairs whose smaller set is of that class."""
    a, b = threshold
    low, scheme = 1, 0
    while (high := b * low // a + 1) <= n:  # no set below low is linked with one of high or more
        low, scheme = high, scheme + 1
    return scheme, (high - 1) * (b - a) // a + 1 + EMPTY_SEGMENTS


def segment_signs(n: int, elements: np.ndarray, threshold: tuple[int, int]) -> list[int]:
    """Hashes of the set's non-empty segments: two linked sets have one in common.

    Two linked sets differ in at most (high - 1) (1 - t) / t elements, so of the
    segments EMPTY_SEGMENTS + 1 at least are equal in both. If one of the two has
    no more empty ones than that, one of the equal ones isn't empty. If both have
    more, both are dealt anew; after DEALS times they share a sign that says so.
    """
    scheme, segments = segment_counts(n, threshold)
    plans = [(scheme, segments)]
    if scheme:
        low = n
        while segment_counts(low, threshold)[0] == scheme:
            low = low * threshold[0] // threshold[1]
        plans.append(segment_counts(max(1, low), threshold))
    out: list[int] = []
    with np.errstate(over="ignore"):
        for scheme, segments in plans:
            for deal in range(DEALS):
                mixed = common.mix64(elements ^ np.uint64((deal + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
                place = mixed % np.uint64(segments)
                order = np.argsort(place, kind="stable")
                first, _ = runs(place[order])
                sums = np.add.reduceat(common.mix64(mixed[order]), first)
                out += common.mix64(sums ^ common.mix64(place[order][first] + np.uint64((scheme * DEALS + deal) << 32))).view(np.int64).tolist()
                if segments - len(first) <= EMPTY_SEGMENTS:
                    break
            else:
                out.append(scheme)
    return out


def told_apart(rows: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """rows (member, n, shingles) in groups of members that share a segment, and so on: grp. Members that share none are linked with nothing and go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = [segment_signs(n, np.frombuffer(x, np.uint64), threshold) for n, x in zip(batch.column("n").to_pylist(), batch.column("shingles").to_pylist())]
            members = np.repeat(batch.column("member").to_numpy(), [len(x) for x in signs])
            yield pa.RecordBatch.from_arrays([pa.array(members), pa.array([x for own in signs for x in own], pa.int64())], ["member", "sign"])

    signs = common.written(rows.select("member", "n", "shingles").mapInArrow(common.trimmed(run), "member long, sign long"), "signs")
    least = signs.groupBy("sign").agg(F.min("member").alias("least"), F.count("*").alias("times")).where("times > 1")
    grouped = components(signs.join(least, "sign").select(F.col("member").alias("a"), F.col("least").alias("b")).distinct())
    return rows.join(grouped.select(F.col("node").alias("member"), F.col("component").alias("grp")), "member")


def in_chunks(rows: DataFrame) -> DataFrame:
    """rows with the number of chunks of their group, and their own."""
    sizes = rows.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / GROUP_MEMBERS), F.ceil(F.sum(F.octet_length("shingles")) / GROUP_BYTES)).alias("chunks"))
    return rows.join(sizes, "grp").withColumn("chunk", F.pmod(F.xxhash64("member"), F.col("chunks")))


def link_components(found: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """member, component (smallest member) of the linked members, from candidates()."""
    edges = found.select("member", F.explode("prefix").alias("shingle"))
    # Written, so that the join deals both sides anew and a shingle that very many members have can be split.
    least = common.written(edges.groupBy("shingle").agg(F.min("member").alias("least"), F.count("*").alias("times")).where("times > 1"), "shingles")
    grouped = components(edges.join(least, "shingle").select(F.col("member").alias("a"), F.col("least").alias("b")).distinct())
    rows = found.select("member", "n", "shingles").join(grouped.select(F.col("node").alias("member"), F.col("component").alias("grp")), "member")
    rows = common.written(in_chunks(rows), "groups")
    large = rows.where("chunks > 1").select("member", "n", "shingles")
    if not large.isEmpty():
        rows = common.written(rows.where("chunks = 1").unionByName(in_chunks(told_apart(large, threshold))), "groups")
    keyed = rows.withColumn("key", F.xxhash64("grp", "chunk")).withColumn("label", F.col("member"))
    links = common.written(join_groups(keyed, threshold), "links")
    large = rows.where("chunks > 1")
    if large.isEmpty():
        return components(links)
    # Representatives of the chunks' components, then whoever isn't in the largest component of the group against every chunk.
    with_label = _labelled(large, links)
    reps = with_label.where("member = label").withColumn("part", F.floor(F.row_number().over(Window.partitionBy("grp", F.pmod(F.xxhash64("member"), F.lit(64))).orderBy("member")) / GROUP_MEMBERS))
    links = common.written(links.unionByName(join_groups(reps.withColumn("key", F.xxhash64("grp", "part")), threshold)), "links")
    with_label = _labelled(large, links)
    per_label = with_label.groupBy("grp", "label").agg(F.count("*").alias("times"), F.sum(F.octet_length("shingles")).alias("bytes"))
    major = per_label.groupBy("grp").agg(F.max_by("label", F.struct("times", "label")).alias("major"), F.count("*").alias("labels")).where("labels > 1").select("grp", "major")
    minor_size = per_label.join(major, "grp").where("label <> major").groupBy("grp", "major").agg(F.greatest(F.ceil(F.sum("times") / GROUP_MEMBERS), F.ceil(F.sum("bytes") / GROUP_BYTES)).alias("blocks"))
    open_groups = with_label.join(minor_size, "grp")
    # A task has a chunk and a block of minor members: each of these meets all others, whatever their chunk.
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    whole = open_groups.withColumn("block", upto("blocks"))
    minor = open_groups.where("label <> major").withColumn("block", F.pmod(F.xxhash64("member", F.lit(1)), F.col("blocks"))).withColumn("chunk", upto("chunks"))
    last = whole.unionByName(minor).withColumn("key", F.xxhash64("grp", "chunk", "block"))
    return components(common.written(links.unionByName(join_groups(last, threshold)), "links"))


def _labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    known = components(links).withColumnRenamed("node", "member").withColumnRenamed("component", "label")
    return common.written(rows.join(known, "member", "left").withColumn("label", F.coalesce("label", "member")), "labels")


def joined(docs: DataFrame, words: int, threshold: tuple[int, int], bits: int = 64) -> DataFrame:
    """doc_id, hash, n_shingles, component_id of every row of docs (doc_id, text, hash of the text)."""
    spark, since = docs.sparkSession, common.mark()
    first = common.written(members_and_counts(docs, words, bits), "members")
    members = first.where("shingle is null").select("doc_id", "hash", "n", "member", "check")
    count, total = members.agg(F.count("*"), F.sum("n")).first()
    renamed = names_of(members)
    if renamed:
        names = spark.createDataFrame([(m, c, new) for (m, c), new in renamed.items()], "member long, check long, new long")
        members = members.join(F.broadcast(names), ["member", "check"], "left").withColumn("member", F.coalesce("new", "member")).drop("new")  # a row for each clash of 64-bit hashes
    hot = [r.shingle for r in first.where("shingle is not null").groupBy("shingle").agg(F.sum("local").alias("times")).where(F.col("times") >= max(FREQUENT_LEAST, count // (2 * FREQUENT_SHARE))).collect()]
    frequent = spark.sparkContext.broadcast(np.sort(np.array(hot, np.int64).view(np.uint64)))
    buckets = common.partitions_for((total or 0) * KEY_BYTES, BUCKET_BYTES // 2)
    found = common.written(candidates(shared(postings(docs, words, buckets, frequent, renamed, bits), buckets), threshold), "candidates")
    linked = link_components(found, threshold).select(F.col("node").alias("member"), "component")
    # Members of a component are the documents with their sets; its id is the smallest of their doc_ids.
    placed = common.written(members.join(linked, "member", "left").select("doc_id", "hash", "n", F.when(F.col("n") > 0, F.coalesce("component", "member")).alias("component")), "placed")
    least = common.written(placed.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("least")), "least")
    common.sweep(spark, since, placed, least)
    named = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return placed.join(least, "component", "left").select("doc_id", "hash", F.col("n").alias("n_shingles"), named.alias("component_id"))


def with_hash(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return common.documents(df, id_col, text_col).withColumn("hash", F.xxhash64("text"))


def join(df: DataFrame, words: int = WORDS, threshold: tuple[int, int] = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return joined(with_hash(df, id_col, text_col), words, threshold, bits).drop("hash")


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents linked at Jaccard 0.85 or more of their 4-word shingles."""
    return join(common.table(spark, sf_dir, "documents"))


def one_of_each(df: DataFrame, words: int, threshold: tuple[int, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df but those linked, through others or not, with a row of a smaller id (any id, if their own is null). Rows that share the id that a component is named after all stay."""
    found = joined(with_hash(df, id_col, text_col), words, threshold)
    gone = found.where("component_id is not null and not (doc_id <=> component_id)").select(F.col("doc_id").alias("g_id"), F.col("hash").alias("g_hash")).distinct()
    own, key = F.xxhash64(F.col(f"d.`{text_col}`").cast("string")), F.col(f"d.`{id_col}`").cast("long")
    return df.alias("d").join(gone, (own == F.col("g_hash")) & key.eqNullSafe(F.col("g_id")), "left_anti").select(*(F.col(f"d.`{c}`") for c in df.columns))
