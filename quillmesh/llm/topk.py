"""Exact top-k search by inner product with one KD-tree for each shard of vectors.

Space is cut into cells by the top levels of a KD-tree, at medians of a bounded
sample; a cell's vectors are a shard, or several by the hash of their id where
they are too many. Each shard has a tree of its own: it splits its vectors at
the median of the widest coordinate and keeps the tight bounding box of every
node. A query takes nodes best first: by the largest inner product that any
point of the box can have. It ends when no box can beat the k-th result so far.

Each query searches a shard of its own cell first; the k-th score found there
goes with it, and it is sent only to cells whose tight box (of all their vectors,
not of the sample) can reach that score. Queries are searched in blocks of
bounded size.

Scores are integers, held exactly: in doubles while no sum can pass 2^53, in
64-bit integers while none can pass 2^62, else in Python's own. Scores beyond 64
bits count as the nearest long.

Vectors that are null, or hold null or non-finite components, or have a null
id, take no part. Vectors meet only those of their own dimension. Rows that
share the query's id are the query's own and not its candidates; of several the
least vector (compared component by component) asks. Other rows that share an
id are candidates of their own. Ties go to the smaller id. Fewer than k
candidates: all of them. Other columns than the two that are named go.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SHARD_ROWS = 8192
LEAF_ROWS = 64
#: Cells of a dimension, and vectors that their borders are found from, at most.
CELLS = 128
SAMPLED = 4096
#: Queries that meet a tree in one task, roughly, and at once.
QUERY_ROWS = 20_000
QUERY_BLOCK = 256
EXACT, WIDE = 1 << 53, 1 << 62
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantised(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and v array<long>: floor(scale * x) of each component."""
    vectors = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    sound = F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.where(sound).select("vec_id", F.transform("x", lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("v"))


def narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the fewest bytes."""
    for kind in (np.int16, np.int32):
        if not x.size or x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max:
            return x.astype(kind)
    return x


def largest(x: np.ndarray) -> int:
    """The largest absolute value, also that of the least long."""
    return max(-int(x.min(initial=0)), int(x.max(initial=0)))


def farthest(queries: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """The largest inner product that a point of each box can have: queries x boxes."""
    return np.maximum(queries, 0) @ highs.T + np.minimum(queries, 0) @ lows.T


class KdTree:
    """Nodes in arrays: boxes, children, the smallest id below, and for leaves their range of rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS):
        order = np.lexsort((ids,))
        self.lows, self.highs, self.least, self.children, self.ranges = [], [], [], [], []
        rows: list[np.ndarray] = []
        filled = 0
        # Nodes are split from a stack, not by recursion; a node's children are appended as it is split.
        stack = [(order, -1, 0)]
        while stack:
            own, parent, side = stack.pop()
            node, box = len(self.lows), vectors[own]
            low, high = box.min(0), box.max(0)
            self.lows.append(low)
            self.highs.append(high)
            self.least.append(int(ids[own].min()))
            self.children.append([-1, -1])
            self.ranges.append((0, 0))
            if parent >= 0:
                self.children[parent][side] = node
            if len(own) <= leaf_rows:
                self.ranges[node] = (filled, filled + len(own))
                rows.append(own)
                filled += len(own)
                continue
            # All equal: the widest side is 0, and the stable order splits by id.
            axis = int(np.argmax(high - low)) if box.shape[1] else 0
            along = own[np.argsort(box[:, axis], kind="stable")] if box.shape[1] else own
            half = len(along) // 2
            stack += [(along[half:], node, 1), (along[:half], node, 0)]
        rows_all = np.concatenate(rows)
        self.ids, self.vectors = ids[rows_all], narrow(vectors[rows_all])
        self.lows, self.highs = narrow(np.array(self.lows)), narrow(np.array(self.highs))
        self.most = largest(vectors)

    def exact_type(self, queries: np.ndarray) -> type:
        top = self.most * largest(queries) * max(1, queries.shape[1])
        return np.float64 if top < EXACT else np.int64 if top < WIDE else object

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, bounds: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(query, vec_id, score) of up to k best rows for each query, of those with at least its bound."""
        kind = self.exact_type(queries)
        vectors, q = self.vectors.astype(kind), queries.astype(kind)
        box = farthest(q, self.lows.astype(kind), self.highs.astype(kind))
        clip = (lambda x: np.clip(x, LEAST, MOST)) if kind is object else (lambda x: x)
        box = clip(box)
        ids, least, children, ranges = self.ids, self.least, self.children, self.ranges
        for i, own in enumerate(query_ids.tolist()):
            best: list[tuple[int, int]] = []  # heap of (score, -id), the worst first
            worst, worst_id = int(bounds[i]), None
            row, vector = box[i].tolist(), q[i]
            heap = [(-row[0], least[0], 0)]
            while heap:
                reach, smallest, node = heapq.heappop(heap)
                if -reach < worst:
                    break
                if -reach == worst and worst_id is not None and smallest > worst_id:
                    continue
                for child in children[node]:
                    if child >= 0 and row[child] >= worst:
                        heapq.heappush(heap, (-row[child], least[child], child))
                at, end = ranges[node]
                if at == end:
                    continue
                scores = clip(vectors[at:end] @ vector)
                for j in np.flatnonzero(scores >= worst).tolist():
                    found = (int(scores[j]), -int(ids[at + j]))
                    if -found[1] == own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, found)
                    elif found > best[0]:
                        heapq.heapreplace(best, found)
                if len(best) == k and best[0][0] >= worst:
                    worst, worst_id = best[0][0], -best[0][1]
            for score, minus in best:
                yield own, -minus, score


class Cells:
    """The top of a KD-tree: where a vector lies. Made from a sample, it covers all space."""

    def __init__(self, sample: np.ndarray, cells: int):
        # Of each node: the axis and value it splits at (axis -1: a cell), its children, its cell.
        self.axis, self.value, self.left, self.right, self.cell = [-1], [0], [0], [0], [0]
        groups, count = [(len(sample), 0, sample)], 1
        while groups and count < cells:
            groups.sort(key=lambda g: g[:2])
            _, node, rows = groups.pop()
            sides = rows.max(0).astype(float) - rows.min(0) if rows.size else np.zeros(1)
            if not sides.max():
                continue  # all equal: it stays whole
            count += 1
            axis = int(np.argmax(sides))
            along = np.sort(rows[:, axis])
            cut = along[(len(along) - 1) // 2]
            if cut == along[-1]:
                cut = along[along < cut][-1]
            self.axis[node], self.value[node] = axis, int(cut)
            for side, own in ((self.left, rows[rows[:, axis] <= cut]), (self.right, rows[rows[:, axis] > cut])):
                side[node] = len(self.axis)
                for column, new in zip((self.axis, self.value, self.left, self.right, self.cell), (-1, 0, 0, 0, 0)):
                    column.append(new)
                groups.append((len(own), side[node], own))
        leaves = [i for i, axis in enumerate(self.axis) if axis < 0]
        for k, i in enumerate(leaves):
            self.cell[i] = k
        self.count = len(leaves)
        self.axis, self.value, self.left, self.right, self.cell = map(np.array, (self.axis, self.value, self.left, self.right, self.cell))

    def of(self, matrix: np.ndarray) -> np.ndarray:
        node = np.zeros(len(matrix), np.int64)
        while True:
            inner = np.flatnonzero(self.axis[node] >= 0)
            if not len(inner):
                return self.cell[node]
            at = node[inner]
            node[inner] = np.where(matrix[inner, self.axis[at]] <= self.value[at], self.left[at], self.right[at])


def matrices(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each dimension: it, the rows that have it, and their vectors."""
    offsets, flat = column.offsets.to_numpy().astype(np.int64), column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        yield dim, rows, flat[offsets[rows][:, None] + np.arange(dim)] if dim else np.zeros((len(rows), 0), np.int64)


class Plan:
    """How space is cut: for each dimension its cells, and the shards of each cell (first, how many)."""

    def __init__(self, tops: dict[int, Cells]):
        self.tops = tops
        self.first: dict[int, np.ndarray] = {}
        self.shards: dict[int, np.ndarray] = {}

    def settle(self, counts: dict[tuple[int, int], int], shard_rows: int) -> None:
        at = 0
        for dim, top in self.tops.items():
            many = np.array([max(1, -(-counts.get((dim, k), 0) // shard_rows)) for k in range(top.count)])
            self.first[dim], self.shards[dim] = at + np.cumsum(many) - many, many
            at += int(many.sum())

    def shard(self, dim: int, cell: np.ndarray, ids: np.ndarray) -> np.ndarray:
        some = (common.mix64(ids.view(np.uint64)) % self.shards[dim][cell].astype(np.uint64)).astype(np.int64)
        return self.first[dim][cell] + some


def cell_counts(vectors: DataFrame, plan: Plan) -> dict[tuple[int, int], int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for dim, _, matrix in matrices(batch.column(0)):
                rows += [(dim, k, n) for k, n in enumerate(np.bincount(plan.tops[dim].of(matrix)).tolist()) if n]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["dim", "cell", "n"])

    return {(r.dim, r.cell): r.n for r in vectors.select("v").mapInArrow(run, "dim long, cell long, n long").groupBy("dim", "cell").agg(F.sum("n").alias("n")).collect()}


def placed(vectors: DataFrame, plan: Plan, id_col: str) -> DataFrame:
    """vectors (an id, v) with dim, cell and shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            out = [np.zeros(len(ids), np.int64) for _ in range(3)]
            for dim, rows, matrix in matrices(batch.column(1)):
                cell = plan.tops[dim].of(matrix)
                for column, values in zip(out, (dim, cell, plan.shard(dim, cell, ids[rows]))):
                    column[rows] = values
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, out)], [id_col, "v", "dim", "cell", "shard"])

    return vectors.select(id_col, "v").mapInArrow(run, f"{id_col} long, v array<long>, dim long, cell long, shard long")


TREES = "shard long, dim long, cell long, low array<long>, high array<long>, tree binary"


def build(vectors: DataFrame, plan: Plan) -> DataFrame:
    """One row for each shard: its tree and the tree's box."""

    def grow(group: pa.Table) -> pa.Table:
        ids = group.column("vec_id").to_numpy()
        ((dim, _, matrix),) = matrices(group.column("v").combine_chunks())
        tree = KdTree(ids, matrix.astype(np.int64))
        box = [pa.array([x[0].astype(np.int64).tolist()], pa.list_(pa.int64())) for x in (tree.lows, tree.highs)]
        return pa.table({"shard": group.column("shard").slice(0, 1), "dim": pa.array([dim], pa.int64()), "cell": group.column("cell").slice(0, 1), "low": box[0], "high": box[1], "tree": pa.array([pickle.dumps(tree, 5)], pa.binary())})

    return placed(vectors, plan, "vec_id").groupBy("shard").applyInArrow(grow, TREES)


def boxes_of(trees: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each dimension its cells that have vectors, and their tight boxes: at most CELLS rows of each."""
    sides = trees.select("dim", "cell", F.posexplode(F.arrays_zip("low", "high")).alias("axis", "x")).groupBy("dim", "cell", "axis").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    found: dict[int, dict[int, dict[int, tuple[int, int]]]] = {}
    for r in trees.select("dim", "cell").distinct().collect():
        found.setdefault(r.dim, {})[r.cell] = {}
    for r in sides.collect():
        found[r.dim][r.cell][r.axis] = (r.low, r.high)
    out = {}
    for dim, cells in found.items():
        names = sorted(cells)
        table = np.array([[cells[c][a] for a in range(dim)] for c in names], np.int64).reshape(len(names), dim, 2)
        out[dim] = (np.array(names), table[:, :, 0], table[:, :, 1])
    return out


def searched(trees: DataFrame, queries: DataFrame, k: int, blocks: int) -> DataFrame:
    """Run queries (query_id, v, bound, shard) in the trees of their shards, a block of queries at a time."""

    def look(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if right.num_rows:
            ids, bounds = right.column("query_id").to_numpy(), right.column("bound").to_numpy()
            ((_, _, matrix),) = matrices(right.column("v").combine_chunks())
            for blob in left.column("tree").to_pylist():
                tree = pickle.loads(blob)
                for at in range(0, len(ids), QUERY_BLOCK):
                    part = slice(at, at + QUERY_BLOCK)
                    found += tree.search(ids[part], matrix[part], k, bounds[part])
        return pa.table({c: pa.array([f[i] for f in found], pa.int64()) for i, c in enumerate(("query_id", "vec_id", "score"))})

    held = trees.select("shard", "tree", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    return held.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(look, "query_id long, vec_id long, score long")


def elsewhere(queries: DataFrame, plan: Plan, boxes: dict) -> DataFrame:
    """The queries (query_id, v, shard: where they were, bound) for each cell that can reach their bound, with the cell's shards (first, last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds = batch.column("bound").to_numpy()
            for dim, rows, matrix in matrices(batch.column("v")):
                if dim not in boxes:
                    continue
                names, lows, highs = boxes[dim]
                top = max(largest(lows), largest(highs)) * largest(matrix) * max(1, dim)
                kind = np.float64 if top < EXACT else np.int64 if top < WIDE else object
                far = farthest(matrix.astype(kind), lows.astype(kind), highs.astype(kind)) >= np.maximum(bounds[rows], LEAST + 1).astype(kind)[:, None]
                far |= bounds[rows][:, None] == LEAST
                q, c = np.nonzero(far.astype(bool))
                first = plan.first[dim][names[c]]
                part = batch.select(["query_id", "v", "shard", "bound"]).take(pa.array(rows[q]))
                for at in range(0, len(q), common.BATCH_ROWS):
                    some = part.slice(at, common.BATCH_ROWS)
                    ends = slice(at, at + common.BATCH_ROWS)
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(first[ends]), pa.array((first + plan.shards[dim][names[c]] - 1)[ends])], [*some.schema.names, "first", "last"])

    found = queries.select("query_id", "v", "shard", "bound").mapInArrow(run, "query_id long, v array<long>, shard long, bound long, first long, last long")
    return found.withColumnRenamed("shard", "home").withColumn("shard", F.explode(F.sequence("first", "last"))).where("shard <> home").select("query_id", "v", "shard", "bound")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, cells: int = CELLS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of vectors (vec_id, v) for each of queries (vec_id, v)."""
    sizes = {r.dim: r.n for r in vectors.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    asked = queries.select(F.col("vec_id").alias("query_id"), "v").groupBy("query_id").agg(F.min("v").alias("v"))
    if not total:
        return asked.where("false").select("query_id", F.lit(1).alias("rank"), F.lit(1).cast("long").alias("vec_id"), F.lit(1).cast("long").alias("score"))
    some: dict[int, list] = {dim: [] for dim in sizes}
    for r in (vectors if total <= SAMPLED else vectors.sample(SAMPLED / total, 1)).select("v").collect():
        some[len(r.v)].append(r.v)
    plan = Plan({dim: Cells(np.array(rows, np.int64).reshape(len(rows), dim), min(cells, -(-sizes[dim] // shard_rows))) for dim, rows in some.items()})
    plan.settle(cell_counts(vectors, plan), shard_rows)
    trees = common.written(build(vectors, plan), "kdtrees")
    asked = asked.where(F.size("v").isin(list(sizes)))
    blocks = max(1, -(-asked.count() // query_rows))
    home = common.written(placed(asked, plan, "query_id").select("query_id", "v", "shard"), "topk-queries")
    first = common.written(searched(trees, home.withColumn("bound", F.lit(LEAST).cast("long")), k, blocks), "topk-home")
    full = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("bound")).where(F.col("n") >= k).select("query_id", "bound")
    rest = elsewhere(home.join(full, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(LEAST).cast("long"))), plan, boxes_of(trees))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = first.unionByName(searched(trees, rest, k, blocks))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all vectors for each whose id is divisible by 50."""
    vectors = quantised(common.table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)
