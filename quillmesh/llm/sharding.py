"""Minimax contiguous partition of ordered atomic groups into shards.

Equal texts form a group that isn't split; groups are ordered by the hash of
their text. The smallest shard capacity is searched by bisection: a capacity is
feasible if filling shards greedily in order, a new one whenever the next group
doesn't fit, takes no more shards than there are.

No group list reaches the driver. It sees cells, ranges of hashes with their
sizes, at most a few thousand to begin with. Taking a cell as indivisible gives
a capacity that surely suffices, taking it as divisible one below which none
does. While the two differ, the cells in which a cut may fall are split, until
both meet; the cuts then stand at borders of cells.

Null texts count as empty and are one group with them. No shard exceeds the
minimax capacity; an empty table gives no rows. Every row is placed by its text
alone, so repeated rows, rows that share an id and rows with a null doc_id have
slots of their own; ties in slots are settled by id and then by the text's CRC.
Texts of any length count whole.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common

FIRST_BITS = 12
MORE_BITS = 8
#: Rows of a shard that are numbered together, roughly.
NUMBERED_ROWS = 100_000

#: A cell: smallest and largest hash in it, bits of its width, size, whether it is one group.
Cell = tuple[int, int, int, int, bool]


def sized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return common.documents(df, id_col, text_col).select(
        "doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("group_hash")
    )


def greedy(prefix: list[int], single: list[bool], capacity: int, shards: int, divisible: bool) -> list[int] | None:
    """Positions where shards end, or None if they don't suffice. divisible: cells of several groups can be cut anywhere."""
    ends, at, total = [], 0, prefix[-1]
    for _ in range(shards):
        reach = at + capacity
        if reach >= total:
            return [*ends, total]
        i = bisect_right(prefix, reach) - 1  # cells up to i fit
        at = reach if divisible and not single[i] else prefix[i]
        ends.append(at)
    return None


def smallest(prefix: list[int], single: list[bool], shards: int, divisible: bool, low: int, high: int) -> int:
    while low < high:
        middle = (low + high) // 2
        if greedy(prefix, single, middle, shards, divisible) is None:
            low = middle + 1
        else:
            high = middle
    return low


def cells_of(rows: DataFrame, bits: int, parents: list[Cell] | None = None) -> list[Cell]:
    """Sizes of the hash ranges that share their leading bits, within the parents if those are given."""
    if parents is not None:
        spark = rows.sparkSession
        keys = spark.createDataFrame([(c[0] >> (64 - c[2]),) for c in parents], "parent long")
        rows = rows.join(keys, F.shiftright("group_hash", 64 - parents[0][2]) == F.col("parent"), "left_semi")
    found = rows.groupBy(F.shiftright("group_hash", 64 - bits).alias("cell")).agg(F.min("group_hash").alias("low"), F.max("group_hash").alias("high"), F.sum("size").alias("size")).collect()
    return [(r.low, r.high, bits, r.size, r.low == r.high) for r in found]


def cuts(rows: DataFrame, shards: int) -> list[int]:
    """Largest hash of each shard but the last, for the smallest feasible capacity."""
    cells = sorted(cells_of(rows, FIRST_BITS))
    while cells:
        prefix = [0, *accumulate(c[3] for c in cells)]
        single = [c[4] for c in cells] + [True]
        total, largest = prefix[-1], max((c[3] for c in cells if c[4]), default=0)
        low = smallest(prefix, single, shards, True, max(largest, -(-total // shards)), total)
        high = smallest(prefix, [True] * len(single), shards, False, low, total)
        if low == high:
            ends = greedy(prefix, [True] * len(single), high, shards, False)
            at = {p: i for i, p in reversed(list(enumerate(prefix)))}
            return [cells[at[end] - 1][1] for end in ends[:-1] if end]
        # Every cut lies between where it falls at the lower capacity, cells taken whole, and at the upper one, cells taken as divisible.
        doubtful: set[int] = set()
        first = last = 0
        for _ in range(shards - 1):
            i = min(bisect_right(prefix, first + low) - 1, len(cells) - 1)
            first = prefix[i]
            last = min(last + high, total)
            j = min(bisect_right(prefix, last) - 1, len(cells) - 1)
            doubtful.update(k for k in range(i, j + 1) if not single[k])
        by_bits: dict[int, list[Cell]] = {}
        for k in doubtful:
            by_bits.setdefault(cells[k][2], []).append(cells[k])
        kept = [c for k, c in enumerate(cells) if k not in doubtful]
        cells = sorted([*kept, *(c for bits, parents in by_bits.items() for c in cells_of(rows, min(64, bits + MORE_BITS), parents))])
    return []


def shard_of(group_hash: Column, ends: list[int]) -> Column:
    shard = F.lit(0)
    for end in ends:
        shard = shard + (group_hash > F.lit(end)).cast("int")
    return shard


def assign(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, group_hash, shard and slot, gapless from 0 within the shard, of every row."""
    rows = common.written(sized(df, id_col, text_col), "sharding")
    count = rows.count()
    parts = max(16, -(-count // NUMBERED_ROWS))
    placed = rows.withColumn("shard", shard_of(F.col("group_hash"), cuts(rows, shards))).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    # Numbers within (shard, part) and the rows of the parts before: no shard is numbered by one task.
    sizes = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = sizes.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32"))
    return placed.withColumn("own", own).join(before, ["shard", "part"]).select("doc_id", "size", "text_crc32", "group_hash", "shard", (F.col("before") + F.col("own") - 1).cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write every column of df as Parquet under path, one folder shard=N each, several files where a shard is large.

    If df has a column shard, the new one is shard_2 (and so on), and so are the folders.
    """
    rows = sized(df, id_col, text_col).select("group_hash", "size")
    name = common.free_names(df, "shard")[0]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df.withColumn(name, shard_of(F.xxhash64(text), cuts(rows, shards))).write.partitionBy(name).parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards under the law `bytes`: sizes near equal."""
    placed = assign(common.table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast(T.IntegerType()).alias("grown_shard"))
