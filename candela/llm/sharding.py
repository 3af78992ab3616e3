"""Sharding: indivisible groups into a fixed number of shards of equal capacity, by best-fit decreasing.

Two levels keep the work distributed. Every task packs the groups it holds, largest first, into *bricks* of a small
capacity: a group enters the brick with the tightest sufficient rest, found in a balanced tree. The bricks - at most
``2 * shards * BRICKS + tasks`` whatever the input, because any two bricks of a task together exceed one capacity - are
packed into the shards by the same rule on the driver; the shard capacity is the smallest at which they fit.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candela.llm.common import stored

#: Bricks a shard; with them the sizes of shards differ by about 1 / BRICKS of a shard, or by the largest group.
BRICKS = 512


class RestTree:
    """Balanced (AA) tree of (rest, bin): insert, and take out the bin with the smallest rest of at least a size."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None  # node: [key, level, left, right]

    @staticmethod
    def _skew(t):
        if t and t[2] and t[2][1] == t[1]:
            left = t[2]
            t[2], left[3] = left[3], t
            return left
        return t

    @staticmethod
    def _split(t):
        if t and t[3] and t[3][3] and t[3][3][1] == t[1]:
            right = t[3]
            t[3], right[2] = right[2], t
            right[1] += 1
            return right
        return t

    def insert(self, key):
        def put(t):
            if t is None:
                return [key, 1, None, None]
            side = 2 if key < t[0] else 3
            t[side] = put(t[side])
            return self._split(self._skew(t))

        self.root = put(self.root)

    def tightest(self, size):
        """The smallest key whose rest is at least ``size``, or None."""
        best, t = None, self.root
        while t:
            if t[0][0] >= size:
                best, t = t[0], t[2]
            else:
                t = t[3]
        return best

    def remove(self, key):
        def cut(t, key):
            if t is None:
                return None
            if key < t[0]:
                t[2] = cut(t[2], key)
            elif t[0] < key:
                t[3] = cut(t[3], key)
            elif t[2] is None:
                return t[3]
            elif t[3] is None:
                return t[2]
            else:
                s = t[3]
                while s[2]:
                    s = s[2]
                t[0] = s[0]
                t[3] = cut(t[3], s[0])
            low = min(t[2][1] if t[2] else 0, t[3][1] if t[3] else 0) + 1
            if low < t[1]:
                t[1] = low
                if t[3] and t[3][1] > low:
                    t[3][1] = low
            t = self._skew(t)
            t[3] = self._skew(t[3])
            if t[3]:
                t[3][3] = self._skew(t[3][3])
            t = self._split(t)
            t[3] = self._split(t[3])
            return t

        self.root = cut(self.root, key)


class BestFit:
    """Bins of one capacity. Sizes come in falling order; one beyond the capacity gets a bin of its own."""

    def __init__(self, capacity: int):
        self.capacity, self.bins, self.tree = capacity, 0, RestTree()

    def place(self, size: int) -> int:
        found = self.tree.tightest(size)
        if found:
            self.tree.remove(found)
            rest, b = found
        else:
            rest, b = self.capacity, self.bins
            self.bins += 1
        if rest > size:
            self.tree.insert((rest - size, b))
        return b


def spread(sizes: list[int], shards: int) -> list[int]:
    """The shard of each size: best fit decreasing at the smallest capacity, found by bisection, that needs no more shards."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))

    def pack(capacity):
        fit = BestFit(capacity)
        at = [fit.place(sizes[i]) for i in order]
        return at if fit.bins <= shards else None

    total = sum(sizes)
    low, high = max(math.ceil(total / shards), max(sizes, default=0)), total
    best = [0] * len(order)
    step = max(1, (low // 4096))
    while low <= high:  # gallop from the lower bound, then bisect
        got = pack(low + step)
        if got is not None:
            best, high = got, low + step
            break
        low, step = low + step + 1, step * 2
    while low < high:
        mid = (low + high) // 2
        if (got := pack(mid)) is not None:
            best, high = got, mid
        else:
            low = mid + 1
    out = [0] * len(sizes)
    for i, b in zip(order, best, strict=True):
        out[i] = b
    return out


def shard(docs: DataFrame, shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text", bricks: int = BRICKS) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1), text_crc32, shard, slot (gapless from 0 in its shard): equal texts stay together
    and shard sizes are near equal in bytes.

    Null texts count 1 byte and form one group, apart from empty texts; null and repeated ids keep a row each; an empty
    table gives no rows; very long texts are groups like others. Only the id and the text are read, so other columns may have
    any name.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"), F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"null")).alias("key"))
    total = docs.select((F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size")).agg(F.sum("size")).first()[0] or 0
    capacity = max(1, total // (shards * bricks))

    def lay(batches):
        from pyspark import TaskContext

        fit, base = BestFit(capacity), TaskContext.get().partitionId() << 32
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([base + fit.place(s) for s in b.column(1).to_pylist()], pa.int64())], names=["key", "bytes", "brick"])

    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes")).sortWithinPartitions(F.desc("bytes"), "key")
    laid = stored(groups.mapInArrow(lay, "key binary, bytes long, brick long"), "bricks")
    sums = laid.groupBy("brick").agg(F.sum("bytes").alias("bytes")).collect()
    sums.sort(key=lambda r: r["brick"])
    placed = docs.sparkSession.createDataFrame(list(zip([r["brick"] for r in sums], spread([r["bytes"] for r in sums], shards), strict=True)), "brick long, shard int")
    where = laid.join(F.broadcast(placed), "brick").select("key", "shard")  # bounded: see the module's first lines
    return numbered(stored(rows.join(where, "key").drop("key").withColumn("place", F.monotonically_increasing_id()), "shards"))


def numbered(rows: DataFrame) -> DataFrame:
    """Adds slot, gapless from 0 in each shard: row numbers in hashed blocks of a shard, plus the rows of earlier blocks. Blocks
    are hashed from ``place``, which no two rows share, so repeated rows spread too."""
    blocks = max(64, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("place"), F.lit(blocks)).cast("int"))
    counts = rows.groupBy("shard", "block").count()
    base = counts.select("shard", "block", (F.sum("count").over(Window.partitionBy("shard").orderBy("block")) - F.col("count")).alias("base"))  # shards x blocks rows
    inner = F.row_number().over(Window.partitionBy("shard", "block").orderBy("place"))
    return rows.withColumn("inner", inner).join(F.broadcast(base), ["shard", "block"]).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("inner") - 1).alias("slot"))
