"""Sharding of indivisible groups by best-fit decreasing.

Groups are the rows of one text. A group larger than a grain is packed by itself; smaller ones are first
bundled by a hash into bundles of about a grain. Grains are a fixed part of a shard's capacity, so the
number of things to pack is bounded by shards * grains whatever the input, and only their sizes come to
the driver. Sorted by size they enter the tightest bin that holds them, found in a balanced tree.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planframe.llm.common import hot_join, numbered, settle


class Tree:
    """A balanced (AA) tree of (room, bin) pairs: insert, remove, and the least pair at or above a bound."""

    class Node:
        __slots__ = ("key", "level", "left", "right")

        def __init__(self, key):
            self.key, self.level, self.left, self.right = key, 1, None, None

    def __init__(self):
        self.root = None

    @staticmethod
    def _skew(n):
        if n and n.left and n.left.level == n.level:
            left = n.left
            n.left, left.right = left.right, n
            return left
        return n

    @staticmethod
    def _split(n):
        if n and n.right and n.right.right and n.level == n.right.right.level:
            right = n.right
            n.right, right.left = right.left, n
            right.level += 1
            return right
        return n

    def insert(self, key) -> None:
        def put(n):
            if n is None:
                return Tree.Node(key)
            if key < n.key:
                n.left = put(n.left)
            else:
                n.right = put(n.right)
            return self._split(self._skew(n))

        self.root = put(self.root)

    def remove(self, key) -> None:
        def take(n, key):
            if n is None:
                return None
            if key < n.key:
                n.left = take(n.left, key)
            elif key > n.key:
                n.right = take(n.right, key)
            elif n.left is None:
                return n.right
            else:
                most = n.left
                while most.right:
                    most = most.right
                n.key = most.key
                n.left = take(n.left, most.key)
            low = min(n.left.level if n.left else 0, n.right.level if n.right else 0) + 1
            if low < n.level:
                n.level = low
                if n.right and low < n.right.level:
                    n.right.level = low
            n = self._skew(n)
            n.right = self._skew(n.right)
            if n.right:
                n.right.right = self._skew(n.right.right)
            n = self._split(n)
            n.right = self._split(n.right)
            return n

        self.root = take(self.root, key)

    def at_least(self, bound):
        n, best = self.root, None
        while n:
            if n.key >= bound:
                best, n = n.key, n.left
            else:
                n = n.right
        return best

    def most(self):
        n = self.root
        while n.right:
            n = n.right
        return n.key


def best_fit_decreasing(sizes: dict, capacity: int, bins: int | None = None) -> dict:
    """item -> bin. With ``bins`` None, a new bin of ``capacity`` opens where no bin has room; an item above it has its own.

    With ``bins`` given, that many bins are there from the start, and an item that fits nowhere enters the emptiest.
    """
    tree, placed, opened = Tree(), {}, bins or 0
    for b in range(opened):
        tree.insert((capacity, -b))
    for item, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        found = tree.at_least((size, float("-inf")))
        if found is None and bins is None:
            found = (max(capacity, size), -opened)
            opened += 1
        else:
            found = found or tree.most()
            tree.remove(found)
        placed[item] = -found[1]
        tree.insert((found[0] - size, found[1]))
    return placed


def near_equal(sizes: dict, shards: int) -> dict:
    """item -> shard: about the least fixed capacity whose best-fit-decreasing packing needs no more than ``shards`` bins.

    An item above an equal part has a bin to itself; the others share the remaining bins evenly.
    """
    left, bins = sum(sizes.values()), shards
    for size in sorted(sizes.values(), reverse=True):
        if bins == 1 or size <= left / bins:
            break
        left, bins = left - size, bins - 1
    low = max(1, -(-left // bins))
    step = max(1, low // 5_000)
    high, best = low + step, None
    while best is None:
        placed = best_fit_decreasing(sizes, high)
        if len(set(placed.values())) <= shards:
            best = placed
        else:
            low, step = high + 1, 2 * step
            high += step
    for _ in range(4):
        middle = (low + high) // 2
        if middle >= high:
            break
        placed = best_fit_decreasing(sizes, middle)
        if len(set(placed.values())) <= shards:
            best, high = placed, middle
        else:
            low = middle + 1
    return best


def shard(docs: DataFrame, shards: int = 40, grains: int = 1000, overhead: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): every row of ``docs(doc_id, text)`` in a shard of near equal bytes.

    ``size`` is the UTF-8 bytes of the text (null: none) plus ``overhead``. Rows of one text (null counts
    as empty) stay together, so a group larger than a shard's part has a shard to itself and the others
    share the rest. Slots run from 0 in each shard, without gaps. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.md5(text.cast("binary")).alias("_group"),
    )
    rows = settle(rows, "sizes")
    groups = rows.groupBy("_group").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("_n"))
    count, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    grain = max(1, total // (shards * grains))
    bundles = max(1, shards * grains)
    own = F.col("bytes") >= grain
    # Bundles follow the groups' hash; a group of a grain or more is an item by itself.
    item = F.when(own, F.col("_group")).otherwise(F.concat(F.lit("b"), F.pmod(F.conv(F.substring("_group", 1, 12), 16, 10).cast("long"), F.lit(bundles))))
    groups = settle(groups.withColumn("_item", item), "groups")
    sizes = {r[0]: r[1] for r in groups.groupBy("_item").agg(F.sum("bytes").alias("bytes")).toArrow().to_pandas().itertuples(index=False)}
    placed = near_equal(sizes, shards)
    spark = docs.sparkSession
    # At most 2 * shards * grains rows.
    plan = F.broadcast(spark.createDataFrame([(k, int(v)) for k, v in placed.items()], "_item string, shard int"))
    dealt = groups.join(plan, "_item").select("_group", "shard", "_n")
    out = hot_join(rows, dealt, ["_group"], "_n", count).select("doc_id", "size", "text_crc32", "shard")
    salts = max(1, min(100_000, count // 2_000 + 1))
    return numbered(out, ["shard"], [F.col("doc_id"), F.col("text_crc32")], salts, "slot")
