"""Shards of near equal size by best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

#: Bundles of small groups per shard; with that many again of large groups they bound what the driver packs.
BUNDLES = 256
#: Parts that the rows of a shard are numbered in.
PARTS = 512


class CapacityTree:
    """Bins in a balanced search tree (a treap) by remaining capacity and number."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _weight(bin: int) -> int:
        return (bin + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def _split(self, node, key):
        """Nodes below ``key``, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], rest = self._split(node[3], key)
            return node, rest
        rest, node[2] = self._split(node[2], key)
        return rest, node

    def add(self, room: int, bin: int) -> None:
        low, high = self._split(self.root, (room, bin))
        self.root = self._merge(self._merge(low, [(room, bin), self._weight(bin), None, None]), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Removes the bin with the least room that holds ``size``."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        node = high
        while node[2] is not None:
            node = node[2]
        key = node[0]
        _, rest = self._split(high, (key[0], key[1] + 1))
        self.root = self._merge(low, rest)
        return key


def best_fit_decreasing(sizes: list[int], capacity: int, bins: int) -> list[int] | None:
    """The bin of each size (in decreasing order), or None if they need more than ``bins``. A new bin is
    opened only if no open one has room, so that as few as possible are used."""
    tree, opened, placed = CapacityTree(), 0, []
    for size in sizes:
        found = tree.take_tightest(size)
        if found is None:
            if opened == bins or size > capacity:
                return None
            found, opened = (capacity, opened), opened + 1
        tree.add(found[0] - size, found[1])
        placed.append(found[1])
    return placed


def pack(sizes: list[int], bins: int) -> list[int]:
    """The bin of each size (in decreasing order), at the least capacity that ``bins`` bins of best fit
    need, to one part in 20,000. A size that alone exceeds a fair share of what is left has a bin of its own."""
    left, alone = sum(sizes), 0
    while alone < min(bins - 1, len(sizes)) and sizes[alone] * (bins - alone) >= left:
        left -= sizes[alone]
        alone += 1
    rest, n = sizes[alone:], bins - alone
    low = max(-(-left // n), rest[0] if rest else 0)
    high = low
    while (found := best_fit_decreasing(rest, high, n)) is None:
        low, high = high + 1, high + max(1, high // 64)
    while high - low > low // 20_000:
        middle = (low + high) // 2
        if (better := best_fit_decreasing(rest, middle, n)) is None:
            low = middle + 1
        else:
            high, found = middle, better
    return [*range(alone), *(alone + b for b in found)]


def assign_shards(
    docs: DataFrame, shards: int = 24, id: str = "doc_id", text: str = "text", overhead: int = 8,
    bundles: int = BUNDLES, parts: int = PARTS,
) -> DataFrame:
    """``(id, size, text_crc32, shard, slot)``, one row per row of ``docs``.

    The law is ``bytes``: a row has the UTF-8 bytes of its text plus ``overhead``, and shards are near equal
    in bytes. Rows of equal text are a group and stay together; a null text has no bytes and goes
    with the empty ones. ``slot`` counts each shard's rows from 0 without gaps. Equal ids and repeated rows
    are rows like others; an empty table gives no rows.

    Groups of less than a ``bundles``-th of a fair share are first bundled by a hash of their text, into
    ``bundles`` for each shard, so the driver packs at most twice ``bundles * shards`` sizes,
    however many groups there are. Groups are known by 64 bits of hash; two that share them stay
    together too. A shard's rows are numbered in ``parts`` parts by a hash of the id, each from
    the sum of those before, so that no task has the rows of a whole shard.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    rows = stored(
        docs.select(
            F.col(id).alias("id"),
            (F.octet_length(content).cast("long") + overhead).alias("size"),
            F.crc32(content.cast("binary")).alias("text_crc32"),
            F.xxhash64(content).alias("text"),
        )
    )
    groups = stored(rows.groupBy("text").agg(F.sum("size").alias("bytes")))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    count = bundles * shards
    least = max(1, total // count)
    large = groups.filter(F.col("bytes") >= least)  # at most ``count`` of them
    bundle = F.pmod(F.xxhash64("text", F.lit("bundle")), F.lit(count))
    small = groups.filter(F.col("bytes") < least).groupBy(bundle.alias("key")).agg(F.sum("bytes").alias("bytes"))
    items = [(r.bytes, 1, r.text) for r in large.collect()] + [(r.bytes, 0, r.key) for r in small.collect()]
    items.sort(key=lambda x: (-x[0], x[1], x[2]))
    placed = pack([x[0] for x in items], shards) if items else []
    spark = docs.sparkSession
    plan = spark.createDataFrame(
        [(bool(kind), key, shard) for (_, kind, key), shard in zip(items, placed)], "large boolean, key long, shard int"
    )
    own = plan.filter("large").select(F.col("key").alias("text"), F.col("shard").alias("own"))
    shared = plan.filter("not large").select(F.col("key").alias("bundle"), F.col("shard").alias("shared"))
    dealt = (
        rows.withColumn("bundle", bundle)
        .join(F.broadcast(own), "text", "left")
        .join(F.broadcast(shared), "bundle", "left")
        .select("id", "size", "text_crc32", F.coalesce("own", "shared").alias("shard"))
    )
    return _numbered(dealt, parts).withColumnRenamed("id", id)


def _numbered(rows: DataFrame, parts: int) -> DataFrame:
    """Adds ``slot``. A row's part depends on its values only; equal rows may swap slots."""
    rows = stored(rows.withColumn("part", F.pmod(F.xxhash64("id", "size", "text_crc32"), F.lit(parts)).cast("int")))
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "part").orderBy("id", "text_crc32", "size")
    return (
        rows.withColumn("at", F.row_number().over(within) - 1)
        .join(F.broadcast(starts), ["shard", "part"])  # at most shards * parts rows
        .select("id", "size", "text_crc32", "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"))
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, id: str = "doc_id", text: str = "text") -> None:
    """Writes ``docs`` with their shard and slot, a folder per shard. Ids have to be unique here, as a row finds
    its shard by its id; one row may be without. Columns named ``shard`` and ``slot`` are replaced."""
    placed = assign_shards(docs, shards, id, text).select(F.col(id).alias("__placed"), "shard", "slot")
    plain = docs.drop("shard", "slot")
    joined = plain.join(placed, F.col(id).eqNullSafe(F.col("__placed"))).drop("__placed")
    joined.write.partitionBy("shard").parquet(path)
