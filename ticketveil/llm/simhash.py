"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spaced_words, stored, utf8
from .components import connected_components

#: Members of a bucket that are compared with each other at once; larger buckets are dealt anew.
BUCKET = 4096
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """A bit is 1 if set in over half the XXH64 of the word shingles, repeats included. With fewer
    words than a shingle the whole sequence is the one shingle; without words it is zero."""
    tokens = spaced_words(text)
    if not tokens:
        return 0
    joined, hashed = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= shingle:
        return hashed(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: 1 - shingle].tolist()
    n = len(starts)
    hashes = np.fromiter(
        (hashed(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())), np.uint64, n
    )
    octets = hashes.view(np.uint8).reshape(-1, 8)
    counts = [np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)]
    return int(np.packbits(2 * np.concatenate(counts) > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, fp)``: one row per row; null text counts as empty. ``fp`` has the bits as a long."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id).alias("id"), utf8(text).alias("t")).mapInArrow(run, f"id {kind}, fp long")
    return rows.withColumnRenamed("id", id)


def masks(radius: int, level: int) -> list[int]:
    """Covering bit masks: each bit has a non-zero vector of ``radius + 1`` bits, and mask v keeps the
    bits whose vector has an odd product with v. Up to ``radius`` differing bits have vectors that
    some non-zero v is orthogonal to, so that v's mask leaves out all of them."""
    n = (1 << radius + 1) - 1
    vectors = np.arange(64) % n + 1
    if level:
        np.random.default_rng(level).shuffle(vectors)
    return [sum(1 << i for i, m in enumerate(vectors) if (int(m) & v).bit_count() & 1) for v in range(1, n + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _forest(pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those pairs that join two trees."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            parent[x] = y
            kept.append((a, b))
    return kept


def bucket_links(runs: np.ndarray, fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within equal ``runs`` (sorted), as positions."""
    found, step, n = [], 1, len(fps)
    alive = np.arange(n - 1) if n else np.arange(0)
    while len(alive):
        alive = alive[alive + step < n]
        alive = alive[runs[alive] == runs[alive + step]]
        near = alive[np.bitwise_count(fps[alive] ^ fps[alive + step]) <= radius]
        found += _forest(zip(near.tolist(), (near + step).tolist()))
        step += 1
    return _forest(iter(found))


def links(fps: DataFrame, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints ``fps (fp)``, enough to connect all that lie
    within ``radius`` bits of each other.

    Every mask is a table; fingerprints that agree on it share a bucket. A bucket is read as a
    sorted stream; if it has more members than ``bucket``, all of them are dealt anew by finer masks (the
    mask and each mask of another covering family, which together still cover the radius),
    until the buckets fit. So no bucket is cut and memory is bounded.
    """
    rows, level, parts = fps.select("fp", F.lit(0).cast("long").alias("mask")), 0, []
    shuffles = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        family = F.array(*(F.lit(_signed(m)) for m in masks(radius, level)))
        dealt = (
            rows.select("fp", F.explode(F.transform(family, lambda m: m.bitwiseOR(F.col("mask")))).alias("mask"))
            .select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
            .distinct()
            if level
            else rows.select("fp", F.explode(family).alias("mask")).withColumn(
                "key", F.col("fp").bitwiseAND(F.col("mask"))
            )
        )
        sorted_ = dealt.repartition(shuffles, "mask", "key").sortWithinPartitions("mask", "key")
        found = stored(sorted_.mapInArrow(_compare(radius, bucket), "kind int, a long, b long"))
        parts.append(found.filter("kind = 0").select("a", "b"))
        rows = found.filter("kind = 1").select(F.col("a").alias("fp"), F.col("b").alias("mask"))
        if rows.isEmpty():
            break
        level += 1
    edges = parts[0]
    for part in parts[1:]:
        edges = edges.unionAll(part)
    return edges


def _compare(radius: int, bucket: int):
    def out(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], names=["kind", "a", "b"]
        )

    def whole(fp: np.ndarray, mask: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole buckets, in order."""
        new = np.ones(len(fp), bool)
        new[1:] = (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])
        runs = np.cumsum(new)
        large = np.bincount(runs)[runs] > bucket
        if large.any():
            yield out(1, fp[large], mask[large])
        runs, fp = runs[~large], fp[~large]
        if pairs := bucket_links(runs, fp.view(np.uint64), radius):
            a, b = np.array(pairs).T
            yield out(0, fp[a], fp[b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((3, 0), np.int64)
        over = None  # the bucket whose rows pass on as they come
        for batch in batches:
            new = np.array([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if over is not None:
                same = (new[1] == over[0]) & (new[2] == over[1])
                if same.any():
                    yield out(1, new[0, same], new[1, same])
                    new = new[:, ~same]
                if new.shape[1]:
                    over = None
            held = np.concatenate((held, new), axis=1)
            if not held.shape[1]:
                continue
            last = (held[1] == held[1, -1]) & (held[2] == held[2, -1])
            if not last.all():
                yield from whole(*held[:, ~last])
                held = held[:, last]
            if held.shape[1] > bucket:
                yield out(1, held[0], held[1])
                over, held = (held[1, 0], held[2, 0]), held[:, :0]
        if held.shape[1]:
            yield from whole(*held)

    return run


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = 3) -> DataFrame:
    """``(id, fingerprint, component_id)``, one row per row of ``docs``.

    Fingerprints within ``radius`` bits are linked; ``component_id`` is the least id reachable over
    links. Equal fingerprints are one class from the start, so only distinct ones are compared.
    Null and empty texts have fingerprint zero and are linked like any other. Rows that repeat an
    id keep their rows; a null id takes no part in the least id. Other columns are not read.
    """
    prints = stored(fingerprints(docs, id, text))
    classes = stored(prints.groupBy("fp").agg(F.min(id).alias("rep")))
    parts = connected_components(links(classes, radius))
    lowest = stored(
        parts.join(classes, parts.node == classes.fp).groupBy("component").agg(F.min("rep").alias("low"))
    )
    linked = parts.join(lowest, "component").select(F.col("node").alias("fp"), "low")
    ids = stored(
        classes.join(linked, "fp", "left").select("fp", F.coalesce("low", "rep").alias("component_id"))
    )
    return prints.join(ids, "fp").select(
        id, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = 3) -> DataFrame:
    """One row of ``docs`` for each group, of the least id in it; rows without an id stay.

    An id may stand at several texts, and a text several times at one id: rows are known by id and a 128-bit
    hash of the text, and of equal ones any stays.
    """
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    parts = [F.col("id"), F.xxhash64("t"), F.xxhash64(F.lit(1), "t")]
    named = F.struct(*(c.alias(n) for c, n in zip(parts, "irs")))
    keyed = rows.select(F.when(F.col("id").isNotNull(), named).alias("k"), "t")
    found = stored(near_duplicates(keyed, "k", "t", radius).filter("k is not null").groupBy("k", "component_id").count())
    least = F.col("k") == F.col("component_id")
    several = found.filter(least & (F.col("count") > 1)).select("k.*")
    gone = found.filter(~least | (F.col("count") > 1)).select("k.*")

    free = "k" * (1 + max(map(len, docs.columns)))  # no column has this name
    names = [f"{free}{n}" for n in "irs"]
    content = F.coalesce(F.col(text), F.lit(""))
    marked = docs.withColumns(dict(zip(names, [F.col(id), F.xxhash64(content), F.xxhash64(F.lit(1), content)])))
    stay = marked.join(gone.toDF(*names), names, "left_anti")
    if several.isEmpty():
        return stay.select(*docs.columns)
    again = marked.join(several.toDF(*names), names, "left_semi").dropDuplicates(names)
    return stay.unionByName(again).select(*docs.columns)
