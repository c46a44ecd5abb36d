"""Embedding near-duplicates: inverted lists with product-quantised residuals, and an exact rerank."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import connected_components

#: Vectors that the coarse lists and the codebooks are fitted on, at most; all are indexed.
SAMPLE = 20_000
MAX_LISTS = 4_096
SUBSPACES, CODES = 8, 32
#: Members and queries of a list that meet in one group; larger lists are dealt in tiles.
TILE = 2_048
#: How far a near vector may lie across the plane between two lists, in standard deviations of a difference in a
#: random direction. Up to 16 dimensions that is the whole reach, and no link can be lost.
DEVIATIONS = 4.0
_EPS = 1e-6


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(0)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        nearest = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        n = np.bincount(nearest, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1), 0)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([_squared(x[i : i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)])


@dataclass
class Index:
    """Coarse centres, and a codebook for each subspace of the residuals."""

    centres: np.ndarray
    books: list[np.ndarray]
    cuts: list[tuple[int, int]]
    reach: float  # distance of unit vectors at the threshold
    shapes: list[np.ndarray]  # covariances of trace one that a difference may have
    exact: bool = False  # probe the whole reach

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, and how far the decoded vector is from the vector."""
        lists = _nearest(unit, self.centres)
        rest = unit - self.centres[lists]
        codes = np.empty((len(unit), len(self.cuts)), np.uint8)
        error = np.zeros(len(unit))
        for s, ((a, b), book) in enumerate(zip(self.cuts, self.books)):
            codes[:, s] = _nearest(rest[:, a:b], book)
            error += ((rest[:, a:b] - book[codes[:, s]]) ** 2).sum(1)
        return lists, codes, np.sqrt(error)

    def probes(self, unit: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """Which lists may hold a vector within reach. That one lies on the other side of the plane between two
        centres, so the query is no farther from the plane than the difference goes across it: ``DEVIATIONS``
        times its standard deviation there are searched, or the whole reach if ``exact``."""
        squared = _squared(unit, self.centres)
        nearer = squared - squared[np.arange(len(unit)), lists][:, None]
        apart = _squared(self.centres[lists], self.centres)
        gap = np.sqrt(apart)
        if self.exact:
            return nearer <= 2 * self.reach * gap + _EPS
        # at least that of a random direction; vectors of few effective dimensions have few directions to go
        spread = np.full_like(apart, 1 / unit.shape[1])
        for shape in self.shapes:
            own = ((self.centres @ shape) * self.centres).sum(1)
            across = own[lists][:, None] - 2 * (self.centres[lists] @ shape) @ self.centres.T + own
            spread = np.maximum(spread, np.divide(across, apart, out=np.zeros_like(apart), where=apart > _EPS))
        margin = self.reach * np.minimum(1.0, DEVIATIONS * np.sqrt(spread))
        return nearer <= 2 * margin * gap + _EPS

    def approximate(self, queries: np.ndarray, of: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances from queries to the coded members of a list: a table of squared distances to
        the codes for each query and subspace, looked up by the members' codes."""
        rest = queries - self.centres[of]
        total = np.zeros((len(queries), len(codes)))
        for s, ((a, b), book) in enumerate(zip(self.cuts, self.books)):
            total += _squared(rest[:, a:b], book)[:, codes[:, s]]
        return np.sqrt(total)


def _shapes(*tables: np.ndarray) -> list[np.ndarray]:
    found = [x.T @ x for x in (t - t.mean(0) for t in tables)]
    return [c / np.trace(c) for c in found if np.trace(c) > _EPS]


def train(sample: np.ndarray, count: int, threshold: float, exact: bool = False) -> Index:
    """An index of as many lists as the square root of the ``count`` of vectors, up to ``MAX_LISTS``."""
    lists = max(1, min(MAX_LISTS, round(math.sqrt(count)), len(sample)))
    centres = _kmeans(sample, lists)
    rest = sample - centres[_nearest(sample, centres)]
    bounds = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int).tolist()
    cuts = list(zip(bounds, bounds[1:]))
    books = [_kmeans(rest[:, a:b], CODES) for a, b in cuts]
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    return Index(centres, books, cuts, reach, _shapes(sample, rest), exact)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _unit(raw: np.ndarray) -> np.ndarray:
    scaled = raw / np.abs(raw).max(1, keepdims=True)  # neither overflow nor underflow of the squares
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _forest(linked: np.ndarray, queries: np.ndarray, members: np.ndarray) -> list[tuple]:
    """Links from the least id of each connected part of a tile to its other ids."""
    edges, left = [], linked.any(1)
    while left.any():
        q = np.zeros(len(queries), bool)
        q[np.flatnonzero(left)[0]] = True
        while True:
            m = linked[q].any(0)
            grown = linked[:, m].any(1)
            if (grown == q).all():
                break
            q = grown
        left &= ~q
        ids = np.unique(np.concatenate((queries[q], members[m])))
        edges += [(i, ids[0]) for i in ids[1:]]
    return edges


def _index_rows(index) -> object:
    """A member row for each vector in its list, and a query row in each list that it probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                unit = _unit(_matrix(part.column(2)))
                lists, codes, error = index.value.encode(unit)
                who, where = np.nonzero(index.value.probes(unit, lists))
                n = len(unit)
                rows = np.concatenate((np.arange(n), who))
                query = np.arange(len(rows)) >= n
                empty = [b""] * len(who)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate((lists, where)).astype(np.int32)),
                        pa.array(query),
                        part.column(0).take(pa.array(rows)),
                        part.column(1).take(pa.array(rows)),
                        part.column(2).take(pa.array(rows)),
                        pa.array([c.tobytes() for c in codes] + empty, pa.binary()),
                        pa.array(np.concatenate((error, np.zeros(len(who))))),
                    ],
                    names=["list", "query", "id", "m", "v", "code", "error"],
                )

    return run


def _compare(index, threshold: float):
    """Streams tiles, members before queries; gives links of each query and a forest of the links."""

    def out(kind: int, a: list, b: list) -> pa.RecordBatch:
        columns = [pa.array([kind] * len(a), pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["kind", "a", "b"])

    def tile(of: int, members: list[pa.RecordBatch], queries: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        book: Index = index.value
        ids = np.concatenate([b.column("id").to_numpy() for b in members])
        weight = np.concatenate([b.column("m").to_numpy() for b in members])
        vectors = _unit(np.concatenate([_matrix(b.column("v")) for b in members]))
        error = np.concatenate([b.column("error").to_numpy() for b in members])
        codes = np.frombuffer(b"".join(x for b in members for x in b.column("code").to_pylist()), np.uint8)
        codes = codes.reshape(len(ids), -1)
        for at in range(0, queries.num_rows, 512):
            part = queries.slice(at, 512)
            own, asked = part.column("id").to_numpy(), _unit(_matrix(part.column("v")))
            near = book.approximate(asked, of, codes) <= book.reach + error + _EPS
            near &= own[:, None] != ids
            q, m = near.any(1), near.any(0)
            if not q.any():
                continue
            linked = near[np.ix_(q, m)] & (asked[q] @ vectors[m].T >= threshold)
            found = linked @ weight[m]
            yield out(0, own[q][found > 0].tolist(), found[found > 0].tolist())
            if pairs := _forest(linked, own[q], ids[m]):
                a, b = zip(*pairs)
                yield out(1, list(a), list(b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, []
        for batch in batches:
            keys = np.array([batch.column(i).to_numpy() for i in range(3)] + [batch.column(3).to_numpy(zero_copy_only=False)])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if a == b:
                    continue
                part, now = batch.slice(a, b - a), tuple(keys[:3, a].tolist())
                if now != key:
                    key, members = now, []
                if not keys[3, a]:
                    members.append(part)
                elif members:
                    yield from tile(int(now[0]), members, part)

    return run


def _links(classes: DataFrame, threshold: float, exact: bool) -> DataFrame:
    """``(kind, a, b)``: for kind 0 the links ``b`` that a query found for class ``a`` in one tile, for kind 1 a
    link. ``classes (id, m, v)`` are distinct vectors of one length; ``m`` rows have each."""
    spark, count = classes.sparkSession, classes.count()
    picked = classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
    index = train(_unit(_matrix(picked.column(0).combine_chunks())), count, threshold, exact)
    shared = spark.sparkContext.broadcast(index)
    vector = classes.schema["v"].dataType.simpleString()
    schema = f"list int, query boolean, id long, m long, v {vector}, code binary, error double"
    rows = stored(classes.select("id", "m", "v").mapInArrow(_index_rows(shared), schema))
    # at most MAX_LISTS rows
    sizes = stored(
        rows.groupBy("list").agg(
            F.ceil(F.sum((~F.col("query")).cast("int")) / TILE).cast("int").alias("mts"),
            F.ceil(F.sum(F.col("query").cast("int")) / TILE).cast("int").alias("qts"),
        )
    )
    own = F.col("query")
    tiled = (
        rows.join(F.broadcast(sizes), "list")
        .filter("mts > 0 and qts > 0")
        .withColumn("h", F.xxhash64("id"))
        .withColumn("mine", F.pmod("h", F.when(own, F.col("qts")).otherwise(F.col("mts"))).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(own, F.col("mts")).otherwise(F.col("qts")) - 1)))
        .select(
            "list",
            F.when(own, F.col("other")).otherwise(F.col("mine")).alias("mt"),
            F.when(own, F.col("mine")).otherwise(F.col("other")).alias("qt"),
            *("query", "id", "m", "v", "code", "error"),
        )
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = tiled.repartition(parts, "list", "mt", "qt").sortWithinPartitions("list", "mt", "qt", "query")
    return stored(sorted_.mapInArrow(_compare(shared, threshold), "kind int, a long, b long"))


def near_duplicates(
    vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.95, exact: bool = False
) -> DataFrame:
    """``(id, n_links, component_id, kept)`` per row of ``vectors``; the id is a whole number.

    Rows whose cosine in double precision is at least ``threshold`` are linked. ``n_links`` counts the other rows
    linked directly, ``component_id`` is the least id reachable, ``kept`` says whether it is the row's.
    Null, empty and zero vectors, and those with null or non-finite components, link with nothing, nor
    do vectors of different length. Equal vectors are one class, compared once, whatever their
    number. The bound on coded distances loses no link; the probes lose none up to 16 dimensions, and
    beyond that only one whose difference lies ``DEVIATIONS`` standard deviations across a plane. With ``exact`` they lose
    none at any dimension, and visit more lists: many times as many at 64 dimensions.
    """
    v, kind = F.col(embedding), vectors.schema[id].dataType
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = fine & F.exists(v, lambda x: x != 0)
    rows = stored(
        vectors.select(
            F.col(id).cast("long").alias("id"),
            F.coalesce(fine, F.lit(False)).alias("fine"),
            F.xxhash64(v).alias("h"),
            F.xxhash64(F.lit(1), v).alias("g"),
            v.alias("v"),
        )
    )
    classes = stored(
        rows.filter("fine and id is not null")
        .groupBy("h", "g")
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("m"), F.first("v").alias("v"))
    )
    lengths = [r.n for r in classes.select(F.size("v").alias("n")).distinct().collect()]
    found = None
    for n in sorted(lengths):
        part = _links(classes.filter(F.size("v") == n), threshold, exact)
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = rows.sparkSession.createDataFrame([], "kind int, a long, b long")
    parts = connected_components(found.filter("kind = 1").select("a", "b"))
    links = found.filter("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("n"))
    results = stored(
        classes.select("h", "g", "id", "m")
        .join(links, "id", "left")
        .join(parts.select(F.col("node").alias("id"), "component"), "id", "left")
        .select(
            "h", "g", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("component", "id").alias("c"),
            F.lit(True).alias("fine"),
        )
    )
    component = F.coalesce("c", "id").cast(kind)
    return rows.select("id", "h", "g", "fine").join(results, ["h", "g", "fine"], "left").select(
        F.col("id").cast(kind).alias(id),
        F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("c", "id"), F.lit(True)).alias("kept"),
    )
