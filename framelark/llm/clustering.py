"""Centroid clustering of whole-number vectors by scalar lookup tables.

Components become integers. Vectors lie in blocks of about BLOCK rows, coded once: for each dimension the integers that
occur in the block, sorted, and each vector's place among them. A round tabulates, for each dimension, occurring integer
and centroid, the squared difference; a vector's distances are gathers from these tables and their sum. Tasks then give
one row a cluster with the sums of its vectors, and Spark adds those up, so that 64 sums a centroid reach the driver,
whatever the number of vectors. All arithmetic is exact: 64-bit where the block's spread allows it, else Python's integers.

Defined cases: vectors that are null, of another length, or hold null, NaN or infinity take no part; vectors without an
id do, and are the last that can start a centroid; repeated rows count each; equal hashes start in the order of their
components; with fewer vectors than centroids there are as many centroids as vectors; an empty table gives an empty
table; extra columns are ignored. A component or distance beyond 64 bits makes the run fail.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import durable, table

#: Components of a vector; centroids; rounds; factor of the components; vectors of a block.
DIM, K, ROUNDS, SCALE, BLOCK = 64, 8, 10, 1024, 1 << 14
BLOCK_SCHEMA = "ids binary, no_id binary, codes binary, sizes binary, values binary"


def whole(x: Column) -> Column:
    fits = (x >= -float(1 << 63)) & (x < float(1 << 63))
    return F.when(fits, F.floor(x)).otherwise(F.raise_error(F.lit("a component exceeds 64 bits")).cast("long"))


def whole_vectors(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, vec): floor(scale * x) of each component, of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: whole(x * scale)).alias("vec"))


def coded(rows: DataFrame, dim: int = DIM, size: int = BLOCK) -> DataFrame:
    """Blocks of rows (vec_id, vec): ids, places of the components among the block's integers of their dimension, and those."""

    def block(ids: list[pa.Array], parts: list[np.ndarray]) -> pa.RecordBatch:
        names, m = pa.chunked_array(ids).combine_chunks(), np.concatenate(parts)
        values, codes = [], np.empty(m.shape, "<u4")
        for d in range(dim):
            own, place = np.unique(m[:, d], return_inverse=True)
            values.append(own)
            codes[:, d] = place
        columns = (np.asarray(names.fill_null(0)).astype("<i8"), np.asarray(names.is_null()), codes if max(map(len, values)) > 1 << 16 else codes.astype("<u2"), np.array([len(x) for x in values], "<i8"), np.concatenate(values).astype("<i8"))
        return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names=["ids", "no_id", "codes", "sizes", "values"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held = [], [], 0
        for b in batches:
            if b.num_rows:
                ids.append(b.column(0))
                parts.append(np.asarray(b.column(1).flatten()).reshape(-1, dim))
                held += b.num_rows
            if held >= size:
                yield block(ids, parts)
                ids, parts, held = [], [], 0
        if held:
            yield block(ids, parts)

    return rows.mapInArrow(blocks, BLOCK_SCHEMA)


class Block:
    """A coded block."""

    def __init__(self, row: dict, dim: int) -> None:
        self.sizes, self.values = np.frombuffer(row["sizes"], "<i8"), np.frombuffer(row["values"], "<i8")
        n = len(row["no_id"])
        self.codes = np.frombuffer(row["codes"], "<u2" if len(row["codes"]) == 2 * n * dim else "<u4").reshape(n, dim)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.ids = pa.array(np.frombuffer(row["ids"], "<i8"), pa.int64(), mask=np.frombuffer(row["no_id"], bool))

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's centroid (the smaller number of equally near ones) and squared distance to it."""
        dim = len(self.sizes)
        ends = [int(self.values.min()), int(self.values.max()), *map(int, (centroids.min(), centroids.max()))]
        exact = np.int64 if (max(ends) - min(ends)) ** 2 * dim < 1 << 63 else object
        values, c = self.values.astype(exact), centroids.astype(exact)
        dimension = np.repeat(np.arange(dim), self.sizes)
        squares = (values[:, None] - c.T[dimension]) ** 2  # the lookup tables: all dimensions' integers by centroid
        total = np.zeros((len(self.codes), len(c)), exact)
        for d in range(dim):
            total += squares[self.first[d] : self.first[d] + self.sizes[d]][self.codes[:, d]]
        own = total.argmin(1)
        return own, total[np.arange(len(own)), own]

    def sums(self, own: np.ndarray, k: int) -> np.ndarray:
        """(k, dim): the sum of each cluster's vectors, from how often each integer occurs in each cluster."""
        safe = max(-int(self.values.min()), int(self.values.max())) * len(own) < 1 << 63
        values, total = self.values if safe else self.values.astype(object), []
        for d, (first, size) in enumerate(zip(self.first, self.sizes, strict=True)):
            often = np.bincount(own * size + self.codes[:, d], minlength=k * size).reshape(k, size)
            total.append((often * values[first : first + size]).sum(1))
        return np.array(total).T


def gathered(blocks: DataFrame, centroids: np.ndarray) -> list[tuple[int, int, list[int]]]:
    """(vectors, summed distance, summed components) of each cluster, exactly; empty ones have 0 vectors."""
    k, dim = centroids.shape

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((k, dim + 2), object)  # vectors, distance, components
        for b in batches:
            for row in b.to_pylist():
                block = Block(row, dim)
                own, distance = block.nearest(centroids)
                far = [distance[own == c].astype(object).sum() for c in range(k)]
                held += np.column_stack([np.bincount(own, minlength=k).astype(object), far, block.sums(own, k).astype(object)])
        rows = [(c, d, str(x)) for c in range(k) if held[c, 0] for d, x in enumerate(held[c])]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string()))], names=["cluster", "place", "amount"])

    parts = blocks.mapInArrow(part, "cluster int, place int, amount string").groupBy("cluster", "place").agg(F.sum(F.col("amount").cast("decimal(38,0)")).alias("amount"))
    found = {(r.cluster, r.place): int(r.amount) for r in parts.collect()}  # k * (dim + 2) numbers at most
    return [(found.get((c, 0), 0), found.get((c, 1), 0), [found.get((c, d + 2), 0) for d in range(dim)]) for c in range(k)]


def first_centroids(rows: DataFrame, k: int = K, salt: str = "3") -> np.ndarray:
    """The k vectors with the least SHA-256 of `salt:vec_id`."""
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r.vec for r in rows.orderBy(order.asc_nulls_last(), "vec").limit(k).collect()], np.int64)


def cluster(rows: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, block: int = BLOCK) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of rows (vec_id, vec of `dim` whole numbers)."""
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = first_centroids(rows, k)
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], schema)
    blocks = durable(coded(rows, dim, block))
    for _ in range(rounds):
        centroids = np.array([[s // n for s in total] if n else old.tolist() for old, (n, _, total) in zip(centroids, gathered(blocks, centroids), strict=True)], np.int64)
    inertia = [far for _, far, _ in gathered(blocks, centroids)]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                held = Block(row, dim)
                own, distance = held.nearest(centroids)
                columns = [held.ids, pa.array(own.astype(np.int32)), pa.array(distance.tolist(), pa.int64()), pa.array([inertia[c] for c in own], pa.int64()), pa.array([sum(inertia)] * len(own), pa.int64()), pa.array([digests[c] for c in own], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return blocks.mapInArrow(assigned, schema)


def op11_lookup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(whole_vectors(table(spark, sf_dir, "embeddings")))


def _sql() -> str:
    """All rounds as materialised steps. A sum less its positive remainder is divided exactly, which is its floor."""
    near = lambda n: f"""p{n} AS MATERIALIZED (SELECT r, c, sum((q[i] - m[i]) * (q[i] - m[i]))::BIGINT AS d FROM k, c{n}, i GROUP BY r, c),
a{n} AS MATERIALIZED (SELECT r, arg_min(c, d::HUGEINT * {K} + c) AS c, min(d) AS d FROM p{n} GROUP BY r)"""  # noqa: E731
    steps = [f"""k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [floor(x::DOUBLE * {SCALE})::BIGINT FOR x IN embedding] AS q FROM embeddings
WHERE len(embedding) = {DIM} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {DIM}), i AS MATERIALIZED (SELECT unnest(range(1, {DIM + 1})) AS i),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, q) - 1 AS c, q AS m FROM k QUALIFY c < {K})""", near(0)]
    for n in range(1, ROUNDS + 1):
        steps += [f"""s{n} AS MATERIALIZED (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM (SELECT c, i, sum(q[i])::BIGINT AS s, count(*) AS n FROM a{n - 1} JOIN k USING (r), i GROUP BY c, i) GROUP BY c),
c{n} AS MATERIALIZED (SELECT c, coalesce(s.m, o.m) AS m FROM c{n - 1} o LEFT JOIN s{n} s USING (c))""", near(n)]
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN k USING (r) JOIN c{ROUNDS} USING (c)"""


QUERIES = {"op11_lookup_clusters": op11_lookup_clusters}
ORACLE = {"op11_lookup_clusters": _sql()}
