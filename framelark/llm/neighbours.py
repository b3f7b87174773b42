"""Approximate nearest neighbours by an inverted multi-index.

Both halves of the vectors are quantised on their own; a row's cell is its pair of centroids. A query walks the pairs
by falling sum of both halves' inner products with a heap until the cells seen hold a share of all distinct vectors, and
those cells' vectors are reranked by the true inner product. The share is measured: vectors of the sample are searched
for among all distinct vectors, exactly and through the cells, and the least share that finds RECALL of their neighbours
is taken. Equal vectors are one entry with its smallest ids, so a very common vector weighs no more than a rare one.
Cells are as many as give about CELL vectors each. Cells are dealt to blocks of `BLOCK` to 8 * BLOCK entries; a larger
cell is split. Centroids are fitted on `SAMPLE` distinct vectors; every vector is indexed.

A query goes to the blocks of its cells with one number, the sum of the last cell that its walk took: the cells taken are
those with no lower sum. A task holds the entries of one block at a time, and queries stream by them in Arrow batches, so
its memory does not depend on how many queries there are.

Defined cases: vectors that are null, zero, of another length than most of the sample, or hold null, NaN or infinity
take no part, nor do rows without an id; ties go to the smaller id; fewer rows than asked give all of them; an empty
table gives an empty table; extra columns are ignored.
"""
from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import durable, table

#: Distinct vectors that the centroids and the share are fitted on; vectors of a cell, about; centroids of a half, at most;
#: entries of a block; queries that a task walks.
SAMPLE, CELL, CENTROIDS, BLOCK, WALKS = 20_000, 16, 512, 16_384, 256
#: Part of the sample's neighbours that the share must find; vectors of the sample that are searched for.
RECALL, PROBES = 0.96, 256


def fit_half(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k-means centroids, started from evenly spaced rows."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)


@dataclass
class MultiIndex:
    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray | None = None
    block: np.ndarray | None = None
    parts: np.ndarray | None = None
    held: list[int] | None = None

    def sums(self, q: np.ndarray) -> np.ndarray:
        """Each cell's summed nearness, in the order of its number."""
        h = self.first.shape[1]
        return ((self.first @ q[:h])[:, None] + (self.second @ q[h:])[None]).ravel()

    def cells(self, x: np.ndarray) -> np.ndarray:
        h = self.first.shape[1]
        return nearest(x[:, :h], self.first) * len(self.second) + nearest(x[:, h:], self.second)

    def plan(self, counts: np.ndarray, size: int = BLOCK) -> None:
        """Blocks of neighbouring cells; a cell above `size` gets blocks of its own."""
        self.counts, self.parts, self.held = counts, np.maximum(1, -(-counts // size)), counts.tolist()
        self.block, at, held = np.zeros(len(counts), np.int64), 0, 0
        for k, n in enumerate(counts.tolist()):
            if self.parts[k] > 1 or held + n > size:
                at, held = at + (held > 0), 0
            self.block[k] = at
            if self.parts[k] > 1:
                at, held = at + int(self.parts[k]), 0
            else:
                held += n

    def walk(self, q: np.ndarray, wanted: int) -> list[int]:
        """Cells by falling summed nearness, until they hold `wanted` entries."""
        h = self.first.shape[1]
        a, b = self.first @ q[:h], self.second @ q[h:]
        i, j = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist()
        sa, sb = a[i].tolist(), b[j].tolist()
        width, counts, out, seen = len(j), self.held, [], 0
        done = [0] * len(i)  # pairs taken in each row: a row's next pair enters when the row above is ahead
        heap = [(-(sa[0] + sb[0]), 0, 0)]
        while heap and seen < wanted:
            _, r, c = heapq.heappop(heap)
            done[r] = c + 1
            cell = i[r] * width + j[c]
            if n := counts[cell]:
                out.append(cell)
                seen += n
            if c + 1 < width and (r == 0 or done[r - 1] > c + 1):
                heapq.heappush(heap, (-(sa[r] + sb[c + 1]), r, c + 1))
            if r + 1 < len(i) and done[r + 1] == c:
                heapq.heappush(heap, (-(sa[r + 1] + sb[c]), r + 1, c))
        return out


def share_reached(index: MultiIndex, counts: np.ndarray, probes: np.ndarray, cells: list[np.ndarray]) -> float:
    """The least part of all vectors, in the order of a walk, that holds RECALL of the probes' neighbours, which lie in `cells`."""
    found = []
    for q, near in zip(probes, cells, strict=True):
        walk = np.argsort(-index.sums(q), kind="stable")
        seen = np.empty(len(walk))
        seen[walk] = np.cumsum(counts[walk]) / counts.sum()
        found.append(seen[near])
    found = np.concatenate(found)
    return float(np.quantile(found, RECALL)) if len(found) else 1.0


def probes_of(x: np.ndarray) -> np.ndarray:
    return np.unique(np.linspace(0, len(x) - 1, PROBES).astype(int))


def share_for(index: MultiIndex, x: np.ndarray, k: int) -> float:
    """share_reached for vectors of x among x."""
    cells, near, rows = index.cells(x), [], probes_of(x)
    for r in rows:
        s = x @ x[r]
        s[r] = -np.inf
        near.append(cells[np.argsort(-s, kind="stable")[: min(k, len(x) - 1)]])
    return share_reached(index, np.bincount(cells, minlength=len(index.first) * len(index.second)), x[rows], near)


def share_among(index: MultiIndex, counts: np.ndarray, x: np.ndarray, cells: DataFrame, k: int) -> float:
    """share_reached for vectors of x among all entries (vec, ids, cell): one pass, in which a task keeps k a probe."""
    q = x[probes_of(x)]
    own = {v.tobytes(): r for r, v in enumerate(q)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, where = np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64)
        for b in batches:
            vecs = b.column(0).to_pylist()
            if vecs:
                s = q @ np.frombuffer(b"".join(vecs), "<f8").reshape(-1, q.shape[1]).T
                for c, v in enumerate(vecs):
                    if v in own:
                        s[own[v], c] = -np.inf
                s, c = np.hstack([best, s]), np.hstack([where, np.broadcast_to(np.asarray(b.column(2)), s.shape)])
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                best, where = np.take_along_axis(s, top, 1), np.take_along_axis(c, top, 1)
        r, c = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(-best[r, c]), pa.array(where[r, c])], names=["probe", "far", "cell"])

    near = cells.mapInArrow(rows, "probe long, far double, cell long").groupBy("probe").agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "cell"))), 1, k).alias("near"))
    found = {r.probe: np.array([n.cell for n in r.near]) for r in near.collect()}  # k a probe
    return share_reached(index, counts, q[sorted(found)], [found[r] for r in sorted(found)])


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec): vectors that take part, as little-endian doubles."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & v.isNotNull() & fine)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1)
            flat = (np.asarray(x.flatten()) + 0.0).astype("<f8").tobytes()  # -0.0 becomes 0.0
            ends = np.cumsum([0, *x.value_lengths().to_pylist()]) * 8
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([flat[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["vec_id", "vec"])

    return kept.mapInArrow(rows, "vec_id long, vec binary")


def distinct_vectors(rows: DataFrame, ids: int) -> DataFrame:
    """(vec, ids): each distinct vector with its `ids` smallest ids, gathered by task first."""
    least = lambda c: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), 1, ids).alias("ids")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[bytes, list[int]] = {}
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found.setdefault(v, []).append(i)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([sorted(set(x))[:ids] for x in found.values()], pa.list_(pa.int64()))], names=["vec", "ids"])

    some = rows.mapInArrow(part, "vec binary, ids array<long>")
    return some.groupBy("vec", F.pmod(F.spark_partition_id(), F.lit(32)).alias("task")).agg(least("ids")).groupBy("vec").agg(least("ids"))


ENTRY = pa.list_(pa.int64())
GRID = "block long, asks boolean, vec binary, cell int, ids array<long>, name long, least double"


def reranked(batches: Iterator[pa.RecordBatch], index: MultiIndex, dim: int, k: int) -> Iterator[pa.RecordBatch]:
    """(name, far, vec_id): the k + 1 nearest of each block for each query that asks it, of GRID sorted by block, entries
    before queries. One block's entries are held; queries stream by."""
    width, h = len(index.second), index.first.shape[1]
    at, parts, held = None, [], None

    def ready() -> tuple:
        t = pa.Table.from_batches(parts)
        m = np.frombuffer(b"".join(t.column("vec").to_pylist()), "<f8").reshape(-1, dim)
        own, place = np.unique(t.column("cell").to_numpy(), return_inverse=True)
        return m, own // width, own % width, place, t.column("ids").to_pylist()

    def answers(asked: pa.RecordBatch) -> pa.RecordBatch:
        m, one, two, place, ids = held
        q = np.frombuffer(b"".join(asked.column("vec").to_pylist()), "<f8").reshape(-1, dim)
        least = np.asarray(asked.column("least"))
        sums = (q[:, :h] @ index.first.T)[:, one] + (q[:, h:] @ index.second.T)[:, two]
        open_ = sums >= (least - 1e-9 * (1 + np.abs(least)))[:, None]
        s = np.where(open_[:, place], q @ m.T, -np.inf)
        last = np.partition(s, -(k + 1), axis=1)[:, -(k + 1)] if s.shape[1] > k + 1 else np.full(len(q), -np.inf)
        names, far, found = [], [], []
        for r, name in enumerate(asked.column("name").to_pylist()):
            near = np.flatnonzero((s[r] >= last[r] - 1e-9 * (1 + abs(last[r]))) & (s[r] > -np.inf)) if np.isfinite(last[r]) else np.flatnonzero(s[r] > -np.inf)
            exact = np.cumsum(m[near] * q[r], axis=1)[:, -1]  # terms in order: equal vectors, equal scores
            best = sorted((-e, i) for e, n in zip(exact.tolist(), near.tolist(), strict=True) for i in ids[n])[: k + 1]
            names += [name] * len(best)
            far += [e for e, _ in best]
            found += [i for _, i in best]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(far, pa.float64()), pa.array(found, pa.int64())], names=["name", "far", "vec_id"])

    for b in batches:
        block, asks = np.asarray(b.column("block")), b.column("asks").to_numpy(zero_copy_only=False)
        edge = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (asks[1:] != asks[:-1]))[: len(block)])
        for i, j in zip(edge.tolist(), np.append(edge[1:], len(block)).tolist(), strict=True):
            if block[i] != at:
                at, parts, held = block[i], [], None
            if not asks[i]:
                parts.append(b.slice(i, j - i))
            elif parts or held:
                if held is None:
                    held, parts = ready(), []
                some = max(1, (128 * BLOCK) // max(BLOCK, len(held[0])))
                for n in range(i, j, some):
                    yield answers(b.slice(n, min(some, j - n)))


def search(rows: DataFrame, queries: DataFrame, k: int = 20, share: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query (vec_id, vec) among rows (vec_id, vec). A share
    is measured if none is given; ten vectors for each of the k are reranked at least."""
    entries = durable(distinct_vectors(rows, k + 1))
    none = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n = entries.count()
    drawn = entries if n <= 2 * SAMPLE else entries.where(F.pmod(F.xxhash64("vec", F.lit(1)), F.lit(1 << 30)) < int(1.2 * SAMPLE / n * (1 << 30)))  # so that no task sends a sample of its own
    sample = [np.frombuffer(r.vec, "<f8") for r in drawn.orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).select("vec").collect()]
    if not sample:
        return none
    dim = Counter(map(len, sample)).most_common(1)[0][0]
    x = np.stack([v for v in sample if len(v) == dim])
    h = max(1, dim // 2)
    centroids = int(np.clip(np.sqrt(n / CELL), 1, CENTROIDS))
    index = MultiIndex(fit_half(x[:, :h], centroids), fit_half(x[:, h:], centroids))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = np.frombuffer(b"".join(b.column(0).to_pylist()), "<f8").reshape(-1, dim)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(index.cells(m).astype(np.int32))], names=["vec", "ids", "cell"])

    cells = durable(entries.where(F.octet_length("vec") == 8 * dim).mapInArrow(placed, "vec binary, ids array<long>, cell int"))
    counts = np.zeros(len(index.first) * len(index.second), np.int64)
    for r in cells.groupBy("cell").count().collect():  # one row a cell
        counts[r["cell"]] = r["count"]
    if share is None:
        share = share_for(index, x, k) if n <= SAMPLE else share_among(index, counts, x, cells, k)
    index.plan(counts, int(np.clip(n // 128, BLOCK, 8 * BLOCK)))
    wanted = max(10 * (k + 1), int(np.ceil(share * counts.sum())))
    kinds = pa.schema([("block", pa.int64()), ("asks", pa.bool_()), ("vec", pa.binary()), ("cell", pa.int32()), ("ids", ENTRY), ("name", pa.int64()), ("least", pa.float64())])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = np.asarray(b.column(2))
            salt = np.array([hash_of(v) for v in b.column(0).to_pylist()], np.int64) % index.parts[c]
            yield pa.RecordBatch.from_arrays([pa.array(index.block[c] + salt), pa.array(np.zeros(len(c), bool)), b.column(0), b.column(2), b.column(1), pa.nulls(len(c), pa.int64()), pa.nulls(len(c), pa.float64())], schema=kinds)

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for v, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                q = np.frombuffer(v, "<f8")
                walk = np.array(index.walk(q, wanted), np.int64)
                parts = index.parts[walk]
                to = np.unique(np.repeat(index.block[walk], parts) + np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
                least = float((index.first[walk[-1:] // len(index.second)] @ q[:h] + index.second[walk[-1:] % len(index.second)] @ q[h:])[0])
                size = len(to)
                yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.ones(size, bool)), pa.array([v] * size, pa.binary()), pa.nulls(size, pa.int32()), pa.nulls(size, ENTRY), pa.array([name] * size, pa.int64()), pa.array([least] * size, pa.float64())], schema=kinds)

    asked = queries.where(F.octet_length("vec") == 8 * dim)
    tasks = min(10_000, -(-asked.count() // WALKS))  # walking costs more than its few bytes tell
    named = durable(asked.groupBy("vec").agg(F.min("vec_id").alias("name")).repartition(max(1, tasks), "vec"))
    grid = cells.mapInArrow(dealt, GRID).unionByName(named.mapInArrow(probed, GRID))
    tasks = min(10_000, int((index.block + index.parts).max()))
    scored = grid.repartition(tasks, "block").sortWithinPartitions("block", "asks").mapInArrow(lambda batches: reranked(batches, index, dim, k), "name long, far double, vec_id long")
    best = scored.groupBy("name").agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "vec_id"))), 1, k + 1).alias("near"))
    others = F.slice(F.filter("near", lambda n: n["vec_id"] != F.col("query_id")), 1, k)
    return (
        asked.select(F.col("vec_id").alias("query_id"), "vec").join(named, "vec").select("query_id", "name").join(best, "name").select("query_id", F.posexplode(others))
        .select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col.vec_id").alias("vec_id"), (F.lit(0.0) - F.col("col.far")).alias("score"))
    )


def hash_of(vec: bytes) -> int:
    import zlib

    return zlib.crc32(vec)


def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"))
    return search(rows, rows.where("vec_id % 20 = 0"))


QUERIES = {"op10_multi_index": op10_multi_index}
ORACLE: dict[str, str] = {}
