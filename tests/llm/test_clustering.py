"""Centroid clustering against plain Python, and its defined cases."""
import hashlib
import random

import numpy as np
import pytest

from framelark.llm import clustering

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string"


def brute(rows, k, rounds):
    """(vec_id, cluster, distance, cluster_inertia, inertia, digest) of (vec_id, whole numbers), sorted."""
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [r[1] for r in sorted(rows, key=key)[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in rows]
        for c in range(len(centroids)):
            held = [v for (_, v), o in zip(rows, own, strict=True) if o == c]
            if held:
                centroids[c] = [sum(x) // len(held) for x in zip(*held, strict=True)]
    found = [(i, *nearest(v)[::-1]) for i, v in rows]
    inertia = [sum(d for _, o, d in found if o == c) for c in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), c, d, inertia[c], sum(inertia), digest[c]) for i, c, d in found)


def vectors(n, dim, seed=1, spread=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread) + (i % 5) for _ in range(dim)]) for i in range(n)]


def listed(df):
    return sorted((str(r[0]), *r[1:]) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


@pytest.mark.parametrize(("spread", "block"), [(1.0, 64), (1.0, 7), (1e-3, 64)])
def test_rounds(spark, spread, block):
    rows = [*vectors(150, 6, 3, spread), *[(900 + i, [0.5] * 6) for i in range(80)], (3, [1.0] * 6), (None, [2.0] * 6)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(3)
    whole = [(i, [int(np.floor(x * 1024)) for x in v]) for i, v in rows]
    got = listed(clustering.cluster(clustering.whole_vectors(df, 6), 8, 5, 6, block))
    assert got == brute(whole, 8, 5)


def test_what_takes_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.25]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, []), (8, [-0.0001, 1.0])]
    df = spark.createDataFrame([(i, v, None, None) for i, v in rows], SCHEMA)
    assert sorted(map(tuple, clustering.whole_vectors(df, 2).collect())) == [(1, [512, -256]), (8, [-1, 1024])]
    assert listed(clustering.cluster(clustering.whole_vectors(df, 2), 8, 2, 2)) == brute([(1, [512, -256]), (8, [-1, 1024])], 8, 2)


def test_far_apart(spark):
    """Squares beyond 64 bits between vectors of different centroids."""
    df = spark.createDataFrame([(i, [4e6 * (i % 2) + i]) for i in range(6)], "vec_id long, embedding array<double>")
    whole = [(i, [int(4e6 * (i % 2) + i) * 1024]) for i in range(6)]
    assert listed(clustering.cluster(clustering.whole_vectors(df, 1), 2, 3, 1)) == brute(whole, 2, 3)


def test_beyond_64_bits(spark):
    df = spark.createDataFrame([(1, [1e300], 1, "x")], SCHEMA)
    with pytest.raises(Exception, match="exceeds 64 bits"):
        clustering.whole_vectors(df, 1).collect()


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = clustering.op11_lookup_clusters(spark, str(tmp_path))
    assert got.count() == 0
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_query_with_clashing_columns(spark, tmp_path, duckdb_at, compare):
    rows = [(i, v, 1, "x") for i, v in vectors(60, 64)] + [(i, [float(i)] * 63, 1, "x") for i in range(5)] + [(77, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.selectExpr("*", "label AS distance", "label AS vec", "label AS ids").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = clustering.op11_lookup_clusters(spark, str(tmp_path))
    assert listed(got) == brute([(i, [int(np.floor(x * 1024)) for x in v]) for i, v in vectors(60, 64)], 8, 10)
    assert compare(got.toPandas()) == compare(duckdb_at(str(tmp_path)).sql(clustering.ORACLE["op11_lookup_clusters"]).df())
