"""Divergence of sources against plain Python, at several cuts of the cube, and its defined cases."""
import random
import re
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import pytest

from framelark.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, least=3, top=200):
    """Rows (lang, source, part, item, value, rank) of (text, lang, source), by definition."""
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = [(lang, source, re.findall(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text.translate(lower))) for text, lang, source in rows]
    docs, n = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in found:
        docs[lang].update(set(terms))
        n[lang, source].update(terms)
    out = []
    for lang in {r[1] for r in rows}:
        kept = [t for t, c in docs[lang].items() if c >= least]
        groups = {s: [n[lang, s][t] for t in kept] for l, s in n if l == lang}
        share = lambda counts: [1 + 1_000_000_000 * (c + 1) // (sum(counts) + len(kept)) for c in counts]  # noqa: E731, B023
        p = {s: share(c) for s, c in groups.items()}
        q = share([sum(c) for c in zip(*groups.values(), strict=True)] if kept else [])
        f = lambda a, b: (a - b) ** 2 // b
        for s in groups:
            parts = [("pair", o, sum(map(f, p[s], p[o]))) for o in groups if o != s]
            parts += [("term", t, f(a, b)) for t, c, a, b in zip(kept, groups[s], p[s], q, strict=True) if c and a > b]
            for part, items in groupby(sorted(parts, key=lambda x: (x[0], -x[2], x[1].encode())), key=lambda x: x[0]):
                out += [(lang, s, *x, k) for k, x in enumerate(items, 1) if part == "pair" or k <= top]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    word = lambda top: f"{'abcdefgh'[rng.randrange(8)]}{'éßxyz'[rng.randrange(5)]}{'Q' * rng.randrange(top)}"
    out = [(None, None, None), ("", "en", "empty"), ("one two three", "xx", "only"), ("12 _ 3", "en", None), ("\U0001d400 \x85 É é", "en", "s1"), ("it's A-Z a_z", None, "s1")]
    for k in range(150):
        lang, source = ("en", "de")[k % 5 == 0], f"s{min(rng.randrange(12), rng.randrange(12))}"
        out.append((" ".join(word(2 + k % 4) for _ in range(rng.randrange(80))) + " Shared.words\nhere", lang, source))
    out += [out[20]] * 5  # repeated rows
    return [*out, ("long " + " ".join(word(9) for _ in range(30_000)), "en", "s3")]


@pytest.mark.parametrize(("groups", "terms"), [(32, 1 << 14), (3, 16), (1, 5)])
def test_cuts_of_the_cube(spark, rows, groups, terms):
    df = spark.createDataFrame([(k, t, lang, s, None) for k, (t, lang, s) in enumerate(rows)], SCHEMA).repartition(3)
    got = divergence.audit(df.select("lang", "source", "text"), 3, 20, groups, terms)
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == brute(rows, 3, 20)


def test_shares_are_exact(spark):
    rng = random.Random(1)
    pairs = [(c := rng.randrange(1, 10 ** rng.randrange(1, 16)), rng.randrange(c, 9 * 10**15)) for _ in range(300)] + [(1, 1), (7, 7)]
    want = [1 + 10**9 * c // t for c, t in pairs]
    assert [int(divergence.shares(np.array([c]), t)[0]) for c, t in pairs] == want
    df = spark.createDataFrame([(k, c, t) for k, (c, t) in enumerate(pairs)], "k int, c long, t long")
    assert [r[0] for r in df.orderBy("k").selectExpr(divergence.share("c", "t")).collect()] == want


def test_counting_in_parts(spark, rows, monkeypatch):
    df = spark.createDataFrame([(t, lang, s) for t, lang, s in rows], "text string, lang string, source string").repartition(2).select("lang", "source", "text")
    whole = sorted(map(str, divergence.wanted_counts(divergence.term_counts(df)).collect()))
    monkeypatch.setattr(divergence, "HELD", 50)
    assert sorted(map(str, divergence.wanted_counts(divergence.term_counts(df)).collect())) == whole


def test_query_with_clashing_columns(spark, rows, tmp_path, duckdb_at, compare):
    df = spark.createDataFrame([(k, t, lang, s, None) for k, (t, lang, s) in enumerate(rows)], SCHEMA)
    df.selectExpr("*", "lang AS term", "n_chars AS n", "n_chars AS value", "n_chars AS block").write.parquet(f"{tmp_path}/documents.parquet")
    got = divergence.op13_cube_divergence(spark, str(tmp_path)).toPandas()
    assert compare(got) == compare(duckdb_at(str(tmp_path)).sql(divergence.ORACLE["op13_cube_divergence"]).df())


def test_no_rows(spark, bare):
    assert divergence.op13_cube_divergence(spark, bare).count() == 0
