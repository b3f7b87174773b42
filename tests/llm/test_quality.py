"""Weak supervision of quality: counts against plain Python, the fit against its definition, held-out labels."""
import random
import re
from collections import Counter

import numpy as np
import pytest

from framelark.llm import quality

NAMES = ["doc_id", *quality.COUNTS]


def brute(text):
    """The counts of one text, by definition."""
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", t)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = Counter(windows)
    covered = {i + k for i, g in enumerate(windows) if often[g] > 1 for k in range(8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    letter = lambda c: c.isascii() and c.isalpha() or not c.isascii()
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), sum("A" <= c <= "Z" for c in t), sum(map(letter, t)), sum(not c.isascii() for c in t), sum(c in "!?" for c in t),
        sum(any(map(letter, x)) for x in w), sum(a == b for a, b in zip(w, w[1:], strict=False)), len(covered), len(lines), sum(x in lines[:i] for i, x in enumerate(lines)),
        sum(x.rstrip(" \t\n\v\f\r")[-1] in ".!?" for x in lines),
    )


def test_counts(spark, messy):
    rng = random.Random(5)
    odd = ["a b c d e f g h " * 3, "x " * 9, "x x x", "One.\nOne.\n\n  \nTwo!\x0b\n中文。 é?\n", "A B  c\u0085 d", "a|b <c> ##", "\n".join(["same line here"] * 40), "🎉 party! " * 30, "\x00 \x1f"]
    odd += [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))) for _ in range(60)]
    rows = [(r[0], r[1]) for r in messy] + [(1000 + i, t) for i, t in enumerate(odd)]
    got = quality.counted(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select(NAMES).collect()
    assert sorted(map(tuple, got)) == sorted((i, *brute(t)) for i, t in rows)


def test_fit_by_definition():
    """One pattern at a time, in plain Python, with two rules."""
    votes, n = ["++", "+-", "-+", "--", "0+", "-0", "00"], [900, 20, 30, 25, 100, 15, 10]
    prior, good, bad, total = quality.PRIOR, [quality.GOOD] * 2, [quality.BAD] * 2, sum(n)
    s = quality.PRIOR_SHARE * total

    def posterior(v):
        a, b = prior, 1 - prior
        for k, x in enumerate(v):
            if x != "0":
                a, b = a * (good[k] if x == "+" else 1 - good[k]), b * (1 - bad[k] if x == "+" else bad[k])
        return a / (a + b)

    for _ in range(6):
        p = [posterior(v) for v in votes]
        prior = (sum(c * x for c, x in zip(n, p, strict=True)) + s * quality.PRIOR) / (total + s)
        for k in range(2):
            rows = [(c, x, v[k]) for c, x, v in zip(n, p, votes, strict=True) if v[k] != "0"]
            good[k] = (sum(c * x for c, x, v in rows if v == "+") + s * quality.GOOD) / (sum(c * x for c, x, _ in rows) + s)
            bad[k] = (sum(c * (1 - x) for c, x, v in rows if v == "-") + s * quality.BAD) / (sum(c * (1 - x) for c, x, _ in rows) + s)
            assert good[k] + bad[k] >= 1
    got, rates, others = quality.fit(votes, np.array(n, float), 6)
    assert np.allclose(got, [posterior(v) for v in votes])
    assert np.allclose(rates, good)
    assert np.allclose(others, bad)


def test_a_rule_worse_than_chance_says_nothing():
    rng = random.Random(2)
    rows = Counter()
    for _ in range(20_000):
        fine = rng.random() < 0.8
        vote = lambda a, b: "+" if rng.random() < (a if fine else 1 - b) else "-"  # noqa: E731, B023
        rows[vote(0.95, 0.7) + vote(0.9, 0.8) + vote(0.95, 0.6) + vote(0.3, 0.3)] += 1
    votes = sorted(rows)
    p, good, bad = quality.fit(votes, np.array([rows[v] for v in votes], float), 200)
    assert abs(good[3] + bad[3] - 1) < 1e-9
    assert np.allclose(good[:3], [0.95, 0.9, 0.95], atol=0.03)
    assert np.allclose(bad[:3], [0.7, 0.8, 0.6], atol=0.06)
    by = dict(zip(votes, p, strict=True))
    assert abs(by["++-+"] - by["++--"]) < 1e-9
    assert by["++++"] > 0.9 > 0.1 > by["---+"]


def test_held_out_labels(spark):
    """No label is used; of the labelled texts that the base passes, nearly all good ones stay and nearly all bad ones go."""
    got = quality.op12_weak_supervision(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    n = {(r.quality, r.kept): r["count"] for r in got.where("NOT base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    assert n[1, True] >= 0.99 * (n[1, True] + n.get((1, False), 0))
    assert n[0, False] >= 0.95 * (n[0, False] + n.get((0, True), 0))


@pytest.fixture(scope="module")
def odd_table(spark, messy, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    junk = [(500 + i, " ".join(f"w{i}#{k}|" for k in range(40)), None, None, None) for i in range(6)] + [(None, "no id at all", "en", None, 0)]
    df = spark.createDataFrame([*[r for r in messy if r[1] is None or len(r[1]) < 50_000], *junk], "doc_id long, text string, lang string, source string, n_chars long")
    df.selectExpr("*", "n_chars AS votes", "n_chars AS n_words", "lang AS posterior", "lang AS kept").write.parquet(f"{path}/documents.parquet")
    return path


def test_query(spark, odd_table, duckdb_at, compare):
    got = quality.op12_weak_supervision(spark, odd_table).toPandas()
    want = duckdb_at(odd_table).sql(quality.ORACLE["op12_weak_supervision"]).df()
    assert sorted(got.columns) == sorted(want.columns)
    as_ids = lambda df: df.assign(doc_id=df.doc_id.astype("Int64"))
    assert compare(as_ids(got)) == compare(as_ids(want))
    assert not got[got.n_words < 20].kept.any()


def test_no_rows(spark, bare):
    assert quality.op12_weak_supervision(spark, bare).count() == 0
