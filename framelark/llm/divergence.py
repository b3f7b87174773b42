"""Divergence between the sources of each language by three-dimensional cube partitioning.

A group is a (language, source). Terms are runs of letters, counted by task first, so that only one row a group, term and
task is shuffled. A term that enough documents of its language hold is kept. Shares are whole billionths, so all sums are
exact. The divergences of all pairs of a language's groups are a cube of groups by groups by terms, which is cut along all
three axes: a cell (block of groups, block of groups, block of terms) gets a copy of both blocks' slices of counts, sums
the terms of its block for each pair of its groups, in both directions, and the sums are added up along the term axis. So
no task holds more than two blocks of groups times a block of terms, and a slice is copied once for each block of groups.

Defined cases: null text, language or source are empty ones; a group without kept terms has the shares of counts of 0; a
language without kept terms gives pairs of value 0; a language of one source gives no pairs; repeated rows count each;
ties go by the item's UTF-8; an empty table gives an empty table; extra columns are ignored; a text is read whole.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import durable, table

#: Documents of a language that hold a kept term, at least; unit of shares; ranks of terms that are listed.
LEAST_DOCS, UNIT, TOP = 3, 1_000_000_000, 200
#: Groups of a block; terms of a block, about; (group, term) rows that a counting task holds before it hands them on.
GROUPS, TERMS, HELD = 32, 1 << 14, 400_000
_TERM = re.compile(rb"[a-z\x80-\xff]+")


def terms(text: str) -> list[bytes]:
    """The terms of a text in order, as UTF-8: letters A-Z, a-z and all code points beyond ASCII; only A-Z are lower-cased."""
    return _TERM.findall(text.encode().lower())


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of rows (lang, source, text), in parts to be added up; each group has rows with a null
    term and n of 0."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[str, str], Counter] = {}
        docs: dict[tuple[str, str], Counter] = {}
        held = 0  # rows so far, at most

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in n.items():
                columns = [pa.array([*own, None], pa.binary()).cast(pa.string()), pa.array([*own.values(), 0], pa.int64()), pa.array([*map(docs[lang, source].__getitem__, own), 0], pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(own) + 1), pa.repeat(source, len(own) + 1), *columns], names=["lang", "source", "term", "n", "docs"])

        for b in batches:
            for lang, source, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                group, found = (lang or "", source or ""), terms(text or "")
                own = set(found)
                n.setdefault(group, Counter()).update(found)
                docs.setdefault(group, Counter()).update(own)
                held += len(own) + 1
                if held >= HELD and (held := sum(map(len, n.values()))) >= HELD // 2:
                    yield from out()
                    n.clear()
                    docs.clear()
                    held = 0
        if n:
            yield from out()

    return docs.select(*[F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")]).mapInArrow(rows, "lang string, source string, term string, n long, docs long")


def share(count: str, total: str) -> str:
    """1 + floor(UNIT * count / total) as SQL, three digits at a time, so that nothing overflows."""
    rests = [f"(({count}) % ({total}))"]
    rests += [f"(({rests[0]} * 1000) % ({total}))"]
    rests += [f"(({rests[1]} * 1000) % ({total}))"]
    digits = [f"(({r} * 1000) div ({total})) * {1000 ** (2 - k)}" for k, r in enumerate(rests)]
    return f"1 + (({count}) div ({total})) * {UNIT} + " + " + ".join(digits)


def shares(count: np.ndarray, total: int) -> np.ndarray:
    """The same in numpy."""
    p, rest = np.divmod(count, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        p = p * 1000 + digit
    return p + 1


def wanted_counts(parts: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, total): the sums of terms that `least` documents of their language hold, and the groups' rows
    with null terms. total: in all of the language. One shuffle deals out terms, which is all that both sums need."""
    sums = parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = W.partitionBy("lang", "term")
    both = sums.withColumns({"total": F.sum("n").over(term), "in_docs": F.sum("docs").over(term)})
    return both.where((F.col("in_docs") >= least) | F.col("term").isNull()).select("lang", "source", "term", "n", "total")


def kept_counts(wanted: DataFrame, size: int = TERMS) -> DataFrame:
    """(lang, source, term, n, total, in_lang, n_terms, block, place, width) of kept terms. in_lang: what all of the language's
    sum to; n_terms: how many it keeps. A term has a place in a block of `width` ones."""
    rows = wanted.where("term IS NOT NULL")
    kept = rows.groupBy("lang", "term").agg(F.first("total").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("total").alias("in_lang"), F.count("*").alias("n_terms"))
    # dealt out anew, as the join may have left a whole language in one task
    dealt = kept.drop("total").join(langs, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.ceil(F.col("n_terms") / size)).cast("int")).repartition("lang", "block")
    block = W.partitionBy("lang", "block")
    placed = dealt.withColumns({"place": F.row_number().over(block.orderBy("term")) - 1, "width": F.count("*").over(block).cast("int")})
    return rows.join(placed, ["lang", "term"])


def all_groups(counts: DataFrame, kept: DataFrame, size: int = GROUPS) -> DataFrame:
    """(lang, source, in_group, n_terms, n_blocks, group_block, group_blocks) of every group. in_group: of all kept terms."""
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("in_group"))
    langs = kept.groupBy("lang").agg(F.max("n_terms").alias("n_terms"), (F.max("block") + 1).alias("n_blocks"))
    groups = counts.where("term IS NULL").select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["in_group", "n_terms"]).fillna(1, ["n_blocks"])
    some = groups.groupBy("lang").agg(F.ceil(F.count("*") / size).cast("int").alias("group_blocks"))
    return groups.join(some, "lang").withColumn("group_block", F.pmod(F.xxhash64("source"), "group_blocks").cast("int"))


def cell_sums(slices: pd.DataFrame) -> pd.DataFrame:
    """(lang, source, item, value): for the ordered pairs of a cell's two blocks of groups, the sum over its block of terms."""
    low, high = int(slices["low"].iloc[0]), int(slices["high"].iloc[0])
    width = int(slices["width"].max())
    counts = np.zeros((len(slices), width), np.int64)
    for r, (place, n) in enumerate(zip(slices["places"], slices["counts"], strict=True)):
        if place is not None:
            counts[r, place] = n
    p = np.stack([shares(c + 1, int(total)) for c, total in zip(counts, slices["in_group"] + slices["n_terms"], strict=True)]) if width else counts
    block, names = slices["group_block"].to_numpy(), slices["source"].to_numpy()
    out = []
    for a, b in {(low, high), (high, low)}:
        others = np.flatnonzero(block == b)
        for r in np.flatnonzero(block == a):
            value = ((p[r] - p[others]) ** 2 // p[others]).sum(1)
            out += [(names[r], names[o], v) for o, v in zip(others, value.tolist(), strict=True) if o != r]
    return pd.DataFrame(out, columns=["source", "item", "value"]).assign(lang=slices["lang"].iloc[0])


def pair_divergence(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of a language's groups."""
    held = kept.groupBy("lang", "source", "block").agg(F.array_sort(F.collect_list(F.struct("place", "n"))).alias("held"))
    vectors = held.select("lang", "source", "block", F.col("held.place").alias("places"), F.col("held.n").alias("counts"))
    widths = kept.groupBy("lang", "block").agg(F.max("width").alias("width"))
    every = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    slices = every.join(vectors, ["lang", "source", "block"], "left").join(widths, ["lang", "block"], "left").fillna(0, ["width"])
    other = F.explode(F.sequence(F.lit(0), F.col("group_blocks") - 1)).alias("other")
    copies = slices.select("*", other).withColumns({"low": F.least("group_block", "other"), "high": F.greatest("group_block", "other")})
    cells = copies.select("lang", "low", "high", "block", "group_block", "source", "in_group", "n_terms", "width", "places", "counts").groupBy("lang", "low", "high", "block")
    return cells.applyInPandas(cell_sums, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_divergence(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the terms that are more frequent in a group than in its language."""
    rows = kept.join(groups.select("lang", "source", "in_group"), ["lang", "source"])
    rows = rows.withColumns({"p": F.expr(share("n + 1", "in_group + n_terms")), "q": F.expr(share("total + 1", "in_lang + n_terms"))}).where("p > q")
    return rows.select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, n_groups: int = GROUPS, n_terms: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of rows (lang, source, text)."""
    counts = durable(wanted_counts(term_counts(docs), least))
    kept = durable(kept_counts(counts, n_terms))
    groups = durable(all_groups(counts, kept, n_groups))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    row = lambda df, part: df.withColumn("rank", rank).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return row(pair_divergence(groups, kept), "pair").unionByName(row(term_divergence(groups, kept), "term").where(F.col("rank") <= top))


def op13_cube_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{_CAPITALS}', '{_CAPITALS.lower()}') AS t FROM documents),
w AS MATERIALIZED (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*)::HUGEINT AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
l AS MATERIALIZED (SELECT lang, sum(total)::HUGEINT AS in_lang, count(*) AS v FROM k GROUP BY lang),
c AS MATERIALIZED (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS MATERIALIZED (SELECT lang, source, coalesce(in_group, 0) AS in_group, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n)::HUGEINT AS in_group FROM c GROUP BY ALL) USING (lang, source) LEFT JOIN l USING (lang)),
p AS MATERIALIZED (SELECT g.lang, g.source, term, 1 + {UNIT}::HUGEINT * (coalesce(n, 0) + 1) // (in_group + v) AS p FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
q AS (SELECT lang, term, 1 + {UNIT}::HUGEINT * (total + 1) // (in_lang + v) AS q FROM k JOIN l USING (lang)),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) JOIN c USING (lang, source, term) WHERE p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (FROM pairs UNION ALL FROM terms) QUALIFY part = 'pair' OR rank <= {TOP}"""

QUERIES = {"op13_cube_divergence": op13_cube_divergence}
ORACLE = {"op13_cube_divergence": _SQL}
