"""Similarity join of shingle sets by vertical partitioning.

Documents of equal sets are one, under the smallest id. Shingles have one global order: by how many documents hold
them (its logarithm), then by hash. The order is cut into FRAGMENTS of about equal weight, so a set falls into a segment
for each fragment. Two sets that link share a shingle in the first of the shorter one's and of the longer one's order
(the prefixes of PPJoin); pairs that meet there have their overlaps counted segment by segment, fragment and pair being
the key, and summed for each pair.

Pairs are formed a star at a time. The first turns pair one document of each shingle's group with the group; then
linked documents are one component. Later turns pair documents outside a group's largest component with the rest of the
group, in growing numbers, each once, until no group has more than one component. So a group of k near copies costs
about k pairs; what is paired beyond are documents of different components whose sizes and places leave a link open.

Defined cases: a null or wordless text has an empty set and is linked with nothing; texts of any length are taken
whole; equal sets are one component whatever their texts; ties in the order go to the smaller hash, of documents to the
smaller id; repeated rows of one id have one component, also where their texts differ (each set links); rows without
doc_id are left out; an empty table gives an empty table; extra columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from ._common import durable, table
from .exchange import Block, ask, blocks, bucket_bits, expand, pack_keys, planes, runs, short, squeeze, table_of, unpack_keys, unplanes
from .graph import components

#: Words of a shingle; least similarity in percent; fragments of the order; factor by which a turn's centres grow;
#: pairs of a centre that share a copy of its segments.
SHINGLE, PERCENT, FRAGMENTS, GROWTH, SPREAD = 5, 75, 4, 32, 10_000
#: Ids up to which a list of them is broadcast; beyond, what they belong to is joined by shuffle.
LISTED = 2_000_000


def sets_of(block: Block, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, whose they are): each document's distinct shingles, by document and hash."""
    h, index, _ = words.hashes(block.data, block.ends, lower=True)
    at, own = words.inside(index, n)
    found, whose = [words.shingles(h, n)[at]], [own]
    size = np.diff(index)
    for k in range(1, n):  # a text of fewer words is one shingle
        few = np.flatnonzero(size == k)
        if len(few):
            found.append(words.mix(words.shingles(h, k)[index[few]] + np.uint64(k)))
            whose.append(few)
    f, o = np.concatenate(found), np.concatenate(whose)
    order = words.by(f, o)
    f, o = f[order], o[order]
    new = np.append(True, (f[1:] != f[:-1]) | (o[1:] != o[:-1]))[: len(f)]
    return f[new], o[new]


def set_names(f: np.ndarray, own: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(128-bit name of each document's set, its size)."""
    name = np.zeros((docs, 2), np.uint64)
    for k, salt in enumerate((0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47)):
        np.add.at(name[:, k], own, words.mix(f ^ np.uint64(salt)))
    return name, np.bincount(own, minlength=docs)


def sets(held: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n, rep, name, prefix, places, shared, cells) of every document: the set's size; the smallest id with an
    equal set; a hash of the set; and, on one row of all that have the set, if others may link with it: the prefix
    shingles that others hold with their places in the order, and all shingles that others hold, in order, with their
    cells of the order."""
    bits = bucket_bits(held)

    def questions(block: Block) -> Iterator[tuple]:
        f, own = sets_of(block)
        keys, n = np.unique(short(f, bits), return_counts=True)
        name, size = set_names(f, own, len(block.doc_ids))
        some = np.flatnonzero(size > 0)
        to = (name[some, 0] >> np.uint64(64 - bits)).astype(np.int64)
        some, to = some[np.argsort(to, kind="stable")], np.sort(to)
        asked = {b: (i, j) for b, i, j in runs(keys)}
        for b in sorted(asked.keys() | set(to.tolist())):
            i, j = asked.get(b, (0, 0))
            own_ = some[np.searchsorted(to, b) : np.searchsorted(to, b, side="right")]
            yield b, pack_keys(keys[i:j]), planes(n[i:j], 4), squeeze(name[own_].tobytes() + size[own_].astype("<i8").tobytes() + block.doc_ids[own_].tobytes())

    sent = ask(held, questions, [("keys", pa.binary()), ("n", pa.binary()), ("sets", pa.binary())])
    kinds = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("often", pa.binary()), ("reps", pa.binary())])

    def answer(t: pa.Table) -> pa.Table:
        parts = [unpack_keys(x) for x in t.column("keys").to_pylist()]
        n = np.concatenate([unplanes(x, 4) for x in t.column("n").to_pylist()])
        inverse = np.unique(np.concatenate(parts), return_inverse=True)[1]
        often = np.log2(np.bincount(inverse, n)).astype(np.uint8) if len(inverse) else np.zeros(0, np.uint8)
        named = [np.frombuffer(expand(x), "<u8").reshape(-1) for x in t.column("sets").to_pylist()]
        count = [len(a) // 4 for a in named]
        name = np.concatenate([a[: 2 * c].reshape(-1, 2) for a, c in zip(named, count, strict=True)])
        size = np.concatenate([a[2 * c : 3 * c] for a, c in zip(named, count, strict=True)])
        ids = np.concatenate([a[3 * c :] for a, c in zip(named, count, strict=True)]).astype(np.int64)
        order = np.lexsort((np.repeat(t.column("block").to_numpy(), count), ids, size, name[:, 1], name[:, 0]))
        same = (name[order][1:] == name[order][:-1]).all(1) & (size[order][1:] == size[order][:-1])
        first = np.flatnonzero(np.append(True, ~same)) if len(order) else np.zeros(0, np.int64)
        rep = np.empty(len(ids), "<i8")
        rep[order] = np.repeat(ids[order][first], np.diff(np.append(first, len(order))))
        alone = np.zeros(len(ids), np.uint8)
        alone[order[first]] = 1
        out, at, doc, bucket = [], 0, 0, t.column("bucket")[0].as_py()
        for block, p, c in zip(t.column("block").to_pylist(), parts, count, strict=True):
            out.append((block, bucket, squeeze(often[inverse[at : at + len(p)]]), squeeze(rep[doc : doc + c].tobytes() + alone[doc : doc + c].tobytes())))
            at, doc = at + len(p), doc + c
        return table_of(out, kinds)

    replies = sent.groupBy("bucket").applyInArrow(answer, "block long, bucket int, often binary, reps binary")
    kinds_out = [("doc_id", pa.int64()), ("n", pa.int64()), ("rep", pa.int64()), ("name", pa.int64()), ("prefix", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("shared", pa.list_(pa.int64())), ("cells", pa.list_(pa.int32()))]
    result = pa.schema(kinds_out)

    def chosen(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block.of(left)
        f, own = sets_of(block)
        got = sorted((b, expand(o), expand(r)) for b, o, r in zip(*(right.column(c).to_pylist() for c in ("bucket", "often", "reps")), strict=True))
        often = np.frombuffer(b"".join(o for _, o, _ in got), np.uint8)[np.unique(short(f, bits), return_inverse=True)[1]]
        name, size = set_names(f, own, len(block.doc_ids))
        some, rep = np.flatnonzero(size > 0), block.doc_ids.copy()
        some = some[np.argsort(name[some, 0] >> np.uint64(64 - bits), kind="stable")]
        rep[some] = np.frombuffer(b"".join(r[: len(r) // 9 * 8] for _, _, r in got), "<i8")
        stands = np.zeros(len(size), bool)  # for all rows of its set
        stands[some] = np.frombuffer(b"".join(r[len(r) // 9 * 8 :] for _, _, r in got), np.uint8)
        order = words.by(f, often, own)
        f, own, often = f[order], own[order], often[order]
        first = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(len(f)) - first[own]
        shared = (often > 0) & stands[own]
        ahead = shared & (place < (size - -(-percent * size // 100) + 1)[own])

        def lists(which: np.ndarray, values: np.ndarray) -> list:
            edge, all_ = np.searchsorted(own[which], np.arange(len(size) + 1)).tolist(), values[which].tolist()
            return [all_[i:j] if has else None for i, j, has in zip(edge, edge[1:], held_, strict=False)]

        held_ = (np.bincount(own[ahead], minlength=len(size)) > 0).tolist()
        cell = often.astype(np.int64) * 4 + (f >> np.uint64(62)).astype(np.int64)
        columns = [block.doc_ids, size, rep, name[:, 0].view(np.int64), lists(ahead, f.view(np.int64)), lists(ahead, place), lists(shared, f.view(np.int64)), lists(shared, cell)]
        return pa.Table.from_arrays([pa.array(x, t.type) for x, t in zip(columns, result, strict=True)], schema=result)

    return durable(held.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(chosen, "doc_id long, n long, rep long, name long, prefix array<long>, places array<int>, shared array<long>, cells array<int>"))


def fragment_edges(whole: DataFrame, fragments: int) -> list[int]:
    """Where the global order is cut: between its cells, by the weight that documents' shingles have there."""
    weight = sorted((r.cell, r.n) for r in whole.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).collect())  # four cells for each doubling of the frequency
    total, before, edges = sum(n for _, n in weight), 0, [0]
    for cell, n in weight:
        if 0 < before and before * fragments >= len(edges) * total and len(edges) < fragments:
            edges.append(cell)
        before += n
    return [*edges, 1 << 30]


def segments(whole: DataFrame, edges: list[int]) -> DataFrame:
    """(doc_id, name, n, fragment, part): what each set has in each fragment of the global order."""
    part = lambda lo, hi: F.filter("shared", lambda _, k: (F.get("cells", k) >= lo) & (F.get("cells", k) < hi))
    parts = F.array(*[F.struct(F.lit(k).alias("fragment"), part(lo, hi).alias("part")) for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))])
    return whole.select("doc_id", "name", "n", F.explode(parts).alias("p")).select("doc_id", "name", "n", "p.fragment", "p.part").where(F.size("part") > 0)


def verified(pairs: DataFrame, whole: DataFrame, edges: list[int], percent: int = PERCENT) -> DataFrame:
    """The pairs (x, y) whose sets link. Overlaps are counted for each pair and fragment, and summed. A centre x of many
    pairs sends its segments to several places, each for about SPREAD of them."""
    count = pairs.count()
    ids = pairs.select(F.col("x").alias("doc_id")).union(pairs.select("y")).distinct()
    parts = segments(whole.join(F.broadcast(ids) if 2 * count <= LISTED else ids, "doc_id", "left_semi"), edges)
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("y"), F.lit(1 + count // SPREAD)))
    centres = dealt.select("x", "salt").distinct().join(parts.select(F.col("doc_id").alias("x"), F.col("name").alias("hx"), F.col("n").alias("nx"), "fragment", F.col("part").alias("px")), "x")
    others = dealt.join(parts.select(F.col("doc_id").alias("y"), F.col("name").alias("hy"), F.col("n").alias("ny"), "fragment", F.col("part").alias("py")), "y")
    partial = others.join(centres, ["x", "salt", "fragment"]).select("x", "y", "hx", "hy", "nx", "ny", F.size(F.array_intersect("px", "py")).alias("both"))
    total = partial.groupBy("x", "y", "hx", "hy", "nx", "ny").agg(F.sum("both").alias("both"))
    return total.where(100 * F.col("both") >= percent * (F.col("nx") + F.col("ny") - F.col("both"))).select("x", "y").distinct()


def with_components(rows: DataFrame, comp: DataFrame | None) -> DataFrame:
    if comp is None:
        return rows.withColumn("comp", F.col("doc_id"))
    return rows.join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id")).drop("component")


def turn_of(t: DataFrame, turn: int) -> DataFrame:
    """The rows of t whose group still has several components, with `centre`: whether this turn pairs the row with all
    others of its group. The groups are written first, so that the join with a hot one can be split."""
    if turn < 2:
        groups = durable(t.groupBy("shingle").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.min("doc_id").alias("least")).where("a <> b").select("shingle", "least"))
        centre: Column = F.col("doc_id") == F.col("least")
    else:
        parts = t.groupBy("shingle", "comp").agg(F.count("*").alias("size"))
        groups = durable(parts.groupBy("shingle").agg(F.max(F.struct("size", "comp")).alias("main"), F.sum("size").alias("size"), F.count("*").alias("comps")).where("comps > 1").select("shingle", "main", "size"))
        outside = F.col("size") - F.col("main.size")
        drawn = F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.lit(1 << 20)) * outside < F.lit(min(GROWTH ** (turn - 1), 1 << 42) << 20)
        centre = (F.col("comp") != F.col("main.comp")) & drawn
    return t.join(groups, "shingle").select("doc_id", "n", "shingle", "place", "comp", centre.alias("centre"))


def met(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (x, y) of a centre and another document of its group that may link: the shared shingle is in the prefix
    that the longer set has for shorter ones and the shorter set has for longer ones, the sizes are near enough, and what
    both have from there on is enough."""
    centres = rows.where("centre").select("shingle", F.col("doc_id").alias("x"), F.col("n").alias("nx"), F.col("place").alias("px"), F.col("comp").alias("cx"))
    longer = lambda a, b: F.ceil(F.lit(2 * percent) * F.least(a, b) / F.lit(100 + percent))
    first = F.when((F.col("nx") < F.col("n")) | (F.col("nx") == F.col("n")) & (F.col("x") < F.col("doc_id")), F.col("px")).otherwise(F.col("place"))
    near = F.least("n", "nx") * 100 >= F.greatest("n", "nx") * percent
    reach = F.least(F.col("nx") - F.col("px"), F.col("n") - F.col("place")) * (100 + percent) >= percent * (F.col("nx") + F.col("n"))
    both = rows.join(centres, "shingle").where(F.col("comp") != F.col("cx")).where(~(F.col("centre") & (F.col("doc_id") < F.col("x"))))
    return both.where(near & reach & (first <= F.least("n", "nx") - longer("n", "nx"))).select("x", F.col("doc_id").alias("y")).distinct()


def join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of (doc_id, text)."""
    found = sets(blocks(docs), percent)
    whole = found.where("prefix IS NOT NULL")
    edges = fragment_edges(whole, FRAGMENTS)
    # first by one shingle of each document, its most frequent one of the prefix, where most copies meet
    links, comp, turn = None, None, 0
    t = whole.select("doc_id", "n", F.element_at("prefix", -1).alias("shingle"), F.element_at("places", -1).alias("place"), F.col("doc_id").alias("comp"))
    while True:
        rows = durable(turn_of(t, turn))
        if turn and rows.isEmpty():
            break
        pairs = durable(met(rows, percent))
        new = None if pairs.isEmpty() else durable(verified(pairs, whole, edges, percent))
        if new is not None and not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            comp = components(links)
        if turn == 0:
            t = with_components(whole.select("doc_id", "n", F.arrays_zip("prefix", "places").alias("at")), comp).select("doc_id", "n", "comp", F.explode("at").alias("at")).select("doc_id", "n", "comp", F.col("at.prefix").alias("shingle"), F.col("at.places").alias("place"))
        else:  # centres have met their groups
            t = with_components(rows.where("NOT centre").drop("comp", "centre"), comp)
        turn += 1
    out = found.select("doc_id", F.col("n").alias("n_shingles"), "rep")
    if comp is None:
        return out.select("doc_id", "n_shingles", F.col("rep").alias("component_id"))
    return out.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def first_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs, with all their columns, without those that link with one of a smaller id; of repeated rows one stays. Rows
    without doc_id, which no other row can be held against, pass as they are."""
    found = durable(join(docs, percent).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("component_id").alias("c")))

    def listed(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.limit(LISTED + 1).count() <= LISTED else ids

    gone, again = listed(found.where("c <> doc_id").select("doc_id")), listed(found.where("c = doc_id AND n > 1").select("doc_id"))
    kept = docs.join(gone, "doc_id", "left_anti")
    once = kept.join(again, "doc_id", "left_anti").unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return once.select(docs.columns)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, k, k + 4) AS g FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 3, 2))) AS k) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) ON a = d.doc_id"""

QUERIES = {"op3_ngram_jaccard": op3_ngram_jaccard}
ORACLE = {"op3_ngram_jaccard": SQL}
