"""Substring deduplication with prefix-partitioned suffix trees over words.

1. Blocks count their suffixes' prefixes: a prefix of `window` words that only one document holds has no deep node, so
   its suffix needs no tree. What blocks hold in common is found by exchanging sorted hashes of these prefixes.
2. Suffixes left are dealt to trees by variable-length prefixes: the shortest prefix with at most GROUP suffixes (by
   counts of hashed prefixes of every length, over all documents) names the group; small groups share a task.
3. A group sorts its suffixes by their words, EDGE words to a symbol; neighbours' common prefix lengths give the tree's
   nodes `window` words deep, which are repeats; a suffix is cut there, so no deeper node is built. Each answers its suffixes whether an earlier document holds it.
4. Blocks mark the words of windows that an earlier document holds; neighbouring windows join to maximal repeats.

Defined cases: null texts and texts without a repeat lose nothing; windows are judged on the input; repeated rows of
one doc_id are one document, so they don't shorten each other; rows without doc_id are left out; an empty table gives
an empty table; extra columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import words
from ._common import durable, table
from .exchange import Block, ask, blocks, bucket_bits, expand, pack_keys, planes, runs, short, squeeze, table_of, unpack_keys, unplanes

#: Words of a window; suffixes of a group, about; prefix lengths that may name a group; hash slots of prefixes;
#: words of an edge.
WINDOW, GROUP, LENGTHS, SLOTS, EDGE = 13, 1 << 20, (1, 2, 4, 8, 13), 1 << 12, 5


class Suffixes:
    """A block's suffixes that are at least `window` words long, by place."""

    def __init__(self, block: Block, window: int) -> None:
        self.window = window
        self.words, self.index, _ = words.hashes(block.data, block.ends)
        self.at, own = words.inside(self.index, window)
        self.full = words.shingles(self.words, window)[self.at]
        self.own = own
        self.doc = block.doc_ids[own]
        self.order = np.argsort(self.full)  # equal prefixes together
        f, d = self.full[self.order], self.doc[self.order]
        head = np.append(True, f[1:] != f[:-1])[: len(f)]
        self.group = np.cumsum(head) - 1
        head = np.flatnonzero(head)
        self.first = self.order[head]  # one place of each distinct prefix, by hash
        self.least = np.minimum.reduceat(d, head) if len(f) else d  # the smallest document that holds it here

    def keys(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(short keys of the distinct prefixes, whose key each prefix has)."""
        k = short(self.full[self.first], bits)
        new = np.append(True, k[1:] != k[:-1])[: len(k)]
        return k[new], np.cumsum(new) - 1

    def slots(self, length: int, places: np.ndarray) -> np.ndarray:
        return (words.shingles(self.words, length)[places] >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)

    def symbols(self, places: np.ndarray) -> np.ndarray:
        """A suffix's first `window` words as edges of up to EDGE words: a row of 32-bit symbols for each edge."""
        out, at = [], 0
        for part in np.array_split(np.arange(self.window), -(-self.window // EDGE)):
            out.append((words.shingles(self.words, len(part))[places + at] >> np.uint64(32)).astype("<u4"))
            at += len(part)
        return np.stack(out)

    def held_elsewhere(self, bits: int, answers: dict[int, bytes]) -> np.ndarray:
        """For each distinct prefix: whether another block holds it."""
        keys, own = self.keys(bits)
        known = np.zeros(len(keys), bool)
        for b, i, j in runs(keys):
            known[i:j] = np.unpackbits(np.frombuffer(answers[b], np.uint8))[: j - i]
        return known[own]


def groups_of(s: Suffixes, places: np.ndarray, plan: np.ndarray) -> np.ndarray:
    """The task of each suffix: that of its shortest prefix whose slot the plan names."""
    out = np.full(len(places), -1, np.int64)
    for k, length in enumerate(LENGTHS):
        open_ = np.flatnonzero(out < 0)
        if not len(open_):
            break
        out[open_] = plan[k][s.slots(min(length, s.window), places[open_])]
    return out


def make_plan(counts: np.ndarray, size: int) -> np.ndarray:
    """Tasks by prefix length and slot, -1 where a longer prefix is needed. Slots of small counts fill a task together."""
    plan, task, room = np.full(counts.shape, -1, np.int64), 0, size
    for k in range(len(counts)):
        for slot in np.flatnonzero((counts[k] <= size) | (k == len(counts) - 1)).tolist():
            n = int(min(counts[k][slot], size))
            if n > room:
                task, room = task + 1, size
            plan[k, slot] = task
            room -= n
    return plan


def deep_nodes(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes as rows of symbols: their order in the tree, and for each place in it the number of the deepest
    internal node at `depth` or below that it hangs from (suffixes alone in theirs are leaves)."""
    order = np.lexsort(symbols.T[::-1])
    s = symbols[order]
    common = np.zeros(len(s), np.int64)  # common prefix length with the suffix in front
    alive = np.ones(max(0, len(s) - 1), bool)
    for k in range(symbols.shape[1]):
        alive &= s[1:, k] == s[:-1, k]
        common[1:] += alive
    return order, np.cumsum(common < depth) - 1


def repeats(docs: DataFrame, window: int = WINDOW, carry: list[str] | None = None) -> tuple[DataFrame, DataFrame, int, np.ndarray]:
    """(blocks, answers, bucket bits, plan): `marks` reads the answers, rows of (block, task, kind, answer)."""
    held = blocks(docs, carry)
    bits = bucket_bits(held)
    lengths, edges = [min(n, window) for n in LENGTHS], -(-window // EDGE)

    def prefixes(block: Block) -> Iterator[tuple]:
        s = Suffixes(block, window)
        if not len(s.first):
            return
        keys, _ = s.keys(bits)
        for b, i, j in runs(keys):
            yield b, pack_keys(keys[i:j]), None
        counts = np.stack([np.bincount(s.slots(n, s.at[s.first]), minlength=SLOTS) for n in lengths])
        yield block.block % 8, None, squeeze(counts.astype("<i4"))

    sent = ask(held, prefixes, [("keys", pa.binary()), ("counts", pa.binary())])
    kinds = pa.schema([("block", pa.int64()), ("task", pa.int64()), ("kind", pa.int32()), ("answer", pa.binary())])
    ddl = "block long, task long, kind int, answer binary"

    def common(t: pa.Table) -> pa.Table:
        bucket, out, total = t.column("bucket")[0].as_py(), [], np.zeros((len(lengths), SLOTS), "<i8")
        rows = list(zip(t.column("block").to_pylist(), t.column("keys").to_pylist(), t.column("counts").to_pylist(), strict=True))
        parts = [(b, unpack_keys(k)) for b, k, _ in rows if k is not None]
        for _, _, c in rows:
            if c is not None:
                total += np.frombuffer(expand(c), "<i4").reshape(total.shape)
        if parts:
            inverse, n = np.unique(np.concatenate([p for _, p in parts]), return_inverse=True, return_counts=True)[1:]
            shared, at = (n > 1)[inverse], 0
            for b, p in parts:
                out.append((b, bucket, 0, np.packbits(shared[at : at + len(p)]).tobytes()))
                at += len(p)
        if total.any():
            out.append((-1, bucket, 2, squeeze(total)))
        return table_of(out, kinds)

    first = durable(sent.groupBy("bucket").applyInArrow(common, ddl))
    counts = np.zeros((len(lengths), SLOTS), np.int64)
    for r in first.where("kind = 2").select("answer").collect():  # eight rows
        counts += np.frombuffer(expand(r.answer), "<i8").reshape(counts.shape)
    plan = make_plan(counts, GROUP)

    leaves_kind = pa.schema([("task", pa.int64()), ("block", pa.int64()), ("symbols", pa.binary()), ("docs", pa.binary())])

    def leaves(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block.of(left)
        s = Suffixes(block, window)
        out = []
        some, tasks, parts = dealt(s, right, bits, plan)
        symbols = s.symbols(s.at[s.first[some]])
        for task, i, j in zip(tasks, parts, parts[1:], strict=False):
            out.append((task, block.block, symbols[:, i:j].tobytes(), planes(s.least[some[i:j]].astype(np.uint64), 8)))
        return table_of(out, leaves_kind)

    known = held.groupBy("block").cogroup(first.where("kind = 0").groupBy("block"))
    suffixes = known.applyInArrow(leaves, "task long, block long, symbols binary, docs binary")

    def tree(t: pa.Table) -> pa.Table:
        task = t.column("task")[0].as_py()
        docs_ = [unplanes(x, 8).astype(np.int64) for x in t.column("docs").to_pylist()]
        symbols = np.concatenate([np.frombuffer(x, "<u4").reshape(edges, -1).T for x in t.column("symbols").to_pylist()])
        doc = np.concatenate(docs_)
        order, node = deep_nodes(symbols, edges)
        least = np.minimum.reduceat(doc[order], np.flatnonzero(np.append(True, node[1:] != node[:-1])))
        earlier = np.empty(len(doc), bool)
        earlier[order] = least[node] < doc[order]
        out, at = [], 0
        for b, d in zip(t.column("block").to_pylist(), docs_, strict=True):
            out.append((b, task, 1, np.packbits(earlier[at : at + len(d)]).tobytes()))
            at += len(d)
        return table_of(out, kinds)

    trees = suffixes.groupBy("task").applyInArrow(tree, ddl)
    return held, first.where("kind = 0").unionByName(trees), bits, plan


def dealt(s: Suffixes, answers: pa.Table, bits: int, plan: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
    """(distinct prefixes of a block's suffixes that need a tree, by task; the tasks; where each begins, and the end)."""
    if not len(s.first):
        return np.zeros(0, np.int64), [], [0]
    got = {t: a for t, k, a in zip(*(answers.column(c).to_pylist() for c in ("task", "kind", "answer")), strict=True) if k == 0}
    left = np.flatnonzero(s.held_elsewhere(bits, got))
    task = groups_of(s, s.at[s.first[left]], plan)
    order = np.argsort(task, kind="stable")
    left, task = left[order], task[order]
    begin = np.flatnonzero(np.append(True, task[1:] != task[:-1])[: len(task)])
    return left, task[begin].tolist(), [*begin.tolist(), len(task)]


def marks(block: Block, answers: pa.Table, bits: int, plan: np.ndarray, window: int) -> tuple[np.ndarray, Suffixes]:
    """Whether each word of the block is covered by a window that a document with a smaller id holds."""
    s = Suffixes(block, window)
    told = {t: a for t, k, a in zip(*(answers.column(c).to_pylist() for c in ("task", "kind", "answer")), strict=True) if k == 1}
    earlier = np.zeros(len(s.first), bool)
    some, tasks, parts = dealt(s, answers, bits, plan)
    for task, i, j in zip(tasks, parts, parts[1:], strict=False):
        earlier[some[i:j]] = np.unpackbits(np.frombuffer(told[task], np.uint8))[: j - i]
    repeat = np.zeros(len(s.full), bool)
    if len(s.full):
        repeat[s.order] = earlier[s.group] | (s.doc[s.order] > s.least[s.group])
    edge = np.zeros(len(s.words) + 1, np.int64)
    np.add.at(edge, s.at[repeat], 1)
    np.add.at(edge, s.at[repeat] + window, -1)
    return np.cumsum(edge[:-1]) > 0, s


def kept_texts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, repeats) of (doc_id, text): the words left, joined by one space, and the
    maximal repeats as first word and length."""
    held, answers, bits, plan = repeats(docs, window)
    kinds = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("repeats", pa.list_(pa.list_(pa.int64())))])

    def rest(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block.of(left)
        gone, s = marks(block, right, bits, plan, window)
        out = []
        for k, doc_id in enumerate(block.doc_ids.tolist()):
            i, j = s.index[k], s.index[k + 1]
            cut = gone[i:j]
            own = block.text(k).split()
            spans: list[list[int]] = []
            if cut.any():
                own = [w for w, c in zip(own, cut.tolist(), strict=True) if not c]
                at = np.flatnonzero(np.diff(np.concatenate([[0], cut.view(np.int8), [0]]))).reshape(-1, 2)
                spans = [[int(a), int(b - a)] for a, b in at]
            out.append((doc_id, int(j - i), int(cut.sum()), b" ".join(own).decode(), spans))
        return table_of(out, kinds)

    return held.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(rest, "doc_id long, n_words long, n_removed long, kept string, repeats array<array<long>>")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_texts(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, length: str | None = "n_chars", window: int = WINDOW) -> DataFrame:
    """docs, with all their columns and without the words of repeats. Texts without any stay as they are; `length`, where
    there is such a column, follows. Rows without doc_id pass as they are."""
    held, answers, bits, plan = repeats(docs, window, docs.columns)
    target = to_arrow_schema(docs.schema)

    def rest(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block.of(left)
        gone, s = marks(block, right, bits, plan, window)
        t = block.carried().rename_columns(target.names)
        texts = t.column("text").to_pylist()
        for k in np.unique(np.searchsorted(s.index, np.flatnonzero(gone), side="right") - 1).tolist():
            cut = gone[s.index[k] : s.index[k + 1]].tolist()
            texts[k] = b" ".join(w for w, c in zip(block.text(k).split(), cut, strict=True) if not c).decode()
        columns = dict(zip(target.names, t.columns, strict=True)) | {"text": pa.array(texts, pa.string())}
        if length in columns:
            columns[length] = pa.array([None if x is None else len(x) for x in texts], pa.int64())
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns.values(), target, strict=True)], schema=target)

    return held.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(rest, docs.schema).unionByName(docs.where("doc_id IS NULL"))


SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, k, list_slice(w, k, k + 12) AS s FROM d, LATERAL (SELECT unnest(range(1, len(w) - 11)) AS k)),
m AS (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY s) < doc_id AS r FROM g),
h AS (SELECT DISTINCT doc_id, k + o AS k FROM m, (SELECT unnest(range(0, 13)) AS o) WHERE r),
x AS (SELECT doc_id, list(k) AS gone FROM h GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(array_to_string([w[k] FOR k IN range(1, len(w) + 1) IF NOT coalesce(list_contains(gone, k), false)], ' ')) AS kept_sha256 FROM d LEFT JOIN x USING (doc_id)"""

QUERIES = {"op1_substring_dedup": op1_substring_dedup}
ORACLE = {"op1_substring_dedup": SQL}
