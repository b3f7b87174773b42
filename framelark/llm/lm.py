"""Language-model scores from a log-bilinear model trained with noise-contrastive estimation.

A symbol is a word with at least N ** (2 / 3) / OWN of the table's N tokens, or a hash of the last bytes of all other
words. So the symbols that are words grow with the table, and are at most OWN * N ** (1 / 3), which is what the driver
gets. The most frequent symbols are classes of their own, the rest fall to classes by their rank, so that classes and
their members are both about as many as the root of the symbols.
The model predicts a token's symbol from those of the two tokens before it: a position's vectors are scaled, summed, and
multiplied with every class's vector at once, then with those of the class's members; both softmaxes give normalised
probabilities. A word takes its part of its symbol by its count. Unseen words are one event, whose probability is the
part of training tokens seen once.
Training documents fall to shards and rounds by their ids. In a round each shard trains on all its documents of the round
from the same model, with noise shared by a batch; the shards' parameters are averaged by tokens, WIDTH at a time, and
the next round begins with the average. So scores do not depend on partitions. Counts are exact, over all training
tokens; only symbol sums and the model's parameters reach the driver, merged WIDTH at a time before.

Defined cases: null and empty texts are the end token alone; repeated rows are scored each and count each; without
texts of any length are scored whole; without
training texts every token is unseen and the model's score is the base score; an empty table gives an empty table;
rows without doc_id are left out; extra columns are ignored.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from ._common import durable, table
from .exchange import BITS, Block, ask, blocks, bucket_bits, expand, pack_keys, planes, runs, short, squeeze, table_of, unpack_keys, unplanes

#: Factor of the words that are symbols; symbols of other words by their last TAIL bytes; vector length; tokens before;
#: batch; noise classes of a batch; noise members of a token; rounds of training.
OWN, RARE, TAIL, DIM, ORDER, BATCH, NOISE, AMONG, ROUNDS = 64, 384, 3, 16, 2, 4096, 32, 2, 4
#: Training tokens of a shard, about, and of a piece of it; what is merged into one at a time.
SHARD, PIECE, WIDTH = 1 << 21, 1 << 19, 64
FOLDS = 10
END = np.uint64(0x5851F42D4C957F2D)
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes with an end after each text, each text's first token and the count behind, rare class)."""
    h, index, tails = words.hashes(block.data, block.ends, lower=True, tail=TAIL)
    n = len(index) - 1
    at = index[1:] + np.arange(n)
    out, rare = np.full(len(h) + n, END, np.uint64), np.zeros(len(h) + n, np.int64)
    word = np.ones(len(out), bool)
    word[at] = False
    out[word], rare[word] = h, (tails % np.uint64(RARE)).astype(np.int64)
    return out, index + np.arange(n + 1), rare


def held_out(doc_ids: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(str(i).encode()) % FOLDS == 0 for i in doc_ids.tolist()], bool)


@dataclass
class Counts:
    """Totals of the training tokens and the symbols made from them, numbered by falling weight."""
    total: int
    distinct: int
    once: int
    frequent: np.ndarray  # hashes, sorted
    symbol_of: np.ndarray  # their symbols
    rare: np.ndarray  # the symbols of tail hashes
    weight: np.ndarray  # training tokens of each symbol

    def symbols(self, h: np.ndarray, rare: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.frequent, h)
        at[at == len(self.frequent)] = 0
        hit = self.frequent[at] == h if len(self.frequent) else np.zeros(len(h), bool)
        return np.where(hit, self.symbol_of[at] if len(self.frequent) else 0, self.rare[rare])


@dataclass
class Classes:
    """The first `single` symbols are classes of their own, the rest fall to classes of `width` by rank."""
    symbols: int
    single: int
    width: int

    @classmethod
    def of(cls, symbols: int) -> Classes:
        root = int(np.ceil(np.sqrt(symbols)))
        return cls(symbols, min(symbols, 2 * root), root)

    @property
    def number(self) -> int:
        return self.single + -(-(self.symbols - self.single) // self.width)

    def of_symbol(self, s: np.ndarray) -> np.ndarray:
        return np.where(s < self.single, s, self.single + (s - self.single) // self.width)

    def begin(self, c: np.ndarray | int) -> np.ndarray:
        return self.single + (c - self.single) * self.width

    def end(self, c: np.ndarray | int) -> np.ndarray:
        return np.minimum(self.begin(c) + self.width, self.symbols)


@dataclass
class Model:
    """Context scales (ORDER, DIM), input vectors of symbols, output vectors and offsets of classes and of symbols in
    their class; the last input row stands for no token."""
    scale: np.ndarray
    inputs: np.ndarray
    outputs: np.ndarray
    offset: np.ndarray
    members: np.ndarray
    bias: np.ndarray

    @classmethod
    def start(cls, weight: np.ndarray) -> Model:
        n, rng, classes = len(weight), np.random.default_rng(7), Classes.of(len(weight))
        p = weight + 0.1
        of = np.bincount(classes.of_symbol(np.arange(n)), p, minlength=classes.number)
        small = lambda rows: rng.normal(0, 0.1, (rows, DIM)).astype(np.float32)
        within = np.log(p / of[classes.of_symbol(np.arange(n))]).astype(np.float32)
        return cls(np.ones((ORDER, DIM), np.float32), small(n + 1), small(classes.number), np.log(of / of.sum()).astype(np.float32), small(n), within)

    def arrays(self) -> list[np.ndarray]:
        return [self.scale, self.inputs, self.outputs, self.offset, self.members, self.bias]

    def context(self, c: np.ndarray) -> np.ndarray:
        return sum(self.inputs[c[:, k]] * self.scale[k] for k in range(ORDER))

    def log_probability(self, c: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Natural log probabilities of the wanted symbols after contexts c; each distinct context's vector once."""
        size, classes = len(self.inputs), Classes.of(len(self.members))
        code, inverse = np.unique(c @ (size ** np.arange(ORDER)), return_inverse=True)
        r = self.context(np.stack([code // size**k % size for k in range(ORDER)], 1))
        of, out = classes.of_symbol(wanted), np.empty(len(wanted))
        order = np.argsort(inverse, kind="stable")
        edge = np.searchsorted(inverse[order], np.arange(0, len(r) + 2048, 2048))
        for k in range(0, len(r), 2048):
            s, z = log_sums(r[k : k + 2048], self.outputs, self.offset)
            some = order[edge[k // 2048] : edge[k // 2048 + 1]]
            out[some] = s[inverse[some] - k, of[some]] - z[inverse[some] - k]
        order = np.argsort(of, kind="stable")
        edge = np.searchsorted(of[order], np.arange(classes.single, classes.number + 1))
        for k in np.flatnonzero(np.diff(edge)).tolist():
            lo, hi = int(classes.begin(classes.single + k)), int(classes.end(classes.single + k))
            for at in range(edge[k], edge[k + 1], 4096):
                some = order[at : min(at + 4096, edge[k + 1])]
                s, z = log_sums(r[inverse[some]], self.members[lo:hi], self.bias[lo:hi])
                out[some] += s[np.arange(len(some)), wanted[some] - lo] - z
        return out


def log_sums(r: np.ndarray, vectors: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, the logarithm of the sum of their exponentials) for each row of r."""
    s = r @ vectors.T + offset
    bound = np.sqrt((r * r).sum(1).max() * (vectors * vectors).sum(1).max()) + np.abs(offset).max()
    if bound > 60:  # exponentials might leave single precision
        top = s.max(1)
        return s, top + np.log(np.exp(s - top[:, None]).sum(1))
    return s, np.log(np.exp(s).sum(1))


def contexts(symbols: np.ndarray, index: np.ndarray, none: int) -> np.ndarray:
    """The ORDER symbols before each token of its own text; `none` where there is none."""
    place = np.arange(len(symbols)) - np.repeat(index[:-1], np.diff(index))
    out = np.full((len(symbols), ORDER), none, np.int64)
    for k in range(ORDER):
        out[k + 1 :, k] = np.where(place[k + 1 :] > k, symbols[: -(k + 1)], none)
    return out


def train(model: Model, c: np.ndarray, wanted: np.ndarray, noise: np.ndarray, memory: list[np.ndarray], rng: np.random.Generator, rate: float = 0.1) -> None:
    """One pass of noise-contrastive estimation: each token against noise classes drawn once for its batch."""

    def step(rows: np.ndarray, *changes: tuple[int, np.ndarray]) -> None:
        """Adds changes (which array, what to each of its rows): those of one row are summed first."""
        rows = rows.astype(np.min_scalar_type(len(model.inputs)))  # short ones sort faster
        order = np.argsort(rows, kind="stable")
        own = rows[order]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        own = own[first]
        for k, g in changes:
            g = np.add.reduceat(g[order], first, axis=0)
            squares = memory[k][own] + g * g
            memory[k][own] = squares
            model.arrays()[k][own] += rate * g / np.sqrt(squares)

    classes = Classes.of(len(noise))
    of = classes.of_symbol(np.arange(len(noise)))
    of_class = np.bincount(of, noise, minlength=classes.number)
    of_class = of_class / of_class.sum()
    upto = np.concatenate([[0], np.cumsum(noise)])
    log_noise = np.log(of_class * NOISE).astype(np.float32)
    shared = np.maximum(of, classes.single)
    among = upto[classes.end(shared)] - upto[np.minimum(classes.begin(shared), len(noise))]
    log_among = np.log(np.divide(noise, among, out=np.ones(len(noise)), where=of >= classes.single) * AMONG).astype(np.float32)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    shuffled = rng.permutation(len(wanted))
    drawn = np.searchsorted(np.cumsum(of_class), rng.random(NOISE * (len(wanted) // BATCH + 1))).clip(0, classes.number - 1)
    for k, at in enumerate(range(0, len(wanted), BATCH)):
        some = shuffled[at : at + BATCH]
        w, ctx, q = of[wanted[some]], c[some], drawn[k * NOISE : (k + 1) * NOISE]
        r = model.context(ctx)
        up = sigmoid(-((r * model.outputs[w]).sum(1) + model.offset[w] - log_noise[w]))  # towards the token
        down = -sigmoid(r @ model.outputs[q].T + model.offset[q] - log_noise[q])  # away from the noise
        back = up[:, None] * model.outputs[w] + down @ model.outputs[q]
        n = np.float32(len(some))
        step(np.concatenate([w, q]), (2, np.concatenate([up[:, None] * r, down.T @ r]) / n), (3, np.concatenate([up, down.sum(0)]) / n))
        inside = np.flatnonzero(w >= classes.single)
        if len(inside):  # the token against members of its class
            v, g, x = wanted[some][inside], w[inside], r[inside]
            lo, hi = upto[classes.begin(g)], upto[classes.end(g)]
            m = np.searchsorted(upto, lo[:, None] + rng.random((len(v), AMONG)) * (hi - lo)[:, None], side="right") - 1
            m = np.clip(m, classes.begin(g)[:, None], classes.end(g)[:, None] - 1)
            up = sigmoid(-((x * model.members[v]).sum(1) + model.bias[v] - log_among[v]))
            down = -sigmoid(np.einsum("nd,nkd->nk", x, model.members[m]) + model.bias[m] - log_among[m])
            back[inside] += up[:, None] * model.members[v] + np.einsum("nk,nkd->nd", down, model.members[m])
            step(np.concatenate([v, m.ravel()]), (4, np.concatenate([up[:, None] * x, (down[:, :, None] * x[:, None]).reshape(-1, DIM)]) / n), (5, np.concatenate([up, down.ravel()]) / n))
        for j in range(ORDER):
            step(ctx[:, j], (1, back * model.scale[j] / n))
        step(np.arange(ORDER), (0, np.stack([(back * model.inputs[ctx[:, j]]).sum(0) for j in range(ORDER)]) / n))


def count(held: DataFrame) -> tuple[DataFrame, Counts]:
    """(block, bucket, counts): each block's words' training counts in its own order; and the totals."""
    bits = bucket_bits(held)
    size = held.agg(F.sum(F.col("n_words") + F.col("n_docs"))).first()[0] or 0
    least = max(1, int(np.ceil(size ** (2 / 3) / OWN)))

    def questions(block: Block) -> Iterator[tuple]:
        h, index, rare = tokens(block)
        learned = np.repeat(~held_out(block.doc_ids), np.diff(index))
        keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        n = np.bincount(inverse, learned, minlength=len(keys)).astype(np.int64)
        keys = short(keys, bits)  # equal ones (far below one in a billion) would count as one word
        fresh = np.append(True, keys[1:] != keys[:-1])
        n = np.add.reduceat(n, np.flatnonzero(fresh)) if len(keys) else n
        keys, rare = keys[fresh], rare[first][fresh]
        for b, i, j in runs(keys):
            yield b, pack_keys(keys[i:j]), planes(n[i:j], 4), squeeze(rare[i:j].astype("<u2"))

    sent = ask(held, questions, [("keys", pa.binary()), ("n", pa.binary()), ("rare", pa.binary())])
    kinds = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("n", pa.binary()), ("sums", pa.binary())])

    def answer(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        parts = [unpack_keys(x) for x in t.column("keys").to_pylist()]
        n = np.concatenate([unplanes(x, 4) for x in t.column("n").to_pylist()]).astype(np.int64)
        rare = np.concatenate([np.frombuffer(expand(x), "<u2") for x in t.column("rare").to_pylist()])
        keys, first, inverse = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
        total = np.bincount(inverse, n, minlength=len(keys)).astype(np.int64)
        rare = rare[first].astype(np.int64)
        top = np.flatnonzero(total >= least)
        full = keys[top] | np.uint64(bucket) << np.uint64(BITS)
        sums = np.concatenate([[total.sum(), (total > 0).sum(), (total == 1).sum()], np.bincount(rare, total, minlength=RARE)]).astype("<i8")
        best = np.concatenate([full.astype("<i8"), total[top], rare[top]]).astype("<i8")
        out, at = [], 0
        for k, (block, p) in enumerate(zip(t.column("block").to_pylist(), parts, strict=True)):
            own = total[inverse[at : at + len(p)]]
            out.append((block, bucket, planes(own, 5), squeeze(sums.tobytes() + best.tobytes()) if k == 0 else None))
            at += len(p)
        return table_of(out, kinds)

    replies = durable(sent.groupBy("bucket").applyInArrow(answer, "block long, bucket int, n binary, sums binary"))
    def merged(a: list[np.ndarray]) -> np.ndarray:
        best = np.concatenate([x[3 + RARE :].reshape(3, -1).T for x in a])
        return np.concatenate([np.sum([x[: 3 + RARE] for x in a], axis=0), best.T.ravel()])

    def merge(t: pa.Table) -> pa.Table:
        found = merged([np.frombuffer(expand(x), "<i8") for x in t.column("sums").to_pylist()])
        return table_of([(t.column("bucket")[0].as_py() // WIDTH, squeeze(found.astype("<i8")))], pa.schema([("bucket", pa.int32()), ("sums", pa.binary())]))

    sums, left = replies.where("sums IS NOT NULL").select("bucket", "sums"), 1 << bits
    while left > WIDTH:  # WIDTH buckets become one, until so few are left
        sums, left = sums.groupBy(F.floor(F.col("bucket") / WIDTH)).applyInArrow(merge, "bucket int, sums binary"), -(-left // WIDTH)
    a = merged([np.zeros(3 + RARE, np.int64), *(np.frombuffer(expand(r.sums), "<i8") for r in sums.collect())])
    total, best = a[: 3 + RARE], a[3 + RARE :].reshape(3, -1).T
    best = best[np.argsort(best[:, 0].astype(np.uint64))]
    rest = total[3:].copy()
    np.subtract.at(rest, best[:, 2], best[:, 1])
    weight = np.concatenate([best[:, 1], rest])
    order = np.argsort(-weight, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return replies, Counts(int(total[0]), int(total[1]), int(total[2]), best[:, 0].astype(np.uint64), rank[: len(best)], rank[len(best) :], weight[order])


def fit(held: DataFrame, counts: Counts, bits: int) -> Model:
    """A model that every training token has trained once, in ROUNDS averages over shards. Documents fall to shards and
    rounds by their ids and are taken in one order there, so that the partitions of the input change nothing."""
    model = Model.start(counts.weight)
    state = [*model.arrays(), *(np.full(a.shape, 1e-6, np.float32) for a in model.arrays())]  # with the squares of the steps
    noise = np.maximum(counts.weight, 0.1) ** 0.75
    noise = noise / noise.sum()
    shards = max(1, -(-counts.total // SHARD))
    dealt_kinds = pa.schema([("turn", pa.int64()), ("shard", pa.int64()), ("docs", pa.binary()), ("sizes", pa.binary()), ("symbols", pa.binary())])
    kinds = pa.schema([("part", pa.int32()), ("shard", pa.int64()), ("n", pa.int64()), ("values", pa.binary())])
    ddl = "part int, shard long, n long, values binary"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                block = Block.of(b, k)
                h, index, rare = tokens(block)
                symbols = counts.symbols(short(h, bits), rare).astype("<u4")
                by: dict[tuple[int, int], list[int]] = {}
                for d in np.flatnonzero(~held_out(block.doc_ids)).tolist():
                    turn, shard = divmod(zlib.crc32(str(block.doc_ids[d]).encode()) // FOLDS, shards)
                    by.setdefault((turn % ROUNDS, shard), []).append(d)
                size = np.diff(index)
                found = [(t, s, block.doc_ids[ds].astype("<i8").tobytes(), size[ds].astype("<i8").tobytes(), planes(np.concatenate([symbols[index[d] : index[d + 1]] for d in ds]), 4)) for (t, s), ds in by.items()]
                if found:
                    yield from table_of(found, dealt_kinds).to_batches()

    def learner(turn: int, state: list[np.ndarray]):
        def learn(t: pa.Table) -> pa.Table:
            shard = t.column("shard")[0].as_py()
            docs, sizes = (np.concatenate([np.frombuffer(x, "<i8") for x in t.column(c).to_pylist()]) for c in ("docs", "sizes"))
            flat = np.concatenate([unplanes(x, 4).astype("<u4") for x in t.column("symbols").to_pylist()])
            ends = np.concatenate([[0], np.cumsum(sizes)])
            order = sorted(range(len(docs)), key=lambda d: (int(docs[d]), flat[ends[d] : ends[d + 1]].tobytes()))
            order = np.array(order)[np.random.default_rng([turn, shard]).permutation(len(order))]
            own = [a.copy() for a in state]
            model, memory, at, piece = Model(*own[: len(own) // 2]), own[len(own) // 2 :], 0, 0
            while at < len(order):  # documents of about PIECE tokens at a time
                to = max(at + 1, int(np.searchsorted(np.cumsum(sizes[order[at:]]), PIECE)) + at)
                some = order[at:to]
                symbols = np.concatenate([flat[ends[d] : ends[d + 1]] for d in some.tolist()]).astype(np.int64)
                train(model, contexts(symbols, np.concatenate([[0], np.cumsum(sizes[some])]), len(counts.weight)), symbols, noise, memory, np.random.default_rng([turn, shard, piece]))
                at, piece = to, piece + 1
            return table_of([(k, shard, int(sizes.sum()), squeeze(a.astype("<f4"))) for k, a in enumerate(own)], kinds)

        return learn

    def average(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t.column("shard").to_pylist(), t.column("n").to_pylist(), t.column("values").to_pylist(), strict=True))
        total = sum(n for _, n, _ in rows)
        a = sum(n / total * np.frombuffer(expand(v), "<f4").astype(float) for _, n, v in rows)
        return table_of([(t.column("part")[0].as_py(), rows[0][0] // WIDTH, total, squeeze(a.astype("<f4")))], kinds)

    dealt = durable(held.mapInArrow(deal, "turn long, shard long, docs binary, sizes binary, symbols binary"))
    for turn in range(ROUNDS):
        models, left = dealt.where(F.col("turn") == turn).groupBy("shard").applyInArrow(learner(turn, state), ddl), shards
        while left > 1:  # WIDTH models become one, until one is left
            models, left = models.groupBy("part", F.floor(F.col("shard") / WIDTH)).applyInArrow(average, ddl), -(-left // WIDTH)
        got = {r.part: np.frombuffer(expand(r["values"]), "<f4") for r in models.collect()}
        state = [got[k].reshape(a.shape).copy() if k in got else a for k, a in enumerate(state)]
    return Model(*state[: len(state) // 2])


def score_documents(docs: DataFrame) -> DataFrame:
    """SCHEMA of (doc_id, text)."""
    held = blocks(docs)
    bits = bucket_bits(held)
    replies, counts = count(held)
    model = fit(held, counts, bits)
    kinds = pa.schema([(x.split()[0], {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[x.split()[1]]) for x in SCHEMA.split(", ")])
    total, distinct = counts.total, counts.distinct
    unseen = min(0.5, max(1, counts.once) / max(2, total))

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block.of(left)
        h, index, rare = tokens(block)
        key = short(h, bits)
        n = dict(zip(right.column("bucket").to_pylist(), right.column("n").to_pylist(), strict=True))
        c = np.concatenate([unplanes(n[b], 5) for b in sorted(n)]).astype(np.int64)[np.unique(key, return_inverse=True)[1]]
        base = np.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))
        if total:
            symbols = counts.symbols(key, rare)
            p = model.log_probability(contexts(symbols, index, len(counts.weight)), symbols) / np.log(10)
            known = c > 0
            value = np.full(len(c), np.log10(unseen))
            value[known] = np.log10(1 - unseen) + p[known] + np.log10(c[known] / counts.weight[symbols[known]])
        else:
            value = base
        sums = lambda x: np.add.reduceat(x, index[:-1]) if len(x) else np.zeros(0)  # noqa: E731  every text has a token
        size = len(block.doc_ids)
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip([block.doc_ids, held_out(block.doc_ids), np.diff(index), sums((c > 0).astype(np.int64)), np.full(size, total), sums(base), sums(value)], kinds, strict=True)], schema=kinds)

    return held.groupBy("block").cogroup(replies.select("block", "bucket", "n").groupBy("block")).applyInArrow(scored, SCHEMA)


def op5_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", F.col("text")))


QUERIES = {"op5_log_bilinear": op5_log_bilinear}
ORACLE: dict[str, str] = {}
