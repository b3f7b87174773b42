"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text's spaces become the mark U+2581, with one in front. Adjacent symbols whose concatenation is a piece form an
agenda ordered by the piece's score, then by place; the first entry is merged until none is left; what is no piece is
spelled as bytes. No piece holds the mark after another character, so a text is encoded mark by mark, each distinct
part once. All new parts of an Arrow batch go through the agenda together (long ones through a heap) and are compared
with the sentencepiece library, which raises on any difference; decoding is the library's.

Defined cases: null and empty texts are the begin and end ids alone; repeated rows are encoded each; an empty table
gives an empty table; extra columns are ignored.
"""
from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import table

MARK = "▁"
#: Parts that a worker keeps with their ids; symbols from which a part goes through the heap.
CACHED, LONG = 400_000, 64
NONE = np.int64(1) << 40


class Pieces:
    def __init__(self, model: str) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = self.size = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        names = [sp.id_to_piece(i) for i in range(n)]
        if any(MARK in x.lstrip(MARK) for x, s in zip(names, special, strict=True) if not s):
            raise ValueError("a piece holds the mark after another character")
        self.ids = {x: i for i, (x, s) in enumerate(zip(names, special, strict=True)) if not s and not sp.is_unused(i)}
        self.score = {x: sp.get_score(i) for x, i in self.ids.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        # symbols: the pieces' ids, and beyond them single characters that are no piece
        chars = sorted({c for x in self.ids for c in x} - self.ids.keys())
        symbol = self.ids | {c: n + k for k, c in enumerate(chars)}
        self.other = n + len(chars)
        self.base = np.int64(self.other + 1)
        self.symbols = np.full(0x110000, self.other, np.int32)
        for x, i in symbol.items():
            if len(x) == 1:
                self.symbols[ord(x)] = i
        rank = {s: k for k, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        pairs = sorted((symbol[x[:k]] * int(self.base) + symbol[x[k:]], rank[self.score[x]], i) for x, i in self.ids.items() for k in range(1, len(x)) if x[:k] in symbol and x[k:] in symbol)
        self.keys, self.ranks, self.merged = (np.array(c, np.int64) for c in zip(*pairs, strict=True))
        self.known: dict[str, bytes] = {}
        self.parts = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def spell(self, symbol: str) -> list[int]:
        i = self.ids.get(symbol)
        return [self.bytes[b] for b in symbol.encode()] if i is None else [i]

    def agenda(self, part: str) -> list[int]:
        """The merges of one part by a heap of (score, place); entries whose symbols have changed are passed over."""
        sym: list[str | None] = list(part)
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(a: int, b: int) -> None:
            if 0 <= a and b < len(sym) and (s := self.score.get(x := sym[a] + sym[b])) is not None:
                heapq.heappush(heap, (-s, a, x))

        for k in range(len(sym) - 1):
            offer(k, k + 1)
        while heap:
            _, a, x = heapq.heappop(heap)
            b = after[a]
            if sym[a] is None or b >= len(sym) or sym[a] + sym[b] != x:
                continue
            sym[a], sym[b], after[a] = x, None, after[b]
            if after[b] < len(sym):
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [i for x in sym if x is not None for i in self.spell(x)]

    def together(self, parts: list[str]) -> list[bytes]:
        """The merges of many short parts: in each round every part makes the first merge of its agenda."""
        points = np.frombuffer("".join(parts).encode("utf-32-le"), "<u4")
        own = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        sym, char = self.symbols[points].astype(np.int64), points
        done = []
        while len(sym):
            key = sym[:-1] * self.base + sym[1:]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            fits = (self.keys[at] == key) & (own[1:] == own[:-1])
            rank = np.append(np.where(fits, self.ranks[at], NONE), NONE)
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(sym)))
            best_of = np.repeat(best, size)
            ended = best_of == NONE
            if ended.any():
                done.append((own[ended], sym[ended], char[ended]))
            hits = np.flatnonzero((rank == best_of) & ~ended)
            hits = hits[np.append(True, own[hits[1:]] != own[hits[:-1]])] if len(hits) else hits
            sym[hits] = self.merged[at[hits]]
            keep = ~ended
            keep[hits + 1] = False
            sym, own, char = sym[keep], own[keep], char[keep]
        own, sym, char = (np.concatenate(c) for c in zip(*done, strict=True)) if done else (own, sym, char)
        order = np.argsort(own, kind="stable")
        own, sym, char = own[order], sym[order], char[order]
        spelled = np.flatnonzero(sym >= self.size)
        ends = np.cumsum(np.bincount(own, minlength=len(parts)))
        if len(spelled):  # characters that are no piece
            new, at = [], 0
            grown = np.zeros(len(parts), np.int64)
            for k in spelled.tolist():
                ids = self.spell(chr(char[k]))
                new += [sym[at:k], np.array(ids, np.int64)]
                grown[own[k]] += len(ids) - 1
                at = k + 1
            sym, ends = np.concatenate([*new, sym[at:]]), ends + np.cumsum(grown)
        held, at, out = sym.astype("<u4").tobytes(), 0, []
        for end in (4 * ends).tolist():
            out.append(held[at:end])
            at = end
        return out

    def learn(self, new: list[str]) -> None:
        short = [p for p in new if len(p) < LONG]
        self.known.update(zip(short, self.together(short), strict=True))
        self.known.update((p, np.array(self.agenda(p), "<u4").tobytes()) for p in new if len(p) >= LONG)
        # the library puts a mark in front of its own
        asked = [p for p in new if p[0] == MARK and len(p) > 1]
        for p, ids in zip(asked, self.library.encode([p[1:].replace(MARK, " ") for p in asked], num_threads=1), strict=True):
            if np.array(ids, "<u4").tobytes() != self.known[p]:
                raise ValueError(f"the library encodes {p!r} otherwise")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers, with begin and end."""
        parts = [self.parts.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.known) > CACHED:
            self.known.clear()
        if new := set().union(*parts).difference(self.known):
            self.learn(list(new))
        a, b = (np.array([i], "<u4").tobytes() for i in (self.library.bos_id(), self.library.eos_id()))
        return [a + b"".join(map(self.known.__getitem__, p)) + b for p in parts]

    def decode(self, ids: list[bytes]) -> list[str]:
        return self.library.decode([np.frombuffer(x, "<u4").tolist() for x in ids], num_threads=1)


_PIECES: dict[str, Pieces] = {}


def shared_pieces(model: str) -> Pieces:
    """One for each Python worker."""
    if model not in _PIECES:
        _PIECES[model] = Pieces(model)
    return _PIECES[model]


def encode_documents(docs: DataFrame, model: str, whole: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of (doc_id, text); with `whole`, also ids and decoded."""
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("ids", pa.list_(pa.int64())), ("decoded", pa.string())] if whole else []

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared_pieces(model)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                ids = pieces.encode([t or "" for t in part.column(1).to_pylist()])
                decoded = pieces.decode(ids)
                columns = [part.column(0).cast(pa.int64()), [len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(t.encode()).hexdigest() for t in decoded]]
                columns += [[np.frombuffer(x, "<u4").tolist() for x in ids], decoded] if whole else []
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], schema=pa.schema(fields))

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * whole)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op6_sentencepiece": op6_sentencepiece}
ORACLE: dict[str, str] = {}
