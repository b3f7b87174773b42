"""Hierarchical packing of tokenised documents into windows of several lengths.

Each document's ids (plus an end id) are cut into full longest windows; the rest goes to the shortest tier that holds
it. Tiers are packed from the longest to the shortest: a window starts with the largest waiting piece, its gap takes
the largest pieces that fit from its own and shorter tiers, and the last gap takes a cut of a shorter piece, so every
window is full. What is left when a task ends fills windows of falling powers of two. Windows of one tier are dealt to
step groups so that attention cost is balanced. Pieces never leave the task that read them: no shuffle, and memory is
bounded by `WAITING` pieces.

Defined cases: null and empty texts are the end id alone; texts of any length are tokenised whole and cut over windows;
rows without doc_id are packed as any other, with a null doc_id; of pieces of equal length the one that came last goes
first; repeated rows are packed each on its own; an empty table gives an empty table; extra columns are ignored.
"""
from __future__ import annotations

import base64
import bisect
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ._common import table

TIERS = (256, 512, 1024, 2048)
#: Pieces that wait for a window before a task packs them; windows in a step group.
WAITING, STEP = 4096, 8
END = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
#: A run of white space that goes through the tokenizers library.
LONG_RUN = 1000
_RUN, _LONG = re.compile(r"\s\s"), re.compile(rf"\s{{{LONG_RUN}}}")


class Ids:
    """Token ids of whole texts as the tokenizers library gives them from `tokenizer`, a byte-level BPE whose vocabulary
    `ranks` has as ranks and whose splitting rule is `pattern`. Tiktoken makes them from the ranks in a fifth of the
    library's time. Only runs of white space need the rule's look-ahead, so texts without such runs are split by the rule
    without it, which is faster and gives the same; a text with a run of LONG_RUN or more, which overflows that look-ahead's
    stack, goes through the library. Added tokens are found first, as the library does, and have one id each."""

    def __init__(self, ranks: str, pattern: str, tokenizer: str) -> None:
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        head, ahead, _ = pattern.rpartition(r"|\s+(?!\S)|\s+")
        full = tiktoken.Encoding("full", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        plain = tiktoken.Encoding("plain", pat_str=head + r"|\s", mergeable_ranks=table, special_tokens={}).encode_ordinary if ahead else full
        self.encode = lambda text: full(text) if _RUN.search(text) else plain(text)
        self.added, self.tokenizer, self.library = dict(added_tokens(tokenizer)), tokenizer, None
        self.split = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None

    def slow(self, text: str) -> list[int]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.tokenizer)
        return self.library.encode(text, add_special_tokens=False).ids

    def of(self, text: str) -> bytes:
        if _LONG.search(text):
            ids = self.slow(text)
        elif self.split and len(parts := self.split.split(text)) > 1:  # every second part is an added token
            ids = [i for k, part in enumerate(parts) for i in ([self.added[part]] if k % 2 else self.encode(part))]
        else:
            ids = self.encode(text)
        return np.asarray(ids, "<u4").tobytes()


_IDS: dict[tuple, Ids] = {}


def shared_ids(ranks: str, pattern: str, tokenizer: str) -> Ids:
    """One for each Python worker."""
    if (ranks, pattern, tokenizer) not in _IDS:
        _IDS[ranks, pattern, tokenizer] = Ids(ranks, pattern, tokenizer)
    return _IDS[ranks, pattern, tokenizer]


def added_tokens(path: str) -> tuple[tuple[str, int], ...]:
    """(content, id) of the added tokens of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    if any(t[k] for t in tokens for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"added tokens of {path} are not plain texts")
    return tuple((t["content"], t["id"]) for t in tokens)


class Packer:
    """Windows from pieces (row, start, length); `rows` has (doc_id, ids as bytes) of each waiting row."""

    def __init__(self, first: int, tiers: tuple[int, ...] = TIERS, step: int = STEP) -> None:
        self.tiers, self.step, self.next, self.group = tuple(sorted(tiers)), step, first, first
        self.waiting: list[tuple[int, int, int]] = []  # (length, row, start), by length
        self.rows: dict[int, tuple[int, bytes]] = {}
        self.seen = 0
        self.windows: list[tuple[int, list[tuple[int, int, int]]]] = []

    def add(self, doc_id: int, ids: bytes) -> None:
        n, top, row = len(ids) // 4, self.tiers[-1], self.seen
        self.seen += 1
        self.rows[row] = (doc_id, ids)
        for start in range(0, n - n % top, top):
            self.windows.append((top, [(top, row, start)]))
        if n % top:
            bisect.insort(self.waiting, (n % top, row, n - n % top))

    def fill(self, size: int, first: tuple[int, int, int] | None) -> list[tuple[int, int, int]]:
        out, gap = ([first], size - first[0]) if first else ([], size)
        while gap and self.waiting:
            k = bisect.bisect_right(self.waiting, (gap, 1 << 62, 0))
            if k:
                piece = self.waiting.pop(k - 1)
            else:  # all are longer: cut the shortest
                length, row, start = self.waiting.pop(0)
                piece = (gap, row, start)
                bisect.insort(self.waiting, (length - gap, row, start + gap))
            out.append(piece)
            gap -= piece[0]
        return out

    def pack(self, last: bool) -> None:
        total = sum(p[0] for p in self.waiting)
        for k in range(len(self.tiers) - 1, -1, -1):
            size, below = self.tiers[k], self.tiers[k - 1] if k else 0
            while self.waiting and below < self.waiting[-1][0] <= size <= total:
                self.windows.append((size, self.fill(size, self.waiting.pop())))
                total -= size
        if last:
            while total:
                size = 1 << (total.bit_length() - 1)
                self.windows.append((size, self.fill(size, None)))
                total -= size

    def flush(self, last: bool) -> Iterator[tuple]:
        self.pack(last)
        totals = {r: len(ids) // 4 for r, (_, ids) in self.rows.items()}
        by_tier: dict[int, list] = {}
        for size, pieces in self.windows:
            by_tier.setdefault(size, []).append((sum(p[0] ** 2 for p in pieces), pieces))
        for size in sorted(by_tier, reverse=True):
            windows = sorted(by_tier[size], key=lambda w: -w[0])
            groups = -(-len(windows) // self.step)
            for i, (_, pieces) in enumerate(windows):
                turn, place = divmod(i, groups)
                group, offset = self.group + (place if turn % 2 == 0 else groups - 1 - place), 0
                for length, row, start in pieces:
                    doc_id, ids = self.rows[row]
                    yield doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), totals[row], self.next, offset, size, group
                    offset += length
                self.next += 1
            self.group += groups
        self.windows = []
        held = {p[1] for p in self.waiting}
        self.rows = {r: x for r, x in self.rows.items() if r in held}


def pack_documents(docs: DataFrame, ranks: str, pattern: str, tokenizer: str, tiers: tuple[int, ...] = TIERS, end: int = END) -> DataFrame:
    """Pieces of all documents (doc_id, text): SCHEMA. `ranks`, `pattern` and `tokenizer` are as in Ids."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    last_id = np.asarray([end], "<u4").tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, packer = shared_ids(ranks, pattern, tokenizer), Packer(TaskContext.get().partitionId() << 32, tiers)
        schema = pa.schema([(n, pa.int32() if n == "tier" else pa.int64()) for n in names])

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            if found := list(packer.flush(last)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), schema.types, strict=True)], schema=schema)

        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    packer.add(doc_id, ids.of(text or "") + last_id)
                if len(packer.waiting) + len(packer.windows) >= WAITING:
                    yield from out(False)
        yield from out(True)

    return docs.select("doc_id", "text").mapInArrow(rows, SCHEMA)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op2_packing": op2_packing}
ORACLE: dict[str, str] = {}
