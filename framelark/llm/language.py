"""Language identification by cross-parsing.

A suffix automaton of labelled text stands for each language. A text is parsed into the longest phrases that occur
there; phrases times the logarithm of the labelled text's length, for each symbol, estimate the cross-entropy, and the
language with the least wins. Symbols are letters (lower case, as UTF-8 bytes); all else is one space. Every whole text
is parsed; its stretches of `STRETCH` symbols are parsed side by side in numpy, and no phrase crosses their ends.

Defined cases: null texts and texts without a letter are `und` with score 0; repeated rows give equal rows; ties go to
the first language by name; with no labelled text all is `und`; an empty table gives an empty table; extra columns are
ignored.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ._common import table

#: Bytes of labelled text of each language that its automaton is built from, at most; symbols of a stretch.
SAMPLE, STRETCH = 60_000, 512
UNKNOWN = "und"
_TO = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def symbols(text: str) -> bytes:
    return b" ".join(text.encode().translate(_TO).split())


def automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of `data`: state 0 is the start."""
    after: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in data:
        cur = len(after)
        after.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in after[p]:
            after[p][c] = cur
            p = link[p]
        if p >= 0:
            q = after[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(after)
                after.append(dict(after[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and after[p].get(c) == q:
                    after[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return after


@dataclass
class Parser:
    """For each language a table of (next state * 4 + phrases ended) by state and symbol."""
    languages: list[str]
    classes: np.ndarray
    tables: list[np.ndarray]
    scale: list[float]

    @classmethod
    def of(cls, labelled: dict[str, bytes]) -> Parser:
        used = sorted(set().union(*labelled.values()))
        classes = np.zeros(256, np.uint8)
        classes[used] = np.arange(1, len(used) + 1)
        tables, width = [], len(used) + 1
        for name in sorted(labelled):
            after = automaton(labelled[name])
            root = np.full(width, -1, np.int64)
            for c, s in after[0].items():
                root[classes[c]] = s
            # a symbol that does not go on ends the phrase and starts the next; one that nothing holds is a phrase
            t = np.tile(np.where(root < 0, 2, root * 4 + 1), (len(after), 1))
            t[0] = np.where(root < 0, 1, root * 4)
            rows = np.repeat(np.arange(len(after)), [len(a) for a in after])
            t[rows, classes[[c for a in after for c in a]]] = 4 * np.array([s for a in after for s in a.values()])
            tables.append(t.astype(np.int32).ravel())
        names = sorted(labelled)
        return cls(names, classes, tables, [math.log2(max(2, len(labelled[n]))) for n in names])

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases by text and language."""
        out = np.zeros((len(texts), len(self.tables)))
        length = np.array([len(t) for t in texts])
        n = -(-length // STRETCH)
        if not n.sum():
            return out
        own = np.repeat(np.arange(len(texts)), n)
        flat = np.zeros((int(n.sum()), STRETCH), np.uint8)
        sizes = np.full(len(flat), STRETCH)
        ends = np.cumsum(n)[n > 0] - 1
        sizes[ends] = length[n > 0] - (n[n > 0] - 1) * STRETCH
        joined = np.frombuffer(b"".join(t + bytes(-len(t) % STRETCH) for t in texts), np.uint8)
        flat[:] = self.classes[joined].reshape(-1, STRETCH)
        order = np.argsort(-sizes, kind="stable")
        flat, sizes, own = np.ascontiguousarray(flat[order].T), sizes[order], own[order]
        running = np.searchsorted(-sizes, -np.arange(STRETCH), side="left")  # rows with more symbols than j
        width = self.classes.max() + 1
        for k, t in enumerate(self.tables):
            state, cost = np.zeros(len(own), np.int32), np.zeros(len(own), np.int32)
            for j in range(STRETCH):
                m = running[j]
                if not m:
                    break
                v = t[state[:m] * np.int32(width) + flat[j, :m]]
                cost[:m] += v & 3
                state[:m] = v >> 2
            out[:, k] = np.bincount(own, cost + (state > 0), minlength=len(texts))
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        import regex

        letter = regex.compile(r"\p{L}")
        held = [symbols(t) if t else b"" for t in texts]
        cost = self.phrases(held) * np.array(self.scale) if self.tables else np.zeros((len(texts), 1))
        out = []
        for text, c in zip(texts, cost, strict=True):
            if not self.tables or not text or not letter.search(text):
                out.append((UNKNOWN, 0.0))
                continue
            best = int(c.argmin())
            second = float(np.delete(c, best).min()) if len(c) > 1 else math.inf
            out.append((self.languages[best], 1.0 - float(c[best]) / second if second > 0 else 0.0))
        return out


_PARSERS: dict[tuple, Parser] = {}


def shared_parser(labelled: dict[str, bytes]) -> Parser:
    """One for each Python worker; automata are built where they are used."""
    key = tuple(sorted((k, hash(v)) for k, v in labelled.items()))
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = Parser.of(labelled)
    return _PARSERS[key]


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, bound: int = SAMPLE) -> dict[str, bytes]:
    """Up to `bound` symbols of whole texts of each language, taken in the order of a hash of doc_id and text."""
    train = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("at", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)))
    sizes = train.groupBy("lang").agg(F.sum(F.length("text")).alias("n"), F.min(F.length("text")).alias("least")).collect()  # one row a language
    chosen = None
    for r in sizes:
        part = (F.col("lang") == r.lang) & (F.col("at") < int(min(1.0, 4 * bound / max(1, r.n)) * (1 << 30)))
        chosen = part if chosen is None else chosen | part
    taken: dict[str, list[bytes]] = {}
    room = {r.lang: bound for r in sizes}
    shortest: dict[str, bytes] = {}
    # about four times the bound for each language reaches the driver
    rows = train.where(chosen).where(F.length("text") <= 4 * bound).select("lang", "at", "doc_id", "text").collect() if sizes else []
    for r in sorted(rows, key=lambda r: (r["at"], r["text"])):
        s = symbols(r["text"])
        if len(s) < room[r.lang]:
            taken.setdefault(r.lang, []).append(s)
            room[r.lang] -= len(s) + 1
        if s and (r.lang not in shortest or len(s) < len(shortest[r.lang])):
            shortest[r.lang] = s
    out = {k: b" ".join(v) for k, v in taken.items() if any(v)}
    for k, s in shortest.items():
        out.setdefault(k, s)
    for r in sizes:  # a language whose sample came out empty
        if r.lang not in out:
            first = train.where(F.col("lang") == r.lang).orderBy(F.length("text").desc() if r.n < bound else F.abs(F.length("text") - bound // 8), "at").select("text").limit(1).collect()
            if first and (s := symbols(first[0]["text"])):
                out[r.lang] = s
    return out


def identify(docs: DataFrame, labelled: dict[str, bytes]) -> DataFrame:
    """All columns of docs with lang_pred and score, from the text alone."""
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    at = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = shared_parser(labelled)
        for b in batches:
            got = parser.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(rows, schema)


def accepted(docs: DataFrame, labelled: dict[str, bytes]) -> DataFrame:
    """The rows of docs, with all their columns, whose text has a letter; a null lang is filled in with the
    nearest learned language, however far."""
    at, lang = docs.columns.index("text"), docs.columns.index("lang")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = shared_parser(labelled)
        for b in batches:
            got = [g[0] for g in parser.predict(b.column(at).to_pylist())]
            filled = pc.coalesce(b.column(lang).cast(pa.string()), pa.array(got, pa.string()))
            whole = pa.RecordBatch.from_arrays([filled if k == lang else c for k, c in enumerate(b.columns)], names=b.schema.names)
            yield whole.filter(pa.array([g != UNKNOWN for g in got]))

    return docs.mapInArrow(rows, docs.schema)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs.select("doc_id", "text"), labelled_sample(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language": op4_language}
ORACLE: dict[str, str] = {}
