"""Document quality by weak supervision: rules vote or abstain, and expectation-maximisation weighs their votes.

Counts of each whole text are made in numpy. A rule calls a text good or bad, or abstains where its counts say nothing.
Each rule has two unknown rates: how often it calls good texts good, and bad ones bad. Texts with the same votes are
alike to the model, so it is fitted on the number of texts of each pattern of votes (3 ** rules at most, whatever the
input); every text counts. The posterior probability of being good decides, in place of a text's having to pass all.
Starting beliefs weigh as PRIOR_SHARE of all texts, so that the fit behaves alike at every size. A rule that would say
less than chance counts as saying nothing.

Defined cases: a null text has no words; texts without words or with fewer than 20 fail the base, as do repetitive ones;
repeated rows count each; a null id is kept; an empty table gives an empty table; extra columns are ignored; a text is
counted whole, and needs memory in proportion to its length. Words of a window are compared by 64-bit hashes.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from ._common import durable, table

WINDOW = 8
#: Counts of a text: words; code points in them; symbols, capitals A-Z, letters (A-Z, a-z and all beyond ASCII), code points
#: beyond ASCII, exclamation and question marks; words with a letter; words equal to the one before; words in repeated
#: windows; lines with a word, those equal to an earlier line, those that end in a mark.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_letters", "n_beyond", "n_marks", "n_letter_words", "n_stutter_words", "n_repeat_words", "n_lines", "n_dup_lines", "n_ended_lines")
SPACES = " \t\n\v\f\r"


@dataclass(frozen=True)
class Rule:
    """What it calls bad, what good, as conditions on the counts, and where it may vote."""
    name: str
    bad: str
    good: str
    where: str = "n_words > 0"


RULES = (
    Rule("symbols", "10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    Rule("letters", "100 * n_letters < 75 * word_chars", "100 * n_letters >= 85 * word_chars"),
    Rule("letter_words", "10 * n_letter_words < 8 * n_words", "10 * n_letter_words >= 9 * n_words"),
    Rule("capitals", "10 * n_capitals > 4 * n_letters", "10 * n_capitals <= 2 * n_letters", "n_letters >= 20"),
    Rule("marks", "4 * n_marks > n_words", "20 * n_marks <= n_words"),
    Rule("repeats", "5 * n_repeat_words > n_words", "20 * n_repeat_words <= n_words", "n_words >= 16"),
    Rule("stutter", "10 * n_stutter_words > n_words", "50 * n_stutter_words <= n_words", "n_words >= 16"),
    Rule("lines", "10 * n_dup_lines > 3 * n_lines", "10 * n_dup_lines <= n_lines", "n_lines >= 2"),
    Rule("length", "word_chars > 9 * n_words OR word_chars < 3 * n_words", "word_chars <= 8 * n_words AND word_chars >= 4 * n_words", "n_words >= 16 AND 2 * n_beyond <= word_chars"),
    Rule("ends", "10 * n_ended_lines < 3 * n_lines", "10 * n_ended_lines >= 7 * n_lines", "n_words >= 16"),
)
#: Beliefs at the start: good texts that a rule calls good, bad ones that it calls bad, good texts of all; their weight as
#: a share of all texts; rounds; the posterior from which a text is kept.
GOOD, BAD, PRIOR, PRIOR_SHARE, ROUNDS, LEAST = 0.98, 0.3, 0.9, 0.001, 40, 0.5
BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"


def _flags(*characters: str) -> np.ndarray:
    flag = np.zeros(256, bool)
    flag[[ord(c) for c in "".join(characters)]] = True
    return flag


_SYMBOL, _MARK, _CAPITAL = _flags("#*$%&|<>"), _flags("!?"), _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_FIRST = (np.arange(256) & 0xC0) != 0x80  # a code point's first byte
_BEYOND = np.arange(256) >= 0xC0  # first bytes of code points beyond ASCII
_LETTER = _CAPITAL | _flags("abcdefghijklmnopqrstuvwxyz") | _BEYOND


def line_counts(text: str) -> tuple[int, int, int]:
    """Lines with a word; those equal to an earlier line; those whose last character other than white space is a mark."""
    seen, n, same, ended = set(), 0, 0, 0
    for line in text.split("\n"):
        if bare := line.rstrip(SPACES):
            n += 1
            same += line in seen
            seen.add(line)
            ended += bare[-1] in ".!?"
    return n, same, ended


def repeated(h: np.ndarray, index: np.ndarray, n: int = WINDOW) -> np.ndarray:
    """Whether each word lies in a window of n words that its text holds twice or more."""
    at, own = words.inside(index, n)
    g = words.shingles(h, n)[at] if len(at) else np.zeros(0, np.uint64)
    order = words.by(g, own)
    g, o = g[order], own[order]
    same = (g[1:] == g[:-1]) & (o[1:] == o[:-1])
    twice = np.zeros(len(g), bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(len(h) + 1, np.int64)
    np.add.at(covered, at[order[twice]], 1)
    np.add.at(covered, at[order[twice]] + n, -1)
    return np.cumsum(covered)[:-1] > 0


def counts(column: pa.Array) -> np.ndarray:
    """(texts, COUNTS) of some texts."""
    data, ends = words.buffers(column)
    per = lambda flag, at: np.diff(np.concatenate([[0], np.cumsum(flag)])[at])
    starts, stops, index = words.bounds(data, ends)
    h, _, _ = words.hashes(data, ends)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[stops] -= 1
    word = np.cumsum(inside[:-1]).astype(bool)
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    stutter = np.zeros(len(h), bool)
    stutter[1:] = h[1:] == h[:-1]
    stutter[index[:-1][index[:-1] < len(h)]] = False
    lines = np.array([line_counts(t) for t in column.fill_null("").to_pylist()], np.int64).reshape(-1, 3).T
    return np.stack([
        np.diff(index), per(_FIRST[data] & word, ends), per(_SYMBOL[data], ends), per(_CAPITAL[data], ends), np.diff(letters[ends]), per(_BEYOND[data], ends), per(_MARK[data], ends),
        per(letters[stops] > letters[starts], index), per(stutter, index), per(repeated(h, index), index), *lines,
    ], axis=1)


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, COUNTS) of rows (doc_id, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(b.column(1)), 0)).astype(np.int64)
            piece = np.cumsum(size) // words.CHUNK  # some texts at a time
            for p in np.unique(piece):
                first, last = np.searchsorted(piece, p), np.searchsorted(piece, p, side="right")
                some = b.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([some.column(0), *map(pa.array, counts(some.column(1)).T.astype(np.int64))], names=["doc_id", *COUNTS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, ", ".join(f"{c} long" for c in ("doc_id", *COUNTS)))


def ballot(rule: Rule) -> str:
    """+ good, - bad, 0 abstains, as SQL."""
    return f"CASE WHEN NOT ({rule.where}) THEN '0' WHEN {rule.bad} THEN '-' WHEN {rule.good} THEN '+' ELSE '0' END"


def fit(votes: list[str], n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of each pattern, rates of good calls on good texts, of bad calls on bad texts)."""
    plus, minus = (np.array([[v == sign for v in p] for p in votes], float).reshape(len(votes), -1) for sign in "+-")
    weight, prior, good, bad = PRIOR_SHARE * n.sum(), PRIOR, np.full(plus.shape[1], GOOD), np.full(plus.shape[1], BAD)
    for last in range(rounds + 1):
        odds = np.log(prior / (1 - prior)) + plus @ np.log(good / (1 - bad)) + minus @ np.log((1 - good) / bad)
        p = 1 / (1 + np.exp(-odds))
        if last == rounds:
            return p, good, bad
        prior = (n @ p + weight * PRIOR) / (n.sum() + weight)
        good = ((n * p) @ plus + weight * GOOD) / ((n * p) @ (plus + minus) + weight)
        bad = ((n * (1 - p)) @ minus + weight * BAD) / ((n * (1 - p)) @ (plus + minus) + weight)
        pooled = (n @ plus + weight * GOOD) / (n @ (plus + minus) + weight)
        good, bad = np.where(good + bad < 1, pooled, good), np.where(good + bad < 1, 1 - pooled, bad)


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, COUNTS, votes, base_failed, posterior, kept) of rows (doc_id, text)."""
    found = durable(counted(docs).withColumn("votes", F.concat(*[F.expr(ballot(r)) for r in rules])))
    patterns = found.groupBy("votes").count().collect()  # 3 ** len(rules) rows at most
    posterior, _, _ = fit([r.votes for r in patterns], np.array([r["count"] for r in patterns], float)) if patterns else ([], 0, 0)
    known = docs.sparkSession.createDataFrame([(r.votes, float(p)) for r, p in zip(patterns, posterior, strict=True)], "votes string, posterior double")
    failed = F.expr(BASE_FAILED)
    return found.join(F.broadcast(known), "votes").withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("posterior") >= LEAST))


def op12_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "votes", F.round("posterior", 6).alias("posterior"))


def _sql() -> str:
    """The counts from lists of words and lines, then a step for each round of the fit."""
    size = lambda pattern: f"len(regexp_extract_all(t, '{pattern}'))"
    total = lambda value, at: f"list_sum([CASE WHEN {value} THEN 1 ELSE 0 END FOR {at}])"
    steps = [rf"""d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM d),
g AS MATERIALIZED (SELECT r, k, array_to_string(w[k:k + {WINDOW - 1}], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, len(w) - {WINDOW - 2})) AS k)),
m AS MATERIALIZED (SELECT r, count(DISTINCT k + o) AS n FROM (SELECT r, k FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1), (SELECT unnest(range({WINDOW})) AS o) GROUP BY r),
c AS MATERIALIZED (SELECT r, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars,
{size('[#*$%&|<>]')} AS n_symbols, {size('[A-Z]')} AS n_capitals, {size('[A-Za-z]|[^\\x00-\\x7F]')} AS n_letters, {size('[^\\x00-\\x7F]')} AS n_beyond, {size('[!?]')} AS n_marks,
coalesce({total(r"regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]')", 'x IN w')}, 0)::BIGINT AS n_letter_words, coalesce({total('w[i] = w[i - 1]', 'i IN range(2, len(w) + 1)')}, 0)::BIGINT AS n_stutter_words,
coalesce(n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce({total(r"regexp_matches(x, '[.!?][\x20\x09-\x0D]*$')", 'x IN l')}, 0)::BIGINT AS n_ended_lines
FROM w LEFT JOIN m USING (r)),
v AS MATERIALIZED (SELECT *, {' || '.join(ballot(r) for r in RULES)} AS votes FROM c),
n AS MATERIALIZED (SELECT votes, count(*)::DOUBLE AS n, sum(count(*)) OVER ()::DOUBLE AS total FROM v GROUP BY votes)"""]
    own = range(len(RULES))
    steps.append(f"t0 AS MATERIALIZED (SELECT {PRIOR}::DOUBLE AS prior, " + ", ".join(f"{GOOD}::DOUBLE AS g{k}, {BAD}::DOUBLE AS b{k}" for k in own) + ")")
    for i in range(ROUNDS + 1):
        odds = " + ".join(["ln(prior / (1 - prior))", *[f"CASE votes[{k + 1}] WHEN '+' THEN ln(g{k} / (1 - b{k})) WHEN '-' THEN ln((1 - g{k}) / b{k}) ELSE 0 END" for k in own]])
        steps.append(f"p{i} AS MATERIALIZED (SELECT votes, n, total, 1 / (1 + exp(-({odds}))) AS p FROM n, t{i})")
        if i < ROUNDS:
            s = f"{PRIOR_SHARE} * max(total)"
            rate = lambda weight, sign, believed, k: f"(coalesce(sum({weight}) FILTER (votes[{k + 1}] = '{sign}'), 0) + {s} * {believed}) / (coalesce(sum({weight}) FILTER (votes[{k + 1}] <> '0'), 0) + {s})"
            steps.append(f"s{i} AS MATERIALIZED (SELECT (sum(n * p) + {s} * {PRIOR}) / (max(total) + {s}) AS prior, " + ", ".join(f"{rate('n * p', '+', GOOD, k)} AS g{k}, {rate('n * (1 - p)', '-', BAD, k)} AS b{k}, {rate('n', '+', GOOD, k)} AS m{k}" for k in own) + f" FROM p{i})")
            steps.append(f"t{i + 1} AS MATERIALIZED (SELECT prior, " + ", ".join(f"CASE WHEN g{k} + b{k} < 1 THEN m{k} ELSE g{k} END AS g{k}, CASE WHEN g{k} + b{k} < 1 THEN 1 - m{k} ELSE b{k} END AS b{k}" for k in own) + f" FROM s{i})")
    return "WITH " + ",\n".join(steps) + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE_FAILED}) AS base_failed, NOT ({BASE_FAILED}) AND p >= {LEAST} AS kept, votes, round(p, 6) AS posterior FROM v JOIN p{ROUNDS} USING (votes)"""


QUERIES = {"op12_weak_supervision": op12_weak_supervision}
ORACLE = {"op12_weak_supervision": _sql()}
