"""Secret scanning over an incremental blob ledger, in DataFrame operations only.

Every version of a path is addressed by the SHA-256 of its content. A ledger holds which (blob, rule@version)
pairs have been scanned and what they gave; a run scans only pairs that the ledger lacks, once per blob, and joins
the findings back to all paths that hold the blob.

Defined cases: a null text is the empty blob; an empty table gives an empty table; repeated rows and exact copies
share one blob and each row gets its findings; a ledger may hold a (blob, rule@version) more than once, as after a retried
append, and other versions of a rule, which are not looked at; texts are scanned whole, however long, and with many findings (places are
summed STRIDE at a time); findings that start together go in the order of the rules; extra columns are ignored by the digest and kept by `redact`.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import durable, shared_folder, table


@dataclass(frozen=True)
class Rule:
    """kind; Java pattern; group whose length counts; its least length; version of the pattern; base rules come first."""
    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1
    base: bool = True


RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    # a run of 16 (32) or more that starts where the unbounded run would start: the same matches, found faster
    Rule("access", r"AKIA[A-Z0-9]{12,}+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}+", 0, 32),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}+", 0, 40, base=False),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]+", 0, 0, base=False),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0, base=False),
)
SPAN = "array<struct<start:int,k:int,end:int,kind:string>>"
#: Values that a running sum takes at a time; code points of a piece of text; bytes of findings that are broadcast.
STRIDE, PIECE, BROADCAST = 64, 1024, 16 << 20


def before(df: DataFrame, values: list[str], merge: Callable[[Column, Column], Column]) -> DataFrame:
    """df with a column <v>_before for each array of whole numbers <v>: what merge (from 0 on) makes of all values before
    each. STRIDE values are taken at a time, so that no list grows by one for every value; each step is a column of its
    own, which is made once."""
    zero, stride, no_ints = F.lit(0), F.lit(STRIDE), F.array().cast("array<int>")

    def cut(v: Column) -> Column:
        at = F.when(F.size(v) > 0, F.sequence(zero, F.floor((F.size(v) - 1) / stride).cast("int"))).otherwise(no_ints)
        return F.transform(at, lambda c: F.slice(v, c * stride + 1, stride))

    def heads(parts: Column) -> Column:
        step = lambda acc, part: F.struct(F.aggregate(part, acc["at"], merge).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(parts, F.struct(zero.alias("at"), no_ints.alias("out")), step, lambda acc: acc["out"])

    def inner(v: str) -> Column:
        both = F.arrays_zip(F.col(f"{v}_cut").alias("part"), F.col(f"{v}_head").alias("head"))
        return F.flatten(F.transform(both, lambda z: F.transform(z["part"], lambda _, i: F.aggregate(F.slice(z["part"], 1, i), z["head"], merge))))

    df = df.withColumns({f"{v}_cut": cut(F.col(v)) for v in values})
    df = df.withColumns({f"{v}_head": heads(F.col(f"{v}_cut")) for v in values})
    return df.withColumns({f"{v}_before": inner(v) for v in values}).drop(*[f"{v}_{x}" for v in values for x in ("cut", "head")])


def with_matches(df: DataFrame, rules: tuple[Rule, ...], wanted: Callable[[Rule], Column]) -> DataFrame:
    """df (with `text`) and `found`: for each wanted(rule) its tag and what it matches, in code points. The pieces between
    matches give their places."""

    def pieces(rule: Rule) -> Column:
        kept = lambda hit: F.length(F.regexp_extract(hit, rule.pattern, rule.group) if rule.group else hit) >= rule.least
        both = F.arrays_zip(F.split("text", rule.pattern, -1).alias("gap"), F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)).alias("hit"))
        found = F.transform(both, lambda p: F.struct(F.length(p["gap"]).alias("gap"), F.coalesce(F.length(p["hit"]), F.lit(0)).alias("hit"), (p["hit"].isNotNull() & kept(p["hit"])).alias("kept")))
        return F.when(wanted(rule) & F.col("text").rlike(rule.pattern), found).otherwise(F.array().cast("array<struct<gap:int,hit:int,kept:boolean>>"))

    def found(rule: Rule, k: int) -> Column:
        placed = F.filter(F.arrays_zip(F.col(f"p{k}").alias("p"), F.col(f"n{k}_before").alias("at")), lambda x: x["p"]["kept"])
        start = lambda x: x["at"] + x["p"]["gap"]
        spans = F.transform(placed, lambda x: F.struct(start(x).alias("start"), (start(x) + x["p"]["hit"]).alias("end")))
        return F.when(wanted(rule), F.struct(F.lit(tag(rule)).alias("tag"), spans.alias("spans")))

    names, own = df.columns, range(len(rules))
    df = df.withColumns({f"p{k}": pieces(r) for k, r in enumerate(rules)})
    df = before(df.withColumns({f"n{k}": F.transform(f"p{k}", lambda p: p["gap"] + p["hit"]) for k in own}), [f"n{k}" for k in own], lambda a, b: a + b)
    return df.select(*names, F.array_compact(F.array(*[found(r, k) for k, r in enumerate(rules)])).alias("found"))


def address(versions: DataFrame, text: str = "text") -> DataFrame:
    """Adds `blob`, the SHA-256 of the content (null: of the empty text)."""
    return versions.withColumn("blob", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def tag(rule: Rule) -> str:
    return f"{rule.kind}@{rule.version}"


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Ledger rows (blob, tags, found: tag and spans of each rule) for the blobs of `versions` that lack a rule: only lacking rules,
    in the versions asked for, are scanned.

    `ledger` has the same columns; a blob may have several rows there, for each run that added rules and for runs that
    did the same at once or again.
    """
    blobs = address(versions.select(F.col(text).alias("text")), "text").groupBy("blob").agg(F.coalesce(F.first("text"), F.lit("")).alias("text"))
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("tags"))).alias("seen"))
        blobs = blobs.join(seen, "blob", "left")
    else:
        blobs = blobs.withColumn("seen", F.lit(None).cast("array<string>"))
    tags = F.array(*[F.lit(tag(r)) for r in rules])
    blobs = blobs.withColumn("seen", F.coalesce("seen", F.array().cast("array<string>"))).withColumn("tags", F.array_except(tags, "seen")).where(F.size("tags") > 0)
    return with_matches(blobs.select("blob", "tags", "text"), rules, lambda r: F.array_contains("tags", tag(r))).drop("text")


def update_ledger(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The ledger stored at `path`, after what it lacks of `versions` has been scanned and appended. There may be none yet."""
    spark = versions.sparkSession
    try:
        ledger = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        ledger = None
    scan_unseen(versions, ledger, rules, text).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def new_ledger(spark: SparkSession) -> str:
    """A place for a ledger in the shared folder."""
    return f"{shared_folder(spark)}/ledger-{uuid.uuid4()}"


def findings_by_path(versions: DataFrame, ledger: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of `versions` with the sorted spans that the ledger holds for its content from the given versions of rules;
    other versions' stay unused. What a ledger holds twice counts once. Blobs with findings are written before they are
    joined: broadcast, if they have few bytes, or else by a join whose hot blobs can be split."""
    none = F.from_json(F.lit("[]"), SPAN)
    order = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(tag(r)), F.struct(F.lit(k).alias("k"), F.lit(r.kind).alias("kind")))])
    asked = F.filter("found", lambda f: f["tag"].isin([tag(r) for r in rules]))
    span = lambda f, s: F.struct(s["start"].alias("start"), order[f["tag"]]["k"].alias("k"), s["end"].alias("end"), order[f["tag"]]["kind"].alias("kind"))
    # no filter below the aggregate: it would be pushed through the scan and repeat it
    blobs = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found")).withColumn("found", asked)
    found = durable(blobs.select("blob", F.array_sort(F.flatten(F.transform("found", lambda f: F.transform(f["spans"], lambda s: span(f, s))))).alias("spans")).where(F.size("spans") > 0))
    size = found.agg(F.sum(F.size("spans") * 40 + 100)).first()[0] or 0
    return address(versions, text).join(F.broadcast(found) if size <= BROADCAST else found, "blob", "left").withColumn("spans", F.coalesce("spans", none))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(df: DataFrame, spans: str = "spans", text: str = "text") -> DataFrame:
    """Replaces every span by [kind]; where spans overlap, the part that an earlier one covers stays with that one."""
    whole = df.select(F.struct("*").alias("row"), F.col(text).alias("text"), F.col(spans).alias("spans"))
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    whole = whole.withColumns({"pieces": F.when(F.size("spans") > 0, cut).otherwise(F.array().cast("array<string>")), "ends": F.transform("spans", lambda s: s["end"])})

    def between(start: Column, end: Column) -> Column:
        """Code points from start to end: only the pieces that hold them are looked at."""
        first, last = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
        return F.when(end > start, F.substring(F.array_join(F.slice("pieces", first + 1, last - first + 1), ""), start % PIECE + 1, end - start)).otherwise("")

    placed = F.filter(F.arrays_zip(F.col("spans").alias("s"), F.col("ends_before").alias("at")), lambda x: x["s"]["start"] >= x["at"])
    parts = F.transform(placed, lambda x: F.concat(between(x["at"], x["s"]["start"]), F.lit("["), x["s"]["kind"], F.lit("]")))
    new = F.array_join(F.concat(parts, F.array(between(F.array_max("ends"), F.length("text")))), "")
    done = before(whole, ["ends"], lambda a, b: F.greatest(a, b)).select("row", F.when(F.size("spans") > 0, new).otherwise(F.col("text")).alias("text"))
    return done.select([F.col("text").alias(text) if c == text else F.col(f"row.`{c}`").alias(c) for c in df.columns])


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = findings_by_path(docs, update_ledger(docs, new_ledger(spark)))
    base = F.filter("spans", lambda s: s["k"] < sum(r.base for r in RULES))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _sql_rule(k: int, kind: str, pattern: str, test: str) -> str:
    p = pattern.replace("'", "''")
    return f"""{kind}_p AS (SELECT r, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}') AS h FROM d WHERE regexp_matches(t, '{p}')),
{kind}_m AS (SELECT r, h[i] AS m, (list_sum([length(x) FOR x IN g[1:i]]) + coalesce(list_sum([length(x) FOR x IN h[1:i-1]]), 0))::BIGINT AS s FROM {kind}_p, LATERAL (SELECT unnest(range(1, len(h) + 1)) AS i)),
{kind}_s AS (SELECT r, {k} AS k, s, '{kind}:' || s || ':' || (s + length(m)) AS span FROM {kind}_m WHERE {test})"""


_A = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_RULES = [
    _sql_rule(0, "assign", _A, "length(regexp_extract(m, '" + _A.replace("'", "''") + "', 2)) >= 8"),
    _sql_rule(1, "access", "AKIA[A-Z0-9]+", "length(m) >= 16"),
    _sql_rule(2, "hex", "[0-9a-f]+", "length(m) >= 32"),
    _sql_rule(3, "forge", "gh[pousr]_[A-Za-z0-9]+", "length(m) >= 40"),
    _sql_rule(4, "jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", "true"),
    _sql_rule(5, "pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "true"),
]
SQL = "WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),\n" + ",\n".join(_RULES) + """,
f AS (SELECT * FROM assign_s UNION ALL SELECT * FROM access_s UNION ALL SELECT * FROM hex_s UNION ALL SELECT * FROM forge_s UNION ALL SELECT * FROM jwt_s UNION ALL SELECT * FROM pem_s),
a AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  coalesce(string_agg(span, ',' ORDER BY s, k) FILTER (k < 3), '') AS base, string_agg(span, ',' ORDER BY s, k) AS spans FROM f GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (r)"""

QUERIES = {"op8_secret_scan": op8_secret_scan}
ORACLE = {"op8_secret_scan": SQL}
