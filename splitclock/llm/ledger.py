"""Secret scans through an incremental ledger of blobs. Spark expressions only.

The ledger is a folder with two tables. ``paths`` lists every version of every path that was ever recorded, with the content
address (SHA-256) of its text. ``blobs`` says which blob was scanned under which version of which rule, and what was found.

A scan takes the recorded blobs, drops the (blob, rule, version) triples that the ledger already has, and scans the rest: one
text for each blob, however many paths and versions hold it, and only the rules that are new to it. Findings are appended; then
they are joined back to all paths. A blob that a third of all rows hold is reduced to one row a task before the shuffle, and the
join back is one of many rows with one row, which adaptive execution splits.

How spans are found
-------------------
``split`` gives what stands between the matches of a pattern, ``regexp_extract_all`` the matches; their lengths in code points,
added up along the text, are the places. Matches are leftmost and do not overlap; those that fail the
check of their rule are dropped and not tried again. Every pattern moves along a text in linear time, and texts are not cut.

Rules: ``assign`` (a named password, secret, token or key with a value of 6 or more characters), ``access`` (AKIA and 16 or more
further letters and digits), ``hex`` (24 or more hexadecimal digits) are the base. The ledger adds ``private`` (the head of a
private key), ``provider`` (tokens of public services, by their prefix) and ``login`` (user and password in an address).

Cases: a NULL text is the empty blob, which is scanned like any other; NULL and repeated paths are rows of their own; a batch that
is recorded again replaces itself; an empty table adds nothing. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splitclock.llm.common import table
from splitclock.session import scratch_path

STEP = 256


class Rule(NamedTuple):
    """A kind of secret. ``shortest`` is the least length of group ``group`` (0: the whole match). A change of the pattern or of
    the check takes a new version."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    shortest: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}:{self.version}"


def either_case(word: str) -> str:
    """``word`` as a pattern for ASCII letters in either case."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [
    Rule("assign", 1, ASSIGN, 2, 6),
    # Runs are taken whole, so that the least length can stand in the pattern: a shorter run holds no longer one.
    Rule("access", 1, "AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, "[0-9a-f]{24,}"),
]
RULES = [
    *BASE,
    Rule("private", 1, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("provider", 1, "gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}"),
    Rule("login", 1, r"://[^\s:/@]{1,200}:[^\s/@]{1,200}@"),
]

_SPANS = "array<struct<start:int,end:int>>"
_FOUND = f"array<struct<rule:string,spans:{_SPANS}>>"


def checked(text: Column, rule: Rule) -> Column:
    """The spans of a rule as array<struct<start, end>>, in code points, end exclusive.

    One walk over (what stands before a match, the match, its checked group) adds up the lengths. The spans found are held in
    blocks of ``STEP``, so that a text with very many of them costs their number times ``STEP`` and not its square. All arrays are
    arguments of the walk: what a lambda names from outside would be worked out anew for every element.
    """
    values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    parts = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("match"), values.alias("value")
    )
    none = F.array().cast(_SPANS)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPANS}>").alias("done"), none.alias("open"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        passes = F.coalesce(F.length(x["value"]) >= rule.shortest, F.lit(False))
        full = F.size(acc["open"]) >= STEP
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(
            end.alias("at"),
            F.when(passes & full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.when(passes & full, span).when(passes, F.concat(acc["open"], span)).otherwise(acc["open"]).alias("open"),
        )

    found = F.aggregate(parts, zero, step, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["open"]))))
    return F.when(F.exists(values, lambda v: F.length(v) >= rule.shortest), found).otherwise(none)


def _part(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A table of the ledger, made empty where there is none."""
    path = f"{folder}/{name}"
    fields = [F.lit(None).cast(kind).alias(c) for c, kind in (x.split(" ", 1) for x in schema.split(", "))]
    spark.range(0).select(*fields).write.mode("ignore").parquet(path)
    return spark.read.schema(schema).parquet(path)


def record(versions: DataFrame, folder: str, batch: str = "all", path: Sequence[str] = ("doc_id",), rules: Sequence[Rule] = RULES) -> DataFrame:
    """Record the versions of some paths and scan what is new in them. Returns the (blob, found) rows that were added.

    ``versions`` has the columns ``path`` and ``text``; each row is one version of a path.
    """
    spark = versions.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = versions.select(*path, F.sha2(text, 256).alias("_blob"), text.alias("_text"))
    rows.select(*path, "_blob").write.mode("overwrite").parquet(f"{folder}/paths/batch={batch}")
    paths = spark.read.parquet(f"{folder}/paths/batch={batch}")
    known = _part(spark, folder, "blobs", f"blob string, scan string, found {_FOUND}")
    known = known.select("blob", F.explode(F.transform("found", lambda f: f["rule"])).alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    every = F.array(*[F.lit(r.name) for r in rules])
    todo = paths.select(F.col("_blob").alias("blob")).distinct().join(known, "blob", "left")
    todo = todo.select("blob", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo")).where(F.size("todo") > 0)
    texts = rows.groupBy(F.col("_blob").alias("blob")).agg(F.first("_text").alias("text"))
    due = texts.join(todo, "blob")
    results = [F.when(F.array_contains("todo", r.name), F.struct(F.lit(r.name).alias("rule"), checked(F.col("text"), r).alias("spans"))) for r in rules]
    found = due.select("blob", F.array_compact(F.array(*results)).alias("found"))
    scan = scratch_path(spark, "scan").rsplit("/", 1)[-1]
    found.select("blob", F.lit(scan).alias("scan"), "found").write.mode("append").parquet(f"{folder}/blobs")
    return _part(spark, folder, "blobs", f"blob string, scan string, found {_FOUND}").where(F.col("scan") == scan).drop("scan")


def findings(spark: SparkSession, folder: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Every recorded version of every path: its columns, its blob and ``found``, array<struct<kind, start, end>> by start, then
    by the order of ``rules``; only the given versions of the rules count."""
    ranks = {r.name: k for k, r in enumerate(rules)}
    names = F.array(*[F.lit(n) for n in ranks])
    hits = _part(spark, folder, "blobs", f"blob string, scan string, found {_FOUND}")
    hits = hits.select("blob", F.explode("found").alias("f")).where((F.size("f.spans") > 0) & F.array_contains(names, F.col("f.rule")))
    rank = (F.array_position(names, F.col("f.rule")) - 1).cast("int")
    hits = hits.select("blob", F.transform("f.spans", lambda s: F.struct(s["start"].alias("start"), rank.alias("rank"), s["end"].alias("end"))).alias("spans"))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    in_order = F.array_sort(F.flatten(F.collect_list("spans")))
    hits = hits.groupBy("blob").agg(in_order.alias("spans"))
    hits = hits.select("blob", F.transform("spans", lambda s: F.struct(F.get(kinds, s["rank"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("found"))
    paths = spark.read.parquet(f"{folder}/paths").drop("batch").withColumnRenamed("_blob", "blob")
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return paths.join(hits, "blob", "left").withColumn("found", F.coalesce("found", none))


def ledger_query(spark, sf_dir: str) -> DataFrame:
    """All documents as versions of paths (rows with one doc_id are versions of one path), in a ledger of their own."""
    folder = scratch_path(spark, "ledger")
    record(table(spark, sf_dir, "documents"), folder)
    found = findings(spark, folder)
    base = [r.kind for r in BASE]
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    own = F.filter("found", lambda s: s["kind"].isin(base))
    of_kind = lambda kind: F.filter("found", lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(k)).cast("bigint").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(F.concat_ws(",", F.transform(own, text)), 256).alias("base_sha256"), F.concat_ws(",", F.transform("found", text)).alias("spans"))


def _sql() -> str:
    parts = []
    for rank, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT id, {rank} AS rank, '{r.kind}' AS kind, k, list_sum(list_transform(gaps[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda m: length(m))), 0) AS start, length(hits[k]) AS n, length(vals[k]) AS size, {r.shortest} AS shortest "
            f"FROM (SELECT id, gaps, hits, vals, unnest(range(1, len(hits) + 1)) AS k FROM (SELECT id, regexp_split_to_array(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS hits, regexp_extract_all(t, '{pattern}', {r.group}) AS vals FROM texts))"
        )
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""
WITH texts AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
matches AS ({" UNION ALL ".join(parts)}),
spans AS (SELECT id, rank, kind, CAST(start AS BIGINT) AS start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + n AS BIGINT) AS span FROM matches WHERE size >= shortest)
SELECT doc_id, {counts}, sha256(coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start, rank), '') AS spans
FROM texts LEFT JOIN spans USING (id) GROUP BY texts.id, doc_id
"""


ORACLE = _sql()
