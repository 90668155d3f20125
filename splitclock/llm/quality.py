r"""Quality rules: a learned decision list over text statistics, emitted as an ordered Spark condition.

Everything runs as DataFrame and SQL functions. The statistics of a text come from array expressions inside its row, so
no text is shuffled. The list is learned by sequential covering from counts: every growing step is one aggregate over
the labelled rows, grouped by statistic and threshold bin, whose result has a fixed size.

Covering. Rules describe rejected documents. A rule starts empty and takes the condition ``statistic > t`` or
``statistic <= t`` with the best information gain on the growing part of the labels, up to ``max_literals``. It is then
cut back to the prefix that is best on the pruning part, (p - n) / (p + n). A rule with precision under
``min_precision`` or fewer than ``min_cover`` rows ends the list. Thresholds are moved to the middle of the gap between
the labelled rows on both sides. Rows that a rule covers leave, and the next rule is grown.

Cases: NULL and blank texts have no words and fail the base rule (fewer than 50 words); NULL or missing labels are left out;
without labels of both kinds the list is empty and only the base rule rejects; repeated rows are judged alike; an empty
table gives no rows; further columns are carried by `keep_good` and ignored by the query.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitclock.llm.common import BLANKS, table, written
from splitclock.session import removed_after

STATISTICS = ["n_words", "word_length", "symbols_per_word", "dup_line_share", "repeat_share"]
_BLANK = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Literal:
    statistic: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.statistic)
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)


Rule = list[Literal]


def text_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.trim(text, F.lit(BLANKS))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.trim(line, F.lit(BLANKS)) != "")
    step = docs.select(
        *keep,
        F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _BLANK, -1)).alias("_words"),
        (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        lines.alias("_lines"),
    )
    step = step.select(
        *keep,
        F.size("_words").cast("bigint").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.size("_words") < 3, F.array().cast("array<bigint>"))
        .otherwise(F.transform(F.slice("_words", F.lit(1), F.size("_words") - 2), lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2))))
        .alias("_windows"),
    )
    # Windows sorted with their places: a repeated window has an equal neighbour. Texts without any skip the sort.
    kept = [*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    step = step.select(
        *kept,
        F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_sorted"),
    )
    same = lambda s, k: F.coalesce(F.get("_sorted", k - 1)["h"] == s["h"], F.lit(False)) | F.coalesce(F.get("_sorted", k + 1)["h"] == s["h"], F.lit(False))
    step = step.select(*kept, F.sort_array(F.transform(F.filter("_sorted", same), lambda s: s["i"])).alias("_at"))
    gap = lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_at", k + 1) - p, F.lit(3)))
    covered = F.aggregate(F.transform("_at", gap), F.lit(0), lambda total, g: total + g)
    return step.select(*kept, F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def with_ratios(stats: DataFrame) -> DataFrame:
    """Add the ratios that the rules may use."""
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return stats.withColumns(
        {
            "word_length": F.col("word_chars") / words,
            "symbols_per_word": F.col("n_symbols") / words,
            "dup_line_share": F.col("n_dup_lines") / lines,
            "repeat_share": F.col("n_repeat_words") / words,
        }
    )


def _all(literals: Rule) -> Column:
    out = F.lit(True)
    for x in literals:
        out = out & x.column()
    return out


def rejects(rules: list[Rule]) -> Column:
    """The decision list: the first rule that holds rejects, a text that no rule holds for is kept."""
    out = None
    for rule in rules:
        out = F.when(_all(rule), True) if out is None else out.when(_all(rule), True)
    return F.lit(False) if out is None else out.otherwise(False)


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    """First-order information gain of a condition that keeps p of p0 rejected and n of n0 good rows."""
    if not p:
        return -1.0
    return p * (math.log2((p + 1) / (p + n + 2)) - math.log2((p0 + 1) / (p0 + n0 + 2)))


def learn(labelled: DataFrame, bins: int = 32, max_rules: int = 8, max_literals: int = 3, min_precision: float = 0.9, min_cover: int = 5) -> list[Rule]:
    """Learn the list from rows with STATISTICS, ``bad`` (1 rejected, 0 good) and ``fold`` (0 or 1 of 3: growing part).

    ``labelled`` is read once per growing step; write it before. All labelled rows count.
    """
    points = [i / bins for i in range(1, bins)]
    found = labelled.groupBy("bad").agg(F.count(F.lit(1)).alias("rows"), *[F.percentile_approx(s, points, 10_000).alias(s) for s in STATISTICS]).collect()
    if {r["bad"] for r in found} != {0, 1}:
        return []
    cuts = {s: sorted({float(v) for r in found for v in r[s]}) for s in STATISTICS}

    def bin_of(s: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(c) for c in cuts[s]]), lambda c: F.col(s) > c))

    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), bin_of(s).alias("bin")) for k, s in enumerate(STATISTICS)]))
    growing = F.col("fold") < 2
    rules: list[Rule] = []
    while len(rules) < max_rules:
        left = labelled.where(~rejects(rules))
        literals: Rule = []
        while len(literals) < max_literals:
            counts = left.where(growing & _all(literals)).select("bad", pairs.alias("x")).groupBy("x.k", "x.bin").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
            total = [(r["p"], r["n"]) for r in counts if r["k"] == 0]
            p0, n0 = sum(p for p, _ in total), sum(n for _, n in total)
            if not p0 or not n0:
                break
            best, chosen = 1e-9, None
            for k, s in enumerate(STATISTICS):
                of = {r["bin"]: (r["p"], r["n"]) for r in counts if r["k"] == k}
                p = n = 0
                for b, cut in enumerate(cuts[s]):  # bins 0..b hold the values <= cut
                    p, n = p + of.get(b, (0, 0))[0], n + of.get(b, (0, 0))[1]
                    for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
                        g = _gain(pp, nn, p0, n0)
                        if g > best + 1e-9:
                            best, chosen = g, Literal(s, above, cut)
            if chosen is None:
                break
            literals.append(chosen)
        rule = _prune(left, literals, min_precision, min_cover)
        if not rule:
            return rules
        rules.append([_centred(left, rule, k) for k in range(len(rule))])
    return rules


def _prune(left: DataFrame, literals: Rule, min_precision: float, min_cover: int) -> Rule:
    """The prefix of ``literals`` that is best on the pruning part, if it is precise enough on all labels."""
    if not literals:
        return []
    aggs = []
    for k in range(1, len(literals) + 1):
        holds = _all(literals[:k])
        for fold, where in (("prune", F.col("fold") >= 2), ("all", F.lit(True))):
            aggs += [F.sum(F.when(holds & where, F.col("bad"))).alias(f"p_{fold}_{k}"), F.sum(F.when(holds & where, 1 - F.col("bad"))).alias(f"n_{fold}_{k}")]
    row = {c: v or 0 for c, v in left.agg(*aggs).first().asDict().items()}
    worth = lambda k: (row[f"p_prune_{k}"] - row[f"n_prune_{k}"]) / max(1, row[f"p_prune_{k}"] + row[f"n_prune_{k}"])
    k = max(range(1, len(literals) + 1), key=lambda k: (worth(k), -k))
    p, n = row[f"p_all_{k}"], row[f"n_all_{k}"]
    pp, pn = row[f"p_prune_{k}"], row[f"n_prune_{k}"]
    precise = p >= min_precision * (p + n) and pp >= min_precision * (pp + pn)
    return literals[:k] if p >= min_cover and precise else []


def _centred(left: DataFrame, rule: Rule, k: int) -> Literal:
    """The k-th condition with its threshold in the middle of the gap between the rows on both sides."""
    x = rule[k]
    others = left.where(_all(rule[:k] + rule[k + 1 :]))
    inside, value = x.column(), F.col(x.statistic)
    near = F.min if x.above else F.max
    far = F.max if x.above else F.min
    a, b = others.agg(near(F.when(inside & (F.col("bad") == 1), value)), far(F.when(~inside, value))).first()
    return x if a is None or b is None else Literal(x.statistic, x.above, (float(a) + float(b)) / 2)


def learned_rules(stats: DataFrame, labels: DataFrame, **settings) -> list[Rule]:
    """Rules from ``stats`` (doc_id and statistics) and ``labels`` (doc_id, quality); rows failing the base rule are no examples."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.when(F.col("quality") > 0, 0).otherwise(1)).alias("bad"))
    rows = stats.where(~base_failed()).join(marks, "doc_id").select(*STATISTICS, "bad", F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("fold"))
    return learn(written(rows, "labelled"), **settings)


def judged(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """(doc_id, the counts, base_failed, kept) for every row of ``docs`` (doc_id, text)."""
    stats = with_ratios(written(text_statistics(docs, "doc_id"), "statistics"))
    rules = learned_rules(stats, labels, **settings)
    failed = base_failed()
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return stats.select("doc_id", *counts, failed.alias("base_failed"), (~failed & ~rejects(rules)).alias("kept"), *STATISTICS[1:])


def keep_good(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that pass the base rule and the learned list, with their columns.

    No text is written or shuffled: the rules are learned from the numbers of the labelled rows, which are written and then removed;
    the rows are judged as they are read again.
    """

    def work():
        return learned_rules(with_ratios(written(text_statistics(docs, "doc_id"), "statistics")), labels, **settings), []

    rules = removed_after(docs.sparkSession, work)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    # The number keeps the planner from working out the statistics anew in each condition of the filter.
    rows = with_ratios(text_statistics(docs.select(row, "text"), "_row")).withColumn("_place", F.monotonically_increasing_id())
    return rows.where(~base_failed() & ~rejects(rules) & (F.col("_place") >= 0)).select("_row.*")


def quality_query(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
