"""Quality rules as weak supervision: rules vote or abstain, and their accuracies are estimated without labels.

Every rule looks at one statistic of a text and votes good (+1) or bad (-1), or abstains (0). A two-class latent model says how
often each rule gives each vote for good and for bad documents. Expectation-maximisation estimates it from the corpus' vote
patterns alone; a document is kept if its posterior probability of being good reaches the threshold, rather than if it passes
every rule.

All of it is DataFrame expressions. The statistics take one pass without a shuffle. The votes are then counted by pattern (partial
counts first; at most 2 ** len(RULES) patterns, whatever the corpus), and expectation-maximisation runs over that one bounded
array inside Catalyst. Its estimates (6 numbers a rule) come back as literals.

Defined results: a null or empty text has no words and fails the base rule; without any row nothing is returned; repeated rows
each count and each get their own result; other columns of docs pass through `judge`, except those named like its results.
"""

from __future__ import annotations

import re
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.llm.common import bound, words, written

WINDOW = 8
BASE_WORDS = 20
BASE_REPEATED = 30
ITERATIONS = 25
#: Counts (bad vote, abstention, good vote) that every rule starts with in good and in bad documents. They name the two classes: a fault is
#: rare in good documents, prose is more common there. The corpus' counts soon outweigh them.
FAULT_PRIOR = ((0.2, 9.8, 0.01), (3.0, 7.0, 0.01))
MERIT_PRIOR = ((0.01, 2.0, 8.0), (0.01, 7.0, 3.0))
START_GOOD = 0.8
THRESHOLD = 0.5
GOOD, BAD, ABSTAIN = 1, -1, 0
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior", "votes")


def repeated_words(hashes: Column) -> Column:
    """Words inside 8-word windows that occur twice or more in the text, from the array of word hashes (a bound variable: it is read for every window)."""
    n = F.size(hashes)
    starts = F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1)))
    windows = F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def places(ordered: Column) -> Column:
            equal = lambda s, k: F.coalesce(F.get(ordered, k)["x"] == s["x"], F.lit(False))
            found = F.filter(ordered, lambda s, k: equal(s, k - 1) | equal(s, k + 1))
            start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
            add = lambda s, p: F.struct((s["total"] + p + WINDOW - F.greatest(p, s["end"])).alias("total"), (p + WINDOW).alias("end"))
            return F.aggregate(F.sort_array(F.transform(found, lambda s: s["i"])), start, add, lambda s: s["total"])

        return bound(ordered, places)

    return F.when(n <= WINDOW, 0).otherwise(bound(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w))))


def statistics(text: Column, ws: Column) -> dict[str, Column]:
    """Counts of a text; ws are its words."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = {
        "n_words": F.size(ws), "word_chars": F.length(F.array_join(ws, "")), "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")),
        "n_lines": F.size(lines), "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": bound(F.transform(ws, lambda w: F.xxhash64(w)), repeated_words), "n_distinct": F.size(F.array_distinct(ws)),
        "n_shouts": F.regexp_count(t, F.lit("!")), "capital_pairs": F.regexp_count(t, F.lit("[A-Z][A-Z]")),
    }
    return {k: v.cast("bigint") for k, v in counts.items()}


#: Rules that vote bad where they see a fault and abstain otherwise.
FAULTS = {
    "length": "n_words < 20",
    "symbols": "100 * n_symbols > 10 * n_words",
    "repeated_words": "100 * n_repeat_words > 28 * n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 3 * n_words or word_chars > 10 * n_words",
    "shouting": "100 * n_shouts > 30 * n_words",
    "capitals": "100 * capital_pairs > 10 * word_chars",
    "variety": "100 * n_distinct < 35 * n_words",
}
#: Rules that vote good where a text looks like prose and abstain otherwise.
MERITS = {
    "plain_characters": "n_symbols = 0 and n_shouts = 0 and 100 * capital_pairs <= word_chars",
    "plain_words": "n_words > 0 and 20 * n_symbols <= n_words and 100 * n_distinct >= 50 * n_words and 10 * word_chars between 38 * n_words and 62 * n_words",
    "new_passages": "n_words > 0 and n_repeat_words = 0 and n_dup_lines = 0",
}
RULES = FAULTS | MERITS


def with_votes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the counts, base_failed and the array of votes in the order of RULES."""
    tag = "r"
    while any(c.startswith(tag) for c in docs.columns):
        tag += "r"
    staged = docs.drop(*RESULTS).withColumn(f"{tag}_words", words(F.col(text_col)))
    staged = staged.withColumn(f"{tag}_counts", F.struct(*(v.alias(k) for k, v in statistics(F.col(text_col), F.col(f"{tag}_words")).items())))
    of = f"{tag}_counts"
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    failed = (F.col(f"{of}.n_words") < BASE_WORDS) | (100 * F.col(f"{of}.n_repeat_words") > BASE_REPEATED * F.col(f"{of}.n_words"))
    return staged.select(*(c for c in docs.columns if c not in RESULTS), *(F.col(f"{of}.{c}").alias(c) for c in counts), failed.alias("base_failed"), votes(of).alias("votes"))


def votes(of: str) -> Column:
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct", "n_shouts", "capital_pairs")

    def condition(sql: str) -> Column:
        for name in sorted(names, key=len, reverse=True):
            sql = re.sub(rf"(?<![\w.]){name}\b", f"{of}.{name}", sql)
        return F.expr(sql)

    return F.array(*(F.when(condition(sql), BAD if name in FAULTS else GOOD).otherwise(ABSTAIN) for name, sql in RULES.items()))


def prior(rule: str) -> tuple[tuple[float, ...], tuple[float, ...]]:
    return FAULT_PRIOR if rule in FAULTS else MERIT_PRIOR


def fit(voted: DataFrame, iterations: int = ITERATIONS) -> tuple[float, list[list[float]]] | None:
    """(log-odds of a good document, log-likelihood ratio of each rule's three votes), estimated over all rows; None without rows."""
    counted = voted.groupBy("votes").agg(F.count("*").cast("double").alias("n"))
    patterns = counted.agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    outcomes = 3 * len(RULES)
    start = F.struct(F.lit(START_GOOD).alias("share"), *(F.array(*(F.lit(p / sum(prior(r)[side])) for r in RULES for p in prior(r)[side])).alias(name) for side, name in enumerate(("good", "bad"))))

    def total(xs: Column, x) -> Column:
        return F.aggregate(xs, F.lit(0.0), lambda s, y: s + x(y))

    def likelihood(p: Column, shares: Column) -> Column:
        return reduce(lambda s, j: s + F.log(F.get(shares, 3 * j + 1 + F.get(p["votes"], F.lit(j)))), range(len(RULES)), F.lit(0.0))

    def step(state: Column, _) -> Column:
        def weigh(p):
            odds = F.log(state["share"]) - F.log(1 - state["share"]) + likelihood(p, state["good"]) - likelihood(p, state["bad"])
            good = p["n"] / (1 + F.exp(-odds))
            return F.struct(p["votes"].alias("votes"), p["n"].alias("n"), good.alias("good"))

        def maximise(weighed):
            good, everything = total(weighed, lambda q: q["good"]), total(weighed, lambda q: q["n"])
            amount = lambda q, x, take: F.when(F.get(q["votes"], F.floor(x / 3).cast("int")) + 1 == x % 3, take(q)).otherwise(0.0)

            def shares(take, side, whole):
                first = F.array(*(F.lit(p) for r in RULES for p in prior(r)[side]))
                sums = F.array(*(F.lit(sum(prior(r)[side])) for r in RULES for _ in range(3)))
                return F.transform(F.sequence(F.lit(0), F.lit(outcomes - 1)), lambda x: (F.get(first, x) + total(weighed, lambda q: amount(q, x, take))) / (whole + F.get(sums, x)))

            return F.struct(((good + 1) / (everything + 2)).alias("share"), shares(lambda q: q["good"], 0, good).alias("good"), shares(lambda q: q["n"] - q["good"], 1, everything - good).alias("bad"))

        return bound(F.transform(F.col("patterns"), weigh), maximise)

    fitted = patterns.where(F.size("patterns") > 0).select(F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, step).alias("m")).select("m.*").first()
    if fitted is None:
        return None
    ratios = [[log(fitted.good[3 * j + o] / fitted.bad[3 * j + o]) for o in range(3)] for j in range(len(RULES))]
    return log(fitted.share / (1 - fitted.share)), ratios


def judge(voted: DataFrame, model: tuple[float, list[list[float]]] | None, threshold: float = THRESHOLD) -> DataFrame:
    """voted with the posterior probability of being good, and kept: not base_failed and likely enough."""
    odds, ratios = model or (0.0, [[0.0] * 3] * len(RULES))
    total = reduce(lambda s, j: s + F.get(F.array(*map(F.lit, ratios[j])), F.get("votes", F.lit(j)) + 1), range(len(ratios)), F.lit(odds))
    return voted.withColumn("posterior", 1 / (1 + F.exp(-total))).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def stored_votes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts, base_failed, votes) of every row, written once, without the texts."""
    return written(with_votes(docs.select(id_col, text_col), text_col).drop(text_col), "votes")
