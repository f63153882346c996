"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

Document evidence: a naive Bayes log-likelihood ratio over binned text statistics, learned from the labelled rows by grouped counts.
Site evidence: the documents' own probabilities are summed by (host, path) and by host; a path's share of good documents is
shrunk to its host's, a host's to the global share, each by a strength that the spread between the groups gives
(beta-binomial moments), so sparse sites follow their parents. The shrunk share of a document's path is its prior, and

    posterior = logistic(logit(path share) + document evidence)

decides. Everything is DataFrame expressions and grouped sums; a hot host costs one partial sum per task. Priors are joined
under a salt, so a host with a third of the rows is spread over `SALTS` tasks.

Defined results: a null text counts as empty; null host or path is a site of its own; without labels every ratio is 0 and everything
is kept; a label other than 0 and 1 is ignored; repeated rows each count and each get their own result; a document labelled more than once
counts with its smallest label; other columns of docs pass through `classify`, except those named like its four results, which are replaced.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.llm.common import bound, words, written

#: Upper bounds of the bins of each statistic, in hundredths (n_words: as it stands).
BINS = {
    "n_words": [1, 5, 20, 60, 250],
    "symbols": [1, 5, 20, 60],
    "shouts": [1, 10, 40, 90],
    "capitals": [1, 5, 20],
    "variety": [15, 30, 50, 65, 80],
    "word_length": [350, 450, 600, 700, 850],
}
SMOOTHING = 0.5
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1_000_000.0
THRESHOLD = 0.5
SALTS = 16
RESULTS = ("evidence", "prior", "posterior", "kept")


def statistics(text: Column, ws: Column) -> dict[str, Column]:
    """Counts of a text that the bins are made from; ws are its words."""
    t = F.coalesce(text, F.lit(""))
    return {
        "n_words": F.size(ws), "distinct_words": F.size(F.array_distinct(ws)), "chars": F.length(t),
        "symbol_chars": F.regexp_count(t, F.lit("[#*$%&|<>]")), "shout_chars": F.regexp_count(t, F.lit("!")),
        "capital_pairs": F.regexp_count(t, F.lit("[A-Z][A-Z]")),
    }


def binned(c: dict[str, Column]) -> dict[str, Column]:
    """Bin numbers from the counts; integer arithmetic only."""
    per_word = lambda x: F.when(c["n_words"] > 0, F.floor(100 * x.cast("bigint") / c["n_words"])).otherwise(0)
    per_char = lambda x: F.when(c["chars"] > 0, F.floor(100 * x.cast("bigint") / c["chars"])).otherwise(0)
    values = {
        "n_words": c["n_words"], "symbols": per_word(c["symbol_chars"]), "shouts": per_word(c["shout_chars"]), "capitals": per_char(c["capital_pairs"]),
        "variety": per_word(c["distinct_words"]), "word_length": per_word(c["chars"]),
    }
    out = {}
    for name, bounds in BINS.items():
        number = F.lit(0)
        for bound in bounds:
            number = number + (values[name] >= bound).cast("int")
        out[name] = number
    return out


def bins_of(text: Column) -> Column:
    """The bin numbers of a text in the order of BINS; words and counts are bound, so they are computed once."""
    def of_words(ws: Column) -> Column:
        counts = statistics(text, ws)
        return bound(F.struct(*(v.alias(k) for k, v in counts.items())), lambda c: F.array(*binned({k: c[k] for k in counts}).values()))

    return bound(words(text), of_words)


def fit_evidence(bins: DataFrame) -> list[list[float]]:
    """Log-likelihood ratios by statistic and bin from rows (bins, label); a table of fixed size."""
    labelled = bins.where("label in (0, 1)")
    counts = labelled.select("label", F.posexplode("bins").alias("statistic", "bin")).groupBy("statistic", "bin").agg(
        F.sum("label").cast("double").alias("good"), F.sum(1 - F.col("label")).cast("double").alias("bad")).collect()
    found = {(r.statistic, r.bin): (r.good, r.bad) for r in counts}
    totals = [sum(v[side] for (s, _), v in found.items() if s == 0) for side in (0, 1)]
    ratios = []
    for s, bounds in enumerate(BINS.values()):
        n = len(bounds) + 1
        share = lambda b, side, s=s, n=n: (found.get((s, b), (0.0, 0.0))[side] + SMOOTHING) / (totals[side] + SMOOTHING * n)
        ratios.append([log(share(b, 0)) - log(share(b, 1)) if min(totals) > 0 else 0.0 for b in range(n)])
    return ratios


def evidence_of(bins: Column, ratios: list[list[float]]) -> Column:
    return bound(bins, lambda b: reduce(lambda total, s: total + F.get(F.array(*map(F.lit, ratios[s])), F.get(b, F.lit(s))), range(len(ratios)), F.lit(0.0)))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def strength(groups: DataFrame, parent: Column | str) -> DataFrame:
    """One row with the prior strength that the spread of group shares around the parents' gives (rows: good, n)."""
    p = F.col(parent) if isinstance(parent, str) else parent
    spread = F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - p, 2)) / F.sum("n")
    within = F.sum(p * (1 - p)) / F.sum("n")
    level = F.sum(F.col("n") * p * (1 - p)) / F.sum("n")
    between = F.greatest(spread - within, level / MAX_STRENGTH)
    return groups.agg(F.least(F.greatest(level / between - 1, F.lit(MIN_STRENGTH)), F.lit(MAX_STRENGTH)).alias("strength"))


def site_shares(scored: DataFrame, share: float) -> DataFrame:
    """(host, path, prior) from rows (host, path, p, label): shares of good documents, shrunk level by level."""
    known = F.when(F.col("label").isin(0, 1), F.col("label").cast("double")).otherwise(F.col("p"))
    paths = scored.groupBy("host", "path").agg(F.sum(known).alias("good"), F.count("*").cast("double").alias("n"))
    hosts = paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    k = value(strength(hosts, F.lit(share)))
    hosts = hosts.select(F.col("host").alias("of_host"), ((F.col("good") + k * share) / (F.col("n") + k)).alias("parent"))
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("of_host"))).drop("of_host")
    k = value(strength(paths, "parent"))
    return paths.select("host", "path", ((F.col("good") + k * F.col("parent")) / (F.col("n") + k)).alias("prior"))


def value(row: DataFrame) -> float:
    x = row.first()[0]
    return MIN_STRENGTH if x is None else x


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang",
        label_col: str = "quality") -> tuple[list[list[float]], DataFrame]:
    """(log-likelihood ratios, site priors), learned from all rows."""
    named = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    marks = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"))
    bins = written(named.select("id", "host", "path", bins_of(F.col("text")).alias("bins")), "quality-bins")
    bins = bins.join(marks, "id", "left")
    ratios = fit_evidence(bins)
    good, bad = bins.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    share = (good + 1.0) / (good + bad + 2.0)
    scored = bins.withColumn("p", logistic(logit(F.lit(share)) + evidence_of(F.col("bins"), ratios)))
    return ratios, written(site_shares(scored, share), "site-priors")


def classify(docs: DataFrame, model: tuple[list[list[float]], DataFrame], text_col: str = "text", host_col: str = "source", path_col: str = "lang",
             threshold: float = THRESHOLD) -> DataFrame:
    """docs with evidence, prior, posterior and kept."""
    ratios, priors = model
    docs = docs.drop(*RESULTS)
    tag = "q"
    while any(c.startswith(tag) for c in docs.columns):
        tag += "q"
    salted = priors.select(F.col("host").alias(f"{tag}_host"), F.col("path").alias(f"{tag}_path"), "prior", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(f"{tag}_of"))
    left = docs.withColumn("evidence", evidence_of(bins_of(F.col(text_col)), ratios))
    left = left.withColumn(f"{tag}_salt", F.pmod(F.xxhash64(text_col), F.lit(SALTS)).cast("int"))
    met = left.join(salted, F.col(host_col).eqNullSafe(F.col(f"{tag}_host")) & F.col(path_col).eqNullSafe(F.col(f"{tag}_path")) & (F.col(f"{tag}_salt") == F.col(f"{tag}_of")), "left")
    met = met.withColumn("posterior", logistic(logit(F.coalesce("prior", F.lit(0.5))) + F.col("evidence"))).withColumn("kept", F.col("posterior") >= threshold)
    return met.select(*docs.columns, *RESULTS)
