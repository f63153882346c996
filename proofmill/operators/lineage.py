"""Design claims, concepts and mappings: citation and lineage rules as violation rows.

Claims carry arrays of slice ids, bundle ids and observation ids; every rule explodes
the ids it needs and equi-joins, so work follows the number of citations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill import fixed_values as fv
from proofmill.functions import strength as sg
from proofmill.functions import text as tx
from proofmill.functions.frames import stage
from proofmill.sources.sinks import landed, work_folder, write_table

CLAIM = ["concept_no", "claim_id"]


def citations(claims: DataFrame) -> DataFrame:
    """One row per distinct citation of a claim: CLAIM, status, role (bundle, support, counter, observation), id, and whether a supporting slice is a counter slice too."""
    roles = {"bundle_ids": "bundle", "slice_ids": "support", "counter_ids": "counter", "observation_ids": "observation"}

    def cited(column: str, role: str):
        ids = F.array_distinct(F.coalesce(column, F.expr("cast(array() as array<string>)")))
        both = lambda i: F.coalesce(F.array_contains("counter_ids", i), F.lit(False)) if role == "support" else F.lit(False)
        return F.transform(ids, lambda i: F.struct(F.lit(role).alias("role"), i.alias("id"), both(i).alias("both")))

    parts = [cited(column, role) for column, role in roles.items()]
    return claims.select(*CLAIM, "status", F.explode(F.concat(*parts)).alias("c")).select(*CLAIM, "status", "c.role", "c.id", "c.both")


def _world(bundles: DataFrame, bundle_slices: DataFrame, slices: DataFrame, observations: DataFrame, observation_slices: DataFrame) -> DataFrame:
    """What can be cited, one row per (kind, id): whether it is known, whether it is explicit (a bundle) or a design document (a slice), the
    rank of an observation, and the slices that a bundle or an observation holds."""
    def rows(df: DataFrame, kind: str, key: str, **columns):
        given = {"known": F.lit(False), "explicit": F.lit(False), "rank": F.lit(None).cast("int"), "slice_id": F.lit(None).cast("string")} | columns
        return df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), *[value.alias(name) for name, value in given.items()])

    c = F.col
    every = (rows(bundles, "bundle", "bundle_id", known=c("ceiling").isNotNull(), explicit=c("ceiling") == "explicit")
             .unionByName(rows(slices, "slice", "slice_id", known=c("path").isNotNull(), explicit=F.coalesce(c("path").rlike(fv.DESIGN_DECISION), F.lit(False))))
             .unionByName(rows(observations, "observation", "observation_id", known=c("strength").isNotNull(), rank=F.when(c("strength").isNotNull(), sg.rank(c("strength"))).cast("int")))
             .unionByName(rows(bundle_slices, "bundle", "bundle_id", slice_id=c("slice_id")))
             .unionByName(rows(observation_slices, "observation", "observation_id", slice_id=c("slice_id"))))
    return every.groupBy("kind", "id").agg(F.bool_or("known").alias("known"), F.coalesce(F.bool_or("explicit"), F.lit(False)).alias("explicit"), F.min("rank").alias("rank"),
                                           F.collect_set("slice_id").alias("held"))


#: Claims checked in one turn, and the most turns: the shuffles of a turn are deleted after it, but every turn reads the claims again.
CLAIMS_A_TURN, MOST_TURNS = 4_000_000, 8


def claim_checks(claims: DataFrame, bundles: DataFrame, bundle_slices: DataFrame, slices: DataFrame, observations: DataFrame,
                 observation_slices: DataFrame, claims_a_turn: int = CLAIMS_A_TURN) -> DataFrame:
    """All claim rules; one row per broken rule (CLAIM, reason, cited).

    Citations meet what can be cited (`_world`) in one join and come back together as one row per claim; its rules are decided on that row.
    Both ways are shuffles many times as large as the claims, so many claims go in turns, dealt by the hash of their key: the broken rules
    of a turn are landed, and only one turn's shuffles are on disk at once.
    """
    spark = claims.sparkSession
    world = landed(_world(bundles, bundle_slices, slices, observations, observation_slices), "citable")
    turns = max(1, min(MOST_TURNS, -(-claims.count() // claims_a_turn)))
    if turns == 1:
        return _broken_rules(claims, world)
    folder = work_folder(spark)
    paths = [f"{folder}/broken-rules-{turn}" for turn in range(turns)]
    for turn, path in enumerate(paths):
        broken = _broken_rules(claims.filter(F.pmod(F.xxhash64(*CLAIM), F.lit(turns)) == turn), world)
        write_table(broken, path)
    return spark.read.schema(broken.schema).parquet(*paths)


#: A citation's role is sent as its number here, plus the others where they hold (of the claim, of the citation, of what it cites).
ROLES, SURE, BOTH, KNOWN, EXPLICIT = ["bundle", "support", "counter", "observation"], 4, 8, 16, 32


def _broken_rules(claims: DataFrame, world: DataFrame) -> DataFrame:
    c, no = F.col, F.lit(False)
    flag = lambda condition, n: F.when(condition, n).otherwise(0)
    told = F.array_position(F.array(*[F.lit(r) for r in ROLES]), c("role")) - 1 + flag(c("status") != "unknown", SURE) + flag(c("both"), BOTH)
    # One text names the kind and the id: the first letter is the kind's.
    kind = F.when(c("role").isin("support", "counter"), "s").otherwise(F.substring("role", 1, 1))
    facts = citations(claims).select(*CLAIM, told.cast("int").alias("told"), F.concat(kind, "id").alias("of"))
    citable = world.select(F.concat(F.substring("kind", 1, 1), "id").alias("of"), (flag(c("known"), KNOWN) + flag(c("explicit"), EXPLICIT)).alias("found"), "rank", F.when(F.size("held") > 0, c("held")).alias("held"))
    cited = facts.join(citable, "of", "left").select(*CLAIM, (c("told") + F.coalesce("found", F.lit(0))).alias("told"), "of", "rank", "held")
    head = F.struct("status", "confidence", c("n_limitations").cast("long").alias("n_limitations"), *[F.size(name).alias(f"n_{name}") for name in ("slice_ids", "bundle_ids", "observation_ids")])
    entry = F.when(c("told").isNotNull(), F.struct("told", F.expr("substring(of, 2)").alias("id"), "rank", F.coalesce("held", F.expr("cast(array() as array<string>)")).alias("held")))
    # Flat rows are dealt by claim before they are listed: hardly two rows of a claim are together until then.
    rows = cited.unionByName(claims.select(*CLAIM, head.alias("head")), allowMissingColumns=True).repartition(*CLAIM).groupBy(*CLAIM).agg(
        F.collect_list(entry).alias("entries"), F.collect_list("head").alias("heads"))

    def having(*roles: str):
        return F.filter("entries", lambda e: e["told"].bitwiseAND(3).isin(*[ROLES.index(r) for r in roles]))

    def has(e, n: int):
        return e["told"].bitwiseAND(n) > 0

    rows = stage(rows, bundles=having("bundle"), seen=having("observation"), cites=having("support", "counter"), backs=having("support"))
    rows = stage(rows, allowed=F.array_distinct(F.flatten(c("bundles.held"))), observed=F.array_distinct(F.flatten(c("seen.held"))))
    rows = stage(rows, aligned=F.array_intersect(c("backs.id"), "allowed"), backed=F.array_distinct(F.transform("seen", lambda e: F.struct(e["id"].alias("id"), e["held"].alias("held")))))

    def broken(condition, name: str, e) -> Column:
        return F.when(condition, F.struct(F.lit(name).alias("reason"), e["id"].alias("cited")))

    def rules(entries: str, *checks):
        return F.flatten(F.transform(entries, lambda e: F.array_compact(F.array(*[broken(check(e), name, e) for check, name in checks]))))

    allowed = lambda e: F.array_contains("allowed", e["id"])
    aligned = lambda e: F.size(F.array_intersect(e["held"], c("aligned")))
    # Each citation of a slice that breaks a rule is a violation of its own.
    by_citation = F.concat(
        rules("cites", (lambda e: ~has(e, KNOWN), "unknown-slice"), (lambda e: ~allowed(e), "slice-outside-bundles")),
        rules("backs", (lambda e: has(e, SURE) & ~(allowed(e) & F.array_contains("observed", e["id"])), "evidence-without-observation"),
              (lambda e: has(e, SURE) & has(e, BOTH), "supporting-and-counter")),
        rules("bundles", (lambda e: ~has(e, KNOWN), "unknown-bundle")),
        rules("seen", (lambda e: ~has(e, KNOWN), "unknown-observation")),
        rules("backed", (lambda e: (F.size(e["held"]) > 0) & (aligned(e) == 0), "observation-not-backed"),
              (lambda e: aligned(e) < F.size(e["held"]), "observation-slices-missing")))

    def of_claim(h):
        status, conf = h["status"], h["confidence"]
        limit = sg.ceiling(F.coalesce(F.array_min(F.transform("seen", lambda e: e["rank"])), F.lit(0)))
        names = tx.reasons(
            ((status != "unknown") & (h["n_bundle_ids"] == 0), "no-bundle"), ((status != "unknown") & (h["n_observation_ids"] == 0), "no-observation"),
            ((status == "explicit") & ~F.exists("bundles", lambda e: has(e, EXPLICIT)), "explicit-without-explicit-bundle"),
            ((status == "explicit") & ~F.exists("backs", lambda e: has(e, EXPLICIT)), "explicit-without-design-document"),
            (status.isin("explicit", "observed", "inferred") & (h["n_slice_ids"] == 0), "no-supporting-evidence"),
            (status.isin("observed", "inferred") & (conf > limit), "confidence-above-ceiling"),
            ((status == "inferred") & (h["n_limitations"] == 0), "inferred-without-limitations"), ((status == "inferred") & (conf > 0.8), "inferred-confidence"),
            ((status == "unknown") & (h["n_limitations"] == 0), "unknown-without-limitations"), ((status == "unknown") & (conf > 0.2), "unknown-confidence"))
        return F.transform(names, lambda n: F.struct(n.alias("reason"), F.lit("").alias("cited")))

    return rows.select(*CLAIM, F.inline(F.concat(F.flatten(F.transform("heads", of_claim)), by_citation)))


def common_evidence(claims: DataFrame) -> DataFrame:
    """Slices a claim cites both for and against itself."""
    return claims.select(*CLAIM, F.explode(F.array_intersect("slice_ids", "counter_ids")).alias("slice_id"))


REQUIRED_SECTIONS = {"architecture": ["modules", "contracts"], "specification": ["contracts", "failureSemantics"], "test": ["testConcepts"]}


def concept_lineage(concepts: DataFrame, concept_claims: DataFrame, concept_slices: DataFrame, claims: DataFrame, observations: DataFrame,
                    mappings: DataFrame) -> DataFrame:
    """Concept rules: claims exist, slices equal their claims' slices, sections are observed.

    concepts: concept_no, kind; concept_claims: concept_no, claim_id; concept_slices: concept_no, slice_id;
    mappings: concept_no, decision (first decision per concept).
    """
    key = ["concept_no"]
    links = concept_claims.select("concept_no", "claim_id")
    c = claims.select("claim_id", "status", "slice_ids", "observation_ids")
    # Links are dealt by claim once, for their count and for the claims; what is known per concept comes from one aggregate.
    counted = links.repartition("claim_id").groupBy("concept_no", "claim_id").agg(F.count("*").alias("n"))
    joined = landed(counted.join(c, "claim_id", "left"), "concept-claims")
    unknown_claim = joined.filter("status is null").select(*key, F.lit("unknown-claim").alias("reason"), F.col("claim_id").alias("cited"))
    repeated = joined.filter("n > 1").select(
        *key, F.lit("duplicate-claim").alias("reason"), F.col("claim_id").alias("cited")).distinct()
    mine = joined.filter("status is not null")
    # Both sides of the comparison in one aggregate: what only one of them holds is a violation.
    both = mine.select(*key, F.explode("slice_ids").alias("slice_id"), F.lit(False).alias("own")).unionByName(concept_slices.select(*key, "slice_id", F.lit(True).alias("own")))
    sides = both.groupBy(*key, "slice_id").agg(F.bool_and("own").alias("only_own"), F.bool_or("own").alias("own")).filter("only_own or not own")
    uneven = sides.select(*key, F.when(F.col("own"), "evidence-not-from-claims").otherwise("claim-evidence-omitted").alias("reason"), F.col("slice_id").alias("cited"))
    status = joined.groupBy(*key).agg(F.bool_or(F.col("status") == "unknown").alias("any_unknown"), F.bool_or(F.col("status") == "inferred").alias("any_inferred"), F.lit(True).alias("any_claim"))
    seen = mine.select(*key, F.explode("observation_ids").alias("observation_id")).join(observations.select("observation_id", "section", "strength"), "observation_id").filter(
        "strength <> 'missing'")
    sections = seen.groupBy(*key).agg(F.collect_set("section").alias("sections"))  # at most eight names
    j = concepts.join(status, key, "left").join(sections, key, "left").join(mappings.select("concept_no", "decision"), key, "left")
    live = F.coalesce(F.col("decision") != "reject", F.lit(True))
    none = F.array().cast("array<string>")
    got = F.coalesce("sections", none)
    inferred = F.coalesce("any_inferred", F.lit(False))

    def lacks(names: list[str]):
        return ~F.arrays_overlap(got, F.array(*[F.lit(n) for n in names]))

    rules = tx.reasons(
        (F.coalesce("any_unknown", F.lit(False)), "depends-on-unknown"),
        (inferred & ~F.coalesce(F.col("decision") == "adapt", F.lit(False)), "inferred-must-adapt"),
        (F.size(F.array_remove(got, "negativeSpace")) == 0, "only-negative-space"),
        (~inferred & (F.col("kind") == "architecture") & lacks(["modules", "contracts"]), "no-boundary-section"),
        (~inferred & (F.col("kind") == "specification") & lacks(["contracts"]), "no-contract-section"),
        (~inferred & (F.col("kind") == "specification") & lacks(["failureSemantics"]), "no-failure-section"),
        (~inferred & (F.col("kind") == "test") & lacks(["testConcepts"]), "no-test-section"))
    bare = F.when(F.col("any_claim").isNull(), F.array(F.lit("no-claims"))).otherwise(none)
    out = j.select(*key, F.explode(F.concat(F.when(live, rules).otherwise(none), bare)).alias("reason"), F.lit("").alias("cited"))
    for part in (unknown_claim, repeated, uneven):
        out = out.unionByName(part)
    return out


def mapping_checks(mappings: DataFrame, mapped: DataFrame, concepts: DataFrame) -> DataFrame:
    """Mapping rules.  mappings: mapping_id, decision, n_adaptations, n_tests, n_targets; mapped: mapping_id, concept_no."""
    rules = mappings.select(F.col("mapping_id").alias("item"), F.explode(tx.reasons(
        ((F.col("decision") == "adapt") & (F.col("n_adaptations") == 0), "adapt-without-adaptations"),
        ((F.col("decision") != "reject") & (F.col("n_tests") == 0), "no-acceptance-tests"),
        ((F.col("decision") != "reject") & (F.col("n_targets") == 0), "no-target-paths"))).alias("reason"))
    empty = mappings.select("mapping_id").join(mapped.select("mapping_id").distinct(), "mapping_id", "left_anti").select(
        F.col("mapping_id").alias("item"), F.lit("no-concepts").alias("reason"))
    known = concepts.select("concept_no").distinct()
    name = F.col("concept_no").cast("string").alias("item")
    unknown = mapped.select("concept_no").distinct().join(known, "concept_no", "left_anti").select(name, F.lit("unknown-concept").alias("reason"))
    many = mapped.groupBy("concept_no").agg(F.count("*").alias("n")).filter("n > 1").select(name, F.lit("several-decisions").alias("reason"))
    bare = known.join(mapped.select("concept_no").distinct(), "concept_no", "left_anti").select(name, F.lit("no-decision").alias("reason"))
    return rules.unionByName(empty).unionByName(unknown).unionByName(many).unionByName(bare)


def active_concepts(concepts: DataFrame, concept_claims: DataFrame, claims: DataFrame, mapped: DataFrame, mappings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(active concepts with their non-unknown claims, rejected concepts)."""
    decided = mapped.join(mappings.select("mapping_id", "decision"), "mapping_id")
    live = concepts.join(decided.filter("decision <> 'reject'").select("concept_no").distinct(), "concept_no", "left_semi")
    usable = concept_claims.join(claims.filter("status <> 'unknown'").select("claim_id"), "claim_id", "left_semi")
    active = live.join(usable.groupBy("concept_no").agg(F.countDistinct("claim_id").alias("claims")), "concept_no", "left").select(
        "concept_no", F.coalesce("claims", F.lit(0)).alias("claims"))
    rejected = concepts.select("concept_no").join(decided.filter("decision = 'reject'").select("concept_no").distinct(), "concept_no", "left_semi")
    return active, rejected


def repository_set_match(declared: DataFrame, approved: DataFrame, evidence: DataFrame, key: str = "dossier_id") -> DataFrame:
    """Declared and approved repository sets must be equal, and each declared one needs evidence."""
    k = [key, "repository"]
    d = declared.select(*k).distinct()
    a = approved.select(*k).distinct()
    repeated = declared.groupBy(*k).agg(F.count("*").alias("n")).filter("n > 1").select(*k, F.lit("declared-twice").alias("reason"))
    return (d.join(a, k, "left_anti").select(*k, F.lit("unapproved").alias("reason"))
            .unionByName(a.join(d, k, "left_anti").select(*k, F.lit("omitted").alias("reason")))
            .unionByName(d.join(evidence.select(*k).distinct(), k, "left_anti").select(*k, F.lit("no-evidence").alias("reason")))
            .unionByName(repeated))
