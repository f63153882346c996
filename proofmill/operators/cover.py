"""Greedy evidence cover of a repository: exact, in rounds over narrow rows and reduced candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmill import fixed_values as fv
from proofmill.functions import paths as pt
from proofmill.functions import text as tx
from proofmill.functions.frames import stage
from proofmill.operators.intervals import semantic_window
from proofmill.operators.windows import listed_terms, with_listed
from proofmill.params import DEFAULT, Params
from proofmill.sources.sinks import landed


def cover_candidates(kept: DataFrame, relations: DataFrame, terms: DataFrame) -> DataFrame:
    """Feature rows of deduplicated slices: weights by feature name, length, no content."""
    kinds = F.transform(pt.slice_kinds(F.col("path"), F.col("evidence_roles"), F.col("architecture_roles")), lambda k: F.concat(F.lit("modality:"), k))
    roles = F.transform(F.filter("architecture_roles", lambda r: r != "relationship"), lambda r: F.concat(F.lit("role:"), r))
    low = F.lower(F.concat("path", F.lit("\n"), "content"))
    words = F.transform(F.filter("terms", lambda t: F.contains(low, t)), lambda t: F.concat(F.lit("task:"), t))
    # The terms are landed, so that their true size decides whether texts are dealt by repository to meet them; relations meet feature rows.
    listed = landed(listed_terms(terms), "cover-terms")
    rows = with_listed(kept, listed).select(
        "full_name", "slice_id", "path", "start_line", "end_line", "relevance", "revision", F.length("content").cast("long").alias("chars"),
        (~semantic_window(F.col("strategy"))).alias("plain"), F.array_contains("architecture_roles", "relationship").alias("anchor"),
        F.array_sort(F.array_distinct(F.concat(kinds, roles, words))).alias("features"))
    ends = relations.select("full_name", F.explode(F.array("src", "dst")).alias("path")).distinct().withColumn("endpoint", F.lit(True))
    return rows.join(ends, ["full_name", "path"], "left").select(*rows.columns, F.coalesce("endpoint", F.lit(False)).alias("endpoint"))


def reduce_candidates(rows: DataFrame) -> DataFrame:
    """Drop candidates the greedy pass can never pick.

    Away from relation endpoints two slices with equal features compete only by
    (relevance, length, id); a later one that is not shorter is never chosen.  The
    frontier is taken per hash bucket first, so one very common feature set is spread
    over many tasks, then over the survivors.
    """
    free = rows.filter(~F.col("endpoint")).withColumn("signature", F.array_join("features", "\u0001")).withColumn("bucket", F.pmod(F.xxhash64("slice_id"), F.lit(64)))

    def frontier(df: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(F.desc("relevance"), "chars", "slice_id").rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn("shortest", F.min("chars").over(w)).filter(F.col("shortest").isNull() | (F.col("chars") < F.col("shortest"))).drop("shortest")

    best = frontier(frontier(free, ["full_name", "signature", "bucket"]), ["full_name", "signature"]).drop("bucket", "signature")
    return best.unionByName(rows.filter("endpoint"))


#: Tasks over which the candidates of one task and repository are dealt when they meet its state.
SPREAD = 8


def _apart(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: however small it is in one round, the rounds together would send it through the driver."""
    return side.hint("shuffle_hash")


def _weight(feature: Column) -> Column:
    return F.when(feature.startswith("modality:"), 1000).when(feature.startswith("role:"), 200).when(
        feature == "relationship:anchor", 80).when(feature == "relationship:target", 40).otherwise(20)


def _covers(spans: Column, start: Column, end: Column) -> Column:
    """Whether line spans together cover start to end: each span, in order, moves the first uncovered line on."""
    reach = F.aggregate(F.array_sort(spans), start.cast("long"), lambda at, s: F.when((s["s"] <= at) & (at <= s["e"]), s["e"] + 1).otherwise(at))
    return reach > end


def _backed(live: DataFrame, state: DataFrame, edges: DataFrame) -> DataFrame:
    """(task_id, slice_id, as_source, as_target, as_both): edges of a candidate's file that it would back together with the chosen windows.

    An edge needs its target file chosen and its cited lines covered by chosen windows of its source file, so only edges with their other
    end among the chosen files can count (or both ends in the candidate's own).  Edges meet chosen files and candidates by key.
    """
    ends = edges.filter("located").select("full_name", F.explode(F.array_distinct(F.array("src", "dst"))).alias("path"), F.when(F.col("path") == F.col("src"), F.col("dst")).otherwise(F.col("src")).alias("other"),
                                          "src", "dst", "s", "e")
    own = ends.filter("src = dst")
    near = live.filter("endpoint").select("task_id", "full_name", "slice_id", "path", "start_line", "end_line", "chosen")
    files = state.filter("going").select("task_id", "full_name", F.explode(F.array_distinct(F.col("chosen.path"))).alias("other"))
    open_ends = _apart(files).join(ends.filter("src <> dst"), ["full_name", "other"])
    met = near.join(_apart(open_ends), ["task_id", "full_name", "path"]).unionByName(near.join(_apart(own), ["full_name", "path"]).select(*near.columns, "other", "src", "dst", "s", "e"))
    mine = F.transform(F.filter("chosen", lambda c: c["path"] == F.col("src")), lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e")))
    it = F.array(F.struct(F.col("start_line").alias("s"), F.col("end_line").alias("e")))
    spans = F.when(F.col("path") == F.col("src"), F.concat(mine, it)).otherwise(mine)
    held = met.filter(_covers(spans, F.col("s"), F.col("e")))
    both = F.col("src") == F.col("dst")
    return held.groupBy("task_id", "slice_id").agg(F.count_if(F.col("path") == F.col("src")).alias("as_source"), F.count_if(F.col("path") == F.col("dst")).alias("as_target"), F.count_if(both).alias("as_both"))


def _pick(state: DataFrame, pool: DataFrame, edges: DataFrame | None) -> DataFrame:
    """The state after one more pick of every task: most new weight, then relevance, shorter, id.

    Weights are recomputed for all candidates that still fit; the best is a minimum with partial aggregates, so the candidates of
    one task are spread over many tasks of the cluster and one row each leaves them.
    """
    going = state.filter("going").select("task_id", "full_name", "room", "covered", "chosen", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("share"))
    live = pool.withColumn("share", F.pmod(F.xxhash64("slice_id"), F.lit(SPREAD)).cast("int")).join(_apart(going), ["task_id", "full_name", "share"]).drop("share").filter(
        (F.col("chars") <= F.col("room")) & ~F.exists("chosen", lambda c: c["slice_id"] == F.col("slice_id")))
    gained = F.filter("features", lambda f: ~F.array_contains("covered", f))
    if edges is None:
        rows = live.withColumn("gained", gained)
    else:
        rows = live.join(_apart(_backed(live, state, edges)), ["task_id", "slice_id"], "left").na.fill(0, ["as_source", "as_target", "as_both"])
        new = lambda name: ~F.array_contains("covered", name)
        backs = (F.col("as_source") + F.col("as_target") > 0) & new("role:relationship")
        anchors = F.col("anchor") & (F.col("out_edges") > F.col("as_source")) & new("relationship:anchor")
        # An edge within one file counts as the anchor's, where the window is one.
        aimed = F.when(F.col("anchor"), F.col("in_edges") - F.col("own_edges") > F.col("as_target") - F.col("as_both")).otherwise(F.col("in_edges") > F.col("as_target"))
        targets = aimed & new("role:relationship") & new("relationship:target")
        rows = rows.withColumn("gained", F.array_sort(F.array_distinct(F.concat(gained, tx.reasons((backs, "role:relationship"), (anchors, "relationship:anchor"), (targets, "relationship:target"))))))
    total = F.aggregate("gained", F.lit(0), lambda t, f: t + _weight(f)).cast("long")
    rank = F.struct((-total).alias("loss"), (-F.col("relevance")).alias("r"), "chars", "slice_id", "path", "start_line", "end_line", F.array_sort("gained").alias("gained"))
    best = rows.groupBy("task_id").agg(F.min(rank).alias("b"))
    took = F.coalesce(F.col("b.loss") < 0, F.lit(False))
    item = F.struct("b.slice_id", "b.path", F.col("b.start_line").alias("s"), F.col("b.end_line").alias("e"), (-F.col("b.loss")).alias("gain"), F.col("b.gained").alias("gains"), F.col("b.chars").alias("chars"))
    return state.join(_apart(best), "task_id", "left").select(
        "task_id", "full_name", F.when(took, F.col("slots") - 1).otherwise(F.col("slots")).alias("slots"), F.when(took, F.col("room") - F.col("b.chars")).otherwise(F.col("room")).alias("room"),
        F.when(took, F.concat("covered", "b.gained")).otherwise(F.col("covered")).alias("covered"), F.when(took, F.array_append("chosen", item)).otherwise(F.col("chosen")).alias("chosen"),
        (F.col("going") & took & (F.col("slots") > 1)).alias("going"))


def select_cover(selected: DataFrame, candidates: DataFrame, relations: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Greedy weighted cover per task over its repositories, in selection order.

    Candidates are reduced first, to the frontier of each feature set plus the slices of relation endpoints.  Picks are rounds over
    all tasks at once (`_pick`); between two rounds a task is one row, whose lists are bounded by the slice budget, landed in the shared
    folder.  No side of a join of the rounds is sent through the driver, since there are many rounds and a task more for every two repositories.  A repository's budget depends on what the task's repositories before it used, so repositories of equal rank go together.
    """
    reduced = reduce_candidates(candidates)
    edges, at = relation_ends(relations)
    rows = _apart(selected.select("task_id", "full_name", "selection_rank")).join(reduced, "full_name").join(_apart(at), ["full_name", "path"], "left").na.fill(0, ["out_edges", "in_edges", "own_edges"])
    rows = landed(rows, "cover-candidates")
    named = rows.select("task_id", "full_name", "selection_rank").distinct()
    turns = landed(named.withColumn("turn", F.row_number().over(Window.partitionBy("task_id").orderBy("selection_rank")))
                   .withColumn("turns", F.count("*").over(Window.partitionBy("task_id"))), "cover-turns")
    edges = landed(edges, "cover-edges")
    known = None if edges.isEmpty() else edges
    none = F.expr("cast(array() as array<string>)")
    items = F.expr("cast(array() as array<struct<slice_id:string,path:string,s:bigint,e:bigint,gain:bigint,gains:array<string>,chars:bigint>>)")
    used = turns.select("task_id").distinct().select("task_id", F.lit(0).cast("long").alias("slices"), F.lit(0).cast("long").alias("spent"))
    done = []
    for turn in range(1, (turns.agg(F.max("turn")).first()[0] or 0) + 1):
        left = F.col("turns") - F.col("turn") + 1
        slots = F.floor((F.lit(params.max_slices) - F.col("slices")) / left)
        room = F.floor((F.lit(params.slice_characters) - F.col("spent")) / left)
        state = landed(turns.filter(F.col("turn") == turn).join(_apart(used), "task_id").select("task_id", "full_name", slots.alias("slots"), room.alias("room"), none.alias("covered"), items.alias("chosen"),
                                                                                       (slots > 0).alias("going")), "cover-state")
        pool = rows.join(_apart(turns.filter(F.col("turn") == turn).select("task_id", "full_name")), ["task_id", "full_name"], "left_semi")
        if turn > 1 or not turns.filter("turn > 1").isEmpty():
            pool = landed(pool, "cover-pool")
        while not state.filter("going").isEmpty():
            state = landed(_pick(state, pool, known), "cover-state")
        done.append(state)
        here = state.select("task_id", F.size("chosen").cast("long").alias("n"), F.aggregate("chosen", F.lit(0).cast("long"), lambda t, c: t + c["chars"]).alias("c"))
        used = used.join(_apart(here), "task_id", "left").select("task_id", (F.col("slices") + F.coalesce("n", F.lit(0))).alias("slices"), (F.col("spent") + F.coalesce("c", F.lit(0))).alias("spent"))
    final = done[0] if done else turns.limit(0).select("task_id", "full_name", F.lit(0).alias("slots"), F.lit(0).alias("room"), none.alias("covered"), items.alias("chosen"))
    for state in done[1:]:
        final = final.unionByName(state)
    picked = final.select("task_id", "full_name", F.posexplode("chosen").alias("nth", "c")).select(
        "task_id", "full_name", "c.slice_id", (F.col("nth") + 1).cast("long").alias("place"), F.lit("selected").alias("status"), "c.gain", "c.gains")
    rest = rows.select("task_id", "full_name", "slice_id", "chars").join(_apart(final.select("task_id", "full_name", "slots", "room")), ["task_id", "full_name"]).join(
        _apart(picked.select("task_id", "full_name", "slice_id")), ["task_id", "full_name", "slice_id"], "left_anti")
    full = (F.col("chars") > F.col("room")) | (F.col("slots") <= 0)
    return picked.unionByName(rest.select("task_id", "full_name", "slice_id", F.lit(None).cast("long").alias("place"), F.when(full, "budget").otherwise("redundant").alias("status"),
                                          F.lit(0).cast("long").alias("gain"), none.alias("gains")))


def relation_ends(relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct edges with their cited lines, and how many each file has as source, as target and within itself."""
    a = tx.line_anchor(F.col("source_url"))
    edges = stage(relations, a=a).select("full_name", "src", "dst", F.coalesce("a.start_line", F.lit(0)).cast("long").alias("s"), F.coalesce("a.end_line", F.lit(0)).cast("long").alias("e"),
                                         ((F.col("evidence_path") == F.col("src")) & F.col("a.start_line").isNotNull()).alias("located")).distinct()
    both = edges.select("full_name", F.explode(F.array_distinct(F.array("src", "dst"))).alias("path"), "src", "dst")
    counts = both.groupBy("full_name", "path").agg(F.count_if(F.col("path") == F.col("src")).alias("out_edges"), F.count_if(F.col("path") == F.col("dst")).alias("in_edges"),
                                                   F.count_if(F.col("src") == F.col("dst")).alias("own_edges"))
    return edges, counts


def role_coverage(chosen: DataFrame, supported: DataFrame) -> DataFrame:
    """Required roles covered and missing per repository after selection.

    chosen: full_name, architecture_roles; supported: full_name of repositories with a supported edge.
    """
    required = F.array(*[F.lit(r) for r in fv.SEMANTIC_ROLES])
    roles = chosen.select("full_name", F.explode_outer("architecture_roles").alias("r")).groupBy("full_name").agg(F.collect_set("r").alias("roles"))
    edge = supported.select("full_name").distinct().withColumn("edge", F.lit(True))
    j = roles.join(edge, "full_name", "left")
    have = F.filter(required, lambda r: F.when(r == "relationship", F.coalesce("edge", F.lit(False))).otherwise(F.array_contains("roles", r)))
    return j.select("full_name", have.alias("covered"), F.array_except(required, have).alias("missing"),
                    F.when(F.size(have) == len(fv.SEMANTIC_ROLES), "covered").otherwise("degraded").alias("status"))
