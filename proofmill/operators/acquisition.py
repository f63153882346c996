"""Deficit-driven reading: decide from metadata which files of a repository to read."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofmill import fixed_values as fv
from proofmill.functions import paths as pt
from proofmill.functions.frames import at_most
from proofmill.operators.structure import cap_per_group, category_paths, role_path_hints
from proofmill.operators.windows import READ_ORDER, inspected_roles, with_terms
from proofmill.params import DEFAULT, Params

READS = "full_name string, path string, read_order bigint, reasons array<string>, status string, stop_reason string, covered array<string>, missing array<string>"


def acquisition_rows(ranked: DataFrame, terms: DataFrame, evidence: DataFrame, symbols: DataFrame, edges: DataFrame, failures: DataFrame, limit: int | None = None) -> DataFrame:
    """One narrow row per file that could be read: those of a category, role hint or term match, and the ends of known edges.

    With a read budget of `limit` files, the first `limit` of each are all that the greedy pass can reach; nothing else enters a group.
    """
    file = ["full_name", "path"]
    cats = category_paths(ranked.select(*file))
    rank = ranked.select(*file, "read_rank", "size")
    hints = ranked.select(*file, F.explode(role_path_hints(F.col("path"))).alias("category"))
    listed = cats.unionByName(hints.withColumn("category", F.concat(F.lit("hint:"), "category"))).join(rank, file)
    w = Window.partitionBy("full_name", "category").orderBy("read_rank")
    near = listed.withColumn("nth", F.row_number().over(w)).filter(at_most(F.col("nth"), limit)).select(*file)
    capped = edges.select("full_name", "src", "dst", "reason").distinct()
    ends = capped.select("full_name", F.explode(F.array("src", "dst")).alias("path"))
    named = with_terms(rank, terms)
    term_hit = F.exists("terms", lambda t: F.contains(F.lower("path"), t))
    hit = cap_per_group(named.filter(term_hit), ["full_name"], ["read_rank"], limit)
    reach = near.union(ends).union(hit.select(*file)).distinct()
    roles = symbols.select(*file, F.explode_outer(inspected_roles(symbols)).alias("r")).groupBy(*file).agg(F.collect_set("r").alias("roles"))  # four role names
    grouped = cats.groupBy(*file).agg(F.collect_set("category").alias("categories"))  # six category names
    out_edges = capped.groupBy("full_name", F.col("src").alias("path")).agg(F.array_sort(F.collect_list(F.struct("dst", "reason"))).alias("targets"))
    bad = failures.select(*file, F.lit(True).alias("failed")).distinct()
    rows = reach.join(named, file).join(grouped, file, "left").join(roles, file, "left").join(evidence, file, "left").join(out_edges, file, "left").join(bad, file, "left")
    none = F.expr("cast(array() as array<string>)")
    ok = F.filter(F.coalesce("categories", none), lambda c: F.when(c == "source", F.coalesce("source_evidence", F.lit(False))).when(
        c == "test", F.coalesce("test_evidence", F.lit(False))).otherwise(True))
    return rows.select(*file, "read_rank", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("categories", none).alias("categories"), ok.alias("qualifies"),
                       F.coalesce("roles", none).alias("roles"), role_path_hints(F.col("path")).alias("hints"), term_hit.alias("term_hit"), pt.is_marker(F.col("path")).alias("marker"),
                       F.transform(F.coalesce("targets", F.expr("cast(array() as array<struct<dst:string,reason:string>>)")), lambda t: F.concat(t["dst"], F.lit("\u0001"), t["reason"])).alias("targets"),
                       F.coalesce("failed", F.lit(False)).alias("failed"))


def _plan(params: Params):
    most_files, most_characters, most_bytes = (math.inf if n is None else n for n in (params.atlas_files, params.atlas_characters, params.max_file_bytes))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        files = {r.path: r for r in pdf.sort_values("read_rank").itertuples(index=False)}
        have = {c for r in files.values() for c in r.categories}
        tried: list = []
        done: set[str] = set()
        roles, good, nominated = set(), set(), {}
        turn = used = 0

        def pick():
            nonlocal turn
            for step in range(len(READ_ORDER)):
                at = (turn + step) % len(READ_ORDER)
                cat = READ_ORDER[at]
                if cat in good:
                    continue
                markers = sum(files[p].marker for p, _w in tried)
                options = [p for p, r in files.items() if p not in done and cat in r.categories and (not r.marker or markers < 2)]
                if options:
                    turn = (at + 1) % len(READ_ORDER)
                    return next((p for p in options if not files[p].marker), options[0]), [f"missing-modality:{cat}"]
            waiting = [p for p in nominated if p in files and p not in done]
            if waiting:
                def urgency(p):
                    why = nominated[p]
                    return (not any(x.startswith("fixture-scope:") for x in why), not any(x.startswith("manifest-target:") for x in why), not files[p].term_hit, p)
                return min(waiting, key=urgency), []
            missing = [r for r in fv.SEMANTIC_ROLES if r not in roles]
            open_files = [r for r in files.values() if r.path not in done and not r.marker]
            found = next((r for r in open_files if missing and set(r.hints) & set(missing)), None) or next((r for r in open_files if missing and r.term_hit), None)
            if found is None:
                return None, []
            why = [f"missing-role-path-candidate:{x}" for x in missing if x in found.hints]
            return found.path, why + (["task-relevant-path-candidate"] if found.term_hit else [])

        stop = "no-supported-candidates"

        def pending():
            return any(p not in done and any(x.startswith("fixture-scope:") for x in why) for p, why in nominated.items())

        def satisfied():
            return len(roles) == len(fv.SEMANTIC_ROLES) and have <= good and not pending()

        while len(tried) < most_files and used < most_characters:
            if satisfied():
                break
            path, why = pick()
            if path is None:
                break
            r = files[path]
            done.add(path)
            status = "failed"
            if not r.failed and r.size <= most_bytes:
                room = most_characters - used
                used += min(room, r.size)
                status = "read" if r.size <= room else "truncated"
            reasons = sorted({*why, *nominated.get(path, [])})
            tried.append((path, (reasons, status)))
            if status == "read":
                good.update(r.qualifies)
                roles.update(r.roles)
                for t in r.targets:
                    dst, reason = t.split("\u0001")
                    if dst in files:
                        nominated.setdefault(dst, set()).add(reason)
                read = {p for p, (_w, s) in tried if s == "read"}
                if any(t.split("\u0001")[0] in read for p in read for t in files[p].targets):
                    roles.add("relationship")
        if satisfied():
            stop = "satisfied"
        elif len(tried) >= most_files or used >= most_characters:
            stop = "budget-exhausted"
        covered = [x for x in fv.SEMANTIC_ROLES if x in roles]
        missing = [x for x in fv.SEMANTIC_ROLES if x not in roles]
        name = pdf.full_name.iloc[0]
        out = [(name, p, n, why, status, stop, covered, missing) for n, (p, (why, status)) in enumerate(tried, 1)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in READS.split(", ")])

    return run


def acquire_role_evidence(rows: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Reads of each repository with reasons, and why reading stopped."""
    return rows.groupBy("full_name").applyInPandas(_plan(params), READS)
