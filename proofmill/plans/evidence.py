"""Queries over strength, quality, bundles, covers, observations and the advisory decision."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofmill import fixed_values as fv
from proofmill.operators import acquisition as aq
from proofmill.operators import advisory as av
from proofmill.operators import bundles as bn
from proofmill.operators import cover as cv
from proofmill.operators import domain as dm
from proofmill.operators import intervals as iv
from proofmill.operators import observations as ob
from proofmill.operators import quality as ql
from proofmill.operators import relations as rl
from proofmill.operators import structure as st
from proofmill.operators import windows as wn
from proofmill.params import DEFAULT
from proofmill.plans import assessment as asm
from proofmill.plans import corpus as cp
from proofmill.plans import duck as d
from proofmill.plans import relations as rel
from proofmill.plans import windows as wp
from proofmill.plans.registry import oracle_view, query
from proofmill.plans.views import VIEWS
from proofmill.sources.sinks import landed

# Fixture links with their supporting slices, straight from parsed declarations.
VIEWS["v_fixture_support"] = "select full_name, path like 'tests/%' as supported, @arr(slice_id) as slice_ids from v_slices where path like 'tests/%' and revision = 'r1' and start_line = 1"


def strength(v):
    return ql.annotate_strength(v("v_slices"), v("v_symbols"), v("v_tree").select("full_name", "revision"), rel.support(v), v("v_fixture_support"))


QM = d.quality_modalities()
# Witnesses of a cited range: the furthest-reaching window that covers the next line, twice at most here.
oracle_view("o_first", """
select s.full_name, s.src, s.dst, s.kind, s.source_url, s.t, arg_min(p.slice_id, row(-p.end_line, p.start_line, p.slice_id)) as slice_id, max(p.end_line) as far from o_support s
join o_pinned p on p.full_name = s.full_name and p.path = s.src and p.start_line <= s.s and p.end_line >= s.s where s.located group by 1, 2, 3, 4, 5, 6""")
oracle_view("o_second", """
select s.full_name, s.src, s.dst, s.kind, s.source_url, arg_min(p.slice_id, row(-p.end_line, p.start_line, p.slice_id)) as slice_id from o_first s
join o_pinned p on p.full_name = s.full_name and p.path = s.src and p.start_line <= s.far + 1 and p.end_line >= s.far + 1 where s.far < s.t group by 1, 2, 3, 4, 5""")
oracle_view("o_witness", "select full_name, src, dst, kind, source_url, slice_id from o_first union all select full_name, src, dst, kind, source_url, slice_id from o_second")
oracle_view("o_related", """
select slice_id, bool_or(kind = 'tests') as tested from (
  select s.kind, s.target as slice_id from o_support s where located and covered and target is not null
  union all select s.kind, w.slice_id from o_support s join o_witness w on w.full_name = s.full_name and w.src = s.src and w.dst = s.dst and w.kind = s.kind and w.source_url = s.source_url where located and covered and target is not null) group by 1""")
oracle_view("o_strength", f"""
select s.slice_id, s.full_name, s.path, s.revision, s.m, case when complete and (coalesce(r.tested, false) or coalesce(x.cross_modal, false) or f.slice_id is not null) then 4 when complete and r.slice_id is not null then 3 when complete then 2 else 1 end as rank,
  concat_ws('|', 'bounded-text-window', case when complete then 'complete-semantic-unit' end, case when complete and (coalesce(r.tested, false) or coalesce(x.cross_modal, false) or f.slice_id is not null) then 'cross-modal-corroboration' end,
    case when r.slice_id is not null then 'static-relation-candidate' end) as signals
from (select s.*, {QM} as m, s.strategy <> 'line-window' and s.revision = 'r1' and (not exists (select 1 from v_symbols y where y.full_name = s.full_name and y.path = s.path)
        or exists (select 1 from v_symbols y where y.full_name = s.full_name and y.path = s.path and y.start_line >= s.start_line and y.end_line <= s.end_line)) as complete from v_slices s) s
left join o_related r on r.slice_id = s.slice_id
left join (select full_name, path, revision, bool_or(list_contains(m, 'implementation')) and bool_or(list_contains(m, 'test')) as cross_modal from (select *, {QM} as m from v_slices where strategy <> 'line-window') group by 1, 2, 3) x
  on x.full_name = s.full_name and x.path = s.path and x.revision = s.revision
left join (select distinct unnest(slice_ids) as slice_id from v_fixture_support where supported) f on f.slice_id = s.slice_id""")
LEVEL = "case {} " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(fv.STRENGTH_LEVELS)) + " end"


@query("annotate_strength", f"select slice_id, cast(rank as bigint) as rank, {LEVEL.replace('{}', 'rank')} as level, signals from o_strength")
def _(v):
    return strength(v).withColumn("signals", F.array_join("signals", "|"))


@query("bundle_strength", f"""
select bundle_id, {LEVEL.replace('{}', 'max(rank)')} as strongest, {LEVEL.replace('{}', 'min(rank)')} as weakest, array_to_string(list_sort(list_distinct(flatten(list(split(signals, '|'))))), '|') as signals
from v_bundle_slices b join o_strength s on s.slice_id = b.slice_id group by 1""")
def _(v):
    return ql.bundle_strength(v("v_bundle_slices"), strength(v)).withColumn("signals", F.array_join("signals", "|"))


VIEWS["v_failures"] = "select full_name, path, 'content-truncated' as reason from v_tree where size % 23 = 0"
oracle_view("o_qfiles", """
select p.full_name, p.path, greatest(coalesce(b.best, case when f.path is not null then 0 else 1 end), case when y.path is not null then 2 else 0 end, case when e.path is not null then 3 else 0 end) as rank
from (select full_name, path from v_tree union select full_name, path from v_failures) p left join (select full_name, path, max(rank) as best from o_strength where revision = 'r1' group by 1, 2) b on b.full_name = p.full_name and b.path = p.path
left join v_failures f on f.full_name = p.full_name and f.path = p.path left join (select distinct full_name, path from v_symbols) y on y.full_name = p.full_name and y.path = p.path
left join (select full_name, src as path from o_support where located and covered and target is not null union select full_name, dst from o_support where located and covered and target is not null) e on e.full_name = p.full_name and e.path = p.path""")


def quality_files(v):
    return ql.quality_files(v("v_tree"), v("v_failures"), rel.pinned(v), strength(v), v("v_symbols"), rel.support(v))


@query("quality_files", f"select full_name, path, cast(rank as bigint) as rank, {LEVEL.replace('{}', 'rank')} as level from o_qfiles")
def _(v):
    return quality_files(v)


@query("quality_score", f"""
with r as (select full_name, path, list_contains(m, 'implementation') as i, list_contains(m, 'test') as t, contains(signals, 'complete-semantic-unit') as w from o_strength where revision = 'r1'),
a as (select full_name, bool_or(i) as s1, bool_or(t) as s2, bool_or(i and w) as s3, bool_or(t and w) as s4 from r group by 1),
x as (select full_name, bool_or(z) as x1 from (select full_name, path, bool_or(i and w) and bool_or(t and w) as z from r group by 1, 2) group by 1),
s as (select full_name, bool_or(kind = 'tests') as x2 from o_support where located and covered and target is not null group by 1),
c as (select full_name, {', '.join(f"count(case when rank = {i} then 1 end) as {n}" for i, n in enumerate(fv.STRENGTH_LEVELS))}, max(rank) as hi from o_qfiles group by 1)
select c.full_name, cast(case when s1 then 15 else 0 end + case when s2 then 15 else 0 end + case when s3 then 15 else 0 end + case when s4 then 15 else 0 end
  + case when c.full_name in (select y.full_name from o_symbol_cover o join v_symbols y on y.full_name = o.full_name and y.path = o.path and y.name = o.name where covered and role = 'implementation') then 15 else 0 end
  + case when s.full_name is not null then 10 else 0 end + case when coalesce(x1, false) or coalesce(x2, false) or c.full_name in (select full_name from v_fixture_support where supported) then 15 else 0 end as bigint) as score,
  {', '.join(fv.STRENGTH_LEVELS)}, {LEVEL.replace('{}', 'hi')} as highest from c left join a on a.full_name = c.full_name left join x on x.full_name = c.full_name left join s on s.full_name = c.full_name""")
def _(v):
    return ql.quality_score(quality_files(v), rel.pinned(v), strength(v), v("v_symbols"), rel.support(v), v("v_fixture_support"))


def bundles(v):
    cand = bn.bundle_candidates(v("v_slices"), v("v_tree"), asm.entries(v), st.test_file_index(v("v_tree"), v("v_symbols")), v("v_relations"), asm.modules(v))
    return bn.build_bundles(cand, v("v_relations"), v("v_tree").select("full_name", "revision"))


@query("build_bundles")
def _(v):
    b, _members = bundles(v)
    return b.select("bundle_id", "full_name", "concern", "discriminator", "ceiling", F.array_join("evidence_kinds", "|").alias("kinds"), "slices", "relations",
                    F.array_join("limitations", "|").alias("limitations"))


@query("bundle_membership", "select distinct path, bundle_id from v_slices s join v_bundle_slices b on s.slice_id = b.slice_id".replace("distinct path", "distinct s.path"))
def _(v):
    return bn.bundle_membership(v("v_slices").select("path", "slice_id"), v("v_bundle_slices"), "path")


# -- cover ------------------------------------------------------------------------------------
VIEWS["v_cover_selection"] = """
select source as task_id, full_name, row_number() over (partition by source order by first_doc) as selection_rank from (select d.source, f.full_name, min(f.doc_id) as first_doc from v_files f join v_docs d on d.doc_id = f.doc_id group by 1, 2) x"""


def cover_rows(v):
    """Candidates of the kept slices at pinned revisions.  Feature rows are made first, from every slice: what is joined then holds no text."""
    rows = landed(cv.cover_candidates(v("v_slices"), v("v_relations"), v("v_terms")), "cover-slices")
    pinned = iv.same_revision(rows, v("v_tree").select("full_name", "revision"))[0]
    kept = wn.dedupe_slices(v("v_slices"), v("v_relations")).filter("status = 'kept'").select("slice_id")
    return pinned.join(kept.hint("merge"), "slice_id", "left_semi")


def cover_tasks(selection, size=DEFAULT.max_repositories):
    """Every repository of a selection in tasks of `size` by rank; the first task of a selection keeps its name."""
    at = F.col("selection_rank") - 1
    turn = F.floor(at / size)
    return selection.select(F.when(turn == 0, F.col("task_id")).otherwise(F.concat_ws("#", "task_id", turn)).alias("task_id"), "full_name", (at % size + 1).alias("selection_rank"))


def cover(v):
    return cv.select_cover(cover_tasks(v("v_cover_selection")), cover_rows(v), v("v_relations"))


@query("select_cover")
def _(v):
    return cover(v).withColumn("gains", F.array_join("gains", "|"))


@query("role_coverage", """
select full_name, array_to_string(list_filter(['contract', 'invariant', 'failure', 'relationship', 'test'], lambda r: case when r = 'relationship' then edge else list_contains(roles, r) end), '|') as covered,
  array_to_string(list_filter(['contract', 'invariant', 'failure', 'relationship', 'test'], lambda r: not case when r = 'relationship' then edge else list_contains(roles, r) end), '|') as missing,
  case when edge and list_has_all(roles, ['contract', 'invariant', 'failure', 'test']) then 'covered' else 'degraded' end as status
from (select s.full_name, coalesce(flatten(list(architecture_roles)), []) as roles, s.full_name in (select full_name from o_support where located and covered and target is not null) as edge from o_pinned s group by 1)""")
def _(v):
    out = cv.role_coverage(rel.pinned(v), rel.support(v).filter("supported"))
    return out.select("full_name", F.array_join("covered", "|").alias("covered"), F.array_join("missing", "|").alias("missing"), "status")


# -- observations -------------------------------------------------------------------------------
def observations(v):
    """Compiled over landed inputs: each step is a small plan of its own, and files are parsed once."""
    symbols, support = landed(rel.parsed_symbols(v), "parsed-symbols"), landed(rel.support(v), "relation-support")
    pinned = landed(rel.pinned(v).drop("content"), "pinned-slices")
    level = landed(ql.annotate_strength(v("v_slices"), v("v_symbols"), v("v_tree").select("full_name", "revision"), support, v("v_fixture_support")), "slice-strength")
    fixtures = landed(iv.fixture_support(rl.link_fixtures(symbols), symbols, pinned), "fixture-support")
    unresolved = landed(rl.unresolved_imports([rel.rs(v)[1]]), "unresolved-imports")
    return ob.compile_observations(landed(asm.modules(v), "modules"), v("v_symbols"), pinned, level, support, fixtures, unresolved, landed(cp.routes(v), "routes"))


@query("compile_observations")
def _(v):
    out = observations(v)
    return out.select("full_name", "section", "discriminator", "strength", "summary", *[F.array_join(c, "|").alias(c) for c in ("paths", "symbols", "slice_ids", "limitations")])


oracle_view("o_contracts", f"""
select y.full_name, y.path || ':' || y.start_line || ':' || y.kind || ':' || y.name as discriminator, y.path, y.name from v_symbols y join o_symbol_cover c on c.full_name = y.full_name and c.path = y.path and c.name = y.name
where covered and role = 'implementation' and {wp.PUBLIC}""".replace("starts_with(name", "starts_with(y.name"))


@query("observed_contracts", "select full_name, discriminator, path as paths, name as symbols from o_contracts")
def _(v):
    out = observations(v).filter("section = 'contracts' and strength = 'syntactic' and discriminator not like '%slice-contract'")
    return out.select("full_name", "discriminator", F.array_join("paths", "|").alias("paths"), F.array_join("symbols", "|").alias("symbols"))


@query("select_observations")
def _(v):
    return ob.select_observations(observations(v), v("v_slices"))


VIEWS["v_observed"] = f"""
select slice_id as observation_id, full_name, case relevance % 8 {' '.join(f"when {i} then '{s}'" for i, s in enumerate(fv.BLUEPRINT_SECTIONS))} end as section,
  case (relevance + start_line) % 5 {' '.join(f"when {i} then '{s}'" for i, s in enumerate(fv.STRENGTH_LEVELS))} end as strength from v_slices"""
SRANK = "case strength " + " ".join(f"when '{n}' then {i}" for i, n in enumerate(fv.STRENGTH_LEVELS)) + " end"
SPRIO = "case section " + " ".join(f"when '{n}' then {i}" for n, i in fv.SECTION_PRIORITY.items()) + " end"


@query("brief_observations", f"""
select task_id, o.full_name, observation_id, section, strength from v_cover_selection s join v_observed o on o.full_name = s.full_name where section <> 'negativeSpace' and {SRANK} >= 2
qualify row_number() over (partition by task_id order by {SRANK} desc, {SPRIO} desc, observation_id) <= 5""")
def _(v):
    return ob.brief_observations(v("v_observed"), v("v_cover_selection"))


# -- advisory -------------------------------------------------------------------------------------
VIEWS["v_pairs"] = """
select t.task_id, c.full_name, @i(50 + length(c.full_name) % 4 * 10) as domain, @i(length(t.task_id) % 3) as capabilities, @i(2) as n_capabilities
from v_tasks t join (select full_name, row_number() over (order by full_name) as n from (select distinct full_name from v_files) x) c on length(t.task_id) % 5 = c.n % 5"""


def benefit(v):
    facts = av.slice_facts(v("v_slices"), strength(v), v("v_relations"))
    return av.advisory_benefit(v("v_pairs"), facts, dm.content_capability_coverage(v("v_concepts"), v("v_slices")))


oracle_view("o_cap_parts", """
select task_id, concept, unnest(list_distinct(list_concat(whole, list_filter(flatten(list_transform(whole, lambda a: regexp_split_to_array(a, '[ +_-]+'))), lambda p: length(p) >= 3)))) as term
from (select task_id, concept, list_prepend(concept, aliases) as whole from o_concepts where kind = 'capability')""")
oracle_view("o_cap_texts", f"select full_name, path, {d.norm('content')} as norm from v_slices where list_has_any(evidence_roles, ['implementation', 'test'])")
oracle_view("o_content", f"""
select p.task_id, f.full_name, count(distinct concept) as matched, any_value(total) as total from o_cap_parts p
join (select distinct t.term, x.full_name from (select distinct term from o_cap_parts) t join o_cap_texts x on {d.contains_norm('x.norm', 't.term')}) f on p.term = f.term
join (select task_id, count(distinct concept) as total from o_cap_parts group by 1) n on n.task_id = p.task_id group by 1, 2""")
oracle_view("o_benefit", f"""
select *, cast(case when same then 25 else 0 end + case when pair then 20 else 0 end + case when mech then 15 else 0 end + case when related then 15 else 0 end + case when tst then 15 else 0 end + case when strong >= 2 then 10 else 0 end as bigint) as score from (
  select p.task_id, p.full_name, p.domain, p.capabilities / p.n_capabilities >= 0.5 as caps, coalesce(k.matched / k.total >= 0.5, false) as acts, p.domain >= 60 and p.capabilities / p.n_capabilities >= 0.5 and coalesce(k.matched / k.total >= 0.5, false) as same,
    src and tst0 as pair, rc or ri or rf as mech, rr or p.full_name in (select full_name from v_relations) as related, rt and tst0 as tst, strong
  from v_pairs p join (select s.full_name, coalesce(bool_or(list_contains(evidence_roles, 'implementation')), false) as src, coalesce(bool_or(list_contains(evidence_roles, 'test')), false) as tst0,
      {', '.join(f"bool_or(list_contains(architecture_roles, '{r}')) as {n}" for r, n in (('contract', 'rc'), ('invariant', 'ri'), ('failure', 'rf'), ('relationship', 'rr'), ('test', 'rt')))},
      count(case when x.rank >= 2 then 1 end) as strong from v_slices s join o_strength x on x.slice_id = s.slice_id group by 1) f on f.full_name = p.full_name
  left join o_content k on k.task_id = p.task_id and k.full_name = p.full_name)""")
BLOCK = d.reasons(("domain < 60", "'domain-below-60'"), ("not caps", "'core-capability-coverage'"), ("not acts", "'behavioral-capability-evidence'"), ("not pair", "'no-implementation-test-pair'"),
                  ("not mech and not related", "'no-mechanism-or-relationship'"), ("strong < 2", "'too-few-strong-slices'"), ("score < 60", "'score-below-threshold'"))


@query("advisory_benefit", f"select task_id, full_name, score, {BLOCK} as blockers, {BLOCK} = '' as eligible from o_benefit")
def _(v):
    return benefit(v).select("task_id", "full_name", "score", F.array_join("blockers", "|").alias("blockers"), "eligible")


@query("advisory_decision", f"""
select t.task_id, case when s.selected is null then 'skip' else 'learn' end as decision, s.selected from (select distinct task_id from o_benefit) t left join (
  select task_id, string_agg(full_name, '|' order by full_name) as selected from (select * from o_benefit where {BLOCK} = '' qualify row_number() over (partition by task_id order by score desc, full_name) <= 2) group by 1) s on s.task_id = t.task_id""")
def _(v):
    return av.advisory_decision(benefit(v))


@query("acquire_role_evidence")
def _(v):
    ranked = wn.rank_structural_files(v("v_tree"), v("v_terms"))
    readable, failures = st.filter_text_blobs(v("v_tree"), v("v_blobs"))
    evidence = st.text_evidence(readable, v("v_symbols"))
    edges = v("v_relations").select("full_name", "src", "dst", F.concat(F.lit("import-target:"), "src").alias("reason"))
    rows = aq.acquisition_rows(ranked, v("v_terms"), evidence, v("v_symbols"), edges, failures)
    out = aq.acquire_role_evidence(rows)
    return out.select("full_name", "path", "read_order", F.array_join("reasons", "|").alias("reasons"), "status", "stop_reason", F.array_join("covered", "|").alias("covered"),
                      F.array_join("missing", "|").alias("missing"))
