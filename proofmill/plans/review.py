"""Queries over reviews, confirmations, claims, concepts and mappings."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofmill import fixed_values as fv
from proofmill.operators import lineage as ln
from proofmill.operators import review as rv
from proofmill.params import DEFAULT
from proofmill.plans import duck as d
from proofmill.plans.registry import oracle_view, query
from proofmill.plans.views import VIEWS


@query("review_citations", """
select repository, review_no, '' as cited, 'unknown-repository' as reason from v_reviews where repository like 'src11/%'
union all select repository, review_no, '', 'duplicate-decision' from (select *, row_number() over (partition by pack_id, repository order by review_no) as nth from v_reviews) where nth > 1
union all select c.repository, review_no, c.bundle_id, case when b.bundle_id is null then 'unknown-bundle' else 'foreign-bundle' end from v_review_bundles c left join v_bundles b on c.bundle_id = b.bundle_id where b.full_name is distinct from c.repository
union all select repository, review_no, slice_id, reason from (
  select c.repository, c.review_no, c.slice_id, case when s.slice_id is null then 'unknown-slice' when s.full_name <> c.repository then 'foreign-slice'
      when exists (select 1 from v_review_bundles b where b.repository = c.repository and b.review_no = c.review_no)
       and not exists (select 1 from v_review_bundles b join v_bundle_slices x on b.bundle_id = x.bundle_id where b.repository = c.repository and b.review_no = c.review_no and x.slice_id = c.slice_id) then 'slice-outside-bundles' end as reason
  from v_review_slices c left join v_slices s on c.slice_id = s.slice_id) where reason is not null""")
def _(v):
    known = v("v_files").filter("full_name not like 'src11/%'").select("full_name")
    return rv.review_citations(v("v_reviews"), v("v_review_slices"), v("v_review_bundles"), v("v_slices"), v("v_bundles"), v("v_bundle_slices"), known)


# The capability words of the local task, and a domain score per repository.
VIEWS["v_review_terms"] = "select 'retry' as term, min(item_id) as first_item from benchmark union all select 'raise valueerror', min(item_id) from benchmark"
VIEWS["v_review_domain"] = "select full_name as repository, @i(40 + count(*)) as domain from v_files group by full_name"
VIEWS["v_fit_slices"] = "select repository, review_no, slice_id from v_review_slices where review_no % 4 <> 3"
oracle_view("o_fit", f"""
select f.repository, f.review_no, f.slice_id, s.full_name is not distinct from f.repository and c.slice_id is not null as bound,
  {d.is_behavior('s.path')} and ({d.contains_norm(d.norm('s.content'), "'retry'")} or {d.contains_norm(d.norm('s.content'), "'raise valueerror'")}) as supports
from v_fit_slices f left join v_slices s on f.slice_id = s.slice_id left join (select distinct * from v_review_slices) c on c.repository = f.repository and c.review_no = f.review_no and c.slice_id = f.slice_id""")
oracle_view("o_domain_review", f"""
select repository, review_no, unnest(split(r, '|')) as reason from (
  select v.repository, v.review_no, {d.reasons(
    ("coalesce(m.domain, 0) < 50", "'domain-mismatch'"), ("relation is null", "'domain-fit-missing'"), ("relation <> 'same-domain'", "'domain-relation:' || relation"),
    ("relation is not null and length(trim(rationale)) < 20", "'domain-rationale'"), ("relation is not null and coalesce(n, 0) = 0", "'domain-evidence-missing'"),
    ("relation is not null and not coalesce(ok, false)", "'domain-behavior-missing'"))} as r
  from v_reviews v left join v_review_domain m on m.repository = v.repository
  left join (select repository, review_no, count(*) as n, bool_or(bound and supports) as ok from o_fit group by 1, 2) f on f.repository = v.repository and f.review_no = v.review_no) where r <> ''
union all select distinct f.repository, f.review_no, 'evidence-unbound:' || slice_id from o_fit f join v_reviews v on v.repository = f.repository and v.review_no = f.review_no where not bound and relation is not null""")


def domain_reasons(v):
    return rv.domain_review(v("v_reviews"), v("v_fit_slices"), v("v_review_slices"), v("v_slices"), v("v_review_terms"), v("v_review_domain"))


@query("domain_review", "select * from o_domain_review")
def _(v):
    return domain_reasons(v)


VIEWS["v_accepted"] = "select distinct full_name as repository, case when full_name like 'src2/%' then 'license-policy: license is not allowlisted' end as license_rejection from v_files"
oracle_view("o_gate", f"""
select *, verdict in ('adopt', 'adapt') and reasons = '' as approved from (
  select a.repository, r.review_no, pack_id, verdict, relation, confidence, risk, reviewer, case when verdict is null then 'No second-stage review decision' when verdict = 'pending' then 'Review is still pending'
    when verdict = 'reject' then 'Reviewer rejected the precedent' else concat_ws('|', d.reasons, license_rejection,
      case when confidence < 0.7 then 'Confidence ' || case when confidence = 0 then '0' when confidence = 1 then '1' else cast(confidence as varchar) end || ' < 0.7' end,
      case when risk = 'high' then 'Review risk high exceeds medium' end, case when coalesce(s.n, 0) < 1 then 'Evidence slices ' || coalesce(s.n, 0) || ' < 1' end,
      case when b.n is null then 'No inspected evidence bundle was cited' end, case when n_patterns = 0 then 'No transferable pattern was stated' end, case when summary = '' then 'No review summary was stated' end,
      case when verdict = 'adapt' and n_mismatches = 0 then 'Adapt verdict requires at least one mismatch' end, case when risk <> 'low' and n_risks = 0 then risk || ' risk review requires at least one stated risk' end) end as reasons
  from v_accepted a left join v_reviews r on a.repository = r.repository
  left join (select repository, review_no, count(distinct slice_id) as n from v_review_slices group by 1, 2) s on s.repository = r.repository and s.review_no = r.review_no
  left join (select repository, review_no, count(*) as n from v_review_bundles group by 1, 2) b on b.repository = r.repository and b.review_no = r.review_no
  left join (select repository, review_no, string_agg(reason, '|' order by reason) as reasons from (select distinct * from o_domain_review) group by 1, 2) d on d.repository = r.repository and d.review_no = r.review_no)""")


def gate(v):
    return rv.review_gate(v("v_accepted"), v("v_reviews"), v("v_review_slices"), v("v_review_bundles"), domain_reasons(v))


@query("review_gate", "select repository, review_no, verdict, reasons, coalesce(approved, false) as approved from o_gate")
def _(v):
    return gate(v).select("repository", "review_no", "verdict", F.array_join("reasons", "|").alias("reasons"), "approved")


@query("gate_report", """
select pack_id, verdict, count(case when approved then 1 end) as approved, count(*) as candidates, round(avg(confidence), 6) as avg_confidence,
  cast(sum(case when reasons = '' then 0 else len(split(reasons, '|')) end) as bigint) as reasons from o_gate group by 1, 2""")
def _(v):
    return rv.gate_report(gate(v))


oracle_view("o_approved_slices", """
select c.slice_id from v_review_slices c join o_gate g on g.repository = c.repository and g.review_no = c.review_no where approved
union select x.slice_id from v_review_bundles c join o_gate g on g.repository = c.repository and g.review_no = c.review_no join v_bundle_slices x on x.bundle_id = c.bundle_id where approved""")


def approved(v):
    return rv.approved_slice_ids(gate(v), v("v_review_slices"), v("v_review_bundles"), v("v_bundle_slices"))


@query("approved_pack", "select slice_id, full_name, path from v_slices where slice_id in (select slice_id from o_approved_slices)")
def _(v):
    return v("v_slices").select("slice_id", "full_name", "path").join(approved(v), "slice_id", "left_semi")


@query("evidence_index", "select slice_id, full_name, path, start_line, end_line, array_to_string(architecture_roles, '|') as roles, strategy, license from v_slices where slice_id in (select slice_id from o_approved_slices)")
def _(v):
    return rv.evidence_index(v("v_slices"), approved(v))


VIEWS["v_assessed_packs"] = """
select source as pack_id, f.full_name, min(f.doc_id) as candidate_rank, count(*) > 12 as accepted from v_files f join v_docs d on f.doc_id = d.doc_id group by 1, 2"""
VIEWS["v_coverage_in"] = "select full_name, @i(count(*)) as score from v_files where full_name not like 'src4/%' group by full_name"


@query("review_candidates", """
with c as (select a.*, s.n as slices from v_assessed_packs a join (select full_name, count(*) as n from v_slices group by 1) s on a.full_name = s.full_name where accepted
  qualify row_number() over (partition by pack_id order by candidate_rank, a.full_name) <= 2),
j as (select c.*, b.n as bundles, v.score as coverage from c left join (select full_name, count(*) as n from v_bundles where full_name not like 'src6/%' group by 1) b on b.full_name = c.full_name left join v_coverage_in v on v.full_name = c.full_name)
select pack_id, full_name, candidate_rank, slices, bundles, coverage, 'pending' as verdict, 0e0 as confidence, 'high' as risk, null as reason from j where coverage is not null and bundles is not null
union all select pack_id, full_name, null, null, null, null, null, null, null, unnest(list_filter([case when coverage is null then 'missing-atlas' end, case when bundles is null then 'missing-bundles' end], lambda x: x is not null)) from j where coverage is null or bundles is null""")
def _(v):
    good, bad = rv.review_candidates(v("v_assessed_packs"), v("v_slices"), v("v_bundles").filter("full_name not like 'src6/%'"), v("v_coverage_in"))
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad, allowMissingColumns=True)


VIEWS["v_confirmations"] = """
select f.full_name as pack_id, case count(*) % 3 when 0 then ' reviewer 1 ' else 'Second Pair' end as confirmer, case when min(f.doc_id) % 5 = 0 then 'short' else 'checked the cited behaviour' end as rationale,
  f.full_name not like 'src7/%' as pack_ok, true as task_ok, f.full_name not like 'src8/%' as review_ok, @arr(f.full_name) as confirmed
from v_files f group by f.full_name"""
oracle_view("o_confirm", f"""
select c.pack_id, {d.reasons(("not pack_ok", "'different-pack'"), ("not task_ok", "'different-task'"), ("not review_ok", "'different-review'"), ("length(trim(rationale)) < 12", "'rationale-vague'"),
    ("list_contains(reviewers, lower(trim(confirmer)))", "'same-identity'"), ("not coalesce(passed, false)", "'confirms-unapproved'"))} as reasons
from v_confirmations c left join (select pack_id, list(lower(trim(reviewer))) as reviewers, bool_or(approved) as passed from o_gate group by 1) g on g.pack_id = c.pack_id""")


@query("confirm_gate", """
select g.repository, g.review_no, coalesce(g.approved and c.reasons = '', false) as approved, concat_ws('|', nullif(g.reasons, ''), case when g.approved and coalesce(c.reasons <> '', true) then 'Not approved by the independent confirmer' end) as reasons
from o_gate g left join o_confirm c on c.pack_id = g.pack_id
union all select pack_id, null, null, unnest(split(reasons, '|')) from o_confirm where reasons <> ''""")
def _(v):
    kept, bad = rv.confirm_gate(gate(v), v("v_confirmations"))
    rows = kept.select("repository", "review_no", "approved", F.array_join("reasons", "|").alias("reasons"))
    return rows.unionByName(bad.select(F.col("pack_id").alias("repository"), F.lit(None).cast("long").alias("review_no"),
                                       F.lit(None).cast("boolean").alias("approved"), F.col("reason").alias("reasons")))


@query("read_ledger_check", "select repository, slice_id from v_review_slices except select full_name, slice_id from v_slices where relevance % 5 <> 0")
def _(v):
    log = v("v_slices").filter("relevance % 5 <> 0").select(F.col("full_name").alias("repository"), "slice_id")
    return rv.read_ledger_check(v("v_review_slices"), log, ["repository", "slice_id"])


@query("run_counts", """
select f.full_name as pack_id, coalesce(s.n, 0) as slices, coalesce(b.n, 0) as bundles, coalesce(r.n, 0) as reviews, coalesce(c.n, 0) as cited, coalesce(a.n, 0) as approved
from (select distinct full_name from v_files) f left join (select full_name, count(distinct slice_id) as n from v_slices group by 1) s on s.full_name = f.full_name
left join (select full_name, count(distinct bundle_id) as n from v_bundles group by 1) b on b.full_name = f.full_name left join (select pack_id, count(distinct review_no) as n from v_reviews group by 1) r on r.pack_id = f.full_name
left join (select repository, count(distinct slice_id) as n from v_review_slices group by 1) c on c.repository = f.full_name left join (select pack_id, count(distinct review_no) as n from o_gate where approved group by 1) a on a.pack_id = f.full_name""")
def _(v):
    return rv.run_counts({
        "slices": (v("v_slices").withColumnRenamed("full_name", "pack_id"), F.col("slice_id")),
        "bundles": (v("v_bundles").withColumnRenamed("full_name", "pack_id"), F.col("bundle_id")),
        "reviews": (v("v_reviews"), F.col("review_no")),
        "cited": (v("v_review_slices").withColumnRenamed("repository", "pack_id"), F.col("slice_id")),
        "approved": (gate(v).filter("approved"), F.col("review_no"))})


@query("cited_evidence_payload", f"""
select pack_id, slice_id, substring(content, 1, greatest(0, {DEFAULT.payload_characters} - prior)) as content, greatest(0, {DEFAULT.payload_characters} - prior) < length(content) as truncated from (
  select c.pack_id, s.slice_id, s.content, cast(coalesce(sum(length(s.content)) over (partition by c.pack_id order by {d.dirname('s.path')}, s.path, s.start_line, s.slice_id rows between unbounded preceding and 1 preceding), 0) as bigint) as prior
  from (select distinct repository as pack_id, slice_id from v_review_slices) c join v_slices s on s.slice_id = c.slice_id)""")
def _(v):
    return rv.cited_evidence_payload(v("v_slices"), v("v_review_slices").withColumnRenamed("repository", "pack_id"))


# -- claims, concepts, mappings -------------------------------------------------------------
VIEWS["v_claim_slices"] = "select 'cs' || @s(p_partkey) as slice_id, case p_partkey % 7 when 0 then 'docs/adr/' || @s(p_partkey) || '.md' else 'src/' || @s(p_partkey) || '.ts' end as path, p_partkey from part"
VIEWS["v_claim_bundles"] = "select 'cb' || @s(@div(p_partkey / 4)) as bundle_id, case when max(case when p_size > 40 then 1 else 0 end) = 1 then 'explicit' else 'observed' end as ceiling from part group by @div(p_partkey / 4)"
VIEWS["v_claim_bundle_slices"] = "select 'cb' || @s(@div(p_partkey / 4)) as bundle_id, 'cs' || @s(p_partkey) as slice_id from part"
VIEWS["v_claim_obs"] = f"""
select 'co' || @s(@div(p_partkey / 2)) as observation_id, case @div(min(p_partkey) / 2) % 8 {' '.join(f"when {i} then '{s}'" for i, s in enumerate(fv.BLUEPRINT_SECTIONS))} end as section,
  case @div(min(p_partkey) / 2) % 5 {' '.join(f"when {i} then '{s}'" for i, s in enumerate(fv.STRENGTH_LEVELS))} end as strength from part group by @div(p_partkey / 2)"""
VIEWS["v_claim_obs_slices"] = "select 'co' || @s(@div(p_partkey / 2)) as observation_id, 'cs' || @s(p_partkey) as slice_id from part where p_size % 3 <> 2 union select 'co' || @s(@div(p_partkey / 2)), 'cs' || @s(min(p_partkey)) from part group by @div(p_partkey / 2)"
CEIL = "case weakest " + " ".join(f"when {i} then {fv.CONFIDENCE_CEILING[s]}e0" for i, s in enumerate(fv.STRENGTH_LEVELS)) + " else 0.2e0 end"
RANK = "case strength " + " ".join(f"when '{s}' then {i}" for i, s in enumerate(fv.STRENGTH_LEVELS)) + " end"
oracle_view("o_cb", "select concept_no, claim_id, status, unnest(bundle_ids) as bundle_id from v_claims")
oracle_view("o_cs", "select concept_no, claim_id, status, unnest(slice_ids) as slice_id, true as positive from v_claims union all select concept_no, claim_id, status, unnest(counter_ids), false from v_claims")
oracle_view("o_co", "select concept_no, claim_id, status, unnest(observation_ids) as observation_id from v_claims")
oracle_view("o_allowed", "select distinct claim_id, x.slice_id from o_cb b join v_claim_bundle_slices x on b.bundle_id = x.bundle_id")
oracle_view("o_back", """
select o.concept_no, o.claim_id, o.observation_id, s.slice_id, a.slice_id is not null as aligned from o_co o join v_claim_obs_slices s on s.observation_id = o.observation_id
left join (select c.claim_id, c.slice_id from o_cs c join o_allowed a on a.claim_id = c.claim_id and a.slice_id = c.slice_id where positive) a on a.claim_id = o.claim_id and a.slice_id = s.slice_id""")


@query("claim_checks", f"""
select concept_no, claim_id, unnest(split(r, '|')) as reason, '' as cited from (select c.concept_no, c.claim_id, {d.reasons(
    ("status <> 'unknown' and len(bundle_ids) = 0", "'no-bundle'"), ("status <> 'unknown' and len(observation_ids) = 0", "'no-observation'"),
    ("status = 'explicit' and not coalesce(xb, false)", "'explicit-without-explicit-bundle'"), ("status = 'explicit' and not coalesce(ds, false)", "'explicit-without-design-document'"),
    ("status <> 'unknown' and len(slice_ids) = 0", "'no-supporting-evidence'"), (f"status in ('observed', 'inferred') and confidence > {CEIL}", "'confidence-above-ceiling'"),
    ("status = 'inferred' and n_limitations = 0", "'inferred-without-limitations'"), ("status = 'inferred' and confidence > 0.8e0", "'inferred-confidence'"),
    ("status = 'unknown' and n_limitations = 0", "'unknown-without-limitations'"), ("status = 'unknown' and confidence > 0.2e0", "'unknown-confidence'"))} as r
  from v_claims c left join (select claim_id, bool_or(ceiling = 'explicit') as xb from o_cb b join v_claim_bundles x on b.bundle_id = x.bundle_id group by 1) b on b.claim_id = c.claim_id
  left join (select claim_id, bool_or({d.rx('path', fv.DESIGN_DECISION)}) as ds from o_cs s join v_claim_slices x on s.slice_id = x.slice_id where positive group by 1) s on s.claim_id = c.claim_id
  left join (select claim_id, min({RANK}) as weakest from o_co o join v_claim_obs x on x.observation_id = o.observation_id group by 1) o on o.claim_id = c.claim_id) where r <> ''
union all select concept_no, claim_id, 'unknown-bundle', bundle_id from o_cb where bundle_id not in (select bundle_id from v_claim_bundles)
union all select concept_no, claim_id, 'unknown-slice', slice_id from o_cs where slice_id not in (select slice_id from v_claim_slices)
union all select concept_no, claim_id, 'slice-outside-bundles', slice_id from o_cs c where not exists (select 1 from o_allowed a where a.claim_id = c.claim_id and a.slice_id = c.slice_id)
union all select concept_no, claim_id, 'unknown-observation', observation_id from o_co where observation_id not in (select observation_id from v_claim_obs)
union all select concept_no, claim_id, 'observation-not-backed', observation_id from o_back group by all having not bool_or(aligned)
union all select concept_no, claim_id, 'observation-slices-missing', observation_id from o_back group by all having not bool_and(aligned)
union all select concept_no, claim_id, 'evidence-without-observation', slice_id from o_cs c where positive and status <> 'unknown' and not exists (select 1 from o_back b where aligned and b.claim_id = c.claim_id and b.slice_id = c.slice_id)
union all select concept_no, claim_id, 'supporting-and-counter', unnest(list_intersect(slice_ids, counter_ids)) from v_claims where status <> 'unknown'""")
def _(v):
    return ln.claim_checks(v.unlanded("v_claims"), v("v_claim_bundles"), v("v_claim_bundle_slices"), v("v_claim_slices"), v("v_claim_obs"), v("v_claim_obs_slices"))


@query("common_evidence", "select concept_no, claim_id, unnest(list_intersect(slice_ids, counter_ids)) as slice_id from v_claims")
def _(v):
    return ln.common_evidence(v("v_claims"))


VIEWS["v_concepts_in"] = "select o_orderkey as concept_no, case o_orderkey % 3 when 0 then 'architecture' when 1 then 'specification' else 'test' end as kind from orders"
VIEWS["v_concept_claims"] = """
select concept_no, claim_id from v_claims union all select concept_no, claim_id from v_claims where l_suppkey % 10 = 9
union all select o_orderkey, 'none-' || @s(o_orderkey) from orders where o_orderpriority = '5-LOW'"""
VIEWS["v_claim_slice_rows"] = {"spark": "select concept_no, l_partkey, l_suppkey, explode(slice_ids) as slice_id from v_claims", "duck": "select concept_no, l_partkey, l_suppkey, unnest(slice_ids) as slice_id from v_claims"}
VIEWS["v_concept_slices"] = """
select concept_no, slice_id from v_claim_slice_rows where l_suppkey % 12 <> 11 union select o_orderkey, 'cs-extra' from orders where o_orderstatus = 'P'"""
VIEWS["v_mappings"] = """
select 'm' || @s(@div(o_orderkey / 3)) as mapping_id, case @div(o_orderkey / 3) % 4 when 0 then 'adopt' when 1 then 'adapt' when 2 then 'reject' else 'adapt' end as decision,
  @i(@div(o_orderkey / 3) % 3) as n_adaptations, @i(@div(o_orderkey / 3) % 5) as n_tests, @i(@div(o_orderkey / 3) % 2) as n_targets from orders group by @div(o_orderkey / 3)"""
VIEWS["v_mapped"] = """
select 'm' || @s(@div(o_orderkey / 3)) as mapping_id, o_orderkey as concept_no from orders where o_orderpriority <> '1-URGENT'
union all select 'm' || @s(@div(o_orderkey / 3) + 1), o_orderkey from orders where o_orderstatus = 'P' and o_orderkey % 3 = 0 union all select 'm' || @s(@div(o_orderkey / 3)), -1 - o_orderkey from orders where o_orderpriority = '5-LOW' and o_orderstatus = 'P'"""
VIEWS["v_first_decision"] = "select concept_no, min(decision) as decision from v_mapped m join v_mappings d on m.mapping_id = d.mapping_id group by concept_no"
oracle_view("o_cc", "select distinct l.concept_no, l.claim_id, c.status, c.slice_ids, c.observation_ids from v_concept_claims l left join v_claims c on l.claim_id = c.claim_id")
oracle_view("o_lineage", """
select c.concept_no, c.kind, decision, coalesce(u, false) as u, coalesce(i, false) as i, coalesce(sections, cast([] as varchar[])) as sections from v_concepts_in c
left join v_first_decision m on m.concept_no = c.concept_no left join (select concept_no, bool_or(status = 'unknown') as u, bool_or(status = 'inferred') as i from o_cc where status is not null group by 1) s on s.concept_no = c.concept_no
left join (select concept_no, list(distinct section) as sections from (select concept_no, unnest(observation_ids) as observation_id from o_cc where status is not null) o join v_claim_obs x on x.observation_id = o.observation_id where strength <> 'missing' group by 1) z on z.concept_no = c.concept_no
where coalesce(decision <> 'reject', true)""")


@query("concept_lineage", f"""
select concept_no, unnest(split(r, '|')) as reason, '' as cited from (select concept_no, {d.reasons(
    ("u", "'depends-on-unknown'"), ("i and not coalesce(decision = 'adapt', false)", "'inferred-must-adapt'"), ("len(list_filter(sections, lambda s: s <> 'negativeSpace')) = 0", "'only-negative-space'"),
    ("not i and kind = 'architecture' and not list_has_any(sections, ['modules', 'contracts'])", "'no-boundary-section'"), ("not i and kind = 'specification' and not list_contains(sections, 'contracts')", "'no-contract-section'"),
    ("not i and kind = 'specification' and not list_contains(sections, 'failureSemantics')", "'no-failure-section'"), ("not i and kind = 'test' and not list_contains(sections, 'testConcepts')", "'no-test-section'"))} as r from o_lineage) where r <> ''
union all select concept_no, 'unknown-claim', claim_id from o_cc where status is null
union all select concept_no, 'duplicate-claim', claim_id from v_concept_claims group by all having count(*) > 1
union all select concept_no, 'no-claims', '' from v_concepts_in where concept_no not in (select concept_no from v_concept_claims)
union all (select concept_no, 'evidence-not-from-claims', slice_id from v_concept_slices except select concept_no, 'evidence-not-from-claims', unnest(slice_ids) from o_cc where status is not null)
union all (select concept_no, 'claim-evidence-omitted', unnest(slice_ids) from o_cc where status is not null except select concept_no, 'claim-evidence-omitted', slice_id from v_concept_slices)""")
def _(v):
    return ln.concept_lineage(v("v_concepts_in"), v("v_concept_claims"), v("v_concept_slices"), v("v_claims"), v("v_claim_obs"), v("v_first_decision"))


@query("mapping_checks", f"""
select mapping_id as item, unnest(split(r, '|')) as reason from (select mapping_id, {d.reasons(("decision = 'adapt' and n_adaptations = 0", "'adapt-without-adaptations'"),
    ("decision <> 'reject' and n_tests = 0", "'no-acceptance-tests'"), ("decision <> 'reject' and n_targets = 0", "'no-target-paths'"))} as r from v_mappings) where r <> ''
union all select mapping_id, 'no-concepts' from v_mappings where mapping_id not in (select mapping_id from v_mapped)
union all select distinct cast(concept_no as varchar), 'unknown-concept' from v_mapped where concept_no not in (select concept_no from v_concepts_in)
union all select cast(concept_no as varchar), 'several-decisions' from v_mapped group by concept_no having count(*) > 1
union all select cast(concept_no as varchar), 'no-decision' from v_concepts_in where concept_no not in (select concept_no from v_mapped)""")
def _(v):
    return ln.mapping_checks(v("v_mappings"), v("v_mapped"), v("v_concepts_in"))


@query("active_concepts", """
select c.concept_no, coalesce(n, 0) as claims, 'active' as state from v_concepts_in c left join (select concept_no, count(distinct l.claim_id) as n from v_concept_claims l where claim_id in (select claim_id from v_claims where status <> 'unknown') group by 1) x on x.concept_no = c.concept_no
where c.concept_no in (select concept_no from v_mapped m join v_mappings d on m.mapping_id = d.mapping_id where decision <> 'reject')
union all select concept_no, null, 'rejected' from v_concepts_in where concept_no in (select concept_no from v_mapped m join v_mappings d on m.mapping_id = d.mapping_id where decision = 'reject')""")
def _(v):
    active, rejected = ln.active_concepts(v("v_concepts_in"), v("v_concept_claims"), v("v_claims"), v("v_mapped"), v("v_mappings"))
    return active.withColumn("state", F.lit("active")).unionByName(rejected.withColumn("state", F.lit("rejected")), allowMissingColumns=True)


VIEWS["v_dossier_repos"] = "select source as dossier_id, full_name as repository, k from v_docs where k = 1 and n % 3 <> 2"
VIEWS["v_dossier_approved"] = "select distinct source as dossier_id, full_name as repository from v_docs where k = 2 and n % 4 <> 3"
VIEWS["v_dossier_evidence"] = "select distinct source as dossier_id, full_name as repository from v_docs where lang = 'en' and k = 1"


@query("repository_set_match", """
select *, 'unapproved' as reason from (select dossier_id, repository from v_dossier_repos except select dossier_id, repository from v_dossier_approved)
union all select *, 'omitted' from (select dossier_id, repository from v_dossier_approved except select dossier_id, repository from v_dossier_repos)
union all select *, 'no-evidence' from (select dossier_id, repository from v_dossier_repos except select dossier_id, repository from v_dossier_evidence)
union all select dossier_id, repository, 'declared-twice' from v_dossier_repos group by all having count(*) > 1""".replace("group by all having", "group by dossier_id, repository having"))
def _(v):
    return ln.repository_set_match(v("v_dossier_repos"), v("v_dossier_approved"), v("v_dossier_evidence"))
