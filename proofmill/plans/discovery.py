"""Queries over tasks, vocabulary and repository search."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofmill.functions import text as tx
from proofmill.operators import domain as dm
from proofmill.plans import duck as d
from proofmill.plans.registry import oracle_view, query
from proofmill.sources.sinks import landed


@query("normalize_text", f"select full_name, {d.norm('full_name || chr(32) || description || chr(32) || upper(description)')} as norm from v_catalog")
def _(v):
    return v("v_catalog").select("full_name", tx.normalize_text(
        F.concat_ws(" ", "full_name", "description", F.upper("description"))).alias("norm"))


@query("contains_term", f"""
select slice_id, {d.contains_norm(d.norm('content'), "'the'")} as has_the, {d.contains_norm(d.norm('content'), "'of the'")} as has_phrase,
  {d.contains_norm(d.norm('content'), "'store'")} as has_store from v_slices""")
def _(v):
    terms = {"has_the": "the", "has_phrase": "of the", "has_store": "Store"}
    return tx.with_terms_held(v("v_slices").select("slice_id", "content"), "content", terms).drop("content")


@query("meaningful_terms", f"select task_id, {d.joined(d.meaningful('task'))} as terms from v_task_text")
def _(v):
    return v("v_task_text").select("task_id", F.array_join(tx.meaningful_terms(F.col("task")), "|").alias("terms"))


PLAIN = r"regexp_replace(regexp_replace({}, '[^\p{L}\p{N} +_-]+', ' ', 'g'), ' +', ' ', 'g')"


@query("plain_search_term", f"""
select task_id, trim(substring(trim({PLAIN.replace('{}', 'task')}), 1, 100)) as term from v_task_text""")
def _(v):
    return v("v_task_text").select("task_id", tx.plain_search_term(F.col("task")).alias("term"))


@query("plain_search_term_folded")
def _(v):
    return v("v_task_text").select("task_id", tx.plain_search_term(tx.nfkc(F.col("task"))).alias("term"))


oracle_view("o_anchors", f"""
select task_id, anchor_rank, term, hits from (
  select *, row_number() over (partition by task_id order by hits desc, pos) as anchor_rank from (
    select task_id, term, count(*) as hits, min(pos) as pos from (
      select task_id, unnest(terms) as term, generate_subscripts(terms, 1) as pos from (
        select t.task_id, {d.meaningful("t.task || ' ' || array_to_string(t.must_have, ' ')", "coalesce(t.language, '') || ' ' || coalesce(t.ecosystem, '')")} as terms
        from v_tasks t where t.task_id not in (select task_id from v_concepts)))
    where regexp_matches(term, '^[a-z0-9]+$') group by task_id, term)) where anchor_rank <= 12""")

oracle_view("o_concepts", f"""
select task_id, kind, ordinal, {d.norm('name')} as concept,
  list_sort(list_distinct(list_filter(list_transform(aliases, lambda a: {d.norm('a')}), lambda a: a <> {d.norm('name')} and a <> ''))) as aliases
from v_concepts""")

oracle_view("o_terms", """
select distinct task_id, kind, concept, term, term <> concept as is_alias from (
  select task_id, kind, concept, unnest(list_distinct(list_prepend(concept, aliases))) as term from o_concepts)
union all select task_id, 'lexical', term, term, false from o_anchors""")

oracle_view("o_repo_text", f"""
select full_name, {d.norm("full_name || ' ' || description || ' ' || array_to_string(topics, ' ')")} as norm from v_catalog""")

oracle_view("o_matches", f"""
select task_id, kind, concept, term, full_name from o_terms join (
  select t.term as t2, r.full_name from (select distinct term from o_terms) t join o_repo_text r on {d.contains_norm('r.norm', 't.term')}) m on term = m.t2""")

oracle_view("o_domain", """
select m.task_id, full_name, cast(case when n_anchors > 0 then round(25 + 50 * matched / n_anchors)
    else round(60 + 25 * capabilities / greatest(n_capabilities, 1)) end as bigint) as domain, matched, capabilities, n_capabilities
from (select task_id, full_name, count(distinct case when kind in ('purpose', 'lexical') then term end) as matched,
        count(distinct case when kind = 'capability' then concept end) as capabilities from o_matches group by 1, 2) m
join (select task_id, count(distinct case when kind = 'capability' then concept end) as n_capabilities,
        count(case when kind = 'lexical' then 1 end) as n_anchors from o_terms group by 1) s on m.task_id = s.task_id
where matched > 0""")

oracle_view("o_query_terms", """
select task_id, list_prepend(concept, aliases)[1:3] as terms from o_concepts where kind = 'purpose'
union all
select task_id, case when len(a) > 2 then [array_to_string(a[1:2], ' '), array_to_string(a, ' ')] else [array_to_string(a, ' ')] end from (
  select task_id, list(term order by anchor_rank) as a from o_anchors where anchor_rank <= 3 group by task_id)""")

oracle_view("o_queries", f"""
select task_id, row_number() over (partition by task_id order by pos) as query_no, query, language, cast(100 as bigint) as min_stars from (
  select task_id, query, language, min(pos) as pos from (
    select task_id, unnest(queries) as query, null as language, generate_subscripts(queries, 1) as pos from v_tasks
    union all select q.task_id, terms[1], language, 100 from o_query_terms q join v_tasks t on q.task_id = t.task_id where language is not null
    union all select task_id, unnest(terms), null, 200 + generate_subscripts(terms, 1) from o_query_terms)
  where {d.trimmed('query')} <> '' group by task_id, query, language)
qualify query_no <= 5""".replace("select task_id, query, language, min(pos)", f"select task_id, {d.trimmed('query')} as query, language, min(pos)").replace("group by task_id, query, language)", "group by 1, 2, 3)"))

oracle_view("o_hits", """
select q.task_id, q.query_no, h.hit_rank, h.full_name, h.stars from o_queries q join (
  select query, language, full_name, stars, row_number() over (partition by query, language order by stars desc, full_name) as hit_rank from (
    select distinct a.query, a.language, r.full_name, r.stars from (select distinct query, lower(language) as language from o_queries) a
    join (select c.*, t.norm from v_catalog c join o_repo_text t on c.full_name = t.full_name where not archived and not fork and stars >= 100) r
      on list_has_all(split(r.norm, ' '), split(NORMQ, ' ')) and (a.language is null or a.language = lower(r.language)))
  qualify hit_rank <= 12) h on q.query = h.query and lower(q.language) is not distinct from h.language""".replace("NORMQ", d.norm("a.query")))

oracle_view("o_ranked", """
select task_id, candidate_rank, full_name, score, hits, domain, stars from (
  select *, row_number() over (partition by task_id order by score desc, stars desc, full_name) as candidate_rank from (
    select f.task_id, f.full_name, hits, stars, coalesce(d.domain, 0) as domain,
      round(coalesce(d.domain, 0) * 10 + hits * 12 + rrf * 40 + log10(stars + 1), 2) as score
    from (select task_id, full_name, count(*) as hits, sum(1 / (10 + pos)) as rrf, max(stars) as stars from (
            select task_id, query_no, full_name, min(hit_rank) as pos, max(stars) as stars from o_hits group by 1, 2, 3) group by 1, 2) f
    left join o_domain d on f.task_id = d.task_id and f.full_name = d.full_name))
where candidate_rank <= 6""")


oracle_view("o_text_anchors", f"""
select task_id, anchor_rank, term, hits from (
  select *, row_number() over (partition by task_id order by hits desc, pos) as anchor_rank from (
    select task_id, term, count(*) as hits, min(pos) as pos from (
      select task_id, unnest(terms) as term, generate_subscripts(terms, 1) as pos from (select task_id, {d.meaningful('task')} as terms from v_task_text))
    where regexp_matches(term, '^[a-z0-9]+$') group by task_id, term)) where anchor_rank <= 12""")


@query("lexical_anchors", "select task_id, anchor_rank, term, hits from o_text_anchors")
def _(v):
    out = dm.lexical_anchors(v("v_task_text"))
    return out.withColumn("anchor_rank", F.col("anchor_rank").cast("long"))


@query("task_terms", "select task_id, kind, concept, term, is_alias from o_terms")
def _(v):
    return dm.task_terms(v("v_tasks"), v("v_concepts"))


@query("plan_queries", "select * from o_queries")
def _(v):
    return dm.plan_queries(v("v_tasks"), v("v_concepts"))


@query("search_topk", "select * from o_hits")
def _(v):
    return dm.search_topk(dm.plan_queries(v("v_tasks"), v("v_concepts")), v.unlanded("v_catalog"))


def terms(v):
    return v.memo("terms", lambda: landed(dm.task_terms(v("v_tasks"), v("v_concepts")), "terms"))


def domain(v):
    t = terms(v)
    return dm.domain_signal(t, dm.term_matches(t, v("v_catalog")))


def hits(v):
    """A search asks for names, words and stars only, so no other column of the catalogue is made."""
    return v.memo("hits", lambda: landed(dm.search_topk(dm.plan_queries(v("v_tasks"), v("v_concepts")), v.unlanded("v_catalog")), "hits"))


def found_catalog(v):
    """The catalogue of repositories that some query found; where the whole is not landed, only the lines of their parts are aggregated."""
    def make():
        found = hits(v).select("full_name").distinct()
        if v.has_landed("v_catalog"):
            return landed(v("v_catalog").join(found, "full_name", "left_semi"), "found-catalog")
        part, lines = v.base("part"), v.base("lineitem")
        named = v.unlanded("v_catalog", lineitem=lines.filter("false")).join(found, "full_name", "left_semi")
        keys = landed(named.select("p_partkey").distinct(), "found-parts")
        return landed(v.unlanded("v_catalog", part=part.join(keys, "p_partkey", "left_semi"),
                                 lineitem=lines.join(keys, lines["l_partkey"] == keys["p_partkey"], "left_semi")), "found-catalog")

    return v.memo("found_catalog", make)


def found_domain(v):
    """Only repositories some query found are matched against the vocabulary."""
    return v.memo("found_domain", lambda: landed(dm.domain_signal(terms(v), dm.term_matches(terms(v), found_catalog(v))), "domain"))


def ranked(v):
    return v.memo("ranked", lambda: dm.fuse_search_hits(hits(v), found_domain(v)))


@query("term_matches", "select * from o_matches")
def _(v):
    return dm.term_matches(terms(v), v("v_catalog"))


@query("domain_signal", "select * from o_domain")
def _(v):
    return domain(v)


@query("fuse_search_hits", "select * from o_ranked")
def _(v):
    return ranked(v)


REQUESTED = "select 't_' || replace(p_name, ' ', '_') as task_id, lower(c.full_name) as repository from part p join v_catalog c on p.p_partkey = c.p_partkey"


@query("exclude_requested", f"select r.* from o_ranked r where (task_id, full_name) not in (select task_id, repository from ({REQUESTED}))")
def _(v):
    names = v.sql("select 't_' || replace(p_name, ' ', '_') as task_id, p_partkey from part")
    asked = names.join(v("v_catalog").select("p_partkey", F.upper("full_name").alias("repository")), "p_partkey")
    return dm.exclude_requested(ranked(v), asked)


TEXT_CAPS = "select task_id, task, task as purpose, split(task, ',') as capabilities from v_task_text"


@query("advisory_tasks", f"""
select task_id, task, purpose, {d.joined('caps')} as capabilities, rtrim(substring(task, 1, 600)) as evidence from (
  select task_id, {d.collapsed('task')} as task, trim(substring(trim({PLAIN.replace('{}', 'task')}), 1, 100)) as purpose,
    list_transform(list_filter(list_zip(caps0, range(1, len(caps0) + 1)), lambda z: list_position(caps0, z[1]) = z[2]), lambda z: z[1])[1:6] as caps from (
    select *, list_filter(list_transform(capabilities, lambda c: trim(substring(trim({PLAIN.replace('{}', 'c')}), 1, 100))), lambda c: c <> '') as caps0 from ({TEXT_CAPS})))
where task <> '' and purpose <> '' and len(caps) > 0""")
def _(v):
    good, _bad = dm.advisory_tasks(v.sql(TEXT_CAPS))
    return good.withColumn("capabilities", F.array_join("capabilities", "|"))


@query("content_capability_coverage", f"""
with parts as (select task_id, concept, unnest(list_distinct(list_concat(whole, list_filter(flatten(list_transform(whole, lambda a: regexp_split_to_array(a, '[ +_-]+'))),
    lambda p: length(p) >= 3)))) as term from (select task_id, concept, list_prepend(concept, aliases) as whole from o_concepts where kind = 'capability')),
texts as (select slice_id, full_name, path, {d.norm('content')} as norm from v_slices where list_has_any(evidence_roles, ['implementation', 'test'])),
found as (select distinct t.term, x.full_name, x.path from (select distinct term from parts) t join texts x on {d.contains_norm('x.norm', 't.term')})
select c.*, e.evidence from (
  select p.task_id, f.full_name, count(distinct concept) as matched, any_value(total) as total, count(distinct concept) / any_value(total) as ratio, count(distinct path) as paths
  from parts p join found f on p.term = f.term join (select task_id, count(distinct concept) as total from parts group by 1) n on p.task_id = n.task_id
  group by 1, 2) c
join (select task_id, full_name, string_agg(supports, '|' order by supports) as evidence from (
  select task_id, full_name, concept || ': ' || string_agg(distinct path, ', ' order by path) as supports from parts p join found f on p.term = f.term group by task_id, full_name, concept) group by 1, 2) e
  on e.task_id = c.task_id and e.full_name = c.full_name""")
def _(v):
    return dm.content_capability_coverage(v("v_concepts"), v("v_slices")).withColumn("evidence", F.array_join("evidence", "|"))


@query("search_term_hits_in_window", """
select slice_id, len(list_filter(['and', 'der', 'of', 'run', 'the', 'und'], lambda t: contains(lower(content), t))) as term_hits
from v_slices""")
def _(v):
    slices = v("v_slices")
    words = F.explode(F.array(*[F.lit(w) for w in ("The", "and", "of", "der", "und", "run", "the")])).alias("term")
    wanted = slices.select("full_name").distinct().select("full_name", words)
    return dm.window_term_hits(slices, wanted, ["full_name"]).select("slice_id", "term_hits")


BAD = "(length({t}) < 2 or length({r}) > 100 or not regexp_matches({r}, '^[\\p{{L}}\\p{{N}} +_-]+$'))"


def _bad(t):
    return BAD.format(t=d.trimmed(t), r=t)


def _generic(t):
    return f"len({d.meaningful(d.norm(t), PREFS)}) = 0"


PREFS = "coalesce(language, '') || ' ' || coalesce(ecosystem, '')"


@query("validate_domain_profiles", f"""
select task_id, kind, ordinal, unnest(split(r, '|')) as reason from (
  select c.task_id, kind, ordinal, {d.reasons(
      (f"{_bad('name')} or len(list_filter(aliases, lambda a: {_bad('a')})) > 0", "'term-shape'"),
      (f"{_generic('name')} or len(list_filter(aliases, lambda a: {_generic('a')})) > 0", "'term-generic'"),
      ("len(aliases) > 6", "'too-many-aliases'"),
      (f"length({d.trimmed('evidence')}) < 3 or length(evidence) > 600", "'quote-length'"),
      (f"not contains(lower(regexp_replace(task || ' ' || array_to_string(must_have, ' '), '{d.SPACES}+', ' ', 'g')), lower({d.collapsed('evidence')}))", "'quote-not-grounded'"))} as r
  from v_concepts c join v_tasks t on c.task_id = t.task_id) where r <> ''""")
def _(v):
    return dm.validate_domain_profiles(v("v_tasks"), v("v_concepts"))[1]


@query("normalize_task_lists", f"""
select task_id, {d.joined(f"list_sort(list_distinct(list_filter(list_transform(must_have, lambda m: {d.collapsed('m')}), lambda m: m <> '')))")} as must_have from v_tasks""")
def _(v):
    good, _bad_rows = dm.normalize_task_lists(v("v_tasks"), "must_have", 20, 2000)
    return good.select("task_id", F.array_join("must_have", "|").alias("must_have"))


REF_RAW = d.trimmed("requested")
REF_URL = "(?i)^(https?://github\\.com/[^/]+/[^@/?#]+)(?:@(.+))?$"
oracle_view("o_refs", f"""
select *, count(*) over (partition by task_id) as n, row_number() over (partition by task_id, repository order by seq) as nth from (
  select *, {d.reasons(("raw = ''", "'empty'"), ("raw <> '' and is_url and not ok_url", "'url-shape'"),
                       ("not coalesce(regexp_matches(repository, '^[a-z0-9_.-]+/[a-z0-9_.-]+$'), false)", "'name-shape'"),
                       ("length(revision) > 200", "'revision-shape'"))} as shape from (
    select task_id, seq, raw, is_url, regexp_matches(raw, '{REF_URL}') as ok_url,
      lower(regexp_replace({d.trimmed("case when is_url then regexp_extract(raw, '(?i)^https?://github\\.com/([^/]+/[^@/?#]+)(?:@.+)?$', 1) else split_part(raw, '@', 1) end")}, '(?i)\\.git$', '')) as repository,
      nullif({d.trimmed(f"case when is_url then regexp_extract(raw, '{REF_URL}', 2) when contains(raw, '@') then regexp_replace(raw, '^[^@]*@', '') end")}, '') as revision
    from (select task_id, seq, {REF_RAW} as raw, regexp_matches({REF_RAW}, '(?i)^https?://') as is_url from v_requested)))""")


@query("parse_repository_refs", """
select task_id, seq, repository, revision, 'ok' as reason from o_refs where shape = '' and nth = 1 and n <= 2
union all
select task_id, seq, null, null, unnest(split(concat_ws('|', nullif(shape, ''), case when shape = '' and nth > 1 then 'duplicate' end, case when n > 2 then 'too-many' end), '|'))
from o_refs where not (shape = '' and nth = 1 and n <= 2)""")
def _(v):
    # Both halves of the split in one pass over the judged rows.
    good = F.size("reasons") == 0
    return dm.judged_refs(v("v_requested")).select("task_id", "seq", F.when(good, F.col("repository")).alias("repository"), F.when(good, F.col("revision")).alias("revision"),
                                                   F.explode(F.when(good, F.array(F.lit("ok"))).otherwise(F.col("reasons"))).alias("reason"))
