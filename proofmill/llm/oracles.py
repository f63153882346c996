"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

from proofmill.llm import quality_classifier, quality_rules

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

WARC = r"""
with digests as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, cast(unhex(sha1(coalesce(html, ''))) as bit)::varchar as bits,
         min(page_id) over (partition by coalesce(html, '')) as first
  from pages)
select page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + 16 * substr(bits, 5 * i + 1, 1)::int + 8 * substr(bits, 5 * i + 2, 1)::int + 4 * substr(bits, 5 * i + 3, 1)::int + 2 * substr(bits, 5 * i + 4, 1)::int + substr(bits, 5 * i + 5, 1)::int, 1)), '') as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to,
       case when page_id = first then true end as digest_ok
from digests
"""

SUBSTRING_DEDUP = rf"""
with w as (select doc_id, {WORDS} as ws from documents),
windows as (
  select doc_id, p, array_to_string(ws[p : p + 49], ' ') as t
  from (select doc_id, ws, unnest(range(1, len(ws) - 48)) as p from w where len(ws) >= 50)),
gone as (
  select distinct doc_id, unnest(range(p, p + 50)) as k
  from (select doc_id, p, min(doc_id) over (partition by t) as first from windows) where first < doc_id),
kept as (
  select doc_id, count(*) as n, string_agg(word, ' ' order by k) as text
  from (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as k from w) anti join gone using (doc_id, k)
  group by doc_id)
select doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from w left join kept using (doc_id)
"""

NEAR_DEDUP = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from documents),
sets as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) = 1 then [ws[1]]
    else list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) end as shingles
  from w),
shingles as (select doc_id, len(shingles) as n, unnest(shingles) as shingle from sets),
links as (
  select a.doc_id as x, b.doc_id as y
  from shingles a join shingles b on a.shingle = b.shingle and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n
  having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
steps as (select x, y from links union all select y, x from links),
reach as (select x, y from steps union select reach.x, steps.y from reach join steps on reach.y = steps.x)
select doc_id, len(shingles)::bigint as n_shingles, least(doc_id, coalesce(least_id, doc_id)) as component_id, least(doc_id, coalesce(least_id, doc_id)) = doc_id as kept
from sets left join (select x as doc_id, min(y) as least_id from reach group by x) using (doc_id)
"""


def bins_sql() -> str:
    """The bin numbers of quality_classifier as a list."""
    per_word = lambda x: f"case when n_words > 0 then 100 * {x} // n_words else 0 end"
    per_char = lambda x: f"case when chars > 0 then 100 * {x} // chars else 0 end"
    values = {"n_words": "n_words", "symbols": per_word("symbol_chars"), "shouts": per_word("shout_chars"), "capitals": per_char("capital_pairs"), "variety": per_word("distinct_words"), "word_length": per_word("chars")}
    return "[" + ", ".join("(" + " + ".join(f"(({values[s]}) >= {b})::int" for b in bounds) + ")" for s, bounds in quality_classifier.BINS.items()) + "]"


def quality_classifier_sql() -> str:
    q = quality_classifier
    sizes = "[" + ", ".join(str(len(b) + 1) for b in q.BINS.values()) + "]"
    strength = f"""least(greatest(level / greatest(spread - within, level / {q.MAX_STRENGTH}) - 1, {q.MIN_STRENGTH}), {q.MAX_STRENGTH})"""
    moments = lambda p: f"sum(n * pow(good / n - {p}, 2)) / sum(n) as spread, sum({p} * (1 - {p})) / sum(n) as within, sum(n * {p} * (1 - {p})) / sum(n) as level"
    return rf"""
with counts as (
  select doc_id, source, lang, len(ws) as n_words, len(list_distinct(ws)) as distinct_words, length(t) as chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) as symbol_chars, len(regexp_extract_all(t, '!')) as shout_chars, len(regexp_extract_all(t, '[A-Z][A-Z]')) as capital_pairs
  from (select *, coalesce(text, '') as t, {WORDS} as ws from documents)),
marks as (select doc_id, min(quality) as label from labels where quality in (0, 1) group by doc_id),
bins as (select doc_id, source, lang, label, {bins_sql()} as bins from counts left join marks using (doc_id)),
sides as (select count(*) filter (label = 1) as good, count(*) filter (label = 0) as bad from bins),
cells as (
  select s, b, count(*) filter (label = 1) as good, count(*) filter (label = 0) as bad
  from (select label, unnest(bins) as b, unnest(range(1, len(bins) + 1)) as s from bins where label is not null) group by s, b),
scored as (
  select bins.*, evidence, ln(share / (1 - share)) + evidence as odds, share
  from bins join (
    select doc_id, sum(case when sides.good > 0 and sides.bad > 0 then ln((coalesce(cells.good, 0) + {q.SMOOTHING}) / (sides.good + {q.SMOOTHING} * {sizes}[x.s])) - ln((coalesce(cells.bad, 0) + {q.SMOOTHING}) / (sides.bad + {q.SMOOTHING} * {sizes}[x.s])) else 0.0 end) as evidence
    from (select doc_id, unnest(bins) as b, unnest(range(1, len(bins) + 1)) as s from bins) x left join cells on x.s = cells.s and x.b = cells.b, sides group by doc_id) using (doc_id),
  (select (good + 1.0) / (good + bad + 2.0) as share from sides)),
paths as (select source, lang, any_value(share) as share, sum(coalesce(label::double, 1 / (1 + exp(-odds)))) as good, count(*)::double as n from scored group by source, lang),
hosts as (select source, any_value(share) as share, sum(good) as good, sum(n) as n from paths group by source),
host_strength as (select {strength} as k from (select {moments('share')} from hosts)),
parents as (select source, (good + k * share) / (n + k) as parent from hosts, host_strength),
below as (select paths.*, parent from paths join parents on paths.source is not distinct from parents.source),
path_strength as (select {strength} as k from (select {moments('parent')} from below)),
priors as (select source, lang, (good + k * parent) / (n + k) as prior from below, path_strength)
select doc_id, round(evidence, 6) as evidence, round(prior, 6) as prior, round(1 / (1 + exp(-(ln(prior / (1 - prior)) + evidence))), 6) as posterior,
       1 / (1 + exp(-(ln(prior / (1 - prior)) + evidence))) >= {q.THRESHOLD} as kept
from scored join priors on scored.source is not distinct from priors.source and scored.lang is not distinct from priors.lang
"""


def quality_rules_sql() -> str:
    q = quality_rules
    votes = "[" + ", ".join(f"case when {sql} then {q.BAD if name in q.FAULTS else q.GOOD} else {q.ABSTAIN} end" for name, sql in q.RULES.items()) + "]"
    start = lambda side: "[" + ", ".join(repr(p / sum(q.prior(r)[side])) for r in q.RULES for p in q.prior(r)[side]) + "]"
    first = lambda side: "[" + ", ".join(repr(p) for r in q.RULES for p in q.prior(r)[side]) + "]"
    sums = lambda side: "[" + ", ".join(repr(sum(q.prior(r)[side])) for r in q.RULES for _ in range(3)) + "]"
    rules = len(q.RULES)
    ratio = lambda v: f"list_sum(list_transform(range(0, {rules}), lambda j: ln(good[3 * j + 2 + {v}[j + 1]]) - ln(bad[3 * j + 2 + {v}[j + 1]])))"
    shares = lambda side, weight, whole: f"list_transform(range(0, {3 * rules}), lambda x: ({first(side)}[x + 1] + list_sum(list_transform(range(1, len(pats) + 1), lambda i: case when pats[i].v[x // 3 + 1] + 1 = x % 3 then {weight} else 0.0 end))) / ({whole} + {sums(side)}[x + 1]))"
    return rf"""
with recursive w as (
  select doc_id, coalesce(text, '') as t, {WORDS} as ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents),
windows as (
  select doc_id, p, count(*) over (partition by doc_id, t) as n
  from (select doc_id, p, array_to_string(ws[p : p + 7], ' ') as t from (select doc_id, ws, unnest(range(1, len(ws) - 6)) as p from w where len(ws) >= 8))),
repeats as (select doc_id, count(*) as n from (select distinct doc_id, unnest(range(p, p + 8)) as k from windows where n > 1) group by doc_id),
counts as (
  select w.doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
         len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(repeats.n, 0)::bigint as n_repeat_words,
         len(list_distinct(ws))::bigint as n_distinct, len(regexp_extract_all(t, '!'))::bigint as n_shouts, len(regexp_extract_all(t, '[A-Z][A-Z]'))::bigint as capital_pairs
  from w left join repeats using (doc_id)),
voted as (select *, {votes} as v from counts),
patterns as (select list(struct_pack(v := v, n := n) order by v) as pats from (select v, count(*)::double as n from voted group by v)),
em as (
  select 0 as step, {q.START_GOOD}::double as share, {start(0)}::double[] as good, {start(1)}::double[] as bad
  union all
  select step + 1, (list_sum(r) + 1) / (list_sum(list_transform(pats, lambda p: p.n)) + 2),
         {shares(0, 'r[i]', 'list_sum(r)')}, {shares(1, 'pats[i].n - r[i]', 'list_sum(list_transform(pats, lambda p: p.n)) - list_sum(r)')}
  from (select em.*, pats, list_transform(pats, lambda p: p.n / (1 + exp(-(ln(share) - ln(1 - share) + {ratio('p.v')})))) as r from em, patterns where step < {q.ITERATIONS})),
model as (select * from em where step = {q.ITERATIONS}),
judged as (select voted.*, 1 / (1 + exp(-(ln(share / (1 - share)) + {ratio('v')}))) as p, n_words < {q.BASE_WORDS} or 100 * n_repeat_words > {q.BASE_REPEATED} * n_words as base_failed from voted, model)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and p >= {q.THRESHOLD} as kept, round(p, 6) as posterior
from judged
"""


PREFIX_TRIE = r"""
with t as (
  select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as p
  from conversations where conv_id is not null),
convs as (
  select c, c - c % 20 as base, list_reduce(list_prepend(4294967295::ubigint, list_transform(regexp_extract_all(c::varchar, '.'), lambda x: ascii(x)::ubigint)),
    lambda s, b: list_reduce(list_prepend(xor(s, b), list_transform(range(0, 8), lambda i: i::ubigint)), lambda k, i: xor(k >> 1, 3988292384::ubigint * (k & 1::ubigint)))) as crc
  from (select distinct c from t)),
h as (select c, base, (xor(crc, 4294967295::ubigint) % 4)::bigint as h from convs),
rows as (
  select h.c, 0 as part, p, role, text from h join t on t.c = h.base where p < h
  union all select h.c, 1 as part, p, role, text from h join t on t.c = h.c where p >= h),
turns as (
  select c, row_number() over (partition by c order by part, p) as d, md5(length(role) || ':' || role || text) as k,
         len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) as words
  from rows),
places as (
  select c, d, words, md5(array_to_string(list(k) over (partition by c order by d), '')) as node from turns
  union all select c, 0, 0, '' from h),
nodes as (select node, d, min(c) as conv_id, count(*) as n_convs, any_value(words) as words from places group by 1, 2),
edges as (select distinct a.node, b.node as up, b.d as up_d from places a join places b on a.c = b.c and a.d = b.d + 1),
below as (select distinct a.node, b.node as top from places a join places b on a.c = b.c and a.d >= b.d),
kids as (select up, count(*) as n_children, any_value(up_d) from edges group by 1),
sums as (
  select top, count(*) filter (k.up is null) as n_leaves, sum((n_convs - 1) * words) as saved_tokens
  from below join nodes using (node) left join kids k on k.up = node group by 1),
ends as (
  select node, sha256(string_agg(c::varchar, ',' order by c)) as sha from (select p.* from places p join (select c, max(d) as d from places group by 1) using (c, d)) group by 1)
select n.conv_id, n.d::bigint as depth, u.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0) as n_children, n_leaves, saved_tokens::bigint as saved_tokens, coalesce(sha, sha256('')) as ends_sha256
from nodes n left join edges e on e.node = n.node left join nodes u on u.node = e.up left join kids k on k.up = n.node join sums s on s.top = n.node left join ends on ends.node = n.node
"""

ORACLES = {
    "op12_prefix_trie": PREFIX_TRIE,
    "op1_quality_classifier": quality_classifier_sql(),
    "op3_quality_rules": quality_rules_sql(),
    "op5_warc": WARC,
    "op8_substring_dedup": SUBSTRING_DEDUP,
    "op9_near_dedup": NEAR_DEDUP,
}
