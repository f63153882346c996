"""Queries over style sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofmill import fixed_values as fv
from proofmill.functions import text as tx
from proofmill.operators import style as sy
from proofmill.params import DEFAULT
from proofmill.plans import duck as d
from proofmill.plans.registry import oracle_view, query
from proofmill.sources import scans

CLASS_RX = d.lit(r"(?i)\b" + fv.CLASS_ATTRIBUTE)
oracle_view("o_style", f"""
select * from v_style where (regexp_matches(path, {d.lit(fv.STYLE_FILE)}) or regexp_matches(path, {d.lit(fv.STYLE_CONFIG)}))
  and not list_has_any(split(path, '/'), [{d.words(fv.STYLE_IGNORED_DIRS)}])""")
oracle_view("o_classes", f"""
select workspace, path, token from (
  select workspace, path, unnest(regexp_split_to_array(regexp_extract(a, {CLASS_RX}, 1) || regexp_extract(a, {CLASS_RX}, 2) || regexp_extract(a, {CLASS_RX}, 3), '{d.SPACES}+')) as token
  from (select workspace, path, unnest(regexp_extract_all(content, {CLASS_RX})) as a from o_style)) where token <> ''""")
oracle_view("o_vars", f"""
select workspace, variable, arg_max(value, path || lpad(cast(pos as varchar), 9, '0')) as value from (
  select workspace, path, lower(n) as variable, {d.trimmed('x')} as value, pos from (
    select workspace, path, unnest(regexp_extract_all(content, {d.lit(fv.VARIABLE_DEFINITION)}, 1)) as n, unnest(regexp_extract_all(content, {d.lit(fv.VARIABLE_DEFINITION)}, 2)) as x,
      generate_subscripts(regexp_extract_all(content, {d.lit(fv.VARIABLE_DEFINITION)}, 1), 1) as pos from o_style)) group by 1, 2""")
oracle_view("o_backgrounds", f"""
select r.workspace, path, cast(pos - 1 as int) as pos, case when named is null then raw else named || ' -> ' || value end as label, case when named is null then raw else value end as resolved from (
  select *, nullif(regexp_extract({d.trimmed('raw')}, '(?i)^var\\(\\s*(--[a-z0-9_-]+)\\s*\\)$', 1), '') as named from (
    select workspace, path, unnest(regexp_extract_all(content, {d.lit(fv.BACKGROUND)}, 1)) as raw, generate_subscripts(regexp_extract_all(content, {d.lit(fv.BACKGROUND)}, 1), 1) as pos from o_style)) r
left join o_vars v on r.workspace = v.workspace and lower(named) = variable where named is null or value is not null""")


def color_sql(c):
    v = f"lower({d.trimmed(c)})"
    short, long_ = "^#([0-9a-f])([0-9a-f])([0-9a-f])$", "^#([0-9a-f]{2})([0-9a-f]{2})([0-9a-f]{2})(?:ff)?$"
    rgb = r"^rgba?\(\s*(\d{1,3})\s*,\s*(\d{1,3})\s*,\s*(\d{1,3})(?:\s*,\s*(1(?:\.0)?))?\s*\)$"

    def ch(i):
        return (f"cast(case when regexp_matches({v}, '{short}') then cast('0x' || regexp_extract({v}, '{short}', {i}) || regexp_extract({v}, '{short}', {i}) as bigint) "
                f"when regexp_matches({v}, '{long_}') then cast('0x' || regexp_extract({v}, '{long_}', {i}) as bigint) "
                f"when regexp_matches({v}, '{rgb}') then cast(regexp_extract({v}, '{rgb}', {i}) as bigint) end as bigint)")

    light = r"^(?:hsl\(\s*)?\d+(?:\.\d+)?(?:deg)?[ ,]+\d+(?:\.\d+)?%[ ,]+(\d+(?:\.\d+)?)%"
    black = r"^(?:hsl\(\s*)?0(?:deg)?[ ,]+0%[ ,]+0%(?:\s*/\s*100%)?\s*\)?$"
    pure = f"({v} = 'black' or coalesce({ch(1)} + {ch(2)} + {ch(3)} = 0, false) or regexp_matches({v}, '{black}'))"
    near = (f"(not {pure} and case when {ch(1)} is not null then greatest({ch(1)}, {ch(2)}, {ch(3)}) <= 24 "
            f"else coalesce(try_cast(nullif(regexp_extract({v}, '{light}', 1), '') as double) <= 8, false) end)")
    return ch(1), ch(2), ch(3), pure, near


R, G, B, PURE, NEAR = color_sql("resolved")
WORD_COLOR = fv.COLOR_LITERAL.replace("(?:WORD_END)", r"\b")


def _caps(bucket, pattern, group=1):
    return f"select workspace, path, '{bucket}' as bucket, unnest(regexp_extract_all(content, {d.lit(pattern)}, {group})) as value from o_style"


def _toks(bucket, pattern):
    return f"select workspace, path, '{bucket}', token from o_classes where regexp_matches(token, {d.lit(pattern)})"


oracle_view("o_values", "select workspace, path, bucket, lower(" + d.collapsed("value") + ") as value from (" + " union all ".join([
    _caps("custom-property-definitions", r"(?i)(--[a-z0-9_-]+)\s*:\s*[^;}{]{1,160}"), _caps("custom-property-references", fv.VARIABLE_REFERENCE),
    _caps("colors", WORD_COLOR), _caps("font-sizes", fv.FONT_SIZE), _toks("font-sizes", fv.CLASS_FONT_SIZE),
    _caps("radii", fv.BORDER_RADIUS), _toks("radii", fv.CLASS_RADIUS), _toks("pure-black-backgrounds", fv.CLASS_BLACK),
    _toks("near-black-backgrounds", fv.CLASS_NEAR_BLACK), _caps("border-declarations", r"(?i)\b(border(?:-[a-z]+)?)\s*:"),
    _toks("border-declarations", fv.CLASS_BORDER), _caps("shadows", r"(?i)(box-shadow)\s*:"), _toks("shadows", fv.CLASS_SHADOW),
    _caps("gradients", r"(?i)\b((?:linear|radial|conic)-gradient)\b"), _toks("gradients", fv.CLASS_GRADIENT),
    _caps("responsive-signals", r"(?i)(@media)\s*\("), _toks("responsive-signals", fv.CLASS_RESPONSIVE),
    _caps("card-like-references", rf"(?i)\b({fv.CARD_WORDS})\b"),
    f"select workspace, path, case when {PURE} then 'pure-black-backgrounds' else 'near-black-backgrounds' end, label from o_backgrounds where {PURE} or {NEAR}",
]) + ") where " + d.collapsed("value") + " <> ''")
oracle_view("o_metrics", "select workspace, bucket, value, count(*) as count, count(distinct path) as files from o_values group by 1, 2, 3")


def sources(v):
    return scans.scan_workspaces(v("v_style"))[0]


@query("scan_workspaces", "select workspace, path, length(content) as chars from o_style")
def _(v):
    return sources(v).select("workspace", "path", F.length("content").cast("long").alias("chars"))


ROOM = f"{DEFAULT.workspace_characters} - b.used"
WHY = (f"case when b.n >= {DEFAULT.workspace_files} then 'maximum-files-reached' when {ROOM} <= 0 then 'maximum-characters-reached' "
       f"when f.chars > {DEFAULT.workspace_file_characters} or f.chars > {ROOM} then 'file-exceeds-remaining-character-budget' end")


@query("budget_workspace_files", f"""
with recursive f as (select workspace, path, cast(length(content) as bigint) as chars, row_number() over (partition by workspace order by path) as nth from o_style),
b as (select distinct workspace, cast(0 as bigint) as nth, cast(0 as bigint) as n, cast(0 as bigint) as used, cast(null as varchar) as path, cast(null as varchar) as reason from f
  union all select f.workspace, f.nth, b.n + case when {WHY} is null then 1 else 0 end, b.used + case when {WHY} is null then f.chars else 0 end, f.path, {WHY} from b join f on f.workspace = b.workspace and f.nth = b.nth + 1)
select workspace, path, reason from b where nth > 0""")
def _(v):
    kept, skipped = scans.budget_workspace_files(sources(v))
    return kept.select("workspace", "path", F.lit(None).cast("string").alias("reason")).unionByName(skipped)


@query("class_tokens", "select workspace, path, token, count(*) as n from o_classes group by all")
def _(v):
    return sy.class_tokens(sources(v)).groupBy("workspace", "path", "token").agg(F.count("*").alias("n"))


@query("resolve_style_vars", "select * from o_backgrounds")
def _(v):
    return sy.resolve_style_vars(sources(v))


@query("color_class", f"select workspace, path, pos, resolved, {R} as red, {G} as green, {B} as blue, {PURE} as pure_black, {NEAR} as near_black from o_backgrounds")
def _(v):
    return sy.resolve_style_vars(sources(v)).select("workspace", "path", "pos", "resolved", tx.style_color(F.col("resolved")).alias("c")).select(
        "workspace", "path", "pos", "resolved", "c.*")


@query("style_metrics", "select * from o_metrics")
def _(v):
    return sy.style_metrics(sources(v))


@query("style_metric_paths", "select distinct workspace, bucket, value, path from o_values")
def _(v):
    return sy.style_metric_paths(sources(v))


def total(b):
    return f"coalesce(sum(case when bucket = '{b}' then count end), 0)"


def kinds(b):
    return f"count(case when bucket = '{b}' then 1 end)"


oracle_view("o_style_facts", f"""
select f.workspace, f.files, coalesce(borders, 0) as borders, coalesce(cards, 0) as cards, coalesce(gradients, 0) as gradients, coalesce(radii, 0) as radii, coalesce(top_radius, 0) as top_radius,
  coalesce(types, 0) as types, coalesce(responsive, 0) as responsive, coalesce(colors, 0) as colors, coalesce(tokens, 0) as tokens, coalesce(black, 0) as black, coalesce(near, 0) as near
from (select workspace, count(*) as files from o_style group by 1) f left join (
  select workspace, {total('border-declarations')} as borders, {total('card-like-references')} as cards, {total('gradients')} as gradients, {total('radii')} as radii,
    max(case when bucket = 'radii' then count end) as top_radius, {kinds('font-sizes')} as types, {kinds('responsive-signals')} as responsive, {kinds('colors')} as colors,
    {kinds('custom-property-references')} as tokens, {kinds('pure-black-backgrounds')} as black, {kinds('near-black-backgrounds')} as near from o_metrics group by 1) m on f.workspace = m.workspace""")
PROFILE_ROWS = " union all ".join(f"select '{p}' as profile, {b} as mb, {c} as mc, {t} as mt, {r}e0 as ms, '{g}' as gp" for p, (b, c, t, r, g) in fv.STYLE_PROFILES.items())
oracle_view("o_findings", f"""
select workspace, profile, signal, case signal when 'pure-black-surface' then 'error' else 'warning' end as severity from (
  select workspace, profile, unnest(split(s, '|')) as signal from (select workspace, profile, {d.reasons(
    ("black > 0", "'pure-black-surface'"), ("near > 0", "'near-black-surface'"), ("borders > mb", "'border-heavy-surface'"), ("cards > mc", "'card-grid-saturation'"),
    ("radii >= 5 and top_radius / radii > ms", "'uniform-radius-repetition'"), ("types < mt", "'weak-type-hierarchy'"), ("responsive = 0", "'responsive-evidence-missing'"),
    ("gp = 'avoid' and gradients > 0", "'profile-gradient-mismatch'"), ("colors > 10 and tokens < 3", "'raw-color-sprawl'"))} as s
    from o_style_facts cross join ({PROFILE_ROWS})) where s <> '')""")


def facts(v):
    src = sources(v)
    return sy.workspace_facts(src, sy.style_metrics(src))


@query("style_audit", "select * from o_findings")
def _(v):
    return sy.style_audit(facts(v))


@query("style_audit_status", f"""
select f.workspace, p.profile, case when bool_or(coalesce(severity = 'error', false)) then 'blocked' when bool_or(coalesce(severity = 'warning', false)) then 'review' else 'clean' end as status
from o_style_facts f cross join ({PROFILE_ROWS}) p left join o_findings x on x.workspace = f.workspace and x.profile = p.profile group by 1, 2""")
def _(v):
    f = facts(v)
    return sy.audit_status(f, sy.style_audit(f))


@query("style_spec_facts", f"""
select workspace, {kinds('custom-property-definitions')} as custom_properties, bool_or(bucket = 'responsive-signals') as responsive,
  any_value(colors) as colors, any_value(font_sizes) as font_sizes, any_value(radii) as radii from (
  select w.*, c.v as colors, f.v as font_sizes, r.v as radii from o_metrics w
  left join (select workspace, string_agg(value, '|' order by rn) as v from (select workspace, value, row_number() over (partition by workspace order by count desc, value) as rn from o_metrics where bucket = 'colors') where rn <= 8 group by 1) c on c.workspace = w.workspace
  left join (select workspace, string_agg(value, '|' order by rn) as v from (select workspace, value, row_number() over (partition by workspace order by count desc, value) as rn from o_metrics where bucket = 'font-sizes') where rn <= 8 group by 1) f on f.workspace = w.workspace
  left join (select workspace, string_agg(value, '|' order by rn) as v from (select workspace, value, row_number() over (partition by workspace order by count desc, value) as rn from o_metrics where bucket = 'radii') where rn <= 6 group by 1) r on r.workspace = w.workspace)
group by 1""")
def _(v):
    out = sy.style_spec_facts(sy.style_metrics(sources(v)))
    return out.select("workspace", "custom_properties", "responsive", *[F.nullif(F.array_join(c, "|"), F.lit("")).alias(c) for c in ("colors", "font_sizes", "radii")])


def hit(words, plain):
    return f"regexp_matches(x, {d.lit('(?i)' + chr(92) + 'b(' + words + ')' + chr(92) + 'b|' + plain)})"


SIG = {n: (hit(w, p), pt) for n, pt, w, p in fv.VISUAL_SIGNALS}
SCORE = "least(100, " + " + ".join(f"case when {c} then {n} else 0 end" for c, n in SIG.values()) + ")"
E1, S1, F1, Q1 = [c for c, _n in SIG.values()]
VISUAL = f"(({E1} or ({S1} and ({F1} or {Q1}))) and {SCORE} >= 50)"
ROUTE_TEXT = "select task_id, concat_ws(' ', task, language, ecosystem, array_to_string(must_have, ' ')) as x from v_tasks union all select task_id, task from v_task_text"


@query("route_visual_tasks", f"""
select task_id, {SCORE} as score, case when {VISUAL} then 'visual-style' else 'software-precedent' end as route, {d.reasons(*[(c, d.lit(n)) for n, (c, _n) in SIG.items()])} as signals,
  case when {VISUAL} then case {' '.join(f"when {hit(w, p)} then '{n}'" for n, w, p in fv.VISUAL_ARCHETYPES)} else 'calm-product' end end as archetype from ({ROUTE_TEXT})""")
def _(v):
    a = v("v_tasks").select("task_id", F.concat_ws(" ", "task", "language", "ecosystem", F.array_join("must_have", " ")).alias("x"))
    rows = a.unionByName(v("v_task_text").withColumnRenamed("task", "x"))
    return sy.route_visual_tasks(rows, F.col("x")).withColumn("signals", F.array_join("signals", "|"))
