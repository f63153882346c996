"""Queries over evaluation runs, fingerprints and workflow events."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofmill import fixed_values as fv
from proofmill.operators import evals as ev
from proofmill.operators import fingerprints as fp
from proofmill.plans import duck as d
from proofmill.plans.registry import oracle_view, query
from proofmill.sources.sinks import work_folder
from proofmill.streaming import phases, summaries

MET = """count(run_id) as runs, count(case when verification_exit_code = 0 then 1 end) as verified,
  count(case when verification_exit_code = 0 then 1 end) / greatest(count(run_id), 1) as verification_rate,
  round(coalesce(sum(duration_ms), 0) / greatest(count(run_id), 1), 3) as avg_duration_ms, round(coalesce(sum(changed_files), 0) / greatest(count(run_id), 1), 6) as avg_changed_files"""


@query("eval_summary", f"select n.variant, {MET} from (select unnest(['baseline', 'treatment', 'control']) as variant) n left join v_eval_runs r on n.variant = r.variant group by 1")
def _(v):
    return ev.eval_summary(v("v_eval_runs"), ("baseline", "treatment", "control"))


@query("eval_rollup", f"select suite, task_id, variant, cast(grouping(suite, task_id, variant) as bigint) as level, {MET} from v_eval_runs group by rollup (suite, task_id, variant)")
def _(v):
    return ev.eval_rollup(v("v_eval_runs"))


@query("eval_paired_delta", """
select coalesce(a.task_id, b.task_id) as task_id, coalesce(a.worker, b.worker) as worker, coalesce(a.repetition, b.repetition) as repetition,
  case when a.run_id is null or b.run_id is null then 'unpaired' when a.verification_exit_code is null or b.verification_exit_code is null then 'not-verified'
    when b.verification_exit_code = 0 and a.verification_exit_code <> 0 then 'improved' when a.verification_exit_code = 0 and b.verification_exit_code <> 0 then 'regressed' else 'same' end as outcome,
  round(b.duration_ms - a.duration_ms, 3) as delta_ms
from (select * from v_eval_runs where variant = 'baseline') a full join (select * from v_eval_runs where variant = 'treatment') b
  on a.task_id = b.task_id and a.worker = b.worker and a.repetition = b.repetition""")
def _(v):
    runs = v("v_eval_runs")
    return ev.eval_paired_delta(runs)


EVAL_TASKS = "select 's' || @s(o_custkey % 5) as suite, 'task' || @s(o_custkey) as task_id, 1 + count(*) % 4 as repetitions from orders group by o_custkey"


@query("eval_plan", f"""
select suite, task_id, repetition, variant, task_id || '-' || variant || '-r' || repetition as run_id from (select *, unnest(range(1, repetitions + 1)) as repetition from ({EVAL_TASKS})) cross join (select unnest(['baseline', 'treatment']) as variant)""")
def _(v):
    return ev.eval_plan(v.sql(EVAL_TASKS), ("baseline", "treatment", "baseline"))


@query("eval_plan_totals", f"select suite, cast(sum(repetitions) * 2 as bigint) as runs, cast(sum(repetitions) * 6 as bigint) as max_calls from ({EVAL_TASKS}) group by suite")
def _(v):
    return ev.eval_plan_totals(ev.eval_plan(v.sql(EVAL_TASKS)))


@query("changed_files", f"""
select coalesce(a.run, b.run) as run, coalesce(a.path, b.path) as path, case when a.h is null then 'added' when b.h is null then 'removed' else 'changed' end as change
from (select run, path, sha256(content) as h from v_before) a full join (select run, path, sha256(content) as h from v_after where not list_has_any(split(path, '/'), [{d.words(fv.SNAPSHOT_IGNORED)}])) b
  on a.run = b.run and a.path = b.path where a.h is distinct from b.h""")
def _(v):
    return ev.changed_files(v("v_before"), v("v_after"))


@query("last_json_object", """
select log_id, case when turn % 5 = 4 then '{"note": {"k": "a}b"}}' else regexp_extract(log, '\\{"approvedRepositories".*$') end as doc
from v_judge_log join (select conv_id || '-' || turn as id, turn from conversations) c on c.id = log_id""")
def _(v):
    return v("v_judge_log").select("log_id", ev.last_json_object("log").alias("doc"))


oracle_view("o_judge", """
select log_id, conv_id, turn, turn % 5 = 4 as broken, turn % 2 = 1 as outside, turn % 3 = 2 as short from v_judge_log join (select conv_id || '-' || turn as id, conv_id, turn from conversations) c on c.id = log_id""")


@query("judge_decisions", """
select log_id, 'repo/' || (conv_id + turn % 2) || '|repo/x' as approved, 'clear shared mechanism' as rationale, null as reason from o_judge where not broken and not outside and not short
union all select log_id, null, null, unnest(list_filter([case when broken then 'approved-missing' end, case when broken or short then 'rationale-vague' end, case when not broken and outside then 'approved-not-allowed' end], lambda x: x is not null))
from o_judge where broken or outside or short""")
def _(v):
    good, bad = ev.judge_decisions(v("v_judge_log"))
    return good.select("log_id", F.array_join("approved", "|").alias("approved"), "rationale", F.lit(None).cast("string").alias("reason")).unionByName(bad, allowMissingColumns=True)


# -- fingerprints ------------------------------------------------------------------------
FP_TASKS = """select task_id, task, must_have, queries, case length(task) % 3 when 0 then 'C:' || chr(92) || 'Work' || chr(92) || task_id when 1 then '/home/' || task_id || '/' else '/srv/' || task_id end as workspace,
  case length(task) % 2 when 0 then '  ' else 'r' || task_id end as revision from v_tasks"""
LISTS = lambda c: f"array_to_string(list_sort(list_distinct(list_filter(list_transform({c}, lambda x: {d.collapsed('x')}), lambda x: x <> ''))), chr(1))"
SLASH = "regexp_replace(replace(workspace, chr(92), '/'), '/$', '')"


@query("task_fingerprint", f"""
select task_id, sha256(concat_ws(chr(0), case when regexp_matches({SLASH}, '(?i)^[a-z]:/') then lower({SLASH}) else {SLASH} end, case when trim(revision) = '' then 'unversioned' else trim(revision) end,
  {d.collapsed('task')}, {LISTS('must_have')}, {LISTS('queries')})) as fingerprint from ({FP_TASKS})""")
def _(v):
    t = v.sql(FP_TASKS)
    return t.select("task_id", fp.task_fingerprint(F.col("task"), {"must_have": F.col("must_have"), "queries": F.col("queries")}, F.col("workspace"), F.col("revision")).alias("fingerprint"))


def group_fp(src, key, cols):
    h = "sha256(concat_ws(chr(0), " + ", ".join(f"coalesce('=' || cast({c} as varchar), '-')" for c in cols) + "))"
    w = ", ".join(f"sum(cast(cast('0x' || substring(h, {1 + 15 * i}, 15) as bigint) as hugeint)) as s{i}" for i in range(4))
    return (f"select {key}, rows, sha256(concat_ws(':', cast(rows as varchar), cast(s0 as varchar), cast(s1 as varchar), cast(s2 as varchar), cast(s3 as varchar))) as fingerprint "
            f"from (select {key}, count(*) as rows, {w} from (select {key}, {h} as h from {src}) group by {key})")


oracle_view("o_pack_before", group_fp("v_before", "run", ["path", "content"]))
oracle_view("o_pack_after", group_fp("v_after", "run", ["path", "content"]))


@query("pack_fingerprint", "select * from o_pack_after")
def _(v):
    return fp.group_fingerprint(v("v_after"), ["run"], ["path", "content"])


REVIEW_COLUMNS = ["review_no", "verdict", "risk", "confidence", "reviewer", "summary"]
oracle_view("o_review_a", group_fp("(select repository, review_no, verdict, risk, cast(confidence * 10 as bigint) as confidence, reviewer, summary from v_reviews)", "repository", REVIEW_COLUMNS))
oracle_view("o_review_b", group_fp("v_review_slices", "repository", ["review_no", "slice_id"]))


@query("review_fingerprint", "select a.repository, sha256(concat_ws(':', a.fingerprint, coalesce(b.fingerprint, '-'))) as fingerprint from o_review_a a left join o_review_b b on a.repository = b.repository")
def _(v):
    reviews = v("v_reviews").withColumn("confidence", (F.col("confidence") * 10).cast("long")).withColumn("reviewer", F.concat(F.lit("  "), "reviewer", F.lit("\t")))
    return fp.review_fingerprint(reviews, v("v_review_slices"), ["repository"], REVIEW_COLUMNS)


@query("tamper_check", """
select coalesce(a.run, b.run) as run, case when a.fingerprint is null then 'not-stored' when b.fingerprint is null then 'missing' else 'modified' end as reason
from o_pack_before a full join (select * from o_pack_after where run not like 'src9/%') b on a.run = b.run where a.fingerprint is distinct from b.fingerprint""")
def _(v):
    stored = fp.group_fingerprint(v("v_before"), ["run"], ["path", "content"])
    now = fp.group_fingerprint(v("v_after"), ["run"], ["path", "content"]).filter("run not like 'src9/%'")
    return fp.tamper_check(stored, now, ["run"])


# -- workflow phases ------------------------------------------------------------------------
def code_sql(table):
    return "case phase_now " + " ".join(f"when '{p}' then '{c}'" for p, c in table.items()) + " end"


AUDIT_SQL = f"""
select task_id, seq, tool, mode, phase_now, case when tool in ({d.words(fv.MUTATION_TOOLS)}) then case when mode = 'advisory' then {code_sql(fv.ADVISORY_SIGNALS)} else {code_sql(fv.STRICT_SIGNALS)} end end as signal
from (select *, coalesce(last_value(phase ignore nulls) over (partition by task_id order by ts, seq rows between unbounded preceding and 1 preceding), 'idle') as phase_now from v_workflow) where tool is not null"""


@query("phase_audit_batch", AUDIT_SQL)
def _(v):
    return phases.phase_audit_batch(v("v_workflow"))


@query("phase_audit_stream", AUDIT_SQL)
def _(v):
    folder = work_folder(v.spark)
    events = v("v_workflow")
    events.write.parquet(f"{folder}/events")
    stream = v.spark.readStream.schema(events.schema).parquet(f"{folder}/events")
    return summaries.run_to_table(phases.phase_audit_stream(stream), folder, "append")


@query("eval_summary_stream", """
select variant, count(*) as runs, count(case when verification_exit_code = 0 then 1 end) as verified, round(avg(duration_ms), 3) as avg_duration_ms, round(avg(changed_files), 6) as avg_changed_files from v_eval_runs group by 1""")
def _(v):
    folder = work_folder(v.spark)
    runs = v("v_eval_runs")
    runs.write.parquet(f"{folder}/runs")
    stream = v.spark.readStream.schema(runs.schema).parquet(f"{folder}/runs")
    return summaries.run_to_table(summaries.eval_summary_stream(stream), folder, "complete")
