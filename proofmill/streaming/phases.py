"""Phase audit of tool calls: batch with a window, streaming with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from proofmill import fixed_values as fv


def gate_signal(tool: Column, phase: Column, mode: Column) -> Column:
    """Signal code when a mutating tool is used in a phase that forbids it, else NULL."""
    def lookup(table: dict[str, str]) -> Column:
        return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[phase]

    code = F.when(mode == "advisory", lookup(fv.ADVISORY_SIGNALS)).otherwise(lookup(fv.STRICT_SIGNALS))
    return F.when(tool.isin(fv.MUTATION_TOOLS), code)


def phase_audit_batch(events: DataFrame) -> DataFrame:
    """Each tool call with the phase in force just before it.

    The as-of lookup keys on task and day: the last phase of each earlier day is found
    from one row per task and day, so a task with a very long history is not sorted
    by a single task.
    """
    e = events.withColumn("day", F.to_date("ts"))
    inside = Window.partitionBy("task_id", "day").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    within = e.withColumn("today", F.last("phase", ignorenulls=True).over(inside))
    closing = e.groupBy("task_id", "day").agg(F.max_by("phase", F.when(F.col("phase").isNotNull(), F.struct("ts", "seq"))).alias("closing"))
    earlier = Window.partitionBy("task_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    opening = closing.withColumn("opening", F.last("closing", ignorenulls=True).over(earlier)).select("task_id", "day", "opening")
    joined = within.join(opening, ["task_id", "day"], "left")
    phase = F.coalesce("today", "opening", F.lit("idle"))
    calls = joined.filter("tool is not null").withColumn("phase_now", phase)
    return calls.select("task_id", "seq", "tool", "mode", "phase_now", gate_signal(F.col("tool"), F.col("phase_now"), F.col("mode")).alias("signal"))


OUTPUT = "task_id string, seq bigint, tool string, mode string, phase_now string, signal string"


def _audit(expiry_ms: int):
    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Advance one task's phase over the new events and report its tool calls.

        A task's events of one trigger may come in several Arrow batches; they are put in order together.
        """
        if state.hasTimedOut:
            state.remove()
            return
        phase = state.get[0] if state.exists else "idle"
        rows = []
        for e in pd.concat(list(batches)).sort_values(["ts", "seq"]).itertuples(index=False):
            if isinstance(e.tool, str):
                table = fv.ADVISORY_SIGNALS if e.mode == "advisory" else fv.STRICT_SIGNALS
                rows.append((key[0], e.seq, e.tool, e.mode, phase, table.get(phase) if e.tool in fv.MUTATION_TOOLS else None))
            if isinstance(e.phase, str):
                phase = e.phase
        state.update((phase,))
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + expiry_ms)
        yield pd.DataFrame(rows, columns=["task_id", "seq", "tool", "mode", "phase_now", "signal"])

    return advance


def phase_audit_stream(events: DataFrame, lateness: str = "1 hour", expiry_hours: int = 7 * 24) -> DataFrame:
    """The same audit, incrementally; a task idle for expiry_hours beyond the watermark is forgotten and starts anew.

    What one trigger reads bounds what is put in order at once (maxFilesPerTrigger).
    """
    return (events.withWatermark("ts", lateness).groupBy("task_id")
            .applyInPandasWithState(_audit(expiry_hours * 3_600_000), OUTPUT, "phase string", "append", GroupStateTimeout.EventTimeTimeout))
