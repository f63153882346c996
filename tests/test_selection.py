"""Inputs of the registered cover query."""

from proofmill.plans.evidence import cover_tasks


def test_every_repository_of_a_selection_is_covered(spark):
    rows = [("s", f"s/r{i}", i) for i in range(1, 6)] + [("t", "t/r1", 1)]
    got = {tuple(r) for r in cover_tasks(spark.createDataFrame(rows, "task_id string, full_name string, selection_rank bigint")).collect()}
    assert got == {("s", "s/r1", 1), ("s", "s/r2", 2), ("s#1", "s/r3", 1), ("s#1", "s/r4", 2), ("s#2", "s/r5", 1), ("t", "t/r1", 1)}
