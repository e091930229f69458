"""State machines over records, one batch at a time."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

POLICIES = ("FAIL", "SKIP", "REPLACE", "MERGE")


@dataclass(frozen=True)
class Transition:
    """``guard`` is a condition on the record; ``identity`` makes the target's id; ``merge`` maps
    column names to what a merged record holds, from columns ``r.*`` and ``t.*``."""

    name: str
    source: str
    target: str
    policy: str = "FAIL"
    guard: Column | None = None
    identity: Column | None = None
    merge: dict[str, Column] = field(default_factory=dict)
    materialize: Callable[[DataFrame], DataFrame] | None = None


@dataclass(frozen=True)
class Lifecycle:
    states: tuple[str, ...]
    terminal: tuple[str, ...]
    transitions: tuple[Transition, ...]

    def __post_init__(self) -> None:
        names = [t.name for t in self.transitions]
        problems = []
        if len(set(self.states)) != len(self.states) or len(set(names)) != len(names):
            problems.append("a name is given twice")
        if not set(self.terminal) <= set(self.states):
            problems.append("a terminal state is no state")
        for t in self.transitions:
            if t.source not in self.states or t.target not in self.states:
                problems.append(f"{t.name}: unknown state")
            if t.policy not in POLICIES:
                problems.append(f"{t.name}: unknown policy")
        if problems:
            raise ValueError("; ".join(problems))

    def transition(self, name: str) -> Transition:
        return next(t for t in self.transitions if t.name == name)


def run_batch(records: DataFrame, id_column: str, state_column: str, step: Transition, existing: DataFrame) -> DataFrame:
    """``records`` with target_id, outcome and code.

    Outcomes: wrong_state, guard_failed, conflict (policy FAIL), skipped, replaced,
    merged, written.  Records do not see each other's results, so a batch is one join
    against the ids that exist in the target state.
    """
    identity = step.identity if step.identity is not None else F.col(id_column)
    guard = F.coalesce(step.guard, F.lit(False)) if step.guard is not None else F.lit(True)
    rows = records.withColumn("_target", identity).withColumn("_guard", guard)
    taken = existing.select(F.col(existing.columns[0]).alias("_taken")).distinct()
    joined = rows.join(taken, F.col("_target") == F.col("_taken"), "left")
    hit = F.col("_taken").isNotNull()
    on_hit = {"FAIL": "conflict", "SKIP": "skipped", "REPLACE": "replaced", "MERGE": "merged"}[step.policy]
    outcome = F.when(~F.col(state_column).eqNullSafe(F.lit(step.source)), "wrong_state").when(~F.col("_guard"), "guard_failed").when(hit, on_hit).otherwise("written")
    return joined.select(*records.columns, F.col("_target").alias("target_id"), outcome.alias("outcome"))


def writes(results: DataFrame, state_column: str, step: Transition, target: DataFrame | None = None, target_id: str | None = None) -> DataFrame:
    """The records to write, in the target state; merged ones take ``step.merge`` from both sides."""
    done = results.where(F.col("outcome").isin("written", "replaced", "merged")).withColumn(state_column, F.lit(step.target))
    if step.merge and target is not None:
        done = done.alias("r").join(target.alias("t"), F.col("r.target_id") == F.col(f"t.{target_id}"), "left")
        done = done.select(*[F.when(F.col("r.outcome") == "merged", step.merge[c]).otherwise(F.col(f"r.{c}")).alias(c) if c in step.merge else F.col(f"r.{c}") for c in results.columns])
    return step.materialize(done) if step.materialize else done


def state_projection(records: DataFrame, state_column: str, state: str, valid_in: dict[str, tuple[str, ...]]) -> DataFrame:
    """The records of one state with the fields that it has (fields not listed are in every state)."""
    kept = [c for c in records.columns if c not in valid_in or state in valid_in[c]]
    return records.where(F.col(state_column) == state).select(*kept)
