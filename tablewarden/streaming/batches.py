"""The same plan for each micro-batch of a stream, and for a batch that is being written anyway."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql.streaming import DataStreamWriter

from ..contract.model import Contract
from ..operators.execute import CheckResult, RunResult, micros_of, run_check
from ..plans.planner import Planner
from ..session import pinned


def check_batches(contract: Contract, stream: DataFrame, on_result: Callable[[int, RunResult], None], write: Callable[[DataFrame, int], Any] | None = None, typed: bool = True, **options: Any) -> DataStreamWriter:
    """A stream writer that checks every micro-batch; uniqueness is judged within a batch.

    ``on_result`` gets the batch's id and result. ``write`` is called with the batch when no check of
    severity error failed. The caller starts the writer and chooses trigger and checkpoint.
    """

    def each(batch: DataFrame, number: int) -> None:
        result = run_check(contract, batch, typed=typed, **options)
        on_result(number, result)
        if write and not result.is_failure():
            write(batch, number)

    return stream.writeStream.foreachBatch(each)


def check_on_write(contract: Contract, frame: DataFrame, typed: bool = True, now: Any = None) -> tuple[DataFrame, Callable[[], list[CheckResult]]]:
    """The frame with its checks counted while it is written: no scan of its own.

    Covers every check that is read from plain aggregates; exact uniqueness, keys, references and
    assertions need grouped jobs and are left to ``run_check``. Write the returned frame, then call the
    returned function for the outcomes.
    """
    with pinned(frame.sparkSession):
        planner = Planner(contract, frame, typed, micros_of(now))
        planned = [c for c in planner.plan() if not c.job]
        observation = Observation()
        observed = frame.observe(observation, *(e.alias(k) for k, e in planner.slots.expressions.items()))

    def outcomes() -> list[CheckResult]:
        values = observation.get
        return [CheckResult(c.id, c.column, c.kind, c.params, c.severity, c.fixed or c.read(values)) for c in planned]

    return observed, outcomes
