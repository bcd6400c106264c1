"""One delivery run: select, classify, type the answers, append to the ledger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.uploads import (
    classify_files,
    merge_ledger,
    outcome_counts,
    select_new,
    skipped_attempts,
    type_outcomes,
)
from ..session import materialize
from ..sinks.tables import append_attempts, append_ledger
from ..sources.tables import read_ledger


def plan_delivery(inventory: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files this run must look at, with what is to be done with each."""
    return classify_files(select_new(inventory, ledger))


def settle_delivery(planned: DataFrame, responses: DataFrame, ledger: DataFrame, run_id: str, ts) -> dict[str, DataFrame]:
    """Attempts of the run, its counts, and the rows to append to the ledger."""
    attempts = type_outcomes(responses).unionByName(
        skipped_attempts(planned, run_id=run_id, ts=ts), allowMissingColumns=True
    )
    return {"attempts": attempts, "counts": outcome_counts(attempts), "ledger": merge_ledger(ledger, attempts)}


def deliver(
    inventory: DataFrame, send: Callable[[DataFrame], DataFrame], ledger: str, attempts: str, run_id: str, ts, batch: str | None = None
) -> DataFrame:
    """One run from inventory to ledger; returns its counts.

    ``send`` gives the responses to the files it is handed. ``ledger`` and
    ``attempts`` are the folders that are appended to. A run, or a ``batch`` of
    one, that is repeated after a failure reads the ledger without its own rows
    and replaces them, so the ledger holds them once.
    """
    name = run_id if batch is None else f"{run_id}-{batch}"
    known = read_ledger(inventory.sparkSession, ledger, without=name)
    planned = materialize(plan_delivery(inventory, known), "planned")
    responses = materialize(send(planned.filter("status = 'eligible'")), "responses")  # asked for once
    settled = settle_delivery(planned, responses, known, run_id, ts)
    append_attempts(settled["attempts"], attempts, name)
    append_ledger(settled["ledger"], ledger, name)
    return settled["counts"]
