"""Jobs that write results by repository through the store."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .metrics import period_aggregates
from .store import Replace, Store

PERIODS = ("year", "month", "week")


def rotate(store: Store, name: str, new: DataFrame, writer: str = "", batch: int | None = None) -> bool:
    """The new snapshots of repositories take the place of the old ones, which move to ``<name>_history``."""
    return store.commit([Replace(name, new, new, history=f"{name}_history")], writer, batch)


def refresh_aggregates(store: Store, commits: DataFrame, scope: DataFrame, writer: str = "", batch: int | None = None, parts: int | None = None) -> bool:
    """Yearly, monthly and weekly aggregates of the repositories in scope, all replaced at once; those without commits lose theirs."""
    of = commits.join(scope.select("repo_id").distinct(), "repo_id", "left_semi")
    return store.commit([Replace(f"repo_aggregates_{p}", period_aggregates(of, p, parts=parts), scope) for p in PERIODS], writer, batch)
