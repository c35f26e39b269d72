"""Resumable work over a table."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.plans.scratch import materialise


def pending(items: DataFrame, done: DataFrame, key: str = "item_id") -> DataFrame:
    """Items without a result."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def prune_errors(errors: DataFrame, done: DataFrame, key: str = "item_id") -> DataFrame:
    """Logged errors of items that have no result yet."""
    return errors.join(done.select(key).distinct(), key, "left_anti")


def run_jobs(items: DataFrame, done: DataFrame, worker: Callable[[dict], str], key: str = "item_id", attempts: int = 3, backoff: float = 0.0) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Apply ``worker`` to each item without a result; returns (results, errors, counts).

    The worker gets an item as a dict and returns a text; a call that raises is tried again in its task, after a pause
    that grows by ``backoff`` seconds, and an item that fails every time is an error row with the last
    attempt's type and message. Results are written once before they are counted.
    """
    names = items.columns

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for row in x.to_dict("records"):
                for n in range(1, attempts + 1):
                    try:
                        out.append((row[key], worker(row), None, None, n))
                        break
                    except Exception as e:  # any failure of a user's worker is an outcome
                        if n == attempts:
                            out.append((row[key], None, type(e).__name__, str(e), n))
                        else:
                            time.sleep(backoff * n)
            yield pd.DataFrame(out, columns=["item_id", "result", "error_type", "error_message", "attempt"])

    kind = dict(items.dtypes)[key]
    todo = pending(items, done, key).select(names)
    ran = materialise(todo.mapInPandas(work, f"item_id {kind}, result string, error_type string, error_message string, attempt int"), "jobs")
    ok, bad = ran.where("error_type is null"), ran.where("error_type is not null")
    total = items.count()
    counts = {"total": total, "completed_existing": done.select(key).distinct().count(), "submitted": ran.count(), "succeeded": ok.count(), "failed": bad.count()}
    counts["skipped"] = total - counts["submitted"]
    return ok.select("item_id", "result", "attempt"), bad.select("item_id", "error_type", "error_message", "attempt"), counts
