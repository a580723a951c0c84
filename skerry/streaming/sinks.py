"""Sinks for batches and, by ``foreachBatch``, for streams."""

from __future__ import annotations

import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.streaming import topic

#: Answers after which a request is sent again.
AGAIN = (500, 502, 503, 504)


def retried(
    call: Callable,
    attempts: int,
    base_s: float,
    most_s: float,
    again: tuple[type[Exception], ...] = (Exception,),
    sleep: Callable[[float], None] = time.sleep,
):
    """``call()``, tried again after a random wait of up to ``base_s`` doubled each time; the last failure is raised."""
    for n in range(attempts):
        try:
            return call()
        except again:
            if n + 1 == attempts:
                raise
            sleep(random.uniform(0, min(most_s, base_s * 2**n)))


class Refused(Exception):
    """An answer after which the request may be sent again."""


def http_post(url: str, body: str, headers: dict[str, str], timeout: float = 10.0) -> int:
    """Status of a POST."""
    request = urllib.request.Request(url, body.encode(), {"Content-Type": "application/json"} | headers)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status
    except urllib.error.HTTPError as error:
        return error.code


def deliver(
    alerts: DataFrame, key: str, url: str, headers: dict[str, str] | None = None, retries: int = 3, base_s: float = 0.1
) -> DataFrame:
    """POST every row as JSON; (key, status, delivered) as the requests' outcome.

    A final failure is a row, not an error, and an alert that was deduplicated before stays so.  Sent where the
    rows are, in their partitions.  Write the result once: a task that is run again sends its rows again.
    """
    own = headers or {}

    def post(body: str) -> int:
        def once() -> int:
            status = http_post(url, body, own)
            if status in AGAIN:
                raise Refused(status)
            return status

        try:
            return retried(once, retries + 1, base_s, 120.0, (Refused, OSError))
        except Refused as error:
            return error.args[0]
        except OSError:
            return 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            status = [post(body) for body in batch.body]
            yield pd.DataFrame({key: batch[key], "status": status, "delivered": [200 <= s < 300 for s in status]})

    kind = alerts.schema[key].dataType.simpleString()
    rows = alerts.select(key, F.to_json(F.struct("*")).alias("body"))
    return rows.mapInPandas(run, f"{key} {kind}, status int, delivered boolean")


def write_csv(rows: DataFrame, path: str, *order: str) -> None:
    """CSV in the order of ``order`` over its files."""
    (rows.orderBy(*order) if order else rows).write.mode("overwrite").csv(path, header=True)


def fan_out(rows: DataFrame, outputs: str, letters: str, batch: int | str) -> None:
    """Rows (with ``error``) to two topics as one batch: those without an error, and the dead letters.  A batch that comes
    again, whole or in part, adds only what is missing.
    """
    topic.publish(rows.where(F.col("error").isNull()).drop("error"), outputs, batch)
    topic.publish(rows.where(F.col("error").isNotNull()), letters, batch)
