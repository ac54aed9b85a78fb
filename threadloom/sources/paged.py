"""A Spark data source for services that hand out JSON objects by page.

A fetcher is any picklable function page -> list of dictionaries. Pages are read in parallel, each partition a stride of
pages until its first empty one; a page that can't be read is tried again with growing pauses, then fails the task.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

Fetcher = Callable[[int], list[dict]]


def pages_of(fetch: Fetcher, first: int, stride: int, tries: int = 3, pause: float = 0.5) -> Iterator[dict]:
    page = first
    while True:
        for attempt in range(1, tries + 1):
            try:
                rows = fetch(page)
                break
            except OSError:
                if attempt == tries:
                    raise
                time.sleep(pause * attempt)
        if not rows:
            return
        yield from rows
        page += stride


def articles_of(answer: object) -> list[dict]:
    """The articles in a service's answer: a list, or an object that holds one; anything else has none."""
    if isinstance(answer, dict):
        answer = answer.get("articles", [])
    return answer if isinstance(answer, list) else []


def read_pages(spark: SparkSession, fetch: Fetcher, schema: str, readers: int = 8) -> DataFrame:
    """Rows of all pages (from 1), typed by ``schema``; fields that are missing are null, others are left out."""
    from pyspark.sql import functions as F

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in batch.column(0).to_pylist():
                held: list[str] = []
                for row in pages_of(fetch, first + 1, readers):
                    held.append(json.dumps(row))
                    if len(held) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])

    raw = spark.range(readers).repartition(readers, "id").mapInArrow(run, "value string")
    return raw.select(F.from_json("value", schema).alias("r")).select("r.*")
