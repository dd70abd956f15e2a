"""Small pieces of the batches that Spark hands to a task, so that what is made of them stays small.

A batch may hold tens of megabytes of text; the objects, arrays and ids made of it take several times that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oppflow.llm.tables import whole_text

ROWS = 512


def sliced(batches: Iterator[pd.DataFrame], rows: int = ROWS) -> Iterator[pd.DataFrame]:
    """The same rows in frames of at most ``rows``."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at:at + rows].reset_index(drop=True)


def with_results(
    df: DataFrame, columns: list[str], text_col: str, results: Callable[[list[str]], dict[str, list]], schema: str,
) -> DataFrame:
    """``columns`` as ``_0, _1, ...`` and what ``results`` makes of the texts, as named in ``schema``.

    The columns stay in Arrow memory as they are; only the texts become Python objects.
    """
    names = [f"_{i}" for i in range(len(columns))]
    own = df.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, columns)], whole_text(text_col).alias("_text"))
    out = ", ".join(f"{c} {kind}" for c, kind in own.dtypes if c != "_text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = results(part.column(len(names)).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], *(pa.array(v) if isinstance(v, list) else v for v in found.values())],
                    names=[*names, *found],
                )

    return own.mapInArrow(add, f"{out}, {schema}")
