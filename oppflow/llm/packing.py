"""Best-fit packing of token sequences in bulk-synchronous rounds.

Documents are tokenized, cut into pieces of at most ``capacity`` tokens, and packed into sequences of
that capacity.  Range-sorted by length, pieces of one length are interchangeable, and so are open
sequences with one gap; the sort is therefore kept as runs, (length, count) and (gap, count), of which
there are at most ``capacity`` each however large the table is.  Lengths are served from the longest
down, one round each.  In a round all pieces of a length sweep the gaps upward from their own length:
every sequence met takes as many as fit, and which piece goes where is settled by the piece's rank within
its length.  Then the gaps are updated and the next length follows; what found no gap opens new
sequences.  The result is best-fit decreasing for the whole table, without any order among tasks.

What is distributed: tokenizing, the histogram of lengths, the ranks and the placement of every piece.
Only the runs are swept in one place.  Ranks are taken in cells of a length and added up from cell
counts, so that one length with a third of all pieces does not meet in one task.

Defined cases: null text is empty and has only the end id; rows that repeat are packed as often as they
occur; ties between pieces of one length are broken by id; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oppflow.llm.batches import sliced
from oppflow.llm.tables import whole_text, written
from oppflow.llm.tokens import encoder

CAPACITY = 2048
#: Pieces of one length that are ranked together, on average over lengths.
CELL_ROWS = 20_000


def token_pieces(
    df: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id",
    text_col: str = "text", keep_ids: bool = False,
) -> DataFrame:
    """``_id, piece, start, length, ids_crc32`` and, on demand, ``ids`` of every piece of every text."""
    kind = dict(df.dtypes)[id_col]
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, width = encoder(tokenizer), 4 * capacity
        for batch in sliced(batches):
            rows = []
            for at, ids in enumerate(enc.ids_of(batch["_text"])):
                ids += end
                for piece, low in enumerate(range(0, len(ids), width)):
                    part = ids[low:low + width]
                    rows.append((at, piece, low // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
            out = pd.DataFrame(rows, columns=["_at", "piece", "start", "length", "ids_crc32", "ids"])
            out.insert(0, "_id", batch["_id"].iloc[out.pop("_at")].reset_index(drop=True))
            yield out

    pieces = df.select(F.col(f"`{id_col}`").alias("_id"), whole_text(text_col).alias("_text")).mapInPandas(
        cut, f"_id {kind}, piece int, start long, length long, ids_crc32 long, ids binary"
    )
    return pieces if keep_ids else pieces.drop("ids")


class Plan:
    """For every length, which sequence and offset a rank gets: runs in order of rank.

    A run (first rank, copies, first sequence, offset) puts ``copies`` pieces after one another into each
    sequence, from ``offset`` on.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.runs: dict[int, list[tuple[int, int, int, int]]] = {}
        self._gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs of open sequences (first, count)
        self._sorted: list[int] = []
        for length in sorted(counts, reverse=True):
            self._round(length, counts[length])

    def _round(self, length: int, count: int) -> None:
        placed, out = 0, self.runs.setdefault(length, [])
        changed: list[tuple[int, int, int]] = []

        def fill(first: int, sequences: int, gap: int) -> int:
            """Put pieces into a run of sequences; how many sequences were met."""
            nonlocal placed
            copies = gap // length
            full = min(sequences, (count - placed) // copies)
            if full:
                out.append((placed, copies, first, self.capacity - gap))
                changed.append((gap - copies * length, first, full))
                placed += full * copies
            rest = count - placed
            if full < sequences and rest:  # one sequence takes what is left
                out.append((placed, rest, first + full, self.capacity - gap))
                changed.append((gap - rest * length, first + full, 1))
                placed, full = count, full + 1
            return full

        at = bisect.bisect_left(self._sorted, length)
        while placed < count and at < len(self._sorted):
            gap = self._sorted[at]
            runs = self._gaps[gap]
            while runs and placed < count:
                first, sequences = runs.pop()
                met = fill(first, sequences, gap)
                if met < sequences:
                    runs.append((first + met, sequences - met))
            if not runs:
                del self._gaps[gap], self._sorted[at]
        if placed < count:
            new = -(-(count - placed) // (self.capacity // length))
            fill(self.sequences, new, self.capacity)
            self.sequences += new
        for gap, first, sequences in changed:
            if gap:
                if gap not in self._gaps:
                    bisect.insort(self._sorted, gap)
                self._gaps.setdefault(gap, []).append((first, sequences))

    def arrays(self) -> dict[int, np.ndarray]:
        return {n: np.array(runs, dtype=np.int64).reshape(-1, 4) for n, runs in self.runs.items()}


def place(pieces: DataFrame, capacity: int = CAPACITY, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.  Reads them three times, so hand in a written table."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = Plan(histogram, capacity).arrays()  # at most ``capacity`` lengths were collected
    cells = max(16, -(-sum(histogram.values()) // cell_rows))
    celled = pieces.withColumn("_cell", F.pmod(F.xxhash64("_id", "piece"), F.lit(cells)))
    counts = celled.groupBy("length", "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_cell").orderBy("_id", "piece", "start", "ids_crc32")
    ranked = (
        celled.withColumn("_in", F.row_number().over(inside) - 1).join(starts, ["length", "_cell"])
        .withColumn("_rank", F.col("_before") + F.col("_in")).drop("_cell", "_in", "_before")
    )
    names = [f for f in pieces.schema.fields]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names) + ", sequence_id long, offset long"

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence, offset = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=np.int64)
            for length, rows in batch.groupby("length").indices.items():
                runs, rank = plan[int(length)], batch["_rank"].to_numpy()[rows]
                first, copies, base, start = runs[np.searchsorted(runs[:, 0], rank, side="right") - 1].T
                sequence[rows] = base + (rank - first) // copies
                offset[rows] = start + (rank - first) % copies * length
            yield batch[[f.name for f in names]].assign(sequence_id=sequence, offset=offset)

    return ranked.select(*[f.name for f in names], "_rank").mapInPandas(placed, out)


def pack_documents(
    df: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id",
    text_col: str = "text", keep_ids: bool = False, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """One row per piece: ``id_col, piece, start, length, ids_crc32[, ids], sequence_id, offset``.

    Pieces are written once to the shared folder, as their lengths are needed before their places.
    """
    pieces = written(token_pieces(df, tokenizer, end_id, capacity, id_col, text_col, keep_ids), "pieces")
    return place(pieces, capacity, cell_rows).withColumnRenamed("_id", id_col)
