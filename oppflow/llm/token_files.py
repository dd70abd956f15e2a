"""Token files of directly addressable codes.

An id is cut into chunks of ``CHUNK_BITS`` bits, lowest first.  Level 0 holds the first chunk of every
token, level 1 the second chunk of the tokens that have one, and so on; a bitmap per level marks the
tokens that continue on the next one, and a rank directory counts the marks before every
``RANK_BLOCK`` bits.  The token at a place is found by following ranks from level to level, so any
token or run of tokens is read without decoding what stands before it.

A segment is a byte string that can be read alone:
    4 bytes magic, then as unsigned 32-bit little-endian integers the number of levels and, per level,
    its chunk count; then per level its chunks (one byte each), its bitmap (padded to whole rank
    blocks) and its rank directory (unsigned 32-bit).

Spark writes segments as rows of a Parquet folder, (part, segment, first, docs, ends, tokens,
payload): documents in ascending id order, parts by id range, segments in order within a part, of whose
tokens ``first`` stand before the segment.
Parquet is the container because Spark commits it task by task on any shared store.

Where parts begin is found from ids and text hashes alone, one part for each shuffle partition.  Then texts are encoded
where they are read, and only ids move, in two bytes each where that is enough.  Rows that repeat an id are parted by
the hash of their text, and rows that are all the same, which may stand in any order, by the place they were read at.

Defined cases: null text is empty and has only the end id; rows that repeat an id stand next to each
other, the smaller text hash first; a null id stands first; an empty table gives an empty folder and
result; other columns are not read.  A hot source has no part in the order; a segment is closed after
``SEGMENT_TOKENS`` tokens, between documents.  A text of more than 2 GB of ids does not fit into a value of a
table and fails with the store's own error.
"""

from __future__ import annotations

import struct
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oppflow.llm.batches import ROWS
from oppflow.llm.tables import scratch, whole_text
from oppflow.llm.tokens import encoder

MAGIC = b"DAC1"
CHUNK_BITS = 8
RANK_BLOCK = 512
SEGMENT_TOKENS = 200_000

_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.uint32)


def pack(ids: np.ndarray) -> bytes:
    """A segment of the ids."""
    rest, levels = np.asarray(ids, dtype=np.uint32), []
    while True:
        chunks = (rest & ((1 << CHUNK_BITS) - 1)).astype(np.uint8)
        rest = rest >> CHUNK_BITS
        more = rest > 0
        padded = np.zeros(-(-len(more) // RANK_BLOCK) * RANK_BLOCK, dtype=bool)
        padded[: len(more)] = more
        bitmap = np.packbits(padded)
        counts = _ONES[bitmap].reshape(-1, RANK_BLOCK // 8).sum(axis=1)
        ranks = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else counts
        levels.append((chunks, bitmap, ranks.astype("<u4")))
        rest = rest[more]
        if not len(rest):
            break
    head = MAGIC + struct.pack(f"<{len(levels) + 1}I", len(levels), *(len(c) for c, _, _ in levels))
    return head + b"".join(x.tobytes() for level in levels for x in level)


class Segment:
    """Random access to the ids of a packed segment."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        (count,) = struct.unpack_from("<I", payload, 4)
        sizes = struct.unpack_from(f"<{count}I", payload, 8)
        at, self.levels = 8 + 4 * count, []
        for size in sizes:
            blocks = -(-size // RANK_BLOCK)
            parts = []
            for kind, length in ((np.uint8, size), (np.uint8, blocks * RANK_BLOCK // 8), ("<u4", blocks)):
                parts.append(np.frombuffer(payload, dtype=kind, count=length, offset=at))
                at += parts[-1].nbytes
            self.levels.append(tuple(parts))
        self.size = sizes[0]

    def _rank(self, level: int, place: int) -> int:
        """Marks before a place, from the directory and the bytes of one block."""
        _, bitmap, ranks = self.levels[level]
        if not len(ranks):
            return 0
        block = min(place // RANK_BLOCK, len(ranks) - 1)
        low, high = block * RANK_BLOCK // 8, place // 8
        rank = int(ranks[block]) + int(_ONES[bitmap[low:high]].sum())
        return rank + (int(bitmap[high]) >> (8 - place % 8)).bit_count() if place % 8 else rank

    def token(self, place: int) -> int:
        return int(self.tokens(place, place + 1)[0])

    def tokens(self, low: int, high: int) -> np.ndarray:
        """The ids at places low to high - 1."""
        if not 0 <= low <= high <= self.size:
            raise IndexError((low, high))
        out = np.zeros(high - low, dtype=np.uint32)
        where = np.arange(high - low)
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            if low == high:
                break
            out[where] |= chunks[low:high].astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            bits = np.unpackbits(bitmap[low // 8: -(-high // 8)])[low % 8: low % 8 + high - low].astype(bool)
            where = where[bits]
            low, high = self._rank(level, low), self._rank(level, low) + int(bits.sum())
        return out


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    docs = df.select(F.col(f"`{id_col}`").alias("_id"), whole_text(text_col).alias("_text"))
    return docs.select("_id", F.xxhash64("_text").alias("_hash"), F.monotonically_increasing_id().alias("_nth"), "_text")


def _order(row_id, text_hash: int) -> tuple:
    """Sorts as the files do: null ids first, then by id and hash."""
    return (False,) if row_id is None else (True, row_id, text_hash)


def _begins(keyed: DataFrame) -> list[tuple]:
    """The first key of every part, in order; several parts may begin with the same key.

    One row per shuffle partition is collected.
    """
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("_id").asc_nulls_first(), F.col("_hash"), F.col("_nth")]
    ranges = keyed.select("_id", "_hash", "_nth").repartitionByRange(parts, *order)
    firsts = ranges.groupBy(F.spark_partition_id().alias("_part")).agg(
        F.bool_or(F.col("_id").isNull()).alias("null"), F.min(F.struct("_id", "_hash")).alias("first")
    )
    return sorted(_order(None if r["null"] else r["first"][0], r["first"][1]) for r in firsts.collect())


def _encoded(keyed: DataFrame, begins: list[tuple], tokenizer: str, end_id: int) -> DataFrame:
    """``_part, _id, _hash, wide, ids``: ids with the end id, little-endian in two bytes each, or four if ``wide``."""
    kind, end = dict(keyed.dtypes)["_id"], np.array([end_id], dtype="<u4").tobytes()

    def part_of(row_id, text_hash: int, nth: int) -> int:
        key = _order(row_id, text_hash)
        last = max(0, bisect_right(begins, key) - 1)
        return last - nth % (last - min(last, bisect_left(begins, key)) + 1)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows, wide, ids = batch.slice(at, ROWS), [], []
                keys, hashes, nths, texts = (column.to_pylist() for column in rows.columns)
                for found in enc.ids_of(texts):
                    numbers = np.frombuffer(found + end, dtype="<u4")
                    wide.append(bool(numbers.max() >= 1 << 16))
                    ids.append(numbers.tobytes() if wide[-1] else numbers.astype("<u2").tobytes())
                parts = pa.array(map(part_of, keys, hashes, nths), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [parts, rows.column(0), rows.column(1), pa.array(wide, pa.bool_()), pa.array(ids, pa.binary())],
                    names=["_part", "_id", "_hash", "wide", "ids"],
                )

    return keyed.mapInArrow(encode, f"_part int, _id {kind}, _hash long, wide boolean, ids binary")


def write_token_files(
    df: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    segment_tokens: int = SEGMENT_TOKENS,
) -> None:
    """Write the ids of all texts, each followed by ``end_id``, in ascending id order."""
    kind = dict(df.dtypes)[id_col]

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, docs, ids, size, number, first = None, [], [], 0, 0, 0

        def segment() -> pa.RecordBatch:
            ends = np.cumsum([len(i) for i in ids])
            values = [
                pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([first], pa.int64()),
                pa.ListArray.from_arrays([0, len(ids)], pa.concat_arrays(docs)), pa.array([ends.tolist()], pa.list_(pa.int64())),
                pa.array([int(ends[-1])], pa.int64()), pa.array([pack(np.concatenate(ids))], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(
                values, names=["part", "segment", "first", "docs", "ends", "tokens", "payload"]
            )

        for batch in batches:
            keys, parts, wides, found = (batch.column(name) for name in ("_id", "_part", "wide", "ids"))
            for at, (range_, wide) in enumerate(zip(parts.to_pylist(), wides.to_pylist())):
                if range_ != part:  # a task may write several ranges, one after the other
                    if docs:
                        yield segment()
                    docs, ids, size, number, first, part = [], [], 0, 0, 0, range_
                docs.append(keys.slice(at, 1))
                ids.append(np.frombuffer(found[at].as_py(), dtype="<u4" if wide else "<u2"))
                size += len(ids[-1])
                if size >= segment_tokens:
                    yield segment()
                    docs, ids, size, number, first = [], [], 0, number + 1, first + size
        if docs:
            yield segment()

    keyed = _keyed(df, id_col, text_col)
    begins = _begins(keyed)
    encoded = _encoded(keyed, begins, tokenizer, end_id).repartitionById(max(1, len(begins)), F.col("_part"))
    sorted_parts = encoded.sortWithinPartitions("_part", F.col("_id").asc_nulls_first(), "_hash")
    sorted_parts.select("_id", "wide", "ids", "_part").mapInArrow(
        segments, f"part int, segment int, first long, docs array<{kind}>, ends array<long>, tokens long, payload binary"
    ).write.parquet(path)


def read_token_files(spark, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document: ``id_col, start, n_tokens, ids``, ids as little-endian 32-bit integers.

    Each document is read at its own place, through the rank directory of its segment.
    ``start`` counts the ids of all documents before: in the parts before, of which one row each is collected,
    and in the segments before in the part, which the segment itself knows.
    """
    files = spark.read.parquet(path)
    kind = files.schema["docs"].dataType.elementType.simpleString()
    # One row per part, so bounded by the number of partitions that wrote the files.
    totals = sorted((r.part, r.n) for r in files.groupBy("part").agg(F.sum("tokens").alias("n")).collect())
    starts, total = {}, 0
    for part, n in totals:
        starts[part], total = total, total + n

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                part, first, docs, ends, payload = (batch.column(k)[at] for k in range(5))
                segment, ends = Segment(payload.as_py()), ends.values.to_numpy()
                lows = np.concatenate([[0], ends[:-1]])
                for low in range(0, len(ends), ROWS):
                    spans = [(int(a), int(b)) for a, b in zip(lows[low:low + ROWS], ends[low:low + ROWS])]
                    yield pa.RecordBatch.from_arrays([
                        docs.values.slice(low, ROWS), pa.array(starts[part.as_py()] + first.as_py() + lows[low:low + ROWS]),
                        pa.array([b - a for a, b in spans], pa.int64()),
                        pa.array([segment.tokens(a, b).astype("<u4").tobytes() for a, b in spans], pa.binary()),
                    ], names=["_id", "start", "n_tokens", "ids"])

    rows = files.select("part", "first", "docs", "ends", "payload")
    return rows.mapInArrow(documents, f"_id {kind}, start long, n_tokens long, ids binary").withColumnRenamed(
        "_id", id_col
    )


def token_file_round_trip(
    df: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    segment_tokens: int = SEGMENT_TOKENS,
) -> DataFrame:
    """Write ``df`` as token files in the shared folder and read them back."""
    path = scratch(df.sparkSession, "token_files")
    write_token_files(df, path, tokenizer, end_id, id_col, text_col, segment_tokens)
    return read_token_files(df.sparkSession, path, id_col)


