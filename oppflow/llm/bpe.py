"""BPE encoding by tree concatenation, and decoding.

Texts of up to ``leaf_chars`` characters are encoded where they are read.  A longer text is halved until
its leaves are that short; leaves are dealt over the tasks and encoded in parallel without regard to
word ends.  Then neighbours are joined pairwise, level by level: a window around the join is encoded
anew from the text, and grows until a token of it agrees with the left half's and another with the right
half's (same id over the same bytes).  Between the two the window's tokens replace those of the halves.

Why one agreeing token a side is enough: the splitting rule scans from the left and looks ahead no
further than a special token is long, and merges stay within a piece.  A sequence of BPE tokens is the
encoding of its text if every adjacent pair is, so two encodings that share a token can be spliced there.
Tokens within ``MARGIN`` bytes of a cut end are not trusted.  Cuts fall before an ASCII character,
which no normalization composes with what precedes it.

Defined cases: null is the empty text, with no ids; ids and texts of rows that repeat are worked out
for each row; other columns are not read.  Only ``leaf_chars`` characters of a long text are encoded at
once, but its ids, like its text, are one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oppflow.llm.batches import sliced
from oppflow.llm.tables import whole_text
from oppflow.llm.tokens import Encoder, encoder

LEAF_CHARS = 16_384
FIRST_WINDOW = 64
MARGIN = 16


def leaves(text: str, leaf_chars: int) -> list[str]:
    """Halves of halves of the text, each at most about ``leaf_chars`` long."""
    if len(text) <= leaf_chars:
        return [text]
    cut = safe_cut(text, len(text) // 2)
    if cut in (0, len(text)):
        return [text]
    return leaves(text[:cut], leaf_chars) + leaves(text[cut:], leaf_chars)


def safe_cut(text: str, near: int) -> int:
    """The last place up to ``near`` that stands before an ASCII character; 0 if there is none."""
    while near > 0 and near < len(text) and not text[near].isascii():
        near -= 1
    return near


def join(enc: Encoder, left: tuple[str, np.ndarray], right: tuple[str, np.ndarray]) -> tuple[str, np.ndarray]:
    """The encoding of two neighbouring texts from the encodings of each.  Places count bytes from the join."""
    size = enc.byte_lengths
    (before, head), (after, tail) = left, right
    reach = FIRST_WINDOW
    while True:
        start = safe_cut(before, max(0, len(before) - reach))
        end = safe_cut(after, min(len(after), reach)) or len(after)
        at = -int(size[_ids(enc, before[start:])].sum())
        window = _ids(enc, before[start:] + after[:end])
        ends = at + np.cumsum(size[window])
        spans = list(zip((ends - size[window]).tolist(), ends.tolist(), window.tolist()))
        low = 0 if start == 0 else _agreed_left(head, size, spans)
        high = len(spans) if end == len(after) else _agreed_right(tail, size, spans)
        if low is not None and high is not None:
            keep_left = 0 if start == 0 else low[1]
            keep_right = len(tail) if end == len(after) else high[1]
            first = 0 if start == 0 else low[0]
            last = len(spans) if end == len(after) else high[0]
            return before + after, np.concatenate([head[:keep_left], window[first:last], tail[keep_right:]])
        reach *= 2


def _agreed_left(head: np.ndarray, size: np.ndarray, spans: list) -> tuple[int, int] | None:
    """(window tokens, left tokens) up to and with the last one that both have before the join."""
    place = {(s, e, t): k for k, (s, e, t) in enumerate(spans) if e <= -MARGIN}
    end, lowest = 0, spans[0][0] if spans else 0
    for i in range(len(head) - 1, -1, -1):
        start = end - int(size[head[i]])
        if start < lowest:
            return None
        if (start, end, int(head[i])) in place:
            return place[start, end, int(head[i])] + 1, i + 1
        end = start
    return None


def _agreed_right(tail: np.ndarray, size: np.ndarray, spans: list) -> tuple[int, int] | None:
    """(window tokens, right tokens) before the first one that both have after the join."""
    highest = spans[-1][1] - MARGIN if spans else 0
    place = {(s, e, t): k for k, (s, e, t) in enumerate(spans) if s >= 0 and e <= highest}
    start = 0
    for i in range(len(tail)):
        end = start + int(size[tail[i]])
        if end > highest:
            return None
        if (start, end, int(tail[i])) in place:
            return place[start, end, int(tail[i])], i
        start = end
    return None


def _ids(enc: Encoder, text: str) -> np.ndarray:
    return np.frombuffer(enc.ids(text), dtype="<u4")


def join_tree(enc: Encoder, parts: list[tuple[str, np.ndarray]]) -> np.ndarray:
    """Neighbours joined pairwise until one encoding is left."""
    while len(parts) > 1:
        joined = [join(enc, parts[i], parts[i + 1]) for i in range(0, len(parts) - 1, 2)]
        parts = joined + parts[len(joined) * 2:]
    return parts[0][1]


def encode_by_tree(enc: Encoder, text: str, leaf_chars: int) -> bytes:
    """The whole method on one text, as the tests use it."""
    return join_tree(enc, [(t, _ids(enc, t)) for t in leaves(text, leaf_chars)]).astype("<u4").tobytes()


def bpe_encode(
    df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = LEAF_CHARS,
    keep_ids: bool = True,
) -> DataFrame:
    """One row per input row: ``id_col, n_tokens, ids_sha256, decoded_sha256`` and, on demand, ``ids``.

    ``ids`` are little-endian unsigned 32-bit integers; the digests are of these bytes and of the decoded text.
    """
    kind = dict(df.dtypes)[id_col]
    docs = df.select(
        F.monotonically_increasing_id().alias("_row"), F.col(f"`{id_col}`").alias("_id"),
        whole_text(text_col).alias("_text"),
    )
    out = f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary"

    def result(ids_of: pd.Series, ids: list[bytes]) -> pd.DataFrame:
        enc = encoder(tokenizer)
        return pd.DataFrame({
            "_id": ids_of, "n_tokens": [len(b) // 4 for b in ids],
            "ids_sha256": [hashlib.sha256(b).hexdigest() for b in ids],
            "decoded_sha256": [hashlib.sha256(enc.decode(b).encode()).hexdigest() for b in ids],
            "ids": ids if keep_ids else None,
        })

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        for batch in sliced(batches):
            yield result(batch["_id"], enc.ids_of(batch["_text"]))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, key, text in batch.itertuples(index=False):
                parts = leaves(text, leaf_chars)
                yield pd.DataFrame({
                    "_row": row, "_id": pd.array([key] * len(parts), dtype=batch["_id"].dtype),
                    "_leaf": range(len(parts)), "_text": parts,
                })

    def encode_leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        for batch in sliced(batches, 64):
            yield batch.assign(_ids=enc.ids_of(batch["_text"]))

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_leaf")
        parts = [(t, np.frombuffer(b, dtype="<u4")) for t, b in zip(group["_text"], group["_ids"])]
        ids = join_tree(encoder(tokenizer), parts).astype("<u4").tobytes()
        return result(group["_id"].iloc[:1].reset_index(drop=True), [ids])

    long = F.length("_text") > leaf_chars
    short = docs.where(~long).select("_id", "_text").mapInPandas(whole, out)
    leaf = f"_row long, _id {kind}, _leaf int, _text string"
    parts = docs.where(long).mapInPandas(cut, leaf)
    parts = parts.repartition("_row", "_leaf").mapInPandas(encode_leaves, leaf + ", _ids binary")
    every = short.unionByName(parts.groupBy("_row").applyInPandas(joined, out)).withColumnRenamed("_id", id_col)
    return every if keep_ids else every.drop("ids")
