"""Toxicity by compression distance.

Two zstandard dictionaries are fitted on a bounded sample of labelled rows.  The ordinary one is trained
on windows of ordinary texts.  The toxic one knows the same text and, before it, what is specific to
toxic texts: word beginnings that occur next to many different words in toxic texts and next to hardly
any in ordinary ones, which leaves out the chance words of copied documents.  A window of a text is
compressed with both; where it has nothing toxic the lengths are equal, where it has they differ by the
bytes that the toxic dictionary saved.

Every text is cut into overlapping windows, all of them compressed.  Where the lengths differ, the place
is looked at again with shorter windows.  The largest differences per window size and the number of
places are calibrated to a probability by logistic regression on the labelled sample.

Defined cases: null and empty texts have one empty window and get the score of a text without any
difference; without labelled rows of both kinds every score is 0; a long text has more windows, which are
compressed in blocks of ``BLOCK_BYTES``; rows that repeat get the same score each; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oppflow.llm.batches import with_results
from oppflow.llm.samples import remainder, sample_per_label

#: Labelled rows per label that a model is fitted on, and the longest text among them.
FIT_ROWS = 2_500
FIT_CHARS = 32_768
DICTIONARY_BYTES = 65_536
LEVEL = 8
WINDOW, STEP = 128, 112
#: Shorter windows, and their steps, for places where the lengths differ.
CLOSER = ((64, 16), (48, 16), (32, 8))
BLOCK_BYTES = 4 << 20
#: An ordinary text taken for toxic counts as much as so many toxic texts missed.
CAUTION = 2.5
SHORTEST, LONGEST = 4, 12
_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    specific: bytes
    weights: tuple[float, ...]
    center: tuple[float, ...]
    scale: tuple[float, ...]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, source_size=WINDOW, dict_size=len(content), min_match=4, write_content_size=False,
        write_checksum=False, write_dict_id=False,
    )
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)


@lru_cache(maxsize=2)
def _compressors(ordinary: bytes, specific: bytes) -> tuple:
    # Both have the same length and the ordinary content at the same distance from the window.
    return _compressor(b"\0" * len(specific) + ordinary), _compressor(specific + ordinary)


def _lengths(compressor, data: bytes, spans: np.ndarray) -> np.ndarray:
    out = compressor.multi_compress_to_buffer(
        zstandard.BufferWithSegments(data, np.ascontiguousarray(spans, dtype="<u8").tobytes()), threads=1
    )
    return np.fromiter((len(x) for x in out), dtype=np.int32, count=len(out))


def _saved(pair: tuple, data: bytes, spans: np.ndarray) -> np.ndarray:
    """Bytes that the toxic dictionary saves in each span; an empty span saves none."""
    saved = np.zeros(len(spans), dtype=np.int32)
    full = spans[:, 1] > 0
    if full.any():
        saved[full] = _lengths(pair[0], data, spans[full]) - _lengths(pair[1], data, spans[full])
    return saved


def _windows(low: int, length: int, width: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    count = max(1, -(-(length - (width - step)) // step))
    starts = np.arange(count) * step
    return low + starts, np.minimum(width, length - starts)


def features(texts: list[str], ordinary: bytes, specific: bytes) -> np.ndarray:
    """Per text: the largest saving per window size, the count of places, and the log of the length."""
    out = np.zeros((len(texts), 3 + len(CLOSER)))
    block, size, first = [], 0, 0
    for at, text in enumerate(texts):
        block.append(text.lower().encode("utf-8", "replace"))
        size += len(block[-1])
        if size >= BLOCK_BYTES or at == len(texts) - 1:
            out[first:at + 1] = _block_features(block, ordinary, specific)
            block, size, first = [], 0, at + 1
    return out


def _block_features(block: list[bytes], ordinary: bytes, specific: bytes) -> np.ndarray:
    pair = _compressors(ordinary, specific)
    out = np.zeros((len(block), 3 + len(CLOSER)))
    lengths = np.array([len(b) for b in block], dtype=np.int64)
    out[:, -1] = np.log1p(lengths)
    if not specific:
        return out
    data, lows = b"".join(block), np.concatenate([[0], np.cumsum(lengths)[:-1]])
    parts = [_windows(int(low), int(n), WINDOW, STEP) for low, n in zip(lows, lengths)]
    owner = np.repeat(np.arange(len(block)), [len(p[0]) for p in parts])
    spans = np.column_stack([np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])])
    # Texts of any length: so many windows at once that their compressed forms stay small.
    saved = np.concatenate([_saved(pair, data, spans[i:i + 40_000]) for i in range(0, len(spans), 40_000)])
    np.maximum.at(out[:, 0], owner, saved)
    places = np.flatnonzero(saved > 0)
    np.add.at(out[:, 1], owner[places], 1)
    for column, (width, step) in enumerate(CLOSER, 2):
        near = [_windows(int(low), int(n), width, step) for low, n in spans[places]]
        if near:
            close = np.column_stack([np.concatenate([p[0] for p in near]), np.concatenate([p[1] for p in near])])
            np.maximum.at(out[:, column], np.repeat(owner[places], [len(p[0]) for p in near]), _saved(pair, data, close))
    out[:, 1] = np.log1p(out[:, 1])
    return out


def _neighbours(texts: list[str], only: set[str] | None = None) -> Counter:
    """For every word beginning, or those in ``only``, the number of different words that stand before it."""
    before: dict[str, set[int]] = defaultdict(set)
    for text in texts:
        last = ""
        for word in _WORD.findall(text.lower()):
            mark = hash(last)
            for size in range(SHORTEST, min(len(word), LONGEST) + 1):
                if only is None or word[:size] in only:
                    before[word[:size]].add(mark)
            last = word
    return Counter({w: len(marks) for w, marks in before.items()})


def specific_beginnings(toxic: list[str], ordinary: list[str]) -> list[str]:
    """Word beginnings specific to the toxic texts, the rarest first, each as long as it stays common."""
    least = max(4, len(toxic) // 50)
    times = Counter(
        word[:size] for text in toxic for word in _WORD.findall(text.lower())
        for size in range(SHORTEST, min(len(word), LONGEST) + 1)
    )
    common = {w for w, n in times.items() if n >= least}
    there = _neighbours(toxic, common)
    elsewhere = _neighbours(ordinary, {w for w, n in there.items() if n >= least})
    n_there, n_else = sum(map(len, toxic)) + 1, sum(map(len, ordinary)) + 1
    specific = {w for w, n in there.items() if n >= least and 20 * elsewhere[w] * n_there < n * n_else}
    cores: dict[str, int] = {}
    for word in sorted(specific):
        if any(word[:k] in specific for k in range(SHORTEST, len(word))):
            continue
        while True:
            longer = [w for w in specific if len(w) == len(word) + 1 and w.startswith(word) and there[w] >= 0.6 * there[word]]
            if not longer:
                break
            word = max(longer, key=lambda w: (there[w], w))
        cores[word] = there[word]
    return sorted(cores, key=lambda w: (cores[w], w))


def fit(rows: list[tuple[str, int]]) -> Model | None:
    """A model from (text, toxic) rows; None unless both labels are there."""
    toxic, ordinary = [t for t, y in rows if y], [t for t, y in rows if not y]
    if not toxic or not ordinary:
        return None
    samples = []
    for text in ordinary:
        data = text.lower().encode("utf-8", "replace")
        starts, sizes = _windows(0, len(data), WINDOW, WINDOW)
        samples += [data[a:a + n] for a, n in zip(starts.tolist(), sizes.tolist()) if n]
    try:
        content = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=64, d=8).as_bytes()
    except zstandard.ZstdError:  # too few samples to choose from: they are the dictionary
        content = b"".join(samples)[-DICTIONARY_BYTES:]
    specific = "".join(f" {w}" for w in specific_beginnings(toxic, ordinary)).encode()
    x = features([t for t, _ in rows], content, specific)
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    weights = _logistic((x - center) / scale, np.array([float(y) for _, y in rows]))
    weights[-1] -= np.log(CAUTION)
    return Model(content, specific, tuple(weights), tuple(center), tuple(scale))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights and, last, the intercept, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w, keep = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def scores(texts: list[str], model: Model | None) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    x = (features(texts, model.ordinary, model.specific) - np.array(model.center)) / np.array(model.scale)
    w = np.array(model.weights)
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def fit_on_labels(
    df: DataFrame, labels: DataFrame, hold_out: tuple[int, int] | None = None, id_col: str = "doc_id",
    text_col: str = "text", toxic_col: str = "toxic", fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS,
) -> Model | None:
    """Fit on a bounded sample of ``df`` with labels.  ``hold_out`` = (modulus, remainder) is left out."""
    label = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{toxic_col}`").cast("int").alias("_label"))
    label = label.where("_label IS NOT NULL")
    if hold_out:
        label = label.where(remainder("_id", hold_out[0]) != hold_out[1])
    return fit(sample_per_label(df, label, fit_rows, fit_chars, id_col, text_col))


def _scored(df: DataFrame, model: Model | None, columns: list[str], text_col: str) -> DataFrame:
    return with_results(
        df, columns, text_col, lambda texts: {"score": pa.array(scores(texts, model))}, "score double"
    )


def toxicity_scores(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score`` for every row."""
    return _scored(df, model, [id_col], text_col).withColumnRenamed("_0", id_col)


def drop_toxic(df: DataFrame, model: Model | None, limit: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows whose score is below ``limit``, with all their columns."""
    kept = _scored(df, model, df.columns, text_col).where(F.col("score") < limit)
    return kept.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(df.columns)])
