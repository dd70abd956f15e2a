"""Language identification as mixture inference.

Each language has probabilities of character trigrams, fitted on a bounded sample of rows that name it.  A
word (a run of letters) has a likelihood under each language; a document is a mixture, every word of one
language.  Expectation-maximisation estimates the proportions.  Then the document's set of languages
is chosen: the largest one, two, three ... languages, each set with proportions of its own, compared by
log-likelihood less half the log of the word count for each further language.  The language with
the largest proportion of the chosen set is the prediction, its proportion the score.

Beside the prediction stands whether the text is in a language at all: whether its letters are likelier under the
chosen set than if every trigram were as likely as any other.  Only ``drop_unknown`` goes by it.

All documents of a block are inferred at once, as arrays over their words.

Defined cases: a null or empty text and one without a letter is ``und`` with score 0, as is every text if there is
no row to learn from; any other text is in one of the learned languages, the likeliest; ties between languages go to the first name; a long text has more words
and is inferred alone if need be; rows that repeat get the same answer each; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oppflow.llm.batches import with_results
from oppflow.llm.samples import remainder, sample_per_label
from oppflow.llm.tables import whole_text

#: Rows per language that the model is fitted on, and the longest text among them.
FIT_ROWS = 1_000
FIT_CHARS = 32_768
BUCKETS = 1 << 16
BLOCK_CHARS = 1 << 19
ROUNDS, SET_ROUNDS = 12, 4
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_p: np.ndarray  # languages x buckets


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    table = np.zeros(0x110000, dtype=bool)
    table[[c for c in range(0x110000) if chr(c).isalpha()]] = True
    return table


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the trigrams around every letter, where words start among them, and the words per text."""
    # Texts are put together with a separator; words end where they end.
    points = np.frombuffer("\n".join([*texts, ""]).lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    # Lower-casing may change lengths, so text ends are found by lower-casing each.
    lengths = np.array([len(t.lower()) for t in texts], dtype=np.int64) + 1
    ends = np.cumsum(lengths)
    letter = _letters()[points]
    code = np.where(letter, points, 0).astype(np.uint64)
    before, after = np.zeros_like(code), np.zeros_like(code)
    before[1:], after[:-1] = code[:-1], code[1:]
    mixed = before * np.uint64(0x9E3779B97F4A7C15) + code * np.uint64(0xC2B2AE3D27D4EB4F) + after * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    places = np.flatnonzero(letter)
    bucket = (mixed[places] >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1)
    starts = np.flatnonzero(letter[places] & (before[places] == 0))
    owner = np.searchsorted(ends, places[starts], side="right")
    return bucket, starts, np.bincount(owner, minlength=len(texts))


def fit(rows: list[tuple[str, str]], smoothing: float = 0.5) -> Model | None:
    """Trigram probabilities per language from (text, language) rows."""
    languages = tuple(sorted({language for _, language in rows}))
    if not languages:
        return None
    log_p = np.empty((len(languages), BUCKETS), dtype=np.float32)
    for k, language in enumerate(languages):
        counts = np.full(BUCKETS, smoothing)
        texts = [t for t, l in rows if l == language]
        for at in range(0, len(texts), 100):
            counts += np.bincount(_trigrams(texts[at:at + 100])[0], minlength=BUCKETS)
        log_p[k] = np.log(counts / counts.sum())
    return Model(languages, log_p)


def inferred(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Proportions, texts x languages, zero outside the chosen set and for texts without a letter; and which texts
    are in a language."""
    bucket, starts, words = _trigrams(texts)
    shares, known = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), dtype=bool)
    has = np.flatnonzero(words)
    if not len(has):
        return shares, known
    score = np.stack([np.add.reduceat(p[bucket], starts) for p in model.log_p])
    likelihood = np.exp(score - score.max(axis=0))
    counts = words[has]
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    owner = np.repeat(np.arange(len(has)), counts)

    def rounds(theta: np.ndarray, times: int) -> np.ndarray:
        for _ in range(times):
            joint = likelihood * theta[:, owner]
            joint /= joint.sum(axis=0) + 1e-30
            new = np.add.reduceat(joint, firsts, axis=1) / counts
            done = np.abs(new - theta).max() < 1e-3
            theta = new
            if done:
                break
        return theta

    k = len(model.languages)
    theta = rounds(np.full((k, len(has)), 1 / k, dtype=np.float32), ROUNDS)
    order = np.argsort(np.argsort(-theta, axis=0, kind="stable"), axis=0, kind="stable")
    best, chosen = np.full(len(has), -np.inf), np.zeros((k, len(has)))
    for size in range(1, k + 1):
        part = np.where(order < size, theta + 1e-6, 0)
        part = (part / part.sum(axis=0)).astype(np.float32)
        part = rounds(part, SET_ROUNDS) if size > 1 else part
        fitted = np.log((likelihood * part[:, owner]).sum(axis=0) + 1e-30)
        value = np.add.reduceat(fitted, firsts) - 0.5 * (size - 1) * np.log(counts)
        better = value > best
        best, chosen = np.where(better, value, best), np.where(better, part, chosen)
    # The trigrams of all words, under the chosen set and as if none were likelier than another.
    best += np.add.reduceat(score.max(axis=0).astype(np.float64), firsts)
    letters = np.add.reduceat(np.diff(starts, append=len(bucket)), firsts)
    shares[has], known[has] = chosen.T, best > -letters * np.log(BUCKETS)
    return shares, known


def infer(texts: list[str], model: Model) -> np.ndarray:
    """Proportions, texts x languages, zero outside the chosen set and for texts without a letter."""
    return inferred(texts, model)[0]


def fit_on_rows(
    df: DataFrame, hold_out: tuple[int, int] | None = None, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang", fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS,
) -> Model | None:
    """Fit on a bounded sample of the rows with a language.  ``hold_out`` = (modulus, remainder) is left out."""
    label = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{lang_col}`").alias("_label")).where("_label IS NOT NULL")
    if hold_out:
        label = label.where(remainder("_id", hold_out[0]) != hold_out[1])
    return fit(sample_per_label(df, label, fit_rows, fit_chars, id_col, text_col))


def predictions(texts: list[str], model: Model | None) -> dict[str, list]:
    """Per text the prediction, its proportion, the chosen languages with theirs, and whether it is in a language."""
    k = len(model.languages) if model else 0
    shares, known = np.zeros((len(texts), k)), np.zeros(len(texts), dtype=bool)
    low = size = 0
    for at, text in enumerate(texts):
        size += len(text)
        if model and (size >= BLOCK_CHARS or at == len(texts) - 1):
            shares[low:at + 1], known[low:at + 1] = inferred(texts[low:at + 1], model)
            low, size = at + 1, 0
    best = shares.max(axis=1, initial=0)
    top = shares.argmax(axis=1) if k else np.zeros(len(texts), dtype=int)
    sets = [np.flatnonzero(s > 0)[np.argsort(-s[s > 0], kind="stable")] for s in shares]
    return {
        "lang_pred": [model.languages[t] if b > 0 else UNKNOWN for t, b in zip(top, best)],
        "score": pa.array(np.clip(best, 0, 1)),
        "languages": pa.array([[model.languages[i] for i in s] for s in sets], pa.list_(pa.string())),
        "shares": pa.array([row[s].tolist() for row, s in zip(shares, sets)], pa.list_(pa.float64())),
        "in_language": pa.array(known),
    }


def _predicted(df: DataFrame, model: Model | None, columns: list[str], text_col: str) -> DataFrame:
    return with_results(
        df, columns, text_col, lambda texts: predictions(texts, model),
        "lang_pred string, score double, languages array<string>, shares array<double>, in_language boolean",
    )


def languages(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score, languages, shares, in_language`` for every row."""
    return _predicted(df, model, [id_col], text_col).withColumnRenamed("_0", id_col)


def drop_unknown(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows whose text is in a language, with all their columns; without a model, those with a letter."""
    if model is None:
        return df.where(whole_text(text_col).rlike(r"\p{L}"))
    kept = _predicted(df, model, df.columns, text_col).where("in_language")
    return kept.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(df.columns)])
