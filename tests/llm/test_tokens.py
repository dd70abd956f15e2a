"""Encoding, token files and packing against the tokenizers library and brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from public_tokenizers import path as tokenizer_path
from tokenizers import Tokenizer

from oppflow.llm import tokens
from oppflow.llm.bpe import bpe_encode, encode_by_tree
from oppflow.llm.packing import Plan, pack_documents
from oppflow.llm.token_files import Segment, pack, read_token_files, token_file_round_trip, write_token_files

PATH = tokenizer_path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, piece string, _row string"
TEXTS = [
    "Plain words, don't they're 12 34!", "", None, " \n\t ", "naïve Ünïcode İstanbul ΣΑΣ ß", "é Á̧ ́x",
    "<|endoftext|> and <|startoftext|>half", "漢字かな交じり文" * 30, "a" * 700, "'s''s'll!!?? x\x1cy",
    "long " * 9000, "x" * 3000 + " " + "'re" * 900, "😀👍🏽 emoji", "tab\tand\x00null",
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def by_library(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def random_texts(count):
    rng = random.Random(11)
    letters = "aabbcc  e's 'll don't é́ȩ́ Ξ Σας ßİ 12 3 !!! '' 漢字 ‍ ..."
    for k in range(count):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 160)))
        if k % 3 == 0:
            text = "".join(rng.choice(["ab", "a", "the", "ing", "tion", "x", "'s"]) for _ in range(rng.randint(0, 120)))
        if k % 5 == 0:
            text = text[:40] + "<|startoftext|>" + text[40:]
        yield text


def test_encoder_equals_library(library):
    enc = tokens.Encoder(PATH)
    texts = [t or "" for t in TEXTS] + list(random_texts(400))
    for text, ids in zip(texts, enc.ids_of(texts)):
        assert np.frombuffer(ids, dtype="<u4").tolist() == by_library(library, text), repr(text[:80])


@pytest.mark.parametrize("leaf", [1, 5, 33])
def test_tree_equals_library(library, leaf):
    enc = tokens.Encoder(PATH)
    for text in list(random_texts(150)) + [t or "" for t in TEXTS if len(t or "") < 2000 or leaf > 5]:
        got = np.frombuffer(encode_by_tree(enc, text, leaf), dtype="<u4").tolist()
        assert got == by_library(library, text), repr(text[:80])


def test_forgetting_pieces_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED_PIECES", 3)
    enc = tokens.Encoder(PATH)
    for text in ["one two three four", "five six one two", "one nine ten"]:
        assert np.frombuffer(enc.ids(text), dtype="<u4").tolist() == by_library(library, text)


@pytest.mark.parametrize("leaf", [100, 16_384])
def test_bpe_table(spark, library, leaf):
    got = {r.doc_id: r for r in bpe_encode(frame(spark, TEXTS), PATH, leaf_chars=leaf).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        ids = by_library(library, text)
        data = np.array(ids, dtype="<u4").tobytes()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256, bytes(got[i].ids)) == (len(ids), hashlib.sha256(data).hexdigest(), data)
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_bpe_repeated_and_empty(spark):
    twice = spark.createDataFrame([(1, "x " * 500), (1, "x " * 500), (None, "y")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in bpe_encode(twice, PATH, leaf_chars=100).collect()) == [(0, 1), (1, 500), (1, 500)]
    assert bpe_encode(frame(spark, []), PATH).collect() == []


@pytest.mark.parametrize("ids", [
    [], [0], [255, 256, 65_535, 65_536, 2**32 - 1], list(range(0, 70_000, 7)), [5] * 5000, [70_000] * 5000,
])
def test_segment_random_access(ids):
    segment = Segment(pack(np.array(ids, dtype=np.uint32)))
    assert segment.size == len(ids)
    assert segment.tokens(0, len(ids)).tolist() == ids
    rng = random.Random(3)
    for _ in range(40 if ids else 0):
        low = rng.randint(0, len(ids))
        high = rng.randint(low, len(ids))
        assert segment.tokens(low, high).tolist() == ids[low:high]
        at = rng.randrange(len(ids))
        assert segment.token(at) == ids[at]


def test_token_files(spark, library):
    rows = [(40 - i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "body").selectExpr(
        "doc_id", "body AS text", "'x' AS start", "1 AS ids")
    got = {r.doc_id: r for r in token_file_round_trip(df, PATH, end_id=2, segment_tokens=500).collect()}
    start = 0
    for i, text in sorted(rows):
        ids = np.array(by_library(library, text) + [2], dtype="<u4")
        assert (got[i].start, got[i].n_tokens, bytes(got[i].ids)) == (start, len(ids), ids.tobytes())
        start += len(ids)
    assert token_file_round_trip(df.where("doc_id < 0"), PATH, end_id=2).collect() == []


def test_token_files_of_several_segments(spark, library, tmp_path):
    """Many segments to a part, ids that repeat (also with the same text) and null ids."""
    rows = [(k % 40 if k % 9 else None, TEXTS[k % len(TEXTS)]) for k in range(200)] + [(2**62 + 1, "last one")]
    rows += [(7, "the same words")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = str(tmp_path / "files")
    write_token_files(df, path, PATH, end_id=2, segment_tokens=300)
    files = spark.read.parquet(path)
    assert files.where("array_contains(docs, 7)").select("part").distinct().count() > 1
    assert files.agg({"segment": "max"}).first()[0] > 3 and files.select("part").distinct().count() > 1
    assert files.selectExpr("sum(size(docs)) AS n").first().n == len(rows)
    got = sorted(read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert sorted(((r.doc_id, bytes(r.ids)) for r in got), key=str) == sorted(
        ((i, np.array(by_library(library, t or "") + [2], dtype="<u4").tobytes()) for i, t in rows), key=str)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    ends = np.cumsum([r.n_tokens for r in got]).tolist()
    assert [r.start for r in got] == [0, *ends[:-1]] and all(len(r.ids) == 4 * r.n_tokens for r in got)


def sequential(lengths, capacity):
    """Best-fit decreasing, one piece at a time."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in range(len(gaps)) if gaps[g] >= n]
        if fits:
            gaps[min(fits, key=lambda g: gaps[g])] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_plan_equals_sequential_best_fit():
    rng = random.Random(5)
    for trial in range(60):
        capacity = rng.choice([10, 64, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 150))] + [3] * rng.choice([0, 50])
        counts = {}
        for n in lengths:
            counts[n] = counts.get(n, 0) + 1
        plan = Plan(counts, capacity)
        assert plan.sequences == sequential(lengths, capacity), trial
        used, placed = {}, {n: [] for n in counts}
        for n, runs in plan.runs.items():
            for (first, copies, base, offset), end in zip(runs, [r[0] for r in runs[1:]] + [counts[n]]):
                for r in range(first, end):
                    placed[n].append(r)
                    used.setdefault(base + (r - first) // copies, []).append((offset + (r - first) % copies * n, n))
        assert all(sorted(p) == list(range(counts[n])) for n, p in placed.items())
        for spans in used.values():
            at = 0
            for offset, n in sorted(spans):
                assert offset == at
                at += n
            assert at <= capacity


def test_packing(spark, library):
    texts = TEXTS + ["same size here"] * 300
    rows = pack_documents(frame(spark, texts), PATH, end_id=0, capacity=64, cell_rows=7).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text in enumerate(texts):
        ids = by_library(library, text) + [0]
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(-(-len(ids) // 64)))
        for r in pieces:
            part = np.array(ids[64 * r.piece: 64 * r.piece + 64], dtype="<u4")
            assert (r.start, r.length, r.ids_crc32) == (64 * r.piece, len(part), zlib.crc32(part.tobytes()))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by_sequence) == sequential([r.length for r in rows], 64)
    assert pack_documents(frame(spark, []), PATH).collect() == []
