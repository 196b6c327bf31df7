"""Token ids and counts equal those of the libraries that the vocabulary files belong to."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from stocklens.llm import bpe, pretokens, queries, tasks, token_counts

RANKS = public_tokenizers.path(queries.MULTI_VOCABULARY)
MERGES = public_tokenizers.path(queries.MERGE_VOCABULARY)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.read_vocabulary(RANKS)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={}
    )


@pytest.fixture(scope="module")
def counter():
    return Tokenizer.from_file(MERGES)


def noise(seed, count, most=60):
    rng = random.Random(seed)
    alphabet = "aste'rvlmd  \n\t1é.! '' 　½日<|>"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, most))) for _ in range(count)]


def split(texts, table):
    found = [[] for _ in texts]
    for pieces, stretches in pretokens.pieces_of(texts, table):
        for number, first, last in stretches:
            found[number] += pieces[first:last]
    return found


@pytest.mark.parametrize("block, pieces", [(1 << 20, 1 << 17), (7, 1 << 17), (1 << 20, 5), (3, 2)])
def test_pieces_are_the_matches_of_the_pattern(vocabulary, monkeypatch, block, pieces):
    monkeypatch.setattr(pretokens, "BLOCK", block)
    monkeypatch.setattr(pretokens, "PIECES", pieces)
    texts = noise(block + pieces, 2_000 if block > 100 else 300)
    pattern = regex.compile(public_tokenizers.PATTERN)
    assert split(texts, vocabulary.symbols) == [pattern.findall(t) for t in texts]


def test_symbols_follow_the_libraries():
    assert (pretokens.rank_file_symbols() == pretokens.merge_file_symbols()).mean() > 0.999


def test_merging_long_and_short_pieces_alike(vocabulary, library):
    rng = random.Random(3)
    pieces = ["".join(rng.choice("abcdefghijé") for _ in range(rng.randint(1, 300))) for _ in range(300)]
    got = vocabulary.merges.merge([p.encode() for p in pieces])
    for piece, ids in zip(pieces, got, strict=True):
        if piece.encode() not in vocabulary.ranks:
            assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(piece)


def test_encode_and_decode(spark, odd_docs, no_docs, library, vocabulary):
    encoded = bpe.encode(odd_docs, RANKS)
    rows = bpe.decode(encoded, RANKS).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect()}
    for r in rows:
        text = by_id[r["doc_id"]]
        assert np.frombuffer(r["token_ids"], "<u4").tolist() == library.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode() and r["n_tokens"] * 4 == len(r["token_ids"])
    assert bpe.decode(bpe.encode(no_docs, RANKS), RANKS).count() == 0


def test_query_over_all_documents(spark, data, texts, library):
    rows = queries.byte_bpe(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(library.encode_ordinary(texts[r["doc_id"]]), "<u4").tobytes()
        assert r["n_tokens"] == len(ids) // 4
        assert r["ids_sha256"] == hashlib.sha256(ids).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_encoder_forgets_when_full(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 3)
    encoder = bpe.Encoder(vocabulary)
    for text in noise(9, 50):
        for pieces, _ in pretokens.pieces_of([text], vocabulary.symbols):
            encoder.learn(pieces)
            assert all(p in encoder for p in pieces)


def test_counts_of_odd_texts(spark, odd_docs, no_docs, counter):
    extra = [(20 + i, t) for i, t in enumerate(["a<|endoftext|> b", "<|endoftext|><|endoftext|>", *noise(5, 200)])]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id bigint, text string"))
    by_id = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in token_counts.count_tokens(docs, MERGES).collect():
        text = by_id[r["doc_id"]]
        assert r["n_tokens"] == len(counter.encode(text, add_special_tokens=False).ids), text[:50]
        assert r["n_bytes"] == len(text.encode())
    assert token_counts.count_tokens(no_docs, MERGES).count() == 0


def test_count_query(spark, data, texts, counter):
    rows = queries.token_count(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(counter.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["over_limit"]) == (n, n > 512)


def test_proved_strings_are_one_token(counter):
    rules = token_counts.read_merge_rules(MERGES)
    chosen = sorted(rules.whole)[::499]
    assert all(len(counter.encode(t, add_special_tokens=False).ids) == 1 for t in chosen if len(t.split()) == 1)


def test_another_stage_finds_nothing_that_is_kept(spark):
    """Pieces learned by a process are gone when it serves the next stage, and its batches are bounded by bytes."""
    docs = spark.range(0, 4_000, 1, 1).selectExpr("id as doc_id", "repeat(cast(id as string), 2000) as text")
    assert bpe.encode(docs, RANKS).agg({"n_tokens": "sum"}).first()[0] > 0
    rows = tasks.by_batches(docs.select("doc_id"), lambda rows: {"n": [len(bpe._ENCODERS)] * len(rows["doc_id"])}, "n bigint")
    assert rows.distinct().collect() == [(0,)]

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    seen = [r["n"] for r in docs.mapInArrow(sizes, "n bigint").collect()]
    assert len(seen) > 5 and max(seen) < 2 * tasks.BATCH_BYTES
