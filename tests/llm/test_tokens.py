"""Token counts and packing against the library itself, and edge rows."""

import gc
import os
import weakref
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wardline.llm import tokens
from wardline.llm.packing import assign, capacities, pack_documents
from wardline.llm.token_counts import count_tokens

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "\n", "a", " a", "a ", "a  b", "a \n b", "a\n\nb", "a\tb", "It's we'll 'tis o'clock don't", "x<|endoftext|>y <|endoftext|> z",
    "<|startoftext|>a<|endoftext|>", "é é ü ́x", "ΣΑΣ ς İstanbul ß", "日本語 テキスト 你好", "a\xa0b  c d", "12345 6 7.8e9 ½",
    "###$$$ a***,b%%% !!", "x" * 5000, "word " * 3000, "\x00\x1f\x85", "naïve—“quoted” …", "Ciónmente! Ñandú? àÀ", "🙂🙃 👩‍👩‍👧", "_a_b-c/d@e.f", "ªº µm",
]


def words(path, text):
    return Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_pieces_match_the_library(text):
    assert tokens.ByteCounter(BYTES).count(text) == len(words(BYTES, text))
    made = tokens.WordEncoder(WORDS).encode(text.encode())
    assert [int.from_bytes(made[i: i + 4], "little") for i in range(0, len(made), 4)] == words(WORDS, text)


def test_given_texts_match_the_library(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    counter, encoder = tokens.ByteCounter(BYTES), tokens.WordEncoder(WORDS)
    one, two = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)
    assert [counter.count(t) for t in texts] == [len(e.ids) for e in one.encode_batch(texts, add_special_tokens=False)]
    assert [len(encoder.encode(t.encode())) // 4 for t in texts] == [len(e.ids) for e in two.encode_batch(texts, add_special_tokens=False)]


def edge(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, None, None), (3, "", "y"), (None, "c", "z"), (4, "word " * 600, "w")]
    return spark.createDataFrame(rows, "doc_id long, text string, digest string")


def test_counts_and_cache(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    docs = edge(spark)
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in count_tokens(docs, BYTES, cache).collect())
    assert got == [(0, 1, 1, False), (1, 3, 2, False), (1, 3, 2, False), (2, 0, 0, False), (3, 0, 0, False), (4, 3000, 601, True)]
    stored = spark.read.parquet(cache)
    assert stored.count() == 4
    # A second run encodes only the new content.
    more = docs.unionAll(spark.createDataFrame([(9, "new", None)], docs.schema))
    assert count_tokens(more, BYTES, cache).count() == 7
    assert spark.read.parquet(cache).count() == 5
    assert count_tokens(docs.limit(0), BYTES, cache).count() == 0


def test_capacities_and_assignment():
    assert capacities(5000, 2048) == [2048, 2048, 512, 256, 128, 8]
    pieces, n = assign([5000, 3, 2048, 1, 1, 700], 2048, 1.0, 0.001)
    assert sum(p[2] for p in pieces) == 7753
    ends = {}
    for _, _, length, sequence, offset in sorted(pieces, key=lambda p: (p[3], p[4])):
        assert ends.get(sequence, 0) == offset
        ends[sequence] = offset + length
    assert len(ends) == n
    assert all(e == 2048 or e & (e - 1) == 0 for e in ends.values())
    assert assign([], 2048, 1, 1) == ([], 0)


@pytest.mark.parametrize("group", [50, 4_000_000])
def test_packing_is_a_round_trip(spark, group):
    rows = pack_documents(edge(spark), WORDS, group_tokens=group).collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 3, 4, None}
    texts = {r["doc_id"]: r["text"] or "" for r in edge(spark).collect()}
    by_copy = {}
    for r in rows:
        by_copy.setdefault(r["copy"], []).append(r)
    assert len(by_copy) == 6
    for found in by_copy.values():
        found.sort(key=lambda r: r["start"])
        ids = [*words(WORDS, texts[found[0]["doc_id"]]), 1]
        at = 0
        for r in found:
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[at: at + r["length"]]))
            at += r["length"]
        assert at == len(ids)
    fill = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert fill.get(r["sequence_id"], 0) == r["offset"]
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(x <= 2048 and (x == 2048 or x & (x - 1) == 0) for x in fill.values())
    assert pack_documents(edge(spark).limit(0), WORDS).count() == 0


def test_long_documents_are_cut(spark):
    docs = spark.createDataFrame([(i, "word " * (1000 * i)) for i in range(1, 9)], "doc_id long, text string")
    rows = pack_documents(docs, WORDS).collect()
    assert sum(r["length"] for r in rows) == 36008
    assert os.path.exists(WORDS)


def test_words_met_before_a_new_start_are_not_merged_again(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_PIECES", 4)
    made = []
    kept = tokens._Bounded(lambda key: made.append(key) or key)
    assert [kept[key] for key in (1, 2, 3, 4, 5, 1, 2)] == [1, 2, 3, 4, 5, 1, 2]
    assert made == [1, 2, 3, 4, 5] and len(kept) <= 4


def test_pieces_go_with_their_task():
    """Without a search for cycles, as workers seldom make one of all their objects."""
    counter, encoder = tokens.ByteCounter(BYTES), tokens.WordEncoder(WORDS)
    assert counter.count("some words, some pieces") and encoder.encode(b"some words, some pieces")
    held = [weakref.ref(kept) for kept in (counter.by_word, counter.by_piece, encoder.by_word, encoder.by_piece)]
    gc.disable()
    try:
        del counter, encoder
        assert [kept() for kept in held] == [None] * 4
    finally:
        gc.enable()
