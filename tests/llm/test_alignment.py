"""Sparse products against dense ones, alignment against whole texts through the libraries."""

import collections
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wardline.llm import alignment
from wardline.llm.alignment import align_tokenizers
from wardline.llm.common import BATCH_BYTES
from wardline.llm.csr import Csr, intervals, members
from wardline.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", None, " ", "\n", "a", " a", "a ", "a  b", "a \n b", "a\n\nb", "a\tb", "It's we'll 'tis o'clock don't", "x<|endoftext|>y <s> </s> <unk> <0x41> z",
    "é é ü ́x", "ΣΑΣ ς İstanbul ß", "日本語 テキスト 你好", "a\xa0b  c d", "###$$$ a***,b%%% !!", "x" * 3000, "word " * 3000,
    "\x00\x1f\x85 a\x1c b", "a▁b c", "▁", "🙂🙃 👩‍👩‍👧", "   ", "naïve—“quoted” …",
]


def dense(m):
    out = np.zeros((m.n_rows, m.n_columns), dtype=np.int64)
    np.add.at(out, (m.rows(), m.indices), m.data)
    return out


def random_csr(rng, rows, columns):
    counts = rng.integers(0, 5, rows)
    indices = rng.integers(0, columns, counts.sum())
    return Csr(np.concatenate([[0], np.cumsum(counts)]), indices, rng.integers(-3, 4, len(indices)), columns)


def test_products():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, m, k = rng.integers(1, 9, 3)
        a, b = random_csr(rng, n, m), random_csr(rng, m, k)
        assert (dense(a.times(b)) == dense(a) @ dense(b)).all()
        assert (dense(a.transpose()) == dense(a).T).all()
        vector = rng.integers(-9, 9, m)
        assert (a.apply(vector) == dense(a) @ vector).all()
        cells = list(zip(*[x.tolist() for x in (a.times(b).rows(), a.times(b).indices)]))
        assert cells == sorted(set(cells))
    cover = intervals(np.array([2, 3, 6]), 6)
    assert dense(cover).tolist() == [[1, 1, 0, 0, 0, 0], [0, 0, 1, 0, 0, 0], [0, 0, 0, 1, 1, 1]]
    assert dense(members(np.array([0, 0, 1]), 2)).tolist() == [[1, 0], [1, 0], [0, 1]]


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        self.a_bytes = alignment._byte_vocabulary(A)[1]

    def piece(self, i):
        name = self.b.id_to_piece(i)
        return bytes([int(name[3:-1], 16)]) if self.b.is_byte(i) else name.replace("▁", " ").encode()

    def text(self, text):
        """(n_a, n_b, groups, links, shared) of a whole text, or None."""
        if not text:
            return None
        a, b, raw = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text), (" " + text).encode()
        sizes = [[len(self.a_bytes[i]) for i in a], [len(self.piece(i)) for i in b]]
        if b"".join(self.a_bytes[i] for i in a) != raw or b"".join(self.piece(i) for i in b) != raw:
            return None
        owner = [np.repeat(np.arange(len(s)), s) for s in sizes]
        links = sorted(set(zip(owner[0].tolist(), owner[1].tolist())))
        ends = [np.cumsum(s).tolist() for s in sizes]
        groups, at, shared = [], [0, 0], 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            sides = []
            for k, ids in enumerate((a, b)):
                start = at[k]
                while at[k] < len(ids) and ends[k][at[k]] <= end:
                    at[k] += 1
                sides.append([str(i) for i in ids[start: at[k]]])
            groups.append(f"{','.join(sides[0])}|{','.join(sides[1])}")
            shared += len(sides[0]) * len(sides[1])
        return len(a), len(b), groups, [(a[x], b[y]) for x, y in links], shared


def plain(docs):
    tool = Plain()
    found = [(key, tool.text(text)) for key, text in docs]
    held = collections.Counter(pair for _, f in found if f for pair in set(f[3]))
    most = collections.Counter()
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    rows = []
    for key, f in found:
        if f is None:
            rows.append((key, 0, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links, shared = f
            best, total = sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links)
            rows.append((key, n_a, n_b, len(groups), len(links), shared, best, total, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(rows, key=str)


def test_edge_rows(spark):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(3, "a"), (3, "a"), (None, "a b"), (900, "ab cd, " * 20_000)]
    rows = spark.createDataFrame([(k, t, 5, "z") for k, t in docs], "doc_id long, text string, chunk int, pair string").repartition(3)
    got = sorted((tuple(r) for r in align_tokenizers(rows, A, B).collect()), key=str)
    assert got == plain(docs)
    assert align_tokenizers(rows.limit(0), A, B).count() == 0


def test_given_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = sorted((tuple(r) for r in align_tokenizers(docs, A, B).collect()), key=str)
    assert got == plain([tuple(r) for r in docs.collect()])


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aZé1 \n\t ▁<s>'日🙂\xa0\x1c.", min_size=1, max_size=25))
def test_cuts_change_nothing(text):
    """Atoms' groups side by side are those of the whole text."""
    tool, aligner = plain_tool(), alignment.Aligner(A, B)
    whole = tool.text(text)
    numbers = aligner.numbers(alignment.CUT.split(text))
    if whole is None:
        assert -1 in numbers
    else:
        assert ";".join(aligner.texts[i] for i in numbers) == ";".join(whole[2])


def test_packed_numbers():
    for top in (0, 255, 256, 65_535, 65_536, 2**32 - 1, 2**32, 2**62):
        values = np.array([0, top, 1, top // 2], dtype=np.int64)
        raw = alignment.packed(values)
        assert alignment.unpacked(pa.py_buffer(raw)).tolist() == values.tolist()
        assert len(raw) == 1 + 4 * next(n for n in (1, 2, 4, 8) if top < 256**n)
    assert alignment.unpacked(pa.py_buffer(alignment.packed(np.zeros(0, dtype=np.int64)))).tolist() == []


def test_a_chunk_is_a_small_row():
    """Executors hold rows several times over: less than the chunk's text, even of made-up words that many pieces write."""
    rng = np.random.default_rng(5)
    words = np.array(["".join(rng.choice(list("aeiourstnlmdp"), rng.integers(3, 9))) for _ in range(3000)])
    texts = [" ".join(rng.choice(words, 500)) for _ in range(500)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts})
    rows = list(alignment._chunks(A, B, pa.int64())(iter([batch])))
    assert sum(len(row.column("id")[0]) for row in rows) == len(texts)
    for row in rows:
        held = sum(len(texts[i.as_py()]) for i in row.column("id")[0].values)
        assert row.nbytes < held


def test_query_keeps_batches_small(spark, tmp_path):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    docs = [(1, "a b c"), (2, None), (1, "a b c"), (None, "x  y")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.unset(name)
    try:
        got = QUERIES["op13_alignment"](spark, str(tmp_path))
        assert spark.conf.get(name) == str(BATCH_BYTES)
        assert sorted((tuple(r) for r in got.collect()), key=str) == plain(docs)
    finally:
        spark.conf.set(name, before)


_TOOLS = []


def plain_tool():
    if not _TOOLS:
        _TOOLS.append(Plain())
    return _TOOLS[0]
