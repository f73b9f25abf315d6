"""Alignment of two tokenizers over the bytes of the same texts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import BATCH_BYTES, pieces, written
from wardline.llm.csr import Csr, intervals, members, spread, tally

# Two chunks make a batch as ``small_batches`` hands them over.
CHUNK_BYTES = BATCH_BYTES // 2
KEPT_ATOMS = 200_000
# Atoms that are encoded as one text, and that are aligned at once.
JOINED_ATOMS, ALIGNED_ATOMS = 500, 20_000
# A space that stands alone between two other characters: tokens of neither kind go across its left edge.
CUT = re.compile(r"(?<=\S) (?=\S)")
SPACE_SIGN = "▁"
ID_BITS = 32


@lru_cache(maxsize=2)
def _byte_vocabulary(path: str):
    """(tokenizer, bytes of each id) of a byte-level vocabulary; strings of special tokens are plain text."""
    from tokenizers import Tokenizer

    from wardline.llm.tokens import _byte_signs

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = True
    value = {sign: b for b, sign in enumerate(_byte_signs())}
    written_as = tokenizer.get_vocab()
    made = [b""] * (max(written_as.values()) + 1)
    for token, i in written_as.items():
        made[i] = bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()
    return tokenizer, made


@lru_cache(maxsize=2)
def _piece_vocabulary(path: str):
    """(model, bytes of each id) of a sentence-piece vocabulary with byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(re.search(f"[^{SPACE_SIGN}]{SPACE_SIGN}", name) for name in names):
        raise ValueError("pieces go across the start of a word; texts can't be cut there")
    made = [
        bytes([int(name[3:-1], 16)]) if model.is_byte(i) else name.replace(SPACE_SIGN, " ").encode() for i, name in enumerate(names)
    ]
    return model, made


@dataclass(frozen=True)
class Aligned:
    """Tokens and links of a run of texts, side by side."""

    a: np.ndarray  # ids
    b: np.ndarray
    a_starts: np.ndarray  # of each text's tokens, and the end
    b_starts: np.ndarray
    a_group: np.ndarray  # group of each token, numbered through
    b_group: np.ndarray
    links: Csr  # A tokens by B tokens, shared bytes
    shared: Csr  # A tokens by B tokens, 1 where both are in one group


def align(a: np.ndarray, b: np.ndarray, a_starts: np.ndarray, b_starts: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> Aligned:
    """Overlaps of tokens whose bytes, text by text, are the same.

    Token-byte incidence matrices A and B have a row a token; A · Bᵀ holds the bytes two
    tokens share.  Groups end where tokens of both kinds end, so links never leave a
    group; the product of the group incidences links all tokens of a group.
    """
    a_end, b_end = np.cumsum(a_size[a]), np.cumsum(b_size[b])
    total = int(a_end[-1]) if len(a_end) else 0
    assert total == (int(b_end[-1]) if len(b_end) else 0)
    links = intervals(a_end, total).times(intervals(b_end, total).transpose())
    borders = np.intersect1d(a_end, b_end, assume_unique=True)
    a_group, b_group = np.searchsorted(borders, a_end), np.searchsorted(borders, b_end)
    shared = members(a_group, len(borders)).times(members(b_group, len(borders)).transpose())
    return Aligned(a, b, a_starts, b_starts, a_group, b_group, links, shared)


class Names:
    """Decimal ids with the sign that follows them: a comma, or the end of a group's side."""

    def __init__(self, n_a: int, n_b: int):
        signs = [(n_a, ","), (n_a, "|"), (n_b, ","), (n_b, ";")]
        self.first = np.concatenate([[0], np.cumsum([n for n, _ in signs])])
        self.names = np.array([f"{i}{sign}" for n, sign in signs for i in range(n)], dtype=object)
        self.lengths = np.array([len(x) for x in self.names], dtype=np.int64)

    def groups(self, found: Aligned) -> tuple[list[str], np.ndarray]:
        """``a1,a2|b1`` of every group, joined by ``;`` for each text, and the first group of each text, and the end."""
        n = int(found.a_group[-1]) + 1 if len(found.a_group) else 0
        a_cuts, b_cuts = (np.concatenate([[0], np.cumsum(np.bincount(g, minlength=n))]) for g in (found.a_group, found.b_group))
        code = np.empty(len(found.a) + len(found.b), dtype=np.int64)
        for ids, group, cuts, before, kind in (
            (found.a, found.a_group, a_cuts, b_cuts[:-1], 0), (found.b, found.b_group, b_cuts, a_cuts[1:], 2),
        ):
            at = np.arange(len(ids))
            code[at + before[group]] = ids + self.first[kind + (at + 1 == cuts[1:][group])]
        ends = np.concatenate([[0], np.cumsum(self.lengths[code])])[found.a_starts + found.b_starts].tolist()
        joined = "".join(self.names[code].tolist())
        return [joined[x: y - 1] for x, y in zip(ends, ends[1:])], np.append(found.a_group, n)[found.a_starts]


class Growing:
    """Rows of integers that are added in bulk."""

    def __init__(self, width: int):
        self.room, self.n = np.zeros((1024, width), dtype=np.int64), 0

    def add(self, rows: np.ndarray) -> None:
        if self.n + len(rows) > len(self.room):
            room = np.zeros((2 * (self.n + len(rows)), self.room.shape[1]), dtype=np.int64)
            room[: self.n] = self.room[: self.n]
            self.room = room
        self.room[self.n: self.n + len(rows)] = rows
        self.n += len(rows)


class Aligner:
    """What each atom, a text between two cuts, comes to; a bounded number is kept.

    Byte-level pieces and sentence pieces both start anew at a lone space, so a text's
    tokens, groups and links are those of its atoms one after the other.  For the same
    reason new atoms are encoded many at once, joined by lone spaces, and their tokens
    told apart by their bytes; where these are not the joined text's, or an atom has
    white space at an end, each atom is encoded by itself.
    """

    def __init__(self, a_path: str, b_path: str):
        self.a, self.a_bytes = _byte_vocabulary(a_path)
        self.b, self.b_bytes = _piece_vocabulary(b_path)
        self.a_size = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        self.names = Names(len(self.a_bytes), len(self.b_bytes))
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[str] = []
        # Of each atom: its first pair and its figures; of each pair: the two ids.
        self.first, self.figures, self.pairs = Growing(1), Growing(len(FIGURES)), Growing(1)
        self.first.add(np.zeros((1, 1), dtype=np.int64))

    def numbers(self, atoms: list[str]) -> list[int]:
        """The number of each atom, -1 where the two vocabularies don't give its bytes back."""
        missing = list(dict.fromkeys(x for x in atoms if x not in self.known))
        for start in range(0, len(missing), ALIGNED_ATOMS):
            some = missing[start: start + ALIGNED_ATOMS]
            edged = [x for x in some if x[0].isspace() or x[-1].isspace()]
            whole = [x for x in some if not (x[0].isspace() or x[-1].isspace())] if edged else some
            runs = []
            for at in range(0, len(whole), JOINED_ATOMS):
                run = whole[at: at + JOINED_ATOMS]
                tokens = self._joined(run)
                if tokens is None:
                    edged += run
                else:
                    runs.append((run, *tokens))
            if edged:
                runs.append(self._apart(edged))
            self._add(runs)
        return list(map(self.known.__getitem__, atoms))

    def _joined(self, atoms: list[str]):
        """Ids of both kinds and the end of each atom's among them, or None if bytes or ends differ."""
        text = " ".join(atoms)
        raw = f" {text}".encode()
        ends = np.cumsum([len(x) + 1 if x.isascii() else len(x.encode()) + 1 for x in atoms])
        sides = (
            (self.a.encode_batch_fast([f" {text}"], add_special_tokens=False)[0].ids, self.a_bytes, self.a_size),
            (self.b.encode(text, out_type=int), self.b_bytes, self.b_size),
        )
        out = []
        for ids, made, size in sides:
            if b"".join(map(made.__getitem__, ids)) != raw:
                return None
            ids = np.array(ids, dtype=np.int64)
            reached = np.cumsum(size[ids])
            at = np.searchsorted(reached, ends)
            if (reached[at] != ends).any():
                return None
            out.append((ids, at + 1))
        (a, a_ends), (b, b_ends) = out
        return a, b, a_ends, b_ends

    def _apart(self, atoms: list[str]):
        """The atoms whose bytes both vocabularies give back, with their ids and ends; the others are known as -1."""
        spaced = [f" {x}" for x in atoms]
        a_ids = [e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
        b_ids = self.b.encode(atoms, out_type=int, num_threads=1)
        good = []
        for i, text in enumerate(spaced):
            raw = text.encode()
            if b"".join(map(self.a_bytes.__getitem__, a_ids[i])) == raw == b"".join(map(self.b_bytes.__getitem__, b_ids[i])):
                good.append(i)
            else:
                self.known[atoms[i]] = -1
        sides = [[ids[i] for i in good] for ids in (a_ids, b_ids)]
        flat = [np.fromiter(chain.from_iterable(ids), dtype=np.int64) for ids in sides]
        return [atoms[i] for i in good], *flat, *(np.cumsum([len(x) for x in ids], dtype=np.int64) for ids in sides)

    def _add(self, runs) -> None:
        atoms = [x for run in runs for x in run[0]]
        if not atoms:
            return
        a, b = (np.concatenate([run[k] for run in runs]) for k in (1, 2))
        starts = []
        for k in (1, 2):
            before = np.cumsum([0] + [len(run[k]) for run in runs])
            starts.append(np.concatenate([[0], *(run[k + 2] + n for run, n in zip(runs, before[:-1], strict=True))]).astype(np.int64))
        found = align(a, b, *starts, self.a_size, self.b_size)
        texts, first = self.names.groups(found)
        cuts = found.links.indptr[found.a_starts]
        counts = [found.a_starts, found.b_starts, first, cuts, found.shared.indptr[found.a_starts]]
        at = len(self.texts)
        self.texts += texts
        self.figures.add(np.stack([np.diff(c) for c in counts], axis=1))
        self.first.add((self.pairs.n + cuts[1:])[:, None])
        self.pairs.add(((found.a[found.links.rows()] << ID_BITS) | found.b[found.links.indices])[:, None])
        self.known.update(zip(atoms, range(at, at + len(atoms)), strict=True))


FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_shared")


def packed(values: np.ndarray) -> bytes:
    """Numbers from zero on, each in the fewest of 1, 2, 4 and 8 bytes that hold all of them; the first byte tells how many."""
    kind = np.min_scalar_type(int(values.max()) if len(values) else 0)
    return bytes([kind.itemsize]) + values.astype(kind.newbyteorder("<")).tobytes()


def unpacked(raw: pa.Buffer) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _chunks(a_path: str, b_path: str, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a_path, b_path)
        for part in pieces(batches, "text", CHUNK_BYTES):
            if len(aligner.known) > KEPT_ATOMS:
                aligner.clear()
            atoms, counts = [], []
            for text in part.column("text").to_pylist():
                cut = CUT.split(text) if text else []
                atoms += cut
                counts.append(len(cut))
            number = np.array(aligner.numbers(atoms), dtype=np.int64)
            ends = np.cumsum(counts)
            bad = np.zeros(len(counts), dtype=bool)
            bad[np.searchsorted(ends, np.flatnonzero(number < 0), side="right")] = True
            number = number[np.repeat(~bad, counts)]
            counts = np.where(bad, 0, counts).astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(counts)])
            digests = []
            listed = number.tolist()
            for i in range(len(counts)):
                if counts[i]:
                    joined = ";".join(map(aligner.texts.__getitem__, listed[starts[i]: starts[i + 1]]))
                    digests.append(hashlib.sha256(joined.encode()).hexdigest())
                else:
                    digests.append("")
            # Atoms and pairs of this chunk, numbered within it.
            kinds, place = np.unique(number, return_inverse=True)
            figures, first = aligner.figures.room[kinds], aligner.first.room[:, 0]
            sizes = first[kinds + 1] - first[kinds]
            pairs, at = np.unique(aligner.pairs.room[spread(first[kinds], sizes), 0], return_inverse=True)
            atoms_pairs = Csr(np.concatenate([[0], np.cumsum(sizes)]), at, np.ones(len(at), dtype=np.int64), len(pairs))
            texts = tally(starts, place, len(kinds))
            linked = texts.times(atoms_pairs)
            columns = [texts.apply(figures[:, k]) for k in range(len(FIGURES))]

            def one(values, kind):
                flat = pa.array(values, kind)
                return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)

            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part.column("id").to_pylist()], pa.list_(id_type)), *(one(c, pa.int64()) for c in columns), one(digests, pa.string()),
                    *(pa.array([packed(x)], pa.binary()) for x in (linked.indptr, linked.indices, linked.data)),
                    pa.array([len(pairs)], pa.int64()), one(pairs, pa.int64()), one(np.bincount(linked.indices, minlength=len(pairs)), pa.int32()),
                ],
                ["id", *FIGURES, "groups", "text_starts", "text_pairs", "text_links", "n_pairs", "pairs", "holders"],
            )

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)

            n_pairs = row.column("n_pairs")[0].as_py()
            counts, best = np.zeros(n_pairs, dtype=np.int64), np.zeros(n_pairs, dtype=np.int64)
            found = row.column("found").flatten()
            if len(found):
                at = found.field("at").to_numpy(zero_copy_only=False)
                counts[at] = found.field("n").to_numpy(zero_copy_only=False)
                best[at] = found.field("best").to_numpy(zero_copy_only=False)
            texts = Csr(*(unpacked(row.column(c)[0].as_buffer()) for c in ("text_starts", "text_pairs", "text_links")), n_pairs)
            sums = [texts.apply(v) for v in (best, counts)]
            plain = [row.column(c).flatten() for c in ("id", *FIGURES)]
            yield pa.RecordBatch.from_arrays(
                [*plain, *(pa.array(s, pa.int64()) for s in sums), row.column("groups").flatten()],
                ["id", *FIGURES, "n_best", "count_sum", "groups_sha256"],
            )


def align_tokenizers(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups and links between the tokens of a byte-level and a sentence-piece vocabulary.

    Each task cuts its texts into chunks and stores a chunk as one matrix, texts by id
    pairs (the product of texts by atoms and atoms by pairs), with the number of its
    texts that hold each pair.
    Those numbers are summed over all chunks; every chunk then gets the counts of its own
    pairs back, so a pair that all documents hold is one row a chunk, not one a
    document, and the sums of a text are products with the chunk's counts.  A matrix
    travels as packed bytes, a few hundred KB a chunk; callers keep the batches small
    (``small_batches``), which executor and workers hold several times over.

    Returns per input row: id, n_a, n_b, n_groups, n_links, n_shared (pairs of tokens in
    one group), n_best, count_sum, groups_sha256.  Null and empty texts, and those that
    one of the vocabularies does not give back byte for byte, have no tokens: zeros and
    an empty digest.  Repeated rows are documents each; an empty table gives no rows;
    other columns are neither read nor returned.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    longs = ", ".join(f"{f} array<long>" for f in FIGURES)
    schema = (
        f"id array<{kind.simpleString()}>, {longs}, groups array<string>, text_starts binary, text_pairs binary, "
        "text_links binary, n_pairs long, pairs array<long>, holders array<int>"
    )
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made = rows.mapInArrow(_chunks(byte_path, piece_path, to_arrow_type(kind)), schema)
    chunks = written(made.withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    held = chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "holders")).alias("at", "p")).select("chunk", "at", F.col("p.pairs").alias("pair"), F.col("p.holders").alias("n"))
    counts = written(held.groupBy("pair").agg(F.sum("n").alias("n")), "counts")
    first = F.shiftrightunsigned("pair", ID_BITS)
    most = counts.groupBy(first.alias("a")).agg(F.max("n").alias("most"))
    ranked = counts.withColumn("a", first).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("int").alias("best"))
    known = held.select("chunk", "at", "pair").join(ranked, "pair").groupBy("chunk").agg(F.collect_list(F.struct("at", "n", "best")).alias("found"))
    own = chunks.drop("pairs", "holders")
    full = own.join(known, "chunk", "left").drop("chunk")
    sums = f"id {kind.simpleString()}, " + ", ".join(f"{f} long" for f in (*FIGURES, "n_best", "count_sum")) + ", groups_sha256 string"
    return full.mapInArrow(_summed, sums).withColumnRenamed("id", id_col)
