"""Packing of token sequences balanced by attention cost."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm import tokens
from wardline.llm.common import pieces

SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, copy long"
GROUP_TOKENS = 4_000_000
HELD_BYTES = 1 << 20


def piece_cost(length, linear: float, quadratic: float):
    """Work of one piece: its tokens pass the layers once and attend to each other."""
    return linear * length + quadratic * length * length


def capacities(total: int, size: int) -> list[int]:
    """Room of the sequences for ``total`` tokens: whole ones, then powers of two without padding."""
    whole, rest = divmod(total, size)
    return [size] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def assign(lengths, size: int, linear: float, quadratic: float):
    """Pieces (document, start, length, sequence, offset) of documents of the given lengths.

    A document of ``size`` tokens or more gives whole sequences first.  What remains
    goes, longest first, to the cheapest sequence with room for all of it; where none
    has, it is cut and fills the cheapest sequences that have any.  The rooms add up
    to the tokens, so every sequence ends full.
    """
    import numpy as np

    lengths = np.asarray(lengths, dtype=np.int64)
    out = []
    sequence = 0
    for doc in np.flatnonzero(lengths >= size).tolist():
        for start in range(0, int(lengths[doc]) - size + 1, size):
            out.append((doc, start, size, sequence, 0))
            sequence += 1
    rest = lengths % size
    room = np.array(capacities(int(rest.sum()), size), dtype=np.int64)
    filled = np.zeros(len(room), dtype=np.int64)
    cost = np.zeros(len(room))
    for doc in np.argsort(-rest, kind="stable").tolist():
        left, start = int(rest[doc]), int(lengths[doc] - rest[doc])
        while left:
            free = room - filled
            fits = free >= left
            target = int(np.where(fits if fits.any() else free > 0, cost, np.inf).argmin())
            take = min(left, int(free[target]))
            out.append((doc, start, take, sequence + target, int(filled[target])))
            filled[target] += take
            cost[target] += piece_cost(take, linear, quadratic)
            start, left = start + take, left - take
    return out, sequence + len(room)


def _packer(path: str, size: int, end_id: int, linear: float, quadratic: float, group: int, id_type: pa.DataType):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        encoder = tokens.WordEncoder(path)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        base = TaskContext.get().partitionId() << 33
        ids, encoded, held, used, copies = [], [], 0, 0, {}

        def flush():
            nonlocal ids, encoded, held, used
            found, sequences = assign([len(x) // 4 for x in encoded], size, linear, quadratic)
            rows = [
                (ids[d], s, n, zlib.crc32(encoded[d][4 * s: 4 * (s + n)]), len(encoded[d]) // 4, base + used + q, o, d) for d, s, n, q, o in found
            ]
            used += sequences
            columns = [list(x) for x in zip(*rows, strict=True)]
            made = pa.RecordBatch.from_arrays(
                [pa.array(columns[0], id_type), *(pa.array(x, pa.int64()) for x in columns[1:7]), pa.array([base + copies["n"] + d for d in columns[7]], pa.int64())],
                ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "copy"],
            )
            copies["n"] += len(ids)
            ids, encoded, held = [], [], 0
            return made

        copies["n"] = 0
        for batch in pieces(batches, "text", HELD_BYTES):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(key)
                encoded.append(encoder.encode(text) + end)
                held += len(encoded[-1]) // 4
                if held >= group:
                    yield flush()
        if ids:
            yield flush()

    return pack


def pack_documents(
    docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1, linear: float = 1.0, quadratic: float = 1 / 2048,
    group_tokens: int = GROUP_TOKENS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Every document's ids, followed by ``end_id``, cut into pieces of sequences of ``size``.

    Each task packs the documents it reads, ``group_tokens`` tokens at a time, so
    nothing is shuffled and memory is bounded; a group's sequences are filled to the
    last token, its remainder in sequences of a power of two, which need no padding.
    A piece costs ``linear * n + quadratic * n * n``, and the descending assignment
    evens out that cost over a group's sequences.

    Returns per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    and ``copy``, a number of the input row (repeated rows are packed each on its own).
    A null or empty text is ``end_id`` alone; an empty table gives no pieces; other
    columns are neither read nor returned.  Sequence ids are unique, not dense.
    """
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    from pyspark.sql.pandas.types import to_arrow_type

    pack = _packer(tokenizer, size, end_id, linear, quadratic, group_tokens, to_arrow_type(id_type))
    return rows.mapInArrow(pack, f"id {id_type.simpleString()}, {SCHEMA}").withColumnRenamed("id", id_col)
