"""Documents in blocks, and an exchange between blocks and hash ranges.

Several operators ask the same kind of question: which of my hashes occur elsewhere, and where first. A block of
about `rows_per_block` documents first reduces its own hashes to distinct ones (so a key that a third of all documents
share is sent once for each block), and sends them, packed, to the owner of each hash range. The owner answers each block. Texts are
shuffled once, by block; the blocks' later passes reuse that exchange.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The id that stands for a null one; it counts as larger than any other.
NO_ID = (1 << 63) - 1

MAIL = "bucket int, block int, kind int, body binary"
_MAIL = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("body", pa.binary())])


def in_blocks(docs: DataFrame, rows_per_block: int = 1024, id_col: str = "doc_id", text_col: str = "text", extra: tuple = ()) -> tuple[DataFrame, int]:
    """(block, doc_id, text, extra columns), and how many blocks there are. Only the count of rows is computed here."""
    n = max(1, -(-docs.count() // rows_per_block))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    return docs.select(F.pmod(F.xxhash64(key, F.col(text_col)), F.lit(n)).cast("int").alias("block"), key.alias("doc_id"), F.col(text_col).cast("string").alias("text"), *extra), n


def buckets_for(n_blocks: int) -> int:
    """Hash ranges for so many blocks: each gets what about eight blocks send."""
    return max(48, n_blocks // 8)


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def post(h: np.ndarray, columns: list[np.ndarray], block: int, n_buckets: int, kind: int = 0) -> pa.Table:
    """A letter for each hash range. h ascends, so that each letter is a slice."""
    at = np.searchsorted(bucket_of(h, n_buckets), np.arange(n_buckets + 1))
    rows = np.flatnonzero(np.diff(at))
    bodies = [pack([h[at[b] : at[b + 1]], *(c[at[b] : at[b + 1]] for c in columns)]) for b in rows.tolist()]
    n = len(rows)
    return pa.table([pa.array(rows, pa.int32()), pa.array(np.full(n, block), pa.int32()), pa.array(np.full(n, kind), pa.int32()), pa.array(bodies, pa.binary())], schema=_MAIL)


def reply(block: int, kind: int, body: bytes) -> tuple:
    return (0, block, kind, body)


def mail(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _MAIL, strict=True)], schema=_MAIL)


def pack(arrays: list[np.ndarray]) -> bytes:
    n = np.array([len(arrays[0])], np.int64).tobytes()
    return n + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(body: bytes, dtypes: list) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(body, np.int64, 1)[0]), 8, []
    for d in map(np.dtype, dtypes):
        out.append(np.frombuffer(body, d, n, at))
        at += n * d.itemsize
    return out


def owners(letters: DataFrame, answer: Callable[..., list[tuple]], with_bucket: bool = False) -> DataFrame:
    """answer gets the letters (block, kind, body) of one hash range, and its number if asked for; it returns replies."""

    def run(table: pa.Table) -> pa.Table:
        got = sorted(zip(table["block"].to_pylist(), table["kind"].to_pylist(), table["body"].to_pylist(), strict=True))
        return mail(answer(got, table["bucket"][0].as_py()) if with_bucket else answer(got))

    return letters.groupBy("bucket").applyInArrow(run, MAIL)
