"""Exact top-k by inner product with MaxScore, over shards of candidates and blocks of queries.

A shard stores its vectors by dimension: one posting column for each dimension, with the largest and smallest component of each part of
PART vectors. For a query the most that a dimension can add is max(q * largest, q * smallest, 0). Dimensions are ordered by those bounds;
the trailing ones whose bounds sum to less than the query's k-th best score so far are non-essential: a vector can't enter by them alone.
The essential columns are traversed for all vectors of a part; the others are probed STEP columns at a time, only for
vectors whose score so far plus the bounds of what is left reaches the k-th best. Queries meet one shard first; the k-th best score there is a
lower bound of the final one, so every other shard starts with it. Each shard returns its k best of each query; these are merged. Ties go to the smaller vec_id.

Shards stay where they are dealt; blocks of queries, the smaller side, are sent to them. GROUPS of blocks share a shard's row only as long as there are fewer shards than tasks.

All arithmetic is in integers (in float64 where every partial sum is below 2**53, else in int64). Where a score might not fit into 64 bits, an OverflowError is
raised. Vectors that are null or hold null, NaN or infinite components, and rows with null vec_id, take no part; shorter vectors (an empty one too) are padded with
zeros. A query never meets rows with its own vec_id. Repeated rows (same vec_id) are candidates each. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenpath.llm.blocks import pack as packed
from lumenpath.llm.blocks import unpack
from lumenpath.llm.sparkutil import ship

SHARD, PART, QUERIES, STEP, GROUPS = 16_384, 2_048, 512, 8, 4


def quantised(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vector: Column) -> Column:
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def _pack(table: pa.Table) -> pa.Table:
    ids = table["vec_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    rows = [np.asarray(x, np.int64) for x in table["v"].to_pylist()]
    width = max((len(x) for x in rows), default=0)
    flat = np.zeros((len(rows), width), np.int64)
    for i, o in enumerate(order.tolist()):
        flat[i, : len(rows[o])] = rows[o]
    kind = np.int16 if not flat.size or np.abs(flat).max() < 32_000 else np.int64
    return pa.table([pa.array([table["part"][0].as_py()], pa.int32()), pa.array([width], pa.int32()), pa.array([kind().itemsize], pa.int32()), pa.array([packed([ids[order]])], pa.binary()), pa.array([flat.astype(kind).tobytes()], pa.binary())], names=["part", "width", "item", "ids", "body"])


_PACKED = "part int, width int, item int, ids binary, body binary"


def _matrix(width: int, item: int, ids: bytes, body: bytes) -> tuple[np.ndarray, np.ndarray]:
    (ids,) = unpack(ids, [np.int64])
    return ids, np.frombuffer(body, f"i{item}").reshape(len(ids), width)


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    new = np.ones(len(query), bool)
    new[1:] = query[1:] != query[:-1]
    at = np.flatnonzero(new)
    place = np.arange(len(query)) - np.repeat(at, np.diff(np.append(at, len(query))))
    use = place < k
    return query[use], ids[use], score[use]


def max_score(q_ids, q, c_ids, c, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the query, candidate's id, score) of each query's k best candidates, but those below `least`."""
    width = max(q.shape[1], c.shape[1])
    q, c = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, c))
    largest = [np.abs(m.astype(np.float64)).max(0, initial=0) for m in (q, c)]
    most = float(largest[0] @ largest[1])
    if most >= 2.0**63 or max(x.max(initial=0) for x in largest) >= 2.0**62:
        raise OverflowError("top_k: scores don't fit into 64 bits")
    kind = np.float64 if most < 1 << 52 else np.int64
    q, low = q.astype(kind), np.iinfo(np.int64).min
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    given = np.full(len(q), -np.inf) if least is None else least
    floor = given.copy()
    for at in range(0, len(c), PART):
        ids, part = c_ids[at : at + PART], c[at : at + PART].astype(kind)
        bound = np.maximum(np.maximum(q * part.max(0), q * part.min(0)), 0)
        order = np.argsort(-bound.sum(0), kind="stable")
        post, ask, bound = np.ascontiguousarray(part[:, order].T), np.ascontiguousarray(q[:, order]), bound[:, order]
        left = np.zeros((len(q), width + 1))
        left[:, :-1] = np.cumsum(bound[:, ::-1].astype(np.float64), 1)[:, ::-1]
        essential = (left[:, :-1] >= floor[:, None]).sum(1)  # columns before the non-essential ones
        essential = np.minimum(-(-essential // STEP) * STEP, width)
        found = []
        for e in np.unique(essential).tolist():
            rows = np.flatnonzero(essential == e)
            done = min(e, max(STEP, width // 2))  # past half of the columns, only competitive vectors go on
            score = ask[rows, :done] @ post[:done]
            alive = score + left[rows, done][:, None] >= floor[rows][:, None]
            r, v = np.nonzero(alive)
            s = score[r, v]
            r = rows[r]
            while done < width and len(r):
                to = min(done + STEP, width)
                if len(r) > len(rows) * len(ids) // 8:
                    s = s + (ask[rows, done:to] @ post[done:to])[np.searchsorted(rows, r), v]
                else:
                    s = s + (ask[r, done:to] * part[:, order[done:to]][v]).sum(1)
                done = to
                use = s + left[r, done] >= floor[r]
                r, v, s = r[use], v[use], s[use]
            other = q_ids[r] != ids[v]
            found.append((r[other], ids[v[other]], s[other].astype(np.int64)))
        best = _best(*(np.concatenate([b, *f]) for b, f in zip(best, zip(*found, strict=True), strict=True)), k)
        n = np.bincount(best[0], minlength=len(q))
        last = np.full(len(q), low)
        last[best[0]] = best[2]  # ascending place: the last one stays
        floor = np.maximum(np.where(n >= k, last, -np.inf), given)
    return best


def _sides(x: dict) -> tuple:
    return *_matrix(x["q_width"], x["q_item"], x["q_ids"], x["q_body"]), *_matrix(x["width"], x["item"], x["ids"], x["body"])


_BLOCK = "block int, q_width int, q_item int, q_ids binary, q_body binary"


def _first(k: int):
    """Blocks of queries with the k-th best score of each query in one shard."""
    names = [x.split()[0] for x in _BLOCK.split(", ")]

    def run(batches):
        for batch in batches:
            least = []
            for x in batch.to_pylist():
                query, _, score = max_score(*(sides := _sides(x)), k)
                floor, n = np.full(len(sides[0]), -np.inf), np.bincount(query, minlength=len(sides[0]))
                floor[query] = score  # in descending order: the last one stays
                floor[n < k] = -np.inf
                least.append(floor.tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(least, pa.binary())], [*names, "q_least"])

    return run


def _search(k: int):
    def run(batches):
        for batch in batches:
            for x in batch.to_pylist():
                q_ids, q, c_ids, c = _sides(x)
                query, ids, score = max_score(q_ids, q, c_ids, c, k, np.frombuffer(x["q_least"], np.float64))
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[query]), pa.array(ids), pa.array(score)], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row for which `queries` holds, the k best of all other rows."""
    spark = vectors.sparkSession
    ship(spark)
    use = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    own = use.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    count = own.agg(F.count("*"), F.count_if("asks")).first()
    n_shards, n_blocks = max(1, -(-count[0] // SHARD)), max(1, -(-count[1] // QUERIES))
    groups = max(1, min(n_blocks, -(-GROUPS * spark.sparkContext.defaultParallelism // n_shards)))
    dealt = lambda df, n: df.select(F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("part"), "vec_id", "v").groupBy("part").applyInArrow(_pack, _PACKED)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    shards, blocks = dealt(own, n_shards), dealt(own.where("asks"), n_blocks)
    blocks = blocks.select(F.col("part").alias("block"), *[F.col(c).alias(f"q_{c}") for c in ("width", "item", "ids", "body")])
    tasks = max(1, min(n_blocks, spark.sparkContext.defaultParallelism))
    one = shards.where("part = 0").withColumn("task", every(tasks))
    seeded = blocks.withColumn("task", F.col("block") % tasks).join(one, "task").mapInArrow(_first(k), _BLOCK + ", q_least binary")
    sent = seeded.withColumn("part", every(n_shards)).withColumn("group", F.col("block") % groups)
    found = shards.withColumn("group", every(groups)).join(sent, ["part", "group"]).mapInArrow(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
