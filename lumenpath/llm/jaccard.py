"""N-gram Jaccard join with prefix trees.

1. Every text becomes the set of its distinct SHINGLE-word shingles (64-bit hashes). Equal sets are one class, so exact copies cost
   one set. The global order of shingles is rare first: by the number of sets that have them (counted over all documents), then by hash.
2. Sets that reach the threshold share one of their first n - ceil(t * n) + 1 shingles, which most often no other set has, and their sizes differ by a factor of t at most:
   by powers of 1 / t, they have one level of size, or neighbouring ones. A shingle in the prefixes of several sets of one level (each set counts in its own and the next) ties each of them
   to the first such set; connected ties form a cluster, and linked sets lie in one cluster. No pairs are made, and chance ties between sets that differ in size neither.
3. A cluster's sets, in shards of at most about SHARD_SHINGLES shingles, are joined shard by shard. One shard's sets stand in a prefix tree
   (most shared shingles first, so that copies share long paths); the other's run down it together: each edge adds its overlap once for
   all sets below it, and a query leaves a subtree where overlap so far plus the remaining length can't reach the bound.
4. Links between classes that are already connected in the same shard pair are redundant and not sent.

Null text, no words: empty set, linked with nothing. Null doc_id: larger than any other. Rows with one doc_id are separate documents.
A very long text is a run of its own. Ties can't matter: a component is known by its smallest doc_id. An empty table gives no rows.
Further columns are ignored by `jaccard_components` and kept by `keep_one`.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenpath.llm import blocks as B
from lumenpath.llm.arrays import U64, Words, mix, ragged, row_sums, runs, shingle_sets, text_column
from lumenpath.llm.blocks import NO_ID
from lumenpath.llm.components import components
from lumenpath.llm.sparkutil import checkpointed, fresh, ship

SHINGLE = 4
SHARD_SHINGLES = 400_000
ROWS_PER_BLOCK = 1024
#: Bytes of the table of shingles by queries that a tree is walked with.
TABLE_BYTES = 1 << 25


def _sets(texts, k: int):
    data, offsets = text_column(texts)
    for i, j in runs(offsets):
        words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=True)
        yield i, j, *shingle_sets(words, k)


def _set_ids(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    n = np.diff(bounds).astype(U64)
    return mix(row_sums(mix(h ^ U64(0x5851F42D4C957F2D)), bounds) + n).view(np.int64)


def _keys(h: np.ndarray, n_buckets: int) -> np.ndarray:
    """A shingle's hash range and 32 bits of its hash: what its count is kept by."""
    return (B.bucket_of(h, n_buckets).astype(U64) << U64(32)) | (h & U64(0xFFFFFFFF))


def _post_counts(n_buckets: int, k: int):
    """In how many different sets of the block each shingle is: four bytes a shingle, and the counts over one."""

    def run(table: pa.Table) -> pa.Table:
        kept, seen = [], set()
        for _, _, row, h, bounds in _sets(table["text"], k):
            ids = _set_ids(h, bounds)
            new = np.zeros(len(ids), bool)
            for r in np.unique(ids, return_index=True)[1].tolist():
                new[r] = int(ids[r]) not in seen
            seen.update(ids[new].tolist())
            kept.append(_keys(h[new[row]], n_buckets))
        keys, n = np.unique(np.concatenate(kept), return_counts=True)
        at = np.searchsorted(keys >> U64(32), np.arange(n_buckets + 1, dtype=U64))
        block, out = table["block"][0].as_py(), []
        for b in np.flatnonzero(np.diff(at)).tolist():
            own, count = keys[at[b] : at[b + 1]].astype(np.uint32), n[at[b] : at[b + 1]]
            many = np.flatnonzero(count > 1)
            out.append((b, block, 0, B.pack([own]) + B.pack([many.astype(np.uint32), count[many].astype(np.uint32)])))
        return B.mail(out)

    return run


def _count_owner(n_buckets: int):
    def run(got: list[tuple[int, int, bytes]], bucket: int) -> list[tuple]:
        owns, counts = [], []
        for _, _, body in got:
            (own,) = B.unpack(body, [np.uint32])
            many, n = B.unpack(body[8 + 4 * len(own) :], [np.uint32, np.uint32])
            count = np.ones(len(own), np.int64)
            count[many] = n
            owns.append(own)
            counts.append(count)
        keys, inverse = np.unique(np.concatenate(owns), return_inverse=True)
        total = np.bincount(inverse, np.concatenate(counts), len(keys))
        level = np.where(total > 1, np.minimum(255, 8 * np.log2(total)), 0).astype(np.uint8)[inverse]
        ends = np.cumsum([len(x) for x in owns])
        return [B.reply(block, bucket, np.packbits(x > 0).tobytes() + x[x > 0].tobytes()) for (block, _, _), x in zip(got, np.split(level, ends[:-1]), strict=True)]

    return run


def _signatures(n_buckets: int, percent: int, k: int):
    """Per row: its set, and those shingles of its prefix that several sets have."""

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _SIGNED.empty_table()
        parts = list(_sets(table["text"], k))
        known = np.unique(np.concatenate([_keys(h, n_buckets) for _, _, _, h, _ in parts]))
        at = np.searchsorted(known >> U64(32), np.arange(n_buckets + 1, dtype=U64))
        levels = np.zeros(len(known), np.uint8)
        for bucket, body in zip(replies["kind"].to_pylist(), replies["body"].to_pylist(), strict=True):
            a, z = at[bucket], at[bucket + 1]
            flags = -(-(z - a) // 8)
            several = np.unpackbits(np.frombuffer(body, np.uint8, flags), count=z - a).astype(bool)
            levels[a:z][several] = np.frombuffer(body, np.uint8, offset=flags)
        ns, ids, sizes, prefix = [], [], [], []
        for _, _, row, h, bounds in parts:
            n = np.diff(bounds)
            level = levels[np.searchsorted(known, _keys(h, n_buckets))] if len(h) else np.zeros(0, np.uint8)
            order = np.lexsort((level, row))  # stable: by hash among equals
            take = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
            chosen = order[ragged(bounds[:-1], take)]
            use = level[chosen] > 0
            ns.append(n)
            ids.append(_set_ids(h, bounds))
            sizes.append(np.bincount(row[chosen][use], minlength=len(n)))
            prefix.append(h[chosen][use])
        shingles = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.concatenate(sizes))), pa.int32()), pa.array(np.concatenate(prefix).view(np.int64)))
        return pa.table([table["doc_id"], table["mark"], pa.array(np.concatenate(ns).astype(np.int64)), pa.array(np.concatenate(ids)), shingles], schema=_SIGNED)

    return run


_SIGNED = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("set_id", pa.int64()), ("prefix", pa.list_(pa.int64()))])


def _packed_sets(k: int):
    """Of rows whose text has the set they were chosen for."""

    def run(batches):
        for batch in batches:
            want = batch.column("set_id").to_numpy()
            for i, j, _, h, bounds in _sets(batch.column("text"), k):
                right = np.flatnonzero(_set_ids(h, bounds) == want[i:j])
                body = [h[bounds[r] : bounds[r + 1]].tobytes() for r in right.tolist()]
                part = batch.slice(i, j - i).take(pa.array(right))
                yield pa.RecordBatch.from_arrays([part.column("cluster"), part.column("shards"), part.column("shard"), part.column("set_id"), pa.array(body, pa.binary())], ["cluster", "shards", "shard", "set_id", "body"])

    return run


class _Union:
    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        while (y := self.up.setdefault(x, x)) != x:
            self.up[x] = x = self.up.setdefault(y, y)
        return x

    def join(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _tree_join(sets: list[np.ndarray], stored: list[int], queries: list[int], ids: list[int], percent: int, union: _Union) -> list[tuple[int, int]]:
    """Links (by ids) of stored sets with query sets that reach percent / 100; only those that connect something new."""
    size = np.array([len(s) for s in sets])
    keys, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.full(len(keys), -1)
    order = np.argsort(-count, kind="stable")
    order = order[count[order] > 1]
    rank[order] = np.arange(len(order))
    coded = np.split(rank[code], np.cumsum(size)[:-1])
    coded = [np.sort(c[c >= 0]) for c in coded]  # a shingle of one set alone can't overlap; it counts by size
    stored = sorted(stored, key=lambda s: coded[s].astype(">u4").tobytes())
    paths, n_stored = [coded[s] for s in stored], size[stored]
    shared = [0] * (len(stored) + 1)
    for k in range(1, len(stored)):
        m = min(len(paths[k - 1]), len(paths[k]))
        differ = np.flatnonzero(paths[k - 1][:m] != paths[k][:m])
        shared[k] = int(differ[0]) if len(differ) else m
    shared, links = np.array(shared), []
    step = max(1, TABLE_BYTES // max(1, len(order)))
    for q0 in range(0, len(queries), step):
        some = queries[q0 : q0 + step]
        n_query = size[some]
        table = np.zeros((len(order), len(some)), np.uint8)
        for c, s in enumerate(some):
            table[coded[s], c] = 1
        stack = [(0, len(stored), 0, np.arange(len(some)), np.zeros(len(some), np.int64))]
        while stack:
            lo, hi, depth, active, overlap = stack.pop()
            to = int(shared[lo + 1 : hi].min()) if hi - lo > 1 else len(paths[lo])
            if to > depth:
                overlap = overlap + table[paths[lo][depth:to]][:, active].sum(0, dtype=np.int64)
            rest = max(len(paths[k]) for k in range(lo, hi)) - to
            need = -(-percent * (n_query[active] + n_stored[lo:hi].min()) // (100 + percent))
            alive = np.minimum(overlap + rest, n_query[active]) >= need
            active, overlap = active[alive], overlap[alive]
            if not len(active):
                continue
            while lo < hi and len(paths[lo]) == to:  # sets that end here
                both = n_stored[lo] + n_query[active] - overlap
                for c in active[100 * overlap >= percent * both].tolist():
                    x, y = ids[stored[lo]], ids[some[c]]
                    if union.join(x, y):
                        links.append((x, y))
                lo += 1
            if lo < hi:
                cuts = [lo, *(np.flatnonzero(shared[lo + 1 : hi] == to) + lo + 1).tolist(), hi]
                stack += [(a, b, to, active, overlap) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return links


def _join_shards(percent: int):
    def run(table: pa.Table) -> pa.Table:
        rows: dict[tuple, list] = {}
        columns = [table[c].to_pylist() for c in ("cluster", "low", "high", "shard", "set_id", "body")]
        for cluster, low, high, shard, set_id, body in zip(*columns, strict=True):
            rows.setdefault((cluster, low, high), {})[set_id] = (shard, np.frombuffer(body, U64))
        links = []
        for (_, low, high), found in rows.items():
            ids = list(found)
            stored = [i for i, x in enumerate(ids) if found[x][0] == low]
            queries = [i for i, x in enumerate(ids) if found[x][0] == high]
            if stored and queries and len(ids) > 1:
                links += _tree_join([found[x][1] for x in ids], stored, queries, ids, percent, _Union())
        return pa.table([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

    return run


def _classes(docs: DataFrame, percent: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, n, set_id) of each row, and (node, root) of linked set_ids."""
    spark = docs.sparkSession
    ship(spark)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")
    text = F.col("text").cast("string").alias("text")
    own = docs.select(key, text, F.xxhash64("text").alias("mark"))
    base, n = B.in_blocks(docs, ROWS_PER_BLOCK, extra=(F.xxhash64("text").alias("mark"),))
    n_buckets, by_block = B.buckets_for(n), base.groupBy("block")
    counts = B.owners(by_block.applyInArrow(_post_counts(n_buckets, k), B.MAIL), _count_owner(n_buckets), with_bucket=True)
    made = by_block.cogroup(counts.groupBy("block")).applyInArrow(_signatures(n_buckets, percent, k), "doc_id long, mark long, n long, set_id long, prefix array<long>")
    signed = checkpointed(made)
    level = F.floor(F.log("n") / -math.log(percent / 100) + 1e-9) if percent < 100 else F.col("n")
    sized = signed.where(F.size("prefix") > 0).select("set_id", "prefix", F.explode(F.array(level, level + 1)).alias("size"))
    entries = sized.select("set_id", "size", F.explode("prefix").alias("shingle"))
    first = entries.groupBy("shingle", "size").agg(F.min("set_id").alias("a"), F.max("set_id").alias("z")).where("a < z").select("shingle", "size", "a")
    ties = entries.join(first, ["shingle", "size"]).where("set_id <> a").select("a", "set_id").distinct()
    cluster = components(ties, "a", "set_id").select(F.col("node").alias("set_id"), F.col("root").alias("cluster"))
    first_of = signed.where("n > 0").groupBy("set_id").agg(F.min(F.struct("doc_id", "mark")).alias("d"), F.max("n").alias("n"))
    members = first_of.join(cluster, "set_id").select("cluster", "set_id", "d.doc_id", "d.mark", "n")
    mass = members.groupBy("cluster").agg(F.ceil(F.sum("n") / SHARD_SHINGLES).cast("int").alias("shards"))
    members = checkpointed(members.join(mass, "cluster").withColumn("shard", F.pmod(F.xxhash64("set_id"), "shards").cast("int")))
    total = members.agg(F.sum(F.col("n") * F.col("shards"))).first()[0] or 0
    chosen = own.join(members.drop("n"), ["doc_id", "mark"]).select("cluster", "shards", "shard", "set_id", "text")
    sets = chosen.mapInArrow(_packed_sets(k), "cluster long, shards int, shard int, set_id long, body binary")
    other = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    pairs = sets.withColumn("other", other).withColumn("low", F.least("shard", "other")).withColumn("high", F.greatest("shard", "other"))
    bucket = F.pmod(F.xxhash64("cluster", "low", "high"), F.lit(max(64, total // 1_000_000))).cast("int")
    links = pairs.select(bucket.alias("bucket"), "cluster", "low", "high", "shard", "set_id", "body").groupBy("bucket").applyInArrow(_join_shards(percent), "a long, b long")
    return signed.drop("prefix"), components(links, "a", "b")


def _rooted(docs: DataFrame, percent: int, k: int) -> tuple[DataFrame, DataFrame]:
    signed, linked = _classes(docs, percent, k)
    rooted = signed.join(linked, signed["set_id"] == linked["node"], "left").select("doc_id", "mark", "n", F.when(F.col("n") > 0, F.coalesce("root", "set_id")).alias("root"))
    return rooted, rooted.where("n > 0").groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("first"))


def jaccard_components(docs: DataFrame, percent: int = 85, k: int = SHINGLE) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    rooted, _ = _rooted(docs, percent, k)
    shared = rooted.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("first"), F.count("*").alias("docs")).where("docs > 1")
    first = checkpointed(shared.select("root", "first"))  # a table of its own, so that Spark can split a very large root in the join
    own = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    out = rooted.join(first, "root", "left").withColumn("component_id", F.coalesce("first", "doc_id"))
    return out.select(own("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), own("component_id").alias("component_id"))


def keep_one(docs: DataFrame, percent: int = 85, k: int = SHINGLE) -> DataFrame:
    """docs, with one document of each component: that with the smallest doc_id. Documents without words all stay."""
    _, first = _rooted(docs, percent, k)
    keep = first.select("first.*")
    key, mark = fresh(docs, "key", "mark")
    own = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(mark, F.xxhash64("text"))
    keep = keep.select(F.col("doc_id").alias(key), F.col("mark").alias(mark))
    blank = F.length(F.btrim(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(" \t\n\x0b\f\r"))) == 0
    kept = own.where(~blank).join(keep, [key, mark]).dropDuplicates([key, mark]).select(*[F.col(f"`{c}`") for c in docs.columns])
    return kept.union(docs.where(blank))
