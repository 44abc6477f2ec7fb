"""Substring dedup by relative Lempel-Ziv parsing.

Every document is parsed against the documents with smaller ids, which stand in indexed reference blocks:

1. Anchors. Each block picks anchors: of any WINDOW consecutive words, the 7-word run with the smallest hash. Equal windows
   have equal anchors, wherever they stand. The owner of a hash range tells each block which of its anchors other documents have, and
   the block with an anchor's first document (of smallest id) who asks for it.
2. Reference. That block sends, to each block that asks, the words around the anchors asked for: what a factor there can reach. So every
   reference block that shares an anchor with a block of documents is indexed there, by its windows, each with its chain of places.
3. Parse. A document is factored greedily, left to right: at each word the longest run of words that the reference has in a document of smaller id,
   taken if it has WINDOW words or more, else one literal word. Long factors are duplicate spans.
4. Factor boundaries. Windows that run over the end of a factor are looked up in the index. Windows that hold a shared anchor and still lie
   in nothing found (their earlier document isn't the anchor's first) are compared by their own hash, with the first documents' windows.

A window in a factor is in the reference. Of a window W in no factor of d, but in an earlier document, let x be the first document with it. No
document before x has W, so x has it in no factor either; its anchor is shared, so x and d both post W, and d is told. So the result is exact
(up to equal 64-bit hashes): no window is lost, whatever the number of copies.

Null or empty text: no words, nothing removed. Null doc_id: larger than all others. Rows with the same doc_id are
judged one by one and never against each other. A very long text is a run of its own; it is parsed whole. Ties between factors of equal length
go to the smaller id; they remove the same words. An empty table gives no rows. Further columns are ignored by `duplicate_words`, kept by `strip_duplicates`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenpath.llm import blocks as B
from lumenpath.llm.arrays import U64, Words, ragged, row_sums, runs, text_column, windows
from lumenpath.llm.sparkutil import ship

WINDOW, GRAM = 13, 7
SPAN = WINDOW - GRAM + 1  # 7-word runs in a window


class _Parse:
    """Anchors of a run of rows, and for each window the anchor that it holds."""

    def __init__(self, words: Words):
        self.words = words
        self.at, self.gram = windows(words, GRAM)
        self.win, self.win_hash = windows(words, WINDOW)
        n = len(self.win)
        self.held = np.zeros(n, np.int64)  # index into at
        if n:
            first = np.searchsorted(self.at, self.win)
            best = self.gram[first].copy()
            self.held = first.copy()
            for j in range(1, SPAN):  # of equal ones the last
                h = self.gram[first + j]
                less = h <= best
                best[less] = h[less]
                self.held[less] = first[less] + j
        chosen = np.zeros(len(self.at), bool)
        chosen[self.held] = True
        self.anchors = np.flatnonzero(chosen)
        row = words.row_of()
        self.row = row[self.at[self.anchors]] if n else np.zeros(0, np.int64)


def _first_in_block(h: np.ndarray, doc: np.ndarray, more: list[np.ndarray]) -> tuple:
    """Distinct h, ascending: the smallest doc, more of that row, and whether another doc has h too."""
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(h)) - 1
    return h[at], doc[at], [m[order][at] for m in more], (doc[at] != doc[last]).astype(np.uint8) if len(h) else np.zeros(0, np.uint8)


def _joined(got: list[tuple[int, int, bytes]], dtypes: list) -> tuple[np.ndarray, list[np.ndarray]]:
    parts = [B.unpack(body, dtypes) for _, _, body in got]
    return np.repeat([b for b, _, _ in got], [len(p[0]) for p in parts]), [np.concatenate(c) for c in zip(*parts, strict=True)]


#: Kinds of replies: shared anchors, anchors that others ask for, reference texts, first documents of windows.
SHARED, WANTED, TEXTS, FIRSTS = range(4)


def _groups(h: np.ndarray, doc: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries sorted by (h, doc): the first entry with each one's h, whether several documents have it, and whether one is the first."""
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    at = np.flatnonzero(new)
    if not len(at):
        return at, new, new
    group, last = np.cumsum(new) - 1, np.append(at[1:], len(h)) - 1
    several = (doc[at] != doc[last]) | (np.maximum.reduceat(many, at) > 0)
    return at[group], several[group], new


def _by_block(block: np.ndarray, columns: list[np.ndarray], kind: int) -> list[tuple]:
    order = np.argsort(block, kind="stable")
    columns, block = [c[order] for c in columns], block[order]
    ids, starts = np.unique(block, return_index=True)
    ends = np.append(starts, len(block))[1:]
    return [B.reply(int(b), kind, B.pack([c[s:e] for c in columns])) for b, s, e in zip(ids, starts, ends, strict=True)]


def _anchor_owner(got: list[tuple[int, int, bytes]]) -> list[tuple]:
    """To each block: those of its anchors that several documents have. To the block of an anchor's first document: the blocks that ask for it."""
    block, (h, doc, many) = _joined(got, [U64, np.int64, np.uint8])
    order = np.lexsort((doc, h))
    block, h, doc, many = block[order], h[order], doc[order], many[order]
    first, several, _ = _groups(h, doc, many)
    asks = several & ((np.arange(len(h)) != first) | (many > 0))
    return _by_block(block[several], [h[several]], SHARED) + _by_block(block[first[asks]], [h[asks], block[asks].astype(np.int32)], WANTED)


def _window_owner(got: list[tuple[int, int, bytes]]) -> list[tuple]:
    """To each block: those of its windows that an earlier document has, with the first one."""
    block, (h, doc, many) = _joined(got, [U64, np.int64, np.uint8])
    order = np.lexsort((doc, h))
    block, h, doc, many = block[order], h[order], doc[order], many[order]
    first, several, _ = _groups(h, doc, many)
    use = several & ((doc != doc[first]) | (many > 0))
    return _by_block(block[use], [h[use], doc[first][use]], FIRSTS)


def _rows(table: pa.Table):
    data, offsets = text_column(table["text"])
    docs = table["doc_id"].to_numpy()
    for i, j in runs(offsets):
        own = data[offsets[i] : offsets[j]]
        yield i, j, own, docs[i:j], Words(own, offsets[i : j + 1] - offsets[i])


def _post_anchors(n_buckets: int):
    def run(table: pa.Table) -> pa.Table:
        h, doc = [], []
        for _, _, _, docs, words in _rows(table):
            p = _Parse(words)
            h.append(p.gram[p.anchors])
            doc.append(docs[p.row])
        h, doc, _, many = _first_in_block(np.concatenate(h), np.concatenate(doc), [])
        return B.post(h, [doc, many], table["block"][0].as_py(), n_buckets)

    return run


def _bodies(replies: pa.Table, kind: int) -> list[bytes]:
    return [b for b, k in zip(replies["body"].to_pylist(), replies["kind"].to_pylist(), strict=True) if k == kind]


def _columns(bodies: list[bytes], dtypes: list) -> list[np.ndarray]:
    parts = [B.unpack(b, dtypes) for b in bodies] or [[np.zeros(0, d) for d in dtypes]]
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def _lookup(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index of each h in the ascending keys, -1 where it is absent."""
    if not len(keys) or not len(h):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, at, -1)


def _send_reference(table: pa.Table, replies: pa.Table) -> pa.Table:
    """To each block that asks: the words around the anchors that it asks for, as texts with their documents and places."""
    want, to = _columns(_bodies(replies, WANTED), [U64, np.int32])
    if not table.num_rows or not len(want):
        return B.mail([])
    data, offsets = text_column(table["text"])
    raw, found, starts, ends, n = data.tobytes(), [], [], [], 0
    for i, _, _, docs, words in _rows(table):
        p = _Parse(words)
        found.append((p.gram[p.anchors], docs[p.row], p.at[p.anchors] + n, words.first[p.row] + n, words.first[p.row + 1] + n))
        starts.append(words.start + offsets[i])
        ends.append(words.end + offsets[i])
        n += len(words)
    start, end = np.concatenate(starts), np.concatenate(ends)
    h, doc, at, low, high = (np.concatenate(c) for c in zip(*found, strict=True))
    h, doc, (at, low, high), _ = _first_in_block(h, doc, [at, low, high])
    k = _lookup(h, want)
    k, to = k[k >= 0], to[k >= 0]
    order = np.lexsort((at[k], to))
    k, to = k[order], to[order]
    begin, stop = np.maximum(at[k] - WINDOW + 1, low[k]), np.minimum(at[k] + GRAM + WINDOW - 1, high[k])
    new = np.ones(len(k), bool)
    new[1:] = (to[1:] != to[:-1]) | (low[k[1:]] != low[k[:-1]]) | (begin[1:] > stop[:-1])
    first = np.flatnonzero(new)
    begin, stop = begin[first], stop[np.append(first[1:], len(k)) - 1]
    doc, to, place = doc[k[first]], to[first], begin - low[k[first]]
    from_byte, to_byte = start[begin], end[stop - 1]
    cuts, out, own = np.append(np.flatnonzero(np.diff(to, prepend=-1)), len(to)).tolist(), [], table["block"][0].as_py()
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        texts = b"".join([raw[s:e] for s, e in zip(from_byte[a:z].tolist(), to_byte[a:z].tolist(), strict=True)])
        out.append(B.reply(int(to[a]), TEXTS, B.pack([doc[a:z], place[a:z], to_byte[a:z] - from_byte[a:z], np.full(z - a, own, np.int64)]) + texts))
    return B.mail(out)


class Reference:
    """The reference blocks' texts that a block of documents is parsed against, indexed by their windows: each has a chain of places, smaller ids first."""

    #: Words that are compared at a time.
    STEP = 32

    def __init__(self, bodies: list[bytes]):
        columns, texts = [], []
        for body in bodies:
            own = B.unpack(body, [np.int64] * 4)
            columns.append(own)
            texts.append(np.frombuffer(body, np.uint8, offset=8 + 32 * len(own[0])))
        doc, place, size, block = (np.concatenate(c) for c in zip(*columns, strict=True)) if columns else [np.zeros(0, np.int64)] * 4
        data = np.concatenate(texts) if texts else np.zeros(0, np.uint8)
        offsets = np.append(0, np.cumsum(size))
        words, windows_at, hashes, n = [], [], [], 0
        for i, j in runs(offsets):
            w = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            at, h = windows(w, WINDOW)
            row = w.row_of()
            spread = np.zeros(len(w) + j - i, U64)  # a blank after each text
            spread[np.arange(len(w)) + row] = w.hash
            words.append(spread)
            windows_at.append(np.stack([at + row[at] + n, row[at] + i, at - w.first[row[at]]]) if len(at) else np.zeros((3, 0), np.int64))
            hashes.append(h)
            n += len(spread)
        self.words = np.concatenate([*words, np.zeros(self.STEP, U64)])
        at, row, inside = np.concatenate(windows_at, 1) if windows_at else np.zeros((3, 0), np.int64)
        h = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        order = np.lexsort((doc[row], h))
        self.key, self.at, self.doc, self.block, self.place = h[order], at[order], doc[row][order], block[row][order], (place[row] + inside)[order]

    def chains(self, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of each window's chain; empty where no document before doc has it."""
        low, high = np.searchsorted(self.key, h, "left"), np.searchsorted(self.key, h, "right")
        if len(self.doc):
            low = np.where(self.doc[np.minimum(low, len(self.doc) - 1)] < doc, low, high)
        return low, high

    def longest(self, own: np.ndarray, low: int, high: int, doc: int) -> tuple[int, int]:
        """(words, entry) of the longest run that `own` starts with, out of a chain whose windows `own` starts with."""
        high = low + int(np.searchsorted(self.doc[low:high], doc))
        entry, n = np.arange(low, high), WINDOW
        while n < len(own):
            some = own[n : n + self.STEP]
            same = self.words[self.at[entry][:, None] + np.arange(n, n + len(some))] == some
            run = np.where(same.all(1), len(some), same.argmin(1))
            best = int(run.max())
            entry, n = entry[run == best], n + best
            if best < len(some):
                break
        return n, int(entry[0])


def factors(own: np.ndarray, h: np.ndarray, doc: int, low: np.ndarray, high: np.ndarray, at: np.ndarray, reference: Reference) -> list[tuple[int, int, int]]:
    """The factors (first word, words, entry of the reference) of WINDOW words or more of a document; all other words are literals.

    own: hashes of its words; h, at, low, high: hashes, first words and chains of those of its windows that the reference has in a document before doc.
    """
    out, k, n = [], 0, len(at)
    while k < n:
        i = int(at[k])
        size, entry = reference.longest(own[i:], int(low[k]), int(high[k]), doc)
        out.append((i, size, entry))
        k = int(np.searchsorted(at, i + size))
    return out


def _covered(p: _Parse, docs: np.ndarray, shared: np.ndarray, reference: Reference) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window: lies in a factor, or over a factor's end and in the reference; has to be compared by its hash; its document."""
    words = p.words
    row = words.row_of()[p.win] if len(p.win) else p.win
    doc = docs[row] if len(p.win) else np.zeros(0, np.int64)
    inside = np.zeros(len(p.win), bool)
    held = np.zeros(len(p.at), bool)
    held[p.anchors] = _lookup(shared, p.gram[p.anchors]) >= 0
    asks = held[p.held] if len(p.win) else inside
    some = np.flatnonzero(asks)
    low, high = reference.chains(p.win_hash[some], doc[some])
    use = low < high
    some, low, high = some[use], low[use], high[use]
    known = np.zeros(len(words) + 1, bool)
    known[p.win[some]] = True
    cuts = np.append(np.flatnonzero(np.diff(row[some], prepend=-1)), len(some)).tolist()
    spans = []
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        r = row[some[a]]
        first, last = words.first[r], words.first[r + 1]
        found = factors(words.hash[first:last], p.win_hash[some[a:z]], int(docs[r]), low[a:z], high[a:z], p.win[some[a:z]] - first, reference)
        spans += [(first + i, n) for i, n, _ in found]
    if spans:
        begin, size = np.array(spans, np.int64).T
        flag = np.zeros(len(words) + 1, bool)
        flag[ragged(begin, size - WINDOW + 1)] = True
        over = ragged(begin + size - WINDOW + 1, np.full(len(begin), WINDOW - 1))  # windows that start in a factor and end behind it
        over = over[over < len(words)]
        flag[over[known[over]]] = True
        inside = flag[p.win]
    return inside, asks & ~inside, doc


def _shared(replies: pa.Table) -> np.ndarray:
    return np.sort(_columns(_bodies(replies, SHARED), [U64])[0])


def _post_windows(n_buckets: int):
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows or not replies.num_rows:
            return B.mail([])
        shared, reference = _shared(replies), Reference(_bodies(replies, TEXTS))
        h, doc = [], []
        for _, _, _, docs, words in _rows(table):
            p = _Parse(words)
            _, ask, own = _covered(p, docs, shared, reference)
            h.append(p.win_hash[ask])
            doc.append(own[ask])
        h, doc, _, many = _first_in_block(np.concatenate(h), np.concatenate(doc), [])
        return B.post(h, [doc, many], table["block"][0].as_py(), n_buckets)

    return run


def _removed(table: pa.Table, replies: pa.Table):
    """(run's rows, bytes, words, which words are removed)."""
    shared, reference = _shared(replies), Reference(_bodies(replies, TEXTS))
    h, first = _columns(_bodies(replies, FIRSTS), [U64, np.int64])
    order = np.argsort(h)
    h, first = h[order], first[order]
    for i, j, data, docs, words in _rows(table):
        p = _Parse(words)
        cut, ask, doc = _covered(p, docs, shared, reference)
        asked = np.flatnonzero(ask)
        found = _lookup(h, p.win_hash[asked])
        hit = found >= 0
        hit[hit] = first[found[hit]] < doc[asked[hit]]
        cut[asked[hit]] = True
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, p.win[cut], 1)
        np.add.at(edge, p.win[cut] + WINDOW, -1)
        yield i, j, data, words, np.cumsum(edge[:-1]) > 0


_DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _digest(table: pa.Table, replies: pa.Table) -> pa.Table:
    n_words, n_removed, sums = [], [], []
    for i, j, data, words, gone in _removed(table, replies):
        raw = data.tobytes()
        lost = row_sums(gone.astype(np.int64), words.first)
        for r in range(j - i):
            a, b = words.first[r], words.first[r + 1]
            if lost[r]:
                keep = np.flatnonzero(~gone[a:b]) + a
                text = b" ".join([raw[s:e] for s, e in zip(words.start[keep].tolist(), words.end[keep].tolist(), strict=True)])
            else:
                text = b" ".join(raw[words.start[a] : words.end[b - 1]].split()) if b > a else b""
            sums.append(hashlib.sha256(text).hexdigest())
        n_words.append(words.counts)
        n_removed.append(lost)
    docs = table["doc_id"].to_numpy()
    if not len(docs):
        return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_sha256": pa.array([], pa.string())})
    return pa.table({"doc_id": pa.array(docs, pa.int64(), mask=docs == B.NO_ID), "n_words": np.concatenate(n_words).astype(np.int64), "n_removed": np.concatenate(n_removed).astype(np.int64), "kept_sha256": pa.array(sums, pa.string())})


def _stripped(columns: list[str], text: str):
    """All rows and columns; of texts that change, the words that stay, each with the white space after it."""

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        out = table.select(columns)
        at, texts = [], []
        for i, _, data, words, gone in _removed(table, replies):
            raw = data.tobytes()
            changed = np.unique(words.row_of()[gone]) if len(gone) else []
            bounds = np.append(words.start, len(raw))
            for r in changed:
                a, b = words.first[r], words.first[r + 1]
                keep = np.flatnonzero(~gone[a:b]) + a
                end = np.where(keep == b - 1, words.end[keep], bounds[keep + 1])
                at.append(i + int(r))
                texts.append(b"".join([raw[s:e] for s, e in zip(words.start[keep].tolist(), end.tolist(), strict=True)]).decode("utf-8", "replace").rstrip("\t\n\v\f\r "))
        if not at:
            return out
        mask = np.zeros(len(out), bool)
        mask[at] = True
        new = pc.replace_with_mask(table["text"].combine_chunks(), pa.array(mask), pa.array(texts, table["text"].type))
        return out.set_column(columns.index(text), text, new)

    return run


def _plan(docs: DataFrame, rows_per_block: int, last, schema, extra: tuple = ()) -> DataFrame:
    ship(docs.sparkSession)
    base, n = B.in_blocks(docs, rows_per_block, extra=extra)
    n_buckets = B.buckets_for(n)
    by_block = base.groupBy("block")
    anchors = B.owners(by_block.applyInArrow(_post_anchors(n_buckets), B.MAIL), _anchor_owner)
    texts = by_block.cogroup(anchors.where(F.col("kind") == WANTED).groupBy("block")).applyInArrow(_send_reference, B.MAIL)
    known = anchors.where(F.col("kind") == SHARED).unionByName(texts)
    asked = by_block.cogroup(known.groupBy("block")).applyInArrow(_post_windows(n_buckets), B.MAIL)
    replies = known.unionByName(B.owners(asked, _window_owner))
    return by_block.cogroup(replies.groupBy("block")).applyInArrow(last, schema)


def duplicate_words(docs: DataFrame, rows_per_block: int = 1024) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (of the words that stay, joined by one space)."""
    return _plan(docs, rows_per_block, _digest, _DIGEST)


def strip_duplicates(docs: DataFrame, rows_per_block: int = 1024) -> DataFrame:
    """docs, without the words of duplicate spans in `text`. Other texts, and all other columns, stay as they are; they travel with the texts."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    extra = tuple((F.col(f"`{c}`").cast("string") if c == "text" else F.col(f"`{c}`")).alias(n) for n, c in zip(names, docs.columns, strict=True) if c != "text")
    schema = T.StructType([T.StructField("text" if i == at else n, T.StringType() if i == at else f.dataType) for i, (n, f) in enumerate(zip(names, docs.schema.fields, strict=True))])
    columns = [f.name for f in schema.fields]
    out = _plan(docs, rows_per_block, _stripped(columns, "text"), schema, extra)
    return out.select(*[F.col(n).alias(c) for n, c in zip(columns, docs.columns, strict=True)])
