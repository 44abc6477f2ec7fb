import hashlib
from collections import defaultdict

from corpus_cases import WORD

from lumenpath.llm.substring import WINDOW, duplicate_words, strip_duplicates

BIG = 1 << 63


def brute(rows):
    first = {}
    for i, x in rows:
        w = WORD.findall(x or "")
        for k in range(len(w) - WINDOW + 1):
            key = tuple(w[k : k + WINDOW])
            first[key] = min(first.get(key, BIG), BIG - 1 if i is None else i)
    out = defaultdict(list)
    for i, x in rows:
        w = WORD.findall(x or "")
        gone = [False] * len(w)
        for k in range(len(w) - WINDOW + 1):
            if first[tuple(w[k : k + WINDOW])] < (BIG - 1 if i is None else i):
                gone[k : k + WINDOW] = [True] * WINDOW
        kept = " ".join(a for a, g in zip(w, gone, strict=True) if not g)
        out[i].append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


def test_equals_brute_force(docs, sample):
    want = brute([(r[0], r[1]) for r in sample])
    for per_block in (7, 1024):
        got = defaultdict(list)
        for r in duplicate_words(docs, per_block).collect():
            got[r.doc_id].append((r.n_words, r.n_removed, r.kept_sha256))
        assert {k: sorted(v) for k, v in got.items()} == want


def test_strip_keeps_columns_and_other_texts(docs, sample):
    got = strip_duplicates(docs, 50)
    assert got.columns == docs.columns
    want = brute([(r[0], r[1]) for r in sample])
    rows = got.collect()
    assert len(rows) == len(sample)
    originals = {(r[0], r[1]) for r in sample}
    for r in rows:
        n_words, n_removed, digest = want[r.doc_id][0]
        if len(want[r.doc_id]) == 1:
            assert hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest() == digest
            if not n_removed:
                assert (r.doc_id, r.text) in originals


def test_random_small_vocabulary(spark):
    import random

    rng = random.Random(3)
    for vocabulary in (1, 2, 3):
        rows = [(i, " ".join(rng.choice("abc"[:vocabulary]) for _ in range(rng.randrange(60)))) for i in range(40)]
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in duplicate_words(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()}
        assert {k: [v] for k, v in got.items()} == brute(rows)


def test_empty_table(no_docs):
    assert duplicate_words(no_docs).collect() == []
    assert strip_duplicates(no_docs).collect() == []


def test_factors_are_greedy_and_longest():
    """Factors and literals tile a document; each factor is the longest run that an earlier document of any reference block has there."""
    import random

    import numpy as np
    import pyarrow as pa

    from lumenpath.llm import blocks as B
    from lumenpath.llm.arrays import Words, text_column, windows
    from lumenpath.llm.substring import Reference, factors

    def hashes(text):
        data, offsets = text_column(pa.array([text]))
        return Words(data, offsets)

    rng = random.Random(8)
    longest_seen = 0
    for _ in range(30):
        base = [rng.choice("abcdefgh") * 3 for _ in range(400)]
        texts = [(doc, k % 3, " ".join(base[a : a + rng.randrange(5, 150)])) for k, doc in enumerate(rng.sample(range(100), 9)) for a in [rng.randrange(250)]]
        bodies = []
        for block in range(3):
            own = [(d, t) for d, b, t in texts if b == block]
            columns = [np.array(c, np.int64) for c in ([d for d, _ in own], [0] * len(own), [len(t) for _, t in own], [block] * len(own))]
            bodies.append(B.pack(columns) + "".join(t for _, t in own).encode())
        reference = Reference(bodies)
        doc, words = rng.randrange(20, 100), []
        while len(words) < 300:
            a = rng.randrange(380)
            words += base[a : a + rng.randrange(3, 90)]
        parsed = hashes(" ".join(words))
        at, h = windows(parsed, WINDOW)
        low, high = reference.chains(h, np.full(len(h), doc))
        use = low < high
        found = factors(parsed.hash, h[use], doc, low[use], high[use], at[use], reference)
        earlier = [t.split() for d, _, t in texts if d < doc]

        def longest(i, words=words, earlier=earlier):
            best = 0
            for other in earlier:
                for p in range(len(other)):
                    n = 0
                    while i + n < len(words) and p + n < len(other) and words[i + n] == other[p + n]:
                        n += 1
                    best = max(best, n)
            return best

        i, want = 0, []
        while i < len(words):
            n = longest(i)
            if n >= WINDOW:
                want.append((i, n))
                i += n
            else:
                i += 1
        assert [(i, n) for i, n, _ in found] == want
        for i, n, entry in found:
            text = next(t.split() for d, b, t in texts if d == reference.doc[entry] and b == reference.block[entry])
            place = int(reference.place[entry])
            assert reference.doc[entry] < doc and text[place : place + n] == words[i : i + n]
            longest_seen = max(longest_seen, n)
    assert longest_seen > 2 * Reference.STEP


def test_repeated_rows_nulls_and_clashing_columns(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, passage, "a"), (1, passage, "a"), (2, f"x {passage} y", None), (None, f"{passage} z", "n"), (None, None, None), (3, "", "e"), (3, " \t", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, c1 string").selectExpr("c1 as kind", "text", "doc_id", "c1 as block", "c1 as stripped", "array(doc_id, null) as bucket")
    got = strip_duplicates(docs, 2)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    assert sorted((str(r.doc_id), r.text or "", str(r.kind), str(r.bucket)) for r in got.collect()) == sorted(
        (str(d), {f"x {passage} y": "x y", f"{passage} z": "z"}.get(t, t) or "", str(c), str([d, None])) for d, t, c in rows
    )


def test_a_very_long_text(spark):
    """A megabyte in one row, half of it copied by another, across the steps in which runs are compared."""
    words = [f"w{i}" for i in range(150_000)]
    rows = [(1, " ".join(words)), (2, " ".join(["new", *words[:75_000], "end"])), (3, "short")]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in duplicate_words(spark.createDataFrame(rows, "doc_id long, text string"), 1).collect()}
    assert got == {1: (150_000, 0), 2: (75_002, 75_000), 3: (1, 0)}


def test_letters_of_few_entries(docs, sample, monkeypatch):
    """The exchange at sizes where hash ranges are so many that a letter holds an entry or two."""
    from lumenpath.llm import blocks

    monkeypatch.setattr(blocks, "buckets_for", lambda n: 20_000)
    want = brute([(r[0], r[1]) for r in sample[:60] + sample[-20:]])
    some = docs.sparkSession.createDataFrame(sample[:60] + sample[-20:], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    got = defaultdict(list)
    for r in duplicate_words(some, 9).collect():
        got[r.doc_id].append((r.n_words, r.n_removed, r.kept_sha256))
    assert {k: sorted(v) for k, v in got.items()} == want
