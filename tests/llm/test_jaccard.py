import re
from collections import Counter

import numpy as np
from corpus_cases import WORD

from lumenpath.llm import jaccard as J


def shingles(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, percent, k):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    big = 1 << 62
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), big), big if d is None else d)
    return Counter((d, len(sets[i]), None if least[find(i)] == big else least[find(i)]) for i, (d, _) in enumerate(rows))


def test_equals_brute_force(docs, sample):
    rows = [(r[0], r[1]) for r in sample]
    for percent, k in ((85, 4), (80, 5), (60, 4)):
        got = Counter(tuple(r) for r in J.jaccard_components(docs, percent, k).select("doc_id", "n_shingles", "component_id").collect())
        assert got == brute(rows, percent, k), (percent, k)


def test_shards_lose_no_link(docs, sample, monkeypatch):
    monkeypatch.setattr(J, "SHARD_SHINGLES", 400)
    monkeypatch.setattr(J, "TABLE_BYTES", 2_000)
    got = Counter(tuple(r) for r in J.jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute([(r[0], r[1]) for r in sample], 85, 4)


def test_tree_finds_all_links():
    rng = np.random.default_rng(1)
    for _ in range(30):
        base = rng.choice(200, 40, replace=False)
        sets = [np.unique(np.concatenate([base[rng.random(40) < 0.93], rng.choice(200, 2)])).astype(np.uint64) for _ in range(12)]
        union = J._Union()
        J._tree_join(sets, list(range(12)), list(range(12)), list(range(12)), 80, union)
        want = J._Union()
        for a in range(12):
            for b in range(12):
                n = len(np.intersect1d(sets[a], sets[b]))
                if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                    want.join(a, b)
        assert [union.find(i) for i in range(12)] == [want.find(i) for i in range(12)]


def test_keep_one(docs, sample):
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    want = brute([(r[0], r[1]) for r in sample], 85, 4)
    groups = {c for _, n, c in want if n}
    with_words = [r for r in rows if WORD.search(r.text or "")]
    assert Counter(r.doc_id for r in with_words) == Counter(groups)
    assert sum(1 for r in rows if not WORD.search(r.text or "")) == sum(1 for r in sample if not WORD.search(r[1] or ""))


def test_keep_one_keeps_texts_of_white_space(spark):
    rows = [(None, "\n\t"), (None, "\n\t"), (1, "\x0b\x0c\r "), (1, "\x0b\x0c\r "), (2, "a word"), (2, "a word")]
    kept = J.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter(rows[:5])


def test_empty_table(no_docs):
    assert J.jaccard_components(no_docs).collect() == []
    assert J.keep_one(no_docs).collect() == []
