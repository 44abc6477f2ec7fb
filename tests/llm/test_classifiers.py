import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from corpus_cases import WORD
from pyspark.sql import functions as F

from lumenpath.llm import langid, lmscore, mixing, quality, rules, subwords
from lumenpath.llm.samples import labelled_texts


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.fit(docs, ~held)
    found = langid.identify(docs.where(held), model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (found.lang_pred == found.lang).mean() > 0.97
    sure = found[found.accepted]
    assert len(sure) > 0.9 * len(found) and (sure.lang_pred == sure.lang).mean() > 0.99
    assert found.score.between(0, 1).all()


def test_language_cases(spark, docs, sample, no_docs):
    model = langid.fit(docs, F.lit(True))
    got = langid.identify(docs, model).collect()
    assert len(got) == len(sample)
    unknown = {r.doc_id for r in got if r.lang_pred == "und"}
    assert {1200, 1201, 1202} <= unknown and 1203 not in unknown
    assert langid.fit(no_docs, F.lit(True)) is None
    assert langid.identify(no_docs, None).collect() == []
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}


def test_statistics_equal_a_plain_count():
    texts = ["Ab cd!\nab CD!\n\nx", "", None, "  ", "a a a a a", "#$% 12\n#$% 12", "é" * 5]
    got = quality.statistics(pa.array(texts))
    for x, row in zip(texts, got, strict=True):
        w = [t.lower() for t in WORD.findall(x or "")]
        named = dict(zip(quality.STATISTICS, row, strict=True))
        lines = [tuple(WORD.findall(line.lower())) for line in (x or "").split("\n") if WORD.search(line)]
        assert math.isclose(named["log_words"], math.log1p(len(w))) and math.isclose(named["log_lines"], math.log1p(len(lines)))
        assert math.isclose(named["distinct_words"], len(set(w)) / max(1, len(w)))
        assert math.isclose(named["distinct_lines"], len(set(lines)) / max(1, len(lines)))
        assert math.isclose(named["symbol"], sum(c in "#*$%&|<>" for c in x or "") / max(1, len((x or "").encode())))


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    forest = quality.fit(docs, labels.where(~held))
    found = quality.scores(docs, forest).join(labels.where(held), "doc_id").toPandas()
    assert ((found.score >= 0.3) == (found.quality == 1)).mean() > 0.95
    kept = quality.keep_good(docs.withColumn("score", F.lit("clash")), forest)
    assert kept.columns == [*docs.columns, "score"]
    assert kept.count() == quality.scores(docs, forest).where("score >= 0.3").count()


def test_quality_cases(spark, docs, sample, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    forest = quality.fit(docs, labels)
    assert {round(r.score, 3) for r in quality.scores(docs, forest).collect()} == {1.0}
    assert quality.scores(no_docs, forest).collect() == [] and quality.keep_good(no_docs, forest).collect() == []
    assert quality.keep_good(docs, forest).count() == len(sample)


def test_forest_walk_equals_a_plain_walk():
    rng = np.random.default_rng(0)
    x = rng.random((500, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.3)).astype(float)
    forest = quality.grow(x, y, 20, 3)
    for row in x[:50]:
        total = forest.base
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + (row[f[k]] > t[k])
            total += leaf[k - len(f)]
        assert math.isclose(forest.score(row[None])[0], 1 / (1 + math.exp(-total)))
    assert ((forest.score(x) > 0.5) == (y > 0)).mean() > 0.97


def base_statistics(text):
    w = WORD.findall(text or "")
    triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + j for i, t in enumerate(triples) if triples.count(t) > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rules(spark, docs, sample, no_docs):
    short = docs.where(F.length(F.coalesce("text", F.lit(""))) < 5000)
    texts = {(r.doc_id, r.text) for r in short.collect()}
    known = rules.with_statistics(short.select("doc_id", F.col("text").alias("raw"), F.coalesce("text", F.lit("")).alias("text"))).collect()
    for r in known:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_statistics(r.raw), r.raw
    assert len(texts) <= len(known)
    assert rules.judge(no_docs, []).collect() == []
    assert rules.fit(docs, spark.createDataFrame([], "doc_id long, quality int")) == []
    judged = rules.judge(docs, []).collect()
    assert len(judged) == len(sample) and all(r.kept == (not r.base_failed) for r in judged)
    plan = rules.judge(docs, [rules.Rule((("n_words", True, 3.0),))])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rules_are_learned():
    import random

    rng = random.Random(1)
    rows = [{"a": rng.random(), "b": rng.random()} for _ in range(900)]
    bad = [r["a"] > 0.8 or (r["b"] < 0.2 and r["a"] < 0.3) for r in rows]
    found = rules.learn(rows, bad)
    hit = [any(all((r[n] >= v) if up else (r[n] <= v) for n, up, v in rule.tests) for rule in found) for r in rows]
    assert sum(h == b for h, b in zip(hit, bad, strict=True)) > 0.95 * len(rows)


def test_mixing_meets_targets(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = docs.select("doc_id", F.col("lang").alias("domain"))
    weights = {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}
    rated = mixing.fit_rates(docs, labels, weights).collect()
    total = sum(r.tokens for r in rated)
    names = sorted(weights)
    for k, name in enumerate(names):
        got = sum(r.rate * r.tokens * r.posterior[k] for r in rated) / total
        assert abs(got - weights[name]) < 5e-3, (name, got)
    assert min(r.rate for r in rated) >= 0
    same = mixing.fit_rates(docs, labels, weights, budget=None, least=1.0)
    out = mixing.sample(docs.withColumn("rate", F.lit("clash")), same)
    assert out.columns == [*docs.columns, "rate"] and out.select("doc_id").distinct().count() == docs.count()
    assert out.count() >= docs.count()


@pytest.mark.parametrize("weights, how", [({"a": 0.1, "b": 0.88, "rare": 0.02}, {"budget": None, "least": 1.0}), ({"a": 0.6, "b": 0.38, "rare": 0.02}, {})])
def test_mixing_of_skewed_shares(spark, weights, how):
    rng = random.Random(4)  # a has 0.85 of all tokens, rare 0.001
    rows = [(i, " ".join(f"{x}{rng.choice('klmnop')}{x}" for _ in range(n)), x) for i, (x, n) in enumerate([("a", 120)] * 340 + [("b", 120)] * 60 + [("rare", 12)] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    rated = mixing.fit_rates(docs.drop("domain"), docs.select("doc_id", "domain"), weights, **how).collect()
    got = [sum(r.rate * r.tokens * r.posterior[k] for r in rated) for k in range(3)]
    for name, x in zip(sorted(weights), got, strict=True):
        assert abs(x / sum(got) - weights[name]) < 0.05 * weights[name], (name, x / sum(got))


def test_mixing_tells_what_it_misses(spark):
    rows = [(i, f"word{i % 7} more text", "a" if i % 2 else "b") for i in range(40)]  # the texts do not tell the domains apart
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    with pytest.warns(UserWarning) as told:
        mixing.fit_rates(docs.drop("domain"), docs.select("doc_id", "domain"), {"a": 0.98, "b": 0.01, "c": 0.01})
    assert any("labelled document of c" in str(w.message) for w in told) and any("miss their targets" in str(w.message) for w in told)


def test_mixing_cases(spark, docs, sample, no_docs):
    labels = docs.where("lang IS NOT NULL").select("doc_id", F.col("lang").alias("domain"))
    rated = mixing.fit_rates(docs, labels, {"en": 1.0, "fr": 1.0})
    assert rated.count() == len(sample)
    assert sorted(r.tokens for r in rated.collect()) == sorted(len(WORD.findall(r[1] or "")) for r in sample)
    none = mixing.fit_rates(docs, labels.where("doc_id < -5"), {"en": 1.0})
    assert {r.rate for r in none.collect()} == {1.0}
    assert mixing.fit_rates(no_docs, labels, {"en": 1.0}).collect() == []


def plain_losses(rows, targets):
    """Each document by models of all other documents, the background scaled to the target's size."""
    texts = [(d, WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))) for d, t in rows]
    count = Counter(x for _, w in texts for x in w)
    texts = [(d, [x if count[x] >= lmscore.COMMON else None for x in w]) for d, w in texts]
    vocabulary = sum(1 for c in count.values() if c >= lmscore.COMMON)
    every = [(Counter(w), Counter(zip(w[:-1], w[1:], strict=True))) for _, w in texts]
    sums = [[sum((own[k] for (d, _), own in zip(texts, every, strict=True) if use(d)), Counter()) for k in (0, 1)] for use in (lambda d: d in targets, lambda d: True)]
    out = [[], []]
    for (d, w), own in zip(texts, every, strict=True):
        total = sums[0][0].total() - len(w) * (d in targets)
        for k, (one, two) in enumerate(sums):
            mine = k == 1 or d in targets
            s = total / max(1, one.total() - len(w)) if k else 1.0
            c = lambda x, one=one, own=own, mine=mine, s=s: s * (one[x] - own[0][x] * mine)
            loss = 0.0
            for i, x in enumerate(w):
                p = (c(x) + 1) / (total + vocabulary + 1)
                if i:
                    pair = (w[i - 1], x)
                    p = (s * (two[pair] - own[1][pair] * mine) + lmscore.M * p) / (c(w[i - 1]) + lmscore.M)
                loss -= math.log(p)
            out[k].append(loss / max(1, len(w)))
    return out


def test_lm_scores_equal_plain_models(spark, sample, no_docs):
    rows = [(i, r[1]) for i, r in enumerate(sample)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("x")).repartition(3)
    targets = {i for i in range(0, len(rows), 3)}
    table = spark.createDataFrame([(i,) for i in targets] + [(None,), (0,), (10**9,)], "doc_id long")
    got = {r.doc_id: r for r in lmscore.score(docs, table, 40).collect()}
    target, background = plain_losses(rows, targets)
    assert len(got) == len(rows)
    for i in range(len(rows)):
        assert math.isclose(got[i].target_loss, target[i], rel_tol=1e-9, abs_tol=1e-12)
        assert math.isclose(got[i].background_loss, background[i], rel_tol=1e-9, abs_tol=1e-12)
        assert math.isclose(got[i].score, background[i] - target[i], abs_tol=1e-9)
    assert lmscore.score(no_docs, table).collect() == []
    assert lmscore.score(docs, table.where("doc_id < 0")).count() == len(rows)
    blank = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert [(r.n_words, r.score) for r in lmscore.score(blank, table).collect()] == [(0, 0.0)] * 2




def test_samples_keep_their_bound(spark):
    docs = spark.createDataFrame([(k % 3, f"text {k}") for k in range(600)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(k % 3, k) for k in range(30)] + [(None, 1), (9, 1)], "doc_id long, y int")
    for bound in (1, 2, 50):
        got = labelled_texts(docs, labels, bound).collect()
        assert len(got) <= min(bound, 3) and all(r.y == int(r.text.split()[1]) % 3 for r in got)
    assert len(labelled_texts(docs, labels, 50).collect()) == 3
    assert sorted(map(tuple, labelled_texts(docs, labels, 2).collect())) == sorted(map(tuple, labelled_texts(docs.repartition(7), labels.repartition(5), 2).collect()))


def plain_subwords(text):
    """Counts of buckets by a loop over all positions."""
    data = bytearray(text.encode())
    for i, b in enumerate(data):
        if i and data[i - 1] == 0xC3 and 0x80 <= b <= 0x9E:
            data[i] += 32
    code = [32 if b in b" \t\n\v\f\r" else b + 32 if 65 <= b <= 90 else b for b in data]
    out = {}
    for size in subwords.SIZES:
        for i in range(len(code) - size + 1):
            h = code[i]
            for c in code[i + 1 : i + size]:
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ c
            h = (h + size) * 0x9E3779B1 & 0xFFFFFFFF
            out[h >> 32 - subwords.BITS] = out.get(h >> 32 - subwords.BITS, 0) + 1
    return out


def plain_posterior(model, text):
    counts = plain_subwords(text)
    total = max(1, sum(counts.values()))
    x = [(sum(n * float(model.value[b, k]) for b, n in counts.items()) / total + float(model.bias[k])) / model.temperature for k in range(len(model.labels))]
    top = max(x)
    return [math.exp(v - top) / sum(math.exp(w - top) for w in x) for v in x]


def test_language_scores_equal_a_plain_loop(spark, docs, sample, monkeypatch):
    model = langid.fit(docs, F.lit(True))
    texts = {r[0]: r[1] for r in sample if r[0] is not None and r[0] >= 1200} | {r[0]: r[1] for r in sample[:12]}
    want = {k: plain_posterior(model, t) for k, t in texts.items() if t and any(c.isalpha() for c in t)}
    got = {r.doc_id: r for r in langid.identify(docs.where(F.col("doc_id").isin(list(want))), model).collect() if r.doc_id}
    for k in got:
        assert math.isclose(got[k].score, max(want[k]), rel_tol=1e-4) and got[k].lang_pred == model.labels[want[k].index(max(want[k]))]
    text = " ".join(r[1] or "" for r in sample)[:30_000] + "É"
    counted = subwords._counts(text.encode())
    monkeypatch.setattr(subwords, "RUN_BYTES", 1000)
    assert subwords._counts(text.encode()) == counted
    plain = plain_subwords(text)
    total = sum(plain.values())
    assert {int(b): round(float(n) * total) for b, n in zip(*subwords._uncounted(counted), strict=True)} == plain
    assert np.allclose(model.posteriors(pa.array([text])), [plain_posterior(model, text)], rtol=1e-4)


def plain_rates(tokens, posteriors, wished, total):
    """Projected gradient on one table, with many small steps: the same objective as the operator's."""
    share = tokens @ posteriors / total
    scale = 1 / np.maximum(share, mixing.LEAST_SHARE)
    moments = (posteriors * tokens[:, None]).T @ posteriors / total
    step = 0.5 / (np.linalg.eigvalsh(moments * np.sqrt(np.outer(scale, scale))).max() + mixing.PULL)
    rate = np.ones(len(tokens))
    for _ in range(20_000):
        residual = ((rate * tokens) @ posteriors / total - wished) * scale
        rate = np.maximum(0, rate - step * (posteriors @ residual + mixing.PULL * (rate - 1)))
    return rate


def test_mixing_equals_plain_least_squares(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    weights = {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}
    rows = mixing.fit_rates(docs, docs.select("doc_id", F.col("lang").alias("domain")), weights).collect()
    tokens, posteriors = np.array([r.tokens for r in rows], float), np.array([r.posterior for r in rows])
    wished = np.array([weights[k] for k in sorted(weights)])
    rate = plain_rates(tokens, posteriors, wished, tokens.sum())
    got = np.array([r.rate for r in rows])
    mine, plain = ((x * tokens) @ posteriors / tokens.sum() for x in (got, rate))
    assert np.abs(mine - plain).max() < 1e-3 and np.abs(got - rate).max() < 0.05


def test_a_very_long_text(spark):
    """Three megabytes in one row, beside a short one."""
    docs = spark.createDataFrame([(1, "Ein langer Text und noch viel mehr davon. " * 75_000, "de"), (2, "a short one", "en"), (3, "another one", "en")], "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    assert {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}[1] == "de"
    rated = mixing.fit_rates(docs, docs.select("doc_id", F.col("lang").alias("domain")), {"de": 0.5, "en": 0.5}).collect()
    assert {r.doc_id: r.tokens for r in rated} == {1: 600_000, 2: 3, 3: 2}
    forest = quality.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    assert quality.scores(docs, forest).count() == 3
    assert {r.doc_id: r.n_words for r in rules.judge(docs, []).collect()}[1] == 600_000


def plain_statistics(text):
    text = text or ""
    data, w = text.encode(), [x.encode() for x in WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))]
    lines = [tuple(WORD.findall(x.lower())) for x in text.split("\n") if WORD.search(x)]
    per = lambda n, d: n / max(1, d)
    runs = lambda k: len({tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
    share = lambda chars: per(sum(b in chars for b in data), len(data))
    return {
        "log_bytes": math.log1p(len(data)), "log_words": math.log1p(len(w)), "log_lines": math.log1p(len(lines)), "word_bytes": per(sum(map(len, w)), len(w)),
        "long_words": per(sum(len(x) > 12 for x in w), len(w)), "longest_word": max(map(len, w), default=0), "one_byte_words": per(sum(len(x) == 1 for x in w), len(w)),
        "distinct_words": per(len(set(w)), len(w)), "distinct_pairs": per(runs(2), len(w) - 1), "distinct_triples": per(runs(3), len(w) - 2), "distinct_lines": per(len(set(lines)), len(lines)),
        "words_a_line": per(len(w), len(lines)), "upper": share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "lower": share(b"abcdefghijklmnopqrstuvwxyz"), "digit": share(b"0123456789"), "symbol": share(b"#*$%&|<>"),
        "mark": share(b"!?"), "stop": share(b".,;:"), "other": share(b"\"'()[]{}@/\\^_`~+=-"), "line": share(b"\n"), "high": share(bytes(range(0xC0, 0x100))),
    }


def test_all_statistics_equal_plain_ones(sample, monkeypatch):
    texts = [r[1] for r in sample if len(r[1] or "") < 20_000] + ["Ab cd!\nab CD!\n\nx", "a a a a a", "#$% 12\n#$% 12", "\u00e9" * 5, "~^ [x]{y} 'q' \"z\""]
    for run_bytes in (quality.runs.__defaults__[0], 2_000):
        monkeypatch.setattr(quality.runs, "__defaults__", (run_bytes,))
        for text, row in zip(texts, quality.statistics(pa.array(texts)), strict=True):
            plain = plain_statistics(text)
            assert list(plain) == quality.STATISTICS
            assert np.allclose(row, list(plain.values()), rtol=1e-12), (text, plain)


def test_verdicts_equal_plain_rules(spark, docs, sample):
    """kept, by learned rules, against the rules' own texts evaluated on plainly counted statistics."""
    short = docs.where(F.length(F.coalesce("text", F.lit(""))) < 5000)
    labels = spark.createDataFrame([(r[0], int(len(r[1] or "") % 3 > 0)) for r in sample if r[0] is not None and r[0] % 2], "doc_id long, quality int")
    learned = rules.fit(short, labels)
    made = [rules.Rule((("symbols_per_word", True, 0.05), ("n_words", False, 200.0))), rules.Rule((("chars_per_word", True, 6.0),)), rules.Rule((("repeat_word_share", True, 0.2),))]
    for chosen in (learned, made):
        judged = rules.judge(short.withColumn("kept", F.lit("clash")), chosen).collect()
        want = Counter()
        for r in short.collect():
            n, chars, symbols, repeated_lines, repeats = base_statistics(r.text)
            lines = sum(1 for x in (r.text or "").split("\n") if WORD.search(x))
            capitals = sum("A" <= c <= "Z" for c in r.text or "")
            x = {"n_words": n, "symbols_per_word": symbols / max(1, n), "capitals_per_char": capitals / max(1, chars), "chars_per_word": chars / max(1, n), "dup_line_share": repeated_lines / max(1, lines), "repeat_word_share": repeats / max(1, n), "words_per_line": n / max(1, lines)}
            failed = n < 50 or 100 * repeats > 50 * n
            hit = any(all(x[name] >= v if up else x[name] <= v for name, up, v in rule.tests) for rule in chosen)
            want[r.doc_id, n, repeats, failed, not failed and not hit] += 1
        assert Counter((r.doc_id, r.n_words, r.n_repeat_words, r.base_failed, r.kept) for r in judged) == want
        if chosen is made:
            assert {r.kept for r in judged if not r.base_failed} == {True, False}
