"""Quality rules: learned decision lists over text statistics, in DataFrame functions only.

Statistics are column expressions. Rules are learned by sequential covering on a bounded sample of labelled rows: a conjunction of thresholds is grown
by information gain on two thirds of the rows, pruned on the other third, and kept if it is precise enough there; the rows that it
covers are taken out, and the next one is grown. The list is emitted as one ordered conditional expression.

Null text: no words, all statistics 0. Very long texts: sorting only, no quadratic step. Repeated rows are judged each. Further columns
are ignored by `judge`. Without labelled rows of both classes there are no rules, and all rows are kept but those that fail the base.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenpath.llm.samples import labelled_texts

#: White space and symbols of the base statistics.
BLANKS = " \t\n\v\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

TRAIN_ROWS = 10_000
THRESHOLDS, CONDITIONS, RULES, PRECISION, LEAST = 32, 3, 12, 0.9, 8


def _next_to(column: str, step: int) -> Column:
    """column without its last (step 0) or first (step 1) element."""
    return F.slice(column, F.lit(1 + step), F.greatest(F.size(column) - 1, F.lit(0)))


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals. text must not be null.

    Each step is a projection whose columns are used more than once above it, so Catalyst computes them once.
    """
    keep = [F.col(f"`{c}`") for c in df.columns]
    solid = F.btrim(F.col(text), F.lit(BLANKS))
    words = F.when(F.length(solid) > 0, F.split(solid, BLANK_RUN)).otherwise(F.array().cast("array<string>"))
    lines = F.filter(F.split(F.col(text), "\n", -1), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    df = df.select(*keep, words.alias("_words"), lines.alias("_lines"))
    without = lambda chars: F.length(text) - F.length(F.translate(F.col(text), chars, ""))
    n = F.size("_words")
    part = lambda k: F.slice("_hashes", F.lit(k), F.greatest(F.size("_hashes") - 2, F.lit(0)))
    counts = {
        "n_words": n,
        "word_chars": F.length(F.array_join("_words", "")),
        "n_symbols": without(SYMBOLS),
        "n_capitals": without(CAPITALS),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
    }
    df = df.select(*keep, F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"), *[v.cast("long").alias(k) for k, v in counts.items()])
    keep += [F.col(k) for k in counts]
    df = df.select(*keep, F.zip_with(F.zip_with(part(1), part(2), lambda a, b: F.xxhash64(a, b)), part(3), lambda a, b: F.xxhash64(a, b)).alias("_triples"))
    df = df.select(*keep, "_triples", F.sort_array("_triples").alias("_sorted"))
    again = F.exists(F.zip_with(_next_to("_sorted", 0), _next_to("_sorted", 1), lambda a, b: a == b), lambda x: x)
    placed = F.sort_array(F.zip_with("_triples", F.sequence(F.lit(0), F.size("_triples") - 1), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.select(*keep, F.when(again, placed).alias("_placed"))
    df = df.select(*keep, "_placed", F.zip_with(_next_to("_placed", 0), _next_to("_placed", 1), lambda a, b: a["h"] == b["h"]).alias("_same"))
    edge = F.array(F.lit(False))
    found = F.zip_with(F.zip_with(F.concat(edge, "_same"), F.concat("_same", edge), lambda a, b: a | b), "_placed", lambda use, x: F.when(use, x["i"]))
    df = df.select(*keep, F.sort_array(F.array_compact(found)).alias("_at"))
    steps = F.zip_with(_next_to("_at", 0), _next_to("_at", 1), lambda a, b: F.least(b - a, F.lit(3)))
    covered = F.aggregate(steps, F.lit(3).cast("long"), lambda total, x: total + x)
    return df.select(*keep, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def features() -> dict[str, Column]:
    """What rules may test; each from the statistics alone."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "capitals_per_char": per("n_capitals", "word_chars"),
        "chars_per_word": per("word_chars", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_word_share": per("n_repeat_words", "n_words"),
        "words_per_line": per("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Rule:
    """All of (feature, at least or at most, threshold) hold: reject."""

    tests: tuple[tuple[str, bool, float], ...]

    def column(self, columns: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, least, value in self.tests:
            out = out & (columns[name] >= F.lit(value) if least else columns[name] <= F.lit(value))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>=' if up else '<='} {v:.6g}" for n, up, v in self.tests)


def _bits(flags) -> int:
    """Bit i is set where the i-th flag is."""
    return sum(1 << i for i, f in enumerate(flags) if f)


def _threshold_tests(rows: list[dict], bad: list[bool], name: str, left: int) -> list[tuple]:
    """((feature, at least, cut), rows that pass) at quantiles of the rows left, and of the bad ones among them; one walk in ascending order."""
    n = len(rows)
    order = sorted(range(n), key=lambda i: rows[i][name])
    still = [i for i in order if left >> i & 1]
    wrong = [i for i in still if bad[i]]
    cuts = sorted({rows[v[round(k * (len(v) - 1) / THRESHOLDS)]][name] for v in (still, wrong) if v for k in range(THRESHOLDS + 1)})
    out, below, at, every = [], 0, 0, (1 << n) - 1
    for cut in cuts:
        while at < n and rows[order[at]][name] < cut:
            below |= 1 << order[at]
            at += 1
        out.append(((name, True, cut), every & ~below))
        here = at
        while here < n and rows[order[here]][name] <= cut:
            below |= 1 << order[here]
            here += 1
        at = here
        out.append(((name, False, cut), below))
    return out


def learn(rows: list[dict], bad: list[bool]) -> list[Rule]:
    """Sequential covering of the bad rows. Sets of rows are bit masks, so a candidate test costs two popcounts."""
    n = len(rows)
    if not n or all(bad) or not any(bad):
        return []
    target, prune = _bits(bad), _bits(i % 3 == 0 for i in range(n))
    grow_rows = ((1 << n) - 1) & ~prune
    rules, left = [], (1 << n) - 1
    least = min(LEAST, max(2, target.bit_count() // 20))
    closed: set[str] = set()  # features that may not open a rule: none good enough came of them
    fresh = -1  # the rows for which tests were made
    while len(rules) < RULES:
        if fresh != left:
            tests, fresh = [t for name in rows[0] for t in _threshold_tests(rows, bad, name, left)], left
        found = _grown(tests, left, target, grow_rows, closed)
        if not found:
            break
        ways = [_pruned(found, left & prune, target), found]
        for way in ways:
            cover = _cover(way, left)
            p, q = (cover & target).bit_count(), (cover & ~target).bit_count()
            if p >= least and p >= PRECISION * (p + q):
                rules.append(Rule(tuple(t for t, _ in way)))
                left &= ~cover
                break
        else:
            closed.add(found[0][0][0])
    return rules


def _cover(tests: list, rows: int) -> int:
    for _, mask in tests:
        rows &= mask
    return rows


def _grown(tests: list, left: int, target: int, grow_rows: int, closed: set[str]) -> list:
    """A conjunction, by FOIL's information gain, until it covers no row that isn't a target."""
    chosen, cover = [], left & grow_rows
    while len(chosen) < CONDITIONS:
        p0, n0 = (cover & target).bit_count(), (cover & ~target).bit_count()
        if not p0 or not n0:
            break
        before, best, pick = math.log2(p0 / (p0 + n0)), 0.0, None
        for test, mask in tests:
            p, q = (cover & mask & target).bit_count(), (cover & mask & ~target).bit_count()
            gain = p * (math.log2(p / (p + q)) - before) if p else 0.0
            if gain > best and (chosen or test[0] not in closed):
                best, pick = gain, (test, mask)
        if pick is None:
            break
        chosen.append(pick)
        cover &= pick[1]
    return chosen


def _pruned(chosen: list, rows: int, target: int) -> list:
    """chosen without its last conditions, as long as that is better on the rows held for pruning."""

    def worth(some: list) -> float:
        cover = _cover(some, rows)
        p, q = (cover & target).bit_count(), (cover & ~target).bit_count()
        return (p - q) / (p + q) if p + q else -1.0

    while len(chosen) > 1 and worth(chosen[:-1]) > worth(chosen):
        chosen = chosen[:-1]
    return chosen


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> list[Rule]:
    """Rules for label = 0, from at most `rows` labelled rows; only those rows' statistics come to the driver."""
    own = labels.where(F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    columns = features()
    found = with_statistics(labelled_texts(docs, own, rows)).select("y", *[c.alias(k) for k, c in columns.items()]).collect()
    known = sorted(((r["y"] == 0, {k: r[k] for k in columns}) for r in found), key=lambda x: (x[0], *x[1].values()))
    known = [known[i] for i in sorted(range(len(known)), key=lambda i: (i * 2_654_435_761) % (1 << 32))]
    return learn([x for _, x in known], [y for y, _ in known])


def verdict(rules: list[Rule]) -> Column:
    """True unless a rule rejects; the rules in their order."""
    columns, out = features(), None
    for rule in rules:
        test = rule.column(columns)
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    known = with_statistics(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return known.select("doc_id", *stats, failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))
