import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from lumenpath.llm.chat import BEGIN, END, ROLE, TEXT, digests, escape, examples, unescape

TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi </s> \\ [INST]"), (1, 2, "assistant", "</s>[INST] ok [/INST]"), (1, 3, "user", ""), (1, 4, "assistant", "\\<s> \U0001f600é\n"),
    (2, 0, "user", None), (2, 1, "user", "no reply"), (3, 0, "assistant", "x"), (3, 1, None, "y"), (3, 2, "ass[INST]istant", "z"), (4, 1, "assistant", ""),
    (None, 0, "user", "q"), (None, 1, "assistant", "a"), (5, 0, "assistant", "same"), (5, 0, "assistant", "same"), (5, None, "user", "null turn first"),
]


def test_escape_is_reversible(spark):
    texts = ["", "\\", "<s>", "</s>", "<\\s>", "[INST][/INST]", "[[INST]", "</</s>s>", "\\\\</s>\\", "a\nb"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t
        assert not any(c in r.e for c in (BEGIN, ROLE, TEXT, END))


def test_every_turn_once_and_only_replies_trainable(spark):
    made = examples(spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("at", F.lit(1)))
    rows = made.collect()
    by = defaultdict(list)
    for conv, turn, role, text in TURNS:
        by[conv].append((-1 if turn is None else turn, role or "", text or ""))
    got = {r.conv_id: r for r in digests(made).collect()}
    assert set(got) == set(by)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for conv, turns in by.items():
        turns.sort()
        replies = "".join(t for _, r, t in turns if r == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256) == (len(turns), digest("".join(f"{r}\n{t}\n" for _, r, t in turns)))
        assert (g.loss_chars, g.loss_sha256) == (len(replies), digest(replies))
        own = [r for r in rows if r.conv_id == conv]
        assert g.formatted_chars == sum(len(r.text) for r in own)
        assert len(own) == sum(r == "assistant" for _, r, _ in turns) + (turns[-1][1] != "assistant")
        assert all(r.text.count(END) == r.target_turn + 1 for r in own)


def test_empty_table(spark):
    assert digests(examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []
