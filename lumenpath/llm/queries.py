"""The registered query of each corpus operator, with production parameters, over its whole table.

The operators keep general interfaces in their own modules; a query derives the columns of its contract.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenpath.llm.samples import crc_mod
from lumenpath.llm.sparkutil import read


#: The mixture that op1 and the pipeline aim at: text by language, and little junk.
MIXTURE = {"en": 0.52, "de": 0.18, "fr": 0.17, "es": 0.11, "junk": 0.02}


def domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A labelled table (doc_id, domain): junk where labels say so, else the language."""
    lang = docs.where("lang IS NOT NULL").select(F.col("doc_id").alias("_of"), "lang")
    kind = F.when(F.col("quality") == 0, "junk").otherwise(F.col("lang"))
    return labels.join(lang, labels["doc_id"] == lang["_of"]).select("doc_id", kind.alias("domain"))


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenpath.llm.mixing import fit_rates

    docs = read(spark, sf_dir, "documents")
    return fit_rates(docs, domains(docs, read(spark, sf_dir, "labels")), MIXTURE).drop("mark")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenpath.llm.langid import fit, identify

    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(True))
    found = identify(docs, fit(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenpath.llm.lmscore import score

    labels = read(spark, sf_dir, "labels")
    found = score(read(spark, sf_dir, "documents"), labels.where("quality = 1 AND toxic = 0"))
    return found.select("doc_id", "n_words", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")])


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenpath.llm.chat import digests, examples

    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    types = dict(turns.dtypes)
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    values = {"conv_id": F.lit(-1), "turn": F.col("id"), "role": role, "text": F.lit("</s>[INST] ok [/INST]")}
    more = spark.range(2).select(*[v.cast(types[c]).alias(c) for c, v in values.items()])
    return digests(examples(turns.unionByName(more)))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenpath.llm.topk import top_k

    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenpath.llm.jaccard import jaccard_components

    return jaccard_components(read(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenpath.llm.substring import duplicate_words

    return duplicate_words(read(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenpath.llm.quality import fit, scores

    docs, held_out = read(spark, sf_dir, "documents"), F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(True))
    forest = fit(docs, read(spark, sf_dir, "labels").where(~held_out))
    return scores(docs, forest).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lumenpath.llm.packing import pack

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), every=100)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenpath.llm.rules import fit, judge

    docs = read(spark, sf_dir, "documents")
    return judge(docs, fit(docs, read(spark, sf_dir, "labels")))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op10, which SQL can express; the learned verdict it can't."""
    from lumenpath.llm.rules import judge

    return judge(read(spark, sf_dir, "documents"), []).drop("kept")


TOP_K = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

REPEATS = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 11, 1))) AS i FROM w)),
earliest AS (SELECT g, min(doc_id) AS f FROM win GROUP BY g),
hit AS (SELECT doc_id, list(DISTINCT j) AS js FROM (SELECT doc_id, unnest(range(i, i + 13)) AS j FROM win JOIN earliest USING (g) WHERE f < doc_id) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
    sha256(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(coalesce(js, []), i)), ' ')) AS kept_sha256
FROM w LEFT JOIN hit USING (doc_id)
"""

LINKED = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
    SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 3], ' ') END AS g
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pair JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
reach AS (SELECT x AS a, y AS b FROM link UNION SELECT a, y FROM reach JOIN link ON b = x),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least ON a = w.doc_id
"""

BASE = f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {WORDS} AS ws FROM documents),
g AS (SELECT r, unnest(range(1, greatest(len(ws) - 1, 1))) AS i, ws FROM w),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
p AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM h WHERE n > 1) GROUP BY r),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) > 0) AS ls FROM w),
o AS (
    SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words FROM w JOIN l USING (r) LEFT JOIN p USING (r)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM o
"""

LOSSES = rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT r, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0 AND doc_id IS NOT NULL), false)::INTEGER AS g, unnest(ws) AS x, unnest(range(len(ws))) AS i FROM w),
c AS (SELECT x, count(*) AS n FROM t GROUP BY x),
k AS (SELECT r, g, i, CASE WHEN n >= 3 THEN x ELSE '' END AS x FROM t JOIN c USING (x)),
p AS (SELECT *, lag(x) OVER (PARTITION BY r ORDER BY i) AS v FROM k),
one AS (SELECT x, count(*) AS n, sum(g) AS t FROM p GROUP BY x),
two AS (SELECT v, x, count(*) AS n, sum(g) AS t FROM p WHERE v IS NOT NULL GROUP BY v, x),
own AS (SELECT r, x, count(*) AS n FROM p GROUP BY r, x),
pair AS (SELECT r, v, x, count(*) AS n FROM p WHERE v IS NOT NULL GROUP BY r, v, x),
d AS (SELECT r, count(*) AS n FROM p GROUP BY r),
z AS (SELECT count(*) AS n, sum(g) AS t, (SELECT count(*) FROM c WHERE n >= 3) AS words FROM p),
f AS (
    SELECT p.r, p.v, (z.t - g * d.n)::DOUBLE AS size, (z.t - g * d.n)::DOUBLE / greatest(z.n - d.n, 1) AS s, z.words,
        a.n - m.n AS b1, a.t - g * m.n AS t1, e.n - o.n AS b0, e.t - g * o.n AS t0, two.n - pair.n AS b2, two.t - g * pair.n AS t2
    FROM p CROSS JOIN z JOIN d ON d.r = p.r JOIN one a ON a.x = p.x JOIN own m ON m.r = p.r AND m.x = p.x
    LEFT JOIN one e ON e.x = p.v LEFT JOIN own o ON o.r = p.r AND o.x = p.v
    LEFT JOIN two ON two.v = p.v AND two.x = p.x LEFT JOIN pair ON pair.r = p.r AND pair.v = p.v AND pair.x = p.x
), u AS (SELECT *, (s * b1 + 1) / (size + words + 1) AS pb, (t1 + 1) / (size + words + 1) AS pt FROM f),
l AS (
    SELECT r, count(*) AS n, -sum(ln(CASE WHEN v IS NULL THEN pt ELSE (t2 + 4 * pt) / (t0 + 4) END)) AS lt, -sum(ln(CASE WHEN v IS NULL THEN pb ELSE (s * b2 + 4 * pb) / (s * b0 + 4) END)) AS lb
    FROM u GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, round(coalesce(lt / n, 0), 6) AS target_loss, round(coalesce(lb / n, 0), 6) AS background_loss, round(coalesce((lb - lt) / n, 0), 6) AS score
FROM w LEFT JOIN l USING (r)
"""

_ESCAPED = r"length(replace(replace(replace(replace(replace({x}, '\', '\\'), '</s>', '<\/s>'), '<s>', '<\s>'), '[/INST]', '[\/INST]'), '[INST]', '[\INST]'))"
CHAT = f"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), o AS (
    SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
        sum({_ESCAPED.format(x="role")} + {_ESCAPED.format(x="text")} + 17) OVER w + 3 AS chars
    FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(chars) FILTER (role = 'assistant' OR i = n)::BIGINT AS formatted_chars
FROM o GROUP BY conv_id
"""


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()} | {"quality_base": quality_base}


def oracle_sql() -> dict[str, str]:
    return {"quality_base": BASE, "op3_lm_scoring": LOSSES, "op4_chat_format": CHAT, "op5_exact_topk": TOP_K, "op6_ngram_jaccard_join": LINKED, "op7_substring_dedup": REPEATS}
