"""The queries of the numbered operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierflow.llm import (
    bpe,
    fingerprints,
    langid,
    lm,
    lsh_forest,
    mixing,
    packing,
    prefix_trie,
    quality,
    sharding,
    spelling,
    suffix,
    token_store,
)
from tierflow.llm.tables import conversations, documents, tokenizer_path, tokenizer_pattern
from tierflow.runtime import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

SHARDS = 40


def query(name: str):
    def register(build):
        QUERIES[name] = build
        return build

    return register


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo the folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


@query("op1_raked_mixing")
def op1_raked_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked factors, probabilities and the sample, for every document."""
    return mixing.mixture(documents(spark, sf_dir)).select(
        F.col("row.doc_id").alias("doc_id"),
        "source",
        "lang",
        "topic",
        "n_tokens",
        F.round("factor", 6).alias("factor"),
        F.round("probability", 6).alias("probability"),
        "kept",
    )


@query("op2_lsh_forest_join")
def op2_lsh_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return lsh_forest.jaccard_join(documents(spark, sf_dir))


@query("op3_token_store")
def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back through the key index."""
    folder = f"{shared_folder(spark)}/tokens-{uuid4().hex}"
    token_store.write_store(
        documents(spark, sf_dir), folder, tokenizer_path("word_bpe_49k.json"), end=1, width=2
    )
    places = token_store.all_places(spark, folder)
    return token_store.read_documents(spark, folder, places, width=2, with_ids=False)


@query("op4_quality_rules")
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every document and the verdict of the threshold table."""
    return quality.judged(documents(spark, sf_dir)).select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "n_lines",
        "n_stop_words",
    )


@query("op5_best_fit_packing")
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token pieces in sequences of 2048."""
    pieces = packing.token_pieces(
        documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), end=0
    )
    return packing.pack(pieces)


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of repeated 50-byte strings, for every document."""
    return suffix.remove_repeats(documents(spark, sf_dir))


@query("op7_context_mixing")
def op7_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and mixed-context scores, learned from six of seven folds."""
    docs = documents(spark, sf_dir)
    held = fold(F.col("doc_id"), 7) == 2
    return lm.scored(docs, lm.learn(docs.filter(~held)), held)


@query("op8_histogram_shards")
def op8_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    rows = sharding.shard_by_bytes(documents(spark, sf_dir), SHARDS)
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op9_weighted_sampling")
def op9_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.compare_edited(documents(spark, sf_dir))


@query("op10_rank_order_language")
def op10_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from four of five folds."""
    docs = documents(spark, sf_dir).select(
        "doc_id", "text", "lang", (fold(F.col("doc_id"), 5) == 0).alias("held_out")
    )
    profiles = langid.learn(docs.filter(~F.col("held_out")))
    return langid.predict(docs, profiles, keep=("doc_id", "held_out"))


@query("op11_conversation_trie")
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    return prefix_trie.prefix_trie(conversations(spark, sf_dir))


@query("op12_spelling_variants")
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, forms and roots."""
    return spelling.spelling_variants(documents(spark, sf_dir))


@query("op13_byte_bpe")
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and what they decode to."""
    path, pattern = tokenizer_path("byte_bpe_multi_50k.tiktoken"), tokenizer_pattern()
    return bpe.digests(bpe.encode(documents(spark, sf_dir), path, pattern), path, pattern)


CHECKS["op4_quality_rules"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text,
    list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t),
win AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1)
  GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words,
    length(array_to_string(words, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%%&|<>]'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(lines)::BIGINT AS n_lines,
    len(list_filter(words, lambda x: lower(x) IN (%(stops)s)))::BIGINT AS n_stop_words
  FROM w LEFT JOIN rep USING (doc_id))
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
    AND word_chars BETWEEN 2 * n_words AND 20 * n_words
    AND n_symbols <= 0.1::DOUBLE * n_words
    AND n_stop_words >= 0.01::DOUBLE * n_words
    AND n_dup_lines <= 0.5::DOUBLE * n_lines AS kept
FROM m
""" % {"stops": ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS)))}

CHECKS["op1_raked_mixing"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || source, 'null') AS source, coalesce('=' || lang, 'null') AS lang,
    '=' || CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '!!') THEN 'shout'
      WHEN regexp_matches(text, '[0-9]{3}') THEN 'record' ELSE 'prose' END AS topic,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens
  FROM documents),
c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL),
s AS (SELECT source, pow(sum(tokens), 0.9) AS r FROM c GROUP BY source),
l AS (SELECT lang, pow(sum(tokens), 0.9) AS r FROM c GROUP BY lang),
t AS (SELECT topic, pow(sum(tokens), 0.95) AS r FROM c GROUP BY topic),
g AS (
  SELECT c.*, sum(tokens) OVER () AS total,
    s.r / (SELECT sum(r) FROM s) AS gs, l.r / (SELECT sum(r) FROM l) AS gl, t.r / (SELECT sum(r) FROM t) AS gt
  FROM c JOIN s USING (source) JOIN l USING (lang) JOIN t USING (topic)),
rake AS (
  SELECT 0 AS i, source, lang, topic, tokens, total, gs, gl, gt, tokens AS w FROM g
  UNION ALL
  SELECT i + 1, source, lang, topic, tokens, total, gs, gl, gt,
    coalesce(w * gt * total / nullif(sum(w) OVER (PARTITION BY topic), 0), 0)
  FROM (SELECT * REPLACE (coalesce(w * gl * total / nullif(sum(w) OVER (PARTITION BY lang), 0), 0) AS w)
    FROM (SELECT * REPLACE (coalesce(w * gs * total / nullif(sum(w) OVER (PARTITION BY source), 0), 0) AS w)
      FROM rake WHERE i < 100))),
f AS (
  SELECT source, lang, topic, factor, factor / max(factor) OVER () AS p
  FROM (SELECT *, CASE WHEN tokens > 0 THEN w / tokens ELSE 0 END AS factor FROM rake WHERE i = 100))
SELECT doc_id, d.source, d.lang, d.topic, n_tokens,
  round(CASE WHEN n_tokens > 0 THEN factor ELSE 0 END, 6) AS factor,
  round(CASE WHEN n_tokens > 0 THEN p ELSE 0 END, 6) AS probability,
  n_tokens > 0 AND ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496e0 < p AS kept
FROM d JOIN f ON d.source = f.source AND d.lang = f.lang AND d.topic = f.topic
"""

# crc32 over the UTF-8 bytes of a text, by the usual table of 256 values.
CRC_TABLE = """(SELECT list(v ORDER BY i) AS tab FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM range(256) r(i)))"""


def crc_sql(text: str) -> str:
    """SQL for the crc32 of a text; ``tab`` must be in scope."""
    return f"""xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(strlen({text})),
      lambda i: ('0x' || substr(hex({text}), (2 * i + 1)::INT, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])))"""


CHECKS["op11_conversation_trie"] = f"""
WITH tab AS {CRC_TABLE},
t AS (
  SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(x ORDER BY i) AS turns FROM t GROUP BY conv_id),
b AS (SELECT conv_id, turns, {crc_sql("conv_id::VARCHAR")} % 9 AS h FROM o, tab),
r AS (
  SELECT b.conv_id, list_concat(coalesce(p.turns[1:b.h], []), b.turns[b.h + 1:]) AS s
  FROM b LEFT JOIN o p ON p.conv_id = b.conv_id - b.conv_id % 5),
v AS (
  SELECT d, s[1:d] AS p, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(s) = d), '') AS ends
  FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM r) GROUP BY d, s[1:d]),
k AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n_children FROM v WHERE d > 0 GROUP BY 1, 2),
u AS (
  SELECT v.*, coalesce(n_children, 0) AS n_children,
    CASE WHEN v.d = 0 THEN 0 ELSE (n_convs - 1) * strlen(v.p[v.d].text) END AS own
  FROM v LEFT JOIN k ON k.d = v.d AND k.p = v.p),
z AS (
  SELECT a AS d, p[1:a] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum(own)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM u) GROUP BY a, p[1:a])
SELECT u.conv_id, u.d AS depth, q.conv_id AS parent_conv_id, u.n_convs, u.n_children, z.n_leaves,
  z.saved_tokens, sha256(u.ends) AS ends_sha256
FROM u JOIN z ON z.d = u.d AND z.p = u.p LEFT JOIN v q ON q.d = u.d - 1 AND q.p = u.p[1:u.d - 1]
"""

CHECKS["op12_spelling_variants"] = f"""
WITH RECURSIVE tab AS {CRC_TABLE},
r AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
  FROM documents),
c AS (SELECT id, w, id || ':' || w AS both_, count(*) AS k FROM r WHERE length(w) >= 6 GROUP BY ALL),
g AS (SELECT w, k, {crc_sql("both_")} AS h FROM c, tab),
m AS (
  SELECT k, CASE WHEN h % 199 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2)
    ELSE w END AS word FROM g),
v AS (SELECT word, sum(k)::BIGINT AS n FROM m WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
x AS (
  SELECT word, n, i, left(word, (i - 1)::INT) || substr(word, (i + 1)::INT) AS e
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM x a JOIN x b
    ON a.i = b.i AND a.e = b.e AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT x.word, v.word, v.n FROM x JOIN v ON x.e = v.word
  UNION SELECT v.word, x.word, x.n FROM x JOIN v ON x.e = v.word),
f AS (
  SELECT word, v.n, count(near) AS n_near, arg_min(near, {{'a': -near_n, 'b': near}}) AS near, max(near_n) AS near_n
  FROM v LEFT JOIN p USING (word) GROUP BY word, v.n),
y AS (
  SELECT word, CASE WHEN near_n >= 5 * n THEN near END AS form, n, n_near,
    CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM f),
s AS (
  SELECT word, word AS at, 0 AS i FROM y
  UNION ALL SELECT s.word, y.form, i + 1 FROM s JOIN y ON y.word = s.at WHERE y.form IS NOT NULL)
SELECT y.word, y.form, arg_max(s.at, s.i) AS root, y.n, y.n_near, y.form_n
FROM y JOIN s ON s.word = y.word GROUP BY ALL
"""
