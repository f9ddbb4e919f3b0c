"""Registered queries of the operators, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.llm import align, bitpack, boosted, feistel, hnsw, mixing, multiindex, prefixes, recurrent, secrets, simhash, surrogates, wfst


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and decision for every document; a quarter of the labels is never learnt from."""
    documents, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    trees = boosted.train(documents, labels.where(~boosted.held_out()))
    return boosted.score(documents.select("doc_id", "text"), trees).select(
        "doc_id", boosted.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, bits=3)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document."""
    return mixing.mix(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), budget=1.5, most=2).select(
        "doc_id", "size", "source_size", "target", "taken")


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for its entities, and how many they are."""
    done = surrogates.replace_checked(_table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY, record=True)
    return done.select("doc_id", "text", F.size("replaced").alias("n_entities"), F.array_sort(F.array_distinct("replaced.type")).alias("types"))


def op1_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector at cosine 0.95."""
    return hnsw.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return wfst.encode(documents, tokenizer_path("piece_bpe_32k.model"), check=True).select(
        "doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).alias("n_tokens"), "restored")


def op6_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, from the files written."""
    files = bitpack.write(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return bitpack.read(files).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, by the law that counts differ by one row at most."""
    return feistel.shard(_table(spark, sf_dir, "documents"), shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihood of every whole document, with a unigram model's beside it."""
    return recurrent.score(_table(spark, sf_dir, "documents"), boosted.held_out(folds=5, fold=1))


def op9_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors by sign bits for every fiftieth id."""
    return multiindex.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=10)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of both tokenizers for every document."""
    return align.alignment(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all conversations, after heads are shared in groups of twenty ids."""
    turns = prefixes.turns_of(_table(spark, sf_dir, "conversations"))
    return prefixes.prefix_trie(prefixes.with_heads(turns, group=20, most=3))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document, by pattern and by two Markov chains."""
    return secrets.scan(_table(spark, sf_dir, "documents"))


def _matches_sql(kind: int) -> str:
    """Matches of a kind, with their places, from ``texts`` (r, text)."""
    pattern, group, least = secrets.PATTERNS[kind]
    quoted = "'" + pattern.replace("'", "''") + "'"
    return f"""
  SELECT r, {kind} AS kind, value, until - size AS start, until AS "end", length(value) >= {least} AS long_enough FROM (
    SELECT r, value, size, sum(gap + size) OVER (PARTITION BY r ORDER BY i) AS until FROM (
      SELECT r, i, length(gaps[i]) AS gap, length(hits[i]) AS size, vals[i] AS value FROM (
        SELECT r, string_split_regex(text, {quoted}) AS gaps, regexp_extract_all(text, {quoted}) AS hits,
               regexp_extract_all(text, {quoted}, {group}) AS vals FROM texts), unnest(range(1, len(hits) + 1)) AS u(i)))"""


SECRETS_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
matches AS ({' UNION ALL '.join(map(_matches_sql, range(len(secrets.KINDS))))}),
spans AS (SELECT r, kind, start, "end", value FROM matches WHERE long_enough),
base AS (SELECT * FROM spans WHERE kind < {secrets.MARKOV}),
candidates AS (
  SELECT * FROM spans s WHERE kind = {secrets.MARKOV} AND regexp_matches(value, '[A-Za-z]')
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = s.r AND b.start < s."end" AND b."end" > s.start)),
samples AS (SELECT value, min(kind) < {secrets.MARKOV} AS secret FROM (FROM base UNION ALL FROM candidates) GROUP BY value),
symbols AS (SELECT unnest(string_split('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-', '')) AS c),
steps AS (
  SELECT value, secret, unnest(list_zip(['^'] || string_split(value, ''), string_split(value, '') || ['$']), recursive := false) AS step FROM samples),
seen AS (SELECT secret, step[1] AS a, step[2] AS b, count(*) AS n FROM steps GROUP BY ALL),
smoothed AS (
  SELECT k.secret, f.c AS a, t.c AS b, coalesce(n, 0) + {secrets.ADDED} AS n
  FROM (VALUES (true), (false)) k(secret), (FROM symbols UNION ALL SELECT '^') f, (FROM symbols UNION ALL SELECT '$') t
  LEFT JOIN seen ON seen.secret = k.secret AND seen.a = f.c AND seen.b = t.c),
chains AS (SELECT secret, a, b, n / sum(n) OVER (PARTITION BY secret, a) AS p FROM smoothed),
ratios AS (SELECT a, b, ln(s.p / o.p) AS ratio FROM chains s JOIN chains o USING (a, b) WHERE s.secret AND NOT o.secret),
runs AS (SELECT DISTINCT value FROM candidates),
scored AS (
  SELECT value FROM (SELECT value, unnest(list_zip(['^'] || string_split(value, ''), string_split(value, '') || ['$']), recursive := false) AS step FROM runs)
  JOIN ratios ON a = step[1] AND b = step[2] GROUP BY value HAVING sum(ratio) >= {secrets.RATIO}),
every AS (FROM base UNION ALL SELECT c.* FROM candidates c JOIN scored USING (value)),
listed AS (SELECT r, kind, start, "end", {secrets.KINDS!r}[kind + 1] || ':' || start || ':' || "end" AS span FROM every)
SELECT any_value(doc_id) AS doc_id,
       {', '.join(f'count(*) FILTER (kind = {k}) AS n_{name}' for k, name in enumerate(secrets.KINDS))},
       sha256(coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (kind < {secrets.MARKOV}), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY start, kind), '') AS spans
FROM texts LEFT JOIN listed USING (r) GROUP BY r
"""

PREFIX_SQL = r"""
WITH ordered AS (
  SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, turn
  FROM conversations WHERE conv_id IS NOT NULL),
turns AS (
  SELECT conv_id, digest, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS place FROM ordered),
taken AS (
  SELECT conv_id, conv_id - conv_id % 20 AS first,
         xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')]),
           lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)),
           4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT t.conv_id, 0 AS own, c.place, c.digest, c.words FROM taken t JOIN turns c ON c.conv_id = t.first WHERE c.place <= t.h
  UNION ALL
  SELECT t.conv_id, 1, c.place, c.digest, c.words FROM taken t JOIN turns c USING (conv_id) WHERE c.place > t.h),
numbered AS (
  SELECT conv_id, digest, words, row_number() OVER (PARTITION BY conv_id ORDER BY own, place) AS depth FROM rebuilt),
prefixes AS (
  SELECT conv_id, depth, words, md5(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node,
         md5(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS above,
         max(depth) OVER (PARTITION BY conv_id) AS turns
  FROM numbered
  UNION ALL
  SELECT conv_id, 0, 0, md5(''), NULL, (SELECT count(*) FROM numbered n WHERE n.conv_id = taken.conv_id) FROM taken),
nodes AS (
  SELECT node, depth, coalesce(any_value(above), CASE WHEN depth > 0 THEN md5('') END) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = turns), '')) AS ends_sha256
  FROM prefixes GROUP BY node, depth),
children AS (SELECT above AS node, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY above),
counted AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (node)),
subtrees AS (
  SELECT p.node AS top, c.node FROM prefixes p JOIN counted n USING (node) JOIN prefixes c ON c.conv_id = p.conv_id AND c.depth >= p.depth GROUP BY ALL),
summed AS (
  SELECT s.top AS node, count(*) FILTER (c.n_children = 0) AS n_leaves, sum((c.n_convs - 1) * c.words) AS saved_tokens
  FROM subtrees s JOIN counted c ON c.node = s.node GROUP BY s.top)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM counted n JOIN summed USING (node) LEFT JOIN counted p ON p.node = n.above
"""

NEAREST_SQL = """
WITH coded AS (
  SELECT vec_id, CAST(array_to_string([CASE WHEN x > 0 THEN '1' ELSE '0' END FOR x IN embedding], '') AS BIT) AS code
  FROM embeddings),
pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(bit_count(xor(q.code, v.code)) AS INTEGER) AS distance
  FROM coded q JOIN coded v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs) WHERE rank <= 10
"""

MIXING_SQL = r"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS queue,
         coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0) AS size,
         md5(concat_ws('-', 'mix', CAST(doc_id AS VARCHAR))) AS place
  FROM documents),
totals AS (
  SELECT queue, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY queue) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM sized GROUP BY queue),
levels AS (
  SELECT *, CAST(2 * source_size AS DOUBLE) AS lim,
         (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5
          - coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / weight, queue ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2)::DOUBLE
         / sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, queue ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
  FROM totals),
settled AS (
  SELECT arg_min(level, (source_size::DOUBLE / weight, queue)) AS settled FROM levels WHERE level * weight < lim),
targets AS (
  SELECT queue, source_size, CASE WHEN level * weight < lim THEN least(settled * weight, lim) ELSE lim END AS target
  FROM levels LEFT JOIN settled ON true),
queued AS (
  SELECT doc_id, queue, size, place, source_size, target,
         coalesce(sum(size) OVER (PARTITION BY queue ORDER BY place, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         row_number() OVER () AS r
  FROM sized JOIN targets USING (queue)),
copies AS (
  SELECT r, size, sum(size) OVER (
           ORDER BY CAST((copy - 1) * source_size + before + size AS DOUBLE) / target, queue, place, doc_id NULLS FIRST, size, copy
           ROWS UNBOUNDED PRECEDING) AS until
  FROM queued, (VALUES (1), (2)) c(copy) WHERE size > 0),
chosen AS (
  SELECT r, sum(size) AS taken FROM copies WHERE until <= (SELECT sum(size) * 1.5::DOUBLE FROM sized) GROUP BY r)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM queued LEFT JOIN chosen USING (r)
"""


#: A test key; a real one comes from the caller.
SURROGATE_KEY = b"surrogates of the test tables"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hnsw": op1_hnsw,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_mixing": op3_mixing,
    "op4_recurrent_lm": op4_recurrent_lm,
    "op5_pii_surrogates": op5_pii_surrogates,
    "op6_bit_packing": op6_bit_packing,
    "op7_feistel_shards": op7_feistel_shards,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_multi_index": op9_multi_index,
    "op10_simhash": op10_simhash,
    "op11_alignment": op11_alignment,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_secrets": op13_secrets,
}

ORACLES: dict[str, str] = {"op3_mixing": MIXING_SQL, "op9_multi_index": NEAREST_SQL, "op12_prefix_trie": PREFIX_SQL, "op13_secrets": SECRETS_SQL}
