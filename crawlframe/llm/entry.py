"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crawlframe.llm import chat_trees, decontamination, jaccard_join, language_id, licenses, line_templates, packing, pii_crf, prefix_trie, sharding, token_alignment, token_store, topk_search


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


_WORDS = r"list_filter(string_split(regexp_replace(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format(text="text")}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format(text="text")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, list_aggregate(w[i : i + 9], 'string_agg', ' ') AS win, least(len(w), 10) AS n
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, lens.n AS n, list_aggregate(w[i : i + lens.n - 1], 'string_agg', ' ') AS win
       FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), lens WHERE i + lens.n - 1 <= len(w)),
hits AS (SELECT doc_id, i, dw.n AS n, item FROM dw JOIN bw USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


def op2_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.report(_table(spark, sf_dir, "documents"))


def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.report(_table(spark, sf_dir, "documents"))


#: A conversation whose texts hold the template's own marks.
ESCAPES = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def op4_reply_tree_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_trees.report(rows.unionByName(spark.createDataFrame(ESCAPES, "conv_id long, turn long, role string, text string")))


OP4_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
      coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
      sum(15 + length(role) + length(regexp_replace(text, '[\\#<]', '..', 'g'))) AS n FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(n AS BIGINT) AS formatted_chars FROM a"""


def op5_byte_cnn_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.report(_table(spark, sf_dir, "documents"))


def op6_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_segment_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT * FROM v WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id,
             CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i])) AS BIGINT) AS score
      FROM q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e))
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5"""


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.encode_and_read_back(_table(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(_table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_aggregate(w[i : i + 4], 'string_agg', ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(doc_id, low) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.low AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(low) AS low FROM r GROUP BY doc_id) m USING (doc_id)"""


def op11_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(_table(spark, sf_dir, "documents"))


#: CRC-32 as common tables: its 256 steps by their rule, then a fold over bytes.
_CRC = """steps(k, n, v) AS (SELECT 0, n, n FROM range(256) r(n) UNION ALL SELECT k + 1, n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY n) AS t FROM steps WHERE k = 8)"""
_CRC_OF = "xor(list_reduce(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]), 4294967295), 4294967295)"

OP11_SQL = f"""
WITH RECURSIVE {_CRC},
d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(md5(text), ' ') AS digest, CAST(octet_length(encode(coalesce(text, ''))) + 16 AS BIGINT) AS size FROM documents),
s AS (SELECT *, sum(size) OVER (ORDER BY digest, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS start, sum(size) OVER () AS total, max(size) OVER () AS most,
             sum(size) OVER (PARTITION BY digest) AS alike, row_number() OVER (ORDER BY digest, doc_id NULLS FIRST) AS place FROM d),
u AS (SELECT *, CASE WHEN alike <= most THEN min(start) OVER (PARTITION BY digest) ELSE start END AS unit_start, CASE WHEN alike <= most THEN alike ELSE size END AS unit_size FROM s),
p AS (SELECT *, CAST((2 * unit_start + unit_size) * 40 // (2 * total) AS INTEGER) AS shard FROM u)
SELECT doc_id, size, CAST({_CRC_OF.format(text="text")} AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
       CAST(place - min(place) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p, crc"""


def op12_vertical_bitmap_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.report(_table(spark, sf_dir, "conversations"))


OP12_SQL = f"""
WITH RECURSIVE {_CRC},
t AS (SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn_key, length(coalesce(text, '')) AS chars,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), left(coalesce(text, ''), 64), md5(coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC_OF.format(text="CAST(conv_id AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t), crc),
k AS (SELECT c.*, least(h, coalesce(n, 0)) AS taken FROM c LEFT JOIN (SELECT conv_id AS base, count(*) AS n FROM t GROUP BY ALL) USING (base)),
r AS (SELECT k.conv_id, pos, turn_key, chars FROM k JOIN t ON t.conv_id = base AND pos <= taken UNION ALL SELECT conv_id, pos - h + taken, turn_key, chars FROM k JOIN t USING (conv_id) WHERE pos > h),
p AS (SELECT conv_id, coalesce(list(turn_key ORDER BY pos) FILTER (pos IS NOT NULL), []) AS path, coalesce(list(chars ORDER BY pos) FILTER (pos IS NOT NULL), []) AS sizes FROM c LEFT JOIN r USING (conv_id) GROUP BY conv_id),
m AS (SELECT conv_id, d, path[1 : d] AS key, CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS chars, d = len(path) AS ends FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM p)),
n AS (SELECT key, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY key, d),
ch AS (SELECT key[1 : depth - 1] AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch USING (key)),
s AS (SELECT key[1 : up] AS key, sum(CAST(n_children = 0 AS INTEGER)) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM f) GROUP BY 1)
SELECT f.conv_id, f.depth, a.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN s USING (key) LEFT JOIN f a ON f.depth > 0 AND a.key = f.key[1 : f.depth - 1]"""


def op13_token_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.report(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_benchmark_decontamination, op2_skip_chain_pii, op3_line_templates, op4_reply_tree_chat, op5_byte_cnn_language_id, op6_license_digests, op7_segment_top_k, op8_best_fit_packing, op9_token_id_files, op10_ngram_jaccard_join, op11_sampled_splitters, op12_vertical_bitmap_trie, op13_token_anchors)}


def oracle_sql() -> dict[str, str]:
    return {"op1_benchmark_decontamination": OP1_SQL, "op4_reply_tree_chat": OP4_SQL, "op6_license_digests": licenses.SQL, "op7_segment_top_k": OP7_SQL, "op10_ngram_jaccard_join": OP10_SQL, "op11_sampled_splitters": OP11_SQL, "op12_vertical_bitmap_trie": OP12_SQL}
