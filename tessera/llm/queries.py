"""The registered queries ``opN_<name>``: each operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .shared import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_balanced_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import count_tokens, vocabulary

    return count_tokens(_table(spark, sf_dir, "documents"), vocabulary(public_tokenizers.path("piece_bpe_32k.model")))


def op5_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .preferences import format_pairs, neighbours_as_pairs

    return format_pairs(neighbours_as_pairs(_table(spark, sf_dir, "conversations")))


def op6_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_report

    return mix_report(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import main_text

    return main_text(_table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OP3_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents),
g AS (SELECT t, count(*) AS group_size FROM n GROUP BY t),
k AS (SELECT t, doc_id AS keep_id FROM (SELECT t, doc_id, row_number() OVER (PARTITION BY t ORDER BY points DESC, doc_id) AS r FROM n) WHERE r = 1)
SELECT n.doc_id, k.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = k.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t JOIN k ON n.t = k.t
"""


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH w AS (SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN [] ELSE list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') END AS a FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(a) - 11)) AS i, a FROM w WHERE len(a) >= 13),
g AS (SELECT doc_id, i, array_to_string(a[i:i + 12], ' ') AS t FROM p),
m AS (SELECT t, min(doc_id) AS first FROM g GROUP BY t HAVING count(*) > 1),
r AS (SELECT DISTINCT g.doc_id, g.i + k.k AS pos FROM g JOIN m ON g.t = m.t AND g.doc_id > m.first, range(0, 13) AS k(k)),
c AS (SELECT doc_id, list(pos) AS gone, count(*) AS n FROM r GROUP BY doc_id)
SELECT w.doc_id, CAST(len(a) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN c.n IS NULL THEN a ELSE [a[i] FOR i IN range(1, len(a) + 1) IF NOT list_contains(c.gone, i)] END, ' ')) AS kept_sha256
FROM w LEFT JOIN c ON w.doc_id = c.doc_id
"""


OP5_SQL = r"""
WITH t AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, role, text, '<|' || role || '|>' || chr(10) AS head, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS body,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT pair_id, count(*) FILTER (WHERE side = 0) AS nc, count(*) FILTER (WHERE side = 1) AS nr FROM t GROUP BY pair_id),
d AS (SELECT c.pair_id, min(c.i) AS i FROM t c JOIN n USING (pair_id) LEFT JOIN t r ON r.pair_id = c.pair_id AND r.side = 1 AND r.i = c.i AND r.role = c.role AND r.text = c.text WHERE c.side = 0 AND r.i IS NULL GROUP BY c.pair_id),
k AS (SELECT n.pair_id, nc, nr, CASE WHEN nc = 0 OR nr = 0 THEN 0 ELSE coalesce(d.i - 1, nc) END AS k FROM n LEFT JOIN d ON d.pair_id = n.pair_id),
x AS (SELECT t.*, k.k, t.i > k.k AS done, sum(CASE WHEN t.i > k.k THEN length(t.body) ELSE 0 END) OVER (PARTITION BY t.pair_id, t.side ORDER BY t.i) AS stop FROM t JOIN k ON k.pair_id = t.pair_id),
s AS (SELECT pair_id, side, coalesce(string_agg(body, '' ORDER BY i) FILTER (WHERE NOT done), '') AS prompt, coalesce(string_agg(body, '' ORDER BY i) FILTER (WHERE done), '') AS rest,
    coalesce(string_agg(CAST(CAST(stop - length(body) + length(head) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR), ',' ORDER BY i) FILTER (WHERE done AND role = 'assistant'), '') AS mask FROM x GROUP BY pair_id, side)
SELECT k.pair_id, CAST(k.k AS BIGINT) AS n_prompt_turns, coalesce(c.prompt, '') AS prompt, c.rest AS chosen, r.rest AS rejected, c.mask AS chosen_mask, r.mask AS rejected_mask
FROM k LEFT JOIN s c ON c.pair_id = k.pair_id AND c.side = 0 LEFT JOIN s r ON r.pair_id = k.pair_id AND r.side = 1
"""

OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS a FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 4 THEN [array_to_string(a, ' ')] ELSE [array_to_string(a[i:i + 3], ' ') FOR i IN range(1, len(a) - 2)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT o.a, o.b FROM o JOIN n p ON p.doc_id = o.a JOIN n q ON q.doc_id = o.b WHERE 100 * c >= 85 * (p.n + q.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id AND r.c < e.b)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(m.c, w.doc_id) AS BIGINT) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m ON m.doc_id = w.doc_id
"""


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op5_preferences": OP5_SQL, "op2_substring_dedup": OP2_SQL, "op3_exact_dedup": OP3_SQL, "op10_ngram_jaccard": OP10_SQL}
