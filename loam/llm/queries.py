"""The registered queries of this subpackage and, where SQL can state them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import context_tree, jaccard, lines, packing, personal, pieces, quality, search, signatures, substrings, toxicity, tries


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_classes(table(spark, sf_dir, "documents"))


def op2_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.scores(table(spark, sf_dir, "documents"))


def op3_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.exact_top_k(table(spark, sf_dir, "embeddings"))


def op4_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substrings.keep_unrepeated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_lstm_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = personal.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op8_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.approximate_top_k(table(spark, sf_dir, "embeddings"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pieces.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_bloom_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.drop_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_context_tree": op2_context_tree,
    "op3_threshold_top_k": op3_threshold_top_k,
    "op4_suffix_automata": op4_suffix_automata,
    "op5_subword_quality": op5_subword_quality,
    "op6_compression_toxicity": op6_compression_toxicity,
    "op7_lstm_crf_pii": op7_lstm_crf_pii,
    "op8_cross_polytope": op8_cross_polytope,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_bloom_search": op12_bloom_search,
    "op13_line_dedup": op13_line_dedup,
}

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w : w <> '')"

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": rf"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i : array_to_string(ws[i : i + 4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS t FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS nb FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * nb >= 75 * (x.n + y.n - nb)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node)
SELECT n.doc_id, n.n AS n_shingles, min(r.root) AS component_id FROM n JOIN r ON r.node = n.doc_id GROUP BY n.doc_id, n.n""",
    "op3_threshold_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x : floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op4_suffix_automata": r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w : w <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35),
h AS (SELECT s.doc_id, i, md5(array_to_string(ws[i : i + 34], ' ')) AS h FROM s JOIN w USING (doc_id)),
d AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM h SEMI JOIN d USING (h)),
k AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
r AS (SELECT doc_id, ws, coalesce(gone, []) AS gone FROM w LEFT JOIN k USING (doc_id))
SELECT doc_id, len(ws) AS n_words, len(gone) AS n_removed,
  sha256(coalesce(array_to_string(list_filter(ws, lambda x, j : NOT list_contains(gone, j)), ' '), '')) AS kept_sha256 FROM r""",
    "op11_prefix_trie": """
WITH t AS (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({'id': id, 'chars': chars} ORDER BY turn NULLS FIRST, id) AS ts FROM t GROUP BY conv_id),
h AS (SELECT *, xor(list_reduce([4294967295] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c : CAST(ascii(c) AS BIGINT)),
  lambda c, b : list_reduce([xor(c, b)] || range(8), lambda z, i : CASE WHEN z & 1 = 1 THEN xor(z >> 1, 3988292384) ELSE z >> 1 END)), 4294967295) % 6 AS h FROM o),
r AS (SELECT h.conv_id, coalesce(b.ts, [])[1:h.h] || h.ts[h.h + 1:] AS seq FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, len(seq) AS turns, unnest(range(0, len(seq) + 1)) AS depth, seq FROM r),
k AS (SELECT conv_id, turns, depth, array_to_string(list_transform(seq[1:depth], lambda x : x.id), '') AS k, coalesce(seq[depth].chars, 0) AS chars FROM p),
n AS (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (turns = depth), '') AS ends FROM k GROUP BY depth, k),
c AS (SELECT depth - 1 AS depth, left(k, 32 * (depth - 1)) AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (depth, k)),
u AS (SELECT unnest(range(0, depth + 1)) AS depth, k, n_children = 0 AS leaf, (n_convs - 1) * chars AS saved FROM m),
s AS (SELECT depth, left(k, 32 * depth) AS k, count(*) FILTER (leaf) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM u GROUP BY 1, 2)
SELECT m.conv_id, m.depth, up.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN s ON s.depth = m.depth AND s.k = m.k LEFT JOIN m up ON up.depth = m.depth - 1 AND up.k = left(m.k, 32 * (m.depth - 1))""",
    "op12_bloom_search": rf"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all({LOWER}, '{TERM}')) AS term FROM documents),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM f GROUP BY doc_id), c AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM n),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWER}, '{TERM}')) AS term FROM benchmark),
d AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, c GROUP BY term, n_docs),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms)))))::BIGINT AS score
  FROM q JOIN d USING (term) JOIN f USING (term) JOIN n USING (doc_id), c GROUP BY item_id, doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50""",
    "op13_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, coalesce(s.keeper <> doc_id, false) AS gone FROM k LEFT JOIN s ON s.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
}
