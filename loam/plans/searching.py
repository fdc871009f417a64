"""Queries over the main search, the entity graph as a source of results, and the rules for trading answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.embedding import embedded
from ..operators import graph as G
from ..operators import memory_search as S
from ..operators import vectors as N
from . import related as L
from . import retrieving as T
from . import texts as X
from .registry import query, table

r6 = lambda x: F.round(x, 6)


def known_entities(spark, sf_dir):
    """(entities, edges) of the documents' entity graph, from one pass over the texts."""
    pairs = G.cut(G.following(X.docs(spark, sf_dir), "text").distinct())
    entities = pairs.select(F.col("src").alias("name")).distinct().select("name", G.kind("name").alias("type"), F.lit(0.7).alias("confidence"))
    return G.cut(entities), pairs.where("dst is not null and src <> dst")


HITS = rf"""{X.EDGES}, qe AS (SELECT item_id AS qid, unnest(list_distinct(regexp_extract_all({X.PLAIN}, '{X.ENTITY}') || regexp_extract_all(text, '"([^"]*)"', 1))) AS name FROM benchmark),
en AS (SELECT DISTINCT name FROM n), hq AS (SELECT qid, name FROM qe SEMI JOIN en USING (name)), hs AS (SELECT DISTINCT name FROM hq),
k1 AS (SELECT hs.name AS seed, b AS name FROM hs JOIN sym ON a = hs.name), k2 AS (SELECT seed, b AS name FROM k1 JOIN sym ON a = k1.name), kc AS (SELECT seed, count(*) AS connected FROM (SELECT * FROM k1 UNION SELECT * FROM k2) WHERE name <> seed GROUP BY 1),
kr AS (SELECT hs.name, count(*) AS relationships FROM hs JOIN g ON src = hs.name OR dst = hs.name GROUP BY 1),
hits AS (SELECT qid, hq.name, 0.7::DOUBLE AS score, coalesce(connected, 0) AS connected, coalesce(relationships, 0) AS relationships FROM hq LEFT JOIN kc ON kc.seed = hq.name LEFT JOIN kr ON kr.name = hq.name)"""


@query(f"WITH {HITS} SELECT qid, name, 'PERSON' AS type, score, connected, relationships FROM hits")
def graph_search(spark, sf_dir):
    return S.graph_hits(T.questions(spark, sf_dir), *known_entities(spark, sf_dir))


@query(rf"""WITH {HITS}, ws AS (SELECT item_id AS qid, list_distinct(list_filter(string_split_regex(lower(text), '[ \t\n\x0B\f\r]+'), lambda w : w <> '')) AS ws FROM benchmark)
SELECT hits.qid, name, round(least(1.0, (len(list_intersect(ws, list_distinct(list_filter(string_split_regex(lower(name), '[ \t\n\x0B\f\r]+'), lambda w : w <> '')))) + len(list_intersect(ws, ['person']))) / 10::DOUBLE + least(relationships / 20::DOUBLE, 0.3)), 6) AS relevance FROM hits JOIN ws USING (qid)""")
def graph_relevance(spark, sf_dir):
    hits = S.graph_hits(T.questions(spark, sf_dir), *known_entities(spark, sf_dir)).withColumn("properties", F.create_map(F.lit("name"), "name", F.lit("type"), "type"))
    return hits.join(T.questions(spark, sf_dir), "qid").select("qid", "name", r6(S.graph_relevance("text", "properties", "relationships")).alias("relevance"))


@query(f"WITH {L.RL}, v AS (SELECT nd.name, nd.created_at, p_brand FROM nd JOIN part ON nd.name = 'part:' || p_partkey WHERE nd.type = 'part' AND p_brand = 'Brand#1') SELECT name, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM v ORDER BY v.created_at DESC, name LIMIT 50 OFFSET 10")
def find_entities(spark, sf_dir):
    """A page of the parts of one brand."""
    brands = table(spark, sf_dir, "part").selectExpr("concat('part:', p_partkey) as name", "p_brand as brand")
    nodes = L.entities(L.relationships(spark, sf_dir)).join(brands, "name", "left")
    return S.find_entities(nodes, "part", {"brand": "Brand#1"}, 50, 10).select("name", F.date_format("created_at", L.STAMP).alias("created_at"))


@query(f"WITH {T.KNN} SELECT qid, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS i FROM k WHERE score >= 0.3) WHERE i <= 10")
def filter_min_score(spark, sf_dir):
    """The ten nearest rows of each query that are near enough."""
    near = N.exact_nearest(T.corpus(spark, sf_dir), T.asked(spark, sf_dir).withColumnRenamed("qid", "id"), 10)
    return S.at_least(near, 0.3).select("qid", "id", r6("score").alias("score"))


@query("SELECT doc_id AS id, CASE WHEN length(text) <= 4000 THEN 'primary' WHEN text IS NOT NULL THEN 'fallback' END AS model, CAST(CASE WHEN length(text) <= 4000 THEN 64 WHEN text IS NOT NULL THEN 32 END AS INTEGER) AS width FROM documents")
def embed_with_fallback(spark, sf_dir):
    """Texts that are too long for the first model have the vector of the second, of another width."""
    short = F.when(F.length("text") <= 4000, F.col("text"))
    out = S.with_fallback(T.docs(spark, sf_dir).withColumn("short", short), {"primary": embedded("short"), "fallback": embedded("text", 32)})
    return out.select("id", "model", F.when(F.col("v").isNotNull(), F.size("v")).alias("width"))


PAIRS = r"""l AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next, lag(text) OVER w AS before, row_number() OVER w - 1 AS earlier FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pa AS (SELECT conv_id, turn, text AS q, next AS r, coalesce(before, '') AS c, earlier AS memories, contains(lower(text), 'buy') OR contains(lower(text), 'sell') OR contains(lower(text), 'trade') OR contains(lower(text), 'the') AS trading FROM l WHERE role = 'user' AND next_role = 'assistant'),
tc AS (SELECT *, greatest(0, least(98, 85 + CASE WHEN c <> '' THEN 5 ELSE -10 END + least(2 * memories, 10) + CASE WHEN len(regexp_extract_all(q, '[^ \t\n\x0B\f\r]+')) > 5 THEN 5 ELSE -5 END + CASE WHEN len(regexp_extract_all(r, '[^ \t\n\x0B\f\r]+')) > 20 THEN 3 ELSE -3 END
  + CASE WHEN contains(lower(q), 'buy') OR contains(lower(q), 'sell') OR contains(lower(q), 'trade') THEN 2 ELSE 0 END + CASE WHEN contains(r, '⚠️') THEN 2 ELSE 0 END + CASE WHEN contains(lower(r), 'verification') THEN 3 ELSE 0 END + CASE WHEN contains(lower(r), 'risk') THEN 2 ELSE 0 END))::DOUBLE AS confidence FROM pa)"""


def answered(spark, sf_dir):
    """User turns with the answer that follows, what came before as context, and how many turns there were before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    own = table(spark, sf_dir, "conversations").withColumns({"next_role": F.lead("role").over(w), "answer": F.lead("text").over(w), "context": F.coalesce(F.lag("text").over(w), F.lit("")), "memories": F.row_number().over(w) - 1})
    return own.where("role = 'user' and next_role = 'assistant'").withColumn("confidence", S.trading_confidence("text", "answer", "context", "memories"))


@query(f"WITH {PAIRS} SELECT conv_id, turn, confidence FROM tc")
def trading_confidence(spark, sf_dir):
    return answered(spark, sf_dir).select("conv_id", "turn", "confidence")


@query(f"""WITH {PAIRS}, ch AS (SELECT conv_id, turn, confidence, [confidence >= 95, 60 + conv_id % 40 >= 75, conv_id % 7 <> 0, conv_id % 2 = 0, turn % 10 / 10.0 <= 0.5, memories > 0] AS ok, 60 + conv_id % 40 AS h, trading FROM tc)
SELECT conv_id, turn, {T.LEVEL.format("confidence")} AS level, list_bool_and(ok) AS approved, array_to_string(list_filter([CASE WHEN NOT ok[1] THEN 'Confidence ' || printf('%.1f', confidence) || '% below required 95% threshold' END, CASE WHEN NOT ok[2] THEN 'Hallucination score ' || printf('%.1f', h::DOUBLE) || '% below threshold' END,
  CASE WHEN NOT ok[6] THEN 'No memory context available for decision support' END, CASE WHEN trading AND NOT list_bool_and(ok) THEN 'CRITICAL: Trading query detected but safety requirements not met' END], lambda x : x IS NOT NULL), '; ') AS warnings FROM ch""")
def trading_safety_checks(spark, sf_dir):
    own = answered(spark, sf_dir).selectExpr("conv_id", "turn", "confidence", "60 + conv_id % 40 as hallucination", "if(conv_id % 7 = 0, '', concat('a', conv_id)) as agent_id", "conv_id % 2 = 0 as accurate", "turn % 10 / 10 as temperature", "memories", "lower(text) rlike 'buy|sell|trade|the' as trading")
    return S.trading_checks(own).select("conv_id", "turn", "level", "approved", F.array_join("warnings", "; ").alias("warnings"))


@query()  # tests hold the merge and the cut against plain Python; the parts have twins of their own
def search_memory(spark, sf_dir):
    own, asked = T.with_vectors(spark, sf_dir)
    return S.search_memory(own, asked, *known_entities(spark, sf_dir), 10, 0.2)


@query()  # a test holds routes, sources and order against plain Python
def adaptive_retrieve(spark, sf_dir):
    own, asked = T.with_vectors(spark, sf_dir)
    return S.adaptive_retrieve(own, asked, *known_entities(spark, sf_dir), 10)
