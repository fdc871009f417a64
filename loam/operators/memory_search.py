"""The main search: hybrid candidates and hits in the entity graph, merged, reranked and cut; and what answers for trading need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.embedding import small_batches
from . import graph, relations
from .retrieval import deduplicated, hybrid_scan, level, merged_sources, penalised, terms
from .vectors import exact_nearest

HEAD = 200  #: characters by which results count as the same
UNKNOWN = 0.8  #: score of an entity without confidence


def graph_hits(queries: DataFrame, entities: DataFrame, edges: DataFrame, most: int = 10, depth: int = 2) -> DataFrame:
    """(qid, name, type, score, connected, relationships) of entities (name, type, confidence) that a query (qid, text) names.

    Names are met exactly; of one name at most `most` entities, by type, count for a query. connected: other entities within `depth` steps
    of any edge (src, dst), either way; relationships: edges that touch it. score: its confidence, UNKNOWN where that is null.
    Queries without entities, and names that no entity has, find nothing.
    """
    named = queries.select("qid", F.explode(F.array_distinct(graph.query_entities("text"))).alias("name"))
    place = F.row_number().over(Window.partitionBy("qid", "name").orderBy("type"))
    found = graph.cut(named.join(entities, "name").withColumn("place", place).where(F.col("place") <= most))
    seeds = found.select("name").distinct()
    near = relations.connected(edges, entities, seeds, depth)
    touching = relations.touching(edges, seeds).groupBy(F.col("entity").alias("name")).agg(F.count("*").alias("relationships"))
    out = found.join(near, "name", "left").join(touching, "name", "left")
    return out.select("qid", "name", "type", F.coalesce("confidence", F.lit(UNKNOWN)).alias("score"), F.coalesce("connected", F.lit(0)).alias("connected"), F.coalesce("relationships", F.lit(0)).alias("relationships"))


def graph_relevance(query: str, properties: str, relationships: str) -> Column:
    """0.1 for every word of the query in each text property (map<string,string>), and 0.05 for each relationship, 0.3 at most; 1 at most."""
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != ""))
    asked = words(F.coalesce(F.col(query), F.lit("")))
    shared = F.aggregate(F.map_values(F.coalesce(F.col(properties), F.create_map().cast("map<string,string>"))), F.lit(0), lambda n, v: n + F.coalesce(F.size(F.array_intersect(asked, words(v))), F.lit(0)))
    return F.least(F.lit(1.0), shared / 10 + F.least(F.coalesce(F.col(relationships), F.lit(0)) / 20, F.lit(0.3)))


def find_entities(nodes: DataFrame, type_: str | None = None, properties: dict | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the entities of a type with the given columns' values, newest first, then by name."""
    out = nodes if type_ is None else nodes.where(F.col("type") == type_)
    for name, value in (properties or {}).items():
        out = out.where(F.col(name) == value)
    return out.orderBy(F.desc_nulls_last("created_at"), "name").offset(offset).limit(limit)


def merged_by_head(results: DataFrame) -> DataFrame:
    """Of results (qid, key, content, score, confidence, source) with one beginning the best, of equal ones the smallest key."""
    best = F.min(F.struct((-F.col("score")).alias("down"), "key", "content", "score", "confidence", "source")).alias("x")
    return results.groupBy("qid", F.substring("content", 1, HEAD).alias("head")).agg(best).select("qid", "x.key", "x.content", "x.score", "x.confidence", "x.source")


def search_memory(docs: DataFrame, queries: DataFrame, entities: DataFrame, edges: DataFrame, k: int = 10, least: float = 0.0) -> DataFrame:
    """(qid, rank, key, source, score, confidence): the k best memories and entities for every query.

    docs (id, text, v) and queries (qid, text, v): twice as many hybrid candidates as are asked for, and the entities that
    the query names; of equal beginnings (HEAD characters) the higher score stays. All that is left is reranked by the share of the query's terms that
    it holds, then what has less confidence than `least` goes, and k stay; ties by score, then by key.
    """
    near = hybrid_scan(docs, queries, 2 * k).join(docs.select("id", F.col("text").alias("content")), "id")
    near = near.select("qid", F.concat(F.lit("memory:"), F.lpad(F.col("id").cast("string"), 19, "0")).alias("key"), "content", "score", F.col("score").alias("confidence"), F.lit("vector").alias("source"))
    hits = graph_hits(queries, entities, edges)
    hits = hits.select("qid", F.concat(F.lit("entity:"), "name").alias("key"), F.concat(F.lit("Entity: "), "name", F.lit(" ("), "type", F.lit(")")).alias("content"), "score", F.col("score").alias("confidence"), F.lit("graph").alias("source"))
    both = merged_by_head(near.unionByName(hits)).join(queries.select("qid", F.col("text").alias("query")), "qid")
    asked = terms("query")
    share = F.coalesce(F.try_divide(F.size(F.array_intersect(asked, terms("content"))), F.size(asked)), F.lit(0.0))
    scored = both.withColumn("share", F.round(share, 6)).where(F.col("confidence") >= least)
    order = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("share"), F.desc("score"), "key"))
    return scored.withColumn("rank", order).where(F.col("rank") <= k).select("qid", "rank", "key", "source", F.col("share").alias("score"), "confidence")


def at_least(results: DataFrame, score: float, by: str = "score") -> DataFrame:
    """Results whose score is at least so high; put it before the sort of a top-k."""
    return results.where(F.col(by) >= score)


def with_fallback(df: DataFrame, models: dict[str, Column]) -> DataFrame:
    """df with v and model: the vector of the first model that gives one; rows without any have nulls."""
    small_batches(df.sparkSession)
    first = F.coalesce(*[F.when(v.isNotNull(), F.struct(v.alias("v"), F.lit(name).alias("model"))) for name, v in models.items()])
    return df.withColumn("__x", first).withColumns({"v": F.col("__x.v"), "model": F.col("__x.model")}).drop("__x")


# fixed values: words and steps of the trading rules
TRADE = ("buy", "sell", "trade")
WARNING = "⚠️"


def trading_confidence(query: str, response: str, context: str, memories: str) -> Column:
    """Confidence (0 to 98) in an answer to a trading question; nulls count as empty texts and no memories."""
    q, r, c = (F.coalesce(F.col(x), F.lit("")) for x in (query, response, context))
    n = lambda t: F.regexp_count(t, F.lit(r"\S+"))
    said = lambda t, w: F.contains(t, F.lit(w))
    add = lambda ok, yes, no=0.0: F.when(ok, yes).otherwise(no)
    traded = said(F.lower(q), TRADE[0]) | said(F.lower(q), TRADE[1]) | said(F.lower(q), TRADE[2])
    total = F.lit(85.0) + add(c != "", 5.0, -10.0) + F.least(2.0 * F.coalesce(F.col(memories), F.lit(0)), F.lit(10.0)) + add(n(q) > 5, 5.0, -5.0) + add(n(r) > 20, 3.0, -3.0) + add(traded, 2.0)
    total = total + add(said(r, WARNING), 2.0) + add(said(F.lower(r), "verification"), 3.0) + add(said(F.lower(r), "risk"), 2.0)
    return F.greatest(F.least(total, F.lit(98.0)), F.lit(0.0))


def trading_checks(answers: DataFrame) -> DataFrame:
    """answers (confidence, hallucination, agent_id, accurate, temperature, memories, trading) with level, checks, approved and warnings.

    checks: the six by name; approved: all of them; a check on a null fails. trading: whether the question was about trading.
    """
    ok = lambda x: F.coalesce(x, F.lit(False))
    checks = {
        "confidence_above_95": ok(F.col("confidence") >= 95), "hallucination_below_threshold": ok(F.col("hallucination") >= 75), "agent_id_provided": ok(F.col("agent_id") != ""),
        "trading_model_used": ok(F.col("accurate")), "temperature_appropriate": ok(F.col("temperature") <= 0.5), "memory_context_available": ok(F.col("memories") > 0),
    }
    out = answers.withColumn("level", level(F.col("confidence"))).withColumn("checks", F.struct(*[v.alias(k) for k, v in checks.items()]))
    out = out.withColumn("approved", F.forall(F.array(*[F.col(f"checks.{k}") for k in checks]), lambda x: x))
    told = lambda c: F.format_string("%.1f%%", F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    warnings = [
        F.when(~F.col("checks.confidence_above_95"), F.concat(F.lit("Confidence "), told("confidence"), F.lit(" below required 95% threshold"))),
        F.when(~F.col("checks.hallucination_below_threshold"), F.concat(F.lit("Hallucination score "), told("hallucination"), F.lit(" below threshold"))),
        F.when(~F.col("checks.memory_context_available"), F.lit("No memory context available for decision support")),
        F.when(ok(F.col("trading")) & ~F.col("approved"), F.lit("CRITICAL: Trading query detected but safety requirements not met")),
    ]
    return out.withColumn("warnings", F.array_compact(F.array(*warnings)))


# fixed values: words by which a query asks for entities, and for relations between things
ENTITY_WORDS = ("who", "what", "where", "when", "which")
RELATION_WORDS = ("relationship", "connection", "related", "similar", "compare")


def route(text: str) -> Column:
    """graph for queries that ask for entities, hybrid for long ones and those that ask for relations, else vector."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda w: w != "")
    has = lambda known: F.arrays_overlap(words, F.array(*map(F.lit, known)))
    return F.when(has(ENTITY_WORDS), "graph").when((F.size(words) > 10) | has(RELATION_WORDS), "hybrid").otherwise("vector")


def adaptive_retrieve(docs: DataFrame, queries: DataFrame, entities: DataFrame, edges: DataFrame, k: int = 10, penalty: float = 0.1, least: float = 0.0) -> DataFrame:
    """(qid, route, rank, key, score): the k best results of every query by the search that suits it.

    docs (id, text, v), queries (qid, text, v). vector: the k nearest memories; graph: the entities that the query names; hybrid: both, by 0.7 and
    0.3, without near copies. Then results lose up to `penalty` of their score for likeness with better ones, results
    are reranked by the mean of score and share of the query's terms, and those below `least` go. Ties by key.
    """
    routed = queries.withColumn("route", route("text"))
    near = exact_nearest(docs.select("id", "v"), routed.where("route <> 'graph'").select(F.col("qid").alias("id"), "v"), k).join(docs.select("id", "text"), "id")
    near = near.select("qid", F.concat(F.lit("memory:"), F.lpad(F.col("id").cast("string"), 19, "0")).alias("id"), "score", "rank", "text")
    hits = graph_hits(routed.where("route <> 'vector'"), entities, edges).withColumn("id", F.concat(F.lit("entity:"), "name"))
    first = Window.partitionBy("qid").orderBy(F.desc("score"), "id", "type")
    hits = hits.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("qid", "id", "score", "rank", F.concat(F.lit("Entity: "), "name", F.lit(" ("), "type", F.lit(")")).alias("text"))
    which = routed.select("qid", "route", F.col("text").alias("query"))
    of = lambda df, name: df.join(which.where(F.col("route") == name).select("qid"), "qid", "left_semi")
    mixed = merged_sources({"vector": (of(near, "hybrid"), 0.7), "graph": (of(hits, "hybrid"), 0.3)})
    texts = mixed.select("qid", "id", "text").dropDuplicates(["qid", "id"])
    kept = deduplicated(mixed).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).join(texts, ["qid", "id"])
    columns = ["qid", "id", "score", "rank", "text"]
    found = of(near, "vector").select(columns).unionByName(of(hits, "graph").select(columns)).unionByName(kept.select(columns))
    found = found.withColumn("text", F.coalesce("text", F.lit("")))
    spread = penalised(found, penalty).join(found.select("qid", "id", "text").dropDuplicates(["qid", "id"]), ["qid", "id"]).join(which, "qid")
    asked = terms("query")
    share = F.coalesce(F.try_divide(F.size(F.array_intersect(asked, terms("text"))), F.size(asked)), F.lit(0.0))
    scored = spread.withColumn("score", F.round((F.col("score") + share) / 2, 6)).where(F.col("score") >= least)
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", place).where(F.col("rank") <= k).select("qid", "route", "rank", F.col("id").alias("key"), "score")
