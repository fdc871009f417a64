"""Vector, keyword and hybrid search over query sets, merging and reranking, confidence and grounding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.vectors import cosine, jaccard
from ..sources.scratch import Scratch, sized
from .vectors import exact_nearest

# fixed values: the stop words of the keyword search
STOP = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "were", "will", "with")


def terms(text: str | Column) -> Column:
    """Distinct lower-case words of letters and digits, without stop words."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)), F.array(*map(F.lit, STOP)))


def ranked(df: DataFrame, by: str, *keys: str, tie: str = "id", most: int | None = None) -> DataFrame:
    """The rows of each key in descending order of a score, numbered as rank."""
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(by), tie)))
    return out if most is None else out.where(F.col("rank") <= most)


def nearest(corpus: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """The k rows nearest to the one query vector, by cosine: per-partition heaps, no full sort."""
    score = V.cosine("v", "q")
    return corpus.crossJoin(F.broadcast(query.select(F.col("v").alias("q")))).select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)  # one query row


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("id"), F.explode_outer(terms(text)).alias("term")).where("term is not null")  # outer as in `unrolled`


def keyword_matches(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, id) of documents that hold all terms of a query; a query without terms finds nothing.

    Each query meets the documents by its rarest term only, and the rest of its terms are looked up in those documents.
    """
    asked = queries.select("qid", terms("text").alias("t")).where(F.size("t") > 0)
    wanted = asked.select("qid", F.explode("t").alias("term"))
    vocabulary = sized(wanted.select("term").distinct(), 64)
    held = Scratch(docs.sparkSession).write(postings(docs, "id", "text").join(vocabulary, "term"), "postings")  # one pass over the texts
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    rare = wanted.join(df, "term", "left").groupBy("qid").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("x")).where("x.df > 0").select("qid", "x.term")
    found = held.join(sized(rare, 64), "term").select("qid", "id")
    whole = found.join(asked, "qid").join(docs.select("id", "text"), "id")
    return whole.where(F.size(F.array_intersect("t", terms("text"))) == F.size("t")).select("qid", "id")


def text_rank(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, id, text_rank) of documents that hold all terms of a query: the sum over minimal covers of 0.1 / (1 + noise).

    A cover is a shortest stretch of the text with all terms; noise counts the other words in it. With one term that is 0.1
    for each time it occurs. Words are taken as they are written (lower case): there is no stemming.
    """
    asked = queries.select("qid", terms("text").alias("t"))
    own = keyword_matches(docs, queries).join(asked, "qid").join(docs.select("id", "text"), "id")
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0)
    at = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("pos"), F.array_position("t", w).cast("int").alias("term"))), lambda x: x["term"] > 0)
    return own.select("qid", "id", F.size("t").alias("need"), at.alias("at")).select("qid", "id", covered("at", "need").alias("text_rank"))


def covered(at: str, need: str) -> Column:
    """One pass over occurrences (pos, term) in order: a cover ends where the earliest of the terms' last places moves on."""
    nowhere = F.struct(F.lit(-1).alias("pos"), F.lit(-1).alias("i"))
    start = F.struct(F.array_repeat(nowhere, F.col(need)).alias("last"), F.lit(0).alias("i"), F.lit(-1).alias("begun"), F.lit(0.0).alias("rank"))

    def step(acc, x):
        last = F.transform(acc["last"], lambda y, j: F.when(j + 1 == x["term"], F.struct(x["pos"].alias("pos"), acc["i"].alias("i"))).otherwise(y))
        return F.struct(last.alias("last"), (acc["i"] + 1).alias("i"), acc["begun"].alias("begun"), acc["rank"].alias("rank"), x["pos"].alias("pos"))

    def close(acc):
        first = F.array_min(acc["last"])
        new = (first["pos"] >= 0) & (first["pos"] > acc["begun"])
        noise = (acc["pos"] - first["pos"]) - (acc["i"] - 1 - first["i"])
        return F.struct(acc["last"], acc["i"], F.when(new, first["pos"]).otherwise(acc["begun"]).alias("begun"), F.when(new, acc["rank"] + 0.1 / (1 + noise)).otherwise(acc["rank"]).alias("rank"))

    return F.aggregate(at, start, lambda acc, x: close(step(acc, x)), lambda acc: acc["rank"])


def hybrid_scan(docs: DataFrame, queries: DataFrame, k: int, weight: float = 0.7, far: float = 0.8) -> DataFrame:
    """(qid, id, score, rank): the k best by weight * cosine + (1 - weight) * text rank.

    Candidates are rows that match all terms or whose cosine distance is below `far`. docs and queries: id or qid, text, v.
    A row that does not match counts by its cosine alone, so that the k nearest and the matches hold the k best; a query
    without terms is a search by vectors alone. Rows without a vector can only match.
    """
    near = exact_nearest(docs.select("id", "v"), queries.select(F.col("qid").alias("id"), "v"), k).where(F.col("score") > 1 - far).select("qid", "id", F.col("score").alias("near"))
    matched = text_rank(docs, queries)
    pairs = matched.join(docs.select("id", "v"), "id").join(queries.select("qid", F.col("v").alias("q")), "qid")
    matched = pairs.select("qid", "id", "text_rank", cosine("v", "q").alias("own"))
    both = near.join(matched, ["qid", "id"], "full_outer")
    score = F.round(weight * F.coalesce("own", "near", F.lit(0.0)) + (1 - weight) * F.coalesce("text_rank", F.lit(0.0)), 8)
    return ranked(both.select("qid", "id", score.alias("score")), "score", "qid", most=k)


def deduplicated(results: DataFrame, least: float = 0.9) -> DataFrame:
    """Each query's results (qid, place, id, score, text) without near copies, taken in order of place, as (qid, id, score, place).

    A result whose word set has a Jaccard similarity above `least` with one that is kept is a copy of the first such: the
    higher score stays, a replacement at the end of the list; on equal scores the kept one stays. Texts without words
    are copies of each other. place is that in the new list. A query's results are few (a top-k list).
    """
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != ""))
    own = results.select("qid", F.struct("place", "id", "score", F.coalesce(words, F.array().cast("array<string>")).alias("words")).alias("x"))
    lists = own.groupBy("qid").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    kind = lists.schema["xs"].dataType.simpleString()

    def step(kept, x):
        copy = lambda u: F.when((F.size(u["words"]) == 0) & (F.size(x["words"]) == 0), True).otherwise(F.coalesce(jaccard(u["words"], x["words"]), F.lit(0.0)) > least)
        at = F.array_position(F.transform(kept, copy), F.lit(True)).cast("int")
        better = x["score"] > F.element_at(kept, F.greatest(at, F.lit(1)))["score"]
        instead = F.concat(F.filter(kept, lambda u, i: i != at - 1), F.array(x))
        return F.when(F.size(kept) == 0, F.array(x)).when(at == 0, F.concat(kept, F.array(x))).when(better, instead).otherwise(kept)

    folded = lists.select("qid", F.posexplode(F.aggregate("xs", F.array().cast(kind), step)).alias("place", "x"))
    return folded.select("qid", "x.id", "x.score", (F.col("place") + 1).alias("place"))


def merged_sources(sources: dict[str, tuple[DataFrame, float]]) -> DataFrame:
    """(qid, place, id, score, source, text): ranked lists (qid, id, score, rank, text) one after the other, each score by its weight."""
    parts = [df.select("qid", F.lit(i).alias("part"), "rank", "id", F.round(F.col("score") * weight, 8).alias("score"), F.lit(name).alias("source"), "text") for i, (name, (df, weight)) in enumerate(sources.items())]
    both = reduce(DataFrame.unionByName, parts)
    return both.select("qid", F.row_number().over(Window.partitionBy("qid").orderBy("part", "rank", "id")).alias("place"), "id", "score", "source", "text")


def overlap(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, id, score): the share of a query's terms that a document holds."""
    wanted = queries.select("qid", terms("text").alias("t")).select("qid", F.size("t").alias("need"), F.explode("t").alias("term"))
    hit = postings(docs, "id", "text").join(wanted, "term").groupBy("qid", "id", "need").agg(F.count("*").alias("n"))
    return hit.select("qid", "id", F.round(F.col("n") / F.col("need"), 6).alias("score"))


def fused(left: DataFrame, right: DataFrame, weight: float, k: int) -> DataFrame:
    """Weighted sum of two ranked lists per query; a row missing on one side scores 0 there."""
    both = left.select("qid", "id", F.col("score").alias("x")).join(right.select("qid", "id", F.col("score").alias("y")), ["qid", "id"], "full_outer")
    score = F.round(weight * F.coalesce("x", F.lit(0.0)) + (1 - weight) * F.coalesce("y", F.lit(0.0)), 8)
    return ranked(both.select("qid", "id", score.alias("score")), "score", "qid", most=k)


def reciprocal(left: DataFrame, right: DataFrame, base: int = 60) -> DataFrame:
    """Reciprocal rank fusion; a missing rank counts as one past the end of that list."""
    size = lambda df, n: df.groupBy("qid").agg((F.max("rank") + 1).alias(n))
    both = left.select("qid", "id", F.col("rank").alias("r1")).join(right.select("qid", "id", F.col("rank").alias("r2")), ["qid", "id"], "full_outer")
    both = both.join(size(left, "e1"), "qid", "left").join(size(right, "e2"), "qid", "left")
    part = lambda r, e: 1 / (base + F.coalesce(r, e, F.lit(1)))
    return both.select("qid", "id", F.round(part("r1", "e1") + part("r2", "e2"), 6).alias("score"))


def min_max(df: DataFrame, by: str, *keys: str) -> DataFrame:
    """The score scaled to 0..1 within each key; constant lists stay as they are."""
    w = Window.partitionBy(*keys)
    low, high = F.min(by).over(w), F.max(by).over(w)
    return df.withColumn("scaled", F.when(high > low, (F.col(by) - low) / (high - low)).otherwise(F.col(by)))


def penalised(results: DataFrame, penalty: float) -> DataFrame:
    """score * (1 - penalty * largest word Jaccard with an earlier result of the query)."""
    own = results.withColumn("w", F.array_distinct(F.split(F.lower("text"), " ")))
    before = own.select("qid", F.col("rank").alias("r"), F.col("w").alias("u"))
    worst = own.join(before, "qid").where("r < rank").groupBy("qid", "id").agg(F.max(V.jaccard("w", "u")).alias("most"))
    out = own.join(worst, ["qid", "id"], "left")
    return out.select("qid", "id", F.round(F.col("score") * (1 - penalty * F.coalesce("most", F.lit(0.0))), 6).alias("score"))


def level(x: Column) -> Column:
    """rock_solid from 95, high from 80, fuzzy from 60, else low."""
    return F.when(x >= 95, "rock_solid").when(x >= 80, "high").when(x >= 60, "fuzzy").otherwise("low")


def combined_confidence(results: DataFrame) -> DataFrame:
    """Per query: the mean of the best three scores as per cent, raised if all are above 0.8, lowered if there are fewer."""
    best = F.slice(F.sort_array(F.collect_list("score"), False), 1, 3)  # a query's few results
    own = results.groupBy("qid").agg(best.alias("b"))
    n = F.size("b")
    source = F.aggregate("b", F.lit(0.0), lambda a, x: a + x) / n * 100
    source = F.when((n == 3) & F.forall("b", lambda x: x > 0.8), F.least(F.lit(100.0), source * 1.1)).when(n < 3, source * (0.7 + 0.1 * n)).otherwise(source)
    total = 0.4 * source + 0.3 * source + 0.3 * 70
    return own.select("qid", F.round(total, 6).alias("confidence"), level(total).alias("level"))


def claims(answers: DataFrame, *keys: str) -> DataFrame:
    """Sentences longer than ten characters, numbered."""
    parts = F.filter(F.transform(F.split("text", "[.!?]+"), lambda x: F.trim(x)), lambda x: F.length(x) > 10)
    return answers.select(*keys, F.posexplode(parts).alias("claim_no", "claim"))


def grounding(evidence: DataFrame, *keys: str) -> DataFrame:
    """Mean of the three best similarities of each claim."""
    top = ranked(evidence, "similarity", *keys, "claim_no", most=3)
    return top.groupBy(*keys, "claim_no").agg(F.round(F.avg("similarity"), 6).alias("grounding"))


def scored_evidence(evidence: DataFrame, query: str | None = None) -> DataFrame:
    """Evidence (claim, text, similarity) with its relevance and confidence.

    Relevance adds to the similarity a tenth of the share of the claim's words that the text holds and a twentieth of
    that of the column `query`; texts beyond 1000 characters lose a twentieth. Null texts and queries hold no words.
    """
    words = lambda c: F.array_distinct(F.split(F.lower(F.coalesce(c, F.lit(""))), " "))
    share = lambda c: F.size(F.array_intersect(words(F.col(c)), words(F.col("text")))) / F.greatest(F.size(words(F.col(c))), F.lit(1))
    close = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("similarity", F.lit(0.0))))
    more = close + 0.1 * share("claim") + (0.05 * F.when(F.length(query) > 0, share(query)).otherwise(0.0) if query else 0.0)
    relevance = F.least(F.lit(1.0), more * F.when(F.length("text") > 1000, 0.95).otherwise(1.0))
    out = evidence.withColumn("similarity", close).withColumn("relevance", relevance)
    return out.withColumn("confidence", 1 / (1 + F.exp(-10 * (0.7 * F.col("similarity") + 0.3 * F.col("relevance") - 0.5))))


def answer_confidence(evidence: DataFrame, *keys: str) -> DataFrame:
    """Confidence of every answer from its scored evidence: n_claims, n_strong, spread, confidence.

    The mean grounding of the claims, a twentieth more for each strong piece of evidence (a fifth at most), less a
    twentieth where the first five pieces (by claim, then by confidence) vary by over 0.1, and less for over five claims.
    """
    claims = grounding(evidence, *keys).groupBy(*keys).agg(F.avg("grounding").alias("g"), F.count("*").alias("n_claims"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("claim_no", F.desc("confidence"), "id"))
    first = F.when(F.col("__place") <= 5, F.col("confidence"))
    pieces = evidence.withColumn("__place", place).groupBy(*keys).agg(F.count_if(F.col("confidence") > 0.8).alias("n_strong"), F.var_pop(first).alias("spread"))
    n = F.col("n_claims")
    value = (F.col("g") + F.least(F.lit(0.2), 0.05 * F.col("n_strong"))) * F.when(F.col("spread") > 0.1, 0.95).otherwise(1.0) * F.when(n > 5, F.greatest(F.lit(0.8), 1 - 0.02 * (n - 5))).otherwise(1.0)
    value = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)), 6)
    return claims.join(pieces, list(keys)).select(*keys, "n_claims", "n_strong", F.round("spread", 6).alias("spread"), value.alias("confidence"))
