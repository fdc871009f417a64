"""Queries over chunking, enrichment and entities."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.register import chunked, register_chunker
from ..operators import chunking as C
from ..operators import enrichment as R
from ..operators import graph as G
from .base import WORDS
from .registry import query, table

W = WORDS.format("text")


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(f"SELECT doc_id, round(greatest(1.0, len({W}) * 1.3), 4) AS tokens FROM documents")
def estimate_tokens(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.round(C.estimated_tokens("text"), 4).alias("tokens"))


@query(f"""WITH w AS (SELECT doc_id, {W} AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 1 - 50, 0) + 1, 344)) AS s FROM w WHERE len(w) > 0)
SELECT doc_id, CAST(s // 344 AS INTEGER) AS chunk_no, md5(array_to_string(w[s + 1 : s + 394], ' ')) AS chunk FROM s""")
def chunk_token(spark, sf_dir):
    return C.token_chunks(docs(spark, sf_dir), 512, 50).select("doc_id", "chunk_no", F.md5("chunk").alias("chunk"))


@query("""WITH s AS (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 1 - 100, 0) + 1, 900)) AS s FROM documents)
SELECT doc_id, CAST(s // 900 AS INTEGER) AS chunk_no, md5(substring(text, CAST(s + 1 AS BIGINT), 1000)) AS chunk FROM s WHERE trim(substring(text, CAST(s + 1 AS BIGINT), 1000), ' ') <> ''""")
def chunk_chars(spark, sf_dir):
    return C.char_chunks(docs(spark, sf_dir), 1000, 100).select("doc_id", "chunk_no", F.md5("chunk").alias("chunk"))


@query(rf"""WITH RECURSIVE u AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x : trim(x, ' ') <> '') AS u FROM documents),
n AS (SELECT doc_id, u, list_transform(u, lambda text : 13 * len({W})) AS n FROM u WHERE len(u) > 0),
f AS (SELECT doc_id, 1 AS i, n[1] AS held, 0 AS chunk FROM n
  UNION ALL SELECT f.doc_id, i + 1, CASE WHEN held > 0 AND held + n[i + 1] > 640 THEN n[i + 1] ELSE held + n[i + 1] END, chunk + CASE WHEN held > 0 AND held + n[i + 1] > 640 THEN 1 ELSE 0 END
  FROM f JOIN n ON n.doc_id = f.doc_id WHERE i < len(n.n))
SELECT f.doc_id, chunk AS chunk_no, CAST(min(i) - 1 AS INTEGER) AS first_unit, CAST(max(i) - 1 AS INTEGER) AS last_unit, md5(any_value(u)[min(i)]) AS head FROM f JOIN n ON n.doc_id = f.doc_id GROUP BY f.doc_id, chunk""")
def chunk_line(spark, sf_dir):
    return C.line_chunks(docs(spark, sf_dir), 64).select("doc_id", "chunk_no", "first_unit", "last_unit", F.md5(F.split("chunk", "\n")[0]).alias("head"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
SELECT doc_id, CAST((i - 1) // 5 AS INTEGER) AS section, 'title ' || ((i - 1) // 5 + 1) AS title, CAST(count(*) AS INTEGER) AS n_lines FROM l GROUP BY doc_id, (i - 1) // 5""")
def chunk_section(spark, sf_dir):
    lines = F.split("text", "\n")
    marked = F.flatten(F.transform(lines, lambda x, i: F.when(i % 5 == 0, F.array(F.concat(F.lit("# title "), (i / 5 + 1).cast("int").cast("string")), x)).otherwise(F.array(x))))
    return C.sections(docs(spark, sf_dir).withColumn("text", F.array_join(marked, "\n")), "doc_id", header=lambda x, i: i % 6 == 0)  # the titles, and no line of a text


KIND = "element_at(array('txt', 'md', 'csv', 'json', 'pdf', 'txt', 'txt'), cast(doc_id % 7 + 1 as int))"


@query(r"""SELECT doc_id, CASE doc_id % 7 WHEN 1 THEN 'section' WHEN 2 THEN 'row' WHEN 3 THEN 'object' WHEN 4 THEN 'page' ELSE
  CASE WHEN length(text) < 1000 THEN 'token' WHEN len(string_split_regex(text, '\n\s*\n')) - 1 >= 3 THEN 'paragraph' ELSE 'semantic' END END AS strategy FROM documents""")
def chunk_auto(spark, sf_dir):
    return docs(spark, sf_dir).withColumn("file_type", F.expr(KIND)).select("doc_id", C.strategy("text", "file_type").alias("strategy"))


@query()
def chunk_auto_chunks(spark, sf_dir):
    return C.auto_chunks(docs(spark, sf_dir).withColumn("file_type", F.expr(KIND)), 128).select("doc_id", "strategy", "chunk_no", "chunk")


@query(f"""WITH w AS (SELECT doc_id, {W} AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, len(w), 394)) AS s FROM w WHERE len(w) > 0),
c AS (SELECT doc_id, w[s + 1 : s + 394] AS c FROM s)
SELECT doc_id, count(*) AS chunks, round(sum(greatest(1.0, len(c) * 1.3)), 4) AS tokens, round(avg(length(array_to_string(c, ' '))), 6) AS mean_chars FROM c GROUP BY 1""")
def chunk_stats(spark, sf_dir):
    return C.chunk_stats(C.token_chunks(docs(spark, sf_dir), 512), "doc_id")


TURN = WORDS.format("text")


@query(rf"""WITH RECURSIVE t AS (SELECT conv_id, turn, 13 * len({TURN}) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE trim(text, ' ') <> ''),
f AS (SELECT conv_id, i, n AS held, 0 AS c FROM t WHERE i = 1
  UNION ALL SELECT t.conv_id, t.i, CASE WHEN held > 0 AND held + n > 1280 THEN n ELSE held + n END, c + CASE WHEN held > 0 AND held + n > 1280 THEN 1 ELSE 0 END FROM f JOIN t ON t.conv_id = f.conv_id AND t.i = f.i + 1)
SELECT conv_id, c AS chunk_no, CAST(min(i) - 1 AS INTEGER) AS first_unit, CAST(max(i) - 1 AS INTEGER) AS last_unit FROM f GROUP BY conv_id, c""")
def pack_units(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))  # the turns of one conversation
    return C.unit_chunks(turns.withColumn("u", F.col("t.text")), F.col("u"), 128, "\n").select("conv_id", "chunk_no", "first_unit", "last_unit")


@query("SELECT doc_id, 'source: ' || source || ' | lang: ' || lang || CASE WHEN doc_id % 3 = 0 THEN ' | page: ' || doc_id ELSE '' END AS about FROM documents")
def build_chunk_context(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", R.context({"source": F.col("source"), "lang": F.col("lang"), "page": F.when(F.expr("doc_id % 3 = 0"), F.col("doc_id"))}).alias("about"))


def _has(pattern, text="lower(text)"):
    return f"regexp_matches({text}, '{pattern}')"


PLAIN = r"regexp_replace(text, '[^\x00-\x7F]', '_', 'g')"
_any = lambda words, text='lower(text)': '(' + ' OR '.join(f"contains({text}, '{w}')" for w in words) + ')'
TAG_SQL = "array_to_string(list_filter([" + ", ".join([f"CASE WHEN {_any(ws, 'text' if n in R.AS_WRITTEN else 'lower(text)')} THEN '{n}' END" for n, ws in R.TAGS.items()] + [f"CASE WHEN {_has(R.NUMERIC, 'text')} THEN 'numeric' END"]) + "], lambda x : x IS NOT NULL), ',')"
RISK_SQL = f"greatest(0.0, least(1.0, 0.1 + {' + '.join(f"CASE WHEN contains(lower(text), '{w}') THEN 0.1 ELSE 0 END" for w in R.SPECULATIVE)} + CASE WHEN {_any(R.SWEEPING)} THEN 0.2 ELSE 0 END - CASE WHEN {_any(R.ATTRIBUTION, 'text')} THEN 0.1 ELSE 0 END - CASE WHEN {_has(R.PRECISE, 'text')} THEN 0.05 ELSE 0 END))"
CONF_SQL = f"greatest(0.0, least(1.0, 0.7 + CASE WHEN length(text) < 50 THEN -0.1 WHEN length(text) > 500 THEN 0.1 ELSE 0 END - CASE WHEN {_any(R.UNCERTAIN)} THEN 0.15 ELSE 0 END + CASE WHEN {_any(R.DEFINITIVE)} THEN 0.1 ELSE 0 END))"


def _tagged(spark, sf_dir):
    """documents with words that the rules know in some of them."""
    more = "concat(text, element_at(array('', ' For example, step 4.', ' It could possibly be 3.5?', ' This is clearly proven, obviously.', ' Perhaps, allegedly, it might.', ' It is so according to the API definition: AB.'), cast(doc_id % 6 + 1 as int)))"
    return docs(spark, sf_dir).withColumn("text", F.expr(more))


D = "d AS (SELECT doc_id, text || (['', ' For example, step 4.', ' It could possibly be 3.5?', ' This is clearly proven, obviously.', ' Perhaps, allegedly, it might.', ' It is so according to the API definition: AB.'])[doc_id % 6 + 1] AS text FROM documents)"


@query(f"WITH {D} SELECT doc_id, {TAG_SQL} AS tags FROM d")
def tag_content(spark, sf_dir):
    return _tagged(spark, sf_dir).select("doc_id", F.array_join(R.tags("text"), ",").alias("tags"))


@query(f"WITH {D} SELECT doc_id, CAST(round({CONF_SQL}, 6) AS DOUBLE) AS confidence FROM d")
def estimate_confidence(spark, sf_dir):
    return _tagged(spark, sf_dir).withColumn("about", F.lit("")).select("doc_id", F.round(R.confidence("text", "about"), 6).alias("confidence"))


@query(f"WITH {D} SELECT doc_id, CAST(round({RISK_SQL}, 6) AS DOUBLE) AS risk FROM d")
def estimate_hallucination_risk(spark, sf_dir):
    return _tagged(spark, sf_dir).select("doc_id", F.round(R.risk("text"), 6).alias("risk"))


@query(f"""WITH {D}, q AS (SELECT doc_id % 97 AS document, count(*) AS chunks, CAST(round(avg(CAST({CONF_SQL} AS DOUBLE)), 6) AS DOUBLE) AS confidence, CAST(round(avg(CAST({RISK_SQL} AS DOUBLE)), 6) AS DOUBLE) AS risk FROM d GROUP BY 1)
SELECT *, CASE WHEN confidence < 0.5 AND confidence > 0 THEN 'low_confidence' || CASE WHEN risk > 0.5 THEN ',high_hallucination_risk' ELSE '' END WHEN risk > 0.5 THEN 'high_hallucination_risk' ELSE '' END AS flags FROM q""")
def rollup_document_quality(spark, sf_dir):
    chunks = _tagged(spark, sf_dir).withColumn("about", F.lit("")).select(F.expr("doc_id % 97").alias("document"), R.confidence("text", "about").alias("confidence"), R.risk("text").alias("risk"))
    return R.document_quality(chunks, "document")


ENTITY = r"\b[A-Z][a-z]+(?:[ \t\n\x0B\f\r]+[A-Z][a-z]+)*\b"
# Java's word boundaries know all letters, RE2's only ASCII ones: there, other characters count as _
MENTIONS = rf"""f AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', '_', 'g'), '{ENTITY}') AS found FROM documents),
x AS (SELECT doc_id, unnest(found) AS name, generate_subscripts(found, 1) AS i FROM f),
n AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) AS ordinal FROM x GROUP BY doc_id, name)"""


def entity_mentions(spark, sf_dir):
    return G.mentions(docs(spark, sf_dir).select("doc_id", "text"), "doc_id", "text")


@query(f"WITH {MENTIONS} SELECT doc_id, name, CAST(ordinal AS INTEGER) AS ordinal, 'PERSON' AS type FROM n")
def extract_entities(spark, sf_dir):
    return entity_mentions(spark, sf_dir).select("doc_id", "name", "ordinal", "type")


@query(f"WITH {MENTIONS}, p AS (SELECT doc_id, name, lead(name) OVER (PARTITION BY doc_id ORDER BY ordinal) AS other FROM n) SELECT doc_id, name AS src, other AS dst FROM p WHERE other IS NOT NULL")
def link_co_mentions(spark, sf_dir):
    return G.co_mentions(entity_mentions(spark, sf_dir), "doc_id").select("doc_id", "src", "dst")


@query(f"""WITH b AS (SELECT item_id, text || ' "' || left(text, 10) || '"' AS text FROM benchmark)
SELECT item_id, array_to_string(list_sort(list_distinct(regexp_extract_all({PLAIN}, '{ENTITY}') || regexp_extract_all(text, '"([^"]*)"', 1))), '|') AS entities FROM b""")
def extract_query_entities(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.expr("""concat(text, ' "', left(text, 10), '"')""").alias("text"))
    return asked.select("item_id", F.array_join(F.array_sort(G.query_entities("text")), "|").alias("entities"))


@query("""SELECT item_id, array_to_string(list_filter(string_split(lower(text), ' '), lambda w : length(w) > 2 AND w NOT IN ('the', 'and', 'for', 'that', 'with'))[1:5], ' ') AS keywords FROM benchmark""")
def extract_keywords(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(G.keywords("text", ("the", "and", "for", "that", "with")), " ").alias("keywords"))


@query(r"SELECT doc_id, unnest(regexp_extract_all(text, '\$?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?[KMB]?')) AS number FROM documents")
def extract_numbers(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.explode(G.numbers("text")).alias("number"))


@query(f"WITH {MENTIONS} SELECT name, count(*) AS source_count, min(doc_id) AS first_seen, max(doc_id) AS last_seen FROM n GROUP BY name")
def upsert_entities(spark, sf_dir):
    return G.merged_entities(entity_mentions(spark, sf_dir), "doc_id").select("name", "source_count", "first_seen", "last_seen")


EDGES = f"""{MENTIONS}, p AS (SELECT doc_id, name, lead(name) OVER (PARTITION BY doc_id ORDER BY ordinal) AS other FROM n),
r AS (SELECT name AS src, other AS dst, count(*) AS source_count FROM p WHERE other IS NOT NULL AND name <> other GROUP BY ALL),
g AS (SELECT * FROM r), both AS (SELECT src AS a, dst AS b FROM g UNION SELECT dst, src FROM g)""".replace("both AS", "sym AS")


def entity_edges(spark, sf_dir):
    """Edges between all entities that follow each other in a document."""
    return G.merged_edges(G.following(docs(spark, sf_dir), "text").where("dst is not null"))


@query(f"WITH {EDGES} SELECT src, dst, source_count FROM g")
def upsert_relationships(spark, sf_dir):
    return entity_edges(spark, sf_dir).select("src", "dst", "source_count")


@query(f"WITH {EDGES} SELECT a AS name, count(*) AS degree FROM sym GROUP BY 1")
def graph_degree(spark, sf_dir):
    return G.degrees(entity_edges(spark, sf_dir))


SEEDS = "s AS (SELECT DISTINCT a AS name FROM sym ORDER BY 1 LIMIT 5)"


@query(f"WITH {EDGES}, {SEEDS}, h1 AS (SELECT s.name AS seed, b AS name FROM s JOIN sym ON a = s.name), h2 AS (SELECT seed, b AS name FROM h1 JOIN sym ON a = h1.name), u AS (SELECT *, 1 AS depth FROM h1 UNION ALL SELECT *, 2 FROM h2) SELECT seed, name, min(depth) AS depth FROM u WHERE name <> seed GROUP BY 1, 2")
def connected_entities(spark, sf_dir):
    edges = entity_edges(spark, sf_dir)
    return G.reached(edges, G.degrees(edges).orderBy("name").limit(5).select("name"), 2)


@query(f"""WITH RECURSIVE {EDGES}, cc(name, component) USING KEY (name) AS (SELECT DISTINCT a, a FROM sym
  UNION SELECT sym.b, min(cc.component) FROM cc JOIN sym ON sym.a = cc.name JOIN recurring.cc AS r ON r.name = sym.b WHERE cc.component < r.component GROUP BY sym.b)
SELECT name, component FROM cc""")
def connected_components(spark, sf_dir):
    return G.components(entity_edges(spark, sf_dir))


@query(f"""WITH {EDGES}, l AS (SELECT a, list(b ORDER BY b) AS bs FROM sym GROUP BY 1), d AS (SELECT min(a) AS a, any_value(len(bs)) AS n, count(*) AS members FROM l GROUP BY bs), s AS (SELECT * FROM sym WHERE a IN (SELECT a FROM d)),
pp AS (SELECT x.a AS a, y.a AS b, count(*) AS common FROM s x JOIN s y ON x.b = y.b AND x.a < y.a GROUP BY ALL)
SELECT pp.a, pp.b, x.members AS members_a, y.members AS members_b, round(common / (x.n + y.n - common)::DOUBLE, 6) AS similarity FROM pp JOIN d x ON x.a = pp.a JOIN d y ON y.a = pp.b WHERE common >= 0.5 * (x.n + y.n - common)
UNION ALL SELECT min(a) OVER (PARTITION BY bs), a, count(*) OVER (PARTITION BY bs), count(*) OVER (PARTITION BY bs), 1.0 FROM l QUALIFY min(a) OVER (PARTITION BY bs) <> a""")
def entity_similarity(spark, sf_dir):
    """Pairs of classes of entities, and of every class its members by their smallest one: no similar pair is lost."""
    edges = G.cut(entity_edges(spark, sf_dir))
    return G.neighbour_similarity(edges, 0.5).unionByName(G.same_neighbours(edges))


PAGES = ", ".join(
    f"""gv{i} AS (SELECT dst, sum(rank / deg) AS got FROM r{i} JOIN g ON src = name JOIN (SELECT src AS s, count(*) AS deg FROM g GROUP BY 1) ON s = src GROUP BY 1), lo{i} AS (SELECT 1 - coalesce(sum(got), 0) AS lost FROM gv{i}),
r{i + 1} AS (SELECT name, (1 - 0.85::DOUBLE) / n + 0.85::DOUBLE * (coalesce(got, 0) + lost / n) AS rank, n FROM r{i} LEFT JOIN gv{i} ON dst = name, lo{i})"""
    for i in range(8)
)


@query(f"WITH {EDGES}, nn AS (SELECT DISTINCT a AS name FROM sym), r0 AS (SELECT name, 1.0::DOUBLE / count(*) OVER () AS rank, count(*) OVER () AS n FROM nn), {PAGES} SELECT name, round(rank, 9) AS rank FROM r8")
def pagerank(spark, sf_dir):
    return G.pagerank(entity_edges(spark, sf_dir), 8).select("name", F.round("rank", 9).alias("rank"))


VOTES = ", ".join(f"l{i + 1} AS (SELECT a AS name, label FROM (SELECT sym.a, l{i}.label, count(*) AS n FROM sym JOIN l{i} ON l{i}.name = sym.b GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, label) = 1)" for i in range(4))


@query(f"WITH {EDGES}, l0 AS (SELECT DISTINCT a AS name, a AS label FROM sym), {VOTES} SELECT name, label FROM l4")
def label_propagation(spark, sf_dir):
    return G.communities(entity_edges(spark, sf_dir), 4)


@query(f"WITH {EDGES}, t AS (SELECT count(*) AS edges FROM g), v AS (SELECT count(DISTINCT a) AS entities FROM sym) SELECT entities, edges, round(edges / entities::DOUBLE, 6) AS edges_per_entity FROM t, v")
def graph_statistics(spark, sf_dir):
    return G.statistics(entity_edges(spark, sf_dir))


@query(f"WITH {EDGES}, {SEEDS} SELECT src, dst FROM g WHERE src IN (FROM s) OR dst IN (FROM s)")
def entity_relationships(spark, sf_dir):
    edges = entity_edges(spark, sf_dir)
    return G.touching(edges, G.degrees(edges).orderBy("name").limit(5).select("name")).select("src", "dst")


@query(f"WITH {MENTIONS}, q AS (SELECT DISTINCT name FROM n ORDER BY 1 LIMIT 30), k AS (SELECT n.name, doc_id, row_number() OVER (PARTITION BY n.name ORDER BY doc_id) AS i FROM n JOIN q ON q.name = n.name) SELECT name, doc_id FROM k WHERE i <= 10")
def memories_for_entities(spark, sf_dir):
    found = entity_mentions(spark, sf_dir)
    return G.mentioning(found, found.select("name").distinct().orderBy("name").limit(30), "doc_id", 10)


@query("SELECT doc_id, md5(left(text, 10000)) AS body, 'memory' AS type FROM documents")
def add_episodes(spark, sf_dir):
    return G.episodes(docs(spark, sf_dir).withColumn("at", F.lit("2024-01-01").cast("timestamp")), "text", "at").select("doc_id", F.md5("body").alias("body"), "type")


def by_blank_lines(text: str):
    """A user's chunker: what stands between blank lines."""
    return [part.strip(" ") for part in re.split(r"\n[ \t\n\x0b\x0c\r]*\n", text) if part.strip(" ")]


@query(r"""WITH x AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n[ \t\n\x0B\f\r]*\n'), lambda p : trim(p, ' ')), lambda p : p <> '') AS ps FROM documents)
SELECT doc_id, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS chunk_no, md5(unnest(ps)) AS chunk FROM x""")
def user_chunker(spark, sf_dir):
    """A chunker that a user registers, as a table function over all documents."""
    register_chunker(spark, "blank_line_chunks", by_blank_lines)
    return chunked(docs(spark, sf_dir), "blank_line_chunks", "doc_id").select("doc_id", "chunk_no", F.md5("chunk").alias("chunk"))
