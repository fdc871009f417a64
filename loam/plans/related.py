"""Queries over typed relationships: customers, parts, suppliers, nations and regions as a property graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relations as G
from ..sources.scratch import Scratch
from .registry import query, table

LONG_AGO = "timestamp'1990-01-01 00:00:00'"


def relationships(spark, sf_dir):
    """Edges of the property graph: places, purchases (order lines) and supplies."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", "l_linestatus", "l_quantity")
    open_end = "case when count_if(l_linestatus = 'O') = 0 then max(l_shipdate) end"
    ends = lambda a, b: [F.expr(a).alias("src"), F.expr(b).alias("dst"), "valid_from", "valid_to", "confidence"]
    bought = lines.drop("l_suppkey").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate"), "l_orderkey")
    bought = bought.groupBy("o_custkey", "l_partkey").agg(F.min("o_orderdate").alias("valid_from"), F.expr(open_end).alias("valid_to"), F.expr("max(l_quantity) / 50").alias("confidence"))
    bought = bought.select(ends("concat('customer:', o_custkey)", "concat('part:', l_partkey)"))  # numbers are grouped, and named then
    supplied = lines.groupBy("l_partkey", "l_suppkey").agg(F.min("l_shipdate").alias("valid_from"), F.expr(open_end).alias("valid_to"), F.expr("max(l_quantity) / 50").alias("confidence"))
    supplied = supplied.select(ends("concat('part:', l_partkey)", "concat('supplier:', l_suppkey)"))
    places = [("customer", "concat('customer:', c_custkey)", "concat('nation:', c_nationkey)", "IN"), ("supplier", "concat('supplier:', s_suppkey)", "concat('nation:', s_nationkey)", "IN"), ("nation", "concat('nation:', n_nationkey)", "concat('region:', n_regionkey)", "PART_OF")]
    columns = ["src", "dst", "cast(valid_from as timestamp) as valid_from", "cast(valid_to as timestamp) as valid_to", "confidence", f"coalesce(cast(valid_from as timestamp), {LONG_AGO}) as created_at"]
    out = bought.withColumn("type", F.lit("BOUGHT")).unionByName(supplied.withColumn("type", F.lit("SUPPLIED_BY")))
    for name, src, dst, kind in places:
        out = out.unionByName(table(spark, sf_dir, name).selectExpr(f"{src} as src", f"{dst} as dst", "cast(null as timestamp) as valid_from", "cast(null as timestamp) as valid_to", "1D as confidence", f"'{kind}' as type"))
    return out.where("src is not null and dst is not null").selectExpr("type", *columns).withColumn("rel_id", F.concat_ws("|", "src", "type", "dst"))


RL = """rl AS (SELECT *, src || '|' || type || '|' || dst AS rel_id, coalesce(valid_from, TIMESTAMP '1990-01-01') AS created_at FROM (
  SELECT 'customer:' || o_custkey AS src, 'part:' || l_partkey AS dst, 'BOUGHT' AS type, min(o_orderdate) AS valid_from, CASE WHEN count(*) FILTER (l_linestatus = 'O') = 0 THEN max(l_shipdate) END AS valid_to, max(l_quantity) / 50 AS confidence FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2
  UNION ALL SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'SUPPLIED_BY', min(l_shipdate), CASE WHEN count(*) FILTER (l_linestatus = 'O') = 0 THEN max(l_shipdate) END, max(l_quantity) / 50 FROM lineitem GROUP BY 1, 2
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'IN', NULL, NULL, 1.0 FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'IN', NULL, NULL, 1.0 FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'PART_OF', NULL, NULL, 1.0 FROM nation)),
nd AS (SELECT name, split_part(name, ':', 1) AS type, coalesce(min(valid_from), TIMESTAMP '1990-01-01') AS created_at FROM (SELECT src AS name, valid_from FROM rl UNION ALL SELECT dst, valid_from FROM rl) GROUP BY 1)"""
#: the asked customers: every twentieth
ASKED = "q AS (SELECT 'customer:' || c_custkey AS name FROM customer WHERE c_custkey % 20 = 0)"


def entities(edges):
    """Everything that an edge names, with the kind in its name and when it first came up."""
    ends = edges.select(F.col("src").alias("name"), "valid_from").union(edges.select("dst", "valid_from"))
    return ends.groupBy("name").agg(F.coalesce(F.min("valid_from"), F.expr(LONG_AGO)).alias("created_at")).withColumn("type", F.substring_index("name", ":", 1))


def asked(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_custkey % 20 = 0").selectExpr("concat('customer:', c_custkey) as name")


STEP = "st AS (SELECT src AS a, dst AS b, rel_id FROM rl WHERE src <> dst UNION ALL SELECT dst, src, rel_id FROM rl WHERE src <> dst)"


@query(f"""WITH {RL}, {STEP}, p AS (SELECT 'customer:' || c_custkey AS src, 'part:' || (c_custkey * 7 % (SELECT count(*) FROM part) + 1) AS dst FROM customer WHERE c_custkey % 20 = 0),
f1 AS (SELECT src, dst, b AS node, min([rel_id]) AS path FROM p JOIN st ON a = src GROUP BY 1, 2, 3),
f2 AS (SELECT src, dst, b AS node, min(path || [rel_id]) AS path FROM f1 JOIN st ON a = node WHERE b <> src GROUP BY 1, 2, 3),
b1 AS (SELECT src, dst, b AS node, min([rel_id]) AS path FROM p JOIN st ON a = dst GROUP BY 1, 2, 3),
m AS (SELECT src, dst, 1 AS length, path FROM f1 WHERE node = dst UNION ALL SELECT f1.src, f1.dst, 2, f1.path || b1.path FROM f1 JOIN b1 ON f1.src = b1.src AND f1.dst = b1.dst AND f1.node = b1.node
  UNION ALL SELECT f2.src, f2.dst, 3, f2.path || b1.path FROM f2 JOIN b1 ON f2.src = b1.src AND f2.dst = b1.dst AND f2.node = b1.node)
SELECT src, dst, length, array_to_string(path, ' ') AS path FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY length, path) AS i FROM m) WHERE i = 1""")
def shortest_path(spark, sf_dir):
    parts = table(spark, sf_dir, "part").count()
    pairs = table(spark, sf_dir, "customer").where("c_custkey % 20 = 0").selectExpr("concat('customer:', c_custkey) as src", f"concat('part:', c_custkey * 7 % {parts} + 1) as dst")
    return G.shortest_paths(relationships(spark, sf_dir), pairs, 3).select("src", "dst", "length", F.array_join("path", " ").alias("path"))


@query(f"""WITH RECURSIVE {RL}, {ASKED}, r AS (SELECT name AS seed, name, nd.type, 0 AS depth, 1.0::DOUBLE AS confidence, [name] AS path FROM nd SEMI JOIN q USING (name)
  UNION ALL SELECT seed, n.name, n.type, depth + 1, least(r.confidence, e.confidence), path || [e.type, n.name] FROM r JOIN rl e ON e.src = r.name JOIN nd n ON n.name = e.dst
  WHERE depth < 3 AND e.type IN ('BOUGHT', 'SUPPLIED_BY', 'IN') AND n.type IN ('part', 'supplier', 'nation') AND e.confidence >= 0.8)
SELECT seed, name, type, depth, round(confidence, 6) AS confidence, array_to_string(path, ' ') AS path FROM (SELECT *, row_number() OVER (PARTITION BY seed, name ORDER BY depth, path) AS i FROM r) WHERE i = 1""")
def traverse_filtered(spark, sf_dir):
    edges = Scratch(spark).write(relationships(spark, sf_dir).select("src", "dst", "type", "confidence", "valid_from"), "edges")
    out = G.traversed(edges, entities(edges), asked(spark, sf_dir), 3, ["BOUGHT", "SUPPLIED_BY", "IN"], ["part", "supplier", "nation"], 0.8)
    return out.select("seed", "name", "type", "depth", F.round("confidence", 6).alias("confidence"), F.array_join("path", " ").alias("path"))


STAMP = "yyyy-MM-dd HH:mm:ss"
YEAR = ("1995-01-10 00:00:00", "1995-12-31 00:00:00")
SPAN = ("1996-01-01 00:00:00", "2000-01-01 00:00:00")


@query(f"""WITH {RL}, q AS (SELECT 'customer:' || c_custkey AS name FROM customer UNION ALL SELECT 'nation:' || n_nationkey FROM nation)
SELECT name AS entity, rel_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS at FROM rl JOIN q ON name = src OR (name = dst AND src <> dst)
WHERE (valid_from IS NULL OR valid_from >= TIMESTAMP '{SPAN[0]}') AND (valid_to IS NULL OR valid_to <= TIMESTAMP '{SPAN[1]}')""")
def entity_timeline(spark, sf_dir):
    """Of every customer and nation, in the order of time."""
    who = table(spark, sf_dir, "customer").selectExpr("concat('customer:', c_custkey) as name").union(table(spark, sf_dir, "nation").selectExpr("concat('nation:', n_nationkey)"))
    return G.timeline(relationships(spark, sf_dir), who, *SPAN).orderBy("entity", "at", "rel_id").select("entity", "rel_id", F.date_format("at", STAMP).alias("at"))


def order_facts(spark, sf_dir):
    """What is known of customers by their orders: open orders have no end."""
    return table(spark, sf_dir, "orders").selectExpr("concat('customer:', o_custkey) as entity", "o_orderkey as fact_id", "o_orderpriority as type", "cast(o_orderdate as timestamp) as valid_from", "case when o_orderstatus <> 'O' then cast(o_orderdate as timestamp) + interval 30 days end as valid_to")


FACTS = "f AS (SELECT 'customer:' || o_custkey AS entity, o_orderkey AS fact_id, o_orderpriority AS type, o_orderdate AS valid_from, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 30 DAY END AS valid_to FROM orders)"


@query(f"""WITH {FACTS}, q AS (SELECT 'customer:' || c_custkey AS name FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT entity, fact_id, type, strftime(valid_from, '%Y-%m-%d %H:%M:%S') AS valid_from FROM f WHERE entity IN (FROM q) AND type IN ('1-URGENT', '2-HIGH') AND valid_from >= TIMESTAMP '{SPAN[0]}' AND valid_to <= TIMESTAMP '{SPAN[1]}'""")
def temporal_facts(spark, sf_dir):
    """Urgent and high facts of the customers of one segment, in the order of time."""
    who = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").selectExpr("concat('customer:', c_custkey) as name")
    out = G.facts_of(order_facts(spark, sf_dir), who, *SPAN, ["1-URGENT", "2-HIGH"])
    return out.orderBy("valid_from", "fact_id").select("entity", "fact_id", "type", F.date_format("valid_from", STAMP).alias("valid_from"))


@query(f"""WITH {RL}, k AS (SELECT name FROM nd WHERE created_at BETWEEN TIMESTAMP '{YEAR[0]}' AND TIMESTAMP '{YEAR[1]}' AND type IN ('part', 'supplier'))
SELECT src, dst, type FROM rl WHERE created_at BETWEEN TIMESTAMP '{YEAR[0]}' AND TIMESTAMP '{YEAR[1]}' AND type = 'SUPPLIED_BY' AND src IN (FROM k) AND dst IN (FROM k)""")
def temporal_graph_query(spark, sf_dir):
    edges = relationships(spark, sf_dir)
    return G.created_between(edges, entities(edges), *YEAR, ["part", "supplier"], ["SUPPLIED_BY"])[1].select("src", "dst", "type")


@query(f"""WITH {RL}, {STEP}, s AS (SELECT 'region:' || r_regionkey AS name FROM region), h1 AS (SELECT b AS name FROM st JOIN s ON a = s.name UNION SELECT name FROM s), h2 AS (SELECT b AS name FROM st JOIN h1 ON a = h1.name UNION SELECT name FROM h1)
SELECT src, dst, type FROM rl WHERE src IN (FROM h2) AND dst IN (FROM h2)""")
def subgraph(spark, sf_dir):
    """Two steps around the regions: every nation, customer and supplier and the edges between them."""
    return G.subgraph(relationships(spark, sf_dir).select("src", "dst", "type"), table(spark, sf_dir, "region").selectExpr("concat('region:', r_regionkey) as name"), 2)[1].select("src", "dst", "type")


@query(f"""WITH {RL}, {ASKED} SELECT name AS entity, rel_id, 'out' AS direction FROM rl JOIN q ON name = src WHERE type = 'BOUGHT' UNION ALL
SELECT 'nation:' || n_nationkey, rel_id, 'in' FROM rl JOIN nation ON dst = 'nation:' || n_nationkey""")
def relationships_of_entities(spark, sf_dir):
    """Purchases of the asked customers, and everything that lies in a nation; newest first."""
    edges = relationships(spark, sf_dir)
    nations = table(spark, sf_dir, "nation").selectExpr("concat('nation:', n_nationkey) as name")
    out = G.touching(edges, asked(spark, sf_dir), "out", ["BOUGHT"]).withColumn("direction", F.lit("out"))
    out = out.unionByName(G.touching(edges, nations, "in").withColumn("direction", F.lit("in")))
    return out.orderBy(F.desc("created_at"), "rel_id").select("entity", "rel_id", "direction")
