"""Queries: graph, entity resolution, registries, quality, chunking, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import chunks as K
from sparkloom.functions import text as T
from sparkloom.operators import graph, quality, resolve, temporal, windows
from sparkloom.plans.registry import query
from sparkloom.session import cut
from sparkloom.sources import tables as t
from sparkloom.sources.tables import with_
from sparkloom.streaming import events as X

c = F.col


def _graph(s: SparkSession, d: str) -> DataFrame:
    """The whole graph, written once: a loop reads it again each round."""
    return cut(t.edges(s, d), "edges")


def _nodes(s: SparkSession, *names: str) -> DataFrame:
    return s.createDataFrame([(n,) for n in names], "node string")


GRAPH = "g AS (SELECT * FROM edges)"

# ---- graph ------------------------------------------------------------------------------------------------------


@query("G1_neighborhood", with_("recursive edges", f", {GRAPH}, st AS (SELECT subject AS a, object AS b FROM g UNION ALL SELECT object, subject FROM g), r(node, depth) AS (SELECT 'region:1', 0 UNION SELECT b, depth + 1 FROM r JOIN st ON a = node WHERE depth < 2) SELECT node, min(depth) AS depth FROM r GROUP BY 1 ORDER BY 2, 1 LIMIT 500"))
def neighborhood(s: SparkSession, d: str) -> DataFrame:
    return graph.neighborhood(_graph(s, d), _nodes(s, "region:1"), 2)


@query("G2_induced", with_("edges", f", {GRAPH} SELECT subject, predicate, object FROM g WHERE list_has_any(['nation', 'region', 'supplier', 'part'], [split_part(subject, ':', 1)]) AND list_has_any(['nation', 'region', 'supplier', 'part'], [split_part(object, ':', 1)])"))
def induced(s: SparkSession, d: str) -> DataFrame:
    nodes = t.entities(s, d).where("entity_type != 'Person'").select(c("uri").alias("node"))
    return graph.induced(_graph(s, d), nodes).select("subject", "predicate", "object")


def _paths_sql() -> str:
    """Four rounds of the search, each with one path a node and source, as the operator chooses it."""
    out = """, st AS (SELECT subject AS src, object AS dst, confidence, predicate FROM edges QUALIFY row_number() OVER (PARTITION BY subject, object ORDER BY confidence DESC, predicate) = 1),
        s0 AS (SELECT concat('customer:', c_custkey) AS source, concat('customer:', c_custkey) AS node, 0 AS length, concat('customer:', c_custkey) AS path FROM customer WHERE c_mktsegment = 'BUILDING'), seen0 AS (SELECT source, node FROM s0)"""
    for k in range(1, 5):
        out += f""", s{k} AS (SELECT f.source, dst AS node, {k} AS length, concat(path, '>', dst) AS path FROM s{k - 1} f JOIN st ON src = f.node ANTI JOIN seen{k - 1} x ON x.source = f.source AND x.node = dst
            QUALIFY row_number() OVER (PARTITION BY f.source, dst ORDER BY confidence DESC, predicate, f.node) = 1), seen{k} AS (SELECT source, node FROM seen{k - 1} UNION ALL SELECT source, node FROM s{k})"""
    return out + " SELECT source, node AS target, length, path FROM (" + " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(1, 5)) + ") WHERE node LIKE 'region:%'"


@query("G3_shortest_path", with_("edges", _paths_sql()))
def shortest_path(s: SparkSession, d: str) -> DataFrame:
    u = t.table(s, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("customer:"), c("c_custkey").cast("string")).alias("source"))
    pairs = u.withColumn("target", F.explode(F.array(*[F.lit(f"region:{k}") for k in range(5)])))
    return graph.shortest_paths(_graph(s, d), pairs, 4).select("source", "target", "length", F.array_join("path", ">").alias("path"))


@query("G4_relationships", with_("edges", "SELECT predicate, object, confidence FROM edges WHERE subject = 'part:7' ORDER BY confidence DESC, object"))
def relationships(s: SparkSession, d: str) -> DataFrame:
    out = graph.directed(t.edges(s, d), "out").where("src = 'part:7'")
    return out.orderBy(c("confidence").desc(), "object").select("predicate", "object", "confidence")


@query("G5_triple_closure", with_("recursive edges", f""", {GRAPH}, st AS (SELECT subject AS a, object AS b FROM g UNION ALL SELECT object, subject FROM g), r(node, depth) AS (SELECT 'nation:3', 0 UNION SELECT b, depth + 1 FROM r JOIN st ON a = node WHERE depth < 1),
    n AS (SELECT node, min(depth) AS depth FROM r GROUP BY 1) SELECT subject, predicate, object, min(depth) + 1 AS depth FROM g JOIN n ON node = subject OR node = object GROUP BY ALL"""))
def closure(s: SparkSession, d: str) -> DataFrame:
    return graph.triple_closure(_graph(s, d), _nodes(s, "nation:3"), 2).select("subject", "predicate", "object", "depth")


def _chain(s: SparkSession, d: str) -> DataFrame:
    """Orders of one customer as a chain of versions, each superseding the one before."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.table(s, d, "orders").select(c("o_orderkey").alias("id"), F.lag("o_orderkey").over(w).alias("supersedes"), F.row_number().over(w).alias("n"), "o_custkey")


CHAIN = "ch AS (SELECT o_orderkey AS id, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders)"


@query("G6_merge_chain", f"WITH {CHAIN} SELECT id AS node, coalesce(lag(id, 10) OVER w, first_value(id) OVER w) AS final FROM ch WINDOW w AS (PARTITION BY o_custkey ORDER BY n)")
def merge_chain(s: SparkSession, d: str) -> DataFrame:
    """Ten hops at most."""
    return graph.follow(_chain(s, d).select(c("id").alias("node"), c("supersedes").alias("next"))).select("node", "final")


@query("G7_redirects", f"WITH {CHAIN} SELECT id AS node, coalesce(lag(id, 5) OVER w, first_value(id) OVER w) AS final FROM ch WINDOW w AS (PARTITION BY o_custkey ORDER BY n)")
def redirects(s: SparkSession, d: str) -> DataFrame:
    return graph.follow(_chain(s, d).select(c("id").alias("node"), c("supersedes").alias("next")), 5).select("node", "final")


@query("G8_provenance", with_("recursive edges", f", {GRAPH}, r(node, depth) AS (SELECT 'customer:7', 0 UNION SELECT object, depth + 1 FROM r JOIN g ON subject = node WHERE depth < 8) SELECT node, min(depth) AS depth FROM r GROUP BY 1"))
def provenance(s: SparkSession, d: str) -> DataFrame:
    return graph.bfs(graph.directed(_graph(s, d), "out"), _nodes(s, "customer:7"), 8)


@query("G9_recall_walk", with_("edges", "SELECT DISTINCT b.object AS fact FROM edges a JOIN edges b ON b.subject = a.object WHERE a.subject = 'customer:7' AND a.predicate = 'bought' AND b.predicate = 'supplied_by'"))
def recall_walk(s: SparkSession, d: str) -> DataFrame:
    e = t.edges(s, d)
    near = graph.bfs(graph.directed(e, "out", "bought"), _nodes(s, "customer:7"), 1).where("depth = 1")
    return e.where("predicate = 'supplied_by'").join(near, c("subject") == c("node"), "left_semi").select(c("object").alias("fact")).distinct()


@query("G10_supersession", f"WITH {CHAIN} SELECT id, first_value(id) OVER w AS origin, last_value(id) OVER w AS head FROM ch WINDOW w AS (PARTITION BY o_custkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def supersession(s: SparkSession, d: str) -> DataFrame:
    versions = _chain(s, d).select("id", "supersedes")
    return graph.chain_origin(versions).join(graph.chain_head(versions), "id")


def _weighted(s: SparkSession, d: str) -> DataFrame:
    """The whole graph, undirected, by strength."""
    return graph.strengths(t.edges(s, d)).select("a", "b", "weight")


@query("G11_communities")
def communities(s: SparkSession, d: str) -> DataFrame:
    return graph.two_level_communities(_weighted(s, d))


@query("G12_betweenness")
def betweenness(s: SparkSession, d: str) -> DataFrame:
    """Exact: all nodes as sources over all edges."""
    e = t.edges(s, d).select(c("subject").alias("a"), c("object").alias("b"))
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return graph.betweenness(e, nodes).select("node", F.round("betweenness", 4).alias("betweenness"))


@query("G13_degree", with_("edges", "SELECT node, count(*) AS degree FROM (SELECT subject AS node FROM edges UNION ALL SELECT object FROM edges) GROUP BY 1"))
def degree(s: SparkSession, d: str) -> DataFrame:
    return graph.degrees(t.edges(s, d)).select("node", "degree")


@query("G14_strength", with_("edges", "SELECT least(subject, object) AS a, greatest(subject, object) AS b, round(sum(confidence * occurrence_count), 4) AS weight FROM edges GROUP BY 1, 2"))
def strength(s: SparkSession, d: str) -> DataFrame:
    return graph.strengths(t.edges(s, d)).select("a", "b", F.round("weight", 4).alias("weight"))


@query("G15_label_propagation")
def label_propagation(s: SparkSession, d: str) -> DataFrame:
    """Places and who is in them, by shared labels: every nation gathers its own."""
    return graph.label_propagation(_weighted(s, d), 20)


def _membership(s: SparkSession, d: str) -> DataFrame:
    return cut(graph.top_communities(_weighted(s, d)).select("node", F.col("community").alias("label")), "membership")


@query("G16_cohesion")
def cohesion(s: SparkSession, d: str) -> DataFrame:
    """Communities with the commonest kind of their members as name, and their density."""
    m = _membership(s, d)
    names = graph.community_names(m, m.select("node", F.concat(F.lit("graph/"), F.replace("node", F.lit(":"), F.lit("/"))).alias("path")))
    dense = graph.cohesion(_weighted(s, d), m)
    return names.join(dense.drop("nodes"), "label").select("label", "name", "nodes", "internal", F.round("cohesion", 4).alias("cohesion"))


def _calls(s: SparkSession, d: str, least: int = 0) -> DataFrame:
    """Parts that call the next parts of their orders' lines, of all lines or of large ones: a directed graph with cycles."""
    li = t.table(s, d, "lineitem").where(c("l_quantity") >= least)
    a, b = li.select("l_orderkey", c("l_linenumber").alias("n"), F.concat(F.lit("p"), c("l_partkey").cast("string")).alias("source")), li.select("l_orderkey", (c("l_linenumber") - 1).alias("n"), F.concat(F.lit("p"), c("l_partkey").cast("string")).alias("target"))
    return a.join(b, ["l_orderkey", "n"]).where("source != target").select("source", "target").distinct()


#: Large calls: with all lines every part calls and is called by many, so nothing is orphaned and no trace ends.
LARGE = 40


def _calls_sql(least: int = 0) -> str:
    return f"calls AS (SELECT DISTINCT concat('p', a.l_partkey) AS source, concat('p', b.l_partkey) AS target FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_quantity >= {least} AND b.l_quantity >= {least} AND a.l_partkey <> b.l_partkey)"


CALLS, LARGE_CALLS = _calls_sql(), _calls_sql(LARGE)


@query("G17_entry_points", f"WITH {CALLS}, o AS (SELECT source AS node, count(*) AS callees FROM calls GROUP BY 1), i AS (SELECT target AS node, count(*) AS callers FROM calls GROUP BY 1) SELECT node, round(coalesce(callees, 0) / (coalesce(callers, 0) + 1) * CASE WHEN node LIKE 'p1%' THEN 1.5 WHEN node LIKE 'p9%' THEN 0.3 ELSE 1.0 END, 6) AS score FROM o FULL OUTER JOIN i USING (node)")
def entry_points(s: SparkSession, d: str) -> DataFrame:
    """callees / (callers + 1), times what the name says."""
    deg = graph.degrees(_calls(s, d).select(c("source").alias("subject"), c("target").alias("object")))
    name = F.when(c("node").startswith("p1"), 1.5).when(c("node").startswith("p9"), 0.3).otherwise(1.0)
    return deg.select("node", F.round(c("out_degree") / (c("in_degree") + 1) * name, 6).alias("score"))


@query("G18_flows")
def flows(s: SparkSession, d: str) -> DataFrame:
    """With the reference's limits: 200 entries, ten nodes a trace, four calls a node, 2,000 steps an entry."""
    calls = cut(_calls(s, d, LARGE), "calls")
    entries = calls.groupBy(c("source").alias("entry")).agg(F.count(F.lit(1)).alias("n")).orderBy(c("n").desc(), "entry").limit(200).select("entry")
    return graph.flows(calls, entries, depth=10, branch=4, steps=2000).select("entry", F.array_join("path", ">").alias("path"))


@query("G19_impact", f"WITH RECURSIVE {CALLS}, r(node, depth) AS (SELECT 'p7', 0 UNION SELECT source, depth + 1 FROM r JOIN calls ON target = node WHERE depth < 2) SELECT node, min(depth) AS depth, CASE WHEN min(depth) = 1 THEN 'high' ELSE 'medium' END AS risk FROM r GROUP BY 1 HAVING min(depth) > 0")
def impact(s: SparkSession, d: str) -> DataFrame:
    return graph.impact(_calls(s, d), _nodes(s, "p7"), "up", 2)


@query("G20_call_chain", f"WITH RECURSIVE {CALLS}, r(node, depth) AS (SELECT 'p7', 0 UNION SELECT target, depth + 1 FROM r JOIN calls ON source = node WHERE depth < 3) SELECT node, min(depth) AS depth FROM r GROUP BY 1")
def call_chain(s: SparkSession, d: str) -> DataFrame:
    return graph.bfs(_calls(s, d).select(c("source").alias("src"), c("target").alias("dst")), _nodes(s, "p7"), 3)


@query("G21_orphaned", f"WITH {LARGE_CALLS} SELECT concat('p', p_partkey) AS node FROM part WHERE concat('p', p_partkey) NOT IN (SELECT source FROM calls UNION SELECT target FROM calls)")
def orphaned(s: SparkSession, d: str) -> DataFrame:
    calls = cut(_calls(s, d, LARGE), "calls")
    p = t.table(s, d, "part").select(F.concat(F.lit("p"), c("p_partkey").cast("string")).alias("node"))
    return p.join(calls, c("node") == c("source"), "left_anti").join(calls, c("node") == c("target"), "left_anti")


@query("G22_callers", f"WITH {CALLS} SELECT target AS node, count(*) AS callers, string_agg(source, ',' ORDER BY source) AS names FROM calls WHERE target IN ('p7', 'p11', 'p13') GROUP BY 1")
def callers(s: SparkSession, d: str) -> DataFrame:
    some = _calls(s, d).where(c("target").isin("p7", "p11", "p13"))
    return some.groupBy(c("target").alias("node")).agg(F.count(F.lit(1)).alias("callers"), F.array_join(F.sort_array(F.collect_list("source")), ",").alias("names"))


@query("G23_community_members")
def community_members(s: SparkSession, d: str) -> DataFrame:
    return _membership(s, d).groupBy("label").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("first"))


@query("G24_history", with_("facts", "SELECT fact_id, valid_from, object FROM facts WHERE subject = 'customer:7' ORDER BY valid_from, fact_id"))
def assertion_history(s: SparkSession, d: str) -> DataFrame:
    return t.facts(s, d).where("subject = 'customer:7'").orderBy("valid_from", "fact_id").select("fact_id", "valid_from", "object")


@query("G25_implements", """WITH m AS (SELECT l_orderkey AS o, list(DISTINCT l_suppkey) AS ks FROM lineitem GROUP BY 1), u AS (SELECT o, ks, unnest(ks) AS k FROM m), f AS (SELECT k, count(*) AS n FROM u GROUP BY 1),
    i AS (SELECT o, ks, arg_min(k, struct_pack(n := n, k := k)) AS k FROM u JOIN f USING (k) GROUP BY 1, 2) SELECT i.o AS interface, u.o AS implementer FROM i JOIN u USING (k) WHERE u.o <> i.o AND list_has_all(u.ks, i.ks)""")
def implements(s: SparkSession, d: str) -> DataFrame:
    """An order implements another if it has all of its suppliers."""
    m = t.table(s, d, "lineitem").select(c("l_orderkey").alias("o"), c("l_suppkey").alias("k")).distinct()
    return graph.containments(m, "o", "k").select(c("inner").alias("interface"), c("outer").alias("implementer"))


@query("G26_symmetric", with_("edges", f", {GRAPH} SELECT subject, predicate, object FROM g UNION SELECT object, predicate, subject FROM g WHERE predicate = 'part_of'"))
def symmetric(s: SparkSession, d: str) -> DataFrame:
    return graph.symmetric(_graph(s, d).select("subject", "predicate", "object"), ["part_of"])


@query("G27_hierarchy_walk", with_("recursive edges", f", {GRAPH}, r(node, depth) AS (SELECT 'region:2', 0 UNION SELECT subject, depth + 1 FROM r JOIN g ON object = node WHERE depth < 3) SELECT node, min(depth) AS depth FROM r GROUP BY 1"))
def hierarchy_walk(s: SparkSession, d: str) -> DataFrame:
    return graph.bfs(graph.directed(_graph(s, d), "in"), _nodes(s, "region:2"), 3)


@query("G28_sparql", with_("edges", "SELECT a.subject AS x, b.object AS r FROM edges a JOIN edges b ON b.subject = a.object WHERE a.predicate = 'located_in' AND b.predicate = 'part_of' AND b.object <> 'region:0'"))
def sparql(s: SparkSession, d: str) -> DataFrame:
    return graph.sparql(t.edges(s, d), [("?x", "located_in", "?n"), ("?n", "part_of", "?r")], where=c("r") != "region:0").select("x", "r")


# ---- resolution -------------------------------------------------------------------------------------------------


def _registry(s: SparkSession, d: str) -> DataFrame:
    e = t.entities(s, d)
    norm = T.normalize_entity_text(c("entity_text"))
    return e.select("uri", "entity_text", "entity_type", norm.alias("normalized_text"), F.array(F.concat(F.lit("aka "), norm)).alias("aliases"), F.lit(None).cast("array<double>").alias("embedding"), F.lit(None).cast("string").alias("merged_into"), "occurrence_count")


def _mentions(s: SparkSession, d: str) -> DataFrame:
    """Suppliers' and nations' names as they may be written: as they are, as an alias, with a letter more."""
    e = t.entities(s, d).where(c("entity_type").isin("Organization", "Location"))
    name = F.when(c("entity_type") == "Location", c("entity_text")).when(c("occurrence_count") > 60, F.concat(F.lit("aka "), c("entity_text"))).when(c("occurrence_count") > 30, F.upper("entity_text")).otherwise(F.concat(c("entity_text"), F.lit("x")))
    return e.select(c("uri").alias("mention_id"), name.alias("name"), "entity_type", F.lit(None).cast("array<double>").alias("embedding"))


@query("E1_tiered_resolver")
def tiered(s: SparkSession, d: str) -> DataFrame:
    """All tiers; a mention's context are the orders of its supplier, whose other suppliers are its candidates."""
    links = t.table(s, d, "lineitem").select(F.concat(F.lit("order:"), c("l_orderkey").cast("string")).alias("rid"), F.concat(F.lit("supplier:"), c("l_suppkey").cast("string")).alias("uri"))
    near = resolve.shared_documents(links.select(c("uri").alias("mention_id"), "rid"), links)
    return resolve.resolve(_mentions(s, d), _registry(s, d), near=near, create=True).select("mention_id", "uri", F.round("score", 6).alias("score"), "tier", "relation")


@query("E2_fuzzy")
def fuzzy(s: SparkSession, d: str) -> DataFrame:
    return resolve.fuzzy(_mentions(s, d), _registry(s, d), policy=False).select("mention_id", "uri", F.round("score", 6).alias("score"))


@query("E3_exact_mode", with_("entities", "SELECT m.uri AS mention_id, m.uri AS uri FROM entities m WHERE entity_type = 'Location'"))
def exact_mode(s: SparkSession, d: str) -> DataFrame:
    return resolve.exact(_mentions(s, d).where("entity_type = 'Location'"), _registry(s, d)).select("mention_id", "uri")


@query("E4_registry_fuzzy")
def registry_fuzzy(s: SparkSession, d: str) -> DataFrame:
    return resolve.registry_fuzzy(_mentions(s, d), _registry(s, d)).select("mention_id", "uri", F.round("score", 6).alias("score"))


@query("E5_veto", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name WHERE NOT (a.n_name = 'NATION_1' OR b.n_name = 'NATION_1')")
def veto(s: SparkSession, d: str) -> DataFrame:
    n = t.table(s, d, "nation").select("n_regionkey", c("n_name").alias("a"))
    pairs = n.join(n.withColumnRenamed("a", "b"), "n_regionkey").where("a < b").select("a", "b")
    one = pairs.where("a = 'NATION_1' OR b = 'NATION_1'").select(c("b").alias("x"), c("a").alias("y"))
    return resolve.without_vetoed(pairs, one.select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")), "a", "b")


@query("E6_alias_resolve", with_("entities", "SELECT uri AS mention_id, uri FROM entities WHERE entity_type = 'Organization' AND occurrence_count > 60"))
def alias_resolve(s: SparkSession, d: str) -> DataFrame:
    return resolve.alias(_mentions(s, d), _registry(s, d)).select("mention_id", "uri")


@query("E7_dedup_proposals")
def proposals(s: SparkSession, d: str) -> DataFrame:
    return resolve.dedup_proposals(_registry(s, d), 0.97).select("winner", "loser", F.round("score", 6).alias("score"))


@query("E8_cross_type_collisions", with_("entities", "SELECT DISTINCT a.k AS normalized_text, a.entity_type AS type_a, b.entity_type AS type_b FROM (SELECT substr(normalized_text, 1, 1) AS k, entity_type FROM entities) a JOIN (SELECT substr(normalized_text, 1, 1) AS k, entity_type FROM entities) b ON a.k = b.k AND a.entity_type < b.entity_type"))
def collisions(s: SparkSession, d: str) -> DataFrame:
    return resolve.cross_type_collisions(_registry(s, d).withColumn("normalized_text", F.substring("normalized_text", 1, 1)))


@query("E9_apply_merges", with_("edges", """SELECT subject, predicate, object, max(confidence) AS confidence, sum(occurrence_count)::BIGINT AS occurrence_count FROM (SELECT CASE WHEN subject IN ('nation:2', 'nation:3') THEN 'nation:1' ELSE subject END AS subject, predicate,
    CASE WHEN object IN ('nation:2', 'nation:3') THEN 'nation:1' ELSE object END AS object, confidence, occurrence_count FROM edges) WHERE subject <> object GROUP BY 1, 2, 3"""))
def apply_merges(s: SparkSession, d: str) -> DataFrame:
    merges = s.createDataFrame([("nation:3", "nation:2"), ("nation:2", "nation:1")], "loser string, winner string")
    return resolve.apply_merges(t.edges(s, d), merges)


@query("E10_reversal", "SELECT o_orderkey, 'update' AS action FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000")
def reversal(s: SparkSession, d: str) -> DataFrame:
    before = t.table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    after = before.withColumn("o_orderstatus", F.when((c("o_orderstatus") == "F") & (c("o_totalprice") > 300000), "X").otherwise(c("o_orderstatus")))
    return resolve.snapshot_restore(before, after, ["o_orderkey"]).select("o_orderkey", "action")


@query("E11_window_entities", "SELECT replace(lower(c_mktsegment), '_', ' ') AS norm, min(c_nationkey) AS first_window, count(*) AS mentions FROM customer GROUP BY 1")
def window_entities(s: SparkSession, d: str) -> DataFrame:
    rows = t.table(s, d, "customer").select(c("c_mktsegment").alias("name"), F.lit("Concept").alias("entity_type"), c("c_nationkey").alias("window"), F.lit(1).alias("mentions"))
    return resolve.window_entities(rows).select("norm", "first_window", "mentions")


@query("E12_window_facts", "SELECT o_custkey AS subject, l_partkey AS object, min(l_linenumber) AS start, max(l_linenumber) AS \"end\", CASE WHEN bool_or(l_discount >= 0.09) THEN 'high' ELSE 'normal' END AS confidence FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2")
def window_facts(s: SparkSession, d: str) -> DataFrame:
    j = t.table(s, d, "lineitem").join(t.table(s, d, "orders"), c("o_orderkey") == c("l_orderkey"))
    rows = j.select(c("o_custkey").alias("subject"), F.lit("bought").alias("predicate"), c("l_partkey").alias("object"), c("l_linenumber").alias("start"), c("l_linenumber").alias("end"), F.when(c("l_discount") >= 0.09, "high").otherwise("normal").alias("confidence"))
    return resolve.window_facts(rows).drop("predicate")


def _vector_facts(s: SparkSession, d: str) -> DataFrame:
    return t.vectors(s, d).select(c("vec_id").alias("id"), c("label").cast("string").alias("subject"), F.lit("is").alias("predicate"), c("vec_id").cast("string").alias("object"), "embedding")


@query("E13_supersession", with_("vecs", "SELECT DISTINCT b.vec_id AS old_id FROM vecs a JOIN vecs b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.embedding, b.embedding) > 0.2"))
def fact_supersession(s: SparkSession, d: str) -> DataFrame:
    f = _vector_facts(s, d)
    return resolve.superseded_facts(f, f, ["is"], 0.2)


@query("E14_global_hash_dedup", "SELECT sha256(text) AS hash, count(*) - 1 AS skipped FROM documents GROUP BY 1 HAVING count(*) > 1")
def global_hash(s: SparkSession, d: str) -> DataFrame:
    return t.table(s, d, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg((F.count(F.lit(1)) - 1).alias("skipped")).where("skipped > 0")


@query("E15_type_fold", with_("entities", "SELECT substr(normalized_text, 1, 1) AS label, arg_max(entity_type, CASE entity_type WHEN 'Person' THEN 10 WHEN 'Organization' THEN 9 WHEN 'Location' THEN 7 WHEN 'Product' THEN 6 ELSE 0 END) AS entity_type FROM entities GROUP BY 1"))
def type_fold(s: SparkSession, d: str) -> DataFrame:
    p = F.create_map(*[F.lit(x) for kv in resolve.TYPE_PRIORITY.items() for x in kv])[c("entity_type")]
    return t.entities(s, d).groupBy(F.substring("normalized_text", 1, 1).alias("label")).agg(F.max_by("entity_type", p).alias("entity_type"))


# ---- registries -------------------------------------------------------------------------------------------------

ALLOWED = {"O": ["P"], "P": ["F"]}


@query("N1_transitions", "SELECT o_orderkey, o_orderstatus AS from_state, 'F' AS to_state FROM orders WHERE o_orderstatus <> 'P'")
def transitions(s: SparkSession, d: str) -> DataFrame:
    moves = t.table(s, d, "orders").select("o_orderkey", c("o_orderstatus").alias("from_state"), F.lit("F").alias("to_state"))
    return temporal.invalid_transitions(moves, ALLOWED).select("o_orderkey", "from_state", "to_state")


@query("N2_state_log", """WITH a AS (SELECT l_orderkey AS rid, CASE WHEN l_quantity < 2 THEN NULL ELSE l_linestatus END AS to_state, CASE WHEN l_returnflag <> 'A' THEN l_shipdate END AS created_at, l_linenumber FROM lineitem),
    g AS (SELECT rid, to_state, created_at FROM a WHERE l_linenumber <= 3 AND to_state IS NOT NULL AND created_at IS NOT NULL)
    SELECT rid, to_state, created_at, false AS appended FROM g UNION ALL SELECT rid, to_state, created_at, true FROM a WHERE to_state IS NOT NULL AND created_at IS NULL
    UNION ALL SELECT DISTINCT rid, to_state, created_at, true FROM a WHERE to_state IS NOT NULL AND created_at IS NOT NULL AND (rid, to_state, created_at) NOT IN (SELECT (rid, to_state, created_at) FROM g)""")
def state_log(s: SparkSession, d: str) -> DataFrame:
    """Lines' states as acts, delivered again to a log that holds the first lines."""
    acts = t.table(s, d, "lineitem").select(c("l_orderkey").alias("rid"), F.when(c("l_quantity") >= 2, c("l_linestatus")).alias("to_state"), F.when(c("l_returnflag") != "A", c("l_shipdate")).alias("created_at"), "l_linenumber")
    log = acts.where("l_linenumber <= 3 AND to_state IS NOT NULL AND created_at IS NOT NULL").drop("l_linenumber")
    return temporal.append_log(log, acts, ["rid", "to_state"], "created_at", ["l_linenumber"])


@query("N3_latest_act", "SELECT l_partkey, l_linestatus AS status FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS rn FROM lineitem) WHERE rn = 1 AND l_linestatus <> 'O'")
def latest_act(s: SparkSession, d: str) -> DataFrame:
    acts = t.table(s, d, "lineitem").withColumnRenamed("l_linestatus", "status")
    return temporal.latest_act(acts, "l_partkey", [c("l_shipdate").desc(), c("l_orderkey").desc(), c("l_linenumber").desc()], open_="O").select("l_partkey", "status")


@query("N4_rebuild", "SELECT o_orderkey, 'changed' AS change FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE q > 200")
def rebuild(s: SparkSession, d: str) -> DataFrame:
    new = t.table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q")).withColumnRenamed("l_orderkey", "o_orderkey")
    old = new.withColumn("q", F.least("q", F.lit(200.0)))
    return temporal.diff(old, new, ["o_orderkey"])


@query("N5_calendar", "SELECT count(*) FILTER (WHERE TRY_CAST(left(props, 10) AS TIMESTAMP) IS NULL) AS bad, count(*) AS n FROM events")
def calendar(s: SparkSession, d: str) -> DataFrame:
    return t.table(s, d, "events").agg(F.count_if(F.try_to_timestamp(F.substring("props", 1, 10)).isNull()).alias("bad"), F.count(F.lit(1)).alias("n"))


@query("N6_claims", "SELECT o_orderkey, count(l_linenumber) FILTER (WHERE l_returnflag = 'R') AS rejected, count(l_linenumber) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) GROUP BY 1")
def claims(s: SparkSession, d: str) -> DataFrame:
    who = t.table(s, d, "customer").where("c_nationkey = 3")
    o = t.table(s, d, "orders").join(who, c("o_custkey") == c("c_custkey"), "left_semi")
    return o.join(t.table(s, d, "lineitem"), c("l_orderkey") == c("o_orderkey"), "left").groupBy("o_orderkey").agg(F.count_if(c("l_returnflag") == "R").alias("rejected"), F.count("l_linenumber").alias("n"))


@query("N7_evidence", with_("edges", "SELECT subject, predicate, object FROM edges WHERE object = 'supplier:4' ORDER BY confidence DESC NULLS LAST, subject LIMIT 100"))
def evidence(s: SparkSession, d: str) -> DataFrame:
    return t.edges(s, d).where("object = 'supplier:4'").orderBy(c("confidence").desc_nulls_last(), "subject").limit(100).select("subject", "predicate", "object")


@query("N8_mentioned_in", with_("mentions", "SELECT uri, rid FROM (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY mention_count DESC, rid) AS rn FROM mentions) WHERE rn <= 3"))
def mentioned_in(s: SparkSession, d: str) -> DataFrame:
    return windows.top_k_per(t.mentions(s, d), ["uri"], [c("mention_count").desc(), c("rid")], 3).select("uri", "rid")


@query("N9_best_mapping", "SELECT l_partkey, arg_max(l_suppkey, struct_pack(a := (l_returnflag = 'N')::INT, b := l_quantity, c := l_orderkey, e := l_linenumber)) AS supplier FROM lineitem GROUP BY 1")
def best_mapping(s: SparkSession, d: str) -> DataFrame:
    return t.table(s, d, "lineitem").groupBy("l_partkey").agg(F.max_by("l_suppkey", F.struct((c("l_returnflag") == "N").cast("int"), "l_quantity", "l_orderkey", "l_linenumber")).alias("supplier"))


@query("N10_intents", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1996-01-01' ORDER BY o_orderpriority, o_orderkey LIMIT 100")
def intents(s: SparkSession, d: str) -> DataFrame:
    return t.table(s, d, "orders").where((c("o_orderstatus") == "O") & (c("o_orderdate") <= F.lit("1996-01-01").cast("timestamp"))).orderBy("o_orderpriority", "o_orderkey").limit(100).select("o_orderkey")


@query("N11_unmet_wants", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'N' AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40)")
def unmet(s: SparkSession, d: str) -> DataFrame:
    li = t.table(s, d, "lineitem")
    return li.where("l_returnflag = 'N'").select("l_partkey").distinct().join(li.where("l_returnflag = 'R' AND l_quantity > 40"), "l_partkey", "left_anti")


@query("N12_link_status", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN p_partkey IS NULL THEN 'missing' ELSE 'resolved' END AS status FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 10) GROUP BY 1")
def link_status(s: SparkSession, d: str) -> DataFrame:
    j = t.table(s, d, "lineitem").join(t.table(s, d, "part").where("p_size > 10"), c("p_partkey") == c("l_partkey"), "left")
    return j.groupBy(F.when(c("p_partkey").isNull(), "missing").otherwise("resolved").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("N13_pending_edges", "SELECT l_partkey AS label, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY 1 ORDER BY n DESC, label LIMIT 20")
def pending(s: SparkSession, d: str) -> DataFrame:
    open_ = t.table(s, d, "lineitem").join(t.table(s, d, "part").where("p_size > 10"), c("p_partkey") == c("l_partkey"), "left_anti")
    return open_.groupBy(c("l_partkey").alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy(c("n").desc(), "label").limit(20)


@query("N14_unexpected_pairs", "SELECT DISTINCT a.o_orderpriority AS a, b.o_orderpriority AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority < b.o_orderpriority WHERE NOT (a.o_orderpriority = '1-URGENT' AND b.o_orderpriority = '2-HIGH')")
def unexpected_pairs(s: SparkSession, d: str) -> DataFrame:
    """Pairs of a key's few kinds, from its sorted set of them, minus those expected."""
    kinds = t.table(s, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("ks"))
    sets = kinds.select("ks").distinct()
    pairs = sets.select(F.explode("ks").alias("a"), "ks").select("a", F.explode("ks").alias("b")).where("a < b").distinct()
    expected = s.createDataFrame([("1-URGENT", "2-HIGH")], "a string, b string")
    return pairs.join(F.broadcast(expected), ["a", "b"], "left_anti")


@query("N15_supersession_keys", f"WITH {CHAIN} SELECT DISTINCT md5(concat(p.id, '->', q.id)) AS k FROM ch p JOIN ch q ON p.o_custkey = q.o_custkey AND q.n = p.n + 1")
def supersession_keys(s: SparkSession, d: str) -> DataFrame:
    return _chain(s, d).where("supersedes IS NOT NULL").select(F.md5(F.concat(c("supersedes").cast("string"), F.lit("->"), c("id").cast("string"))).alias("k")).distinct()


@query("N16_catalog", "SELECT doc_id, (SELECT count(*) FROM documents WHERE lang = 'fr') AS total FROM documents WHERE lang = 'fr' ORDER BY doc_id LIMIT 25 OFFSET 25")
def catalog(s: SparkSession, d: str) -> DataFrame:
    return windows.page(t.table(s, d, "documents").where("lang = 'fr'").select("doc_id"), ["doc_id"], 25, 25)


@query("N17_governed", with_("entities edges", "SELECT DISTINCT uri, entity_text FROM entities JOIN edges ON subject = uri WHERE object = 'region:1'"))
def governed(s: SparkSession, d: str) -> DataFrame:
    e = t.edges(s, d).where("object = 'region:1'")
    return t.entities(s, d).join(e, c("uri") == c("subject"), "left_semi").select("uri", "entity_text")


@query("N18_orphan_stats", "SELECT count(*) AS n, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def orphan_stats(s: SparkSession, d: str) -> DataFrame:
    o = t.table(s, d, "lineitem").join(t.table(s, d, "part").where("p_size > 25"), c("l_partkey") == c("p_partkey"), "left_anti")
    return o.agg(F.count(F.lit(1)).alias("n"), F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi"))


@query("N19_partners", "SELECT DISTINCT CASE WHEN lo = 'a' THEN hi ELSE lo END AS partner FROM (VALUES ('a', 'b'), ('a', 'c'), ('b', 'c')) v(lo, hi) WHERE lo = 'a' OR hi = 'a'")
def veto_partners(s: SparkSession, d: str) -> DataFrame:
    return resolve.partners(s.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], "lo string, hi string"), "a")


@query("N20_recent_sources", with_("docs", "SELECT source, count(*) AS n FROM docs WHERE confidence >= 0.5 AND published_at >= TIMESTAMP '2024-01-10' GROUP BY 1"))
def recent_sources(s: SparkSession, d: str) -> DataFrame:
    return t.documents(s, d).where((c("confidence") >= 0.5) & (c("published_at") >= F.lit("2024-01-10").cast("timestamp"))).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


# ---- quality ----------------------------------------------------------------------------------------------------


@query("Q1_confidence_filter", with_("docs", "SELECT rid FROM docs WHERE coalesce(confidence, 0) >= 0.7"))
def confidence_filter(s: SparkSession, d: str) -> DataFrame:
    return t.documents(s, d).where(F.coalesce("confidence", F.lit(0.0)) >= 0.7).select("rid")


#: Names that break rules, beside the tables' own.
ODD_NAMES = [("Ann", "Person"), ("x", "Concept"), ("TBD", "Concept"), ("they", "Concept"), ("12.5 %", "Concept"), ("Location", "Location"), ("user 7", "Person"), ("community", "Organization"), ("ERC-20", "Concept"), ("ABC-12", "Concept"), ("the privacy policy here", "Concept"), ("many things", "Concept"), ("It is done. now go", "Concept"), ("foo::bar", "Concept"), ("fix(ui): colour", "Concept"), ("Helper Bot", "Person"), ("meeting", "Event"), ("platform", "Concept"), ("Ada Foundation", "Person"), ("Testnet", "Location"), ("run.py", "Process"), ("hardness", "Material"), ("Ada Lovelace", "Person")]


@query("Q2_entity_quality", with_("entities", f""", n AS (SELECT uri, entity_text AS x, entity_type AS k FROM entities UNION ALL SELECT concat('odd:', i), v[1], v[2] FROM (SELECT unnest([{', '.join(f"['{a}', '{b}']" for a, b in ODD_NAMES)}]) AS v, unnest(range({len(ODD_NAMES)})) AS i)),
    w AS (SELECT *, lower(trim(x)) AS l, len(list_filter(regexp_split_to_array(lower(x), '\\s+'), lambda z: z <> '')) AS n FROM n),
    r AS (SELECT uri, list_filter([CASE WHEN k = 'Person' AND n = 1 THEN 'single_token_person' END, CASE WHEN length(l) < 2 THEN 'too_short' END, CASE WHEN l IN ({', '.join(repr(x) for x in quality.PLACEHOLDERS)}) THEN 'placeholder' END, CASE WHEN l IN ({', '.join(repr(x) for x in quality.STOP_NAMES)}) THEN 'stop_word' END,
    CASE WHEN regexp_matches(l, '^[\\d\\s.,%$#-]+$') THEN 'numeric_only' END, CASE WHEN l = lower(k) THEN 'tautological' END, CASE WHEN k = 'Person' AND x = lower(x) THEN 'lowercase_person' END, CASE WHEN k = 'Person' AND regexp_matches(l, '^(user|speaker|person|customer|client)\\s*#?\\d*$') THEN 'placeholder_person' END,
    CASE WHEN l IN ({', '.join(repr(x) for x in quality.GENERIC_GROUPS)}) THEN 'generic_group' END, CASE WHEN regexp_matches(l, '^erc-?\\d+$') THEN 'erc_standard' END, CASE WHEN regexp_matches(x, '^[A-Z]{{2,10}}-\\d+$') THEN 'jira_issue_id' END,
    CASE WHEN regexp_matches(l, '(cookie policy|privacy policy|terms of service|all rights reserved|subscribe)') THEN 'boilerplate' END, CASE WHEN regexp_matches(l, '^(some|any|many|various|several|other) ') THEN 'generic_pattern' END, CASE WHEN n > 8 OR regexp_matches(l, '[.!?]\\s+\\w') THEN 'sentence_like' END,
    CASE WHEN length(x) > 120 THEN 'too_long' END, CASE WHEN regexp_matches(l, '(::|->|\\(\\)|[{{}}<>]|^0x[0-9a-f]+$|^/[\\w/.-]+$)') THEN 'technical_pattern' END, CASE WHEN regexp_matches(l, '^(feat|fix|chore|docs|refactor|merge)(\\(.*\\))?:') THEN 'git_changelog' END,
    CASE WHEN k = 'Person' AND regexp_matches(l, '\\b(gpt|chatbot|assistant|llm|bot)\\b') THEN 'ai_as_person' END, CASE WHEN k = 'Event' AND l IN ('meeting', 'call', 'event', 'session', 'workshop') THEN 'generic_event' END, CASE WHEN l IN ('project', 'system', 'platform', 'process', 'product', 'service') THEN 'generic_domain_type' END,
    CASE WHEN k = 'Person' AND regexp_matches(l, '\\b(inc|llc|ltd|foundation|network)$') THEN 'firstname_orgname_artifact' END, CASE WHEN k = 'Location' AND regexp_matches(l, '(chain|mainnet|testnet)$') THEN 'blockchain_as_location' END, CASE WHEN k = 'Process' AND regexp_matches(l, '(\\.py|\\.ts|\\.go|_module)$') THEN 'code_module_as_process' END,
    CASE WHEN k = 'Material' AND regexp_matches(l, '(ness|ity|ism|tion)$') THEN 'abstract_concept_as_material' END], lambda z: z IS NOT NULL) AS rs FROM w) SELECT uri, array_to_string(rs, ',') AS reasons, len(rs) = 0 AS valid FROM r"""))
def entity_quality(s: SparkSession, d: str) -> DataFrame:
    odd = s.createDataFrame([(f"odd:{k}", *x) for k, x in enumerate(ODD_NAMES)], "uri string, entity_text string, entity_type string")
    e = t.entities(s, d).select("uri", "entity_text", "entity_type").unionByName(odd)
    return quality.gate(e, quality.entity_rules(c("entity_text"), c("entity_type"))).select("uri", F.array_join("reasons", ",").alias("reasons"), "valid")


@query("Q3_relevance", with_("docs", "SELECT rid, confidence >= 0.5 AS relevant FROM docs"))
def relevance(s: SparkSession, d: str) -> DataFrame:
    return quality.gate(t.documents(s, d), {"irrelevant": c("confidence") < 0.5}).select("rid", c("valid").alias("relevant"))


@query("Q4_list_splitter", "SELECT n_regionkey, unnest(['A' || n_regionkey, 'B', 'C']) AS name FROM nation")
def list_splitter(s: SparkSession, d: str) -> DataFrame:
    n = t.table(s, d, "nation").select("n_regionkey", F.concat(F.lit("A"), c("n_regionkey").cast("string"), F.lit(", B and C")).alias("name"), F.lit(0.9).alias("confidence"))
    return quality.split_lists(n, "name", "confidence").select("n_regionkey", "name")


@query("Q5_ontology", with_("entities edges", """SELECT subject_type, predicate, object_type, count(*) AS n FROM (SELECT CASE WHEN a.entity_type = 'Person' THEN 'AGENT' ELSE upper(a.entity_type) END AS subject_type, CASE e.predicate WHEN 'bought' THEN 'purchased' ELSE e.predicate END AS predicate,
    CASE WHEN b.entity_type = 'Person' THEN 'AGENT' ELSE upper(b.entity_type) END AS object_type FROM edges e JOIN entities a ON a.uri = e.subject JOIN entities b ON b.uri = e.object) GROUP BY ALL"""))
def ontology(s: SparkSession, d: str) -> DataFrame:
    """Edges by canonical types and predicate: types come with namespaces, predicates with spaces and capitals."""
    e = t.entities(s, d).select("uri", F.concat(F.when(c("occurrence_count") % 2 == 0, F.lit(" schema:")).otherwise(F.lit("https://schema.org/")), "entity_type").alias("kind"))
    named = t.edges(s, d).join(e.select(c("uri").alias("subject"), c("kind").alias("subject_kind")), "subject").join(e.select(c("uri").alias("object"), c("kind").alias("object_kind")), "object")
    types = {"PERSON": "AGENT"}
    predicate = quality.ontology_predicate(F.concat(F.lit("ns:"), F.upper(F.replace("predicate", F.lit("_"), F.lit(" ")))), {"bought": "purchased"})
    return named.groupBy(quality.ontology_type(c("subject_kind"), types).alias("subject_type"), predicate.alias("predicate"), quality.ontology_type(c("object_kind"), types).alias("object_type")).agg(F.count(F.lit(1)).alias("n"))


@query("Q6_canonical", with_("entities", "SELECT uri, CASE WHEN normalized_text = 'nation_1' AND entity_type = 'Location' THEN 'First Nation' ELSE entity_text END AS name FROM entities"))
def canonical(s: SparkSession, d: str) -> DataFrame:
    names = s.createDataFrame([("nation_1", "Location", "First Nation")], "alias string, kind string, canon string")
    return t.entities(s, d).join(F.broadcast(names), (c("normalized_text") == c("alias")) & (c("entity_type") == c("kind")), "left").select("uri", F.coalesce("canon", "entity_text").alias("name"))


@query("Q7_document_dedup", "SELECT DISTINCT l_orderkey, l_partkey FROM lineitem")
def document_dedup(s: SparkSession, d: str) -> DataFrame:
    return t.table(s, d, "lineitem").select("l_orderkey", "l_partkey").dropDuplicates()


@query("Q8_type_guard", with_("edges", "SELECT predicate, count(*) AS n FROM edges WHERE predicate IN ('located_in', 'bought') GROUP BY 1"))
def type_guard(s: SparkSession, d: str) -> DataFrame:
    e = t.entities(s, d).select("uri", "entity_type")
    named = t.edges(s, d).join(e.select(c("uri").alias("subject"), c("entity_type").alias("st")), "subject").join(e.select(c("uri").alias("object"), c("entity_type").alias("ot")), "object")
    rules = s.createDataFrame([("located_in", ["Person", "Organization"], ["Location"]), ("bought", ["Person"], ["Product"])], "predicate string, subject_types array<string>, object_types array<string>")
    return quality.type_guard(named, F.broadcast(rules), "st", "ot").where("allowed").groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))


@query("Q9_chunk_coverage", """WITH ch AS (SELECT DISTINCT conv_id AS rid, turn AS i FROM conversations), ci AS (SELECT conv_id AS rid, min(turn) AS first, min(turn) + 1 AS last FROM conversations GROUP BY 1)
    SELECT rid, round(count(*) FILTER (WHERE i BETWEEN first AND last) / count(*), 6) AS coverage FROM ch JOIN ci USING (rid) GROUP BY 1""")
def chunk_coverage(s: SparkSession, d: str) -> DataFrame:
    turns = t.table(s, d, "conversations")
    chunks = turns.select(c("conv_id").alias("rid"), c("turn").alias("index")).distinct()
    cited = turns.groupBy(c("conv_id").alias("rid")).agg(F.min("turn").alias("first"), (F.min("turn") + 1).alias("last"))
    return quality.chunk_coverage(cited, chunks).select("rid", F.round("coverage", 6).alias("coverage"))


@query("Q9_concentration", with_("edges", "SELECT subject, round(max(n) / sum(n), 6) AS concentration FROM (SELECT subject, predicate, count(*) AS n FROM edges GROUP BY 1, 2) GROUP BY 1"))
def concentration(s: SparkSession, d: str) -> DataFrame:
    return quality.concentration(t.edges(s, d), "subject", "predicate").select("subject", F.round("concentration", 6).alias("concentration"))


@query("Q10_private_scan", "SELECT doc_id, regexp_matches(text, '[\\w.+-]+@[\\w-]+\\.[\\w.-]+') AS has_email FROM documents")
def private_scan(s: SparkSession, d: str) -> DataFrame:
    return quality.scan_private(t.table(s, d, "documents"), c("text")).select("doc_id", "has_email")


@query("Q11_speculation", f"SELECT doc_id, least(1.0, 0.2 * ({' + '.join(f'contains(lower(text), {w!r})::INT' for w in quality.SPECULATION)}))::DOUBLE AS speculation FROM documents")
def speculation(s: SparkSession, d: str) -> DataFrame:
    return t.table(s, d, "documents").select("doc_id", quality.style(c("text"))["speculation"].cast("double").alias("speculation"))


@query("Q12_content_rank", with_("docs", "SELECT rid, round(confidence * CASE WHEN source = 'src2' THEN 1.5 ELSE 1 END * (1 + 0.5 * greatest(0, 1 - date_diff('day', published_at::DATE, DATE '2024-01-20') / 7)) * 1.2, 6) AS score FROM docs WHERE published_at IS NOT NULL"))
def content_rank(s: SparkSession, d: str) -> DataFrame:
    days = F.datediff(F.lit("2024-01-20").cast("date"), c("published_at").cast("date"))
    return t.documents(s, d).where("published_at IS NOT NULL").select("rid", F.round(quality.content_rank(c("confidence"), c("source") == "src2", days, F.array("lang")), 6).alias("score"))


@query("Q13_dbscan")
def dbscan(s: SparkSession, d: str) -> DataFrame:
    from sparkloom.plans.retrieval import vector_pairs

    return quality.dbscan(vector_pairs(s, d), t.vectors(s, d).select(c("vec_id").alias("id")), 3)


@query("Q14_trending", "SELECT topic, count(*) AS n FROM (SELECT lower(split_part(text, ' ', 1)) AS topic FROM documents) GROUP BY 1 HAVING count(*) >= 3 ORDER BY n DESC, topic")
def trending(s: SparkSession, d: str) -> DataFrame:
    return t.table(s, d, "documents").groupBy(F.lower(F.split_part("text", F.lit(" "), F.lit(1))).alias("topic")).agg(F.count(F.lit(1)).alias("n")).where("n >= 3").orderBy(c("n").desc(), "topic")


@query("Q15_health", "SELECT (SELECT count(*) FROM documents WHERE n_chars < 100) AS stale, (SELECT count(*) - count(DISTINCT doc_id) FROM documents) AS duplicate_ids, (SELECT count(*) FROM embeddings WHERE embedding IS NULL) AS null_embeddings")
def health(s: SparkSession, d: str) -> DataFrame:
    docs = t.table(s, d, "documents").agg(F.count_if(c("n_chars") < 100).alias("stale"), (F.count(F.lit(1)) - F.countDistinct("doc_id")).alias("duplicate_ids"))
    return docs.join(F.broadcast(t.table(s, d, "embeddings").agg(F.count_if(c("embedding").isNull()).alias("null_embeddings"))))


@query("Q16_integrity", "SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps FROM conversations GROUP BY 1 HAVING max(turn) - min(turn) + 1 - count(DISTINCT turn) >= 0")
def integrity(s: SparkSession, d: str) -> DataFrame:
    return t.table(s, d, "conversations").groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps")).where("gaps >= 0")


@query("Q17_retrieval_metrics", """WITH r AS (SELECT o_custkey AS q, l_partkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem JOIN orders ON o_orderkey = l_orderkey), tr AS (SELECT DISTINCT o_custkey AS q, l_partkey AS item FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_discount >= 0.08),
    n AS (SELECT q, count(*) AS true_n FROM tr GROUP BY 1), h AS (SELECT r.q, count(DISTINCT r.item) AS hits, min(rank) AS first FROM r JOIN tr ON tr.q = r.q AND tr.item = r.item WHERE rank <= 5 GROUP BY 1), qs AS (SELECT DISTINCT q FROM r)
    SELECT q AS query_id, round(CASE WHEN true_n IS NULL THEN 0 ELSE coalesce(hits, 0) / least(true_n, 5) END, 6) AS recall, round(coalesce(1.0 / first, 0), 6)::DOUBLE AS mrr FROM qs LEFT JOIN n USING (q) LEFT JOIN h USING (q)""")
def retrieval_metrics(s: SparkSession, d: str) -> DataFrame:
    j = t.table(s, d, "lineitem").join(t.table(s, d, "orders"), c("o_orderkey") == c("l_orderkey"))
    ranked = windows.numbered(j, ["o_custkey"], [c("l_extendedprice").desc(), c("l_orderkey"), c("l_linenumber")], "rank").select(c("o_custkey").alias("query_id"), "rank", c("l_partkey").alias("item"))
    truth = j.where("l_discount >= 0.08").select(c("o_custkey").alias("query_id"), c("l_partkey").alias("item")).distinct()
    return quality.retrieval_metrics(ranked, truth).select("query_id", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


@query("Q18_evidence_recall")
def evidence_recall(s: SparkSession, d: str) -> DataFrame:
    """Benchmark passages found in documents: candidates share the passage's first eight words, a text's every eight words."""
    grams = lambda x: F.transform(T.grams(x, 8), lambda g: F.xxhash64(g))
    b = t.table(s, d, "benchmark").select("item_id", F.explode(F.array_distinct(grams(T.terms(c("text"))))).alias("g"))
    docs = t.table(s, d, "documents")
    pairs = docs.select("doc_id", F.explode(F.array_distinct(grams(T.terms(c("text"))))).alias("g")).join(b.select("item_id", "g"), "g").select("item_id", "doc_id").distinct()
    hits = docs.select("doc_id", "text").join(pairs, "doc_id").join(t.table(s, d, "benchmark").select("item_id", c("text").alias("snippet")), "item_id")
    return hits.where(T.evidence_found("snippet", "text")).select("item_id", "doc_id")


@query("Q19_routing", """WITH d AS (SELECT o_orderkey AS draft, concat('nation:', c_nationkey) AS region, [o_orderpriority, o_orderstatus] AS tags, o_orderdate::DATE AS s, o_orderdate::DATE + 30 AS e, o_totalprice AS v, concat('region:', n_regionkey) AS wide FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderkey % 50 = 0),
    p AS (SELECT concat('pool:n', n_nationkey) AS pool, concat('nation:', n_nationkey) AS region, CASE n_nationkey % 3 WHEN 0 THEN ['1-URGENT', 'O'] WHEN 1 THEN ['F', '2-HIGH', 'P'] ELSE [] END AS tags, CASE WHEN n_nationkey % 4 > 0 THEN make_date(1992 + n_nationkey % 8, 1, 1) END AS s, CASE WHEN n_nationkey % 4 > 0 THEN make_date(1995 + n_nationkey % 8, 6, 30) END AS e, CASE WHEN n_nationkey % 2 = 0 THEN 400000.0 END AS threshold, n_nationkey * 20000.0 AS remaining FROM nation
        UNION ALL SELECT concat('pool:r', r_regionkey), concat('region:', r_regionkey), ['O'], NULL, NULL, NULL, 1000000.0 FROM region),
    x AS (SELECT draft, pool, CASE WHEN d.region = p.region THEN 30 WHEN d.wide = p.region THEN 15 ELSE 0 END AS region_score, CASE WHEN len(p.tags) = 0 THEN 0 ELSE round_even(25.0 * len(list_intersect(d.tags, p.tags)) / greatest(len(d.tags), len(p.tags)), 0)::BIGINT END AS tag_score,
        CASE WHEN p.s IS NULL THEN 15 WHEN least(d.e, p.e) > greatest(d.s, p.s) THEN round_even(15.0::DOUBLE * (least(d.e, p.e) - greatest(d.s, p.s)) / 30, 0)::BIGINT ELSE 0 END AS time_score, p.s IS NOT NULL AND least(d.e, p.e) <= greatest(d.s, p.s) AS apart,
        CASE WHEN v > 0 AND remaining > 0 AND v <= remaining THEN round_even(20 * CASE WHEN threshold > 0 THEN least(least(v / threshold, 1) + 0.5, 1) ELSE greatest(1 - v / remaining, 0.3) END, 0)::BIGINT ELSE 0 END AS capacity_score, v, remaining FROM d, p)
    SELECT draft, pool, region_score::BIGINT AS region_score, tag_score, time_score::BIGINT AS time_score, capacity_score, array_to_string(list_filter([CASE WHEN apart THEN 'outside_timeframe' END, CASE WHEN v > 0 AND remaining > 0 AND v > remaining THEN 'exceeds_capacity' END, CASE WHEN v > 0 AND remaining <= 0 THEN 'no_capacity' END], lambda z: z IS NOT NULL), ',') AS excludes,
        region_score + tag_score + time_score + capacity_score AS total, region_score + tag_score + time_score + capacity_score >= 60 AND NOT apart AND NOT (v > 0 AND v > remaining) AS recommended FROM x""")
def routing(s: SparkSession, d: str) -> DataFrame:
    """Every fiftieth order as a draft of its customer's nation, against pools of all nations and regions."""
    n = t.table(s, d, "nation")
    o = t.table(s, d, "orders").where("o_orderkey % 50 = 0").join(t.table(s, d, "customer"), c("o_custkey") == c("c_custkey"))
    day = c("o_orderdate").cast("date")
    drafts = o.select(c("o_orderkey").alias("draft"), F.concat(F.lit("nation:"), c("c_nationkey").cast("string")).alias("region"), F.array("o_orderpriority", "o_orderstatus").alias("tags"), day.alias("start"), F.date_add(day, 30).alias("end"), c("o_totalprice").alias("value"))
    k = c("n_nationkey")
    tags = F.when(k % 3 == 0, F.array(F.lit("1-URGENT"), F.lit("O"))).when(k % 3 == 1, F.array(F.lit("F"), F.lit("2-HIGH"), F.lit("P"))).otherwise(F.array().cast("array<string>"))
    dated = lambda year, rest: F.when(k % 4 > 0, F.to_date(F.concat((year + k % 8).cast("string"), F.lit(rest))))
    pools = n.select(F.concat(F.lit("pool:n"), k.cast("string")).alias("pool"), F.concat(F.lit("nation:"), k.cast("string")).alias("region"), tags.alias("tags"), dated(F.lit(1992), "-01-01").alias("start"), dated(F.lit(1995), "-06-30").alias("end"), F.when(k % 2 == 0, 400000.0).alias("threshold"), (k * 20000.0).alias("remaining"))
    wide = t.table(s, d, "region").select(F.concat(F.lit("pool:r"), c("r_regionkey").cast("string")).alias("pool"), F.concat(F.lit("region:"), c("r_regionkey").cast("string")).alias("region"), F.array(F.lit("O")).alias("tags"), F.lit(1000000.0).alias("remaining"))
    broader = n.select(F.concat(F.lit("nation:"), k.cast("string")).alias("narrow"), F.concat(F.lit("region:"), c("n_regionkey").cast("string")).alias("wide"))
    return quality.routing(drafts, pools.unionByName(wide, allowMissingColumns=True), broader).withColumn("excludes", F.array_join("excludes", ","))


@query("Q20_convergence", "SELECT l_partkey, count(DISTINCT l_suppkey) AS sources, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS stances, count(DISTINCT l_suppkey) >= 2 AS cross_project FROM lineitem GROUP BY 1")
def convergence(s: SparkSession, d: str) -> DataFrame:
    g = t.table(s, d, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("sources"), F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("stances"))
    return g.withColumn("cross_project", c("sources") >= 2)


@query("Q21_bands", "SELECT o_orderkey, CASE WHEN o_totalprice < 500 THEN 'auto' WHEN o_totalprice <= 5000 THEN 'semi' ELSE 'manual' END AS band FROM orders")
def bands(s: SparkSession, d: str) -> DataFrame:
    return t.table(s, d, "orders").select("o_orderkey", F.when(c("o_totalprice") < 500, "auto").when(c("o_totalprice") <= 5000, "semi").otherwise("manual").alias("band"))


@query("Q22_threads", "SELECT regexp_extract(url, '^(https?://[^/?#]+)', 1) AS thread, count(*) AS posts FROM pages GROUP BY 1")
def threads(s: SparkSession, d: str) -> DataFrame:
    p = t.table(s, d, "pages").select(F.regexp_extract("url", "^(https?://[^/?#]+)", 1).alias("url"), F.lit("Re: x").alias("title"), c("page_id").alias("published_at"))
    return quality.threads(p).select("thread", "posts")


@query("Q23_themes", "WITH w AS (SELECT doc_id AS id, lang, source FROM documents), n AS (SELECT tag, count(*) AS n FROM (SELECT lang AS tag FROM w UNION ALL SELECT source FROM w) GROUP BY 1) SELECT theme, count(*) AS items FROM (SELECT id, arg_max(tag, struct_pack(n := n, t := tag)) AS theme FROM (SELECT id, unnest([lang, source]) AS tag FROM w) JOIN n USING (tag) GROUP BY 1) GROUP BY 1")
def themes(s: SparkSession, d: str) -> DataFrame:
    items = t.table(s, d, "documents").select(c("doc_id").alias("id"), F.array("lang", "source").alias("tags"), "source")
    return quality.theme_clusters(items, "tags", "source")


@query("Q24_chunk_structure", "SELECT count(*) AS n, count(*) FILTER (WHERE contains(text, chr(10))) AS with_newline, count(*) FILTER (WHERE regexp_matches(text, '  +')) AS with_columns FROM documents")
def chunk_structure(s: SparkSession, d: str) -> DataFrame:
    return t.table(s, d, "documents").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.contains("text", F.lit("\n"))).alias("with_newline"), F.count_if(c("text").rlike("  +")).alias("with_columns"))


# ---- chunks -----------------------------------------------------------------------------------------------------


@query("K1_token_chunks")
def token_chunks(s: SparkSession, d: str) -> DataFrame:
    return K.chunk_tokens(t.table(s, d, "documents"), "doc_id", "text")


@query("K2_sentence_chunks")
def sentence_chunks(s: SparkSession, d: str) -> DataFrame:
    return K.chunk_tokens(t.table(s, d, "documents"), "doc_id", "text", sentences=True)


@query("K3_char_chunks", "SELECT doc_id, (p - 1) // 800 AS i, substr(text, p, 1000) AS chunk FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1, 800)) AS p FROM documents)")
def char_chunks(s: SparkSession, d: str) -> DataFrame:
    return t.table(s, d, "documents").select("doc_id", F.posexplode(K.chunk_chars(c("text"))).alias("i", "chunk"))


@query("K4_source_chunks")
def source_chunks(s: SparkSession, d: str) -> DataFrame:
    return K.chunk_by_source(t.table(s, d, "documents"), "doc_id", "text", "source")


# ---- streams ----------------------------------------------------------------------------------------------------


def _stream(s: SparkSession, d: str) -> DataFrame:
    return X.read_events(s, d).withColumn("ts", c("ts").cast("timestamp"))


@query("X1_enqueue", "SELECT event_id, ts + INTERVAL 24 HOUR AS expires_at FROM events")
def enqueue(s: SparkSession, d: str) -> DataFrame:
    return X.run_available(X.with_expiry(_stream(s, d), "ts").select("event_id", "expires_at")).withColumn("expires_at", c("expires_at").cast("timestamp_ntz"))


@query("X2_idempotent", "SELECT DISTINCT event_id FROM events")
def idempotent(s: SparkSession, d: str) -> DataFrame:
    return X.run_available(X.idempotent(_stream(s, d), ["event_id"], "ts", "3650 days").select("event_id"))


def _subscriptions(s: SparkSession) -> DataFrame:
    return s.createDataFrame([("n1", ["view", "click"]), ("n2", ["purchase"])], "node string, rid_types array<string>")


def _queued(s: SparkSession, d: str) -> DataFrame:
    return _stream(s, d).select("event_id", c("event_type").alias("rid_type"), F.lit("n0").alias("source_node"), F.when(c("value") > 95, "n2").alias("target_node"))


@query("X3_poll", "SELECT event_id, node FROM events, (VALUES ('n1', ['view', 'click']), ('n2', ['purchase'])) v(node, kinds) WHERE CASE WHEN value > 95 THEN node = 'n2' ELSE list_contains(kinds, event_type) END")
def poll(s: SparkSession, d: str) -> DataFrame:
    return X.run_available(X.deliver(_queued(s, d), _subscriptions(s)).select("event_id", "node"))


@query("X4_excluded", "SELECT event_id, node FROM events, (VALUES ('n1', ['view', 'click']), ('n2', ['purchase'])) v(node, kinds) WHERE coalesce(value, 0) <= 95 AND NOT list_contains(kinds, event_type)")
def excluded(s: SparkSession, d: str) -> DataFrame:
    return X.run_available(X.exclusions(_queued(s, d), _subscriptions(s)).select("event_id", "node"))


@query("X5_expiry", "SELECT event_id FROM events WHERE ts + INTERVAL 24 HOUR > (SELECT max(ts) FROM events) - INTERVAL 2 DAY")
def expiry(s: SparkSession, d: str) -> DataFrame:
    e = t.table(s, d, "events").withColumn("ts", c("ts").cast("timestamp"))
    last = e.agg(F.max("ts").alias("last"))
    return X.with_expiry(e, "ts").join(F.broadcast(last)).where(c("ts") + F.expr("INTERVAL 24 HOURS") > c("last") - F.expr("INTERVAL 2 DAYS")).select("event_id")


def _document_events(e: DataFrame) -> DataFrame:
    kind = F.when(c("event_type") == "purchase", "FORGET").when(c("event_type") == "view", "NEW").otherwise("UPDATE")
    return e.select(F.concat(F.lit("u:"), c("user_id").cast("string")).alias("rid"), kind.alias("event_type"), F.floor("value").cast("string").alias("content_hash"), "ts", c("event_id").alias("seq"))


@query("X6_versions")
def versions(s: SparkSession, d: str) -> DataFrame:
    """Versions by state in the stream; tests hold them against the batch form."""
    return X.run_available(X.versions(_document_events(_stream(s, d)).drop("seq")))


@query("X6_versions_batch", """WITH e AS (SELECT concat('u:', user_id) AS rid, CASE event_type WHEN 'purchase' THEN 'FORGET' ELSE 'PUT' END AS k, floor(value)::BIGINT::VARCHAR AS h, ts, event_id AS seq FROM events),
    l AS (SELECT *, lag(h) OVER w AS bh, lag(k) OVER w AS bk FROM e WINDOW w AS (PARTITION BY rid ORDER BY ts, seq)),
    f AS (SELECT * FROM l WHERE NOT (k <> 'FORGET' AND coalesce(bk <> 'FORGET', false) AND h IS NOT DISTINCT FROM bh) AND NOT (k = 'FORGET' AND coalesce(bk = 'FORGET', true)))
    SELECT rid, count(*) FILTER (WHERE k <> 'FORGET') AS versions FROM f GROUP BY 1 HAVING count(*) FILTER (WHERE k <> 'FORGET') > 0""")
def versions_batch(s: SparkSession, d: str) -> DataFrame:
    e = t.table(s, d, "events").withColumn("ts", c("ts").cast("timestamp"))
    return temporal.reduce_versions(_document_events(e)).groupBy("rid").agg(F.max("version").alias("versions"))


@query("X7_dispatch", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def dispatch(s: SparkSession, d: str) -> DataFrame:
    """Events by domain, each batch in its own rows; the last word on a domain is its last batch's."""
    counts = X.run_available(_stream(s, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "update")
    return windows.first_per(counts, ["event_type"], [c("batch").desc()]).drop("batch")


@query("X9_coalesced", """WITH g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events))
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS events FROM g GROUP BY user_id, k""")
def coalesced(s: SparkSession, d: str) -> DataFrame:
    e = t.table(s, d, "events").withColumn("ts", c("ts").cast("timestamp"))
    return X.coalesced(e, "user_id", "ts", "6 hours").select("user_id", *[c(x).cast("timestamp_ntz").alias(x) for x in ("start", "end")], "events")


@query("X12_hourly", "SELECT date_trunc('hour', ts) AS window_start, count(*) AS n FROM events GROUP BY 1")
def hourly(s: SparkSession, d: str) -> DataFrame:
    e = t.table(s, d, "events").withColumn("ts", c("ts").cast("timestamp"))
    return X.rate_metrics(e, "ts", "value").select(c("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query("X13_incremental", "SELECT user_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS event_type FROM events GROUP BY 1")
def incremental(s: SparkSession, d: str) -> DataFrame:
    e = t.table(s, d, "events").withColumn("rev", F.struct("ts", "event_id"))
    return X.latest_revisions(e.select("user_id", "event_type", "rev"), "user_id", "rev").select("user_id", "event_type")


@query("X14_limiter", """WITH RECURSIVE w(user_id, window_start) AS (SELECT user_id, min(ts) FROM events GROUP BY 1 UNION ALL SELECT w.user_id, min(e.ts) FROM w JOIN events e ON e.user_id = w.user_id AND e.ts >= w.window_start + INTERVAL 1 HOUR GROUP BY w.user_id)
    SELECT w.user_id, window_start, count(*) AS requests FROM w JOIN events e ON e.user_id = w.user_id AND e.ts >= window_start AND e.ts < window_start + INTERVAL 1 HOUR GROUP BY 1, 2""")
def limiter(s: SparkSession, d: str) -> DataFrame:
    e = t.table(s, d, "events").withColumn("ts", c("ts").cast("timestamp"))
    return temporal.fixed_window_counts(e, "user_id", "ts", 3600).withColumn("window_start", c("window_start").cast("timestamp_ntz"))


@query("X15_trailing_hour", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts))::BIGINT RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS trailing FROM events")
def trailing(s: SparkSession, d: str) -> DataFrame:
    e = t.table(s, d, "events").withColumn("ts", c("ts").cast("timestamp"))
    return temporal.trailing_counts(e, "user_id", "ts", 3600).select("event_id", "trailing")

