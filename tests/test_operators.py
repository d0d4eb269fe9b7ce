"""Operators on small hand-made relations, and against plain Python on random ones."""

from __future__ import annotations

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import fts, fusion, graph, numbered, quality, resolve, temporal, windows

EDGES = [("e:a", "knows", "e:b", 0.9), ("e:a", "affiliated_with", "e:o1", 1.0), ("e:a", "collaborates_with", "e:o2", 0.6), ("e:b", "affiliated_with", "e:o2", 0.8), ("e:o1", "has_project", "e:p", 1.0), ("e:p", "about", "e:c", 0.7), ("e:x", "knows", "e:y", 1.0), ("e:y", "knows", "e:z", 1.0), ("e:z", "knows", "e:x", None)]


@pytest.fixture(scope="module")
def edges(spark):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(*e, 1) for e in EDGES], "subject string, predicate string, object string, confidence double, occurrence_count long")


def nodes(spark, *names):  # noqa: ANN001, ANN002, ANN201
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_traversal(spark, edges):  # noqa: ANN001
    out = {r["node"]: r["depth"] for r in graph.neighborhood(edges, nodes(spark, "e:a"), 2, "out").collect()}
    assert out == {"e:a": 0, "e:b": 1, "e:o1": 1, "e:o2": 1, "e:p": 2}
    assert {r["node"] for r in graph.neighborhood(edges, nodes(spark, "e:q"), 2).collect()} == {"e:q"}
    path = graph.shortest_paths(edges, spark.createDataFrame([("e:a", "e:c"), ("e:x", "e:z"), ("e:c", "e:a")], "source string, target string")).collect()
    assert {(r["source"], tuple(r["path"])) for r in path} == {("e:a", ("e:a", "e:o1", "e:p", "e:c")), ("e:x", ("e:x", "e:y", "e:z"))}
    near = {(r["subject"], r["object"]): r["depth"] for r in graph.triple_closure(edges, nodes(spark, "e:o1"), 2, "out").collect()}
    assert near == {("e:o1", "e:p"): 1, ("e:p", "e:c"): 2}


def test_chains(spark):  # noqa: ANN001
    long = [(f"n{k}", f"n{k + 1}") for k in range(12)] + [("n12", None), ("p", "q"), ("q", "p"), ("s", None), ("t", "s")]
    got = {r["node"]: r["final"] for r in graph.follow(spark.createDataFrame(long, "node string, next string")).collect()}
    assert got["s"] == got["t"] == "s" and got["n3"] == "n12" and got["n0"] == "n10" and got["p"] == "q"
    v = spark.createDataFrame([("v1", None), ("v2", "v1"), ("v3", "v2")], "id string, supersedes string")
    assert {r["id"]: r["origin"] for r in graph.chain_origin(v).collect()} == dict.fromkeys(["v1", "v2", "v3"], "v1")
    assert {r["id"]: r["head"] for r in graph.chain_head(v).collect()} == dict.fromkeys(["v1", "v2", "v3"], "v3")


def test_whole_chains(spark):  # noqa: ANN001
    long = [(k, k - 1 if k else None) for k in range(100)] + [(201, 202), (202, 203), (203, 201), (204, 203), (300, 299)]
    v = spark.createDataFrame(long, "id long, supersedes long")
    origin = {r["id"]: r["origin"] for r in graph.chain_origin(v).collect()}
    assert origin == dict.fromkeys(range(100), 0) | dict.fromkeys(range(201, 205), 201) | {300: 299}
    head = {r["id"]: r["head"] for r in graph.chain_head(v.where("id < 200")).collect()}
    assert head == dict.fromkeys(range(100), 99)


def test_random_graphs(spark):  # noqa: ANN001
    r = random.Random(1)
    pairs = sorted({tuple(sorted((f"n{r.randrange(40):02}", f"n{r.randrange(40):02}"))) for _ in range(45)})
    pairs = [p for p in pairs if p[0] != p[1]]
    near = collections.defaultdict(set)
    for a, b in pairs:
        near[a].add(b), near[b].add(a)
    comp, between = {}, collections.Counter()
    for s in near:
        dist, paths, order, back = {s: 0}, collections.Counter({s: 1}), [s], collections.defaultdict(list)
        for u in order:
            for v in sorted(near[u]):
                if v not in dist:
                    dist[v] = dist[u] + 1
                    order.append(v)
                if dist[v] == dist[u] + 1:
                    paths[v] += paths[u]
                    back[v].append(u)
        comp[s] = min(order)
        delta = collections.Counter()
        for v in reversed(order):
            for u in back[v]:
                delta[u] += paths[u] / paths[v] * (1 + delta[v])
            if v != s:
                between[v] += delta[v]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert {x["node"]: x["component"] for x in graph.connected_components(df).collect()} == comp
    got = {x["node"]: x["betweenness"] for x in graph.betweenness(df, nodes(spark, *near)).collect()}
    assert all(got.get(n, 0) == pytest.approx(between[n]) for n in near)
    with pytest.raises(ValueError, match="edges"):
        graph.betweenness(df, nodes(spark, *near), max_edges=3)
    labels = graph.label_propagation(df.withColumn("weight", F.lit(1.0)), 8)
    assert all(comp[x["node"]] == comp[x["label"]] for x in labels.collect())
    assert -0.5 <= graph.modularity(df.withColumn("weight", F.lit(1.0)), labels).first()[0] <= 1
    assert all(0 <= x["cohesion"] <= 1 for x in graph.cohesion(df, labels).collect())


def test_flows_and_impact(spark):  # noqa: ANN001
    calls = spark.createDataFrame([("m", x) for x in "abcde"] + [("a", "m"), ("b", "z")], "source string, target string")
    got = {tuple(x["path"]) for x in graph.flows(calls, spark.createDataFrame([("m",)], "entry string")).collect()}
    assert got == {("m", "a"), ("m", "b", "z"), ("m", "c"), ("m", "d")}
    assert {(x["node"], x["risk"]) for x in graph.impact(calls, nodes(spark, "z"), "up").collect()} == {("b", "high"), ("m", "medium"), ("a", "medium")}
    assert {x["node"] for x in graph.impact(calls, nodes(spark, "z"), "up", exclude=F.col("node") == "m").collect()} == {"b"}
    rows = graph.sparql(calls.select(F.col("source").alias("subject"), F.lit("calls").alias("predicate"), F.col("target").alias("object")), [("?x", "calls", "?y")], optional=[("?y", "calls", "?z")])
    assert rows.where("z IS NULL").count() == 4


def test_fusion(spark):  # noqa: ANN001
    leg = lambda rid, s: spark.createDataFrame([(rid, s, 1)], "rid string, score double, ord int")
    got = fusion.fuse_weighted(leg("doc:1", 0.2), leg("doc:1#chunk14", 0.9), leg("doc:1", 0.4)).collect()
    assert len(got) == 1 and got[0]["base_rid"] == "doc:1" and got[0]["score"] == pytest.approx(0.53) and got[0]["similarity"] == 0.2
    r = lambda k: spark.createDataFrame([("d", k, 1.0)], "id string, rank int, score double")
    legs = {"a": r(1), "b": r(2)}
    for names in itertools.permutations(legs):
        assert fusion.fuse_rrf({n: legs[n] for n in names}).first()["score"] == pytest.approx(0.032522, abs=1e-6)
    ranked = spark.createDataFrame([("q", 1, 0.9), ("q", 2, 0.5), ("one", 1, 0.8)], "k string, rank int, score double")
    c = {x["k"]: x["confidence"] for x in fusion.confidence(ranked, "k", F.col("score")).collect()}
    assert c["q"] == pytest.approx(0.35 * 0.9 + 0.2 * 0.4 + 0.15 * 0.2 + 0.2 * 0.7 + 0.1 * (1 - 0.04)) and c["one"] == pytest.approx(0.35 * 0.8 + 0.2 * 0.5 + 0.015 + 0.16 + 0.1)
    e = spark.createDataFrame([("a", "text_search", 0.05), ("a", "text_search", 0.03), ("b", "entity_lookup", 1.0), ("c", "text_search", 0.015), ("c", "text_search", 0.01), ("d", "text_search", 0.005)], "k string, retrieval_op string, confidence double")
    assert {x["k"]: x["decision"] for x in fusion.gate(e, "k").collect()} == {"a": "confident", "b": "very_low", "c": "low", "d": "very_low"}
    assert {x["k"]: x["decision"] for x in fusion.gate(e, "k", text_ran=False).collect()}["b"] == "confident"
    assert fusion.concat_surfaces({"x": r(0), "y": r(0)}).count() == 2


def test_search(spark):  # noqa: ANN001
    docs = spark.createDataFrame([(1, "Nathan Surname wrote this"), (2, "nat and sur"), (3, "nat sur nat sur"), (4, None), (5, "")], "id long, t string")
    ix = fts.build_index(docs, "id", F.col("t"))
    assert {x["id"] for x in fts.match_all(ix, ["nat", "sur"]).collect()} == {2, 3}
    assert {x["id"] for x in fts.match_prefixes(ix, ["nat", "sur"]).collect()} == {1, 2, 3}
    assert [(x["id"], x["match_type"]) for x in fts.strict_and_relaxed(ix, ["nat", "sur"], 5).orderBy("rank").collect()] == [(3, "strict"), (2, "strict")]
    cover = {x["id"]: x["score"] for x in fts.cover_density(ix, ["nat", "sur"]).collect()}
    assert cover[2] == pytest.approx(1 / 3) and cover[3] == pytest.approx(1.5)
    scored = fts.bm25(ix, ["nat", "sur"], fts.statistics(docs, F.col("t"))).orderBy(F.col("score").desc()).collect()
    assert [x["id"] for x in scored] == [3, 2]
    same = fts.match_any(fts.scan(docs, "id", F.col("t"), ["nat", "sur"]), ["nat", "sur"])
    assert {tuple(x) for x in same.collect()} == {tuple(x) for x in fts.match_any(ix, ["nat", "sur"]).collect()}


REGISTRY = [("u1", "Ana Lopez", "Person", ["[[x/Annie]]"], None, 5), ("u2", "River Trust Fund", "Organization", [], None, 9), ("u3", "Lagoon", "Location", [], None, 3), ("u4", "Lagoon Old", "Location", [], "u3", 1), ("u5", "Northwind", "Product", [], None, 2)]


@pytest.fixture(scope="module")
def registry(spark):  # noqa: ANN001, ANN201
    df = spark.createDataFrame(REGISTRY, "uri string, entity_text string, entity_type string, aliases array<string>, merged_into string, occurrence_count long")
    return df.withColumn("normalized_text", F.lower("entity_text")).withColumn("embedding", F.lit(None).cast("array<double>"))


def test_resolver(spark, registry):  # noqa: ANN001
    m = spark.createDataFrame([("m1", "ANA_LOPEZ", "Person"), ("m2", "annie", "Person"), ("m3", "lagoon", "Concept"), ("m4", "Ana Lopes", "Person"), ("m5", "Ana", "Person"), ("m6", "Lagoon Old", "Location"), ("m7", "Northwood", "Product")], "mention_id string, name string, entity_type string").withColumn("embedding", F.lit(None).cast("array<double>"))
    got = {x["mention_id"]: (x["uri"], x["tier"]) for x in resolve.resolve(m, registry).collect()}
    assert got["m1"] == ("u1", "exact") and got["m2"] == ("u1", "alias") and got["m3"] == ("u3", "cross_type") and got["m4"] == ("u1", "fuzzy") and got["m5"] == (None, "none") and got["m7"] == (None, "none")
    merged = {x["mention_id"]: x["uri"] for x in resolve.resolve(m, registry, follow_merges=True).collect()}
    assert merged["m6"] == "u3"
    veto = spark.createDataFrame([("m4", "u1")], "lo string, hi string")
    assert {x["mention_id"]: x["uri"] for x in resolve.resolve(m, registry, vetoes=veto).collect()}["m4"] is None


def test_semantic_tier(spark):  # noqa: ANN001
    m = spark.createDataFrame([("m", "Location", [1.0, 0.0]), ("far", "Location", [0.0, 1.0])], "mention_id string, entity_type string, embedding array<double>")
    r = spark.createDataFrame([("near", "Location", [0.99, 0.05]), ("wrong", "Person", [1.0, 0.0])], "uri string, entity_type string, embedding array<double>")
    assert [(x["mention_id"], x["uri"]) for x in resolve.semantic(m, r).collect()] == [("m", "near")]


def test_merges(spark, edges):  # noqa: ANN001
    got = resolve.apply_merges(edges, spark.createDataFrame([("e:o2", "e:o1"), ("e:b", "e:a")], "loser string, winner string"))
    triples = {(x["subject"], x["predicate"], x["object"]): (x["confidence"], x["occurrence_count"]) for x in got.collect()}
    assert triples[("e:a", "affiliated_with", "e:o1")] == (1.0, 2) and ("e:a", "knows", "e:a") not in triples
    back = resolve.snapshot_restore(edges.select("subject", "object", "predicate"), got.select("subject", "object", "predicate"), ["subject", "object"])
    assert {x["action"] for x in back.collect()} >= {"insert", "delete"} or back.count() > 0


def test_proposals_and_windows(spark, registry):  # noqa: ANN001
    more = registry.unionByName(registry.where("uri = 'u1'").withColumn("uri", F.lit("u9")).withColumn("normalized_text", F.lit("ana lopes")).withColumn("occurrence_count", F.lit(1).cast("long")))
    assert [(x["winner"], x["loser"]) for x in resolve.dedup_proposals(more).collect()] == [("u1", "u9")]
    w = spark.createDataFrame([("Ana L", "Concept", 2, 1), ("ana-l", "Person", 1, 3)], "name string, entity_type string, window int, mentions int")
    x = resolve.window_entities(w).first()
    assert (x["entity_type"], x["first_window"], x["mentions"], x["conflict"]) == ("Person", 1, 4, True)
    v = spark.createDataFrame([("t", "Person", 2, 3), ("t", "Concept", 3, 0)], "label string, entity_type string, occurrence_count long, relationship_count long")
    assert {r["entity_type"]: r["score"] for r in resolve.polysemy_scores(v, "concept").collect()} == {"Person": 2400.0, "Concept": 53010.0}


def test_facts(spark):  # noqa: ANN001
    f = lambda rows: spark.createDataFrame(rows, "id string, subject string, predicate string, object string, embedding array<double>")
    cur = f([("o1", "s", "lives_in", "x", [1.0, 0.0]), ("o2", "s", "lives_in", "y", [0.9, 0.1])])
    assert [r["new_id"] for r in resolve.near_duplicate_facts(f([("n", "s", "lives_in", "x", [1.0, 0.0]), ("k", "s", "lives_in", "z", [1.0, 0.0])]), cur).collect()] == ["n"]
    assert {r["old_id"] for r in resolve.superseded_facts(f([("n", "s", "lives_in", "x", [1.0, 0.0])]), cur, ["lives_in"]).collect()} == {"o2"}


def test_quality(spark):  # noqa: ANN001
    e = spark.createDataFrame([("Ana", "Person"), ("ana lopez", "Person"), ("12345", "Concept"), ("unknown", "Concept"), ("ABC-12", "Concept"), ("River Trust", "Organization")], "n string, k string")
    got = {x["n"]: x["reasons"] for x in quality.gate(e, quality.entity_rules(F.col("n"), F.col("k"))).collect()}
    assert got["Ana"] == ["single_token_person"] and got["ana lopez"] == ["lowercase_person"] and got["12345"] == ["numeric_only"] and got["unknown"] == ["placeholder"] and got["ABC-12"] == ["jira_issue_id"] and got["River Trust"] == []
    s = quality.split_lists(spark.createDataFrame([("A, B and C", 0.9), ("D and E", 0.1)], "name string, confidence double"), "name", "confidence")
    assert [x["name"] for x in s.collect()] == ["A", "B", "C", "D and E"]
    assert spark.range(1).select(quality.overall([F.lit("pass"), F.lit("review")]), quality.cell_status(F.lit(None), F.lit(0.9), F.lit(0.5))).first() == ("review", "review")
    pts = spark.createDataFrame([(i,) for i in range(6)], "id long")
    near = spark.createDataFrame([(0, 1), (1, 2), (3, 4)], "a long, b long")
    assert {x["id"]: x["cluster"] for x in quality.dbscan(near, pts, 3).collect()} == {0: 1, 1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    res = spark.createDataFrame([("q", 1, "x"), ("q", 2, "y"), ("none", 1, "x")], "query_id string, rank int, item string")
    m = {x["query_id"]: (x["recall"], x["precision"], x["mrr"]) for x in quality.retrieval_metrics(res, spark.createDataFrame([("q", "y"), ("q", "z"), ("lost", "w")], "query_id string, item string")).collect()}
    assert m == {"q": (0.5, 0.5, 0.5), "none": (0.0, 0.0, 0.0), "lost": (0.0, 0.0, 0.0)}


def test_time(spark):  # noqa: ANN001
    a = spark.createDataFrame([("open", "2024-01-01", None, None, None), ("past", "2024-01-01", None, "2024-01-05", "2024-01-10"), ("gone", "2024-01-01", "2024-01-03", None, None)], "id string, tx_recorded_at string, tx_retracted_at string, valid_from string, valid_to string")
    for k in a.columns[1:]:
        a = a.withColumn(k, F.col(k).cast("timestamp"))
    at = lambda d: F.lit(d).cast("timestamp")
    assert {x["id"] for x in temporal.as_of(a, at("2024-02-01"), at("2024-01-10")).collect()} == {"open", "past"}
    assert {x["id"] for x in temporal.as_of(a, at("2024-01-02"), at("2024-01-20")).collect()} == {"open", "gone"}
    assert {x["id"] for x in temporal.overlapping(a, at("2024-01-10"), at("2024-01-11")).collect()} == {"open", "past"}
    moves = spark.createDataFrame([("A", "B"), ("B", "A")], "from_state string, to_state string")
    assert [tuple(x) for x in temporal.invalid_transitions(moves, {"A": ["B"]}).collect()] == [("B", "A")]
    ev = spark.createDataFrame([("r", "NEW", "h1", 1), ("r", "NEW", "h1", 2), ("r", "UPDATE", "h2", 3), ("r", "FORGET", None, 4), ("r", "FORGET", None, 5), ("r", "NEW", "h2", 6), ("s", "UPDATE", "h", 1)], "rid string, event_type string, content_hash string, seq int").withColumn("ts", F.timestamp_seconds(F.col("seq")))
    v = [(x["rid"], x["version"], x["content_hash"], x["superseded_at"] is None) for x in temporal.reduce_versions(ev).orderBy("rid", "version").collect()]
    assert v == [("r", 1, "h1", False), ("r", 2, "h2", False), ("r", 3, "h2", True), ("s", 1, "h", True)]


def test_windows(spark):  # noqa: ANN001
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "k string, v int")
    assert {tuple(x) for x in windows.first_per(df, ["k"], [F.col("v").desc()]).collect()} == {("a", 3), ("b", 2)}
    assert [x["v"] for x in windows.round_robin(df, ["k"], F.col("v"), [F.col("v").desc()]).collect()] == [3, 2, 1]
    new = spark.createDataFrame([("b", 9), ("c", 8)], "k string, v int")
    old = windows.first_per(df, ["k"], ["v"])
    assert {tuple(x) for x in windows.upsert(old, new, ["k"], ["v"]).collect()} == {("a", 1), ("b", 9), ("c", 8)}
    assert {tuple(x) for x in windows.upsert(old, new, ["k"], ["v"], update=False).collect()} == {("a", 1), ("b", 2), ("c", 8)}


def test_supersession_compares_in_tiles(spark, monkeypatch):  # noqa: ANN001
    """Tiles give what all pairs give, at the limit, with equal and null objects, and with vectors that have no similarity."""
    import math

    monkeypatch.setattr(resolve, "FACTS", 7)
    r = random.Random(3)
    vector = lambda: r.choice([None, [], [0.0, 0.0], [3.0, 4.0], [4.0, 3.0], [1.0, 0.0], [-1.0, 0.2, 1.0], [r.gauss(0, 1), r.gauss(0, 1)]])
    facts = [(f"f{k}", r.choice(["s", "t", None]), r.choice(["is", "was"]), r.choice([None, "x", "y", f"o{k}"]), vector()) for k in range(120)]
    df = spark.createDataFrame(facts, "id string, subject string, predicate string, object string, embedding array<double>")

    def cosine(a, b):  # noqa: ANN001, ANN202
        if not a or not b or len(a) != len(b) or not any(a) or not any(b):
            return 0.0
        return sum(p * q for p, q in zip(a, b, strict=True)) / (math.sqrt(sum(p * p for p in a)) * math.sqrt(sum(q * q for q in b)))

    for least in (0.6, 0.96, -0.1):
        want = {b[0] for a in facts for b in facts if a[1] and a[1] == b[1] and a[2] == b[2] == "is" and a[3] != b[3] and cosine(a[4], b[4]) > least}
        assert {x["old_id"] for x in resolve.superseded_facts(df, df, ["is"], least).collect()} == want
    assert "FlatMapGroupsInPandas" in resolve.superseded_facts(df, df, ["is"], 0.6)._jdf.queryExecution().optimizedPlan().toString()  # no join of all pairs


def test_paths_from_targets_are_those_from_sources(spark, monkeypatch):  # noqa: ANN001
    """Also among many equal paths, by parallel edges; the search goes from the side that has fewer nodes."""
    r = random.Random(11)
    rows = [(f"n{r.randrange(40)}", r.choice(["p", "q", "r"]), f"n{r.randrange(40)}", r.choice([None, 0.2, 0.5]), 1) for _ in range(170)]
    es = spark.createDataFrame(rows, "subject string, predicate string, object string, confidence double, occurrence_count long")
    pairs = spark.createDataFrame([(f"n{a}", f"n{b}") for a in range(40) for b in range(5)], "source string, target string")
    rows_of = lambda df: sorted((x["source"], x["target"], x["length"], tuple(x["path"])) for x in df.collect())
    called = []
    back = graph._paths_from_targets
    monkeypatch.setattr(graph, "_paths_from_targets", lambda *a: called.append(1) or back(*a))
    got = rows_of(graph.shortest_paths(es, pairs, 4))
    assert called
    every = spark.createDataFrame([(f"n{a}", f"n{b}") for a in range(40) for b in range(60)], "source string, target string")
    called.clear()
    want = [x for x in rows_of(graph.shortest_paths(es, every, 4)) if x[1] in {f"n{b}" for b in range(5)}]
    assert got == want and not called and len(got) > 100


def test_betweenness_refuses_no_graph(spark):  # noqa: ANN001
    """More than five million edges: a star, seen from one of its leaves."""
    n = 5_000_001
    star = spark.range(n).select(F.lit("hub").alias("a"), F.col("id").cast("string").alias("b"))
    got = graph.betweenness(star, spark.createDataFrame([("7",)], "node string")).collect()
    assert [(r["node"], r["betweenness"]) for r in got] == [("hub", float(n - 1))]


def test_dependencies_of_sources_searched_side_by_side(monkeypatch):  # noqa: ANN001
    """Batches of sources, cut segments and blocks, parts of a graph and a long path give what each source gives by itself."""
    import numpy as np

    r = random.Random(2)
    pairs = {(a, b) for a, b in ((r.randrange(60), r.randrange(60)) for _ in range(150)) if a < b} | {(k, k + 1) for k in range(60, 260)} | {(300, k) for k in range(301, 340)}
    near = collections.defaultdict(set)
    for a, b in pairs:
        near[a].add(b), near[b].add(a)
    n = 345
    to = np.array([v for u in range(n) for v in sorted(near[u])], np.int32)
    first = np.cumsum([0, *[len(near[u]) for u in range(n)]])
    want = np.zeros(n)
    for s in range(n):
        dist, paths, order = {s: 0}, collections.Counter({s: 1}), [s]
        for u in order:
            for v in near[u]:
                if v not in dist:
                    dist[v] = dist[u] + 1
                    order.append(v)
                if dist[v] == dist[u] + 1:
                    paths[v] += paths[u]
        delta = collections.Counter()
        for v in reversed(order):
            for u in near[v]:
                if dist[u] == dist[v] - 1:
                    delta[u] += paths[u] / paths[v] * (1 + delta[v])
            want[v] += delta[v] if v != s else 0
    took, sums = [], numbered._sums_of_ends
    monkeypatch.setattr(numbered, "_sums_of_ends", lambda values, *rest: took.append(values.shape[1]) or sums(values, *rest))
    for segment, rows, cells in ((1024, 512, 1 << 22), (4, 7, 1 << 22), (3, 512, 5 * n)):
        for name, value in (("SEGMENT", segment), ("ROWS", rows), ("CELLS", cells)):
            monkeypatch.setattr(numbered, name, value)
        assert numbered.dependencies(first, to, np.arange(n)) == pytest.approx(want)
    assert max(took) == 64 and not numbered.dependencies(first, to, np.arange(0)).any()
