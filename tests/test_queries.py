"""Every query with an SQL twin gives the same rows as DuckDB; streams equal their batch forms."""

from __future__ import annotations

import os

import duckdb
import pytest

from sparkloom.plans import catalog
from sparkloom.plans.knowledge import LARGE_CALLS, _document_events
from sparkloom.operators import temporal
from sparkloom.sources import tables as t


def shown(v) -> str:  # noqa: ANN001
    return "null" if v is None or v != v else repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck(sf):  # noqa: ANN001, ANN201
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, sf, duck, name):  # noqa: ANN001
    got = catalog.QUERIES[name](spark, sf)
    want = duck.sql(catalog.SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(shown(r[c]) for c in cols) for r in got.collect()) == sorted(tuple(shown(r[k]) for k in at) for r in want.fetchall())


#: Queries without SQL whose rows test_results.py compares; the others have tests below.
ELSEWHERE = {"C5_token_sort_ratio", "C11_phonetic", "E1_tiered_resolver", "E2_fuzzy", "E4_registry_fuzzy", "E7_dedup_proposals", "G11_communities", "G15_label_propagation", "G16_cohesion", "G23_community_members", "H2_canonical_json", "K1_token_chunks", "K2_sentence_chunks", "K4_source_chunks", "L2_indexed_top_k", "Q13_dbscan", "Q18_evidence_recall", "R7_mmr", "R13_idds", "R31_contextual_candidates"}


def test_every_query_has_a_test():
    assert set(catalog.QUERIES) - set(catalog.SQL) == ELSEWHERE | {"G12_betweenness", "G18_flows", "X6_versions"}


def test_stream_versions_equal_batch(spark, sf):  # noqa: ANN001
    events = spark.read.parquet(f"{sf}/events.parquet")
    batch = temporal.reduce_versions(_document_events(events.withColumn("ts", events["ts"].cast("timestamp"))))
    stream = catalog.QUERIES["X6_versions"](spark, sf).where("change = 'written'")
    key = lambda df: sorted((r["rid"], r["version"], r["content_hash"]) for r in df.collect())
    assert key(stream) == key(batch)


def test_betweenness_takes_all_sources_and_edges(spark, sf):  # noqa: ANN001
    near: dict[str, set[str]] = {}
    for r in t.edges(spark, sf).collect():
        near.setdefault(r["subject"], set()).add(r["object"])
        near.setdefault(r["object"], set()).add(r["subject"])
    want = dict.fromkeys(near, 0.0)
    for source in near:
        dist, paths, order = {source: 0}, {source: 1}, [source]
        for u in order:
            for v in near[u]:
                if v not in dist:
                    dist[v], paths[v] = dist[u] + 1, 0
                    order.append(v)
                if dist[v] == dist[u] + 1:
                    paths[v] += paths[u]
        delta = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for u in near[v]:
                if dist[u] == dist[v] - 1:
                    delta[u] += paths[u] / paths[v] * (1 + delta[v])
            want[v] += delta[v] if v != source else 0
    got = {r["node"]: r["betweenness"] for r in catalog.QUERIES["G12_betweenness"](spark, sf).collect()}
    assert len(got) > 0 and set(got) <= set(want)
    assert all(abs(got.get(k, 0.0) - v) < 1e-3 for k, v in want.items())


def test_flows_have_the_limits_of_the_reference(spark, sf, duck):  # noqa: ANN001
    onward: dict[str, list[str]] = {}
    for a, b in sorted(duck.sql(f"WITH {LARGE_CALLS} SELECT source, target FROM calls").fetchall()):
        onward.setdefault(a, []).append(b)
    want = set()
    for entry in sorted(onward, key=lambda x: (-len(onward[x]), x))[:200]:
        queue, looked = [[entry]], 0
        while queue and looked < 2000:
            path, looked = queue.pop(0), looked + 1
            new = [x for x in onward.get(path[-1], [])[:4] if x not in path]
            if len(path) >= 2 and (len(path) == 10 or not new):
                want.add(">".join(path))
            elif len(path) < 10:
                queue += [[*path, x] for x in new]
    got = [r["path"] for r in catalog.QUERIES["G18_flows"](spark, sf).collect()]
    assert sorted(got) == sorted(want)


def test_receipts_take_the_first_of_equal_lines(spark, sf, tmp_path):  # noqa: ANN001
    """Lines that share a number, in many row groups that are read as splits of their own, and null parts and numbers."""
    con = duckdb.connect()
    con.execute("SET threads = 1")  # with more, DuckDB's own choice among equal lines changes from run to run
    con.execute(f"COPY (SELECT * FROM '{sf}/orders.parquet') TO '{tmp_path}/orders.parquet'")
    part = "CASE WHEN i % 11 = 0 THEN NULL ELSE i END"
    con.execute(f"COPY (SELECT i % 700 AS l_orderkey, {part} AS l_partkey, CASE WHEN i % 13 = 0 THEN NULL ELSE (i // 9000 % 2)::INTEGER END AS l_linenumber FROM range(60000) r(i)) TO '{tmp_path}/lineitem.parquet' (ROW_GROUP_SIZE 2048)")
    for n in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{tmp_path}/{n}.parquet'")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = {r["o_orderkey"]: r["first_part"] for r in catalog.QUERIES["J18_receipt_chain"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert got == {o: p for o, _, p in con.sql(catalog.SQL["J18_receipt_chain"]).fetchall()}


def test_two_hops_shuffle_no_row_a_pair(spark, sf, duck):  # noqa: ANN001
    """A person's suppliers come out of one array, by explode, after the last shuffle."""
    df = catalog.QUERIES["J12_two_hops"](spark, sf)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan and plan.index("Generate explode") < plan.index("RepartitionByExpression") < plan.index("Join")
    assert df.count() == duck.sql(f"SELECT count(*) FROM ({catalog.SQL['J12_two_hops']})").fetchall()[0][0]
