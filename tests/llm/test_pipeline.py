"""The pipeline's stages: columns, what they keep, and hostile rows."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from sparkloom.llm.queries import QUERIES


def test_stages(spark, sf):  # noqa: ANN001
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
            docs = corpus_pipeline.cut(out, "test")
        sizes.append(out.count())
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 100 and sizes[4] == sizes[5]
    assert out.where("NOT round_trip").count() == 0


def test_stages_on_hostile_rows(spark, sf):  # noqa: ANN001
    rows = [(1, "a b c d e f", "s"), (1, "a b c d e f", "t"), (2, "a b c d e f", None), (None, None, None), (None, None, "s"), (3, "", "s"), (4, "other words entirely here now", "s"), (4, "one identifier, another text", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert corpus_pipeline.exact(spark, docs, sf).count() == 4
    assert corpus_pipeline.near(spark, docs, sf).where("doc_id = 2").count() == 0
    mixed = corpus_pipeline.mix(spark, docs, sf)
    assert mixed.columns == docs.columns and mixed.count() > 0
    empty = docs.limit(0)
    assert all(stage(spark, empty, sf).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_queries_are_whole(spark, sf):  # noqa: ANN001
    n = spark.read.parquet(f"{sf}/documents.parquet").agg(F.count(F.lit(1))).first()[0]
    for name in ("op2_pii", "op4_token_counts", "op8_quality_rules", "op10_toxicity"):
        assert QUERIES[name](spark, sf).count() == n


CLASHES = {"_judged": "long", "judged": "string", "sha": "string", "kept_id": "long", "kept_sha": "string", "_id": "long", "k1": "long", "K2": "string", "_k1": "long", "positions": "long", "position": "string", "_position": "long", "component": "long", "kept": "boolean", "key": "string", "id": "long", "size": "long", "ids": "string", "name": "string", "bucket": "int", "text_": "string"}


def test_stages_keep_columns_of_any_name(spark, sf):  # noqa: ANN001
    """Columns named like inner ones come through unchanged, beside nulls, copies, empty and long texts."""
    base = [(k, " ".join(f"w{k}x{j}" for j in range(40)), f"s{k % 3}") for k in range(30)]
    base += [(40, base[0][1] + " tail", "s0"), (41, None, None), (42, "", "s1"), (None, "no identifier " * 5, None), (43, "v " * 60_000, "s2"), (5, base[5][1], "s1")]
    value = {"long": lambda k: k * 7, "int": lambda k: k, "string": lambda k: f"v{k}" if k % 4 else None, "boolean": lambda k: k % 2 == 0}
    rows = [(*x, *[value[t](k) for t in CLASHES.values()]) for k, x in enumerate(base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` {t}" for c, t in CLASHES.items()))
    known = {tuple(r) for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        got = [tuple(r) for r in out.collect()]
        assert got and set(got) <= known, name
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert corpus_pipeline.encode(spark, docs, sf).count() == len(rows)


def test_one_of_each_group_stays(spark, sf):  # noqa: ANN001
    """Near copies under one identifier, under several and under none, and rows that are there twice."""
    words = [f"w{k}" for k in range(60)]
    text = " ".join(words)
    near = lambda k: " ".join([*words[:59], f"z{k}"])
    docs = spark.createDataFrame([(1, text, "s"), (1, near(1), "s"), (1, text, "t"), (2, near(2), "s"), (None, near(3), "s"), (1, "quite other words stand in this one", "s"), (3, "", "s"), (4, None, "s"), (9, "alone among all of these texts", "s")], "doc_id long, text string, source string")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near(spark, docs, sf).collect()]
    assert sum(bool(t) and t.startswith("w0 w1") for _, t in got) == 1 and [i for i, t in got if t and t.startswith("w0 w1")] == [1]
    assert sorted(i for i, t in got if not (t and t.startswith("w0 w1"))) == [1, 3, 4, 9]


def test_sql_of_the_corpus_queries(spark, sf):  # noqa: ANN001
    import duckdb
    from sparkloom.llm.queries import SQL

    for name, sql in SQL.items():
        c = duckdb.connect()
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
        want = c.execute(sql)
        columns = [x[0] for x in want.description]
        assert sorted(tuple(r) for r in QUERIES[name](spark, sf).select(*columns).collect()) == sorted(want.fetchall()), name
