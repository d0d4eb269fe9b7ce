"""Scalar functions against known values."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import chunks, text, vectors


def one(spark, value, *columns):  # noqa: ANN001, ANN201
    return tuple(spark.createDataFrame([(value,)], "x string").select(*columns).first())


@pytest.mark.parametrize(("given", "want"), [("GPT-4", "gpt 4"), ("GPT-4o", "gpt 4o"), ("GPT-4.1", "gpt 4.1"), ("gpt-5.4", "gpt 5.4"), ("  Spaced  ", "spaced"), ("@handle", "handle"), ("a_b-c", "a b c"), ("a---b", "a  b"), ("@@x", "x")])
def test_normal_form(spark, given, want):  # noqa: ANN001
    assert one(spark, given, text.normalize_entity_text(F.col("x"))) == (want,)


@pytest.mark.parametrize(("a", "b", "want"), [("abcd", "axyz", 0.55), ("martha", "marhta", 0.961111), ("dwayne", "duane", 0.84), ("northwind", "northwood", 0.911111), ("ana lopez", "ana lopes", 0.955556), ("lopez", "lowe", 0.826667), ("a", "b", 0.0), ("", "x", 0.0), ("same", "same", 1.0)])
def test_jaro_winkler(a, b, want):  # noqa: ANN001
    assert text.jaro_winkler_value(a, b) == pytest.approx(want, abs=1e-6)


def test_names(spark):  # noqa: ANN001
    c = F.col("x")
    assert one(spark, "Regen Works, Inc.", text.normalize_entity_name(c)) == ("regen works",)
    assert one(spark, "@The great.lake | RND", text.normalize_entity_name(c)) == ("great lake",)
    assert one(spark, "[[People/Ana Lopez|Ana]]", text.normalize_alias(c)) == ("ana lopez",)
    assert one(spark, "2024 03 05 sync", text.leading_date(c)) == ("2024-03-05",)
    assert one(spark, "2024-13-05 sync", text.leading_date(c)) == (None,)
    assert one(spark, "see 2024-03-05", text.leading_date(c)) == (None,)
    assert one(spark, "x", text.normalize_alias_list(F.array(F.lit("A"), F.lit(" a "), F.lit(None), F.lit("")))) == (["a"],)
    assert set(one(spark, "the $NCT", text.query_variants(c))[0]) >= {"nct", "NCT", "$nct", "$NCT", "ncts"}
    assert one(spark, "big red fox", text.ngram_patterns(c)) == (["big", "red", "fox", "big red", "red fox", "big red fox"],)
    assert one(spark, "HTTPS://Ex.org:443?q=1#f", text.canonical_url(c)) == ("https://ex.org/?q=1",)
    assert one(spark, "ftp://ex.org", text.canonical_url(c)) == (None,)
    assert one(spark, "doc:1#chunk14", text.base_rid(c)) == ("doc:1",)
    assert one(spark, "orn:some.task-item:7", text.rid_type(c)) == ("TaskItem",)
    assert one(spark, "'''[[a b#x|Shown]]''' {{t}}<ref>y</ref>", text.strip_wiki_markup(c)) == ("Shown",)


@pytest.mark.parametrize(("a", "b", "kind", "want"), [("ana", "ana lopez", "Person", False), ("ana lopez", "ana ruiz", "Person", False), ("ana lopez", "ana lopez", "Person", True), ("university of guelph", "university of melbourne", "Organization", False), ("2024-01-02 sync notes", "2024-02-02 sync notes", "Meeting", False), ("river watch", "river watches", "Location", True)])
def test_strict_policy(spark, a, b, kind, want):  # noqa: ANN001
    got = spark.createDataFrame([(a, b, kind)], "a string, b string, k string").select(text.strict_policy(F.col("a"), F.col("b"), F.col("k"))).first()[0]
    assert got is want


def test_dates_and_evidence(spark):  # noqa: ANN001
    day, sure = text.url_date(F.col("x"))
    assert one(spark, "https://a.org/2024/03/05/post", day.cast("string"), sure) == ("2024-03-05", 0.75)
    assert one(spark, "https://a.org/2024/03/post", day.cast("string"), sure) == ("2024-03-01", 0.70)
    assert one(spark, '<meta property="article:published_time" content="2024-03-05T10:00">', text.html_date(F.col("x")).cast("string")) == ("2024-03-05",)
    assert one(spark, "b", text.evidence_found(F.lit("one two three four five"), F.lit("x Two three, four FIVE y"))) == (True,)
    assert one(spark, '{"b": 1, "a": [2]}', text.canonical_json_hash("x")) == one(spark, '{"a":[2],"b":1}', text.canonical_json_hash("x"))


def test_cosine(spark):  # noqa: ANN001
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [round(x[0], 6) for x in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0, 0.0, 0.0]


def test_batch_top_k_is_exact(spark):  # noqa: ANN001
    rng = np.random.default_rng(1)
    m = rng.standard_normal((200, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<double>").repartition(5)
    got = vectors.batch_top_k(df, df.where("vec_id < 7").select("vec_id", "embedding"), 5).collect()
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(7):
        assert [x["id"] for x in sorted((x for x in got if x["query_id"] == q), key=lambda x: x["rank"])] == np.argsort(-(u @ u[q]), kind="stable")[:5].tolist()


def test_selections(spark):  # noqa: ANN001
    rows = [(0, 1, 0.9, [1.0, 0.0]), (0, 2, 0.89, [1.0, 0.01]), (0, 3, 0.5, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "q int, id long, score double, embedding array<double>")
    assert [x["id"] for x in vectors.mmr(df, "q", 3).orderBy("position").collect()] == [1, 3, 2]
    assert len(vectors.idds(df, "q", 2).collect()) == 2


def test_chunks(spark):  # noqa: ANN001
    r = random.Random(1)
    body = "\n".join("  ".join(f"w{r.randrange(99)}" for _ in range(10)) for _ in range(200))
    df = spark.createDataFrame([(1, body), (2, ""), (3, "  \n "), (4, "a b  c"), (5, " ".join("x" for _ in range(500))), (6, " ".join("x" for _ in range(501))), (7, None)], "id long, t string")
    got = chunks.chunk_tokens(df, "id", "t").collect()
    by = {k: [x for x in got if x["id"] == k] for k in range(1, 8)}
    assert [len(by[k]) for k in range(2, 8)] == [0, 0, 1, 1, 1, 0] and by[4][0]["chunk"] == "a b  c"
    assert all(x["chunk"] in body for x in by[1]) and by[1][0]["end_token"] == 500 and by[1][1]["start_token"] == 450
    assert {x["total_chunks"] for x in by[1]} == {len(by[1])}
    assert spark.createDataFrame([("x" * 1900,)], "t string").select(F.size(chunks.chunk_chars(F.col("t")))).first()[0] == 3
    assert all(x["chunk"] for x in chunks.chunk_tokens(df, "id", "t", sentences=True).collect())
    assert chunks.chunk_by_source(df.withColumn("s", F.lit("article")), "id", "t", "s").count() > 3
