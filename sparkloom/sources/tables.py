"""The engine's relations over the standard tables: documents, entities, edges, facts, chunks, vectors.

Each DataFrame has a twin in SQL (CTES), word for word the same relation, which oracle queries start from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rid, doc_id, text, lang, source, n_chars, is_private (null for some), published_at (null for some), confidence."""
    c = F.col
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("document:"), c("doc_id").cast("string")).alias("rid"), "doc_id", "text", "lang", "source", "n_chars",
        F.when(c("source") == "src1", True).when(c("lang") == "de", F.lit(None).cast("boolean")).otherwise(False).alias("is_private"),
        F.when(c("lang") != "es", F.timestamp_seconds(F.lit(1704067200) + c("n_chars") * 600)).alias("published_at"),
        F.when(c("n_chars") > 2000, 0.9).when(c("n_chars") > 500, 0.7).otherwise(0.4).alias("confidence"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uri, entity_text, entity_type, normalized_text, occurrence_count, node_private."""
    t = lambda n: table(spark, sf_dir, n)

    def of(name: str, kind: str, key: str, text: str, count: Column, private: Column) -> DataFrame:
        return t(name).select(F.concat(F.lit(f"{name}:"), F.col(key).cast("string")).alias("uri"), F.col(text).alias("entity_text"), F.lit(kind).alias("entity_type"), count.cast("long").alias("occurrence_count"), private.alias("node_private"))

    no = F.lit(False)
    all_ = of("customer", "Person", "c_custkey", "c_name", F.floor(F.abs("c_acctbal") / 100), F.col("c_mktsegment") == "MACHINERY")
    all_ = all_.unionByName(of("supplier", "Organization", "s_suppkey", "s_name", F.floor(F.abs("s_acctbal") / 100), no))
    all_ = all_.unionByName(of("part", "Product", "p_partkey", "p_name", F.col("p_size"), no))
    all_ = all_.unionByName(of("nation", "Location", "n_nationkey", "n_name", F.lit(25), no)).unionByName(of("region", "Location", "r_regionkey", "r_name", F.lit(5), no))
    return all_.withColumn("normalized_text", F.lower(F.trim("entity_text")))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, predicate, object, confidence, occurrence_count: one row a triple."""
    t = lambda n: table(spark, sf_dir, n)
    u = lambda n, c: F.concat(F.lit(f"{n}:"), F.col(c).cast("string"))

    def of(df: DataFrame, s: Column, p: str, o: Column, confidence: Column) -> DataFrame:
        return df.select(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"), confidence.cast("double").alias("confidence"))

    one = F.lit(1.0)
    all_ = of(t("customer"), u("customer", "c_custkey"), "located_in", u("nation", "c_nationkey"), one)
    all_ = all_.unionByName(of(t("supplier"), u("supplier", "s_suppkey"), "located_in", u("nation", "s_nationkey"), one))
    all_ = all_.unionByName(of(t("nation"), u("nation", "n_nationkey"), "part_of", u("region", "n_regionkey"), one))
    bought = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    all_ = all_.unionByName(of(bought, u("customer", "o_custkey"), "bought", u("part", "l_partkey"), 1 - F.col("l_discount")))
    all_ = all_.unionByName(of(t("lineitem"), u("part", "l_partkey"), "supplied_by", u("supplier", "l_suppkey"), 1 - F.col("l_tax")))
    return all_.groupBy("subject", "predicate", "object").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("occurrence_count"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fact_id, subject, predicate, object, valid_from, valid_to (null for open ones), tx_retracted_at."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("fact_id"), F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("subject"), F.lit("ordered").alias("predicate"),
        F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("object"), F.col("o_orderdate").alias("valid_from"),
        F.when(F.col("l_linestatus") != "O", F.col("l_shipdate")).alias("valid_to"), F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("tx_retracted_at"), F.col("l_quantity").alias("quantity"),
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rid, uri, mention_count: orders as documents that mention their parts."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("rid"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("uri")).agg(F.count(F.lit(1)).alias("mention_count"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, embedding (array of double), label."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")


CTES = {
    "docs": """docs AS (SELECT concat('document:', doc_id) AS rid, doc_id, text, lang, source, n_chars,
        CASE WHEN source = 'src1' THEN true WHEN lang = 'de' THEN NULL ELSE false END AS is_private,
        CASE WHEN lang <> 'es' THEN make_timestamp((1704067200 + n_chars * 600) * 1000000) END AS published_at,
        CASE WHEN n_chars > 2000 THEN 0.9::DOUBLE WHEN n_chars > 500 THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END AS confidence FROM documents)""",
    "entities": """entities AS (SELECT *, lower(trim(entity_text)) AS normalized_text FROM (
        SELECT concat('customer:', c_custkey) AS uri, c_name AS entity_text, 'Person' AS entity_type, floor(abs(c_acctbal) / 100)::BIGINT AS occurrence_count, c_mktsegment = 'MACHINERY' AS node_private FROM customer
        UNION ALL SELECT concat('supplier:', s_suppkey), s_name, 'Organization', floor(abs(s_acctbal) / 100)::BIGINT, false FROM supplier
        UNION ALL SELECT concat('part:', p_partkey), p_name, 'Product', p_size::BIGINT, false FROM part
        UNION ALL SELECT concat('nation:', n_nationkey), n_name, 'Location', 25::BIGINT, false FROM nation
        UNION ALL SELECT concat('region:', r_regionkey), r_name, 'Location', 5::BIGINT, false FROM region))""",
    "edges": """edges AS (SELECT subject, predicate, object, max(confidence) AS confidence, count(*) AS occurrence_count FROM (
        SELECT concat('customer:', c_custkey) AS subject, 'located_in' AS predicate, concat('nation:', c_nationkey) AS object, 1.0::DOUBLE AS confidence FROM customer
        UNION ALL SELECT concat('supplier:', s_suppkey), 'located_in', concat('nation:', s_nationkey), 1.0::DOUBLE FROM supplier
        UNION ALL SELECT concat('nation:', n_nationkey), 'part_of', concat('region:', n_regionkey), 1.0::DOUBLE FROM nation
        UNION ALL SELECT concat('customer:', o_custkey), 'bought', concat('part:', l_partkey), 1 - l_discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        UNION ALL SELECT concat('part:', l_partkey), 'supplied_by', concat('supplier:', l_suppkey), 1 - l_tax FROM lineitem) GROUP BY ALL)""",
    "facts": """facts AS (SELECT concat(l_orderkey, '-', l_linenumber) AS fact_id, concat('customer:', o_custkey) AS subject, 'ordered' AS predicate, concat('part:', l_partkey) AS object,
        o_orderdate AS valid_from, CASE WHEN l_linestatus <> 'O' THEN l_shipdate END AS valid_to, CASE WHEN l_returnflag = 'R' THEN l_shipdate END AS tx_retracted_at, l_quantity AS quantity
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "mentions": """mentions AS (SELECT concat('order:', l_orderkey) AS rid, concat('part:', l_partkey) AS uri, count(*) AS mention_count FROM lineitem GROUP BY ALL)""",
    "vecs": """vecs AS (SELECT vec_id, embedding::DOUBLE[] AS embedding, label FROM embeddings)""",
}


def with_(names: str, body: str) -> str:
    """SQL that starts from the named relations; names may be followed by `recursive`."""
    parts = names.split()
    head = "WITH RECURSIVE " if "recursive" in parts else "WITH "
    return head + ",\n".join(CTES[n] for n in parts if n != "recursive") + body if body.startswith(",") else head + ",\n".join(CTES[n] for n in parts if n != "recursive") + "\n" + body
