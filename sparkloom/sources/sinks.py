"""Sinks: CSV, JSON lines, JSON-LD, N-Triples; each has its reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("escape", '"').csv(path, header=True)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("escape", '"').csv(path, header=True, multiLine=True)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def json_ld(edges: DataFrame, context: str = "https://schema.org/") -> DataFrame:
    """subject, document: one JSON-LD object a subject, with its objects by predicate."""
    by = edges.groupBy("subject", "predicate").agg(F.sort_array(F.collect_list("object")).alias("objects"))
    doc = by.groupBy("subject").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("predicate", "objects")))).alias("links"))
    return doc.select("subject", F.to_json(F.struct(F.lit(context).alias("@context"), F.col("subject").alias("@id"), "links")).alias("document"))


def document_ld(entities: DataFrame, facts: DataFrame, moves: DataFrame, context: str = "https://schema.org/") -> DataFrame:
    """rid, document: one JSON-LD object a document with its entities (rid, uri, entity_type, entity_text), distinct facts (rid,
    subject, predicate, object) and moves (rid, kind, target); lists are in order."""
    listed = lambda df, name, *cols: df.groupBy("rid").agg(F.sort_array(F.collect_set(F.struct(*cols))).alias(name))
    e = listed(entities, "mentions", F.col("uri").alias("@id"), F.col("entity_type").alias("@type"), F.col("entity_text").alias("name"))
    both = e.join(listed(facts, "facts", "subject", "predicate", "object"), "rid", "left").join(listed(moves, "moves", "kind", "target"), "rid", "left")
    empty = lambda name: F.coalesce(F.col(name), F.array().cast(both.schema[name].dataType)).alias(name)
    return both.select("rid", F.to_json(F.struct(F.lit(context).alias("@context"), F.col("rid").alias("@id"), F.lit("Document").alias("@type"), "mentions", empty("facts"), empty("moves"))).alias("document"))


def n_triples(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat(F.lit("<urn:"), "subject", F.lit("> <urn:p:"), "predicate", F.lit("> <urn:"), "object", F.lit("> .")).alias("value"))


def write_n_triples(edges: DataFrame, path: str) -> None:
    n_triples(edges).write.mode("overwrite").text(path)


def read_n_triples(spark: SparkSession, path: str) -> DataFrame:
    """subject, predicate, object of the lines that are triples."""
    part = lambda k: F.regexp_extract("value", r"^<urn:([^>]*)> <urn:p:([^>]*)> <urn:([^>]*)> \.$", k)
    return spark.read.text(path).select(part(1).alias("subject"), part(2).alias("predicate"), part(3).alias("object")).where("subject != ''")
