"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with their columns; the last one returns
token ids. Between stages documents are written and read again. Rows are told apart by identifier and text: rows equal
in both are copies.

Every stage takes columns of any names beside doc_id, text and source, and carries them along unchanged; null texts count as
empty ones, null sources as one of their own; an empty table gives an empty result; texts may be of any length. What each
stage does about copies, ties and nulls in identifiers is said at the stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import exact_dedup, mixing, near_dedup, piece_lattice, toxicity
from sparkloom.llm.common import cut, inner, load, text_or_empty, tokenizer


def _keys() -> list[Column]:
    """Two 64-bit hashes of a row's identifier and text, never null."""
    return [F.xxhash64(F.lit(k), F.col("doc_id"), text_or_empty()) for k in (1, 2)]


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't find toxic.

    The chain learns from the labels of those documents that are there; without labels, or where they show no signal, all
    stay. Copies are judged alike; empty texts stay unless the labels speak against them; null identifiers have no labels.
    """
    return toxicity.without(docs, toxicity.learn_labels(docs, load(spark, sf_dir, "labels")), "toxic")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, the one with the largest identifier.

    Empty and null texts are one group. A null identifier is smaller than any other. Of rows equal in identifier and text any
    one stays.
    """
    sha, id_, of = inner(docs.columns, "sha", "kept_id", "kept_sha")
    stays = exact_dedup.exact_groups(docs, keep="largest").where("kept").select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(of))
    marked = docs.withColumn(sha, F.sha2(text_or_empty(), 256))
    kept = marked.join(stays, (F.col(sha) == F.col(of)) & F.col("doc_id").eqNullSafe(F.col(id_)), "left_semi")
    return kept.dropDuplicates(["doc_id", sha]).drop(sha)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by five-word shingles and a similarity of 0.8.

    The one with the smallest identifier stays, null last; of several rows under it that with the least hash. Copies are near
    duplicates. Texts without words are in no group: all of them stay.
    """
    k1, k2 = inner([*docs.columns, "n_shingles", "component_id", "kept", "component"], "k1", "k2")
    rows = docs.withColumns(dict(zip((k1, k2), _keys(), strict=True)))
    groups = cut(near_dedup.near_groups(rows, width=5, percent=80, carry=(k1, k2)), "near")
    row = F.struct(F.col(k1).alias("s1"), F.col(k2).alias("s2"))
    stays = groups.where("kept").groupBy(F.coalesce("component", row).alias("component")).agg(F.min(row).alias("row"))
    stays = cut(stays.select(F.col("row.s1").alias(k1), F.col("row.s2").alias(k2)), "stays")
    gone = groups.where("component IS NOT NULL").select(k1, k2).join(stays, [k1, k2], "left_anti").distinct()
    again = groups.where("component IS NOT NULL").groupBy(k1, k2).count().where("count > 1").join(stays, [k1, k2], "left_semi").select(k1, k2)
    gone, again = cut(gone, "gone"), cut(again, "again")
    # Only rows that are there twice are told apart by a shuffle of their texts.
    once = rows.join(gone.unionByName(again), [k1, k2], "left_anti")
    return once.unionByName(rows.join(again, [k1, k2], "left_semi").dropDuplicates([k1, k2])).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix reads them, in the curriculum's order.

    Copies are documents of their own, and are read as often as they are taken. Texts without words take no room and are read
    where their place lies within the target. Ties in position go by the rows' hashes.
    """
    k1, k2, positions, position = inner([*docs.columns, *mixing.COLUMNS], "k1", "k2", "positions", "position")
    keys = dict(zip((k1, k2), _keys(), strict=True))
    read = mixing.curriculum(docs, carry=keys)
    times = read.groupBy(k1, k2).agg(F.flatten(F.collect_list("positions")).alias(positions)).where(F.size(positions) > 0)
    placed = docs.withColumns(keys).dropDuplicates([k1, k2]).join(times, [k1, k2]).withColumn(position, F.explode(positions))
    return placed.orderBy(position, k1).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row: doc_id, ids, round_trip. Copies are encoded alike; an empty text has no ids."""
    return piece_lattice.encode(docs, tokenizer("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", not_toxic),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
