"""Fusion of ranked lists, confidence in them, and gates on it."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import base_rid


def fuse_rrf(legs: Mapping[str, DataFrame], k: int = 60, id_col: str = "id") -> DataFrame:
    """Reciprocal rank fusion of legs (id, rank, score): id, score, <leg>_rank and <leg>_score for each leg.

    Contributions add up over legs, and over rows of one leg (query variants). Legs are unioned and grouped once.
    """
    parts = [leg.select(id_col, F.col("rank").cast("int").alias("rank"), F.col("score").cast("double").alias("leg_score"), F.lit(name).alias("leg")) for name, leg in legs.items()]
    all_ = reduce(DataFrame.unionByName, parts)
    own = [x for name in legs for x in (F.min(F.when(F.col("leg") == name, F.col("rank"))).alias(f"{name}_rank"), F.max(F.when(F.col("leg") == name, F.col("leg_score"))).alias(f"{name}_score"))]
    return all_.groupBy(id_col).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), *own)


def fuse_outer(a: DataFrame, b: DataFrame, k: int = 60, id_col: str = "id") -> DataFrame:
    """The same for two legs as a full outer join: id, score, a_rank, b_rank."""
    left, right = a.select(id_col, F.col("rank").alias("a_rank")), b.select(id_col, F.col("rank").alias("b_rank"))
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return left.join(right, id_col, "full_outer").withColumn("score", part("a_rank") + part("b_rank"))


def fuse_weighted(vector: DataFrame, entity: DataFrame, keyword: DataFrame, *, weights: tuple[float, float, float] = (0.6, 0.2, 0.2), boost: float = 0.15) -> DataFrame:
    """Weighted average of legs (rid, score, ord) by document: base_rid, score, the legs' scores, similarity, entity_boost.

    Chunks count for their document. Within the vector leg the last row of a document wins, as it does in the other legs
    for their own score. similarity is the raw score of the first leg that has the document, which confidence reads.
    """
    last = lambda df, name: df.select(base_rid(F.col("rid")).alias("base_rid"), F.col("score").cast("double").alias("s"), "ord").groupBy("base_rid").agg(F.max_by("s", "ord").alias(name))
    v, e, w = last(vector, "vector_score"), last(entity, "entity_score"), last(keyword, "keyword_score")
    both = v.join(e, "base_rid", "full_outer").join(w, "base_rid", "full_outer")
    boosted = F.when(F.col("entity_score").isNotNull(), boost).otherwise(0.0)
    parts = [F.coalesce(c, F.lit(0.0)) * x for c, x in zip(("vector_score", "entity_score", "keyword_score"), weights, strict=True)]
    return both.select("base_rid", (parts[0] + parts[1] + parts[2] + boosted).alias("score"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("vector_score", "entity_score", "keyword_score")], F.coalesce("vector_score", "entity_score", "keyword_score").alias("similarity"), boosted.alias("entity_boost"))


def concat_surfaces(surfaces: Mapping[str, DataFrame], k: int = 60, offsets: Mapping[str, int] | None = None) -> DataFrame:
    """Surfaces (id, rank from 0) side by side, a hit on two of them twice: id, surface, score 1 / (k + rank + offset + 1)."""
    parts = [df.select("id", F.lit(name).alias("surface"), (1.0 / (k + F.col("rank") + (offsets or {}).get(name, 0) + 1)).alias("score")) for name, df in surfaces.items()]
    return reduce(DataFrame.unionByName, parts)


def confidence(ranked: DataFrame, key: str, score: Column) -> DataFrame:
    """key, confidence in a ranked list (key, rank): the top score, its lead, how many, the mean of five, and evenness."""
    one = lambda r: F.max(F.when(F.col("rank") == r, score))
    some = lambda f, n: f(F.when(F.col("rank") <= n, score))
    s = ranked.groupBy(key).agg(F.count(F.lit(1)).alias("n"), one(1).alias("top"), one(2).alias("second"), some(F.avg, 5).alias("mean5"), some(F.var_pop, 10).alias("var10"))
    gap = F.when(F.col("n") > 1, F.col("top") - F.col("second")).otherwise(0.5)
    even = 1 - F.when(F.col("n") < 2, 0.0).otherwise(F.least(F.lit(1.0), F.col("var10")))
    value = 0.35 * F.col("top") + 0.20 * gap + 0.15 * F.least(F.col("n") / 10, F.lit(1.0)) + 0.20 * F.col("mean5") + 0.10 * even
    return s.select(key, F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)).alias("confidence"))


def gate(evidence: DataFrame, key: str, *, entity_ran: bool = True, text_ran: bool = True, sure: float = 0.02, least: float = 0.01, enough: int = 2) -> DataFrame:
    """key, decision over evidence (key, retrieval_op, confidence): very_low, low or confident."""
    is_text, is_entity = F.col("retrieval_op") == "text_search", F.col("retrieval_op") == "entity_lookup"
    s = evidence.groupBy(key).agg(F.round(F.coalesce(F.max(F.when(is_text, F.col("confidence"))), F.lit(0.0)), 4).alias("top"), F.count_if(is_text).alias("texts"), F.count_if(is_entity).alias("entities"))
    if not text_ran:
        return s.withColumn("decision", F.when(F.lit(entity_ran) & (F.col("entities") == 0), "very_low").otherwise("confident"))
    top, n = F.col("top"), F.col("texts")
    decision = F.when((n == 0) | ((top < least) & (n < enough)), "very_low").when((top < sure) | (n < enough) | (F.lit(entity_ran) & (F.col("entities") == 0) & (top < sure * 1.2)), "low").otherwise("confident")
    return s.withColumn("decision", decision)
