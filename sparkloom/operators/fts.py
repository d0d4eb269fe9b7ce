"""Full-text search: a postings index, boolean and prefix queries, BM25, cover density, strict and relaxed legs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T

#: Words that queries leave out.
STOP = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with"]


def stem(t: Column) -> Column:
    """A light suffix stripper for English plurals, -ing, -ed and -ly; words of four letters or fewer stay."""
    out = F.regexp_replace(t, "(?<=..)(sses)$", "ss")
    for p, by in (("(?<=..)ies$", "y"), ("(?<=[^s]..)s$", ""), ("(?<=...)(ing|edly|ed|ly)$", "")):
        out = F.regexp_replace(out, p, by)
    return F.when(F.length(t) <= 4, t).otherwise(out)


@dataclass(frozen=True)
class Index:
    """postings: id, term, tf, positions, length. Statistics come from it when needed."""

    postings: DataFrame
    id_col: str


def build_index(docs: DataFrame, id_col: str, text: Column, *, stemmed: bool = False) -> Index:
    """A row for each document and term. Stop words are left out, positions count all terms.

    A document's terms are in one row already: its places are sorted by term within the row and cut where the term changes, so
    nothing is shuffled. Identifiers are taken to be unique; rows of one identifier are separate documents.
    """
    stop = F.array(*[F.lit(w) for w in STOP])
    places = lambda ts: F.array_sort(F.filter(F.transform(ts, lambda x, i: F.struct((stem(x) if stemmed else x).alias("t"), i.alias("i"), F.array_contains(stop, x).alias("s"))), lambda x: ~x["s"]))
    starts = lambda xs: F.filter(F.sequence(F.lit(0), F.size(xs) - 1), lambda i: (i == 0) | (F.get(xs, i)["t"] != F.get(xs, i - 1)["t"]))
    run = lambda xs, a, b: F.struct(F.get(xs, a)["t"].alias("term"), (b - a).cast("long").alias("tf"), F.transform(F.slice(xs, a + 1, b - a), lambda x: x["i"]).alias("positions"))
    cut_up = lambda xs: T.let(starts(xs), lambda at: F.transform(at, lambda a, k: run(xs, a, F.coalesce(F.get(at, k + 1), F.size(xs)))))
    none = F.array().cast("array<struct<term:string,tf:bigint,positions:array<int>>>")
    runs = T.let(places(F.col("_terms")), lambda xs: F.when(F.size(xs) == 0, none).otherwise(cut_up(xs)))
    all_ = docs.select(id_col, T.terms(text).alias("_terms"))
    return Index(all_.select(id_col, F.size("_terms").alias("length"), F.inline(runs)).select(id_col, "term", "length", "tf", "positions"), id_col)


def scan(docs: DataFrame, id_col: str, text: Column, terms: Sequence[str], *, prefixes: bool = False) -> Index:
    """Postings for a query's few terms only, without building an index: no shuffle, a row a document and term. With prefixes
    also those of all terms that begin with one of them, stop words aside."""
    if not prefixes:
        all_ = docs.select(id_col, T.terms(text).alias("_terms"))
        one = lambda t: F.struct(F.lit(t).alias("term"), F.filter(F.transform("_terms", lambda x, i: F.when(x == t, i)), lambda i: i.isNotNull()).alias("positions"))
        each = all_.select(id_col, F.size("_terms").alias("length"), F.inline(F.array(*[one(t) for t in terms]))).where(F.size("positions") > 0)
        return Index(each.withColumn("tf", F.size("positions").cast("long")), id_col)
    fits = lambda x: F.exists(F.array(*[F.lit(t) for t in sorted(set(terms))]), lambda t: F.startswith(x, t)) & ~F.array_contains(F.array(*[F.lit(w) for w in STOP]), x)
    hits = docs.select(id_col, F.filter(T.terms(text), fits).alias("_hits")).where(F.size("_hits") > 0)
    each = lambda xs: F.transform(F.array_distinct(xs), lambda x: F.struct(x.alias("term"), (F.size(xs) - F.size(F.array_remove(xs, x))).cast("long").alias("tf")))
    return Index(hits.select(id_col, F.inline(each(F.col("_hits")))), id_col)


def match_all(index: Index, terms: Sequence[str]) -> DataFrame:
    """Documents with every term: id, score (the sum of frequencies)."""
    want = sorted(set(terms))
    found = index.postings.where(F.col("term").isin(want)).groupBy(index.id_col)
    return found.agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("score")).where(F.col("n") == len(want)).drop("n")


def match_any(index: Index, terms: Sequence[str]) -> DataFrame:
    return index.postings.where(F.col("term").isin(sorted(set(terms)))).groupBy(index.id_col).agg(F.sum("tf").alias("score"))


def match_prefixes(index: Index, prefixes: Sequence[str]) -> DataFrame:
    """Documents with, for every prefix, a term that begins with it."""
    has = [F.max(F.when(F.startswith("term", F.lit(p)), 1).otherwise(0)) for p in prefixes]
    tf = F.sum(F.when(F.greatest(*[F.startswith("term", F.lit(p)) for p in prefixes], F.lit(False)), F.col("tf")).otherwise(0))
    some = index.postings.where(F.col("term").rlike("^(" + "|".join(prefixes) + ")"))
    return some.groupBy(index.id_col).agg(sum(has[1:], has[0]).alias("n"), tf.alias("score")).where(F.col("n") == len(prefixes)).drop("n")


def bm25(index: Index, terms: Sequence[str], n_docs: DataFrame, *, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Documents with any term: id, score. n_docs: one row, n and mean length."""
    hits = index.postings.where(F.col("term").isin(sorted(set(terms))))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row a query term
    rows = hits.join(F.broadcast(df), "term").join(F.broadcast(n_docs))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    return rows.groupBy(index.id_col).agg(F.sum(part).alias("score"))


def statistics(docs: DataFrame, text: Column) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(T.terms(text))).alias("mean_length"))


def cover_density(index: Index, terms: Sequence[str]) -> DataFrame:
    """Documents with every term: id, score: the sum over minimal covers of 1 / their length in positions."""
    want = sorted(set(terms))
    hits = index.postings.where(F.col("term").isin(want))
    flat = hits.select(index.id_col, "term", F.explode("positions").alias("pos"))
    order = Window.partitionBy(index.id_col).orderBy("pos")
    # The latest position of each term up to here; a cover ends here if all are known and its start isn't shared by the next.
    for k, t in enumerate(want):
        flat = flat.withColumn(f"_l{k}", F.last(F.when(F.col("term") == t, F.col("pos")), ignorenulls=True).over(order))
    start = F.least(*[F.col(f"_l{k}") for k in range(len(want))]) if len(want) > 1 else F.col("_l0")
    known = F.when(sum([F.col(f"_l{k}").isNull().cast("int") for k in range(1, len(want))], F.col("_l0").isNull().cast("int")) == 0, start)
    covers = flat.withColumn("start", known).where("start IS NOT NULL").groupBy(index.id_col, "start").agg(F.min("pos").alias("end"))
    return covers.groupBy(index.id_col).agg(F.sum(1.0 / (F.col("end") - F.col("start") + 1)).alias("score"))


def log_scaled(found: DataFrame, score: str = "score", *, phrase: Column | None = None, relaxed: Column | None = None) -> DataFrame:
    """score as ln(1 + r) / ln(1 + max), times 1.2 for an exact phrase and 0.9 for a relaxed match, at most 1."""
    top = found.agg(F.max(score).alias("_max"))
    value = F.when(F.col("_max") > 0, F.log1p(score) / F.log1p("_max")).otherwise(0.0)
    if phrase is not None:
        value = value * F.when(phrase, 1.2).otherwise(1.0)
    if relaxed is not None:
        value = value * F.when(relaxed, 0.9).otherwise(1.0)
    return found.join(F.broadcast(top)).withColumn("scaled", F.least(value, F.lit(1.0))).drop("_max")


def strict_and_relaxed(index: Index, terms: Sequence[str], k: int) -> DataFrame:
    """Documents with every term, then those with any term and a term beginning with each but not in the strict leg.

    id, score, match_type ("strict" first), rank.
    """
    strict = match_all(index, terms).withColumn("match_type", F.lit("strict"))
    loose = match_any(index, terms).join(match_prefixes(index, terms).select(index.id_col), index.id_col, "left_semi").join(strict.select(index.id_col), index.id_col, "left_anti")
    both = strict.unionByName(loose.withColumn("match_type", F.lit("relaxed")))
    order = [F.col("match_type").desc(), F.col("score").desc(), F.col(index.id_col)]
    return both.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def ilike_fallback(docs: DataFrame, id_col: str, text: Column, phrase: str, k: int) -> DataFrame:
    low = F.lower(text)
    return docs.where(F.contains(low, F.lit(phrase.lower()))).select(id_col, F.lit(0.5).alias("score")).orderBy(id_col).limit(k)
