"""Vector arithmetic on array<double> columns, within the JVM, and greedy selections over bounded candidate lists."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a vector is null, empty or zero, or lengths differ."""
    length = norm(a) * norm(b)
    fits = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(fits & (length > 0), dot(a, b) / length).otherwise(0.0)


def literal(values: Sequence[float]) -> Column:
    return F.lit([float(v) for v in values])


def top_k(vectors: DataFrame, query: Sequence[float], k: int, *, id_col: str = "vec_id", vec_col: str = "embedding", where: Column | None = None, min_sim: float | None = None) -> DataFrame:
    """The k most similar rows: exact, filters before the limit, ties by id. id, score, rank."""
    rows = vectors if where is None else vectors.where(where)
    scored = rows.select(id_col, cosine(F.col(vec_col), literal(query)).alias("score"))
    best = scored.orderBy(F.col("score").desc(), id_col).limit(k)  # k rows, so the rank's one partition is bounded
    best = best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), F.col(id_col))))
    return best if min_sim is None else best.where(F.col("score") > min_sim)


#: Bytes of queries that are gathered and broadcast at a time.
QUERY_BYTES = 256 << 20


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int, *, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 4096) -> DataFrame:
    """For each query (query_id, query vec) the k most similar rows: query_id, id, score, rank.

    Vectors stay where they are; each Arrow batch is multiplied with the queries and gives its own best k a query, so what is
    shuffled is k rows a query and batch. Queries are measured first and dealt into blocks of QUERY_BYTES, each of which is
    broadcast and takes a pass over the vectors.
    """
    spark = vectors.sparkSession
    ids_col, vecs_col = queries.columns[:2]
    size = queries.agg(F.sum(8 * F.size(vecs_col) + 16)).first()[0] or 0
    n_blocks = max(1, -(-size // QUERY_BYTES))

    def local(held):  # noqa: ANN001, ANN202
        def run(batches):  # noqa: ANN001, ANN202
            ids, q = held.value
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
            for pdf in batches:
                m = np.stack([np.asarray(v, np.float64) for v in pdf[vec_col]])
                m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
                own = pdf[id_col].to_numpy()
                for at in range(0, len(q), block):
                    s = q[at : at + block] @ m.T
                    n = min(k, s.shape[1])
                    order = np.lexsort((np.broadcast_to(own, s.shape), -s), axis=1)[:, :n]
                    rows = np.repeat(np.arange(len(s)), n)
                    yield pd.DataFrame({"query_id": ids[at : at + block][rows], "id": own[order.ravel()], "score": s[rows, order.ravel()]})

        return run

    found = None
    for b in range(n_blocks):
        qs = queries.where(F.pmod(F.xxhash64(ids_col), F.lit(n_blocks)) == b).select(ids_col, vecs_col).toPandas()
        if not len(qs):
            continue
        held = spark.sparkContext.broadcast((qs.iloc[:, 0].to_numpy(), np.stack([np.asarray(v, np.float64) for v in qs.iloc[:, 1]])))
        part = vectors.select(id_col, vec_col).mapInPandas(local(held), "query_id long, id long, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "query_id long, id long, score double")
    own = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


#: Vectors that an index's cells are fitted on, at most, and their bytes.
FIT_ROWS = 20_000
FIT_BYTES = 256 << 20


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def fit_cells(vectors: DataFrame, cells: int | None = None, *, id_col: str = "vec_id", vec_col: str = "embedding", rounds: int = 12) -> np.ndarray:
    """Centres of an inverted file's cells, by spherical k-means on the vectors with the least hashes of their identifiers: a
    sample of FIT_ROWS rows or FIT_BYTES at most. About the square root of all rows, unless given, and 4,096 at most."""
    n, dim = vectors.agg(F.count(F.lit(1)), F.max(F.size(vec_col))).first()
    if not n:
        return np.zeros((0, 1))
    rows = max(1, min(FIT_ROWS, FIT_BYTES // (8 * max(dim, 1))))
    sample = vectors.where(F.size(vec_col) == dim).select(vec_col, F.xxhash64(id_col).alias("h"), id_col).orderBy("h", id_col).limit(rows).toPandas()
    x = _unit(np.stack([np.asarray(v, np.float64) for v in sample[vec_col]]))
    k = min(len(x), cells or min(4096, int(np.ceil(np.sqrt(n)))))
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        filled = np.bincount(own, minlength=k) > 0
        centres[filled] = _unit(sums[filled])
    return centres


def build_index(vectors: DataFrame, centres: np.ndarray, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """cell, id, vec: every vector with the cell of its nearest centre. To be written partitioned or bucketed by cell."""
    held = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            m = np.stack([np.asarray(v, np.float64) for v in pdf["vec"]]) if len(pdf) else np.zeros((0, held.value.shape[1]))
            yield pdf.assign(cell=(m @ held.value.T).argmax(axis=1).astype("int32") if len(pdf) else [])[["cell", "id", "vec"]]

    return vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).mapInPandas(run, f"cell int, id {dict(vectors.dtypes)[id_col]}, vec {dict(vectors.dtypes)[vec_col]}")


def search_index(index: DataFrame, queries: DataFrame, centres: np.ndarray, k: int, probes: int) -> DataFrame:
    """query_id, id, score, rank: the k most similar of the vectors in the cells nearest to each query (query_id, query vec)."""
    held = index.sparkSession.sparkContext.broadcast(centres)
    qid, qvec = queries.columns[:2]

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            if len(pdf):
                m = np.stack([np.asarray(v, np.float64) for v in pdf["q"]])
                near = np.argsort(-(m @ held.value.T), axis=1, kind="stable")[:, :probes]
                at = np.repeat(np.arange(len(pdf)), near.shape[1])
                yield pdf.iloc[at].assign(cell=near.ravel().astype("int32"))[["cell", "query_id", "q"]]

    asked = queries.select(F.col(qid).alias("query_id"), F.col(qvec).alias("q")).mapInPandas(run, f"cell int, query_id {dict(queries.dtypes)[qid]}, q {dict(queries.dtypes)[qvec]}")
    scored = asked.join(index, "cell").select("query_id", "id", cosine(F.col("q"), F.col("vec")).alias("score"))
    own = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id")
    return scored.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def centroids(vectors: DataFrame, label: str, vec_col: str = "embedding") -> DataFrame:
    """label, centroid: element means. Elements are summed by position, so a label of any size is pre-aggregated."""
    each = vectors.select(label, F.posexplode(vec_col).alias("pos", "x")).groupBy(label, "pos").agg(F.avg("x").alias("x"))
    return each.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("centroid"))


def nearest_centroid(vectors: DataFrame, centers: DataFrame, label: str, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, predicted label, similarity, margin over the runner-up. centers: one row a class, gathered into one array."""
    all_ = centers.agg(F.collect_list(F.struct(F.col(label).alias("l"), F.col("centroid").alias("c"))).alias("cs"))
    scored = vectors.join(F.broadcast(all_)).withColumn("s", F.sort_array(F.transform("cs", lambda x: F.struct(cosine(F.col(vec_col), x["c"]).alias("sim"), (-x["l"]).alias("neg"))), asc=False))
    return scored.select(id_col, (-F.col("s")[0]["neg"]).alias("predicted"), F.col("s")[0]["sim"].alias("similarity"), (F.col("s")[0]["sim"] - F.coalesce(F.get("s", F.lit(1))["sim"], F.lit(0.0))).alias("margin"))


def _similarities(rows: list[list[float]]) -> np.ndarray:
    m = np.array(rows, np.float64)
    return (m @ m.T) / np.maximum(np.outer(n := np.linalg.norm(m, axis=1), n), 1e-300)


def mmr(cands: DataFrame, key: str, limit: int = 10, lam: float = 0.5, pool: int | None = None) -> DataFrame:
    """Maximal marginal relevance per key over (key, id, score, embedding): key, id, position. Pools are max(2 limit, 20)."""
    size = pool or max(2 * limit, 20)
    best = Window.partitionBy(key).orderBy(F.col("score").desc(), "id")
    pooled = cands.withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= size)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rn")
        sim, rel = _similarities(pdf["embedding"].tolist()), pdf["score"].to_numpy()
        chosen: list[int] = []
        while len(chosen) < min(limit, len(pdf)):
            left = [i for i in range(len(pdf)) if i not in chosen]
            value = [lam * rel[i] - (1 - lam) * (sim[i, chosen].max() if chosen else 0.0) for i in left]
            chosen.append(left[int(np.argmax(np.round(value, 12)))])  # equal values go by rank
        return pd.DataFrame({key: pdf[key].iloc[0], "id": pdf["id"].to_numpy()[chosen], "position": np.arange(1, len(chosen) + 1)})

    kind = dict(cands.dtypes)
    return pooled.groupBy(key).applyInPandas(pick, f"`{key}` {kind[key]}, id {kind['id']}, position int")


def idds(cands: DataFrame, key: str, budget: int = 5, alpha: float = 0.5, pool: int = 100) -> DataFrame:
    """Informative and diverse picks per key over (key, id, score, embedding): alpha times the mean similarity to the rest
    of the pool plus 1 - alpha times one minus the greatest similarity to a pick."""
    best = Window.partitionBy(key).orderBy(F.col("score").desc(), "id")
    pooled = cands.withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= pool)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rn")
        sim = _similarities(pdf["embedding"].tolist())
        left, chosen = list(range(len(pdf))), []
        while left and len(chosen) < budget:
            n = max(1, len(left) - 1)
            value = [alpha * (sim[i, left].sum() - sim[i, i]) / n + (1 - alpha) * (1 - max(0.0, sim[i, chosen].max()) if chosen else 1.0) for i in left]
            chosen.append(left.pop(int(np.argmax(np.round(value, 12)))))
        return pd.DataFrame({key: pdf[key].iloc[0], "id": pdf["id"].to_numpy()[chosen], "position": np.arange(1, len(chosen) + 1)})

    kind = dict(cands.dtypes)
    return pooled.groupBy(key).applyInPandas(pick, f"`{key}` {kind[key]}, id {kind['id']}, position int")
