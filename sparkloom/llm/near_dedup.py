"""Near-duplicate groups by MinHash with sequential Bayesian verification.

Documents with one set of shingles are one node. Nodes whose signatures agree in a whole band meet in a bucket. In a
bucket, every member is paired with one hub, the member that meets most others over all its buckets; a group of copies
of any size thus makes one pair a member. Pairs are compared by batches of signature values, and dropped as soon as the
posterior probability that their similarity reaches the threshold falls below `miss`; survivors are confirmed on their
full shingle sets. Buckets whose members aren't one component by then are compared exhaustively, member by member in
blocks, but only across components, and again by signature first and in full last. So a link may go unseen only if it
lies within a component anyway, or by the chosen miss probability.

The number of bands follows from the threshold: a pair at the threshold misses every bucket with probability `miss`.

Defined results: words are runs of bytes other than ASCII white space, with A-Z in lower case; a text of fewer words than
a shingle has one, all its words; a text without words, or null, has none and is linked with nothing; repeated rows are
copies; a null identifier never names a component unless all of the component's are null; an empty table gives an empty
result; further columns are ignored. Shingles are compared by 64-bit hashes, shingle sets by 128-bit ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bits, common
from sparkloom.llm.common import batches_of, lookup, text_or_empty
from sparkloom.llm.wordhash import Words, mix, pieces, signed

_U = np.uint64
#: Nearly all that is written here is hashes.
cut = partial(common.cut, compressed=False)
#: Signature values in a band, and those that one step of the sequential test looks at.
ROWS = 6
STEP = 30
#: Members of a bucket, and shingles of theirs, in one block of the exhaustive comparison.
BLOCK = 1024
BLOCK_SHINGLES = 400_000

NODES = "id long, n long, s1 long, s2 long, bands array<long>, sig binary"
TEXTS = "s1 long, s2 long, text string"


def bands_for(threshold: float, miss: float) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**ROWS))


@cache
def least_matches(steps: tuple[int, ...], threshold: float, miss: float) -> list[int]:
    """For each number of compared values, the fewest matches with which P(similarity >= threshold) is miss or more.

    The prior is uniform; a byte of two different minima is equal once in 256.
    """
    s = (np.arange(4000) + 0.5) / 4000
    p = s + (1 - s) / 256
    out = []
    for n in steps:
        m = np.arange(n + 1)[:, None]
        like = m * np.log(p) + (n - m) * np.log1p(-p)
        like = np.exp(like - like.max(axis=1, keepdims=True))
        tail = like[:, s >= threshold].sum(axis=1) / like.sum(axis=1)
        out.append(int(np.argmax(tail >= miss)))
    return out


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, as (document, hash), in order."""
    ws = Words(texts, lower=True)
    size = np.diff(ws.first)
    many = np.where(size >= width, size - width + 1, np.minimum(size, 1))
    doc = np.repeat(np.arange(len(size)), many)
    start = ws.first[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    hashes = ws.sums.of(start, np.minimum(start + width, ws.first[1:][doc]), 0)
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[new], hashes[new]


def sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash) of distinct shingles; and per text their number and both halves of the set's hash."""
    doc, hashes = shingles(texts, width)
    n = np.bincount(doc, minlength=len(texts))
    halves = []
    for salt in (0x51ED270B, 0x7F4A7C15):
        sums = np.zeros(len(hashes) + 1, _U)
        np.cumsum(mix(hashes ^ _U(salt)), out=sums[1:])
        end = np.cumsum(n)
        halves.append(mix(sums[end] - sums[end - n] + n.astype(_U)))
    return doc, hashes, n, halves[0], halves[1]


def _signer(width: int, bands: int, carried: int = 0) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    count = bands * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = mix(np.arange(1, 2 * count + 1, dtype=_U))
        a, b = (seeds[:count] >> _U(32)).astype(np.uint32) | np.uint32(1), (seeds[count:] >> _U(32)).astype(np.uint32)
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                _, hashes, n, s1, s2 = sets(texts, width)
                x = (mix(hashes) >> _U(32)).astype(np.uint32)
                has = np.flatnonzero(n > 0)
                starts = (np.cumsum(n) - n)[has]
                least = np.zeros((count, len(texts)), np.uint32)
                for k in range(count) if len(has) else ():
                    least[k, has] = np.minimum.reduceat(x * a[k] + b[k], starts)
                key = np.zeros((bands, len(texts)), _U) + np.arange(1, bands + 1, dtype=_U)[:, None]
                for r in range(ROWS):
                    key = mix(key ^ least[r::ROWS].astype(_U)) + _U(r)
                sig = ((mix(least.astype(_U) + _U(1)) >> _U(56)).astype(np.uint8)).T.copy()
                empty = pa.array(n == 0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * bands), signed(np.ascontiguousarray(key.T).ravel()))
                blobs = pa.array([row.tobytes() for row in sig], pa.binary())
                ids = part.column(part.schema.get_field_index("id"))
                none = pa.nulls(len(texts), pa.int64())
                extra = [f"c{k}" for k in range(carried)]
                own = [part.column(part.schema.get_field_index(c)) for c in extra]
                yield pa.RecordBatch.from_arrays([ids, signed(n), empty_or(empty, none, signed(s1)), empty_or(empty, none, signed(s2)), lists, blobs, *own], names=["id", "n", "s1", "s2", "bands", "sig", *extra])

    return run


def empty_or(mask: pa.Array, this: pa.Array, that: pa.Array) -> pa.Array:
    import pyarrow.compute as pc

    return pc.if_else(mask, this, that)


def _matrix(column: pa.Array) -> np.ndarray:
    """Binary values of one length as rows of bytes."""
    n = len(column)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(n, -1) if n else np.zeros((0, 0), np.uint8)


def _survive(a: np.ndarray, b: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Rows of a and b that no step of the sequential test drops."""
    if not len(a):
        return np.zeros(0, bool)
    steps = (*range(STEP, a.shape[1], STEP), a.shape[1])
    left, done, matches = np.arange(len(a)), 0, np.zeros(len(a), np.int64)
    for n, need in zip(steps, least_matches(steps, threshold, miss), strict=True):
        matches[left] += (a[left, done:n] == b[left, done:n]).sum(axis=1)
        left, done = left[matches[left] >= need], n
    out = np.zeros(len(a), bool)
    out[left] = True
    return out


def _compare(threshold: float, miss: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs (a, b, sig_a, sig_b) that the sequential test lets through, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = _survive(_matrix(batch.column(2)), _matrix(batch.column(3)), threshold, miss)
            yield batch.filter(pa.array(ok)).select([0, 1])

    return run


def _across(width: int, percent: int, miss: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links within blocks of bucket members (key; structs v, label, own, sig, bands, text) between different labels.

    A pair is looked at in the first bucket that it shares, and where its two blocks meet. What the sequential test lets
    through is confirmed on the full sets at once, so that only links leave.
    """
    threshold = percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = pa.struct([("s1", pa.int64()), ("s2", pa.int64())])
        for batch in batches:
            for key, members in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                flat = members.values
                v, lab, own = flat.field(0), flat.field(1), np.asarray(flat.field(2))
                sig, bands = _matrix(flat.field(3)), np.asarray(flat.field(4).flatten()).reshape(len(flat), -1)
                labels = np.unique(np.stack([np.asarray(lab.field(0)), np.asarray(lab.field(1))], 1), axis=0, return_inverse=True)[1].ravel()
                apart = own.min() != own.max()
                first = least_matches((min(STEP, sig.shape[1]),), threshold, miss)[0]
                doc, hashes = shingles(flat.field(5), width)
                n = np.bincount(doc, minlength=len(flat))
                begin = np.cumsum(n) - n
                for i in range(len(sig) - 1):
                    near = np.flatnonzero((sig[i + 1 :, :STEP] == sig[i, :STEP]).sum(axis=1) >= first) + i + 1
                    near = near[(labels[near] != labels[i]) & ((own[near] != own[i]) | (not apart))]
                    if not len(near):
                        continue
                    near = near[bands[i][(bands[near] == bands[i]).argmax(axis=1)] == key]
                    near = near[100 * np.minimum(n[near], n[i]) >= percent * np.maximum(n[near], n[i])]
                    near = near[_survive(np.broadcast_to(sig[i], (len(near), sig.shape[1])), sig[near], threshold, miss)]
                    if not len(near):
                        continue
                    mine, size = hashes[begin[i] : begin[i] + n[i]], n[near]
                    theirs = hashes[np.repeat(begin[near] - np.cumsum(size) + size, size) + np.arange(size.sum())]
                    shared = np.add.reduceat(mine[np.minimum(np.searchsorted(mine, theirs), n[i] - 1)] == theirs, np.cumsum(size) - size, dtype=np.int64)
                    near = near[100 * shared >= percent * (n[i] + size - shared)]
                    if len(near):
                        yield pa.RecordBatch.from_arrays([v.take(pa.array(np.full(len(near), i))).cast(node), v.take(pa.array(near)).cast(node)], names=["a", "b"])

    return run


def _texts_of(width: int, wanted: object, wide: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts of rows whose cell is wanted, with their set's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(bits.test(wanted.value, np.asarray(batch.column(0)))))
            for _, texts in pieces(some, "text"):
                _, _, n, s1, s2 = sets(texts, width)
                keep = pa.array(np.flatnonzero(n > 0))
                yield pa.RecordBatch.from_arrays([signed(s1).take(keep), signed(s2).take(keep), texts.take(keep).cast(pa.string())], names=["s1", "s2", "text"])

    return run


def _confirm(width: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs (a, b, text_a, text_b) whose sets satisfy 100 * intersection >= percent * union, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _ in pieces(batch, "text_a"):
                (da, ha), (db, hb) = (shingles(part.column(i), width) for i in (2, 3))
                doc, hashes = np.concatenate([da, db]), np.concatenate([ha, hb])
                order = np.lexsort((hashes, doc))
                doc, hashes = doc[order], hashes[order]
                both = np.bincount(doc[1:][(doc[1:] == doc[:-1]) & (hashes[1:] == hashes[:-1])], minlength=len(part))
                union = np.bincount(doc, minlength=len(part)) - both
                yield part.filter(pa.array(100 * both >= percent * union)).select([0, 1])

    return run


def components(links: DataFrame) -> DataFrame:
    """v -> label, the least node of its component, for the nodes of links (a, b). Nothing is gathered on the driver.

    Each round takes the least label among a node's neighbours and then the label's own label, until nothing changes.
    """
    ends = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "ends")
    labels = cut(ends.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("least")).select("v", F.least("v", "least").alias("label")), "labels")
    while True:
        heard = ends.join(labels.select(F.col("v").alias("a"), "label"), "a").groupBy(F.col("b").alias("v")).agg(F.min("label").alias("heard"))
        told = cut(labels.join(heard, "v").select("v", F.col("label").alias("old"), F.least("label", "heard").alias("label")), "told")
        # Labels in use are few beside nodes, and one may name a third of them: looked up, not joined by key.
        used = told.select(F.col("label").alias("v")).distinct()
        above = told.join(used, "v", "left_semi").select(F.col("v").alias("label"), F.col("label").alias("above"))
        told = cut(lookup(told, above, ["label"]).select("v", "old", F.least("label", "above").alias("label")), "labels")
        if told.where("old != label").isEmpty():
            return told.select("v", "label")
        labels = told.drop("old")


class _Search:
    """One run over one table; holds what its steps share."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, miss: float, carry: tuple[str, ...] = ()):
        self.spark: SparkSession = docs.sparkSession
        self.width, self.percent, self.miss = width, percent, miss
        self.rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
        extra, kinds = [f"c{k}" for k in range(len(carry))], dict(docs.dtypes)
        read = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"), *[F.col(c).alias(k) for c, k in zip(carry, extra, strict=True)])
        schema = ", ".join([NODES, *[f"{k} {kinds[c]}" for c, k in zip(carry, extra, strict=True)]])
        with batches_of(self.spark):
            signed_rows = cut(read.mapInArrow(_signer(width, bands_for(percent / 100, miss), len(carry)), schema), "signatures")
        v = F.when(F.col("s1").isNotNull(), F.struct("s1", "s2")).alias("v")
        self.documents = signed_rows.select("id", "n", v, *extra)
        nodes = signed_rows.where("s1 IS NOT NULL").groupBy(v).agg(F.min("id").alias("least_id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
        self.nodes = cut(nodes, "nodes")

    def buckets(self) -> DataFrame:
        """key, v, size for buckets with two members or more.

        What is joined by a key that may be hot is written first, here and below: both sides of the join are then plain
        shuffles, whose large partitions adaptive execution splits.
        """
        all_ = self.nodes.select("v", F.explode("bands").alias("key"))
        shared = cut(all_.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size >= 2"), "shared")
        return cut(all_.join(shared, "key"), "buckets")

    def hub_pairs(self, buckets: DataFrame) -> DataFrame:
        known = cut(buckets.groupBy("v").agg(F.sum("size").alias("meets")), "meets")
        hubs = cut(buckets.join(known, "v").groupBy("key").agg(F.max_by("v", F.struct("meets", "v")).alias("hub")), "hubs")
        pairs = buckets.join(hubs, "key").where("v != hub").select(F.least("v", "hub").alias("a"), F.greatest("v", "hub").alias("b"))
        return pairs.distinct()

    def texts(self, ends: DataFrame) -> DataFrame:
        """v -> text for nodes (column a): one pass over the documents, behind a bitmap of the nodes' least identifiers."""
        ids = self.nodes.join(ends, F.col("v") == F.col("a"), "left_semi").select("least_id")
        wide = bits.width_for(ids.count(), 8)
        cell = F.pmod(F.xxhash64(F.col("least_id")), F.lit(1 << wide))
        wanted = self.spark.sparkContext.broadcast(bits.bitmap(ids.select(cell.alias("cell")).distinct(), F.col("cell"), wide))
        rows = self.rows.select(F.pmod(F.xxhash64("id"), F.lit(1 << wide)).alias("cell"), "text")
        with batches_of(self.spark):
            return cut(rows.mapInArrow(_texts_of(self.width, wanted, wide), TEXTS).groupBy(F.struct("s1", "s2").alias("v")).agg(F.first("text").alias("text")), "texts")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Those of distinct pairs (a, b) that are links by their full sets."""
        with batches_of(self.spark):
            pairs = cut(pairs, "survivors")
        texts = self.texts(pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct())
        both = pairs.join(texts.select(F.col("v").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("v").alias("b"), F.col("text").alias("text_b")), "b")
        node = "struct<s1:bigint,s2:bigint>"
        with batches_of(self.spark):
            return cut(both.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(self.width, self.percent), f"a {node}, b {node}"), "links")

    def tested(self, pairs: DataFrame) -> DataFrame:
        """Those of pairs (a, b) whose sizes allow a link and that pass the sequential test."""
        side = lambda x: self.nodes.select(F.col("v").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        both = both.where(100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b"))
        node = "struct<s1:bigint,s2:bigint>"
        return both.select("a", "b", "sig_a", "sig_b").mapInArrow(_compare(self.percent / 100, self.miss), f"a {node}, b {node}")

    def across(self, buckets: DataFrame, labels: DataFrame) -> DataFrame:
        """Links between different components within buckets."""
        named = buckets.join(labels, "v", "left").select("key", "v", F.coalesce("label", "v").alias("label"))
        named = cut(named.join(self.nodes.select("v", "n"), "v"), "named")
        split = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles")).where("lo != hi")
        n_blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
        split = cut(split.select("key", n_blocks.alias("n_blocks")), "split")
        open_ = cut(named.join(split, "key").drop("n"), "open")
        texts = self.texts(open_.select(F.col("v").alias("a")).distinct())
        full = open_.join(self.nodes.select("v", "sig", "bands"), "v").join(texts, "v")
        dealt = full.withColumn("own", F.pmod(F.xxhash64("v"), F.col("n_blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        blocks = dealt.groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list(F.struct("v", "label", "own", "sig", "bands", "text")).alias("members"))
        node = "struct<s1:bigint,s2:bigint>"
        compared = blocks.where(F.size("members") > 1).select("key", "members").mapInArrow(_across(self.width, self.percent, self.miss), f"a {node}, b {node}")
        with batches_of(self.spark, 2):
            return cut(compared, "across")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, percent: int = 80, miss: float = 1e-6, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row a document: id_col, n_shingles, component_id, kept (whether it names its component), component (two hashes that
    tell components apart, also those of one identifier; null without shingles), and the carried columns."""
    search = _Search(docs, id_col, text_col, width, percent, miss, carry)
    buckets = search.buckets()
    links = search.confirmed(search.tested(search.hub_pairs(buckets)))
    labels = components(links)
    rest = search.across(buckets, labels)
    if not rest.isEmpty():
        labels = components(links.unionByName(rest))
    named = search.nodes.select("v", "least_id").join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
    named = cut(named, "named")
    first = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    # Labels may be hot: one may name a third of the nodes. Nodes alone in their component need no look-up.
    shared = lookup(named.where("label != v"), first.join(named.where("label != v").select("label").distinct(), "label"), ["label"])
    own = named.where("label = v").join(first, "label")
    of_node = cut(shared.select("v", "label", "component_id").unionByName(own.select("v", "label", "component_id")), "members")
    alone = search.documents.where("v IS NULL").withColumns({"component_id": F.col("id"), "label": F.col("v")})
    grouped = search.documents.where("v IS NOT NULL").join(of_node, "v", "left").unionByName(alone, allowMissingColumns=True)
    extra = [F.col(f"c{k}").alias(c) for k, c in enumerate(carry)]
    return grouped.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), F.col("label").alias("component"), *extra)
