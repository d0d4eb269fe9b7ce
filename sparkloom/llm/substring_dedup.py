"""Removal of repeated word windows behind a count-min prefilter.

Every window of `width` words is represented by its seed, the SEED words within it whose hash is least. Equal windows
have equal seeds, so a seed's count is never below a window's. First pass: each partition sketches its seeds into a
count-min sketch of two rows, whose width grows with the bytes of all texts; a partition's sketch leaves it as pages of
touched cells, and pages of all partitions are merged by adding up cells, page by page. Second pass: only windows whose
seed both rows estimate as repeated are looked at. Merged pages up to `widest` cells a row are kept as one bit a cell,
"twice or more", in bitmaps that every task gets; those of a wider sketch stay dealt out, and the windows' cells are
joined to the cells counted twice or more. The suspected windows are grouped exactly, by 128-bit hashes: neighbouring
windows with one seed form a span, spans with equal words are grouped as one row each, and the windows of spans that stand
alone are grouped window by window with those of the spans that share a seed with them. Overestimates cost work only; no
repeated window is lost.

Texts with equal words share all results, so they are worked on once: if there are two or more, each window of one starts
in the other as well.

Defined results: a null, empty or short text loses nothing; repeated rows repeat each other's windows; an empty table
gives an empty result; further columns are ignored; a null identifier is kept.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import bits
from sparkloom.llm.common import batches_of, cut, text_or_empty
from sparkloom.llm.wordhash import Words, mix, pieces, signed

SEED = 8
#: Bytes of text a cell of the sketch, cells of a page as a power of two, and seeds that a partition sketches at a time.
BYTES_A_CELL = 16
PAGE = 20
HELD = 1 << 20

FIRST = pa.schema([("id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string()), ("row", pa.int32()), ("page", pa.int64()), ("cells", pa.binary())])
SECOND = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("seed", pa.int64()), ("a", pa.int32()), ("m", pa.int32()), ("c0", pa.int64()), ("c1", pa.int64()), ("packed", pa.binary())])
OPEN = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("p", pa.int32()), ("open", pa.bool_())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.binary(): "binary", pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _nulls(schema: pa.Schema, n: int, **given: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)


def spans(ws: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one seed: first window, number of windows, document, seed's hash."""
    n = int(ws.first[-1])
    empty = np.zeros(0, np.int64)
    if n < width:
        return empty, empty, empty, empty.astype(np.uint64)
    at = np.arange(n - SEED + 1)
    seeds = ws.sums.of(at, at + SEED, 0)
    least = np.lib.stride_tricks.sliding_window_view(seeds, width - SEED + 1).argmin(axis=1) + np.arange(n - width + 1)
    doc = np.repeat(np.arange(len(ws.first) - 1), np.diff(ws.first))
    p = np.arange(n - width + 1)
    p = p[doc[p] == doc[p + width - 1]]
    if not len(p):
        return empty, empty, empty, empty.astype(np.uint64)
    new = np.ones(len(p), bool)
    new[1:] = (least[p[1:]] != least[p[:-1]]) | (doc[p[1:]] != doc[p[:-1]])
    a = np.flatnonzero(new)
    return p[a], np.diff(np.append(a, len(p))), doc[p[a]], seeds[least[p[a]]]


def _cells(seed: np.ndarray, wide: int, row: int) -> np.ndarray:
    """The cells of seeds in a row of 2 ** wide cells."""
    return (mix(seed ^ np.uint64(0xA5A5A5A5A5A5A5A5 * row)) >> np.uint64(64 - wide)).astype(np.int64)


def _pages(seeds: list[np.ndarray], wide: int) -> Iterator[pa.RecordBatch]:
    """A sketch of seeds: for each row and page the touched cells, four bytes each; the lowest bit says twice or more."""
    for row in (0, 1):
        cells, n = np.unique(_cells(np.concatenate(seeds), wide, row), return_counts=True)
        held = (((cells & ((1 << PAGE) - 1)) << 1) | (n > 1)).astype("<u4")
        pages, first = np.unique(cells >> PAGE, return_index=True)
        yield _nulls(FIRST, len(pages), row=pa.array(np.full(len(pages), row, np.int32)), page=pa.array(pages), cells=pa.array([x.tobytes() for x in np.split(held, first[1:])], pa.binary()))


def _sketch(width: int, wide: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, held = [], 0
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                ws = Words(texts)
                t1, t2 = ws.documents()
                sha = [hashlib.sha256(b" ".join(t.encode("utf-8", "surrogatepass").split())).hexdigest() for t in texts.to_pylist()]
                ids = part.column(part.schema.get_field_index("id"))
                yield _nulls(FIRST, len(part), id=ids, t1=signed(t1), t2=signed(t2), n_words=signed(np.diff(ws.first)), sha=pa.array(sha, pa.string()))
                seeds.append(spans(ws, width)[3])
                held += len(seeds[-1])
                if held >= HELD:
                    yield from _pages(seeds, wide)
                    seeds, held = [], 0
        if held:
            yield from _pages(seeds, wide)

    return run


def _merge(as_bits: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pages, in order, added up: row, page and the cells counted twice or more, as bits or as four bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, count = None, np.zeros(1 << PAGE, np.uint8)

        def done() -> pa.RecordBatch:
            hot = np.packbits(count > 1, bitorder="little") if as_bits else np.flatnonzero(count > 1).astype("<u4")
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([hot.tobytes()], pa.binary())], names=["row", "page", "hot"])

        for batch in batches:
            for *at, cells in zip(*batch.columns, strict=True):
                now = tuple(x.as_py() for x in at)
                if now != key:
                    if key is not None:
                        yield done()
                    key = now
                    count[:] = 0
                own = np.frombuffer(cells.as_py(), "<u4")
                count[own >> 1] = np.minimum(count[own >> 1] + 1 + (own & 1), 2)
        if key is not None:
            yield done()

    return run


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells counted twice or more, a row each."""
    for batch in batches:
        for row, page, hot in zip(*batch.columns, strict=True):
            cells = (page.as_py() << PAGE) + np.frombuffer(hot.as_py(), "<u4").astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), row.as_py(), np.int32)), pa.array(cells)], names=["row", "cell"])


def _packed(t1: np.ndarray, t2: np.ndarray, texts: pa.Array) -> dict[str, pa.Array]:
    return {"t1": signed(t1), "t2": signed(t2), "packed": pa.array([zlib.compress(t.encode("utf-8", "surrogatepass"), 1) for t in texts.to_pylist()], pa.binary())}


def _suspects(width: int, wide: int, rows: object | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The spans whose cells both bitmaps have, and the packed texts that hold them; without bitmaps all spans with their cells,
    and all packed texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in pieces(batch, "text"):
                ws = Words(texts)
                a, m, doc, seed = spans(ws, width)
                c0, c1 = (_cells(seed, wide, row) for row in (0, 1))
                if rows is not None:
                    hot = bits.test(rows.value[0], c0) & bits.test(rows.value[1], c1)
                    a, m, doc, seed, c0, c1 = (x[hot] for x in (a, m, doc, seed, c0, c1))
                t1, t2 = ws.documents()
                end = a + m - 1 + width
                cells = {} if rows is not None else {"c0": pa.array(c0), "c1": pa.array(c1)}
                yield _nulls(SECOND, len(a), t1=signed(t1[doc]), t2=signed(t2[doc]), h1=signed(ws.sums.of(a, end, 0)), h2=signed(ws.sums.of(a, end, 1)), seed=signed(seed), a=pa.array((a - ws.first[doc]).astype(np.int32)), m=pa.array(m.astype(np.int32)), **cells)
                has = np.unique(doc)
                yield _nulls(SECOND, len(has), **_packed(t1[has], t2[has], texts.take(pa.array(has))))

    return run


def _unpacked(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with its packed texts as a column text. Packed, they take less room in files and shuffles."""
    texts = [zlib.decompress(x).decode("utf-8", "surrogatepass") for x in batch.column(batch.schema.get_field_index("packed")).to_pylist()]
    return batch.append_column("text", pa.array(texts, pa.string()))


def _windows(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The windows of a text's spans: columns t1, t2, packed and spans (a, m, open)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(_unpacked(batch), "text"):
                ws = Words(texts)
                col = part.column(part.schema.get_field_index("spans"))
                doc = np.repeat(np.arange(len(part)), np.asarray(col.value_lengths()).astype(np.int64))
                flat = col.flatten()
                a, m, is_open = (np.asarray(flat.field(k)) for k in range(3))
                each = np.repeat(np.arange(len(a)), m)
                p = a[each] + np.arange(len(each)) - np.repeat(np.cumsum(m) - m, m)
                at = ws.first[doc[each]] + p
                t1, t2 = (np.asarray(part.column(part.schema.get_field_index(c)))[doc[each]] for c in ("t1", "t2"))
                yield pa.RecordBatch.from_arrays([signed(ws.sums.of(at, at + width, 0)), signed(ws.sums.of(at, at + width, 1)), pa.array(t1), pa.array(t2), pa.array(p.astype(np.int32)), pa.array(is_open[each])], schema=OPEN)

    return run


def _without(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What stays of a text without its runs of repeated windows: columns t1, t2, packed and runs (a, m)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(batch.schema.get_field_index(c)) for c in ("t1", "t2")]
            texts, runs = (batch.column(batch.schema.get_field_index(c)) for c in ("packed", "runs"))
            removed, shas = [], []
            for text, own in zip(texts, runs, strict=True):
                ws = zlib.decompress(text.as_py()).split()
                flat = own.values
                a, m = np.asarray(flat.field(0)), np.asarray(flat.field(1))
                edge = np.zeros(len(ws) + 1, np.int64)
                np.add.at(edge, a, 1)
                np.add.at(edge, np.minimum(a + m - 1 + width, len(ws)), -1)
                gone = np.cumsum(edge)[:-1] > 0
                removed.append(int(gone.sum()))
                shas.append(hashlib.sha256(b" ".join(w for w, g in zip(ws, gone.tolist(), strict=True) if not g)).hexdigest())
            yield pa.RecordBatch.from_arrays([*keys, pa.array(removed, pa.int64()), pa.array(shas, pa.string())], names=["t1", "t2", "n_removed", "kept_sha"])

    return run


def sketched(rows: DataFrame, width: int, wide: int, as_bits: bool) -> tuple[DataFrame, DataFrame]:
    """(documents, pages): what is known of each document, and the merged sketch."""
    with batches_of(rows.sparkSession):
        first = cut(rows.mapInArrow(_sketch(width, wide), _ddl(FIRST)), "sketch")
    dealt = first.where(F.col("page").isNotNull()).select("row", "page", "cells").repartition("row", "page").sortWithinPartitions("row", "page")
    with batches_of(rows.sparkSession, 16):
        pages = cut(dealt.mapInArrow(_merge(as_bits), "row int, page long, hot binary"), "pages")
    return first.where(F.col("t1").isNotNull()).drop("row", "page", "cells"), pages


def suspects(rows: DataFrame, pages: DataFrame, width: int, wide: int, as_bits: bool) -> tuple[DataFrame, DataFrame]:
    """(found, texts): the spans whose seeds the sketch has twice or more, and the packed texts that hold them."""
    spark, maps = rows.sparkSession, None
    if as_bits:
        merged = [np.zeros(max(1 << wide, 1 << PAGE) // 8, np.uint8) for _ in (0, 1)]
        for p in pages.toLocalIterator():
            at = p["page"] << PAGE >> 3
            merged[p["row"]][at : at + (1 << PAGE >> 3)] = np.frombuffer(p["hot"], np.uint8)
        maps = spark.sparkContext.broadcast(merged)
    with batches_of(spark):
        second = cut(rows.select("text").mapInArrow(_suspects(width, wide, maps), _ddl(SECOND)), "suspects")
    found, texts = second.where(F.col("packed").isNull()).drop("packed"), second.where(F.col("packed").isNotNull())
    if not as_bits:
        hot = cut(pages.mapInArrow(_listed, "row int, cell long"), "hot")
        for row, c in enumerate(("c0", "c1")):
            found = found.join(hot.where(F.col("row") == row).select(F.col("cell").alias(c)), c, "left_semi")
        found = cut(found, "found")
        texts = texts.join(found.select("t1", "t2").distinct(), ["t1", "t2"], "left_semi")
    return found.drop("c0", "c1"), texts.groupBy("t1", "t2").agg(F.first("packed").alias("packed"))


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 35, widest: int = bits.WIDEST) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents, copied, texts, runs): what `dedup` needs, and of use by itself.

    documents: id, t1, t2 (a hash of the words), n_words, sha. copied: t1, t2 of texts with copies. texts: t1, t2, packed (zlib) of
    texts with suspected windows. runs: t1, t2, a, m: m windows from word a on start elsewhere as well.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wide = max(PAGE, (size // BYTES_A_CELL).bit_length())
    documents, pages = sketched(rows, width, wide, wide <= widest)
    found, texts = suspects(rows, pages, width, wide, wide <= widest)

    copied = cut(documents.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n"), F.first("n_words").alias("n_words")).where("n >= 2").drop("n"), "copied")
    place = F.struct("t1", "t2", "a", "m")
    alike = cut(found.groupBy("h1", "h2", "seed").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("place")), "alike")
    alone = alike.where("n = 1")
    repeated = found.join(alike.where("n >= 2").select("h1", "h2"), ["h1", "h2"], "left_semi").select("t1", "t2", "a", "m")
    beside = alike.where("n >= 2").join(alone.select("seed").distinct(), "seed", "left_semi")
    work = alone.select("place.*", F.lit(True).alias("open")).unionByName(beside.select("place.*", F.lit(False).alias("open")))
    work = work.groupBy("t1", "t2").agg(F.collect_list(F.struct("a", "m", "open")).alias("spans"))
    with batches_of(docs.sparkSession):
        windows = cut(texts.join(work, ["t1", "t2"]).mapInArrow(_windows(width), _ddl(OPEN)), "windows")
    again = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.max("open").alias("any_open")).where("n >= 2 AND any_open")
    singles = windows.where("open").join(again.select("w1", "w2"), ["w1", "w2"], "left_semi").select("t1", "t2", F.col("p").alias("a"), F.lit(1).alias("m"))
    runs = repeated.unionByName(singles)
    return documents, copied, texts, runs


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 35, widest: int = bits.WIDEST) -> DataFrame:
    """A row a document: id_col, n_words, n_removed, kept_sha256 (of its kept words joined by spaces)."""
    documents, copied, texts, runs = repeated_windows(docs, id_col, text_col, width=width, widest=widest)
    own = runs.join(copied.select("t1", "t2"), ["t1", "t2"], "left_anti").groupBy("t1", "t2").agg(F.collect_list(F.struct("a", "m")).alias("runs"))
    cleaned = texts.join(own, ["t1", "t2"]).mapInArrow(_without(width), "t1 long, t2 long, n_removed long, kept_sha string")
    nothing = hashlib.sha256(b"").hexdigest()
    whole = copied.where(F.col("n_words") >= width).select("t1", "t2", F.col("n_words").alias("n_removed"), F.lit(nothing).alias("kept_sha"))
    with batches_of(docs.sparkSession):
        verdicts = cut(cleaned.unionByName(whole), "verdicts")
    joined = documents.join(verdicts, ["t1", "t2"], "left")
    return joined.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha", "sha").alias("kept_sha256"))
