"""Chunkers: a text into overlapping pieces, as Columns where offsets suffice and as a Python table function otherwise."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"\S+")
CHUNK = "index int, start_token int, end_token int, total_chunks int, chunk string"


def chunk_chars(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Array of substrings, one every size - overlap characters; the last may lie within the one before."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size - overlap))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size))))


def token_ranges(n: int, size: int, overlap: int, least: int) -> list[tuple[int, int]]:
    """Token ranges of a text of n tokens; a short tail is left out."""
    if n <= size:
        return [(0, n)] if n else []
    out, start = [], 0
    while start < n:
        end = min(start + size, n)
        if end - start >= least or start == 0:
            out.append((start, end))
        step = end - overlap
        start = step if step > start else end
    return out


def sentence_ranges(tokens: list[str], size: int, overlap: int, least: int) -> list[tuple[int, int]]:
    """The same, each range ending with a sentence if one ends within its last fifth."""
    n = len(tokens)
    if n <= size:
        return [(0, n)] if n else []
    out, start = [], 0
    while start < n:
        goal = min(start + size, n)
        end = next((i + 1 for i in range(goal - 1, max(start, goal - size // 5) - 1, -1) if tokens[i][-1] in ".!?"), goal)
        if end - start >= least or start == 0:
            out.append((start, end))
        start = max(end - overlap, start + 1)
    return out


def _chunks(text: str, size: int, overlap: int, least: int, sentences: bool) -> list[tuple[int, int, int, int, str]]:
    spans = [m.span() for m in TOKEN.finditer(text or "")]
    if len(spans) <= size:
        return [(0, 0, len(spans), 1, text.strip())] if spans else []
    ranges = sentence_ranges([text[a:b] for a, b in spans], size, overlap, least) if sentences else token_ranges(len(spans), size, overlap, least)
    return [(i, a, b, len(ranges), text[spans[a][0] : spans[b - 1][1]]) for i, (a, b) in enumerate(ranges)]


def chunk_tokens(docs: DataFrame, id_col: str, text_col: str, size: int = 500, overlap: int = 50, least: int = 100, *, sentences: bool = False) -> DataFrame:
    """A row a chunk: id_col, index, start_token, end_token, total_chunks, chunk (a verbatim slice of the text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *c) for k, t in zip(pdf[id_col], pdf[text_col], strict=True) for c in _chunks(t, size, overlap, least, sentences)]
            yield pd.DataFrame(rows, columns=[id_col, "index", "start_token", "end_token", "total_chunks", "chunk"])

    return docs.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, {CHUNK}")


def chunk_by_source(docs: DataFrame, id_col: str, text_col: str, source_col: str, *, short: int = 280, size: int = 1500, overlap: int = 150) -> DataFrame:
    """A row a chunk by the kind of source: short posts whole, code by top-level blocks, articles by paragraphs up to size
    characters with the end of the one before in front."""

    def parts(text: str, kind: str) -> list[str]:
        if len(text) <= short or kind == "post":
            return [text] if text.strip() else []
        units = re.split(r"\n(?=\S)", text) if kind == "code" else re.split(r"\n\s*\n|\n", text)
        out: list[str] = []
        for u in units:
            if out and len(out[-1]) + len(u) + 1 <= size:
                out[-1] += "\n" + u
            else:
                out += [u[i : i + size] for i in range(0, len(u), size)] or []
        if kind == "code":
            return [x for x in out if x.strip()]
        return [x if i == 0 else out[i - 1][-overlap:] + "\n" + x for i, x in enumerate(out) if x.strip()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, c) for k, t, s in zip(pdf[id_col], pdf[text_col], pdf[source_col], strict=True) for i, c in enumerate(parts(t or "", s or ""))]
            yield pd.DataFrame(rows, columns=[id_col, "index", "chunk"])

    return docs.select(id_col, text_col, source_col).mapInPandas(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, index int, chunk string")
