"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks: runs of text between block-level tags, each with the path of tags above it. A block is read as
three vectors: the path's tags, classes and identifiers hashed into PATH bins, its words hashed into WORDS bins, and a few
numbers (length, share of linked text, place). A bidirectional LSTM, in numpy, runs over the page's blocks in order, so
every block is labelled in the light of the whole page: article or not. The article's blocks, in page order, are the text.

Weights are trained by html_training.py on pages that it makes up, and stored beside this module.

Defined results: a null or empty page has no text; unclosed tags and a page that breaks off are read as far as they go;
character references are decoded; white space within a block, line breaks included, becomes one space; repeated rows give
equal results; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import small_batches
from sparkloom.llm.wordhash import Words, pieces

PATH, WORDS, NUMBERS = 256, 64, 8
#: Blocks whose vectors are made at a time, and time steps whose gates are: a page of any length takes bounded room for these.
CHUNK = 4096
WEIGHTS = Path(__file__).with_name("html_weights.npz")

#: Fixed values of HTML: tags that end a block of text, tags without content, tags whose content isn't text, and tags
#: before which an open paragraph, list item, cell or the like is closed.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea noscript template svg math iframe object canvas audio video".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")

Block = tuple[str, tuple[str, ...], int]


@cache
def _raw_end(tag: str) -> re.Pattern[str]:
    return re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I)


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    """A tag's contribution to the path: itself and the parts of its classes and identifiers."""
    out = [tag]
    if "=" in attributes:
        for m in NAMED.finditer(attributes):
            out += [f".{x.lower()}" for x in PART.findall(m[1] or m[2] or m[3] or "")]
    return tuple(out)


def blocks(page: str) -> list[Block]:
    """Text, path and number of linked characters of each block with text."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    texts: list[str] = []
    linked, in_link, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if texts:
            text = " ".join("".join(texts).split())
            if text:
                out.append((text, tuple(x for _, names in stack for x in names), linked))
            texts.clear()
        linked = 0

    def close_to(k: int) -> None:
        nonlocal in_link
        in_link -= sum(t == "a" for t, _ in stack[k:])
        del stack[k:]

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            texts.append(text)
            if in_link:
                linked += len(text.strip())

    while m := TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                flush()
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), -1)
            if k >= 0 and (tag in BLOCK or not any(t in BLOCK for t, _ in stack[k + 1 :])):
                close_to(k)
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                end = _raw_end(tag).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES:
                k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in CLOSES[tag] or stack[k][0] in HOLDS[tag]), -1)
                if k >= 0 and stack[k][0] in CLOSES[tag]:
                    close_to(k)
            # A paragraph ends where another block begins; so do headings, which hold no blocks.
            k = next((k for k, (t, _) in enumerate(stack) if t == "p" or t in HEADINGS), -1)
            if k >= 0 and tag not in ("label", "button"):
                close_to(k)
        elif tag == "br":
            texts.append(" ")
        if tag not in VOID:
            stack.append((tag, _names(tag, m[3])))
            in_link += tag == "a"
    add(page[at:])
    flush()
    return out


@cache
def _bins(names: tuple[str, ...]) -> np.ndarray:
    return np.array([zlib.crc32(x.encode()) % PATH for x in dict.fromkeys(names)], np.int64)


def _rows(flat: list[Block], place: np.ndarray) -> np.ndarray:
    """A vector a block; place: where each one lies on its page, from 0 to 1."""
    n = len(flat)
    x = np.zeros((n, PATH + WORDS + NUMBERS), np.float32)
    if _bins.cache_info().currsize > 50_000:
        _bins.cache_clear()
    for i, (_, names, _) in enumerate(flat):
        x[i, _bins(names)] = 1
    ws = Words(pa.array([t for t, _, _ in flat], pa.string()), lower=True)
    size = np.diff(ws.first)
    bag = np.bincount(np.repeat(np.arange(n), size) * WORDS + (ws.hashes[0] >> np.uint64(58)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
    x[:, PATH : PATH + WORDS] = bag / np.maximum(np.sqrt((bag * bag).sum(axis=1, keepdims=True)), 1)
    chars = np.array([len(t) for t, _, _ in flat])
    depth = np.array([len(names) for _, names, _ in flat])
    x[:, -NUMBERS:] = np.stack([
        np.log1p(chars) / 8, np.log1p(size) / 6, np.array([k for _, _, k in flat]) / np.maximum(chars, 1), place,
        np.array([t[-1] in ".!?:;…。" for t, _, _ in flat]), np.minimum(depth, 30) / 30, np.array([bool(HEADINGS & set(names)) for _, names, _ in flat]), np.ones(n),
    ], 1)
    return x


def vectors(pages: list[list[Block]], then: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> np.ndarray:
    """A row a block, all pages' blocks one after the other; `then` is applied to CHUNK rows at a time."""
    flat = [b for p in pages for b in p]
    place = np.concatenate([np.zeros(0), *[np.linspace(0, 1, len(p)) for p in pages if p]])
    cuts = range(0, len(flat), CHUNK)
    return np.concatenate([then(_rows(flat[a : a + CHUNK], place[a : a + CHUNK])) for a in cuts] or [then(np.zeros((0, PATH + WORDS + NUMBERS), np.float32))])


def lstm(x: np.ndarray, w: np.ndarray, b: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Hidden states (time, pages, hidden) for inputs (time, pages, features); pages that have ended keep their state."""
    hidden = w.shape[1] // 4
    h, c = np.zeros((x.shape[1], hidden), np.float32), np.zeros((x.shape[1], hidden), np.float32)
    out = np.zeros((*x.shape[:2], hidden), np.float32)
    for t in range(len(x)):
        if t % CHUNK == 0:
            pre = x[t : t + CHUNK] @ w[: x.shape[2]] + b
        g = pre[t % CHUNK] + h @ w[x.shape[2] :]
        i, f, o = (1 / (1 + np.exp(-g[:, k * hidden : (k + 1) * hidden])) for k in range(3))
        fresh = f * c + i * np.tanh(g[:, 3 * hidden :])
        on = live[t][:, None]
        c = np.where(on, fresh, c)
        h = np.where(on, o * np.tanh(fresh), h)
        out[t] = h
    return out


def padded(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, inputs with each page turned round, live, index): index[t, p] is the row of page p's block t."""
    longest, first = int(sizes.max()), np.cumsum(sizes) - sizes
    t = np.arange(longest)[:, None]
    live = t < sizes[None]
    index = np.where(live, first[None] + t, 0)
    turned = np.where(live, first[None] + sizes[None] - 1 - t, 0)
    return x[index], x[turned], live, index


def label(pages: list[list[Block]], model: dict[str, np.ndarray]) -> list[np.ndarray]:
    """For each page, the probability of each block to be the article's."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        # Pages of similar length together, so many that inputs stay within some 20 MB.
        to = at + 1
        while to < len(order) and to - at < 128 and (to + 1 - at) * len(pages[order[to]]) <= 12_000:
            to += 1
        group = [pages[i] for i in order[at:to]]
        sizes = np.array([len(p) for p in group])
        x = vectors(group, lambda rows: np.tanh(rows @ model["w_in"] + model["b_in"]))
        ahead, behind, live, _ = padded(x, sizes)
        h1 = lstm(ahead, model["w_f"], model["b_f"], live)
        h2 = lstm(behind, model["w_b"], model["b_b"], live)
        for k, i in enumerate(order[at:to]):
            n = sizes[k]
            both = np.concatenate([h1[:n, k], h2[:n, k][::-1], ahead[:n, k]], 1)
            out[i] = 1 / (1 + np.exp(-(both @ model["w_out"] + model["b_out"])))[:, 0]
        at = to
    return out


@cache
def weights(path: str) -> dict[str, np.ndarray]:
    with np.load(path) as f:
        return {k: f[k].astype(np.float32) for k in f.files}


def main_texts(pages: list[str], model: dict[str, np.ndarray]) -> list[str]:
    cut = [blocks(p) for p in pages]
    return ["\n\n".join(b[0] for b, p in zip(page, ps.tolist(), strict=True) if p >= 0.5) for page, ps in zip(cut, label(cut, model), strict=True)]


def _extractor(model: dict[str, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, htmls in pieces(batch, batch.num_columns - 1):  # by bytes, as pages may be long
                texts = main_texts(htmls.to_pylist(), model)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=[*part.schema.names[:-1], "text"])

    return run


def main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """A row a page: id_col, the carried columns, text."""
    small_batches(pages.sparkSession)
    kinds = dict(pages.dtypes)
    rows = pages.select(id_col, *carry, F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in (id_col, *carry))
    return rows.mapInArrow(_extractor(weights(str(WEIGHTS))), f"{fields}, text string")
