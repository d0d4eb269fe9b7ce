"""Exact token counts at every prefix, by prefix dynamic programming.

The vocabulary is a byte-level merge table with word ends. A text is normalised and cut into words as the vocabulary's
file says, and its table of prefixes is kept: the count of a prefix that ends between words is the running sum of its words'
counts. Within a word, `bpe.Vocabulary.prefixes` has every prefix's last token, from which the count of each prefix, taken as
a word of its own, follows by one more step (`WordVocabulary.prefix_counts`). Truncation and budget questions are answered
from these tables without encoding anything again.

Defined results: a null or empty text has 0 bytes, an empty table and so 0 tokens; special strings in a text count as one
token, as in the library's default; repeated rows are counted alike; further columns are ignored; texts and words may be of any
length; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.bpe import _BASE, _INVERSE, LONGEST, Vocabulary, _mix, _powers
from sparkloom.llm.common import small_batches, text_or_empty
from sparkloom.llm.wordhash import pieces

#: Words whose counts a worker keeps (about 50 MB).
KEPT = 300_000


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordVocabulary(Vocabulary):
    """Symbols: 0-255 a byte, 256-511 a byte that ends its word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], _byte_letters()
        self.suffix = model["end_of_word_suffix"]

        def symbols(piece: str) -> tuple[int, ...]:
            ends = piece.endswith(self.suffix)
            body = [letters[c] for c in (piece.removesuffix(self.suffix) if ends else piece)]
            return (*body[:-1], body[-1] + 256) if ends else tuple(body)

        vocab = model["vocab"]
        self.pairs, self.halves, rank = {}, {}, {}
        for r, (a, b) in enumerate(model["merges"]):
            t = vocab[a + b]
            self.pairs[(vocab[a] << 32) | vocab[b]] = t
            if t not in rank:
                rank[t], self.halves[t] = r, (vocab[a], vocab[b])
        tokens = {i: symbols(p) for p, i in vocab.items() if p != self.suffix}
        super().__init__({i: s for i, s in tokens.items() if len(s) == 1 or i in rank}, rank)
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.word = regex.compile(split)
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"])) if spec["added_tokens"] else None

    def merge(self, a: int, b: int) -> int:
        return self.pairs.get((a << 32) | b, -1)

    def split(self, t: int) -> tuple[int, int]:
        return self.halves[t]

    def normal(self, text: str) -> str:
        text = text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def words(self, text: str) -> list[str]:
        """The words of a text; a special string is the word of a zero byte and its own text."""
        if self.special is None or "<" not in text:
            return self.word.findall(self.normal(text))
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*self.word.findall(self.normal(text[at : m.start()])), "\0" + m[0]]
            at = m.end()
        return out + self.word.findall(self.normal(text[at:]))

    def prefix_counts(self, words: list[str]) -> list[list[int]]:
        """For each word, the tokens of each of its prefixes in code points, taken as a word of its own: out of one table.

        A prefix that ends its word is a prefix that doesn't and one last token with the word's end, the only one that is
        stable behind it. Words of more than LONGEST bytes are merged prefix by prefix.
        """
        out: list[list[int]] = [[] for _ in words]
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        for i, r in enumerate(raw):
            if len(r) > LONGEST:
                out[i] = self.word_counts([words[i][:k] for k in range(1, len(words[i]) + 1)])
        short = [i for i, r in enumerate(raw) if 0 < len(r) <= LONGEST]
        if not short:
            return out
        flat = np.frombuffer(b"".join(raw[i] for i in short), np.uint8).astype(np.int64)
        sizes = np.array([len(raw[i]) for i in short])
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        last, back = self.prefixes(flat, offsets)
        open_ = self.counts(last, back, offsets)
        ended = self.ended(flat, np.arange(len(flat)) - np.repeat(offsets[:-1], sizes), last, open_)
        for i, a in zip(short, offsets.tolist(), strict=False):
            ends = np.cumsum([len(ch.encode("utf-8", "surrogatepass")) for ch in words[i]]) - 1
            out[i] = ended[a + ends].tolist()
        return out

    def ended(self, flat: np.ndarray, within: np.ndarray, last: np.ndarray, open_: np.ndarray) -> np.ndarray:
        """Tokens of every prefix that ends its word. within: places in the words; last, open_: last tokens and counts of the
        prefixes that don't end their words."""
        sums, inverse, powers = self._sums(flat), _powers(_INVERSE, len(flat) + 1), _powers(_BASE, len(flat) + 1)
        closing = _mix((flat + 256).astype(np.uint64) + np.uint64(1)) * powers[: len(flat)]
        out = np.zeros(len(flat), np.int64)
        for k in range(1, min(self.longest, int(within.max()) + 1) + 1):
            p = np.flatnonzero((within >= k - 1) & (out == 0))
            start = p - k + 1
            token = self._find(_mix((sums[p] - sums[start] + closing[p]) * inverse[start] + np.uint64(k)))
            p, start, token = p[token >= 0], start[token >= 0], token[token >= 0]
            whole = within[p] == k - 1
            before = np.where(whole, 0, start - 1)
            fits = whole.copy()
            fits[~whole] = self.stable(last[before[~whole]], token[~whole])
            out[p[fits]] = np.where(whole, 1, open_[before] + 1)[fits]
        return out

    def word_counts(self, words: list[str]) -> list[int]:
        """Tokens of each word."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        short = [i for i, r in enumerate(raw) if len(r) <= LONGEST and r[:1] != b"\0"]
        flat = np.frombuffer(b"".join(raw[i] for i in short), np.uint8).astype(np.int64)
        offsets = np.concatenate(([0], np.cumsum([len(raw[i]) for i in short]))).astype(np.int64)
        flat[offsets[1:] - 1] += 256
        last, back = self.prefixes(flat, offsets)
        ends = self.counts(last, back, offsets)[offsets[1:] - 1].tolist() if short else []
        out = [1] * len(words)
        for i, n in zip(short, ends, strict=True):
            out[i] = n
        for i, r in enumerate(raw):
            if len(r) > LONGEST and r[:1] != b"\0":
                out[i] = len(self.merged([*r[:-1], r[-1] + 256]))
        return out


@cache
def vocabulary(path: str) -> tuple[WordVocabulary, dict[str, int]]:
    """The vocabulary of a file and the counts of words met so far: one a worker."""
    return WordVocabulary(path), {}


def count_words(path: str, texts: list[list[str]]) -> list[list[int]]:
    """Tokens of each word of each text."""
    vocab, known = vocabulary(path)
    if len(known) > KEPT:
        known.clear()
    new = list(set().union(*texts).difference(known))
    known.update(zip(new, vocab.word_counts(new), strict=True))
    return [list(map(known.__getitem__, ws)) for ws in texts]


def within(tokens: Column, budget: int) -> Column:
    """Leading words of a text that a budget of tokens has room for, out of its table of prefixes."""
    return F.size(F.filter(tokens, lambda n: n <= budget)).cast("long")


def total(tokens: Column) -> Column:
    return F.when(F.size(tokens) > 0, F.element_at(tokens, -1)).otherwise(0).cast("long")


def _tables(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)[0]
        for batch in batches:
            keep = [i for i, f in enumerate(batch.schema) if f.name != "text"]
            for part, texts in pieces(batch, "text", 1 << 20):  # so much text at a time that a worker's memory stays bounded
                counts = count_words(path, [vocab.words(t) for t in texts.to_pylist()])
                first = np.concatenate(([0], np.cumsum([len(x) for x in counts]))).astype(np.int64)
                sums = np.concatenate(([0], np.cumsum(np.fromiter(chain.from_iterable(counts), np.int64, int(first[-1])))))
                tokens = sums[1:] - np.repeat(sums[first[:-1]], np.diff(first))
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(tokens.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in keep], lists], names=[*[part.schema.field(i).name for i in keep], "tokens"])

    return run


def prefix_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: id_col, n_bytes, tokens (the count of each prefix that ends behind a word, in order)."""
    small_batches(docs.sparkSession)
    text = text_or_empty(text_col)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(_tables(path), f"id {kind}, n_bytes long, tokens array<int>").withColumnRenamed("id", id_col)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, limit: int = 2048) -> DataFrame:
    """A row a document: id_col, n_bytes, n_tokens, n_pieces (its words), fitting_pieces (its leading words within limit tokens)."""
    table = prefix_table(docs, path, id_col, text_col)
    return table.select(id_col, "n_bytes", total(F.col("tokens")).alias("n_tokens"), F.size("tokens").cast("long").alias("n_pieces"), within(F.col("tokens"), limit).alias("fitting_pieces"))
