"""Encoding to and decoding from the pieces of a SentencePiece byte-pair model, over a lattice of pieces.

A text's words (a run of space marks and what follows, up to the next mark) are encoded one by one, as no piece spans two.
A word's lattice has an edge for every substring of bounded length that is a piece. Within it runs the one path that the
model's merges give: an edge extends a path if its piece is stable behind the path's last piece (see bpe.py), which makes
the fold over the edges, ordered by where they end, a Viterbi pass with a single survivor a position.

`lattice` does this to a table of words relationally: explode substrings, equi-join the piece table (as large as the
vocabulary, so broadcast), group edges by word, fold with Spark's higher-order aggregate. `encode` runs the same steps
over documents within Arrow batches, each distinct word once a worker: joining every word of every document to a word
table would shuffle several times the corpus (see README for figures).

Defined results: a null or empty text has no ids; what no piece covers becomes byte pieces; decode(encode(x)) == x for
every text without the mark itself, which decodes to a space as in the library; repeated rows are encoded alike; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.bpe import CHUNK, LONGEST, Vocabulary
from sparkloom.llm.common import small_batches, text_or_empty
from sparkloom.llm.wordhash import pieces

MARK = "▁"
#: Bytes of words and ids that a worker keeps.
KEPT = 160 << 20
#: A newline is in no piece, so it is a word of its own. Within this module a space stands for the mark.
WORD = re.compile(" *[^ \n]+| +|\n")


class PieceVocabulary(Vocabulary):
    """Symbols: code points. Pieces of the model's normal and user-defined kinds; scores give the order of merges."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text = [model.id_to_piece(i).replace(MARK, " ") for i in range(model.get_piece_size())]
        self.bytes_from = next(i for i in range(len(self.text)) if model.is_byte(i))
        plain = [i for i in range(len(self.text)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.of_text = {self.text[i]: i for i in plain}
        self.halves: dict[int, tuple[int, int]] = {}
        raw = [b""] * len(self.text)
        for i in plain:
            raw[i] = self.text[i].encode()
        for b in range(256):
            raw[self.bytes_from + b] = bytes([b])
        self.raw = raw
        rank = {i: -model.get_score(i) for i in plain if len(self.text[i]) > 1}
        super().__init__({i: tuple(map(ord, self.text[i])) for i in plain}, rank)
        self.reachable = np.zeros(self.unknown + 1, bool)
        for i in plain:
            self.reachable[i] = self.merged(list(self.tokens[i])) == [i]

    def merge(self, a: int, b: int) -> int:
        if a >= self.unknown or b >= self.unknown:
            return -1
        return self.of_text.get(self.text[a] + self.text[b], -1)

    def split(self, t: int) -> tuple[int, int]:
        """The last merge of t's own making: of its two halves that are stable together but for t itself."""
        if t not in self.halves:
            text = self.text[t]
            for k in range(1, len(text)):
                a, b = self.of_text.get(text[:k], -1), self.of_text.get(text[k:], -1)
                if a >= 0 and b >= 0 and self.merged_without(t, k):
                    self.halves[t] = (a, b)
                    break
        return self.halves[t]

    def merged_without(self, t: int, k: int) -> bool:
        """Whether encoding t's text with t itself barred ends in its first k symbols and the rest."""
        text = self.text[t]
        a, b = self.of_text[text[:k]], self.of_text[text[k:]]
        held = self.of_text.pop(text)
        try:
            return self.merged([ord(c) for c in text]) == [a, b]
        finally:
            self.of_text[text] = held

    def _whole(self, t: np.ndarray) -> np.ndarray:
        return self.reachable[np.minimum(t, self.unknown)] | (t >= self.unknown)

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return super().stable(a, b) & self._whole(b)

    def out(self, token: int) -> list[int]:
        """A token's ids: itself, or bytes for a symbol that no piece has."""
        if token < self.unknown:
            return [token]
        return [self.bytes_from + b for b in chr(token - self.unknown).encode("utf-8", "surrogatepass")]

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Each word's ids: the path back from its last symbol, for all words step by step."""
        short = [i for i, w in enumerate(words) if len(w) <= LONGEST]
        flat = np.frombuffer("".join([words[i] for i in short]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        offsets = np.concatenate(([0], np.cumsum([len(words[i]) for i in short]))).astype(np.int64)
        last, back = self.prefixes(flat, offsets)
        at, word, start = offsets[1:] - 1, np.arange(len(short)), offsets[:-1]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(at):
            found.append((word, last[at]))
            at = at - back[at]
            on = at >= start
            at, word, start = at[on], word[on], start[on]
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        if found:
            word, tok = (np.concatenate([f[i] for f in reversed(found)]) for i in (0, 1))
            order = np.argsort(word, kind="stable")
            word, tok = word[order], tok[order]
            for i, part in zip(short, np.split(tok.astype(np.int32), np.cumsum(np.bincount(word, minlength=len(short)))[:-1]), strict=True):
                out[i] = part
            for w in np.unique(word[tok >= self.unknown]).tolist():
                i = short[w]
                out[i] = np.array([x for t in out[i].tolist() for x in self.out(t)], np.int32)
        for i, w in enumerate(words):
            if len(w) > LONGEST:
                out[i] = np.array([x for t in self.merged([ord(c) for c in w]) for x in self.out(t)], np.int32)
        return out

    def decode(self, ids: list[int]) -> str:
        data = b"".join(map(self.raw.__getitem__, ids))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


class Known:
    """Ids of words met so far, in one array: word w's are flat[first[w]:first[w + 1]]. `bytes` estimates what they take."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.first, self.n, self.bytes = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), 0, 0

    def add(self, words: list[str], ids: list[np.ndarray]) -> None:
        self.index.update(zip(words, range(self.n, self.n + len(words)), strict=True))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        end = int(self.first[self.n]) + int(sizes.sum())
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(end, np.int32)])
        if self.n + len(words) >= len(self.first):
            self.first = np.concatenate([self.first, np.zeros(self.n + len(words) + 1, np.int64)])
        if words:
            np.concatenate(ids, out=self.flat[int(self.first[self.n]) : end], casting="unsafe")
        self.first[self.n + 1 : self.n + len(words) + 1] = self.first[self.n] + np.cumsum(sizes)
        self.n += len(words)
        # A string, its place in the dictionary and its offset; a code point of most scripts takes two bytes at most.
        self.bytes += 180 * len(words) + 2 * sum(map(len, words)) + 8 * int(sizes.sum())


@cache
def vocabulary(path: str) -> tuple[PieceVocabulary, Known, pa.Array]:
    """The vocabulary of a file, the words met so far and the pieces' bytes: one a worker."""
    v = PieceVocabulary(path)
    return v, Known(), pa.array(v.raw, pa.binary())


def _chunks(words: list[str]) -> Iterator[list[str]]:
    """Words in lists of CHUNK symbols or one word."""
    at = size = 0
    for i, w in enumerate(words):
        if i > at and size + len(w) > CHUNK:
            yield words[at:i]
            at, size = i, 0
        size += len(w)
    if words:
        yield words[at:]


def encode_texts(path: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first): text t's ids are ids[first[t]:first[t + 1]]."""
    vocab, known, _ = vocabulary(path)
    if known.bytes > KEPT:
        known.clear()
    cut = [WORD.findall(" " + (t.replace(MARK, " ") if MARK in t else t)) if t else [] for t in texts]
    flat = list(chain.from_iterable(cut))
    for new in _chunks(list(set(flat).difference(known.index))):
        known.add(new, vocab.encode_words(new))
    word = np.fromiter(map(known.index.__getitem__, flat), np.int64, len(flat))
    begin = known.first[word]
    sizes = known.first[word + 1] - begin
    before = np.concatenate([[0], np.cumsum(sizes)])
    ids = known.flat[np.repeat(begin - before[:-1], sizes) + np.arange(before[-1])]
    return ids, before[np.concatenate([[0], np.cumsum([len(ws) for ws in cut])]).astype(np.int64)]


def same_text(path: str, ids: np.ndarray, first: np.ndarray, texts: list[str]) -> np.ndarray:
    """Whether each text's ids decode to it, by the bytes of the pieces."""
    taken = vocabulary(path)[2].take(pa.array(ids))
    data = bytes(taken.buffers()[2] or b"")
    ends = np.frombuffer(taken.buffers()[1], np.int32)[: len(ids) + 1][first].tolist() if len(ids) else [0] * len(first)
    return np.array([data[a:b] == (b" " + t.encode("utf-8", "surrogatepass") if t else b"") for t, a, b in zip(texts, ends, ends[1:], strict=False)], bool)


def _encoder(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [i for i, f in enumerate(batch.schema) if f.name != "text"]
            for part, own in pieces(batch, "text", 1 << 20):  # so much text at a time that a worker's memory stays bounded
                texts = own.to_pylist()
                ids, first = encode_texts(path, texts)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in keep], lists, pa.array(same_text(path, ids, first, texts))], names=[*[batch.schema.field(i).name for i in keep], "ids", "round_trip"])

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: id_col, ids, round_trip (whether decoding the ids gives the text back)."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(_encoder(path), f"`{id_col}` {kind}, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """A row for each: id_col, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)[0]
        for batch in batches:
            texts = [vocab.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    small_batches(encoded.sparkSession)
    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {dict(encoded.dtypes)[id_col]}, text string")


def lattice(words: DataFrame, path: str, word_col: str = "word") -> DataFrame:
    """The pieces of a table of words, relationally: a row a distinct word, word and toks (unknown + code point where no piece is).

    A space stands for the mark. A word of n symbols has at most n * 16 substrings.
    """
    spark, vocab = words.sparkSession, vocabulary(path)[0]
    table = spark.createDataFrame([(p, i) for p, i in vocab.of_text.items() if vocab.reachable[i]], "piece string, tok long")
    distinct = words.select(F.col(word_col).alias("word")).where(F.length("word") > 0).distinct()
    spans = distinct.withColumn("s", F.explode(F.sequence(F.lit(0), F.length("word") - 1)))
    spans = spans.withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.lit(vocab.longest), F.length("word") - F.col("s")))))
    spans = spans.withColumn("piece", F.substring("word", F.col("s") + 1, F.col("k")))
    joined = spans.join(F.broadcast(table), "piece", "left").where(F.col("tok").isNotNull() | (F.col("k") == 1))
    edges = joined.select("word", "s", (F.col("s") + F.col("k")).alias("e"), F.coalesce("tok", F.lit(vocab.unknown) + F.conv(F.hex(F.encode("piece", "UTF-32")), 16, 10).cast("long")).alias("tok"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)[0]
        for b in batches:
            prev, tok = (b.column(i).to_numpy() for i in (0, 1))
            yield b.filter(pa.array(v.stable(prev, tok)))

    before = edges.select("word", F.col("e").alias("s"), F.col("tok").alias("prev"))
    steps = before.join(edges, ["word", "s"])
    stable = steps.select("prev", "tok").distinct().mapInArrow(judge, "prev long, tok long")
    steps = steps.join(stable, ["prev", "tok"]).unionByName(edges.where("s = 0").withColumn("prev", F.lit(-1).cast("long")))
    grouped = steps.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("e", "s", "prev", "tok"))).alias("steps"))

    def fold(acc: Column, step: Column) -> Column:
        fits = (step["s"] == 0) | (F.get(acc, step["s"])["tok"] == step["prev"])
        return F.when(fits, F.transform(acc, lambda x, i: F.when(i == step["e"], F.struct(step["tok"].alias("tok"), step["s"].alias("s"))).otherwise(x))).otherwise(acc)

    start = F.transform(F.sequence(F.lit(0), F.length("word")), lambda i: F.struct(F.lit(-1).cast("long").alias("tok"), F.lit(0).alias("s")))
    best = grouped.select("word", F.aggregate("steps", start, fold).alias("best"))
    zero = F.struct(F.length("word").alias("at"), F.array().cast("array<bigint>").alias("toks"))
    walk = lambda acc, _: F.when(acc["at"] > 0, F.struct(F.get(F.col("best"), acc["at"])["s"].alias("at"), F.array_prepend(acc["toks"], F.get(F.col("best"), acc["at"])["tok"]).alias("toks"))).otherwise(acc)
    paths = best.select("word", F.aggregate("best", zero, walk)["toks"].alias("toks"))
    return paths
