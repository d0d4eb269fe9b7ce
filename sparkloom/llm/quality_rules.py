"""Host-level quality rules.

Each document is measured and held against rules; failures are counted by host (the column `source`), each host's rate is
shrunk by a beta prior whose two parameters are fitted to all hosts' rates by moments, and a host whose shrunk rate passes
`host_limit` for any rule loses all its documents. All columns are computed by DataFrame expressions, the repeated
windows by sorting a document's window hashes within its row.

Defined results: a null or empty text has no words and fails for length; a null host is a host of its own; repeated rows
count as often as they come; an empty table gives an empty result; further columns are ignored. Windows are compared by
64-bit hashes of their words' hashes within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import GAP, SPACE, cut, let, lookup, text_or_empty, words

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(tokens: Column, width: int = 5) -> Column:
    """Words that lie in a window of `width` words found twice or more among the tokens, the first one included."""

    def windows(hs: Column) -> Column:
        at = lambda i, k: F.get(hs, i + k)
        return F.transform(F.sequence(F.lit(0), F.size(hs) - width), lambda i: F.struct(F.xxhash64(*[at(i, k) for k in range(width)]).alias("h"), i.alias("i")))

    def repeats(sorted_windows: Column) -> Column:
        last = F.size(sorted_windows) - 1
        same = lambda i, j: F.get(sorted_windows, i)["h"] == F.get(sorted_windows, j)["h"]
        found = F.transform(F.sequence(F.lit(0), last), lambda i: F.when(((i > 0) & same(i, i - 1)) | ((i < last) & same(i, i + 1)), F.get(sorted_windows, i)["i"]))
        return F.sort_array(F.filter(found, lambda i: i.isNotNull()))

    def covered(starts: Column) -> Column:
        begin = F.struct(F.lit(-width).alias("end"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, i: F.struct((i + width).alias("end"), (acc["n"] + F.least(F.lit(width), i + width - acc["end"])).cast("long").alias("n"))
        return F.aggregate(starts, begin, step, lambda acc: acc["n"])

    hashes = F.transform(tokens, lambda w: F.xxhash64(w))
    return let(hashes, lambda hs: F.when(F.size(hs) <= width, F.lit(0).cast("long")).otherwise(let(F.sort_array(windows(hs)), lambda ws: covered(repeats(ws)))))


def measures(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(SPACE)) != "")
    tokens = words(text)
    return {
        "n_words": F.size(tokens).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, GAP, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long"),
        "n_repeat_words": repeated_words(tokens),
    }


def rules() -> dict[str, Column]:
    """Rules over the measures; true where a document fails."""
    c = F.col
    return {
        "short": c("n_words") < 10,
        "repeats": 100 * c("n_repeat_words") > 20 * c("n_words"),
        "symbols": 10 * c("n_symbols") > 3 * c("n_words"),
        "odd_words": (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 20 * c("n_words")),
    }


#: Rules that reject a document itself; the others count for its host only.
BASE = ("short", "repeats")


def host_verdicts(counts: DataFrame, failed: list[str], limit: float) -> DataFrame:
    """Hosts with their shrunk failure rates and a verdict. counts: host, n, and a count for each name in failed.

    By moments over hosts: mean m and variance v of the raw rates give a prior of m (1 - m) / v - 1 pseudo-documents,
    held between 1 and 1000; without variance it is 1000.
    """
    rate = lambda f: F.col(f) / F.col("n")
    stats = counts.agg(*[x for f in failed for x in (F.avg(rate(f)).alias(f"m_{f}"), F.var_pop(rate(f)).alias(f"v_{f}"))])
    both = counts.join(F.broadcast(stats))  # stats is one row
    for f in failed:
        m, v = F.col(f"m_{f}"), F.col(f"v_{f}")
        weight = F.when(v > 0, F.greatest(F.lit(1.0), F.least(F.lit(1000.0), m * (1 - m) / v - 1))).otherwise(F.lit(1000.0))
        both = both.withColumn(f"rate_{f}", (F.col(f) + m * weight) / (F.col("n") + weight))
    worst = F.greatest(*[F.col(f"rate_{f}") for f in failed], F.lit(0.0))
    return both.select("host", "n", *[f"rate_{f}" for f in failed], (worst <= limit).alias("host_kept"))


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", *, host_limit: float = 0.6) -> DataFrame:
    """A row a document: id_col, the measures, fail_<rule>, base_failed, host_kept, kept."""
    text = text_or_empty(text_col)
    host = F.when(F.col(host_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(host_col)))
    rows = docs.select(F.col(id_col), host.alias("host"), *[c.alias(k) for k, c in measures(text).items()])
    rows = cut(rows, "measures")
    rows = rows.withColumns({f"fail_{k}": c for k, c in rules().items()})
    failed = [f"fail_{k}" for k in rules()]
    counts = cut(rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f)).alias(f) for f in failed]), "hosts")
    verdicts = host_verdicts(counts, failed, host_limit)
    judged = lookup(rows, verdicts.select("host", "host_kept"), ["host"])
    base = F.col(f"fail_{BASE[0]}") | F.col(f"fail_{BASE[1]}")
    return judged.select(id_col, *MEASURES, *failed, base.alias("base_failed"), "host_kept", (~base & F.col("host_kept")).alias("kept"))
