"""Sanitising personal data by what terms disclose.

Base detection finds e-mail addresses, IP addresses, card and phone numbers by pattern. Beyond it, terms that stand beside
a protected entity may give it away after the entity itself is gone. How strongly is read off the corpus: for an entity e
and a term t, the pointwise mutual information of their document frequencies is compared with e's information content,
and a term with PMI(e, t) >= alpha * IC(e) for any e is taken out of every document: removed where it all but determines an
entity (p(e | t) >= `sure`), generalised to a placeholder otherwise. A document that holds the term but not the entity
points to the entity as well, so it is sanitised like the others. All of it is DataFrame expressions.

Entities with the same posting list are one class (two 64-bit xor signatures of the texts that hold them), so a page of a
thousand addresses that is copied makes one class, not a thousand pairs a term. Copies of a text are folded to one row with
a weight before anything is paired. An entity of a single text counts as any other: all entities that only this text holds
are one class, which its terms are paired with once. However many copies or texts hold an entity, it is protected; only one
that all rows hold, in several different texts, has no information (IC 0) that a term could give away.

Texts are told apart by 128 bits of their SHA-256.

Defined results: a null or empty text has no spans; offsets are code points, end exclusive; repeated rows count as often
as they come; an empty table gives an empty result; further columns are ignored; a null identifier is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, let, lookup, running, running_sum, text_or_empty

#: The order of kinds within spans: four base kinds, then the two that the method adds.
KINDS = ("email", "ip", "card", "phone", "term", "quasi")

#: The contract's patterns in a form that is linear in the text: a match starts where a run of its characters starts, or
#: where the last match ended, and takes runs without giving back. Starts within a run fail as the run's start does.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

TERM = r"\p{L}{4,}+"
SPAN = "array<struct<s:int,k:int,e:int,m:string>>"


def matches(text: Column, pattern: Column | str, kind: int) -> Column:
    """Leftmost non-overlapping matches as structs s, k, e, m, with offsets in code points.

    The text between matches and the matches themselves alternate, so running sums of their lengths are the offsets.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def place(ms: Column, gaps: Column) -> Column:
        ahead = F.transform(ms, lambda m, i: F.length(F.get(gaps, i)) + F.when(i > 0, F.length(F.get(ms, i - 1))).otherwise(F.lit(0)))
        return let(running_sum(ahead), lambda starts: F.transform(ms, lambda m, i: F.struct(F.get(starts, i).alias("s"), F.lit(kind).alias("k"), (F.get(starts, i) + F.length(m)).alias("e"), m.alias("m"))))

    found = F.regexp_extract_all(text, pattern, F.lit(0))
    return let(found, lambda ms: F.when(F.size(ms) == 0, F.array().cast(SPAN)).otherwise(let(F.split(text, pattern, -1), lambda gaps: place(ms, gaps)).cast(SPAN)))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _small_parts(m: Column) -> Column:
    bare = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(m, r"\."), lambda p: (F.length(bare(p)) < 3) | ((F.length(bare(p)) == 3) & (bare(p) <= "255")))


def base_spans(text: Column) -> Column:
    """Spans of the four base kinds, by start and then kind."""
    none = F.array().cast(SPAN)
    size = lambda x: F.length(_digits(x["m"]))
    card = lambda x: size(x).between(12, 19) & F.call_function("luhn_check", F.when(size(x).between(12, 19), _digits(x["m"])).otherwise("1"))
    digit = text.rlike("[0-9]")
    kinds = [
        F.when(F.contains(text, F.lit("@")), matches(text, EMAIL, 0)).otherwise(none),
        F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(matches(text, IP, 1), lambda x: _small_parts(x["m"]))).otherwise(none),
        F.when(digit, F.filter(matches(text, CARD, 2), card)).otherwise(none),
        F.when(F.contains(text, F.lit("+")) & digit, F.filter(matches(text, PHONE, 3), lambda x: size(x).between(9, 15))).otherwise(none),
    ]
    return F.sort_array(F.concat(*kinds))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _entity(x: Column) -> Column:
    return F.concat(x["k"].cast("string"), F.lit(":"), F.when(x["k"] == 0, F.lower(x["m"])).when(x["k"] == 1, x["m"]).otherwise(_digits(x["m"])))


def terms(text: Column) -> Column:
    """Distinct words of four letters or more, outside e-mail addresses."""
    bare = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, EMAIL, " ")).otherwise(text)
    return F.array_distinct(F.regexp_extract_all(bare, F.lit(TERM), F.lit(0)))


def key_of(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def disclosing_terms(found: DataFrame, docs: DataFrame, n_docs: int, *, alpha: float, sure: float) -> DataFrame:
    """term, sure: the terms to take out. found: rows with key, text and base, for documents that hold entities; docs: a column text."""
    # Copies of a text become one row with a weight.
    texts = cut(found.groupBy("key").agg(F.count(F.lit(1)).alias("w"), F.first("text").alias("text"), F.first("base").alias("base")), "texts")
    held = texts.select("key", "w", F.explode(F.array_distinct(F.transform("base", _entity))).alias("entity"))
    classes = held.groupBy("entity").agg(F.sum("w").alias("df_e"), F.count(F.lit(1)).alias("texts"), F.bit_xor(F.xxhash64("key")).alias("x1"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("x2"))
    classes = classes.where((F.col("texts") == 1) | (F.col("df_e") < n_docs))
    # Tables are written before joins whose keys may be hot: both sides are then plain shuffles, which can be split.
    classes = cut(classes.select("entity", "x1", "x2", "df_e"), "entities")
    of_text = cut(held.join(classes, "entity").select("key", "x1", "x2", "df_e").distinct(), "classes")
    beside = texts.join(of_text.groupBy("key").agg(F.collect_list(F.struct("x1", "x2", "df_e")).alias("classes")), "key")
    beside = beside.select("w", "classes", F.explode(terms(F.col("text"))).alias("term"))
    together = cut(beside.select("w", "term", F.inline("classes")).groupBy("x1", "x2", "term", "df_e").agg(F.sum("w").alias("df_et")), "together")
    n = F.lit(float(n_docs))
    # PMI >= alpha * IC is df_t <= df_et * (n / df_e) ** (1 - alpha): a term beyond this in all its pairs is in none flagged.
    most = together.groupBy("term").agg(F.max(F.col("df_et") * F.pow(n / F.col("df_e"), F.lit(1 - alpha))).alias("most"))
    df_t = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df_t"))
    df_t = cut(df_t.join(most, "term").where(F.col("df_t") <= F.col("most") * (1 + 1e-9)).select("term", "df_t"), "df_t")
    pmi = F.log2(n * F.col("df_et") / (F.col("df_e") * F.col("df_t")))
    flagged = together.join(df_t, "term").where(pmi >= alpha * F.log2(n / F.col("df_e")) - 1e-9)
    return flagged.groupBy("term").agg(F.max(F.col("df_et") >= sure * F.col("df_t")).alias("sure"))


def _of_terms(text: Column, names: Column, kind: int, base: Column) -> Column:
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(names, "|"), F.lit(r")(?!\p{L})"))
    spans = F.when(F.size(names) > 0, matches(text, pattern, kind)).otherwise(F.array().cast(SPAN))
    return F.filter(spans, lambda x: ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))


def redact(text: Column, spans: Column) -> Column:
    """The text with a placeholder for each span, and with removed terms gone; spans, by start, that overlap are one, named by
    the first."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS[:4]], F.lit(""), F.lit("[TERM]"))

    def clear(xs: Column, ends: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(xs) - 1), lambda i: (i == 0) | (F.get(ends, i - 1) <= F.get(xs, i)["s"]))
        one = lambda hs: F.transform(hs, lambda h, j: F.struct(F.get(xs, h)["s"].alias("s"), F.get(xs, h)["k"].alias("k"), F.get(ends, F.coalesce(F.get(hs, j + 1), F.size(xs)) - 1).alias("e")))
        return let(heads, one)

    begin = lambda xs, i: F.when(i > 0, F.get(xs, i - 1)["e"]).otherwise(F.lit(0))
    part = lambda xs: lambda x, i: F.concat(text.substr(begin(xs, i) + 1, x["s"] - begin(xs, i)), F.get(names, x["k"]))
    tail = lambda xs: text.substr(F.get(xs, F.size(xs) - 1)["e"] + 1, F.length(text))
    put = lambda xs: F.concat(F.array_join(F.transform(xs, part(xs)), ""), tail(xs))
    ends = lambda xs: running(F.transform(xs, lambda x: x["e"]), lambda a, b: F.greatest(a, b))
    return F.when(F.size(spans) == 0, text).otherwise(let(spans, lambda xs: let(ends(xs), lambda es: let(clear(xs, es), put))))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, alpha: float = 0.9, sure: float = 0.9) -> DataFrame:
    """A row a document: id_col, base and spans (arrays of s, k, e, m), sanitised (the text without them)."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    found = rows.withColumn("base", base_spans(F.col("text"))).where(F.size("base") > 0).withColumn("key", key_of(F.col("text")))
    flagged = disclosing_terms(found, rows, docs.count(), alpha=alpha, sure=sure)
    held = rows.select(key_of(F.col("text")).alias("key"), F.explode(terms(F.col("text"))).alias("term"))
    hits = lookup(held, flagged, ["term"], how="inner").groupBy("key").agg(F.collect_set(F.struct("term", "sure")).alias("hits"))
    pick = lambda c: F.transform(F.filter("hits", c), lambda x: x["term"])
    hits = hits.select("key", F.sort_array(pick(lambda x: x["sure"])).alias("removed"), F.sort_array(pick(lambda x: ~x["sure"])).alias("generalised"))
    told = lookup(rows.withColumn("key", key_of(F.col("text"))), hits, ["key"]).withColumn("base", base_spans(F.col("text")))
    none = F.array().cast("array<string>")
    added = F.concat(_of_terms(F.col("text"), F.coalesce("removed", none), 4, F.col("base")), _of_terms(F.col("text"), F.coalesce("generalised", none), 5, F.col("base")))
    told = told.withColumn("spans", F.sort_array(F.concat("base", added)))
    return told.select(F.col("id").alias(id_col), "base", "spans", redact(F.col("text"), F.col("spans")).alias("sanitised"))
