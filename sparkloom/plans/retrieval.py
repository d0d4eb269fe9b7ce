"""Queries: scalar functions, full-text search, vectors, retrieval, fusion and reranking."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.functions import vectors as V
from sparkloom.operators import fts, fusion, graph, resolve, windows
from sparkloom.plans.registry import query
from sparkloom.session import cut
from sparkloom.sources import tables as t
from sparkloom.sources.tables import with_

c = F.col
TERMS = ["thing", "ered"]

# ---- scalar functions -------------------------------------------------------------------------------------------


@query("C1_normalize_entity_text", with_("entities", "SELECT uri, regexp_replace(replace(replace(replace(trim(lower(concat(' @', entity_text, '_x-y '))), '_', ' '), '-', ' '), '  ', ' '), '^@+', '') AS norm FROM entities"))
def normalize(s: SparkSession, d: str) -> DataFrame:
    return t.entities(s, d).select("uri", T.normalize_entity_text(F.concat(F.lit(" @"), "entity_text", F.lit("_x-y "))).alias("norm"))


@query("C2_alias_list", with_("entities", "SELECT uri, concat(lower(trim(entity_text)), '|', lower(entity_type)) AS aliases FROM entities WHERE lower(trim(entity_text)) <> lower(entity_type)"))
def aliases(s: SparkSession, d: str) -> DataFrame:
    raw = F.array(F.concat(F.lit("[[People/"), "entity_text", F.lit("|Shown]]")), c("entity_type"), F.upper("entity_text"), F.lit(None))
    return t.entities(s, d).select("uri", F.array_join(T.normalize_alias_list(raw), "|").alias("aliases"))


@query("C3_normalize_entity_name", with_("entities", "SELECT uri, regexp_replace(trim(regexp_replace(lower(replace(replace(entity_text, '#', ' '), '_', ' ')), '[ -]+', ' ', 'g')), '[.]+$', '') AS name FROM entities WHERE entity_type = 'Person'"))
def entity_name(s: SparkSession, d: str) -> DataFrame:
    return t.entities(s, d).where("entity_type = 'Person'").select("uri", T.normalize_entity_name(F.concat(F.lit("@The "), F.replace("entity_text", F.lit("#"), F.lit(" ")), F.lit(", Inc. | RND"))).alias("name"))


def _jw(a: str, b: str) -> str:
    """SQL of Jaro-Winkler with the prefix boost always applied."""
    same = f"CASE WHEN left({a}, 4) = left({b}, 4) THEN least(4, length({a}), length({b})) WHEN left({a}, 3) = left({b}, 3) THEN 3 WHEN left({a}, 2) = left({b}, 2) THEN 2 WHEN left({a}, 1) = left({b}, 1) THEN 1 ELSE 0 END"
    return f"(jaro_similarity({a}, {b}) + 0.1 * ({same}) * (1 - jaro_similarity({a}, {b})))"


@query("C4_jaro_winkler", f"SELECT n_name, round({_jw('lower(n_name)', repr('united states'))}, 9) AS score FROM nation")
def jaro_winkler(s: SparkSession, d: str) -> DataFrame:
    n = t.table(s, d, "nation")
    return n.select("n_name", F.round(T.jaro_winkler(F.lower("n_name"), F.lit("united states")), 9).alias("score"))


@query("C5_token_sort_ratio")
def token_sort(s: SparkSession, d: str) -> DataFrame:
    return t.table(s, d, "part").select("p_partkey", T.token_sort_ratio("p_name", "p_type").alias("score"))


@query("C6_token_overlap", "SELECT p_partkey, len(list_intersect(string_split(lower(p_name), ' '), string_split(lower(p_type), ' ')))::INTEGER AS n FROM part")
def token_overlap(s: SparkSession, d: str) -> DataFrame:
    return t.table(s, d, "part").select("p_partkey", T.token_overlap(c("p_name"), c("p_type"))[1].alias("n"))


def _nation_pairs(s: SparkSession, d: str) -> DataFrame:
    """Nations of one region, as pairs of names of several shapes: five a region."""
    n = t.table(s, d, "nation").select(c("n_regionkey").alias("r"), F.lower("n_name").alias("a"))
    return n.join(n.withColumnRenamed("a", "b"), "r").where("a < b")


PAIRS = "pairs AS (SELECT m.n_regionkey AS r, lower(m.n_name) AS a, lower(n.n_name) AS b FROM nation m JOIN nation n ON m.n_regionkey = n.n_regionkey AND lower(m.n_name) < lower(n.n_name))"
GENERIC = "[" + ", ".join(repr(x) for x in T.GENERIC_TOKENS) + "]"


def _sql_words(x: str) -> str:
    return f"list_filter(string_split(lower({x}), ' '), lambda z: z <> '')"


def _sql_distinctive(x: str, y: str) -> str:
    """SQL of distinctive_check."""
    dx, dy = (f"list_filter(list_distinct({_sql_words(z)}), lambda z: NOT list_contains({GENERIC}, z))" for z in (x, y))
    shared = f"len(list_intersect({dx}, {dy}))"
    return f"(CASE WHEN len({dx}) = 0 OR len({dy}) = 0 THEN true WHEN {shared} = 0 THEN false WHEN len({dx}) <> len({dy}) AND {shared} = least(len({dx}), len({dy})) THEN {_jw(f'lower({x})', f'lower({y})')} >= 0.97 ELSE true END)"


def _sql_guard(x: str, y: str) -> str:
    """SQL of person_guard."""
    wx, wy = _sql_words(x), _sql_words(y)
    return f"(CASE WHEN len({wx}) = 0 OR len({wy}) = 0 THEN false WHEN (len({wx}) >= 2) <> (len({wy}) >= 2) THEN false WHEN len({wx}) < 2 THEN true ELSE {_jw(f'{wx}[1]', f'{wy}[1]')} >= 0.85 AND {_jw(f'{wx}[-1]', f'{wy}[-1]')} >= 0.85 END)"


def _sql_policy(x: str, y: str, kind: str) -> str:
    """SQL of strict_policy; no name starts with a date."""
    wx, wy = _sql_words(x), _sql_words(y)
    longer, shorter = (f"CASE WHEN length({x}) {op} length({y}) THEN lower({x}) ELSE lower({y}) END" for op in (">=", "<"))
    single = f"({_jw(f'lower({x})', f'lower({y})')} >= 0.95 AND NOT (starts_with({longer}, {shorter}) AND abs(length({x}) - length({y})) >= 2))"
    n, short = f"len(list_intersect({wx}, {wy}))", f"least(len(list_distinct({wx})), len(list_distinct({wy})))"
    org = f"{kind} IN ('Organization', 'Project', 'Concept')"
    many = f"CASE WHEN {org} AND NOT {_sql_distinctive(x, y)} THEN false WHEN {org} THEN {n} / {short} >= 0.5 AND {n} >= 2 WHEN {kind} = 'Person' THEN {_sql_guard(x, y)} ELSE NOT (len({wx}) = 2 AND len({wy}) = 2) OR {_jw(f'{wx}[-1]', f'{wy}[-1]')} >= 0.75 END"
    return f"(CASE WHEN len({wx}) = 1 OR len({wy}) = 1 THEN {single} ELSE {many} END)"


#: Shapes of the two names of a pair, by region: as (prefix, suffix) and the kind of name.
SHAPES = [("university of ", " press", "institute ", " press", "Organization"), ("", "", "", "", "Location"), ("ana ", "", "anna ", "", "Person"), ("lab ", "", "lab ", " group north", "Project"), ("north ", "", "old ", "", "Location")]


def _shaped(s: SparkSession, d: str) -> DataFrame:
    pick = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in SHAPES]), c("r") + 1)
    p = _nation_pairs(s, d)
    return p.select(F.concat(pick(0), "a", pick(1)).alias("x"), F.concat(pick(2), F.when((c("r") == 0) & F.endswith("a", F.lit("0")), c("a")).otherwise(c("b")), pick(3)).alias("y"), pick(4).alias("kind"))


def _shaped_sql(ok: str) -> str:
    pick = lambda k: "([" + ", ".join(repr(x[k]) for x in SHAPES) + "])[r + 1]"
    return f"WITH {PAIRS}, shaped AS (SELECT concat({pick(0)}, a, {pick(1)}) AS x, concat({pick(2)}, CASE WHEN r = 0 AND ends_with(a, '0') THEN a ELSE b END, {pick(3)}) AS y, {pick(4)} AS kind FROM pairs) SELECT x, y, kind, {ok} AS ok FROM shaped"


@query("C7_distinctive_check", _shaped_sql(_sql_distinctive("x", "y")))
def distinctive_check(s: SparkSession, d: str) -> DataFrame:
    return _shaped(s, d).withColumn("ok", T.distinctive_check(c("x"), c("y")))


@query("C8_person_guard", _shaped_sql(_sql_guard("x", "y")))
def person_guard(s: SparkSession, d: str) -> DataFrame:
    return _shaped(s, d).withColumn("ok", T.person_guard(c("x"), c("y")))


@query("C9_strict_policy", _shaped_sql(_sql_policy("x", "y", "kind")))
def strict_policy(s: SparkSession, d: str) -> DataFrame:
    return _shaped(s, d).withColumn("ok", T.strict_policy(c("x"), c("y"), c("kind")))


@query("C10_semantic_guard", _shaped_sql(f"(CASE WHEN kind = 'Person' THEN {_sql_guard('x', 'y')} ELSE true END) AND (CASE WHEN len({_sql_words('x')}) >= 2 AND len({_sql_words('y')}) >= 2 THEN {_sql_policy('x', 'y', 'kind')} ELSE true END) AND (CASE WHEN len({_sql_words('x')}) <= 2 OR length(x) < 12 THEN length(y) / 20.0 >= 0.95 ELSE length(y) / 20.0 >= 0.92 END)"))
def semantic_guard(s: SparkSession, d: str) -> DataFrame:
    """The similarity is made up from the second name's length, so that both margins matter."""
    p = _shaped(s, d)
    return p.withColumn("ok", T.semantic_guard(c("x"), c("y"), c("kind"), F.length("y") / 20.0, F.lit(0.92), T.strict_policy(c("x"), c("y"), c("kind"))))


@query("C11_phonetic")
def phonetic(s: SparkSession, d: str) -> DataFrame:
    return t.table(s, d, "part").select("p_partkey", "p_name", T.phonetic(c("p_name")).alias("code"))


@query("C12_leading_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def leading_date(s: SparkSession, d: str) -> DataFrame:
    return t.table(s, d, "orders").select("o_orderkey", T.leading_date(F.concat(F.date_format("o_orderdate", "yyyy MM dd"), F.lit(" sync"))).alias("day"))


@query("C13_query_variants", with_("entities", "SELECT uri, concat(lower(entity_text), ' token|', lower(entity_text)) AS variants FROM entities WHERE entity_type = 'Organization'"))
def query_variants(s: SparkSession, d: str) -> DataFrame:
    return t.entities(s, d).where("entity_type = 'Organization'").select("uri", F.array_join(T.query_variants(F.concat(F.lit("The $"), "entity_text", F.lit(" token"))), "|").alias("variants"))


@query("C14_ngram_patterns", """WITH w AS (SELECT p_partkey, list_filter(string_split(regexp_replace(lower(concat(p_name, ' ', p_type)), '[^a-z0-9_ ]', ' ', 'g'), ' '), lambda x: length(x) >= 3) AS ws FROM part)
    SELECT p_partkey, array_to_string(list_concat(ws, list_concat(list_transform(range(1, len(ws)), lambda i: array_to_string(ws[i:i + 1], ' ')), list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')))), '|') AS patterns FROM w""")
def ngram_patterns(s: SparkSession, d: str) -> DataFrame:
    return t.table(s, d, "part").select("p_partkey", F.array_join(T.ngram_patterns(F.concat_ws(" ", "p_name", "p_type")), "|").alias("patterns"))


@query("C15_alias_expansion", "SELECT n_name, coalesce(canonical, n_name) AS canonical FROM nation LEFT JOIN (VALUES ('UNITED STATES', 'USA'), ('UNITED KINGDOM', 'UK')) v(a, canonical) ON a = n_name")
def alias_expansion(s: SparkSession, d: str) -> DataFrame:
    names = s.createDataFrame([("UNITED STATES", "USA"), ("UNITED KINGDOM", "UK")], "a string, canon string")
    return t.table(s, d, "nation").join(F.broadcast(names), c("n_name") == c("a"), "left").select("n_name", F.coalesce("canon", "n_name").alias("canonical"))


@query("C16_deterministic_uri", with_("entities", "SELECT uri, concat('urn:location:', regexp_replace(normalized_text, '[^a-z0-9]+', '-', 'g'), '-', substr(sha256(concat('location|', replace(normalized_text, '_', ' '))), 1, 12)) AS urn FROM entities WHERE entity_type = 'Location'"))
def deterministic_uri(s: SparkSession, d: str) -> DataFrame:
    return t.entities(s, d).where("entity_type = 'Location'").select("uri", T.deterministic_uri(c("entity_text"), c("entity_type")).alias("urn"))


@query("C17_base_rid", with_("docs", "SELECT rid, rid AS base FROM docs"))
def base_rid(s: SparkSession, d: str) -> DataFrame:
    return t.documents(s, d).select("rid", T.base_rid(F.concat("rid", F.lit("#chunk12"))).alias("base"))


@query("C18_rid_type", with_("entities", "SELECT uri, CASE WHEN entity_type = 'Location' THEN NULL WHEN occurrence_count % 2 = 0 THEN entity_type ELSE concat(entity_type, 'CardFile') END AS kind FROM entities"))
def rid_type(s: SparkSession, d: str) -> DataFrame:
    """Plain and dotted namespaces, with parts to be capitalised, and identifiers without a namespace."""
    kind, key = F.lower("entity_type"), F.substring_index("uri", ":", -1)
    rid = F.when(c("entity_type") == "Location", F.concat(F.lit("no namespace "), key)).when(c("occurrence_count") % 2 == 0, F.concat(kind, F.lit(":"), key)).otherwise(F.concat(F.lit("orn:some.space."), kind, F.lit("-card_file:"), key))
    return t.entities(s, d).select("uri", T.rid_type(rid).alias("kind"))


@query("C19_canonical_predicate", with_("edges", "SELECT DISTINCT predicate, CASE predicate WHEN 'bought' THEN 'purchased' WHEN 'located_in' THEN 'located_in' ELSE 'related_to' END AS canonical FROM edges"))
def canonical_predicate(s: SparkSession, d: str) -> DataFrame:
    p = t.edges(s, d).select("predicate").distinct()
    return p.select("predicate", T.canonical_predicate(F.upper(F.replace("predicate", F.lit("_"), F.lit(" "))), {"bought": "purchased"}, ["purchased", "located_in"]).alias("canonical"))


@query("C20_or_terms", "SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+'))), '|') AS terms FROM part")
def or_terms(s: SparkSession, d: str) -> DataFrame:
    return t.table(s, d, "part").select("p_partkey", F.array_join(F.sort_array(T.or_terms(c("p_name"))), "|").alias("terms"))


@query("C21_wiki_markup", "SELECT n_nationkey, concat('See ', n_name, ' and more') AS plain, concat(upper(substr(lower(n_name), 1, 1)), replace(substr(lower(n_name), 2), '_', ' ')) AS link FROM nation")
def wiki_markup(s: SparkSession, d: str) -> DataFrame:
    page = F.concat(F.lit("See '''[["), F.lower("n_name"), F.lit("|"), "n_name", F.lit("]]''' {{note}}and<ref>x</ref> more"))
    return t.table(s, d, "nation").select("n_nationkey", T.strip_wiki_markup(page).alias("plain"), F.get(T.wiki_links(page), F.lit(0)).alias("link"))


@query("C22_canonical_url", "SELECT page_id, regexp_replace(url, '#.*$', '') AS url FROM pages")
def canonical_url(s: SparkSession, d: str) -> DataFrame:
    return t.table(s, d, "pages").select("page_id", T.canonical_url(c("url")).alias("url"))


@query("C23_source_url", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN concat('https://x.org/', page_id) WHEN 2 THEN concat('https://arxiv.org/abs/2401.', lpad((page_id % 100000)::VARCHAR, 5, '0')) END AS url FROM pages")
def source_url(s: SparkSession, d: str) -> DataFrame:
    """A page's own URL, one that its identifier spells out, an archive's number, or nothing."""
    key, kind = c("page_id").cast("string"), c("page_id") % 4
    rid = F.when(kind == 1, F.concat(F.lit("web:https://x.org/"), key)).when(kind == 2, F.concat(F.lit("paper:arxiv:2401."), F.lpad((c("page_id") % 100000).cast("string"), 5, "0"))).otherwise(F.concat(F.lit("note:"), key))
    return t.table(s, d, "pages").select("page_id", T.source_url(rid, F.when(kind == 0, c("url")).otherwise(F.lit("urn:none"))).alias("url"))


@query("C24_slug", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def slug(s: SparkSession, d: str) -> DataFrame:
    return t.table(s, d, "part").select("p_partkey", T.slug(c("p_name")).alias("slug"))


@query("D1_url_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, 0.75::DOUBLE AS sure FROM orders")
def url_date(s: SparkSession, d: str) -> DataFrame:
    day, sure = T.url_date(F.concat(F.lit("https://x.org/"), F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit("/post")))
    return t.table(s, d, "orders").select("o_orderkey", day.cast("string").alias("day"), sure.alias("sure"))


@query("D2_hours_old", "SELECT event_id, round((epoch(TIMESTAMP '2025-01-01') - epoch(ts)) / 3600, 4) AS hours FROM events")
def hours_old(s: SparkSession, d: str) -> DataFrame:
    now = F.unix_micros(F.lit("2025-01-01").cast("timestamp"))
    return t.table(s, d, "events").select("event_id", F.round((now - F.unix_micros(c("ts").cast("timestamp"))) / 3.6e9, 4).alias("hours"))


@query("H1_hashes", "SELECT doc_id, sha256(text) AS sha, md5(text) AS md5 FROM documents")
def hashes(s: SparkSession, d: str) -> DataFrame:
    return t.table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md5"))


@query("H2_canonical_json")
def canonical_json(s: SparkSession, d: str) -> DataFrame:
    return t.table(s, d, "events").select("event_id", T.canonical_json_hash("props").alias("digest"))


@query("V1_cosine", with_("vecs", "SELECT vec_id, round(list_cosine_similarity(embedding, (SELECT embedding FROM vecs WHERE vec_id = 0)), 6) AS similarity FROM vecs"))
def cosine(s: SparkSession, d: str) -> DataFrame:
    v = t.vectors(s, d)
    q = v.where("vec_id = 0").select(c("embedding").alias("q"))
    return v.join(F.broadcast(q)).select("vec_id", F.round(V.cosine(c("embedding"), c("q")), 6).alias("similarity"))


@query("V2_cosine_distance", with_("vecs", "SELECT vec_id, round(1 - list_cosine_similarity(embedding, (SELECT embedding FROM vecs WHERE vec_id = 1)), 6) AS distance FROM vecs"))
def cosine_distance(s: SparkSession, d: str) -> DataFrame:
    v = t.vectors(s, d)
    q = v.where("vec_id = 1").select(c("embedding").alias("q"))
    return v.join(F.broadcast(q)).select("vec_id", F.round(1 - V.cosine(c("embedding"), c("q")), 6).alias("distance"))


@query("V3_log_scaled", "SELECT event_id, round(least(ln(1 + value) / ln(1 + (SELECT max(value) FROM events)) * CASE WHEN event_type = 'purchase' THEN 1.2 ELSE 1.0 END, 1.0), 6) AS scaled FROM events WHERE value >= 0")
def log_scaled(s: SparkSession, d: str) -> DataFrame:
    e = t.table(s, d, "events").where("value >= 0")
    return fts.log_scaled(e, "value", phrase=c("event_type") == "purchase").select("event_id", F.round("scaled", 6).alias("scaled"))


@query("V4_variance", "SELECT event_type, round(least(var_pop(value), 1.0), 6) AS variance FROM events GROUP BY 1")
def variance(s: SparkSession, d: str) -> DataFrame:
    return t.table(s, d, "events").groupBy("event_type").agg(F.round(F.least(F.var_pop("value"), F.lit(1.0)), 6).alias("variance"))


@query("V5_centroids", with_("vecs", "SELECT label, pos::INTEGER AS pos, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS pos FROM vecs) GROUP BY 1, 2"))
def centroids(s: SparkSession, d: str) -> DataFrame:
    return V.centroids(t.vectors(s, d), "label").select("label", F.posexplode("centroid").alias("pos", "v")).select("label", "pos", F.round("v", 6).alias("x"))


@query("V6_style", """SELECT doc_id, round(CASE WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 0 THEN length(regexp_replace(text, '[^A-Z]', '', 'g')) / length(regexp_replace(text, '[^A-Za-z]', '', 'g')) ELSE 0 END, 6) AS shouting FROM documents""")
def style(s: SparkSession, d: str) -> DataFrame:
    from sparkloom.operators.quality import style as measures

    return t.table(s, d, "documents").select("doc_id", F.round(measures(c("text"))["shouting"], 6).alias("shouting"))


# ---- full text --------------------------------------------------------------------------------------------------

TOKENS = "tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ts FROM documents), p AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS t FROM tok) GROUP BY 1, 2)"


def _docs(s: SparkSession, d: str) -> DataFrame:
    return t.table(s, d, "documents").select("doc_id", "text")


@query("FT1_postings", f"WITH {TOKENS} SELECT t AS term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p WHERE t NOT IN ({', '.join(repr(w) for w in fts.STOP)}) GROUP BY 1")
def postings(s: SparkSession, d: str) -> DataFrame:
    return fts.build_index(_docs(s, d), "doc_id", c("text")).postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query("FT2_and", f"WITH {TOKENS} SELECT doc_id, sum(tf)::BIGINT AS score FROM p WHERE t IN ('thing', 'ered') GROUP BY 1 HAVING count(*) = 2")
def match_and(s: SparkSession, d: str) -> DataFrame:
    return fts.match_all(fts.scan(_docs(s, d), "doc_id", c("text"), TERMS), TERMS)


@query("FT3_prefix", f"WITH {TOKENS} SELECT doc_id, sum(tf)::BIGINT AS score FROM p WHERE (t LIKE 'thing%' OR t LIKE 'ered%') AND t NOT IN ({', '.join(repr(w) for w in fts.STOP)}) GROUP BY 1 HAVING max(t LIKE 'thing%') AND max(t LIKE 'ered%')")
def match_prefix(s: SparkSession, d: str) -> DataFrame:
    return fts.match_prefixes(fts.scan(_docs(s, d), "doc_id", c("text"), TERMS, prefixes=True), TERMS)


@query("FT4_or", f"WITH {TOKENS} SELECT doc_id, sum(tf)::BIGINT AS score FROM p WHERE t IN ('thing', 'ered') GROUP BY 1")
def match_or(s: SparkSession, d: str) -> DataFrame:
    return fts.match_any(fts.scan(_docs(s, d), "doc_id", c("text"), TERMS), TERMS)


@query("FT5_cover_density", """WITH o AS (SELECT doc_id, unnest(ts) AS t, unnest(range(len(ts))) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ts FROM documents)),
    l AS (SELECT doc_id, pos, max(CASE WHEN t = 'ered' THEN pos END) OVER w AS a, max(CASE WHEN t = 'thing' THEN pos END) OVER w AS b FROM o WHERE t IN ('thing', 'ered') WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
    SELECT doc_id, round(sum(1.0::DOUBLE / (e - f + 1)), 9) AS score FROM (SELECT doc_id, least(a, b) AS f, min(pos) AS e FROM l WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")
def cover_density(s: SparkSession, d: str) -> DataFrame:
    return fts.cover_density(fts.scan(_docs(s, d), "doc_id", c("text"), TERMS), TERMS).select("doc_id", F.round("score", 9).alias("score"))


@query("FT5_bm25", f"""WITH {TOKENS}, st AS (SELECT count(*) AS n, avg(len(ts)) AS m FROM tok), df AS (SELECT t, count(*) AS df FROM p WHERE t IN ('thing', 'ered') GROUP BY 1)
    SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ts) / m))), 6) AS score FROM p JOIN df USING (t) JOIN tok USING (doc_id) CROSS JOIN st GROUP BY 1""")
def bm25(s: SparkSession, d: str) -> DataFrame:
    docs = _docs(s, d)
    return fts.bm25(fts.scan(docs, "doc_id", c("text"), TERMS), TERMS, fts.statistics(docs, c("text"))).select("doc_id", F.round("score", 6).alias("score"))


@query("FT6_frequency_rank", f"WITH {TOKENS} SELECT doc_id, round(ln(1 + sum(tf)), 6) AS score FROM p WHERE t = 'thing' GROUP BY 1")
def frequency_rank(s: SparkSession, d: str) -> DataFrame:
    return fts.match_any(fts.scan(_docs(s, d), "doc_id", c("text"), ["thing"]), ["thing"]).select("doc_id", F.round(F.log1p("score"), 6).alias("score"))


@query("FT7_strict_relaxed", f"""WITH {TOKENS}, hit AS (SELECT doc_id, sum(tf) FILTER (WHERE t IN ('thing', 'ered'))::BIGINT AS score, count(*) FILTER (WHERE t IN ('thing', 'ered')) AS n, max(starts_with(t, 'thing')) AND max(starts_with(t, 'ered')) AS each_one
    FROM p WHERE (starts_with(t, 'thing') OR starts_with(t, 'ered')) AND t NOT IN ({', '.join(repr(w) for w in fts.STOP)}) GROUP BY 1), m AS (SELECT doc_id, score, CASE WHEN n = 2 THEN 'strict' ELSE 'relaxed' END AS match_type FROM hit WHERE n = 2 OR (n > 0 AND each_one))
    SELECT * FROM (SELECT doc_id, score, match_type, row_number() OVER (ORDER BY match_type DESC, score DESC, doc_id) AS rank FROM m) WHERE rank <= 50""")
def strict_relaxed(s: SparkSession, d: str) -> DataFrame:
    return fts.strict_and_relaxed(fts.scan(_docs(s, d), "doc_id", c("text"), TERMS, prefixes=True), TERMS, 50)


@query("FT8_ilike_fallback", "SELECT doc_id, 0.5::DOUBLE AS score FROM documents WHERE contains(lower(text), 'thing the') ORDER BY doc_id LIMIT 20")
def ilike_fallback(s: SparkSession, d: str) -> DataFrame:
    return fts.ilike_fallback(_docs(s, d), "doc_id", c("text"), "Thing the", 20)


@query("FT9_discourse_search", f"WITH {TOKENS} SELECT doc_id, lang, source FROM (SELECT doc_id FROM p WHERE t IN ('thing', 'ered') GROUP BY 1 HAVING count(*) = 2) JOIN documents USING (doc_id) WHERE lang = 'en'")
def discourse_search(s: SparkSession, d: str) -> DataFrame:
    return fts.match_all(fts.scan(_docs(s, d), "doc_id", c("text"), TERMS), TERMS).join(t.table(s, d, "documents").select("doc_id", "lang", "source"), "doc_id").where("lang = 'en'").select("doc_id", "lang", "source")


# ---- retrieval --------------------------------------------------------------------------------------------------

VECTOR_LEG = "v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY s DESC, vec_id) AS rank, s AS score FROM (SELECT vec_id, list_cosine_similarity(embedding, (SELECT embedding FROM vecs WHERE vec_id = 0)) AS s FROM vecs) QUALIFY rank <= 40)"
TEXT_LEG = "b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY s DESC, doc_id) AS rank, s AS score FROM (SELECT doc_id, sum(tf) AS s FROM p WHERE t IN ('thing', 'ered') GROUP BY 1 HAVING count(*) = 2) QUALIFY rank <= 40)"


def query_vector(s: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    """One stored vector, as a query."""
    return [float(x) for x in t.vectors(s, d).where(c("vec_id") == vec_id).first()["embedding"]]


def vector_leg(s: SparkSession, d: str, k: int = 40, vec_id: int = 0) -> DataFrame:
    return V.top_k(t.vectors(s, d), query_vector(s, d, vec_id), k).withColumnRenamed("vec_id", "id")


def text_leg(s: SparkSession, d: str, k: int = 40) -> DataFrame:
    found = fts.match_all(fts.scan(_docs(s, d), "doc_id", c("text"), TERMS), TERMS).withColumnRenamed("doc_id", "id")
    return windows.ranked(found, [c("score").desc(), c("id")], k)


@query("L1_vector_top_k", with_("vecs", f"SELECT id AS vec_id, rank, round(score, 6) AS score FROM ({'WITH ' + VECTOR_LEG + ' SELECT * FROM v'})"))
def top_k(s: SparkSession, d: str) -> DataFrame:
    return vector_leg(s, d).select(c("id").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


@query("L2_batch_top_k", with_("vecs", """SELECT query_id, id, rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(v.embedding, q.embedding), 9) DESC, v.vec_id) AS rank FROM vecs v JOIN vecs q ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0) WHERE rank <= 10"""))
def batch_top_k(s: SparkSession, d: str) -> DataFrame:
    """Every fiftieth vector as a query, against all vectors but itself."""
    v = t.vectors(s, d)
    near = V.batch_top_k(v, v.where("vec_id % 50 = 0").select("vec_id", "embedding"), 11).where("query_id != id")
    return windows.top_k_per(near, ["query_id"], [F.round("score", 9).desc(), c("id")], 10, "rank").select("query_id", "id", "rank")


@query("L2_indexed_top_k")
def indexed_top_k(s: SparkSession, d: str) -> DataFrame:
    """The same through an inverted file: every vector in a cell, half of the cells looked at for a query."""
    v = t.vectors(s, d)
    centres = V.fit_cells(v)
    index = cut(V.build_index(v, centres), "index")
    near = V.search_index(index, v.where("vec_id % 50 = 0").select("vec_id", "embedding"), centres, 11, -(-len(centres) // 2)).where("query_id != id")
    return windows.top_k_per(near, ["query_id"], [F.round("score", 9).desc(), c("id")], 10, "rank").select("query_id", "id", "rank")


@query("L3_overfetch_dedup", with_("vecs", f"SELECT label, arg_max(id, struct_pack(s := score, i := -id)) AS id FROM (WITH {VECTOR_LEG} SELECT * FROM v) JOIN vecs ON vec_id = id GROUP BY 1"))
def overfetch(s: SparkSession, d: str) -> DataFrame:
    leg = vector_leg(s, d).join(t.vectors(s, d).select(c("vec_id").alias("id"), "label"), "id")
    return windows.first_per(leg, ["label"], [c("score").desc(), c("id")]).select("label", "id")


@query("L4_threshold", with_("vecs", f"SELECT * FROM (WITH {VECTOR_LEG} SELECT id FROM v WHERE rank <= 10 AND score > 0.1 AND id <> 0 ORDER BY rank LIMIT 1)"))
def threshold(s: SparkSession, d: str) -> DataFrame:
    best = V.top_k(t.vectors(s, d), query_vector(s, d), 10, min_sim=0.1)
    return best.where("vec_id != 0").orderBy("rank").limit(1).select(c("vec_id").alias("id"))


@query("J6_full_outer_rank", with_("vecs", f"SELECT * FROM (WITH {TOKENS}, {VECTOR_LEG}, {TEXT_LEG} SELECT id, v.rank AS a_rank, b.rank AS b_rank, round(coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 8) AS score FROM v FULL OUTER JOIN b USING (id))"))
def full_outer_rank(s: SparkSession, d: str) -> DataFrame:
    return fusion.fuse_outer(vector_leg(s, d), text_leg(s, d)).withColumn("score", F.round("score", 8))


@query("R2_hybrid_search", with_("vecs", f"SELECT * FROM (WITH {TOKENS}, {VECTOR_LEG}, {TEXT_LEG} SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM (SELECT * FROM v UNION ALL SELECT * FROM b) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)"))
def hybrid(s: SparkSession, d: str) -> DataFrame:
    """Vector and text legs fused by reciprocal ranks; documents and vectors share identifiers in these tables."""
    both = fusion.fuse_rrf({"vector": vector_leg(s, d), "text": text_leg(s, d)}).select("id", F.round("score", 8).alias("score"))
    return both.orderBy(c("score").desc(), "id").limit(20)


@query("R1_entity_lookup", with_("entities", "SELECT uri FROM entities WHERE entity_type <> 'Product' AND NOT node_private AND contains(normalized_text, 'nation_1') ORDER BY occurrence_count DESC, uri LIMIT 25"))
def entity_lookup(s: SparkSession, d: str) -> DataFrame:
    e = t.entities(s, d).where((c("entity_type") != "Product") & ~c("node_private") & F.contains("normalized_text", F.lit("nation_1")))
    return e.orderBy(c("occurrence_count").desc(), "uri").limit(25).select("uri")


@query("R3_rrf_legs", with_("vecs", f"SELECT * FROM (WITH {TOKENS}, {VECTOR_LEG}, {TEXT_LEG} SELECT id, min(rank) FILTER (WHERE leg = 'v') AS vector_rank, min(rank) FILTER (WHERE leg = 'b') AS text_rank FROM (SELECT *, 'v' AS leg FROM v UNION ALL SELECT *, 'b' FROM b) GROUP BY 1)"))
def rrf_legs(s: SparkSession, d: str) -> DataFrame:
    return fusion.fuse_rrf({"vector": vector_leg(s, d), "text": text_leg(s, d)}).select("id", "vector_rank", "text_rank")


@query("R4_weighted_fusion", with_("vecs", f"SELECT * FROM (WITH {TOKENS}, {VECTOR_LEG}, {TEXT_LEG} SELECT concat('document:', id) AS base_rid, round(0.6 * coalesce(v.score, 0) + 0.2 * coalesce(b.score / 100, 0), 6) AS score FROM v FULL OUTER JOIN b USING (id))"))
def weighted(s: SparkSession, d: str) -> DataFrame:
    rid = F.concat(F.lit("document:"), c("id").cast("string"), F.lit("#chunk1"))
    v = vector_leg(s, d).select(rid.alias("rid"), "score", c("rank").alias("ord"))
    k = text_leg(s, d).select(rid.alias("rid"), (c("score") / 100).alias("score"), c("rank").alias("ord"))
    return fusion.fuse_weighted(v, v.limit(0), k).select("base_rid", F.round("score", 6).alias("score"))


@query("R5_session_hybrid", with_("vecs", """SELECT conv_id, round(1.0::DOUBLE / (60 + rank), 8) AS score FROM (SELECT conv_id, row_number() OVER (ORDER BY n DESC, conv_id) AS rank FROM (SELECT conv_id, sum(len(regexp_extract_all(lower(text), '\\bthe\\b'))) AS n FROM conversations GROUP BY 1 HAVING n > 0)) WHERE rank <= 20"""))
def session_hybrid(s: SparkSession, d: str) -> DataFrame:
    turns = t.table(s, d, "conversations")
    n = F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"\bthe\b"), F.lit(0)))
    found = turns.groupBy("conv_id").agg(F.sum(n).alias("score")).where("score > 0").withColumnRenamed("conv_id", "id")
    return fusion.fuse_rrf({"text": windows.ranked(found, [c("score").desc(), c("id")], 20)}).select(c("id").alias("conv_id"), F.round("score", 8).alias("score"))


@query("R6_unified_search", with_("vecs", f"SELECT * FROM (WITH {TOKENS}, {VECTOR_LEG}, {TEXT_LEG} SELECT id, 'fact' AS surface, round(1.0::DOUBLE / (60 + rank), 8) AS score FROM v UNION ALL SELECT id, 'document', round(1.0::DOUBLE / (60 + rank + 20), 8) FROM b)"))
def unified(s: SparkSession, d: str) -> DataFrame:
    zero = lambda df: df.withColumn("rank", c("rank") - 1)
    out = fusion.concat_surfaces({"fact": zero(vector_leg(s, d)), "document": zero(text_leg(s, d))}, offsets={"document": 20})
    return out.withColumn("score", F.round("score", 8))


@query("R7_mmr")
def mmr(s: SparkSession, d: str) -> DataFrame:
    leg = vector_leg(s, d).join(t.vectors(s, d).select(c("vec_id").alias("id"), "embedding"), "id").withColumn("q", F.lit(0))
    return V.mmr(leg.select("q", "id", "score", "embedding"), "q", 10)


@query("R8_rerank", f"WITH {TOKENS} SELECT doc_id, len(list_intersect(ts, ['thing', 'ered', 'the'])) / 3.0::DOUBLE AS relevance FROM tok WHERE len(list_intersect(ts, ['thing', 'ered', 'the'])) > 0")
def rerank(s: SparkSession, d: str) -> DataFrame:
    """The default reranker: the share of the query's terms in a text."""
    want = F.array(*[F.lit(x) for x in ("thing", "ered", "the")])
    return _docs(s, d).select("doc_id", (F.size(F.array_intersect(want, T.terms(c("text")))) / 3.0).alias("relevance")).where("relevance > 0")


@query("R9_multi_query", with_("vecs", f"SELECT * FROM (WITH {TOKENS}, {TEXT_LEG}, b2 AS (SELECT doc_id AS id, row_number() OVER (ORDER BY s DESC, doc_id) AS rank FROM (SELECT doc_id, sum(tf) AS s FROM p WHERE t IN ('thing') GROUP BY 1) QUALIFY rank <= 40) SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM (SELECT id, rank FROM b UNION ALL SELECT id, rank FROM b2) GROUP BY 1)"))
def multi_query(s: SparkSession, d: str) -> DataFrame:
    """Variants of a query are legs whose contributions add up."""
    one = windows.ranked(fts.match_all(fts.scan(_docs(s, d), "doc_id", c("text"), ["thing"]), ["thing"]).withColumnRenamed("doc_id", "id"), [c("score").desc(), c("id")], 40)
    return fusion.fuse_rrf({"q1": text_leg(s, d), "q2": one}).select("id", F.round("score", 8).alias("score"))


@query("R10_page_expansion", """WITH hit AS (SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'shing')), page AS (SELECT conv_id FROM hit GROUP BY 1 HAVING count(*) >= 2 ORDER BY count(*) DESC, conv_id LIMIT 2)
    SELECT conv_id, turn FROM (SELECT c.conv_id, c.turn, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) AS rn FROM conversations c JOIN page USING (conv_id) WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.conv_id = c.conv_id AND h.turn = c.turn)) WHERE rn <= 3""")
def page_expansion(s: SparkSession, d: str) -> DataFrame:
    turns = t.table(s, d, "conversations")
    hit = turns.where(F.contains(F.lower("text"), F.lit("shing"))).select("conv_id", "turn")
    page = hit.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").orderBy(c("n").desc(), "conv_id").limit(2).select("conv_id")
    near = turns.select("conv_id", "turn").join(F.broadcast(page), "conv_id").join(hit, ["conv_id", "turn"], "left_anti")
    return windows.top_k_per(near, ["conv_id"], ["turn"], 3).select("conv_id", "turn")


@query("R11_confidence", with_("vecs", f"""SELECT * FROM (WITH {VECTOR_LEG} SELECT round(greatest(0, least(1, 0.35 * max(score) FILTER (WHERE rank = 1) + 0.2 * (max(score) FILTER (WHERE rank = 1) - max(score) FILTER (WHERE rank = 2))
    + 0.15 * least(count(*) / 10, 1) + 0.2 * avg(score) FILTER (WHERE rank <= 5) + 0.1 * (1 - least(1, var_pop(score) FILTER (WHERE rank <= 10))))), 6) AS confidence FROM v)"""))
def confidence(s: SparkSession, d: str) -> DataFrame:
    return fusion.confidence(vector_leg(s, d).withColumn("q", F.lit(0)), "q", c("score")).select(F.round("confidence", 6).alias("confidence"))


@query("R12_gate", """SELECT user_id, CASE WHEN texts = 0 OR (top < 0.01 AND texts < 2) THEN 'very_low' WHEN top < 0.02 OR texts < 2 OR (entities = 0 AND top < 0.024) THEN 'low' ELSE 'confident' END AS decision
    FROM (SELECT user_id, round(coalesce(max(value / 1000) FILTER (WHERE event_type = 'view'), 0), 4) AS top, count(*) FILTER (WHERE event_type = 'view') AS texts, count(*) FILTER (WHERE event_type = 'click') AS entities FROM events GROUP BY 1)""")
def gate(s: SparkSession, d: str) -> DataFrame:
    op = F.when(c("event_type") == "view", "text_search").when(c("event_type") == "click", "entity_lookup").otherwise("other")
    e = t.table(s, d, "events").select("user_id", op.alias("retrieval_op"), (c("value") / 1000).alias("confidence"))
    return fusion.gate(e, "user_id").select("user_id", "decision")


@query("R13_idds")
def idds(s: SparkSession, d: str) -> DataFrame:
    leg = vector_leg(s, d).join(t.vectors(s, d).select(c("vec_id").alias("id"), "embedding"), "id").withColumn("q", F.lit(0))
    return V.idds(leg.select("q", "id", "score", "embedding"), "q", 5)


@query("R14_low_confidence", with_("docs", "SELECT rid FROM docs WHERE confidence < 0.7"))
def low_confidence(s: SparkSession, d: str) -> DataFrame:
    return t.documents(s, d).where("confidence < 0.7").select("rid")


def _variants(s: SparkSession, d: str) -> DataFrame:
    deg = graph.degrees(t.edges(s, d))
    return t.entities(s, d).join(deg, c("uri") == c("node"), "left").select("uri", F.substring("normalized_text", 1, 1).alias("label"), "entity_type", "occurrence_count", F.coalesce("degree", F.lit(0)).alias("relationship_count"))


POLY = """(SELECT uri, substr(normalized_text, 1, 1) AS label, entity_type, occurrence_count * 1000 + coalesce(n, 0) * 100 + CASE entity_type WHEN 'Person' THEN 10 WHEN 'Organization' THEN 9 WHEN 'Location' THEN 7 WHEN 'Product' THEN 6 ELSE 0 END * 10
    + CASE WHEN entity_type = 'Product' THEN 50000 ELSE 0 END AS score FROM entities LEFT JOIN (SELECT node, count(*) AS n FROM (SELECT subject AS node FROM edges UNION ALL SELECT object FROM edges) GROUP BY 1) ON node = uri)"""


@query("R15_polysemy", with_("entities edges", f"SELECT uri, score::DOUBLE AS score FROM {POLY}"))
def polysemy(s: SparkSession, d: str) -> DataFrame:
    return resolve.polysemy_scores(_variants(s, d), "product").select("uri", c("score").cast("double").alias("score"))


@query("R16_polysemy_rerank", with_("entities edges", f"SELECT label, max(score) * 1.15::DOUBLE AS score FROM {POLY} GROUP BY 1"))
def polysemy_rerank(s: SparkSession, d: str) -> DataFrame:
    return resolve.polysemy_scores(_variants(s, d), "product").groupBy("label").agg((F.max("score") * 1.15).alias("score"))


@query("R17_entity_resolve", with_("entities", "SELECT uri FROM (SELECT uri, CASE WHEN uri = 'nation:1' THEN 0 WHEN normalized_text = 'france' THEN 1 ELSE 2 END AS k, occurrence_count FROM entities WHERE uri = 'nation:1' OR normalized_text = 'france') ORDER BY k, occurrence_count DESC, uri LIMIT 1"))
def entity_resolve(s: SparkSession, d: str) -> DataFrame:
    k = F.when(c("uri") == "nation:1", 0).when(c("normalized_text") == "france", 1).otherwise(2)
    return t.entities(s, d).where("uri = 'nation:1' OR normalized_text = 'france'").orderBy(k, c("occurrence_count").desc(), "uri").limit(1).select("uri")


@query("R18_dominant_entity", with_("mentions", "SELECT uri, count(*) AS n FROM mentions WHERE mention_count >= 1 GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, uri LIMIT 1"))
def dominant(s: SparkSession, d: str) -> DataFrame:
    return t.mentions(s, d).groupBy("uri").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").orderBy(c("n").desc(), "uri").limit(1)


@query("R19_entity_documents", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey = 11) ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 20")
def entity_documents(s: SparkSession, d: str) -> DataFrame:
    hit = t.table(s, d, "lineitem").where("l_partkey = 11").select("l_orderkey")
    return t.table(s, d, "orders").join(hit, c("o_orderkey") == c("l_orderkey"), "left_semi").orderBy(c("o_orderdate").desc_nulls_last(), "o_orderkey").limit(20).select("o_orderkey", "o_orderdate")


@query("R20_entity_leg", with_("entities mentions", """SELECT rid, count(DISTINCT uri) AS entities FROM mentions JOIN entities USING (uri) WHERE contains(normalized_text, 'red') GROUP BY 1 ORDER BY entities DESC, rid LIMIT 50"""))
def entity_leg(s: SparkSession, d: str) -> DataFrame:
    hit = t.entities(s, d).where(F.contains("normalized_text", F.lit("red"))).select("uri")
    return t.mentions(s, d).join(hit, "uri").groupBy("rid").agg(F.countDistinct("uri").alias("entities")).orderBy(c("entities").desc(), "rid").limit(50)


@query("R21_graphrag", """WITH cust AS (SELECT c_custkey, c_nationkey, count(o_orderkey) AS deg FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2),
    seed AS (SELECT c_nationkey, count(*) AS hits FROM cust WHERE deg >= 12 GROUP BY 1 ORDER BY hits DESC, c_nationkey LIMIT 3), top AS (SELECT max(deg) AS m FROM cust)
    SELECT c_custkey, round(0.4 * least(deg / 20.0, 1) + 0.3 * deg / m + 0.3 * hits / (SELECT max(hits) FROM seed), 6) AS score FROM cust JOIN seed USING (c_nationkey) CROSS JOIN top""")
def graphrag(s: SparkSession, d: str) -> DataFrame:
    """Seeds vote for communities (nations), whose members are scored by relevance, centrality and overlap."""
    n = t.table(s, d, "customer").join(t.table(s, d, "orders"), c("c_custkey") == c("o_custkey"), "left").groupBy("c_custkey", "c_nationkey").agg(F.count("o_orderkey").alias("deg"))
    seeds = n.where("deg >= 12").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("hits")).orderBy(c("hits").desc(), "c_nationkey").limit(3)
    most = n.agg(F.max("deg").alias("m")).join(F.broadcast(seeds.agg(F.max("hits").alias("h"))))
    rows = n.join(F.broadcast(seeds), "c_nationkey").join(F.broadcast(most))
    return rows.select("c_custkey", F.round(0.4 * F.least(c("deg") / 20.0, F.lit(1.0)) + 0.3 * c("deg") / c("m") + 0.3 * c("hits") / c("h"), 6).alias("score"))


@query("R22_graph_context", with_("edges", "SELECT subject, predicate, object FROM edges WHERE confidence >= 0.5 AND occurrence_count >= 1 AND (subject = 'customer:1' OR object = 'nation:1') ORDER BY occurrence_count DESC, confidence DESC, subject, predicate, object LIMIT 30"))
def graph_context(s: SparkSession, d: str) -> DataFrame:
    e = t.edges(s, d).where("confidence >= 0.5 AND occurrence_count >= 1")
    both = e.where("subject = 'customer:1'").unionByName(e.where("object = 'nation:1'")).dropDuplicates(["subject", "predicate", "object"])
    return both.orderBy(c("occurrence_count").desc(), c("confidence").desc(), "subject", "predicate", "object").limit(30).select("subject", "predicate", "object")


@query("R23_query_class", "SELECT item_id, CASE WHEN regexp_matches(lower(text), '\\b(between|vs)\\b') THEN 'multi_entity' WHEN regexp_matches(lower(text), '^(what|who|how|why|when|where)\\b') OR ends_with(trim(text), '?') THEN 'question' ELSE 'entity' END AS kind FROM benchmark")
def query_class(s: SparkSession, d: str) -> DataFrame:
    low = F.lower("text")
    kind = F.when(low.rlike(r"\b(between|vs)\b"), "multi_entity").when(low.rlike(r"^(what|who|how|why|when|where)\b") | F.endswith(F.trim("text"), F.lit("?")), "question").otherwise("entity")
    return t.table(s, d, "benchmark").select("item_id", kind.alias("kind"))


@query("R24_semantic_classifier", with_("vecs", """SELECT vec_id, label AS predicted FROM (SELECT v.vec_id, k.label, row_number() OVER (PARTITION BY v.vec_id ORDER BY list_cosine_similarity(v.embedding, k.centroid) DESC, k.label) AS rn FROM vecs v,
    (SELECT label, list(x ORDER BY pos) AS centroid FROM (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS pos FROM vecs) GROUP BY 1, 2) GROUP BY 1) k) WHERE rn = 1"""))
def classifier(s: SparkSession, d: str) -> DataFrame:
    v = t.vectors(s, d)
    return V.nearest_centroid(v, V.centroids(v, "label"), "label").select("vec_id", "predicted")


TEMPLATES: dict[str, Callable[[DataFrame, str], DataFrame]] = {
    r"^what is related to (\S+)$": lambda e, x: e.where(c("subject") == x).select(c("object").alias("answer")).distinct(),
    r"^how many (\w+) edges$": lambda e, x: e.where(c("predicate") == x).agg(F.count(F.lit(1)).cast("string").alias("answer")),
}


def structured_query(edges: DataFrame, question: str) -> DataFrame | None:
    """The answer to a question that fits a template; None if none fits."""
    import re

    for pattern, plan in TEMPLATES.items():
        if m := re.match(pattern, question):
            return plan(edges, m[1])
    return None


@query("R25_structured_query", with_("edges", "SELECT count(*)::VARCHAR AS answer FROM edges WHERE predicate = 'located_in'"))
def structured(s: SparkSession, d: str) -> DataFrame:
    out = structured_query(t.edges(s, d), "how many located_in edges")
    assert out is not None
    return out


@query("R26_structured_sql", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '2-HIGH' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def structured_sql(s: SparkSession, d: str) -> DataFrame:
    return t.table(s, d, "orders").where("o_orderstatus = 'O' AND o_orderpriority = '2-HIGH'").orderBy(c("o_totalprice").desc(), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@dataclass(frozen=True)
class Step:
    """One retrieval step: an operation, its budget of rows and its parameters."""

    op: str
    budget: int
    params: tuple[tuple[str, object], ...] = ()

    def param(self, name: str, default: object) -> object:
        return dict(self.params).get(name, default)


#: Steps by kind of question, with budgets and parameters.
MATRIX: dict[str, tuple[Step, ...]] = {
    "entity_definition": (Step("entity_lookup", 5), Step("text_search", 20, (("top_k", 8),))),
    "relationship_path": (Step("entity_lookup", 3), Step("text_search", 20, (("multi_query", True), ("top_k", 8)))),
    "governance_policy": (Step("text_search", 20, (("multi_query", True), ("top_k", 12))), Step("entity_lookup", 8), Step("relationship_traverse", 30, (("max_hops", 1),))),
    "roadmap_status": (Step("entity_lookup", 5), Step("structured_sql", 15), Step("text_search", 15, (("top_k", 6),))),
    "commitment_claim": (Step("entity_lookup", 3), Step("text_search", 20, (("multi_query", True), ("top_k", 8)))),
    "out_of_domain": (),
}


def plan_steps(kind: str, depth: str = "standard") -> tuple[Step, ...]:
    """Steps of a retrieval plan by the kind of question; a shallow one only looks entities up, a deep one searches with
    variants of the query and has half as much budget again. An unknown kind has no steps: no answer is given."""
    steps = MATRIX.get(kind, ())
    if depth == "shallow":
        return tuple(x for x in steps if x.op == "entity_lookup")
    if depth == "deep":
        return tuple(replace(x, budget=math.ceil(x.budget * 1.5), params=(*x.params, ("multi_query", True)) if x.op == "text_search" else x.params) for x in steps)
    return steps


Evidence = Callable[[Step, list[str]], DataFrame]


def execute_plan(spark: SparkSession, steps: Sequence[Step], run: dict[str, Evidence], *, max_steps: int = 10, timeout_s: float = 600.0, clock: Callable[[], float] = time.monotonic) -> tuple[DataFrame, list[dict[str, object]]]:
    """(evidence, traces): step, retrieval_op, id, score of each step, at most its budget of rows; and for each step that ran its
    index, op, number of results and error.

    A plan halts before the step beyond max_steps or behind the time limit. A step that fails leaves an error in its trace and
    no evidence. Entities that look-ups find (as many as their budgets) are given to the steps behind.
    """
    evidence, traces, entities = spark.createDataFrame([], "step int, retrieval_op string, id string, score double"), [], []
    begun = clock()
    for k, step in enumerate(steps):
        if k >= max_steps or clock() - begun >= timeout_s:
            break
        n, error = 0, None
        try:
            if step.op not in run:
                raise ValueError(f"no way to run {step.op}")
            found = run[step.op](step, entities).orderBy(c("score").desc(), "id").limit(step.budget)
            found = cut(found.select(F.lit(k).alias("step"), F.lit(step.op).alias("retrieval_op"), c("id").cast("string").alias("id"), c("score").cast("double").alias("score")), "evidence")
            n = found.count()
            if step.op == "entity_lookup":
                entities = [*entities, *[r["id"] for r in found.select("id").orderBy("id").collect()]]  # the step's budget bounds them
            evidence = evidence.unionByName(found)
        except Exception as e:  # noqa: BLE001
            error = str(e).split("\n")[0]
        traces.append({"step": k, "op": step.op, "results": n, "error": error})
    return evidence, traces


def _evidence(s: SparkSession, d: str) -> dict[str, Evidence]:
    def traverse(step: Step, uris: list[str]) -> DataFrame:
        e = t.edges(s, d).where(c("subject").isin(uris) | c("object").isin(uris))
        return e.select(F.concat_ws(" ", "subject", "predicate", "object").alias("id"), c("confidence").alias("score"))

    def text(step: Step, uris: list[str]) -> DataFrame:
        legs = {"q": text_leg(s, d, int(step.param("top_k", 8)))}
        if step.param("multi_query", False):
            one = fts.match_all(fts.scan(_docs(s, d), "doc_id", c("text"), ["thing"]), ["thing"]).withColumnRenamed("doc_id", "id")
            legs["variant"] = windows.ranked(one, [c("score").desc(), c("id")], int(step.param("top_k", 8)))
        return fusion.fuse_rrf(legs).select(c("id").cast("string").alias("id"), F.round("score", 9).alias("score"))

    return {
        "entity_lookup": lambda step, uris: entity_lookup(s, d).select(c("uri").alias("id"), F.lit(1.0).alias("score")),
        "text_search": text,
        "relationship_traverse": traverse,
        "structured_sql": lambda step, uris: structured_sql(s, d).select(c("o_orderkey").cast("string").alias("id"), c("o_totalprice").alias("score")),
    }


PLAN_SQL = with_("entities edges", f"""SELECT * FROM (WITH {TOKENS}, b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY sum(tf) DESC, doc_id) AS rank FROM p WHERE t IN ('thing', 'ered') GROUP BY 1 HAVING count(*) = 2 QUALIFY rank <= 12),
    b2 AS (SELECT doc_id AS id, row_number() OVER (ORDER BY sum(tf) DESC, doc_id) AS rank FROM p WHERE t = 'thing' GROUP BY 1 QUALIFY rank <= 12),
    s0 AS (SELECT id::VARCHAR AS id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM b UNION ALL SELECT * FROM b2) GROUP BY id ORDER BY score DESC, id LIMIT 20),
    look AS (SELECT uri FROM entities WHERE entity_type <> 'Product' AND NOT node_private AND contains(normalized_text, 'nation_1') ORDER BY occurrence_count DESC, uri LIMIT 25),
    s1 AS (SELECT uri AS id, 1.0::DOUBLE AS score FROM look ORDER BY id LIMIT 8),
    s2 AS (SELECT concat(subject, ' ', predicate, ' ', object) AS id, confidence::DOUBLE AS score FROM edges WHERE subject IN (SELECT id FROM s1) OR object IN (SELECT id FROM s1) ORDER BY score DESC, id LIMIT 30)
    SELECT 0 AS step, 'text_search' AS retrieval_op, id, score FROM s0 UNION ALL SELECT 1, 'entity_lookup', id, score FROM s1 UNION ALL SELECT 2, 'relationship_traverse', id, score FROM s2)""")


@query("R27_plan", PLAN_SQL)
def plan(s: SparkSession, d: str) -> DataFrame:
    return execute_plan(s, plan_steps("governance_policy"), _evidence(s, d))[0]


@query("R27_traces", PLAN_SQL.replace("SELECT * FROM (WITH", "SELECT step, retrieval_op AS op, count(*) AS results FROM (WITH", 1) + " GROUP BY 1, 2")
def plan_traces(s: SparkSession, d: str) -> DataFrame:
    traces = execute_plan(s, plan_steps("governance_policy"), _evidence(s, d))[1]
    return s.createDataFrame([(x["step"], x["op"], x["results"]) for x in traces], "step int, op string, results long")


@query("R28_session_search", "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND text ILIKE '%the%' ORDER BY conv_id, turn LIMIT 40")
def session_search(s: SparkSession, d: str) -> DataFrame:
    return t.table(s, d, "conversations").where((c("role") == "user") & c("text").ilike("%the%")).orderBy("conv_id", "turn").limit(40).select("conv_id", "turn")


@query("R29_fact_search", with_("vecs", f"SELECT * FROM (WITH w AS (SELECT vec_id AS id, row_number() OVER (ORDER BY list_cosine_similarity(embedding, (SELECT embedding FROM vecs WHERE vec_id = 0)) DESC, vec_id) AS rank FROM vecs WHERE label <> 2) SELECT id, rank FROM w WHERE rank <= 15)"))
def fact_search(s: SparkSession, d: str) -> DataFrame:
    return V.top_k(t.vectors(s, d), query_vector(s, d), 15, where=c("label") != 2).select(c("vec_id").alias("id"), "rank")


@query("R30_digest_search", with_("docs vecs", "SELECT doc_id, rank FROM (SELECT doc_id, row_number() OVER (ORDER BY list_cosine_similarity(embedding, (SELECT embedding FROM vecs WHERE vec_id = 0)) DESC, doc_id) AS rank FROM docs JOIN vecs ON vec_id = doc_id WHERE published_at BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-16') WHERE rank <= 10"))
def digest_search(s: SparkSession, d: str) -> DataFrame:
    w = t.documents(s, d).where(c("published_at").between(F.lit("2024-01-02").cast("timestamp"), F.lit("2024-01-16").cast("timestamp"))).select("doc_id")
    v = t.vectors(s, d).join(w, c("vec_id") == c("doc_id"), "left_semi")
    return V.top_k(v, query_vector(s, d), 10).select(c("vec_id").alias("doc_id"), "rank")


@query("R31_contextual_candidates")
def contextual(s: SparkSession, d: str) -> DataFrame:
    """Parts beside one part in orders, scored by name, sound and shared orders."""
    m = t.mentions(s, d)
    near = m.where("uri = 'part:11'").select("rid").join(m, "rid").where("uri != 'part:11'").groupBy("uri").agg(F.countDistinct("rid").alias("docs"))
    named = near.join(t.entities(s, d).select("uri", "normalized_text"), "uri").withColumn("q", F.lit("red widget"))
    return named.select("uri", resolve.contextual_score(c("q"), c("normalized_text"), c("docs"))[0].alias("score"))


@query("R32_discourse_candidates", with_("vecs", f"SELECT * FROM (WITH {TOKENS}, {VECTOR_LEG}, {TEXT_LEG}, f AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT id, rank FROM v UNION ALL SELECT id, rank FROM b) GROUP BY 1), n AS (SELECT id, source, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS rn FROM f JOIN documents ON doc_id = id) SELECT id, source, round(score, 8) AS score FROM n WHERE rn <= 2 ORDER BY n.score DESC, id LIMIT 20)"))
def discourse_candidates(s: SparkSession, d: str) -> DataFrame:
    both = fusion.fuse_rrf({"semantic": vector_leg(s, d), "lexical": text_leg(s, d)})
    named = both.join(t.table(s, d, "documents").select(c("doc_id").alias("id"), "source"), "id")
    return windows.top_k_per(named, ["source"], [c("score").desc(), c("id")], 2).orderBy(c("score").desc(), "id").limit(20).select("id", "source", F.round("score", 8).alias("score"))


@query("J15_vector_pairs", with_("vecs", "SELECT a.vec_id AS a, b.vec_id AS b FROM vecs a JOIN vecs b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding, b.embedding) > 0.3"))
def vector_pairs(s: SparkSession, d: str) -> DataFrame:
    """Pairs above a similarity within a label, compared matrix by matrix: a block of vectors against all of its label."""
    import numpy as np
    import pandas as pd

    v = t.vectors(s, d)
    block = 512
    # As many tiles a side as keep one to some 4,096 vectors, whatever a label's size; labels are counted, a row each.
    n = v.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / 2048).cast("int").alias("n_tiles"))
    dealt = v.join(F.broadcast(n), "label").withColumn("own", F.pmod(F.xxhash64("vec_id"), c("n_tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), c("n_tiles") - 1))).drop("n_tiles")
    tiles = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        left, right = pdf[pdf["own"] == i].drop_duplicates("vec_id"), pdf[pdf["own"] == j].drop_duplicates("vec_id")
        out = []
        for at in range(0, len(left), block):
            x, y = (np.stack(z["embedding"].to_list()) if len(z) else np.zeros((0, 1)) for z in (left.iloc[at : at + block], right))
            if not len(x) or not len(y):
                continue
            x, y = (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300) for z in (x, y))
            r, k = np.nonzero(x @ y.T > 0.3)
            a, b = left["vec_id"].to_numpy()[at + r], right["vec_id"].to_numpy()[k]
            keep = a != b if i != j else a < b
            out.append(pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})

    return tiles.groupBy("label", "i", "j").applyInPandas(near, "a long, b long")
