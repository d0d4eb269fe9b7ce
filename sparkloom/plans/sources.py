"""Queries: readers and sinks over the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.resolve import live
from sparkloom.plans.registry import query
from sparkloom.session import shared_folder
from sparkloom.sources import readers, sinks
from sparkloom.sources import tables as t
from sparkloom.sources.tables import with_

c = F.col


@query("S6_feed", "SELECT p_partkey, concat('https://x.org/', p_partkey) AS link, p_name AS title FROM part")
def feed(s: SparkSession, d: str) -> DataFrame:
    xml = F.concat(F.lit("<rss><channel><item><title>"), "p_name", F.lit("</title><link>https://x.org/"), c("p_partkey").cast("string"), F.lit("</link><description>d</description><pubDate>p</pubDate></item></channel></rss>"))
    return readers.feed_items(t.table(s, d, "part").select("p_partkey", xml.alias("xml")), "xml", ("p_partkey",)).select("p_partkey", "link", "title")


@query("S7_code_files", "SELECT p_partkey, (['python', 'sql', 'go'])[p_partkey % 3 + 1] AS language FROM part")
def code(s: SparkSession, d: str) -> DataFrame:
    """Parts' keys as a tree of code files in three languages, read, hashed and cut into chunks: the keys found in these."""
    at = shared_folder(s, "sink")
    line = F.concat(F.lit("part_"), c("p_partkey").cast("string"), F.lit(" = "), c("p_size").cast("string"), F.lit(";"))
    for k, suffix in enumerate(("py", "sql", "go")):
        t.table(s, d, "part").where(c("p_partkey") % 3 == k).select(line.alias("value")).write.option("extension", suffix).option("quoteAll", "false").csv(f"{at}/{suffix}")
    chunks = readers.code_chunks(readers.code_files(s, at))
    keys = F.explode(F.transform(F.regexp_extract_all("chunk", F.lit(r"part_(\d+) = \d+;"), F.lit(1)), lambda x: x.cast("long")))
    return chunks.select(keys.alias("p_partkey"), "language").distinct()


@query("S8_wiki", "SELECT n_nationkey, concat('In ', r_name, '.') AS plain, NULL::VARCHAR AS redirect FROM nation JOIN region ON n_regionkey = r_regionkey")
def wiki(s: SparkSession, d: str) -> DataFrame:
    n = t.table(s, d, "nation").join(F.broadcast(t.table(s, d, "region")), c("n_regionkey") == c("r_regionkey"))
    markup = F.concat(F.lit("In [[region|"), "r_name", F.lit("]].{{stub}}<ref>x</ref>[[Category:Places]]"))
    return readers.wiki_pages(n, c("n_name"), markup, ("n_nationkey",)).select("n_nationkey", "plain", "redirect")


@query("S9_web_pages", "SELECT page_id, nullif(regexp_extract(html, '<title>(.*?)</title>', 1), '') AS title, regexp_extract(html, '<html[^>]*lang=\"([^\"]+)\"', 1) AS lang FROM pages")
def web(s: SparkSession, d: str) -> DataFrame:
    return readers.web_pages(t.table(s, d, "pages"), carry=("page_id",)).select("page_id", "title", "lang")


@query("S10_vault", "SELECT concat('n', n_nationkey) AS subject, 'part_of' AS predicate, lower(r_name) AS object FROM nation JOIN region ON n_regionkey = r_regionkey")
def vault(s: SparkSession, d: str) -> DataFrame:
    n = t.table(s, d, "nation").join(F.broadcast(t.table(s, d, "region")), c("n_regionkey") == c("r_regionkey"))
    note = F.concat(F.lit('---\ntype: place\nregion: "[[Places/'), "r_name", F.lit(']]"\n---\nBody with [[a link]].'))
    notes = readers.vault_notes(n.select(F.concat(F.lit("n"), c("n_nationkey").cast("string")).alias("id"), note.alias("text")), carry=("id",))
    return readers.field_edges(notes, "id", {"region": "part_of"})


@query("S11_metadata", "SELECT doc_id, source, quality FROM documents LEFT JOIN labels USING (doc_id)")
def metadata(s: SparkSession, d: str) -> DataFrame:
    return readers.with_metadata(t.table(s, d, "documents").select("doc_id", "source"), t.table(s, d, "labels").select("doc_id", "quality"), "doc_id")


@query("S12_csv", "SELECT p_partkey, concat(p_name, ', \"', p_type, '\"') AS name FROM part")
def csv(s: SparkSession, d: str) -> DataFrame:
    at = shared_folder(s, "sink")
    sinks.write_csv(t.table(s, d, "part").select("p_partkey", F.concat("p_name", F.lit(', "'), "p_type", F.lit('"')).alias("name")), at)
    return sinks.read_csv(s, at, "p_partkey long, name string")


@query("S13_jsonl", "SELECT vec_id, len(embedding)::INTEGER AS n, label FROM embeddings")
def jsonl(s: SparkSession, d: str) -> DataFrame:
    at = shared_folder(s, "sink")
    sinks.write_jsonl(t.table(s, d, "embeddings"), at)
    return sinks.read_jsonl(s, at, "vec_id long, embedding array<float>, label int").select("vec_id", F.size("embedding").alias("n"), "label")


@query("F1_live", with_("entities", "SELECT uri FROM entities WHERE entity_type <> 'Product'"))
def live_entities(s: SparkSession, d: str) -> DataFrame:
    """Parts are merged away, all others are live."""
    e = t.entities(s, d).withColumn("merged_into", F.when(c("entity_type") == "Product", "part:0"))
    return live(e).select("uri")
