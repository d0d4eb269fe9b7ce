"""Readers of landed sources: feeds, code trees, wiki dumps, web pages, note vaults, mail. Fetching is left to others; these
take what has landed, as files or columns, and give relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import chunks as K
from sparkloom.functions import text as T

#: Suffixes of code files and their languages.
LANGUAGES = {"py": "python", "ts": "typescript", "js": "javascript", "go": "go", "rs": "rust", "sql": "sql", "md": "markdown"}


def feed_items(feeds: DataFrame, xml: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row an item of RSS or Atom XML: link, title, summary, published. Read by Spark's own XPath functions."""
    pick = lambda rss, atom: F.expr(f"concat(xpath({xml}, '/rss/channel/item/{rss}'), xpath({xml}, '//*[local-name()=\"entry\"]/{atom}'))")
    named = "*[local-name()=\"{}\"]"
    zipped = F.arrays_zip(pick("link/text()", named.format("link") + "/@href").alias("link"), pick("title/text()", named.format("title") + "/text()").alias("title"), pick("description/text()", named.format("summary") + "/text()").alias("summary"), pick("pubDate/text()", named.format("updated") + "/text()").alias("published"))
    return feeds.select(*carry, F.inline(zipped).alias("link", "title", "summary", "published"))


def code_files(spark: SparkSession, path: str) -> DataFrame:
    """path, language, text, hash of the code files below a folder."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("path", F.input_file_name())
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    language = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[suffix]
    return files.select("path", language.alias("language"), F.col("value").alias("text"), F.sha2("value", 256).alias("hash")).where("language IS NOT NULL")


def code_chunks(files: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """path, language, hash, index, chunk of code files: overlapping runs of characters; files of equal contents once."""
    first = files.groupBy("hash").agg(F.min_by(F.struct("path", "language", "text"), "path").alias("f")).select("hash", "f.*")
    return first.select("path", "language", "hash", F.posexplode(K.chunk_chars(F.col("text"), size, overlap)).alias("index", "chunk"))


def wiki_pages(pages: DataFrame, title: Column, markup: Column, carry: tuple[str, ...] = ()) -> DataFrame:
    """title, redirect (its target, if it is one), sections, links, categories, plain text."""
    target = F.nullif(F.regexp_extract(markup, r"(?i)^\s*#redirect\s*\[\[([^\]|#]+)", 1), F.lit(""))
    sections = F.regexp_extract_all(markup, F.lit(r"(?m)^==+\s*(.*?)\s*==+\s*$"), F.lit(1))
    categories = F.regexp_extract_all(markup, F.lit(r"\[\[Category:([^\]|]+)"), F.lit(1))
    links = F.filter(T.wiki_links(markup), lambda x: ~F.startswith(x, F.lit("Category:")) & ~F.startswith(x, F.lit("File:")))
    return pages.select(*carry, T.wiki_title(title).alias("title"), T.wiki_title(target).alias("redirect"), sections.alias("sections"), links.alias("links"), categories.alias("categories"), T.strip_wiki_markup(markup).alias("plain"))


def web_pages(pages: DataFrame, url: str = "url", html: str = "html", carry: tuple[str, ...] = ()) -> DataFrame:
    """url (canonical), title, lang, published, text without scripts, styles and tags."""
    bare = F.regexp_replace(F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<!--.*?-->|<[^>]*>", " ")
    return pages.select(
        *carry, T.canonical_url(F.col(url)).alias("url"), F.nullif(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1), F.lit("")).alias("title"), F.nullif(F.regexp_extract(html, r'(?i)<html[^>]*\blang="([^"]+)"', 1), F.lit("")).alias("lang"),
        F.coalesce(T.html_date(F.col(html)), T.url_date(F.col(url))[0]).alias("published"), F.trim(F.regexp_replace(bare, r"\s+", " ")).alias("text"),
    )


def vault_notes(notes: DataFrame, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """fields (front matter, name -> value), links (wikilinks of the body), body."""
    head = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    lines = F.filter(F.split(head, "\n"), lambda x: F.contains(x, F.lit(":")))
    pair = lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.regexp_replace(x, r"^[^:]*:", "")))
    body = F.regexp_replace(text, r"(?s)\A---\n.*?\n---(?:\n|\z)", "")
    return notes.select(*carry, F.map_from_entries(F.transform(lines, pair)).alias("fields"), F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(0)), T.normalize_alias)).alias("links"), body.alias("body"))


def field_edges(notes: DataFrame, subject: str, predicates: dict[str, str]) -> DataFrame:
    """subject, predicate, object (normal form) for front-matter fields that name other notes."""
    wanted = F.create_map(*[F.lit(x) for kv in predicates.items() for x in kv])
    each = notes.select(subject, F.explode("fields").alias("field", "value")).withColumn("predicate", wanted[F.col("field")]).where("predicate IS NOT NULL")
    objects = F.transform(F.regexp_extract_all("value", F.lit(r"\[\[([^\]]+)\]\]"), F.lit(0)), T.normalize_alias)
    return each.select(F.col(subject).alias("subject"), "predicate", F.explode(objects).alias("object"))


def with_metadata(documents: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """Documents with their source's own metadata beside them; documents without any stay."""
    return documents.join(metadata, key, "left")
