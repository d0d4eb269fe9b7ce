"""Quality gates and audits over documents, entities, relationships and extractions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T

#: Names and shapes that a quality filter refuses.
PLACEHOLDERS = ["unknown", "n/a", "none", "null", "tbd", "todo", "example", "test", "placeholder", "untitled"]
STOP_NAMES = ["the", "this", "that", "it", "they", "we", "you", "he", "she", "and", "or", "of", "a", "an"]
GENERIC_GROUPS = ["team", "community", "users", "members", "people", "developers", "everyone", "group", "participants"]
PRIVATE = {"email": r"[\w.+-]+@[\w-]+\.[\w.-]+", "phone": r"\+?\d[\d\s().-]{7,}\d", "ssn": r"\b\d{3}-\d{2}-\d{4}\b", "secret": r"(?i)\b(?:api[_-]?key|token|secret|password)\b\s*[=:]\s*\S+"}
SPECULATION = ["might", "could", "possibly", "perhaps", "rumor", "allegedly", "speculation", "unconfirmed"]


def gate(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """df with reasons (names of the rules that a row breaks, in order) and valid."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]))
    return df.withColumn("reasons", found).withColumn("valid", F.size("reasons") == 0)


def entity_rules(name: Column, kind: Column) -> dict[str, Column]:
    """Reason codes for an entity's name and type."""
    low, n = F.lower(F.trim(name)), F.size(T.tokens(name))
    return {
        "single_token_person": (kind == "Person") & (n == 1), "too_short": F.length(low) < 2, "placeholder": low.isin(PLACEHOLDERS), "stop_word": low.isin(STOP_NAMES),
        "numeric_only": low.rlike(r"^[\d\s.,%$#-]+$"), "tautological": low == F.lower(kind), "lowercase_person": (kind == "Person") & (name == F.lower(name)),
        "placeholder_person": (kind == "Person") & low.rlike(r"^(user|speaker|person|customer|client)\s*#?\d*$"), "generic_group": low.isin(GENERIC_GROUPS), "erc_standard": low.rlike(r"^erc-?\d+$"),
        "jira_issue_id": name.rlike(r"^[A-Z]{2,10}-\d+$"), "boilerplate": low.rlike("(cookie policy|privacy policy|terms of service|all rights reserved|subscribe)"), "generic_pattern": low.rlike("^(some|any|many|various|several|other) "),
        "sentence_like": (n > 8) | low.rlike(r"[.!?]\s+\w"), "too_long": F.length(name) > 120, "technical_pattern": low.rlike(r"(::|->|\(\)|[{}<>]|^0x[0-9a-f]+$|^/[\w/.-]+$)"), "git_changelog": low.rlike(r"^(feat|fix|chore|docs|refactor|merge)(\(.*\))?:"),
        "ai_as_person": (kind == "Person") & low.rlike(r"\b(gpt|chatbot|assistant|llm|bot)\b"), "generic_event": (kind == "Event") & low.isin("meeting", "call", "event", "session", "workshop"), "generic_domain_type": low.isin("project", "system", "platform", "process", "product", "service"),
        "firstname_orgname_artifact": (kind == "Person") & low.rlike(r"\b(inc|llc|ltd|foundation|network)$"), "blockchain_as_location": (kind == "Location") & low.rlike(r"(chain|mainnet|testnet)$"), "code_module_as_process": (kind == "Process") & low.rlike(r"(\.py|\.ts|\.go|_module)$"),
        "abstract_concept_as_material": (kind == "Material") & low.rlike("(ness|ity|ism|tion)$"),
    }


def split_lists(df: DataFrame, name: str, confidence: str, kinds: Sequence[str] | None = None, kind: str = "entity_type", most: int = 5, least: float = 0.75) -> DataFrame:
    """Rows whose name lists several ("A, B and C") as a row an item, if sure enough and not too many; others unchanged."""
    items = F.filter(F.transform(F.split(F.col(name), r"\s*,\s*(?:and\s+)?|\s+and\s+|\s*&\s*"), lambda x: F.trim(x)), lambda x: x != "")
    fits = (F.size(items) > 1) & (F.size(items) <= most) & (F.coalesce(F.col(confidence), F.lit(0.0)) >= least)
    if kinds is not None:
        fits = fits & F.col(kind).isin(list(kinds))
    rest = [c for c in df.columns if c != name]
    return df.select(*rest, F.explode(F.when(fits, items).otherwise(F.array(name))).alias(name)).select(*df.columns)


def ontology_type(kind: Column, types: Mapping[str, str], prefixes: Sequence[str] = ("schema:", "https://schema.org/")) -> Column:
    """A type without its namespace, in capitals with underscores, by its canonical name where the map has one; null and empty
    ones stay."""
    bare = F.trim(kind)
    for prefix in prefixes:
        bare = F.when(F.startswith(F.trim(kind), F.lit(prefix)), F.substring(F.trim(kind), len(prefix) + 1, 1 << 30)).otherwise(bare)
    clean = F.replace(F.upper(bare), F.lit(" "), F.lit("_"))
    named = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])[clean] if types else F.lit(None).cast("string")
    return F.when(kind.isNull() | (kind == ""), kind).otherwise(F.coalesce(named, clean))


def ontology_predicate(predicate: Column, names: Mapping[str, str]) -> Column:
    """A predicate in lower case with underscores, without its namespace, by its canonical name where the map has one."""
    clean = F.element_at(F.split(F.replace(F.lower(F.trim(predicate)), F.lit(" "), F.lit("_")), ":"), -1)
    named = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[clean] if names else F.lit(None).cast("string")
    return F.when(predicate.isNull() | (predicate == ""), predicate).otherwise(F.coalesce(named, clean))


def routing(drafts: DataFrame, pools: DataFrame, broader: DataFrame) -> DataFrame:
    """Drafts (draft, region, tags, start, end, value) against all pools (pool, region, tags, start, end, threshold, remaining):
    draft, pool, region_score, tag_score, time_score, capacity_score, total, excludes, recommended.

    30 for the same region, 15 for one that is broader or narrower (broader: narrow, wide); 25 by shared tags; 15 by the share of
    the draft's days that the pool covers, all of it for a pool without dates; 20 by capacity. A pool without a common day, or
    whose capacity is less than the value or none, is excluded. Rounded half to even. Pools are a stated set, of which a row with
    all of them is joined to each draft.
    """
    linked = broader.select(F.col("narrow").alias("x"), F.col("wide").alias("y")).unionByName(broader.select(F.col("wide").alias("x"), F.col("narrow").alias("y")))
    near = linked.groupBy(F.col("x").alias("region")).agg(F.collect_set("y").alias("near"))
    every = pools.agg(F.collect_list(F.struct("pool", "region", "tags", "start", "end", "threshold", "remaining")).alias("pools"))
    rows = drafts.join(near, "region", "left").join(F.broadcast(every)).withColumn("p", F.explode("pools")).drop("pools")
    c, p = F.col, F.col("p")
    none = F.array().cast("array<string>")
    region = F.when(c("region") == p["region"], 30).when(F.array_contains(F.coalesce("near", none), p["region"]), 15).otherwise(0)
    longest = F.greatest(F.size("tags"), F.size(p["tags"]))
    tags = F.when((F.size("tags") > 0) & (F.size(p["tags"]) > 0), F.bround(25.0 * F.size(F.array_intersect("tags", p["tags"])) / longest)).otherwise(0)
    dated = p["start"].isNotNull() & p["end"].isNotNull()
    shared = F.datediff(F.least(c("end"), p["end"]), F.greatest(c("start"), p["start"]))
    own = F.datediff("end", "start")
    time = F.when(c("start").isNull() | c("end").isNull(), 0).when(~dated, 15).when(shared > 0, F.bround(15.0 * shared / F.when(own == 0, 1).otherwise(own))).otherwise(0)
    apart = c("start").isNotNull() & c("end").isNotNull() & dated & (shared <= 0)
    valued, left = c("value") > 0, F.coalesce(p["remaining"], F.lit(0.0))
    toward = F.bround(20 * F.least(F.least(c("value") / p["threshold"], F.lit(1.0)) + 0.5, F.lit(1.0)))
    fits = F.bround(20 * F.greatest(1 - c("value") / left, F.lit(0.3)))
    capacity = F.when(valued & (left > 0) & (c("value") <= left), F.when(F.coalesce(p["threshold"], F.lit(0.0)) > 0, toward).otherwise(fits)).otherwise(0)
    excludes = F.array_compact(F.array(F.when(apart, "outside_timeframe"), F.when(valued & (left > 0) & (c("value") > left), "exceeds_capacity"), F.when(valued & (left <= 0), "no_capacity")))
    scored = rows.select("draft", p["pool"].alias("pool"), *[x.cast("long").alias(f"{n}_score") for n, x in (("region", region), ("tag", tags), ("time", time), ("capacity", capacity))], excludes.alias("excludes"))
    total = c("region_score") + c("tag_score") + c("time_score") + c("capacity_score")
    return scored.withColumn("total", total).withColumn("recommended", (c("total") >= 60) & (F.size("excludes") == 0))


def type_guard(edges: DataFrame, rules: DataFrame, subject_type: str, object_type: str) -> DataFrame:
    """Edges with allowed: whether their predicate's rule (predicate, subject_types, object_types) admits both types."""
    ok = F.col("subject_types").isNotNull() & F.array_contains("subject_types", F.col(subject_type)) & F.array_contains("object_types", F.col(object_type))
    return edges.join(rules, "predicate", "left").withColumn("allowed", F.coalesce(ok, F.lit(False))).drop("subject_types", "object_types")


def scan_private(df: DataFrame, text: Column) -> DataFrame:
    return df.withColumns({f"has_{k}": text.rlike(p) for k, p in PRIVATE.items()})


def style(text: Column) -> dict[str, Column]:
    """speculation: 0.2 a phrase, at most 1; shouting: the share of capitals; exclamation: marks a hundred characters."""
    low = F.lower(text)
    hits = [F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in SPECULATION]
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    caps = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    marks = F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))
    return {"speculation": F.least(F.lit(1.0), sum(hits[1:], hits[0]) * 0.2), "shouting": F.when(letters > 0, caps / letters).otherwise(0.0), "exclamation": 100 * marks / F.greatest(F.length(text), F.lit(1))}


def content_rank(confidence: Column, prioritised: Column, days_old: Column, tags: Column) -> Column:
    """Relevance: confidence, half as much again for chosen sources, recency within a week, tags, governance."""
    recent = 1 + 0.5 * F.greatest(F.lit(0.0), 1 - days_old / 7)
    governed = F.arrays_overlap(tags, F.array(F.lit("governance"), F.lit("proposal"), F.lit("vote")))
    return confidence * F.when(prioritised, 1.5).otherwise(1.0) * recent * F.when(F.size(tags) > 0, 1.2).otherwise(1.0) * F.when(governed, 1.3).otherwise(1.0)


def cell_status(value: Column, passing: Column, review: Column) -> Column:
    return F.when(value.isNull(), "review").when(value >= passing, "pass").when(value >= review, "review").otherwise("fail")


def overall(statuses: Sequence[Column]) -> Column:
    """The worst of fail, review and pass."""
    level = lambda s: F.when(s == "fail", 2).when(s == "review", 1).otherwise(0)
    worst = F.greatest(*[level(s) for s in statuses], F.lit(0))
    return F.when(worst == 2, "fail").when(worst == 1, "review").otherwise("pass")


def chunk_coverage(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """rid, share of its chunks (rid, index) that some citation (rid, first, last) covers; ranges are clipped to known chunks."""
    cited = citations.where("first <= last").select("rid", F.explode(F.sequence("first", "last")).alias("index")).distinct()
    n = chunks.groupBy("rid").agg(F.count(F.lit(1)).alias("n"))
    hit = chunks.join(cited, ["rid", "index"], "left_semi").groupBy("rid").agg(F.count(F.lit(1)).alias("hit"))
    return n.join(hit, "rid", "left").select("rid", (F.coalesce("hit", F.lit(0)) / F.col("n")).alias("coverage"))


def concentration(rows: DataFrame, key: str, value: str, least: int = 1) -> DataFrame:
    """key, share of its most common value; null with fewer rows than least."""
    c = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    return c.select(key, F.when(F.col("n") >= least, F.col("top") / F.col("n")).alias("concentration"))


def dbscan(neighbors: DataFrame, points: DataFrame, min_samples: int = 2) -> DataFrame:
    """id, cluster over pairs within eps (a, b, both ways or one): cores have min_samples points nearby, themselves included;
    a border point joins its least neighbouring core; noise is a cluster of its own."""
    from sparkloom.operators.graph import connected_components

    both = neighbors.select("a", "b").unionByName(neighbors.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    core = both.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") + 1 >= min_samples).select(F.col("a").alias("core"))
    inner = both.join(core, F.col("a") == F.col("core"), "left_semi").join(core, F.col("b") == F.col("core"), "left_semi")
    comp = connected_components(inner).select(F.col("node").alias("core"), F.col("component").alias("cluster"))
    comp = core.join(comp, "core", "left").select("core", F.coalesce("cluster", "core").alias("cluster"))
    border = both.join(core, F.col("a") == F.col("core"), "left_anti").join(comp, F.col("b") == F.col("core")).groupBy(F.col("a").alias("id")).agg(F.min_by("cluster", "core").alias("cluster"))
    named = comp.select(F.col("core").alias("id"), "cluster").unionByName(border)
    return points.select("id").join(named, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def audit(checks: Mapping[str, DataFrame], limits: Mapping[str, int] | None = None) -> DataFrame:
    """check, violations, status: one count a check (a DataFrame of violations), PASS up to its limit."""
    parts = [df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(k).alias("check"), "violations") for k, df in checks.items()]
    limit = F.create_map(*[F.lit(x) for k in checks for x in (k, (limits or {}).get(k, 0))])[F.col("check")]
    return reduce(DataFrame.unionByName, parts).withColumn("status", F.when(F.col("violations") <= limit, "PASS").otherwise("FAIL"))


def retrieval_metrics(results: DataFrame, truth: DataFrame, k: int = 5) -> DataFrame:
    """query_id, recall, precision, mrr at k of results (query_id, rank, item) against truth (query_id, item).

    Queries without true items count as right when nothing is returned.
    """
    top = results.where(F.col("rank") <= k)
    hit = top.join(truth, ["query_id", "item"]).groupBy("query_id").agg(F.countDistinct("item").alias("hits"), F.min("rank").alias("first"))
    n = truth.groupBy("query_id").agg(F.countDistinct("item").alias("true"))
    got = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("got"))
    all_ = n.join(got, "query_id", "full_outer").join(hit, "query_id", "left")
    hits, true, g = F.coalesce("hits", F.lit(0)), F.coalesce("true", F.lit(0)), F.coalesce("got", F.lit(0))
    return all_.select("query_id", F.when(true == 0, F.when(g == 0, 1.0).otherwise(0.0)).otherwise(hits / F.least(true, F.lit(k))).alias("recall"), F.when(g == 0, F.when(true == 0, 1.0).otherwise(0.0)).otherwise(hits / g).alias("precision"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"))


def theme_clusters(items: DataFrame, tags: str, fallback: str) -> DataFrame:
    """theme, items: an item's theme is its most common tag overall, ties by name, or else the fallback column."""
    counts = items.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    own = items.select("id", F.explode(tags).alias("tag")).join(counts, "tag")
    best = Window.partitionBy("id").orderBy(F.col("n").desc(), "tag")
    theme = own.withColumn("_rn", F.row_number().over(best)).where("_rn = 1").select("id", "tag")
    return items.select("id", fallback).join(theme, "id", "left").groupBy(F.coalesce("tag", fallback).alias("theme")).agg(F.count(F.lit(1)).alias("items"))


def threads(posts: DataFrame) -> DataFrame:
    """thread, title, posts, latest over posts (url, title, published_at): by forum or issue URL, else URL, else title."""
    key = F.coalesce(F.nullif(F.regexp_extract("url", r"(https?://[^?#]+?/(?:t|topic|issues|pull)/[^/?#]+(?:/\d+)?)", 1), F.lit("")), F.col("url"), F.col("title"))
    plain = F.when(F.lower("title").startswith("re:"), 0).otherwise(1)
    return posts.withColumn("thread", key).groupBy("thread").agg(F.max_by("title", F.struct(plain, "published_at", "title")).alias("title"), F.count(F.lit(1)).alias("posts"), F.max("published_at").alias("latest"))
