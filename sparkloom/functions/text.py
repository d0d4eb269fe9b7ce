"""Text functions as Columns: normal forms of names, tokens, dates, URLs; and string similarities as Arrow UDFs."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

#: Words that tell names of organisations apart no further, and their suffixes.
GENERIC_TOKENS = ["of", "the", "and", "for", "a", "in", "institute", "university", "college", "foundation", "network", "initiative", "project", "program", "alliance", "association", "council", "group", "lab", "labs", "camp", "team", "fund", "trust", "society", "collective", "coalition", "centre", "center"]
SUFFIXES = ["inc", "llc", "ltd", "corp", "pbc", "ag"]
QUERY_SUFFIXES = [" module", " validator", " token", " project", " network"]


def normalize_entity_text(c: Column) -> Column:
    """Lower case, trimmed, _ and - as spaces, pairs of spaces as one in a single pass, leading @ dropped, in this order."""
    spaced = F.replace(F.replace(F.trim(F.lower(c)), F.lit("_"), F.lit(" ")), F.lit("-"), F.lit(" "))
    return F.regexp_replace(F.replace(spaced, F.lit("  "), F.lit(" ")), "^@+", "")


def normalize_alias(c: Column) -> Column:
    """[[Path/Name|Shown]] as name: link marks and all but the last part of a path dropped, lower case, trimmed."""
    bare = F.regexp_replace(c, r"\[\[([^\]|]+)(\|[^\]]+)?\]\]", "$1")
    return F.trim(F.lower(F.element_at(F.split(bare, "/"), -1)))


def normalize_alias_list(c: Column) -> Column:
    """Normal forms of an array's aliases, first ones kept; null gives an empty array."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), normalize_alias), lambda x: x.isNotNull() & (x != "")))


def normalize_entity_name(c: Column, dots: bool = True) -> Column:
    """The broader normal form: handles, suffixes after a bar, corporate suffixes, leading articles, end punctuation."""
    out = F.regexp_replace(F.regexp_replace(c, "^@+", ""), r"\s*\|\s*[A-Za-z0-9\s]+$", "")
    out = F.lower(F.translate(out, "_-", "  "))
    if dots:
        out = F.regexp_replace(out, r"(\w)\.(\w)", "$1 $2")
    for suffix in SUFFIXES:
        out = F.regexp_replace(out, rf",?\s*{suffix}\.?$", "")
    out = F.regexp_replace(out, r"^\s*(the|a|an)\s+", "")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    return F.trim(F.regexp_replace(out, r"[.,;:!?]+$", ""))


def tokens(c: Column) -> Column:
    """White-space tokens in lower case."""
    return F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != "")


def terms(c: Column) -> Column:
    """Letters-and-digits tokens in lower case, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def token_overlap(a: Column, b: Column) -> tuple[Column, Column]:
    """Shared tokens as a share of the shorter set, and their number."""
    ta, tb = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    n, short = F.size(F.array_intersect(ta, tb)), F.least(F.size(ta), F.size(tb))
    return F.when(short == 0, 0.0).otherwise(n / short), F.when(short == 0, 0).otherwise(n)


#: Names up to this length are compared many at a time.
LONGEST = 64


def _codes(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points, a name a row, 0 beyond its end; and lengths."""
    size = np.array([len(x) for x in names], np.int64)
    wide = max(1, int(size.max(initial=0)))
    flat = np.array(names, dtype=f"<U{wide}") if len(names) else np.zeros(0, "<U1")
    return np.frombuffer(flat.tobytes(), np.uint32).reshape(len(names), wide), size


def jaro_winkler_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaro similarity with the prefix boost always applied and half transpositions as fractions; a and b are arrays of names.

    All pairs go through the positions together: a step looks at one position of each first name and of each second one.
    """
    x, lx = _codes(a)
    y, ly = _codes(b)
    n, rows = len(x), np.arange(len(x))
    reach = np.maximum(np.maximum(lx, ly) // 2 - 1, 0)
    used, hit = np.zeros(y.shape, bool), np.zeros(x.shape, bool)
    far = int(reach.max(initial=0))
    # What all pairs begin with alike is met place by place, as a letter takes the first free one within reach.
    short = min(int(lx.min(initial=0)), int(ly.min(initial=0)))
    apart = (x[:, :short] != y[:, :short]).any(axis=0)
    begun = int(apart.argmax()) if apart.any() else short
    hit[:, :begun], used[:, :begun] = True, True
    columns_x, columns_y, free = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T), np.ascontiguousarray(~used.T)
    for i in range(begun, x.shape[1]):
        open_ = i < lx
        for j in range(max(begun, i - far), min(y.shape[1], i + far + 1)):
            ok = (columns_x[i] == columns_y[j]) & open_ & free[j] & (j < ly)
            if abs(i - j) > 0:
                ok &= abs(i - j) <= reach
            open_ &= ~ok
            free[j] &= ~ok
            hit[:, i] |= ok
    used[:, begun:] = ~free.T[:, begun:]
    m = hit.sum(axis=1)
    wide = max(1, int(m.max(initial=0)))
    left, right = np.zeros((n, wide), np.uint32), np.zeros((n, wide), np.uint32)
    for codes, marks, out in ((x, hit, left), (y, used, right)):
        r, c = np.nonzero(marks)
        out[r, (np.cumsum(marks, axis=1) - 1)[r, c]] = codes[r, c]
    moved = (left != right).sum(axis=1)
    some = np.maximum(m, 1)
    jaro = np.where(m > 0, (m / np.maximum(lx, 1) + m / np.maximum(ly, 1) + (m - moved / 2) / some) / 3, 0.0)
    first = min(4, x.shape[1], y.shape[1])
    same = (x[:, :first] == y[:, :first]) & (np.arange(first) < np.minimum(lx, ly)[:, None])
    prefix = np.cumprod(same, axis=1).sum(axis=1)
    out = jaro + prefix * 0.1 * (1 - jaro)
    out[(lx == ly) & (rows >= 0) & np.array([p == q for p, q in zip(a, b, strict=True)], bool)] = 1.0
    return out


def token_sort_value(x: str, y: str) -> float:
    """1 - insertions and deletions between the sorted tokens as a share of both lengths.

    The longest common subsequence is counted with a bit a character: a carry runs through each row of the table at once.
    """
    x, y = (" ".join(sorted(s.split())) for s in (x, y))
    total = len(x) + len(y)
    if not total:
        return 1.0
    at: dict[str, int] = {}
    for k, ch in enumerate(x):
        at[ch] = at.get(ch, 0) | (1 << k)
    whole = (1 << len(x)) - 1
    row = whole
    for ch in y:
        met = row & at.get(ch, 0)
        row = ((row + met) | (row - met)) & whole
    return 2 * (len(x) - row.bit_count()) / total


def _pairwise(score: Callable[[np.ndarray, np.ndarray], np.ndarray], a: pd.Series, b: pd.Series) -> pd.Series:
    """score over the distinct pairs of two columns; null where either is."""
    out = np.full(len(a), np.nan)
    known = (a.notna() & b.notna()).to_numpy()
    if known.any():
        place, pairs = pd.factorize(pd.MultiIndex.from_arrays([a[known], b[known]]))
        left, right = (np.array(pairs.get_level_values(k), object) for k in (0, 1))
        values = np.concatenate([score(left[k : k + 20_000], right[k : k + 20_000]) for k in range(0, len(left), 20_000)])
        out[known] = values[place]
    return pd.Series(out).astype("Float64").where(known) if not known.all() else pd.Series(out)


def _jaro_winkler(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Long names, which would widen every row, one by one."""
    long = np.array([max(len(x), len(y)) > LONGEST for x, y in zip(a, b, strict=True)], bool)
    out = np.zeros(len(a))
    out[~long] = jaro_winkler_values(a[~long], b[~long])
    for k in np.flatnonzero(long):
        out[k] = jaro_winkler_values(a[k : k + 1], b[k : k + 1])[0]
    return out


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairwise(_jaro_winkler, a, b)


def jaro_winkler_value(a: str, b: str) -> float:
    return float(jaro_winkler_values(np.array([a], object), np.array([b], object))[0])


@F.pandas_udf(DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairwise(lambda x, y: np.array([token_sort_value(p, q) for p, q in zip(x, y, strict=True)]), a, b)


def phonetic(c: Column) -> Column:
    """A sound code of the first token: digraphs folded, vowels after the first dropped, like consonants as one."""
    s = F.regexp_replace(F.upper(F.get(tokens(c), F.lit(0))), "[^A-Z]", "")
    for pattern, by in (("^(KN|GN|PN|WR)", "N"), ("^X", "S"), ("^WH", "W"), ("MB$", "M"), ("PH", "F"), ("SCH|SH|CH|TCH", "X"), ("TH", "0"), ("C(?=[EIY])", "S"), ("[CQG]", "K"), ("[ZS]+", "S"), ("D", "T"), ("V", "F"), ("B", "P"), ("(?<=.)[AEIOUYHW]", ""), (r"(.)\1+", "$1")):
        s = F.regexp_replace(s, pattern, by)
    return s


def leading_date(c: Column) -> Column:
    """A valid YYYY-MM-DD, spaces allowed for hyphens, that a text starts with; else null."""
    pattern = r"^\s*(\d{4})[-\s](\d{2})[-\s](\d{2})(?!\d)"
    y, m, d = (F.regexp_extract(c, pattern, k) for k in (1, 2, 3))
    fits = (y != "") & m.cast("int").between(1, 12) & d.cast("int").between(1, 31)
    return F.when((y != "") & F.when(y != "", fits), F.concat_ws("-", y, m, d))


def distinctive(c: Column) -> Column:
    return F.array_except(F.array_distinct(tokens(c)), F.array(*[F.lit(t) for t in GENERIC_TOKENS]))


def distinctive_check(a: Column, b: Column) -> Column:
    """Whether names may be one by their distinctive tokens: not disjoint, and no mere extension unless nearly equal."""
    da, db = distinctive(a), distinctive(b)
    shared, na, nb = F.size(F.array_intersect(da, db)), F.size(da), F.size(db)
    extension = (na != nb) & (shared == F.least(na, nb))
    return F.when((na == 0) | (nb == 0), True).when(shared == 0, False).when(extension, jaro_winkler(F.lower(a), F.lower(b)) >= 0.97).otherwise(True)


def person_guard(a: Column, b: Column) -> Column:
    """Person names: as many-worded as each other; if of several words, first and last alike by 0.85 each."""
    ta, tb = tokens(a), tokens(b)
    last = lambda t: F.get(t, F.size(t) - 1)
    near = (jaro_winkler(F.get(ta, F.lit(0)), F.get(tb, F.lit(0))) >= 0.85) & (jaro_winkler(last(ta), last(tb)) >= 0.85)
    return F.when((F.size(ta) == 0) | (F.size(tb) == 0), False).when((F.size(ta) >= 2) != (F.size(tb) >= 2), False).when(F.size(ta) < 2, True).otherwise(near)


def strict_policy(a: Column, b: Column, kind: Column, *, overlap_types: tuple[str, ...] = ("Organization", "Project", "Concept"), min_ratio: float = 0.5, min_count: int = 2) -> Column:
    """The strict token policy: single words nearly equal and no extension of two letters; dates of meetings equal;
    distinctive tokens; and by type the person guard or a minimal overlap."""
    ta, tb, la, lb = tokens(a), tokens(b), F.lower(a), F.lower(b)
    longer, shorter = F.when(F.length(la) >= F.length(lb), la).otherwise(lb), F.when(F.length(la) >= F.length(lb), lb).otherwise(la)
    single = (jaro_winkler(la, lb) >= 0.95) & ~(F.startswith(longer, shorter) & (F.length(longer) - F.length(shorter) >= 2))
    ratio, n = token_overlap(a, b)
    apart = (kind == "Meeting") & F.coalesce(leading_date(a) != leading_date(b), F.lit(False))
    last = lambda t: F.get(t, F.size(t) - 1)
    two = (F.size(ta) == 2) & (F.size(tb) == 2)
    many = (
        F.when(kind.isin("Organization", "Project", "Concept") & ~distinctive_check(a, b), False)
        .when(apart, False)
        .when(kind.isin(*overlap_types), (ratio >= min_ratio) & (n >= min_count))
        .when(kind == "Person", person_guard(a, b))
        .otherwise(~two | (jaro_winkler(last(ta), last(tb)) >= 0.75))
    )
    return F.when((F.size(ta) == 1) | (F.size(tb) == 1), single).otherwise(many)


def semantic_guard(query: Column, found: Column, kind: Column, similarity: Column, threshold: Column, policy: Column) -> Column:
    """What a vector match must pass beyond its threshold: name shapes, the token policy, a margin for short names."""
    tq, tf = tokens(query), tokens(found)
    short = (F.size(tq) <= 2) | (F.length(query) < 12)
    shapes = F.when(kind == "Person", person_guard(query, found)).otherwise(True) & F.when((F.size(tq) >= 2) & (F.size(tf) >= 2), policy).otherwise(True)
    return shapes & F.when(short, similarity >= threshold + 0.03).otherwise(similarity >= threshold)


def query_variants(c: Column) -> Column:
    """Forms in which a query may name an entity."""
    low = F.trim(F.lower(c))
    for prefix in ("x/", "the ", "$"):
        low = F.when(F.startswith(low, F.lit(prefix)), F.substring(low, len(prefix) + 1, 10_000)).otherwise(low)
    up, acronym = F.upper(low), low.rlike("^[a-z]{2,5}$")
    none = F.array().cast("array<string>")
    bare = F.array(*[F.when(F.endswith(low, F.lit(s)), F.trim(F.substring(low, F.lit(1), F.length(low) - len(s)))) for s in QUERY_SUFFIXES])
    short = F.when(acronym, F.array(up, F.concat(F.lit("$"), low), F.concat(F.lit("$"), up), F.concat(low, F.lit("s")), F.concat(up, F.lit("s")), F.concat(low, F.lit(" token")), F.concat(up, F.lit(" token")))).otherwise(none)
    one = F.when(F.endswith(low, F.lit("s")) & (F.length(low) > 3), F.array(F.substring(low, F.lit(1), F.length(low) - 1))).otherwise(none)
    return F.array_distinct(F.concat(F.array(low), F.array_compact(bare), short, one))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda that names an expression would compute it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def grams(tokens: Column, size: int) -> Column:
    """Runs of so many tokens, as arrays."""
    runs = lambda ts: F.filter(F.transform(ts, lambda _, i: F.slice(ts, i + 1, F.lit(size))), lambda g: F.size(g) == size)
    return let(tokens, runs)


def ngram_patterns(c: Column) -> Column:
    """Words of three letters or more, and their adjacent pairs and triples."""
    ws = F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\w\s]", " "), r"\s+"), lambda w: F.length(w) >= 3)
    joined = lambda gs: F.transform(gs, lambda g: F.array_join(g, " "))
    return let(ws, lambda w: F.concat(w, joined(grams(w, 2)), joined(grams(w, 3))))


def deterministic_uri(name: Column, kind: Column) -> Column:
    norm = normalize_entity_text(name)
    return F.concat(F.lit("urn:"), F.lower(kind), F.lit(":"), F.regexp_replace(norm, "[^a-z0-9]+", "-"), F.lit("-"), F.substring(F.sha2(F.concat_ws("|", F.lower(kind), norm), 256), 1, 12))


def base_rid(c: Column) -> Column:
    return F.regexp_replace(c, r"#chunk\d+$", "")


def rid_type(c: Column) -> Column:
    """Type of an identifier orn:a.b.some-type:...: its namespace's last part, words capitalised."""
    last = F.element_at(F.split(F.regexp_extract(c, r"^(?:orn:)?([^:]+):", 1), r"\."), -1)
    return F.when(last == "", None).otherwise(F.replace(F.initcap(F.translate(last, "-_", "  ")), F.lit(" "), F.lit("")))


def canonical_predicate(c: Column, mapping: dict[str, str], allowed: list[str], fallback: str | None = "related_to") -> Column:
    low = F.regexp_replace(F.trim(F.lower(c)), r"[\s-]+", "_")
    named = F.coalesce(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[low], low)
    return F.when(named.isin(allowed), named).otherwise(F.lit(fallback))


def or_terms(c: Column, most: int = 64) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))), 1, most)


def wiki_title(c: Column) -> Column:
    spaced = F.trim(F.regexp_replace(F.translate(F.regexp_replace(c, "#.*$", ""), "_", " "), r"\s+", " "))
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 10_000))


def strip_wiki_markup(c: Column) -> Column:
    out = c
    for pattern, by in ((r"(?s)<!--.*?-->", ""), (r"(?s)<ref[^>]*>.*?</ref>|<ref[^>]*/>", ""), (r"\{\{[^{}]*\}\}", ""), (r"\[\[(?:File|Image|Category):[^\]]*\]\]", ""), (r"\[\[[^\]|]*\|([^\]]*)\]\]", "$1"), (r"\[\[([^\]]*)\]\]", "$1"), (r"\[https?://\S+\s+([^\]]*)\]", "$1"), (r"'{2,}", ""), (r"(?m)^=+\s*(.*?)\s*=+\s*$", "$1"), (r"<[^>]+>", ""), (r"[ \t]+", " ")):
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def wiki_links(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"\[\[([^\]|#]+)"), F.lit(1)), wiki_title)


def canonical_url(c: Column) -> Column:
    """Scheme and host in lower case, default ports and the fragment dropped, an empty path as /; null if not http(s)."""
    raw = F.trim(c)
    part = lambda k: F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#:@]+@)?([^/?#:]*)(?::(\d+))?([^?#]*)(\?[^#]*)?(?:#.*)?$", k)
    scheme, host, port, path, query = F.lower(part(1)), F.lower(part(3)), part(4), part(5), part(6)
    plain = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    return F.when(scheme.isin("http", "https") & (host != ""), F.concat(scheme, F.lit("://"), host, F.when(plain, "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path), query))


def source_url(rid: Column, url: Column) -> Column:
    """Where a document can be read: its own URL, or one that its identifier spells out; never made up."""
    arxiv = F.regexp_extract(rid, r"arxiv[:/.](\d{4}\.\d{4,5})", 1)
    link = F.regexp_extract(rid, r"(https?://\S+)", 1)
    return F.coalesce(F.when(url.rlike("^https?://"), url), F.when(link != "", link), F.when(arxiv != "", F.concat(F.lit("https://arxiv.org/abs/"), arxiv)))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def url_date(c: Column) -> tuple[Column, Column]:
    """A date that a URL spells out, and how sure it is: 0.75 with a day, 0.70 with a month only."""
    day = lambda k: F.regexp_extract(c, r"/((?:19|20)\d{2})[/-](0?[1-9]|1[0-2])[/-](0?[1-9]|[12]\d|3[01])(?:[/-]|$)", k)
    month = lambda k: F.regexp_extract(c, r"/((?:19|20)\d{2})/(0?[1-9]|1[0-2])(?:/|$)", k)
    whole = F.to_date(F.when(day(1) != "", F.concat_ws("-", day(1), F.lpad(day(2), 2, "0"), F.lpad(day(3), 2, "0"))))
    part = F.to_date(F.when(month(1) != "", F.concat_ws("-", month(1), F.lpad(month(2), 2, "0"), F.lit("01"))))
    return F.coalesce(whole, part), F.when(whole.isNotNull(), 0.75).when(part.isNotNull(), 0.70)


def html_date(c: Column) -> Column:
    """The publication date in a page's meta tags or JSON-LD, as a date."""
    found = F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in (r'(?i)<meta[^>]+(?:article:published_time|datePublished|pubdate)[^>]+content="(\d{4}-\d{2}-\d{2})', r'"datePublished"\s*:\s*"(\d{4}-\d{2}-\d{2})', r'(?i)<time[^>]+datetime="(\d{4}-\d{2}-\d{2})')])
    return F.try_to_date(found)


def multi_term_score(text: Column, words: list[str]) -> Column:
    """The share of words (three letters or more) that a text contains, case aside."""
    used = [w.lower() for w in words if len(w) >= 3]
    hits = [F.when(F.contains(F.lower(text), F.lit(w)), 1).otherwise(0) for w in used]
    return sum(hits[1:], hits[0]) / F.lit(float(len(used))) if used else F.lit(0.0)


@F.pandas_udf(StringType())
def canonical_json_hash(c: pd.Series) -> pd.Series:
    """BLAKE2b-256 of JSON with sorted keys and no spaces; null for what isn't JSON."""

    def one(x: str | None) -> str | None:
        try:
            return hashlib.blake2b(json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode(), digest_size=32).hexdigest()
        except (TypeError, ValueError):
            return None

    return c.map(one)


@F.pandas_udf(BooleanType())
def evidence_found(snippet: pd.Series, text: pd.Series) -> pd.Series:
    """Whether a run of at least four fifths of a snippet's words stands in a text, case and spacing aside."""

    def one(s: str | None, t: str | None) -> bool:
        words, body = re.findall(r"\w+", (s or "").lower()), f" {' '.join(re.findall(r'\w+', (t or '').lower()))} "
        need = -(-len(words) * 4 // 5)
        return bool(words) and any(f" {' '.join(words[k : k + need])} " in body for k in range(len(words) - need + 1))

    return pd.Series([one(s, t) for s, t in zip(snippet, text, strict=True)])
