"""Each operator against a brute-force version on hostile rows: nulls, empty and long texts, ties, copies, clashing columns."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import exact_dedup, html_extraction, mixing, near_dedup, piece_lattice, quality_rules, sanitise, substring_dedup, token_counts, toxicity
from sparkloom.llm.common import tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, label int, size long"


def rows(texts: list[tuple[int | None, str | None]], source=lambda i: f"s{i % 3}") -> list[tuple]:  # noqa: ANN001
    return [(i, t, "en", source(i) if i is not None else None, len(t or ""), 7, "x", 1, 3) for i, t in texts]


def prose(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts() -> list[tuple[int | None, str | None]]:
    r = random.Random(5)
    base, shared, long = prose(r, 120), prose(r, 60), prose(r, 4000)
    out: list[tuple[int | None, str | None]] = [(0, None), (1, ""), (2, "  \n\t "), (3, "one"), (4, "two words"), (5, base), (6, base), (7, base.upper()), (8, base + " tail"), (9, long), (10, long + " x")]
    out += [(11 + k, f"{prose(r, 30)} {shared} {prose(r, 20)}") for k in range(8)]
    words = base.split()
    for k in range(12):  # near copies at several distances
        ws = list(words)
        for _ in range(k):
            ws[r.randrange(len(ws))] = "zz"
        out.append((30 + k, " ".join(ws)))
    out += [(60, "mail a.b@c.de and a@b@c.d or 1.2.3.4.5.6.7.8 at 300.1.1.1 é 4111 1111 1111 1111 +49 (0) 30-1234567 x@y.z_q@w.vu"), (60, "mail a.b@c.de and a@b@c.d or 1.2.3.4.5.6.7.8 at 300.1.1.1 é 4111 1111 1111 1111 +49 (0) 30-1234567 x@y.z_q@w.vu")]
    out += [(61, "a" * 20_000), (62, "1" * 20_000), (63, "1 " * 9_000), (64, "x@" * 3_000), (65, "1.2.3.4 " * 500 + "+1" + "(" * 5_000), (66, "line\nline\n\nline\nother " * 30)]
    out += [(None, base), (None, None), (70, "<|endoftext|> 's don't ﬁ ÀΣ 日本 \x1c ▁ x"), (70, "another text under one id")]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):  # noqa: ANN001, ANN201
    return spark.createDataFrame(rows(texts), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):  # noqa: ANN001, ANN201
    return spark.createDataFrame([], SCHEMA)


def counted(df, *cols: str) -> collections.Counter:  # noqa: ANN001
    return collections.Counter(tuple(x) for x in df.select(*cols).collect())


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact(docs, texts, none, keep):  # noqa: ANN001
    groups = collections.defaultdict(list)
    for i, t in texts:
        groups[t or ""].append(i)
    want = collections.Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (max(known) if keep == "largest" else min(known)) if known else None
        for i in ids:
            want[(i, best, len(ids), hashlib.sha256(t.encode()).hexdigest())] += 1
    got = exact_dedup.exact_groups(docs, keep=keep)
    assert counted(got, "doc_id", "keep_id", "group_size", "text_sha256") == want
    kept = got.where("kept").groupBy("text_sha256").count().collect()
    assert len(kept) == len(groups) and all(x["count"] == 1 for x in kept)
    assert got.where("kept AND NOT doc_id <=> keep_id").count() == 0
    assert exact_dedup.exact_groups(none).count() == 0


def test_exact_over_many_partitions(spark):  # noqa: ANN001
    """A text that fills many partitions, whose runs meet at their edges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    many = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 < 3, "same").otherwise(F.concat(F.lit("t"), (F.col("id") % 20).cast("string"))).alias("text"))
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(many, keep="largest").collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == 400 and got[0]["group_size"] == 300 and got[0]["keep_id"] == 398
    assert sum(r["kept"] for r in got.values()) == 1 + 5 and got[398]["kept"]


def shingle_sets(texts, width):  # noqa: ANN001, ANN201
    out = []
    for _, t in texts:
        ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append(frozenset(tuple(ws[k : k + width]) for k in range(len(ws) - width + 1)) if len(ws) >= width else frozenset([tuple(ws)]) if ws else frozenset())
    return out


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near(docs, texts, none, width, percent):  # noqa: ANN001
    sets, parent = shingle_sets(texts, width), list(range(len(texts)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    best: dict[int, int | None] = {}
    for k, (i, _) in enumerate(texts):
        known = [x for x in (best.get(root(k)), i) if x is not None]
        best[root(k)] = min(known) if known else None
    want = collections.Counter((i, len(sets[k]), best[root(k)] if sets[k] else i) for k, (i, _) in enumerate(texts))
    assert counted(near_dedup.near_groups(docs, width=width, percent=percent), "doc_id", "n_shingles", "component_id") == want
    assert near_dedup.near_groups(none).count() == 0


def test_bands_miss_rarely():  # noqa: ANN201
    assert (1 - 0.85**near_dedup.ROWS) ** near_dedup.bands_for(0.85, 1e-6) <= 1e-6
    need = near_dedup.least_matches((30, 180), 0.85, 1e-6)
    assert 0 < need[0] < 26 and need[0] < need[1] < 153


@pytest.mark.parametrize("widest", [28, 1])
def test_substrings(docs, texts, none, widest):  # noqa: ANN001
    """With bitmaps for every task, and with the sketch's cells dealt out and joined."""
    width, count = 35, collections.Counter()
    words = [WORD.findall(t or "") for _, t in texts]
    for ws in words:
        count.update(tuple(ws[k : k + width]) for k in range(len(ws) - width + 1))
    want = collections.Counter()
    for (i, _), ws in zip(texts, words, strict=True):
        gone = set()
        for k in range(len(ws) - width + 1):
            if count[tuple(ws[k : k + width])] > 1:
                gone.update(range(k, k + width))
        left = " ".join(w for k, w in enumerate(ws) if k not in gone)
        want[(i, len(ws), len(gone), hashlib.sha256(left.encode()).hexdigest())] += 1
    assert counted(substring_dedup.dedup(docs, widest=widest), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert substring_dedup.dedup(none, widest=widest).count() == 0


def test_sketches_of_partitions_add_up(docs, spark):  # noqa: ANN001
    """No merged cell is below the count of any seed that falls into it."""
    import numpy as np
    import pyarrow as pa
    from sparkloom.llm.wordhash import Words

    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").alias("id"))
    _, pages = substring_dedup.sketched(texts, 35, 21, False)
    hot = {(p["row"], (p["page"] << substring_dedup.PAGE) + c) for p in pages.collect() for c in np.frombuffer(p["hot"], "<u4").tolist()}
    seeds = np.concatenate([substring_dedup.spans(Words(pa.array([x["text"]])), 35)[3] for x in texts.collect()])
    each, n = np.unique(seeds, return_counts=True)
    assert (n > 1).any() and (n == 1).any()
    for row in (0, 1):
        cells = substring_dedup._cells(each, 21, row)
        assert all((row, c) in hot for c in cells[n > 1].tolist())
        assert np.mean([(row, c) in hot for c in cells[n == 1].tolist()]) < 0.05


def test_quality(docs, texts, none):  # noqa: ANN001
    want = collections.Counter()
    for i, t in texts:
        t, ws = t or "", WORD.findall(t or "")
        grams = collections.Counter(tuple(ws[k : k + 5]) for k in range(len(ws) - 4))
        again = {p for k in range(len(ws) - 4) if grams[tuple(ws[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want[(i, len(ws), sum(map(len, ws)), sum(ch in "#*$%&|<>" for ch in t), len(lines) - len(set(lines)), len(again), len(ws) < 10 or 100 * len(again) > 20 * len(ws))] += 1
    got = quality_rules.apply_rules(docs)
    assert counted(got, "doc_id", *quality_rules.MEASURES, "base_failed") == want
    assert got.where("base_failed AND kept").count() == 0
    assert quality_rules.apply_rules(none).count() == 0


def test_bad_host_goes(spark):  # noqa: ANN001
    r = random.Random(1)
    good, bad = [(k, prose(r, 40)) for k in range(60)], [(100 + k, "too short" if k % 10 else prose(r, 40)) for k in range(60)]
    got = quality_rules.apply_rules(spark.createDataFrame(rows(good + bad, lambda i: "good" if i < 100 else "bad"), SCHEMA))
    assert got.where("doc_id < 100 AND NOT kept").count() == 0 and got.where("doc_id >= 100 AND kept").count() == 0


def test_host_verdicts_by_brute_force(spark):  # noqa: ANN001
    """Shrunk rates of hosts with every rate of failure, against plain Python; the SQL of the query gives the same."""
    import duckdb
    from sparkloom.llm.queries import SQL

    r, texts, source = random.Random(7), [], {}
    for h in range(24):
        for _ in range(3 + 5 * (h % 7)):
            source[len(texts)] = f"h{h}" if h else None
            texts.append("short one" if r.random() < h / 23 else prose(r, 25) + " # $ % & | < > * #" * (h % 5 == 0))
    table = spark.createDataFrame(rows(list(enumerate(texts)), source.get), SCHEMA)
    judged = [(source[k], len(t.split()) < 10, 10 * sum(x in "#*$%&|<>" for x in t) > 3 * len(t.split())) for k, t in enumerate(texts)]
    hosts = {h: [x for x in judged if x[0] == h] for h in source.values()}
    gone = set()
    for rule in (1, 2):
        rates = {h: sum(x[rule] for x in xs) / len(xs) for h, xs in hosts.items()}
        mean = sum(rates.values()) / len(rates)
        var = sum((x - mean) ** 2 for x in rates.values()) / len(rates)
        weight = max(1.0, min(1000.0, mean * (1 - mean) / var - 1)) if var else 1000.0
        gone |= {h for h, xs in hosts.items() if (sum(x[rule] for x in xs) + mean * weight) / (len(xs) + weight) > 0.6}
    assert 3 < len(gone) < 20
    got = {x["doc_id"]: x["kept"] for x in quality_rules.apply_rules(table).collect()}
    assert got == {k: not judged[k][1] and source[k] not in gone for k in range(len(texts))}
    documents = table.toPandas()  # noqa: F841
    assert {d: bool(k) for d, k in duckdb.sql(f"SELECT doc_id, kept FROM ({SQL['op8_quality_rules']})").fetchall()} == got


def test_mixing(docs, texts, none):  # noqa: ANN001
    got = mixing.curriculum(docs).collect()
    assert len(got) == len(texts)
    sizes: collections.Counter = collections.Counter()
    for x in rows(texts):
        sizes[x[3]] += len(WORD.findall(x[1] or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = dict(zip(order, [(3, 1, 2)[k % 3] for k in range(len(order))], strict=True))
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    target |= {s: level * weight[s] for s in open_}
    taken: collections.Counter = collections.Counter()
    for x in got:
        assert x["source_size"] == sizes[x["source"]] and x["target"] == pytest.approx(target[x["source"]])
        assert len(x["positions"]) <= 2 and all(0 <= p <= 1 for p in x["positions"]) and sorted(x["positions"]) == x["positions"]
        taken[x["source"]] += x["size"] * len(x["positions"])
    largest = max(len(WORD.findall(t or "")) for _, t in texts)
    assert all(abs(taken[s] - target[s]) <= largest for s in order)
    again = mixing.curriculum(docs.repartition(3)).collect()
    key = lambda x: (x["doc_id"] is None, x["doc_id"], x["key"], x["positions"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.curriculum(none).count() == 0 and mixing.in_order(mixing.curriculum(none)).count() == 0 and mixing.by_position(mixing.curriculum(none)).count() == 0
    first = [x["first_position"] for x in mixing.by_position(mixing.curriculum(docs)).collect()]
    read = [x for x in first if x is not None]
    assert len(first) == len(texts) and read == sorted(read) and first[: len(read)] == read
    every = [x["position"] for x in mixing.in_order(mixing.curriculum(docs)).collect()]
    assert every == sorted(p for x in got for p in x["positions"])


def test_many_sources(spark):  # noqa: ANN001
    """Ranks over many ranges of sources, and the level by rounds, against water-filling in one place."""
    r = random.Random(12)
    sizes = {f"host{k}": int(r.paretovariate(0.7) * 100) for k in range(700)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {x["name"]: x for x in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "name string, source_size long")).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    order = sorted(sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    assert all(got[s]["rank"] == k for k, s in enumerate(order))
    full: set[str] = set()
    while True:
        level = (1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if 2 * sizes[s] <= level * weight[s]}
        if more == full:
            break
        full = more
    assert all(got[s]["target"] == pytest.approx(min(2 * sizes[s], level * weight[s])) for s in order)
    assert sum(x["target"] for x in got.values()) == pytest.approx(1.5 * sum(sizes.values()))


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits: str) -> bool:
    return sum(int(x) if k % 2 == 0 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str) -> str:
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".") if kind == "ip" and len(p) < 1000) and max(map(len, m[0].split("."))) < 1000, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


def test_base_spans(docs, texts, none):  # noqa: ANN001
    quick = [(i, t) for i, t in texts if i not in (61,)]  # the plain pattern is quadratic there
    want = collections.Counter((i, base_spans(t or "")) for i, t in quick)
    got = sanitise.sanitise(docs.where("doc_id IS NULL OR doc_id != 61")).select("doc_id", sanitise.joined(F.col("base")).alias("b"))
    assert counted(got, "doc_id", "b") == want
    assert sanitise.sanitise(none).count() == 0


def test_random_spans(spark):  # noqa: ANN001
    r = random.Random(2)
    texts = ["".join(r.choices("ab1234567890.@+-_ ()%é", k=r.randint(0, 60))) for _ in range(3000)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", sanitise.joined(sanitise.base_spans(F.col("text"))).alias("b")).collect()
    assert {x["i"]: x["b"] for x in got} == {i: base_spans(t) for i, t in enumerate(texts)}


def test_disclosing_terms_go(spark):  # noqa: ANN001
    r = random.Random(3)
    plain = [(k, prose(r, 30)) for k in range(400)]
    told = [(500 + k, f"{prose(r, 20)} Zanzibarian writes from zed@example.org {prose(r, 20)}") for k in range(3)]
    clean = [(600, "the Zanzibarian alone"), (601, "nothing and nothing")]
    got = {x["doc_id"]: x for x in sanitise.sanitise(spark.createDataFrame(rows(plain + told + clean), SCHEMA)).collect()}
    for k in range(3):
        kinds = [x["k"] for x in got[500 + k]["spans"]]
        assert 0 in kinds and (4 in kinds or 5 in kinds)
        assert "zed@" not in got[500 + k]["sanitised"] and "[EMAIL]" in got[500 + k]["sanitised"] and "Zanzibarian" not in got[500 + k]["sanitised"]
    assert got[600]["sanitised"] == "the [TERM] alone"  # who reads it alone is led to the entity too
    assert not got[601]["spans"] and got[601]["sanitised"] == "nothing and nothing" and sum(bool(got[k]["spans"]) for k in range(400)) < 40


@pytest.mark.parametrize("bound", [None, 0])
def test_term_spans_by_brute_force(spark, monkeypatch, bound):  # noqa: ANN001
    """All pairs of entities and terms counted, over random texts with copies, shared entities and terms in several documents."""
    if bound is not None:  # tables are joined by shuffles
        monkeypatch.setattr("sparkloom.llm.common.BROADCAST_BYTES", bound)
    r = random.Random(8)
    vocab, people = [f"{a}{b}{c}" for a in ("lor", "mip", "sud") for b in ("aka", "olo", "ine") for c in ("ter", "vum", "x", "zéd")], [f"p{k}@mail.org" for k in range(12)]
    texts = []
    for k in range(150):
        ws = r.choices(vocab, weights=[1 / (i + 1) for i in range(len(vocab))], k=r.randint(3, 12)) + ["common"] * (k % 3 > 0)
        if k % 4 == 0:
            who = r.randrange(1 + k // 14)
            ws.insert(r.randrange(len(ws)), people[who])
            ws += [f"nick{chr(97 + who)}"] * (r.random() < 0.9) + [f"once{chr(97 + k // 26)}{chr(97 + k % 26)}"]
        elif k % 37 == 1:
            ws.append(f"nick{chr(97 + k // 14)}")
        texts.append(" ".join(ws))
    texts += [texts[0]] * 9 + [texts[4]] * 3 + ["", None]
    alpha = sure = 0.9
    n, word = len(texts), re.compile(r"[^\W\d_]{4,}")
    has_e = [set(re.findall(PATTERNS["email"].replace("(\\.", "(?:\\."), t or "")) for t in texts]
    has_t = [set(word.findall(re.sub(PATTERNS["email"], " ", t or ""))) for t in texts]
    df_t, df_e = collections.Counter(x for s in has_t for x in s), collections.Counter(x for s in has_e for x in s)
    flagged: dict[str, bool] = {}
    for e, ne in df_e.items():
        if ne < n or len({t for t, s in zip(texts, has_e, strict=True) if e in s}) == 1:
            together = collections.Counter(x for s, ts in zip(has_e, has_t, strict=True) if e in s for x in ts)
            for t, both in together.items():
                if math.log2(n * both / (ne * df_t[t])) >= alpha * math.log2(n / ne) - 1e-9:
                    flagged[t] = flagged.get(t, False) or both >= sure * df_t[t]
    assert any(flagged.values()) and not all(flagged.values())
    want, clean = {}, {}
    for k, t in enumerate(texts):
        base = [(m.start(), 0, m.end(), "email") for m in re.finditer(PATTERNS["email"], t or "")]
        more = [(m.start(), 4 if flagged[m[0]] else 5, m.end(), "term" if flagged[m[0]] else "quasi") for m in word.finditer(t or "") if m[0] in flagged]
        own = sorted(base + [x for x in more if not any(b[0] < x[2] and x[0] < b[2] for b in base)])
        want[k] = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in own)
        out, at = "", 0
        for a, kind, b, _ in own:
            out, at = out + (t or "")[at:a] + ["[EMAIL]", "", "", "", "", "[TERM]"][kind], b
        clean[k] = out + (t or "")[at:]
    got = sanitise.sanitise(spark.createDataFrame(rows(list(enumerate(texts))), SCHEMA).repartition(3)).select("doc_id", sanitise.joined(F.col("spans")).alias("s"), "sanitised").collect()
    assert {x["doc_id"]: x["s"] for x in got} == want and {x["doc_id"]: x["sanitised"] for x in got} == clean


def test_overlapping_spans_leave_nothing(spark):  # noqa: ANN001
    spans = [(2, 0, 6, ""), (4, 2, 10, ""), (9, 3, 12, ""), (14, 4, 16, "")]
    row = spark.createDataFrame([("0123456789abcdefgh", spans), ("plain", []), ("", [])], f"text string, spans {sanitise.SPAN}")
    got = [x[0] for x in row.select(sanitise.redact(F.col("text"), F.col("spans"))).collect()]
    assert got == ["01[EMAIL]cdgh", "plain", ""]


def test_entities_of_one_text_disclose(spark):  # noqa: ANN001
    r = random.Random(4)
    plain = [(k, f"{prose(r, 30)} often") for k in range(400)]
    told = [(500, f"{prose(r, 20)} often Quillfeather writes from quill@example.org and 10.1.2.3")]
    got = {x["doc_id"]: x for x in sanitise.sanitise(spark.createDataFrame(rows(plain + told), SCHEMA)).collect()}
    kinds = {x["m"]: x["k"] for x in got[500]["spans"]}
    assert kinds["Quillfeather"] == 4 and kinds["quill@example.org"] == 0 and "often" not in kinds
    assert not any(x["k"] < 4 for x in got[0]["spans"])


def test_copies_and_small_tables_are_protected(spark):  # noqa: ANN001
    r = random.Random(6)
    told = f"{prose(r, 20)} Quillfeather writes from quill@example.org"
    spans = lambda texts: [{x["m"] for x in row["spans"] if x["k"] > 3} for row in sanitise.sanitise(spark.createDataFrame(rows(list(enumerate(texts))), SCHEMA)).orderBy("doc_id").collect()]
    plain = [prose(r, 30) for _ in range(200)]
    assert all("Quillfeather" in x for x in spans([told] * 100 + plain)[:100])  # a hot group of copies
    assert "Quillfeather" in spans([told, *plain[:3]])[0]  # a small table
    assert "Quillfeather" in spans([told])[0]
    assert not any(spans([f"{t} mail us@example.org" for t in plain[:20]]))  # in every text: no information


def test_token_counts(docs, texts, none):  # noqa: ANN001
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    want = collections.Counter((i, len((t or "").encode()), count(t or "")) for i, t in texts)
    assert counted(token_counts.token_counts(docs, path), "doc_id", "n_bytes", "n_tokens") == want
    assert token_counts.token_counts(none, path).count() == 0
    vocab = token_counts.vocabulary(path)[0]
    words = ["understanding", "日本語の", "naïveté"]
    assert vocab.prefix_counts(words) == [[count(w[:k]) for k in range(1, len(w) + 1)] for w in words]


def test_truncation_needs_no_encoding(spark, docs, texts):  # noqa: ANN001
    """What the table of prefixes says fits a budget does, and one word more doesn't."""
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    lib, vocab = Tokenizer.from_file(path), token_counts.vocabulary(path)[0]
    count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    table = token_counts.prefix_table(docs.where("doc_id IN (5, 9, 11, 60)"), path).select("doc_id", "tokens", *[token_counts.within(F.col("tokens"), b).alias(f"w{b}") for b in (0, 1, 50, 2048, 10**6)])
    known = dict(texts)
    for r in table.collect():
        ws = vocab.words(known[r["doc_id"]])
        assert len(ws) == len(r["tokens"]) and all(r["tokens"][k - 1] == count(" ".join(ws[:k])) for k in (1, 2, len(ws) // 2, len(ws)) if k and r["doc_id"] != 60)
        for budget in (0, 1, 50, 2048, 10**6):
            n = r[f"w{budget}"]
            assert n == sum(x <= budget for x in r["tokens"])


def test_prefixes_within_words():  # noqa: ANN201
    from tokenizers import Tokenizer

    path, r = tokenizer("word_bpe_49k.json"), random.Random(3)
    lib, vocab = Tokenizer.from_file(path), token_counts.vocabulary(path)[0]
    words = ["".join(r.choices("abcdeinorstéß日本", k=r.randint(1, 20))) for _ in range(300)] + ["understanding", "internationalisation", "z" * 70]
    got = vocab.prefix_counts(words)
    want = [[len(e.ids) for e in lib.encode_batch([w[:k] for k in range(1, len(w) + 1)], add_special_tokens=False)] for w in words]
    assert got == want


def test_pieces(spark, docs, texts, none):  # noqa: ANN001
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    want = collections.Counter((i, tuple(lib.encode(t or "")), "▁" not in (t or "")) for i, t in texts)
    got = piece_lattice.encode(docs, path)
    assert collections.Counter((x["doc_id"], tuple(x["ids"]), x["round_trip"]) for x in got.collect()) == want
    assert piece_lattice.encode(none, path).count() == 0
    back = counted(piece_lattice.decode(got, path), "doc_id", "text")
    assert back == collections.Counter((i, lib.decode(lib.encode(t or ""))) for i, t in texts)
    words = [w for w in piece_lattice.WORD.findall(" understanding the  Ananonhé日\nnaïve ☃x" + " ".join(prose(random.Random(9), 60).split()))]
    table = {x["word"]: x["toks"] for x in piece_lattice.lattice(spark.createDataFrame([(w,) for w in words], "word string"), path).collect()}
    vocab = piece_lattice.vocabulary(path)[0]
    for w, ids in zip(words, vocab.encode_words(words), strict=True):
        assert [i for x in table[w] for i in vocab.out(x)] == ids.tolist()


def test_random_tokens():  # noqa: ANN201
    import sentencepiece
    from tokenizers import Tokenizer

    r, letters = random.Random(4), "abcdefghijklmnopqrstuvwxyzéèÀßÜΣ日本語한😀'’\"0123456789 \t\n  -_.,!?#$<|>"
    texts = ["".join(r.choices(letters, k=r.randint(0, 80))) + r.choice(["", "", "<|endoftext|>x", "a" * 90, "      y"]) for _ in range(3000)]
    one, two = tokenizer("word_bpe_49k.json"), tokenizer("piece_bpe_32k.model")
    lib = Tokenizer.from_file(one)
    vocab = token_counts.vocabulary(one)[0]
    assert [sum(c) for c in token_counts.count_words(one, [vocab.words(t) for t in texts])] == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    ids, first = piece_lattice.encode_texts(two, texts)
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:], strict=False)] == sentencepiece.SentencePieceProcessor(model_file=two).encode(texts)


def test_toxicity(spark, docs, none):  # noqa: ANN001
    r = random.Random(6)
    bad = lambda: f"{prose(r, 20)} {r.choice(['grumbler', 'grumblest', 'vilest', 'vileness'])} {prose(r, 20)}"
    known = [(k, bad() if k % 5 == 0 else prose(r, 40)) for k in range(300)]
    later = [(1000 + k, bad() if k % 2 else prose(r, 40)) for k in range(100)]
    table = spark.createDataFrame(rows(known + later), SCHEMA)
    labels = spark.createDataFrame([(k, int(k % 7 > 0), int(k % 5 == 0)) for k in range(300)] + [(5, 1, None), (9999, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in toxicity.judge(table, labels).collect()}
    assert all(got[i]["toxic"] == bool(k % 2) for k, (i, _) in enumerate(later)) and all(x["kept"] != x["toxic"] for x in got.values())
    chain = toxicity.learn_labels(table, labels)
    assert len(chain.models[1].earlier) == 1 and chain.out_of_fold.shape[1] == 2
    assert toxicity.without(table, chain, "toxic").count() == sum(not x["toxic"] for x in got.values())
    assert toxicity.judge(none, labels).count() == 0 and toxicity.judge(docs, labels.limit(0)).where("toxic").count() == 0


def test_toxicity_without_signal(spark, sf):  # noqa: ANN001
    """Few labels, one class only, one positive, labels by chance: nothing is called toxic."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 40")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert toxicity.judge(docs, labels).where("toxic").count() <= 2
    r = random.Random(3)
    table = spark.createDataFrame(rows([(k, prose(r, 30)) for k in range(120)]), SCHEMA)
    for toxic in (lambda k: k == 7, lambda k: 0, lambda k: 1, lambda k: r.random() < 0.5):
        flags = spark.createDataFrame([(k, 1, int(toxic(k))) for k in range(120)], "doc_id long, quality int, toxic int")
        assert toxicity.judge(table, flags).where("toxic").count() == 0
    same = spark.createDataFrame(rows([(k, "the same words in all of them") for k in range(60)]), SCHEMA)
    flags = spark.createDataFrame([(k, 1, k % 2) for k in range(60)], "doc_id long, quality int, toxic int")
    assert toxicity.judge(same, flags).where("toxic").count() == 0


def test_limits():  # noqa: ANN201
    import numpy as np

    y = np.repeat([1.0, 0.0], [20, 80])
    good = np.concatenate([np.linspace(0.8, 0.95, 20), np.linspace(0.05, 0.3, 80)])
    assert 0.3 < toxicity.limit_for(good, good, y) < 0.8
    assert toxicity.limit_for(good, np.full(100, 0.7), y) == toxicity.NEVER
    assert toxicity.limit_for(np.full(100, 0.4), good, y) == toxicity.NEVER
    assert toxicity.limit_for(1 - good, good, y) == toxicity.NEVER
    low = good / 1000  # the out-of-fold limit is far below the final model's probabilities
    assert toxicity.limit_for(low, good, y) == 0.5


def test_recall_of_links(spark):  # noqa: ANN001
    """Every document of a whole table against brute force over all pairs that share a shingle."""
    texts = [(x["doc_id"], x["text"]) for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    sets = [frozenset(map(hash, s)) for s in shingle_sets(texts, 3)]
    holders = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    parent, links = list(range(len(texts))), 0

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a, s in enumerate(sets):
        for b, both in collections.Counter(b for x in s for b in holders[x] if b < a).items():
            if 100 * both >= 85 * (len(s) + len(sets[b]) - both):
                links += 1
                parent[root(a)] = root(b)
    best: dict[int, int] = {}
    for k, (i, _) in enumerate(texts):
        best[root(k)] = min(best.get(root(k), i), i)
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_groups(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), width=3, percent=85).collect()}
    assert links > 50 and got == {i: best[root(k)] if sets[k] else i for k, (i, _) in enumerate(texts)}


def test_very_long_texts(spark):  # noqa: ANN001
    """A text of some megabytes, one word of a megabyte, beside short ones."""
    r = random.Random(11)
    long = prose(r, 300_000)
    texts = [(0, long), (1, long + " end"), (2, "z" * 1_000_000), (3, prose(r, 50))]
    table = spark.createDataFrame(rows(texts), SCHEMA)
    sizes = {i: len(t.split()) for i, t in texts}
    groups = {x["doc_id"]: x for x in near_dedup.near_groups(table).collect()}
    assert [groups[i]["component_id"] for i in range(4)] == [0, 0, 2, 3]
    cut = {x["doc_id"]: x for x in substring_dedup.dedup(table).collect()}
    assert all(cut[i]["n_words"] == n for i, n in sizes.items()) and cut[0]["n_removed"] == sizes[0] == cut[1]["n_removed"] and cut[3]["n_removed"] == 0
    assert exact_dedup.exact_groups(table).where("kept").count() == 4
    assert {x["doc_id"]: x["n_words"] for x in quality_rules.apply_rules(table).collect()} == sizes
    assert all(x["round_trip"] for x in piece_lattice.encode(table, tokenizer("piece_bpe_32k.model")).collect())
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.judge(table, labels).where("kept").count() == 4


def test_word_hashes_do_not_depend_on_slices(monkeypatch):  # noqa: ANN001
    import numpy as np
    import pyarrow as pa
    from sparkloom.llm import wordhash

    r = random.Random(13)
    texts = pa.array([prose(r, r.randint(0, 60)) + r.choice(["", " ", "\n"]) for _ in range(50)] + ["x" * 3000, "", " "])
    whole = wordhash.Words(texts, starts=(3,))
    monkeypatch.setattr(wordhash, "SLICE", 64)
    cut = wordhash.Words(texts, starts=(3,))
    assert all((a == b).all() for a, b in zip([*whole.hashes, whole.first, *whole.begun[3]], [*cut.hashes, cut.first, *cut.begun[3]], strict=True))
    assert len(np.unique(whole.hashes[0])) == len({w for t in texts.to_pylist() for w in t.split()})


PAGES = {
    "<html><body><nav><a href=/>Home</a></nav><article><h1>A  title</h1><p>First &amp; second<br>line.<p>Third <b>bold</b>.</article><footer>(c)</footer>": "A title\n\nFirst & second line.\n\nThird bold.",
    "": "",
    "<script>if (a < b) { x('</p>') }</script><style>p{}</style>": "",
}


def test_html(spark):  # noqa: ANN001
    table = spark.createDataFrame([(i, f"u{i}", h, "x") for i, h in enumerate([*PAGES, None])], "page_id long, url string, html string, text string")
    got = {x["page_id"]: x["text"] for x in html_extraction.main_text(table).collect()}
    assert got == {i: t for i, t in enumerate([*PAGES.values(), ""])}
    assert html_extraction.main_text(table.limit(0)).count() == 0


#: Layouts written by hand, none of them by the trainer's generator: what each page's article is.
LAYOUTS = {
    """<!doctype html><html lang=en><head><title>River floods - The Valley Post</title><link rel=stylesheet href=x.css></head><body class="post-template">
    <div id="top-bar"><a href="/login">Sign in</a> <a href="/sub">Subscribe</a></div><div class="masthead"><a href="/">The Valley Post</a></div>
    <ul class="menu"><li><a href=/n>News</a></li><li><a href=/s>Sport</a></li><li><a href=/w>Weather</a></li></ul>
    <div class="content"><h1>River floods low farms after a week of rain</h1>
    <p>The river rose by two metres on Tuesday night and covered the fields south of the old bridge, the water board said.</p>
    <p>Farmers had moved their cattle to higher ground in time. &ldquo;We watched it come up over an hour,&rdquo; said one of them.</p>
    <p>The road to the mill stays closed until the weekend, and buses go round by the northern bank.</p></div>
    <div class="sidebar"><h3>Most read</h3><ul><li><a href=1>Ten walks</a></li><li><a href=2>New bakery</a></li></ul></div>
    <div class="ad-slot">Advertisement</div>
    <div class="footer"><p>Copyright The Valley Post. All rights reserved.</p><a href=/p>Privacy</a></div></body></html>""": ["River floods low farms", "The river rose by two metres", "Farmers had moved their cattle", "The road to the mill"],
    """<html><body><header><nav><a href="/">Home</a> | <a href="/blog">Blog</a> | <a href="/about">About</a></nav></header><main><article>
    <h2>How we moved our build to one machine</h2><p>Last spring our builds took forty minutes on six machines, and nobody knew why any more.</p>
    <p>So we measured every step, threw out what no one used, and ended with a build of nine minutes on a single one.</p>
    <p>The largest gain came from reading the files once instead of three times.</p></article>
    <section class="comments"><h3>3 comments</h3><div class="comment"><b>ann</b><p>Great write-up, thanks!</p></div><div class="comment"><b>bo</b><p>Did you try caching?</p></div></section></main>
    <aside><form action="/s"><input name=q><button>Search</button></form></aside><footer>Made by hand. <a href="/imprint">Imprint</a></footer>
    <script>var x = "<p>not text</p>";</script></body></html>""": ["How we moved our build", "Last spring our builds", "So we measured every step", "The largest gain came"],
}


def test_html_on_layouts_by_hand():  # noqa: ANN201
    """The article's paragraphs are found on layouts that the trainer never made, and most of the rest is left out."""
    out = html_extraction.main_texts(list(LAYOUTS), html_extraction.weights(str(html_extraction.WEIGHTS)))
    for text, parts in zip(out, LAYOUTS.values(), strict=True):
        got = text.split("\n\n")
        assert [any(x.startswith(p) for x in got) for p in parts] == [True] * len(parts), text
        assert not any(x in text for x in ("Privacy", "Sign in", "Imprint", "not text", "Subscribe", "thanks!")), text


def test_a_page_of_many_blocks():  # noqa: ANN201
    """A page that needs several chunks of vectors and of time steps is labelled as whole."""
    import numpy as np

    page = html_extraction.blocks("<article>" + "".join(f"<p>Paragraph {k} goes on for a while, with words.</p>" for k in range(9000)) + "</article>")
    model = html_extraction.weights(str(html_extraction.WEIGHTS))
    whole = html_extraction.label([page], model)[0]
    before, html_extraction.CHUNK = html_extraction.CHUNK, 10**6
    try:
        assert np.allclose(html_extraction.label([page], model)[0], whole, atol=1e-4)
    finally:
        html_extraction.CHUNK = before


def test_html_on_unseen_layouts():  # noqa: ANN201
    from sparkloom.llm import html_training

    pages, labels = html_training.samples(150, 12345)
    right = [((p >= 0.5) == (y > 0)).mean() for p, y in zip(html_extraction.label(pages, html_extraction.weights(str(html_extraction.WEIGHTS))), labels, strict=True) if len(y)]
    assert sum(right) / len(right) > 0.97


def test_tables_of_hashes_are_not_compressed(spark):  # noqa: ANN001
    """Near-duplicate search writes many tables of hashes; compressing them takes buffers outside the heap and saves nothing."""
    import pyarrow.parquet as pq

    from sparkloom.llm import near_dedup

    written = near_dedup.cut(spark.range(10), "test").inputFiles()[0].removeprefix("file:")
    assert pq.ParquetFile(written).metadata.row_group(0).column(0).compression == "UNCOMPRESSED"
