"""Every operator and stage on small fixtures with nulls, empty and long texts, ties, repeated rows and clashing names, and against brute force."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from test_llm_small import brute_simhash, page
from tokenizers import Tokenizer

import corpus_pipeline
from quillsieve.llm import components, fingerprints, html, langid, mixing, near_copies, packing, quality, queries, rules, simhash, token_files, urls

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "The very long text goes on and on with word{} again. "
ROWS = [
    (1, "The cat sat on the mat and then it went to the house of a man.", "en", "b"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, "   \n\t ", None, "a"),
    (5, "".join(LONG.format(i) for i in range(3000)), "en", "a"),
    (6, "one two three", "en", "é"),
    (7, "one two three", "en", "é"),
    (8, "ONE two  three", "en", "z"),
    (8, "ONE two  three", "en", "z"),
    (9, "x y x y x y x y x y x y x y x y", "fr", "z"),
    (10, "le chat est sur la table et il mange une pomme dans la maison\nle chat\nle chat", "fr", "b"),
    (None, "no id here", "en", "b"),
    (None, "no id here", "en", "b"),
    (11, "😀 émoji ### && %%\n\n😀", "de", None),
    (12, "² ½ Ⅷ ① 3", "de", "b"),
    (13, "it ends <|endoftext|> here <|startoftext|>", "en", "b"),
]
CLASHING = {"u": 1, "size": 2, "copies": 3, "row": 4, "share": 5, "sketch": 6, "rule": 7, "host": 8, "score": 9, "fp": 10, "range": 11, "ids": 12, "count": 13, "quality": 14, "uid": 15, "m": 16, "_quality": 17, "_lang_pred": 18, "a.b": 19, "_again": 20, "_key": 21, "u`v": 22, "_hot": 23, "component_id": 24, "node": 25}
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    return df.select("*", *[F.lit(v).alias(k) for k, v in CLASHING.items()])


@pytest.fixture(scope="module")
def empty(spark, docs):
    return docs.where("false")


def frame(spark, sf, name):
    return pd.read_parquet(f"{sf}/{name}.parquet")


def with_sql(name, tables):
    con = duckdb.connect()
    for k, v in tables.items():
        con.register(k, v)
    return con.execute(queries.ORACLES[name]).fetchdf()


def test_every_operator_is_registered():
    assert [re.match(r"op(\d+)_", n)[1] for n in queries.QUERIES] == [str(i) for i in range(1, 11)]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["identify_language", "classify_quality", "drop_near_duplicates", "mix_sources", "pack_sequences"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = with_sql(name, {"documents": frame(spark, SF, "documents")})[list(got.columns)]
    a, b = (x.sort_values("doc_id").reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b)


def mix_rows(d):
    return sorted((str(x).removesuffix(".0"), int(s), round(float(g), 6), int(k)) for x, s, g, k in zip(d.doc_id, d["size"], d.target, d.taken, strict=True))


def mix_by_sql(rows):
    return mix_rows(with_sql("op1_pareto_mix", {"documents": pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"})}))


def show_ids(rows):
    return sorted((str(x).replace("<NA>", "None").replace("nan", "None"), *more) for x, *more in rows)


def test_mix_of_odd_rows(docs, empty):
    got = mixing.pareto_mix(docs).toPandas()
    assert show_ids(mix_rows(got)) == show_ids(mix_by_sql(ROWS))
    assert len(got) == len(ROWS) and (got.taken <= 3 * got["size"]).all() and got.taken.dtype == "int64"
    assert mixing.pareto_mix(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns and rows.count() == got.copies.sum()


TIED = [
    {"a": [10] * 10, "b": [10] * 10, "c": [10] * 10, "d": [10] * 10},  # a and d tie in size over weight
    {"a": [100] * 10, "b": [40] * 10},
    {"a": [1] * 5, "b": [1] * 2, "c": [1]},
    {"a": [7] * 9, None: [3] * 30, "b": [50]},
]


@pytest.mark.parametrize(("sources", "ids"), [*((x, "equal") for x in TIED), (TIED[0], "unlike"), (TIED[3], "unlike"), (TIED[3], "null")])
def test_mix_of_tied_sources_and_repeated_ids(spark, sources, ids):
    rows = [({"unlike": k, "equal": 1, "null": None}[ids], "w " * n, "en", s) for s, sizes in sources.items() for k, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.pareto_mix(df).toPandas()
    assert show_ids(mix_rows(got)) == show_ids(mix_by_sql(rows))
    by = got.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), least=("size", "min"))
    assert by.target.sum() == pytest.approx(by["size"].sum()) and (by.target <= 3 * by["size"] + 1e-9).all()
    assert (abs(by.taken - by.target) <= by.least / 2 + 1e-9).all()
    assert mixing.mixed_rows(df).count() == got.copies.sum()


def test_mix_comes_near_its_targets(spark):
    got = mixing.pareto_mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"))
    assert (abs(by.taken - by.target) <= 0.02 * by.target).all()
    assert by.target.sum() == pytest.approx(by["size"].sum())


def test_targets_are_reshared(spark):
    sizes = spark.createDataFrame([("a", 1), ("b", 1000), ("c", 50), ("d", 0), (None, 10)], "source string, source_size long")
    got = {r["source"]: r for r in mixing.source_targets(sizes).collect()}
    share, capped = {}, set()
    while True:  # by hand
        left = 1061 - sum(3 * got[s]["source_size"] for s in capped)
        free = {s: w for s, w in zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True) if s not in capped}
        share = {s: left * w / sum(free.values()) for s, w in free.items()}
        over = {s for s in free if share[s] > 3 * got[s]["source_size"]}
        if not over:
            break
        capped |= over
    for s, r in got.items():
        assert r["target"] == pytest.approx(share.get(s, 3 * r["source_size"]))


def brute_sketch(text: str, k: int = 128) -> list[int]:
    words = WORD.findall(text or "")
    hashes = set()
    for i in range(max(1, len(words) - 4) if words else 0):
        h = 42
        for w in words[i : i + 5]:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        hashes.add(h - 2**64 if h >= 2**63 else h)
    return sorted(hashes)[:k]


def brute_near(a: list[int], b: list[int], k: int = 128) -> float:
    if not a and not b:
        return 1.0
    union = sorted(set(a) | set(b))[:k]
    return len(set(a) & set(b) & set(union)) / len(union)


def check_fingerprints(got: pd.DataFrame, rows: list[tuple]):
    rows = sorted(rows, key=lambda r: r[0])
    got = got.set_index("doc_id")
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        text, after = text or "", after or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        r, a, b = got.loc[i], brute_sketch(text), brute_sketch(edited)
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == "".join(f"{x & 0xFFFFFFFFFFFFFFFF:016x}" for x in a)
        assert r["edited_fingerprint"] == "".join(f"{x & 0xFFFFFFFFFFFFFFFF:016x}" for x in b)
        assert r["near_edited"] == pytest.approx(brute_near(a, b)) and r["near_next"] == pytest.approx(brute_near(a, brute_sketch(after)))


def digest(pairs):
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("sketch")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprints.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprints.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    ).toPandas()


def test_fingerprints(spark, docs, empty):
    single = [(i, t) for i, t, *_ in ROWS if i not in (8, None)]
    check_fingerprints(digest(fingerprints.fingerprint_edits(docs.where("doc_id <> 8"))), single)
    check_fingerprints(digest(fingerprints.fingerprint_edits(docs.where("doc_id = 5"))), [r for r in single if r[0] == 5])
    assert fingerprints.fingerprint_edits(docs).count() == len(ROWS) and fingerprints.fingerprint_edits(empty).count() == 0
    assert fingerprints.fingerprint_edits(docs.where("doc_id is null")).count() == 2
    named = digest(fingerprints.fingerprint_edits(docs.where("doc_id <> 8").withColumn("doc_id", F.format_string("d%03d", "doc_id"))))
    check_fingerprints(named.assign(doc_id=named.doc_id.str[1:].astype(int)), single)
    whole = frame(spark, SF, "documents")
    check_fingerprints(queries.op2_bottom_k(spark, SF).toPandas(), list(zip(whole.doc_id, whole.text, strict=True)))


def test_sketches_merge_and_estimate(spark):
    text = " ".join(f"w{i}" for i in range(4000))
    parts = spark.createDataFrame([(k % 2, " ".join(f"w{i}" for i in range(40 * k, 40 * k + 44))) for k in range(100)], "k int, text string")
    parts = parts.select("k", fingerprints.sketch(F.col("text")).alias("s"))
    merged = fingerprints.merge_sketches(parts.withColumn("k", F.lit(0)), "k", "s", fan_in=7).first()["s"]
    assert merged == spark.createDataFrame([(text + " w4000 w4001 w4002 w4003",)], "text string").select(fingerprints.sketch(F.col("text")).alias("s")).first()["s"]
    half = " ".join(f"w{i}" for i in range(2000))
    r = spark.createDataFrame([(text, half)], "a string, b string").select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    r = r.select(fingerprints.resemblance(F.col("a"), F.col("b")), fingerprints.containment(F.col("b"), F.col("a")), fingerprints.containment(F.col("a"), F.col("b")), fingerprints.distinct_shingles(F.col("a"))).first()
    assert r[0] == pytest.approx(0.5, abs=0.15) and r[1] > 0.8 and r[2] == pytest.approx(0.5, abs=0.2) and r[3] == pytest.approx(3996, rel=0.3)


URLS = ["http://A.Example.ORG/es/1", "https://example.org/en/12?x", "https://example.org/en/2#y", "ftp://com", "x://fr.com/fr/", "http://com/de/x", "http://notorg/x", "no scheme", None, "", "http://b.net/q?a=://z/", "http://ORG", "http://b.net/" + "long/" * 3000, "http://b.net/q"]


def brute_rule(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({i: i + 32 for i in range(65, 91)}), m[2]) if m else ("", "")
    fits = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best.name if best else None, best.verdict if best else None


def brute_model(labelled):
    """log-ratio of the last character of a gram, by back-off in plain recursion."""
    n = {}
    for url, ok in labelled:
        c = "^^^" + url.lower()
        for i in range(3, len(c)):
            for k in range(1, 5):
                n.setdefault(c[i - k + 1 : i + 1], [0, 0])[0 if ok else 1] += 1
    follow = {}
    for g, (a, b) in n.items():
        x = follow.setdefault(g[:-1], [[0, 0], [0, 0]])
        for k, v in enumerate((a, b)):
            x[k][0] += v
            x[k][1] += v > 0

    def p(g, k):
        low = p(g[1:], k) if len(g) > 1 else 1 / 256
        total, kinds = follow.get(g[:-1], [[0, 0], [0, 0]])[k]
        return (n.get(g, [0, 0])[k] + kinds * low) / (total + kinds) if total else low

    def score(url):
        c = "^^^" + url.lower()
        return sum(math.log(p(c[i - 3 : i + 1], 0) / p(c[i - 3 : i + 1], 1)) for i in range(3, len(c))) / max(1, len(url)) if url else 0.0

    return score


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, 1, "x") for i, u in enumerate(URLS)], "page_id long, url string, rule int, host string")
    got = {r["page_id"]: r for r in urls.filter_urls(pages, queries.URL_RULES).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = brute_rule(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule) and got[i]["verdict"] in ("allow", "block")
        assert verdict is None or got[i]["verdict"] == verdict
    assert urls.filter_urls(pages.where("false"), queries.URL_RULES).count() == 0
    unlabelled = urls.filter_urls(pages.where("url like '%b.net%'"), queries.URL_RULES)
    assert {r["verdict"] for r in unlabelled.collect()} == {"allow"}


def test_url_scores_equal_brute_force(spark):
    given = frame(spark, SF, "pages").url
    labelled = [(u, brute_rule(u)[3] == "allow") for u in given if brute_rule(u)[2] and zlib.crc32(u.encode()) % 4 != 2]
    score = brute_model(labelled)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in urls.filter_urls(pages, queries.URL_RULES).collect():
        if r["rule"] is None:
            assert r["score"] == pytest.approx(score(r["url"]), abs=0.002)


def test_a_model_that_does_not_fit_the_plan_scores_alike(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    odd = [(10**6 + i, u) for i, u in enumerate(URLS)] + [(10**6, URLS[-1])] + [(10**6 + 50, "http://long.net/" + "abc/" * 5000), (10**6 + 50, "http://long.net/" + "abc/" * 5000)]
    pages = pages.union(spark.createDataFrame(odd, "page_id long, url string"))
    whole, joined = (sorted(map(str, urls.filter_urls(pages, queries.URL_RULES, most).collect())) for most in (1 << 20, 10))
    assert whole == joined


def brute_components(fps: dict) -> dict:
    items = list(fps.items())
    parent = list(range(len(items)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if (items[i][1] ^ items[j][1]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, ((d, *_), _) in enumerate(items):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return {k: least.get(find(i)) for i, (k, _) in enumerate(items)}


@pytest.mark.parametrize("block", [2048, 3])
def test_near_duplicates(spark, docs, empty, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)  # 3: every group of anchors is compared in blocks
    base = " ".join(f"word{i} of" for i in range(400))
    near = [(100 + i, base.replace(f"word{7 * i} ", f"other{i} "), None, None) for i in range(25)]
    extra = spark.createDataFrame(near, SCHEMA)
    every = docs.select("doc_id", "text", "lang", "source").union(extra)
    got = simhash.near_duplicates(every).collect()
    want = brute_components({(d, k): brute_simhash(t) for k, (d, t, *_) in enumerate(ROWS + near)})
    assert sorted((r["doc_id"] or 0, r["fp"] & 0xFFFFFFFFFFFFFFFF, r["component_id"] or 0) for r in got) == sorted((d or 0, brute_simhash(t), want[d, k] or 0) for k, (d, t, *_) in enumerate(ROWS + near))
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] or 0 for r in kept.select("doc_id").collect())
    assert ids == sorted({d for (d, k), c in want.items() if d is not None and d == c and d < 100} | {0})


def five_words(text) -> frozenset:
    w = (text or "").translate({i: i + 32 for i in range(65, 91)}).split()
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_near_copies(texts: dict) -> dict:
    """The least id of each id's component of pairs with a five-word similarity of 0.8 or more."""
    sets = {d: five_words(t) for d, t in texts.items()}
    holders, least = {}, {d: d for d in texts}
    for d, s in sets.items():
        for x in s or {""}:
            holders.setdefault(x, []).append(d)
    pairs = {(a, b) for ds in holders.values() for k, a in enumerate(ds) for b in ds[:k]}

    def find(d):
        while least[d] != d:
            d = least[d]
        return d

    for a, b in pairs:
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            least[max(a, b)] = min(a, b)
    return {d: find(d) for d in texts}


@pytest.mark.parametrize("small", [False, True])
def test_the_pipeline_finds_near_copies_of_five_words(spark, docs, empty, monkeypatch, small):
    if small:  # every key and cluster is compared in several blocks
        monkeypatch.setattr(near_copies, "BLOCK", 3)
        monkeypatch.setattr(near_copies, "SETS", 3)
    whole = frame(spark, "/root/testdata/sf0.01", "documents")
    texts = dict(zip(whole.doc_id, whole.text, strict=True))
    base = [f"w{i}" for i in range(200)]
    for k in range(12):  # a chain, of which only neighbours are near, and copies that differ in case
        texts[10**6 + k] = " ".join(base[6 * k :] + [f"v{i}" for i in range(6 * k)])
    texts[10**6 + 50], texts[10**6 + 51], texts[10**6 + 52] = " ".join(base).upper(), None, ""
    want = brute_near_copies(texts)
    assert sum(d != c for d, c in want.items()) > 11
    every = spark.createDataFrame([(int(d), t) for d, t in texts.items()], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(every).collect()} == want
    kept = corpus_pipeline.drop_near_duplicates(spark, every, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert near_copies.near_copies(docs).count() == len(ROWS) and near_copies.near_copies(empty).count() == 0


def test_forests_of_near_sets_span_all_links():
    rng = np.random.default_rng(1)
    texts = [" ".join("x" + str(rng.integers(10**6)) if i in edits else f"w{i}" for i in range(60)) for edits in (rng.integers(0, 60, rng.integers(0, 5)).tolist() for _ in range(120))]
    sets = [near_copies.shingles(t) for t in texts]
    want = brute_near_copies(dict(enumerate(texts)))
    links = near_copies.forest(np.arange(120), 120, near_copies.near_sets(sets))
    halves = near_copies.forest(np.arange(60), 60, near_copies.near_sets(sets[:60])) + [(i + 60, j + 60) for i, j in near_copies.forest(np.arange(60), 60, near_copies.near_sets(sets[60:]))]
    halves += near_copies.forest(np.arange(120), 60, near_copies.near_sets(sets))
    for found in (links, halves):
        least = list(range(120))
        for _ in range(120):
            for i, j in found:
                least[i] = least[j] = min(least[i], least[j])
        assert dict(enumerate(least)) == want
    assert len(links) == 120 - len(set(want.values()))


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000, 1000 + i) for i in range(200)] + [(2000 + i, 2001 + i) for i in range(60)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def jobs_of(spark, name, run):
    """What run returns, and how many jobs it took."""
    spark.sparkContext.setJobGroup(name, name)
    found = run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_few_links_take_few_jobs(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join(words[6 * k :] + [f"v{i}" for i in range(6 * k)])) for k in range(12)]  # a chain of near copies
    every = spark.createDataFrame(rows, "doc_id long, text string")
    found, jobs = jobs_of(spark, "near copies", lambda: near_copies.near_copies(every).collect())
    assert {r["component_id"] for r in found} == {0} and len(found) == 12
    assert jobs < 100


def test_one_task_and_rounds_unite_alike(spark, monkeypatch):
    rng = np.random.default_rng(7)
    edges = [(int(a), int(b)) for a, b in rng.integers(-300, 300, (400, 2))] + [(5000, 5000 - i) for i in range(100)] + [(9000 + 7 * i % 90, 9000 + 7 * (i + 1) % 90) for i in range(80)]
    edges = spark.createDataFrame([*edges, *edges[:50], (2**63 - 1, -(2**63))], "a long, b long")
    alone, jobs = jobs_of(spark, "alone", lambda: sorted(components.components(edges).collect()))
    monkeypatch.setattr(components, "ALONE", 0)
    rounds, more = jobs_of(spark, "rounds", lambda: sorted(components.components(edges).collect()))
    assert alone == rounds and len({r["node"] for r in alone}) == len(alone) and jobs < more


def held_out(i) -> bool:
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op5_line_crf(spark, sf).toPandas()
    labels = frame(spark, sf, "labels").merge(got, on="doc_id")
    assert (got.held_out == got.doc_id.map(held_out)).all() and len(got) == 10_000 and got.score.between(0, 1).all()
    assert ((got.score >= 0.7).astype(int) == got.predicted).all()
    own = labels[labels.held_out]
    assert (own.quality == own.predicted).mean() > 0.97


def brute_quality(model, text):
    """The score by one chain in plain Python: forward and backward sums over good and bad, and the length-weighted share of bad."""
    x, lengths, _ = quality.line_features([text or ""])
    emit = [(1.0, math.exp(min(30, max(-30, sum(a * b for a, b in zip(row, model.emission, strict=True)))))) for row in x.tolist()]
    t = [[math.exp(v) for v in row] for row in model.transition.tolist()]
    norm = lambda v: [a / sum(v) for a in v]
    forward = [norm(emit[0])]
    for e in emit[1:]:
        forward.append(norm([e[j] * sum(forward[-1][i] * t[i][j] for i in (0, 1)) for j in (0, 1)]))
    backward = [[1.0, 1.0]]
    for e in emit[:0:-1]:
        backward.append(norm([sum(t[i][j] * e[j] * backward[-1][j] for j in (0, 1)) for i in (0, 1)]))
    bad = [f[1] * b[1] / (f[0] * b[0] + f[1] * b[1]) for f, b in zip(forward, backward[::-1], strict=True)]
    share = sum(p * n for p, n in zip(bad, lengths.tolist(), strict=True)) / sum(lengths.tolist())
    return 1 / (1 + math.exp(-(model.offset + model.slope * share)))


def test_quality_equals_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    model = quality.train(docs, labels)
    texts = dict(frame(spark, SF, "documents")[["doc_id", "text"]].itertuples(index=False))
    got = queries.op5_line_crf(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["score"] == pytest.approx(brute_quality(model, texts[r["doc_id"]]), abs=1e-9) and r["predicted"] == (r["score"] >= 0.7)


def test_quality_of_odd_rows(docs, empty, spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 12)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, quality.train(docs, labels))
    assert got.where("score between 0 and 1").count() == len(ROWS) and quality.train(docs, labels.where("quality = 1")) is None
    assert quality.classify(empty, quality.train(empty, labels)).count() == 0
    assert {r[0] for r in quality.classify(docs, None).select("score").collect()} == {0.5}


def test_language_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op9_language_codes(spark, sf).toPandas().merge(frame(spark, sf, "documents"), on="doc_id")
    assert (got.held_out == got.doc_id.map(held_out)).all() and len(got) == 10_000 and got.score.between(0, 1).all()
    own = got[got.held_out]
    assert (own.lang == own.lang_pred).mean() > 0.99


def brute_language(model, text):
    """The language whose codeword loses least, trigram by trigram."""
    folded = text.encode().translate(langid._FOLD)
    b = [32, *folded, 32]
    slots = [(x * 961 + y * 3571 + z * 57) % langid.DIMS for x, y, z in zip(b, b[1:], b[2:], strict=False)]
    margins = [sum(float(model.weights[s, k]) for s in slots) * langid.SCALE / max(1, len(slots)) + float(model.bias[k]) for k in range(model.code.shape[1])]
    losses = [sum(math.log1p(math.exp(-m * int(c))) for m, c in zip(margins, word, strict=True)) for word in model.code]
    shares = [math.exp(min(losses) - x) for x in losses]
    return model.languages[losses.index(min(losses))], max(shares) / sum(shares)


def test_language_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    texts = dict(frame(spark, SF, "documents")[["doc_id", "text"]].itertuples(index=False))
    got = queries.op9_language_codes(spark, SF).collect()
    assert len(got) == len(texts)
    for r in sorted(got, key=lambda r: len(texts[r["doc_id"]] or ""))[:60]:
        if r["lang_pred"] != "und":
            lang, score = brute_language(model, texts[r["doc_id"]])
            assert r["score"] == pytest.approx(score, abs=1e-3) and (r["lang_pred"] == lang or score < 0.55)


def test_every_language_is_learned_from_a_bounded_sample(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 80)
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 40 * 500)
    monkeypatch.setattr(langid, "fit", lambda texts, langs: Counter(langs) | {"": sum(map(len, texts))})
    rows = [(i, ("word " * 20) + chr(97 + i % 40 % 26), f"l{i % 40:02}", "s") for i in range(4000)]
    found = langid.train(spark.createDataFrame(rows, SCHEMA))
    assert len(found) == 41 and max(n for k, n in found.items() if k) <= 8 and found[""] <= 40 * 500


def test_training_gives_memory_back(spark, monkeypatch):
    calls = []
    for module in (langid, quality):
        monkeypatch.setattr(module, "give_back", lambda: calls.append(1))
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet") for name in ("documents", "labels"))
    assert langid.train(documents) and quality.train(documents, labels) and len(calls) == 2


def test_language_of_odd_rows(docs, empty):
    got = langid.identify(docs, langid.train(docs)).select("row.text", "lang_pred", "score").collect()
    for r in got:
        assert (r["lang_pred"] == "und") == (not regex.search(r"\p{L}", r["text"] or "")) and 0 <= r["score"] <= 1
    assert langid.train(empty) is None and langid.identify(empty, None).count() == 0 and langid.train(docs.where("lang is null")) is None


def brute_rules(text):
    text = text or ""
    w = WORD.findall(text)
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(wins)
    covered = {i + k for i, x in enumerate(wins) if often[x] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rules(docs, empty):
    got = {(r["doc_id"]): r for r in rules.judge(docs).collect()}
    for i, text, *_ in ROWS:
        r = got[i]
        assert tuple(r[1:6]) == brute_rules(text) and r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert got[1]["kept"] and not got[5]["kept"] and not got[11]["kept"] and rules.judge(empty).count() == 0


def test_rules_keep_what_is_labelled_good(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op7_quality_rules(spark, sf).toPandas().merge(frame(spark, sf, "labels"), on="doc_id")
    usable = got[~got.base_failed]
    assert usable[usable.quality == 1].kept.mean() > 0.99 and usable[usable.quality == 0].kept.mean() < 0.1


def ids_of(name, texts, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [[*e.ids, end] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check_packing(got: pd.DataFrame, rows: list[tuple], capacity: int):
    want = []
    for (i, _), ids in zip(rows, ids_of("word_bpe_49k.json", [t for _, t in rows], 1), strict=True):
        want += [(i or 0, k, a, len(ids[a : a + capacity]), zlib.crc32(np.array(ids[a : a + capacity], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]
    got["doc_id"] = got.doc_id.fillna(0).astype(int)
    assert sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    filled = got.groupby("sequence_id").length.sum()
    assert filled.max() <= capacity
    return len(filled), -(-got.length.sum() // capacity)


def test_packing(spark, docs, empty, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.best_fit_pack(docs, path, "dropped", 1, 64).toPandas()
    used, least = check_packing(got, [(r[0], r[1]) for r in ROWS], 64)
    assert used <= least + 2
    assert packing.best_fit_pack(empty, path, "dropped", 1).count() == 0
    whole = frame(spark, SF, "documents")
    used, least = check_packing(queries.op6_grouping_ga(spark, SF).toPandas(), list(zip(whole.doc_id, whole.text, strict=True)), 4096)
    assert used == least
    items = spark.range(3000).select(F.col("id").alias("uid"), (F.pmod(F.xxhash64("id"), F.lit(60)) + 1).alias("length"))
    placed = packing.pack(items, 100, block=64).toPandas()
    assert len(placed) == 3000 and placed.groupby("sequence_id").length.sum().max() <= 100
    assert placed.sequence_id.nunique() <= 1.03 * placed.length.sum() / 100 + 1


def test_packing_evolves_where_best_fit_fails(spark, monkeypatch):
    """Triplets that fill bins exactly: longest-first best fit needs more bins, so islands run."""
    rng, own = np.random.default_rng(5), []
    for _ in range(40):
        a, b = int(rng.integers(26, 49)), int(rng.integers(26, 34))
        own += [a, b, 100 - a - b]
    first = len(packing.best_fit([], list(range(120)), own, 100))
    items = spark.createDataFrame(list(enumerate(own)), "uid long, length long")
    monkeypatch.setattr(packing, "GENERATIONS", 60)
    placed = packing.pack(items, 100).toPandas()
    assert len(placed) == 120 and placed.groupby("sequence_id").length.sum().max() <= 100
    assert 40 <= placed.sequence_id.nunique() < first
    ran = []
    monkeypatch.setattr(packing, "_evolved", lambda *a: ran.append(a))
    even = spark.range(64).select(F.col("id").alias("uid"), F.lit(25).cast("long").alias("length"))
    assert packing.pack(even, 100).select("sequence_id").distinct().count() == 16 and not ran


def test_token_files(spark, docs, empty, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = token_files.encode_and_read_back(docs.where("doc_id is not null"), path, "kept", 0, 2).toPandas().sort_values("start")
    rows = sorted([(r[0], r[1]) for r in ROWS if r[0] is not None], key=lambda r: r[0])
    ids = ids_of("byte_bpe_50k.json", [t for _, t in rows], 0)
    assert got.doc_id.tolist() == [i for i, _ in rows] and got.n_tokens.tolist() == [len(x) for x in ids]
    assert got.start.tolist() == np.concatenate([[0], np.cumsum([len(x) for x in ids])[:-1]]).tolist()
    assert got.ids_crc32.tolist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    assert token_files.encode_and_read_back(empty, path, "kept", 0).count() == 0
    with pytest.raises(TypeError):
        token_files.encode_and_read_back(docs.withColumn("doc_id", F.col("doc_id").cast("string")), path, "kept", 0)
    token_files.write_token_files(docs, str(tmp_path / "t"), path, "kept", 0, 4, block_ids=50)
    back = token_files.read_token_files(spark, str(tmp_path / "t")).toPandas().sort_values("start")
    assert len(back) == len(ROWS) and back.doc_id.isna().sum() == 2 and back.doc_id.isna().tolist()[-2:] == [True, True]
    known = back[back.doc_id.notna()]
    assert [list(x) for x in known.ids] == ids
    whole = frame(spark, SF, "documents").sort_values("doc_id")
    got = queries.op8_elias_fano(spark, SF).toPandas().sort_values("doc_id")
    assert got.ids_crc32.tolist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids_of("byte_bpe_50k.json", whole.text, 0)]


def test_html_by_host(spark):
    rows = [(k, f"http://h{k % 2}.org/{k}", page(k)[0], 1) for k in range(30)] + [(90, None, None, 1), (91, "x", "", 1), (91, "x", "", 1), (92, "http://h0.org/", "<b>other</b>", 1), (None, "http://h0.org/", page(3)[0], 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = html.extract_pages(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["n_chars"] == len(r["text"])
        if r["page_id"] is not None and r["page_id"] < 30:
            assert r["text"] == page(r["page_id"])[1]
    assert html.extract_pages(df.where("false")).count() == 0


def test_html_of_the_pages(spark):
    got = queries.op10_html_wrappers(spark, SF).toPandas().merge(frame(spark, SF, "pages"), on="page_id")
    import html as entities

    for text, source in zip(got.text, got.html, strict=True):
        article = re.search(r"<article>(.*)</article>", source, re.S)[1]
        assert text == " ".join(entities.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", article))).split())


def test_repeated_links_are_united_by_task(spark, monkeypatch):
    monkeypatch.setattr(components, "ALONE", 400)
    edges = spark.range(0, 20_000, 1, 9).selectExpr("id % 100 * 3 AS a", "id % 100 * 3 + 1 + id % 2 AS b")
    found, whole = components._contracted(edges)
    assert whole and sorted(found.collect()) == sorted(((3 * k + i, 3 * k) for k in range(100) for i in ((0, 1) if k % 2 == 0 else (0, 2))))
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 3000, (2, 2000))
    parts = [pa.RecordBatch.from_arrays([pa.array(x[k : k + 150]) for x in (a, b)], names=["a", "b"]) for k in range(0, 2000, 150)]
    out = list(components._united(iter(parts)))  # nodes are too many for 400 at once
    assert len(out) > 1
    x, y = (np.concatenate([o.column(k).to_numpy() for o in out]) for k in (0, 1))
    assert all((p == q).all() for p, q in zip(components.united(x, y), components.united(a, b), strict=True))


def test_stages_keep_columns_and_take_odd_rows(spark, docs, empty):
    labels_dir = SF
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, labels_dir)
        assert rows.columns == docs.columns, name
        assert stage(spark, empty, labels_dir).count() == 0, name
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, empty, labels_dir).count() == 0 and last(spark, docs, labels_dir).count() >= len(ROWS)


def test_pipeline(spark):
    got = corpus_pipeline.run(spark, SF).toPandas()
    docs = frame(spark, SF, "documents").set_index("doc_id")
    labels = frame(spark, SF, "labels").set_index("doc_id")
    ids = set(got.doc_id)
    assert not ids & set(labels[labels.quality == 0].index[labels[labels.quality == 0].index.map(lambda i: not held_out(i))])
    assert docs.loc[sorted(ids)].text.is_unique and got.groupby("sequence_id").length.sum().max() <= 4096
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 4096) + 1
