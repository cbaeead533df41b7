"""Near duplicates, substring removal, URL rules, mixing, WARC, pipeline: awkward rows and brute force."""
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clientele.llm import (language_id, minhash_dedup, minhash_kernel, mix_sources, pack_tokens, substring_dedup, substring_kernel,
                           url_filter, warc)
from clientele.llm.common import shared_path, shingles
from clientele.llm.components import connected_components
from tests.conftest import SMOKE_DIR
from tests.llm.test_text_operators import words_of

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = SPACE.findall((text or "").translate(UPPER))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(docs):
    """doc_id -> (set size, smallest id reachable) by comparing all pairs."""
    sets = {d: shingle_set(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                a_, b_ = find(a), find(b)
                root[max(a_, b_)] = min(a_, b_)
    return {d: (len(s), find(d)) for d, s in sets.items()}


# -- near duplicates ---------------------------------------------------------

def test_near_duplicates_match_brute_force(awkward, empty):
    rows = awkward.collect()
    expected = brute_components({r["doc_id"]: r["text"] for r in rows if r["doc_id"] is not None}.items())
    got = minhash_dedup.near_duplicates(awkward).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])
        else:
            assert r["component_id"] is None and r["kept"]
    stayed = minhash_dedup.drop_near_duplicates(awkward)
    assert stayed.columns == awkward.columns
    ids = Counter(r["doc_id"] for r in stayed.collect())
    assert ids.pop(None) == 2
    assert ids == Counter(d for d, (_, c) in expected.items() if d == c)
    assert minhash_dedup.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("blocks", [(1 << 21, 1 << 24), (6000, 9000)])
def test_links_between_members_far_from_the_centre(spark, monkeypatch, blocks):
    """A chain of ever more edited copies: neighbours are linked, distant ones are not, centres see few of them."""
    monkeypatch.setattr(minhash_dedup, "QUERY_BYTES", blocks[0])
    monkeypatch.setattr(minhash_dedup, "DATA_BYTES", blocks[1])
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(40):
        docs.append((i, " ".join(words)))
        for j in rng.integers(0, 200, 2):
            words[j] = f"n{i}x{j}"
    order = rng.permutation(40)
    docs = [(int(order[i]), t) for i, t in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    expected = brute_components(docs)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(df).collect()} == expected


def test_residual_links_grow_with_the_members(spark):
    """Copies of one base with five words changed each: linked to few centres, yet at most one link per row and block."""
    counts = {}
    for n in (50, 200):
        rng = np.random.default_rng(4)
        docs = []
        for i in range(n):
            words = [f"w{k}" for k in range(400)]
            for j in rng.integers(0, 400, 5):
                words[j] = f"n{i}x{j}"
            docs.append((i, " ".join(words)))
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(df).collect()} == brute_components(docs)
        rows = df.withColumnRenamed("doc_id", "id")
        profile = minhash_dedup._profiles(rows).cache()
        members = profile.selectExpr("id as rep", "explode(bands) as key")
        members = members.join(members.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("c")).where("c > 1"), "key").select("key", "hub", "rep")
        none = spark.createDataFrame([], "node long, label long")
        counts[n] = minhash_dedup._residual_links(members, none, minhash_dedup._full_sets(rows).cache(), 75).count()
        assert 0 < counts[n] <= members.count() - members.select("key").distinct().count() <= 40 * n


def test_repeated_ids_with_other_texts_are_documents_of_their_own(spark):
    rng = random.Random(6)
    text = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(5)]
    near = text[1].rsplit(" ", 1)[0] + " end"
    rows = [(7, text[0]), (7, text[1]), (7, text[2]), (7, text[2]), (3, text[0]), (9, near), (4, text[3]), (None, text[4]), (None, None), (5, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = Counter((r["doc_id"], r["component_id"], r["n_shingles"]) for r in minhash_dedup.near_duplicates(df).collect())
    assert got == Counter([(7, 3, 56), (7, 7, 56), (7, 7, 56), (7, 7, 56), (3, 3, 56), (9, 7, 56), (4, 4, 56), (None, None, 56), (None, None, 0), (5, 5, 0), (5, 5, 0)])
    kept = Counter(map(tuple, minhash_dedup.drop_near_duplicates(df).collect()))
    assert kept == Counter([(7, text[1]), (7, text[2]), (3, text[0]), (4, text[3]), (None, text[4]), (None, None), (5, None), (5, "")])


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for n, share in ((3, 1), (8, 0.5), (400, 0.8)):
        pool = np.sort(rng.integers(0, 1 << 63, 2 * n).astype(np.uint64))
        a, b = pool[:n], np.concatenate([pool[:int(n * share)], pool[n:2 * n - int(n * share)]])
        exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        found = (minhash_kernel.signature(a) == minhash_kernel.signature(np.sort(b))).mean()
        assert abs(found - exact) < (0.25 if n < 10 else 0.13)
    assert len(shingles(np.zeros(0, np.uint64), 5)) == 0 and len(shingles(np.arange(3, dtype=np.uint64), 5)) == 1


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 120)] + [(200, 201), (201, 202), (202, 200), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys(range(100, 120), 100), **dict.fromkeys(range(200, 203), 200)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# -- substring removal -------------------------------------------------------

def brute_repeats(docs, width):
    raw = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(t[s:s + width] for _, t in raw for s in range(len(t) - width + 1))
    out = []
    for d, t in raw:
        gone = bytearray(len(t))
        for s in range(len(t) - width + 1):
            if seen[t[s:s + width]] > 1:
                gone[s:s + width] = b"\1" * width
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((d, len(t), sum(gone), sum(g and not gone[i - 1] if i else g for i, g in enumerate(gone)),
                    kept, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def substring_cases(awkward_list):
    rng = np.random.default_rng(6)
    text = lambda n: "".join(rng.choice(list("abcdé \n"), n))
    a, b = text(2000), text(1500)
    more = [(50, a), (51, text(700) + a[300:1200] + text(300)), (52, a[:399]), (53, a[100:500]), (54, b + b[200:900]),
            (55, "ab" * 900), (56, "ab" * 250 + "c"), (57, text(300) + b[5:404]), (58, text(30) + b[5:405] + "é" * 401), (59, "é" * 300)]
    return [(r[0], r[1]) for r in awkward_list if r[0] is None or r[0] < 50] + more


@pytest.mark.parametrize("batches", [1, 4])
def test_substring_removal_matches_brute_force(spark, awkward, batches):
    cases = substring_cases(awkward.collect())
    docs = spark.createDataFrame(cases, "doc_id long, text string").selectExpr(
        "*", "1 as n", "'x' as key", "'x' as id", "'x' as cuts", "'x' as text_key").repartition(3)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]), r["kept_sha256"])
                  for r in substring_dedup.remove_repeats(docs, batches=batches).collect())
    assert got == brute_repeats(cases, substring_kernel.WINDOW)


def test_substring_removal_of_nothing(empty):
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_suffix_levels_grow_geometrically(spark):
    index = substring_dedup.SuffixLevels(spark)
    sizes, found = [], set()
    batches = [[1, 2, 3], [3, 4], [5, 5, 6], [1, 7], [8]]
    for keys in batches:
        found |= {r["key"] for r in index.add(spark.createDataFrame([(k,) for k in keys], "key long")).collect()}
        sizes.append(sorted(index.levels))
    assert sizes == [[0], [1], [0, 1], [2], [0, 2]]
    assert found == {k for k, n in Counter(k for b in batches for k in b).items() if n > 1}
    index.drop()


def test_anchors_do_not_depend_on_what_surrounds_a_window(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(substring_kernel, "_PIECE", 1000)
    core = rng.integers(0, 4, 1500).astype(np.uint8)
    seen = []
    for pad in (0, 777):
        raw = np.concatenate([rng.integers(0, 4, pad).astype(np.uint8), core, rng.integers(0, 4, 100).astype(np.uint8)])
        p, first, last, *_ = substring_kernel.anchors(raw, np.array([0, len(raw)]))
        assert int((last - first + 1).sum()) == len(raw) - substring_kernel.WINDOW + 1
        seen.append({s - pad: int(a) - pad for a, f, t in zip(p, first, last) for s in range(f, t + 1)})
    inside = range(len(core) - substring_kernel.WINDOW + 1)
    assert [seen[0][s] for s in inside] == [seen[1][s] for s in inside]


# -- URL rules ---------------------------------------------------------------

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("Org", "/fr/", "allow"),
         ("a.b.example.com", "", "block"), ("both.com", "/", "block"), ("both.com", "/", "allow"), (None, "/", "block"), ("", "/", "block"),
         ("null-path.com", None, "block")]
URLS = ["http://example.net/en/1", "http://www.Example.NET/de/", "https://example.net", "http://net/", "http://notexample.net?x=/en/",
        "http://x.example.com/de/a?b", "http://example.com/den", "http://x.org/fr/1#z", "no scheme", "", None, "://", "http:///path",
        "http://a.b.example.com", "http://z.a.b.example.com#", "http://both.com/x", "http://null-path.com?q", "http://a..net/x",
        "ftp://user@net/", "http://x.net/" + "p" * 5000, "a://b://net/"]


def brute_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = host.translate(UPPER)
    fits = [(len(h + (p or "")), len(h), a == "block", h.translate(UPPER) + (p or ""), a) for h, p, a in RULES
            if h and (host == h.translate(UPPER) or host.endswith("." + h.translate(UPPER))) and path.startswith(p or "")]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else "allow"


def test_url_rules_match_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "x", "x", "x") for i, u in enumerate(URLS + URLS[:2])],
                                  "page_id long, url string, host string, keys string, code string")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, rules).collect()}
    assert got == {i: brute_verdict(u) for i, u in enumerate(URLS + URLS[:2])}
    assert {r["verdict"] for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def test_urls_of_many_labels(spark):
    deep = ".".join(["a"] * 20_000)
    urls = [f"http://{deep}.net/x", f"http://{deep}.example.net/en/", f"http://{deep}/", "http://" + "." * 5000 + "net/", "http://x/" + "y" * 100_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages, rules).collect()}
    assert got == {i: brute_verdict(u)[2:] for i, u in enumerate(urls)}


def test_cascade_is_exact_over_its_universe(spark):
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(-1 << 62, 1 << 62, (6000, 2)), axis=0)
    flags = rng.random(len(keys)) < 0.2
    universe = spark.createDataFrame([(int(a), int(b), bool(f)) for (a, b), f in zip(keys, flags)], "h1 long, h2 long, listed boolean").cache()
    levels = url_filter.build_cascade(universe)
    h1, h2 = (np.ascontiguousarray(keys[:, i]).view(np.uint64) for i in (0, 1))
    assert len(levels) > 1 and (url_filter.listed(levels, h1, h2) == flags).all()
    with pytest.raises(ValueError):
        url_filter.bloom_shape(10**12, 0.5)


# -- mixing ------------------------------------------------------------------

def test_schedule_stays_within_a_block_of_the_given_weights():
    """Exact lags against the given weights over a million slots: few, many and very many sources, one at a third."""
    rng = np.random.default_rng(7)
    third = lambda n: [n / 2, *rng.uniform(0.5, 1.5, n - 1)]
    cases = [(third(20), 1_000_000), (third(2000), 300_000), (third(20_000), 100_000), (rng.random(9) ** 9 + 1e-6, 20_000), ([1.0], 10),
             ([1.0, 1e-7], 3000), ([0.1] * 10, 1000)]
    for weights, slots in cases:
        whole = mix_sources.whole_weights([float(w) for w in weights])
        total = sum(whole)
        blocks = [min(slots, slots * w // total + 1) for w in whole]
        runs, done = mix_sources.schedule(whole, blocks), [0] * len(whole)
        assert len(runs) == sum(blocks)
        for i, (s, block, release, deadline, slot) in enumerate(runs):
            assert block == done[s] and release == block * total // whole[s] and release <= slot < deadline
            # a source is furthest from its share just before and just after one of its blocks
            assert abs(block * total - slot * whole[s]) < total and abs((block + 1) * total - (slot + 1) * whole[s]) < total
            done[s] += 1
        assert done == blocks and [r[4] for r in runs[:slots // 2]] == list(range(min(slots // 2, len(runs))))


def test_mix_keeps_all_rows_and_the_weights(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}") for i in range(3000)] + [(None, None), (5, "hot"), (5, "hot")]
    docs = spark.createDataFrame(rows, "doc_id long, source string").selectExpr("*", "1 as slot", "'x' as block", "'y' as part", "0 as h").repartition(3)
    weights = {"hot": 0.5, "s0": 0.2, "s1": 0.1, "s2": 0.1, "s3": 0.04, "s4": 0.04, "s5": 0.01, "s6": 0.01, "gone": 3.0}
    placed = mix_sources.mix(docs, weights, carry=["doc_id"]).select("row.doc_id", "*").drop("row").collect()
    assert Counter(r["doc_id"] for r in placed) == Counter(r[0] for r in rows)
    by_source = defaultdict(list)
    for r in placed:
        by_source[r["source"]].append((r["block"], r["place"]))
        assert r["release"] <= r["slot"] < r["deadline"]
    for source, places in by_source.items():
        assert sorted(places) == [divmod(i, mix_sources.BLOCK_DOCS) for i in range(len(places))]
    slots = sorted({(r["slot"], r["source"]) for r in placed})
    assert len({s for s, _ in slots}) == len(slots)  # one block a slot
    given = {s: w for s, w in weights.items() if s != "gone"} | {"": 0.01}
    whole, done = sum(given.values()), Counter()
    target = sorted({(r["slot"], r["source"]) for r in placed if r["in_target"]})
    assert [s for s, _ in target] == list(range(len(target)))
    for t, (_, source) in enumerate(target):
        done[source] += 1
        assert all(abs(done[s] - (t + 1) * w / whole) < 1 for s, w in given.items())


def test_mix_meets_the_weights_of_many_sources(spark):
    """2000 sources, one at a third: the deviation from the given weights, not from rounded ones."""
    rows = [(i, "hot") for i in range(5000)] + [(i, f"s{i % 1999}") for i in range(1999 * 4)]
    weights = {"hot": 1000.0 - 0.5} | {f"s{i}": 1.0 + (i % 7) / 100 for i in range(1999)}
    docs = spark.createDataFrame(rows, "doc_id long, source string").repartition(3)
    placed = mix_sources.mix(docs, weights, block_docs=1, carry=["doc_id"]).select("row.doc_id", "*").drop("row").cache()
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan
    got = placed.collect()
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter(rows)
    assert len({r["slot"] for r in got}) == len(got)
    target = sorted(r["slot"] for r in got if r["in_target"])
    assert target == list(range(len(target))) and len(target) > 9000
    total = sum(weights.values())
    for r in got:  # a source is furthest from its share just before and just after one of its blocks
        w = weights[r["source"]] / total
        assert abs(r["block"] - r["slot"] * w) < 1 + 1e-9 and abs(r["block"] + 1 - (r["slot"] + 1) * w) < 1 + 1e-9


def test_blocks_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(mix_sources, "MAX_BLOCKS", 10)
    monkeypatch.setattr(mix_sources, "BROADCAST_ROWS", 0)
    rows = [(i, 's"x\\é' if i % 3 else f"s{i % 4}") for i in range(1000)]
    got = mix_sources.mix(spark.createDataFrame(rows, "doc_id long, source string"), carry=["doc_id"]).select("row.doc_id", "*").collect()
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter(rows)
    assert max(r["place"] for r in got) == 99 and len({r["slot"] for r in got}) <= 10 + 5


def test_mix_awkward_rows(awkward, empty):
    out = mix_sources.interleave(awkward, mix_sources.source_weights(awkward))
    assert out.columns == awkward.columns
    assert Counter(map(tuple, out.collect())) == Counter(map(tuple, awkward.collect()))
    assert mix_sources.interleave(empty, mix_sources.source_weights(empty)).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan


# -- WARC --------------------------------------------------------------------

def test_archive_round_trip(spark):
    big = "é<p>\r\n\r\nWARC/1.1\r\n</p>" * 9000
    pages = [(1, "http://a/", "small"), (2, None, None), (3, "http://a/\r\nX: y", ""), (4, "u", big), (5, "u", big), (9, "u", big),
             (6, "u", "x" * 1000), (7, "u", "x" * 1000), (8, "u", "x" * 999), (10, "u", "x" * 999), (None, "u", "z" * 2000),
             (11, "u", "r" * 40_000), (11, "u", "r" * 40_000), (12, "u", "0\r\n\r\n" * 3000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' as id", "'x' as block", "0 as n").repartition(3)
    path = shared_path(spark, "warc-test")
    warc.write(df, path)
    found = warc.read(spark, path).collect()
    assert len(found) == len(pages) and all(r["valid"] for r in found)
    origin = defaultdict(list)
    for i, _, html in pages:
        if i is not None and len((html or "").encode()) >= 1000:
            origin[html].append(i)
    expected = Counter()
    for i, _, html in pages:
        data = (html or "").encode()
        to = max(origin[html]) if html in origin and i is not None else i
        to = None if to == i else to
        expected[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if to else "response", to, None if to else data] += 1
    # A page without an id is stored in full.
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"],
                   None if r["payload"] is None else bytes(r["payload"])) for r in found)
    assert got == expected
    segments = warc.records(spark, path).where("number is not null")
    assert segments.where("type = 'continuation'").count() == 8  # 6 of the large page, 1 of each repeated row


def test_damaged_archives_are_reported(spark):
    path = shared_path(spark, "warc-damage")
    warc.write(spark.createDataFrame([(1, "u", "a" * 100_000), (2, "u", "b" * 10)], "page_id long, url string, html string"), path)
    records = spark.read.text(path, lineSep="\r\n\r\n", wholetext=False)
    assert records.count() > 3
    good = warc.records(spark, path)
    rows = good.collect()
    blob = b""
    for r in rows:
        if r["number"] == "2":
            continue  # a lost segment
        lines = [b"WARC/1.1", b"WARC-Type: " + r["type"].encode(), b"WARC-Record-ID: " + r["record_id"].encode()]
        for name, field in (("WARC-Segment-Number", "number"), ("WARC-Segment-Origin-ID", "origin"),
                            ("WARC-Segment-Total-Length", "total"), ("WARC-Payload-Digest", "digest"), ("X-Page-ID", "page_id")):
            if r[field]:
                lines.append(f"{name}: {r[field]}".encode())
        lines.append(f"Content-Length: {len(r['block'])}".encode())
        blob += b"\r\n".join(lines) + b"\r\n\r\n" + bytes(r["block"]) + b"\r\n\r\n"
    import os
    folder = shared_path(spark, "warc-damaged").replace("file:", "")
    os.makedirs(folder)
    with open(f"{folder}/a.warc", "wb") as f:
        f.write(blob)
    got = {r["page_id"]: r["valid"] for r in warc.read(spark, f"file://{folder}").collect()}
    assert got == {1: False, 2: True}
    assert warc.dechunk(b"3\r\nabc\r\n0\r\n\r\n") == b"abc" and warc.dechunk(b"4\r\nabc\r\n0\r\n\r\n") is None and warc.dechunk(b"zz") is None


def test_cut_archives_keep_the_records_before_the_break(spark, empty):
    import os
    path = shared_path(spark, "warc-cut").replace("file:", "")
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 30) for i in range(6)], "page_id long, url string, html string")
    warc.write(pages.coalesce(1), f"file://{path}")
    name = next(f for f in os.listdir(path) if f.startswith("part-"))
    with open(f"{path}/{name}", "rb") as f:
        whole = f.read()
    folder = shared_path(spark, "warc-cuts").replace("file:", "")
    os.makedirs(folder)
    number = whole.replace(b"X-Payload-Length: ", b"X-Payload-Length: x")
    for k, content in enumerate([whole[:-500], whole, b"no archive", whole.replace(b"Content-Length", b"Content-Size", 1), number]):
        with open(f"{folder}/{k}.warc", "wb") as f:
            f.write(content)
    got = warc.read(spark, f"file://{folder}").collect()
    broken = [r for r in got if r["record_type"] == warc.BROKEN]
    assert len(broken) == 3 and all(not r["valid"] and r["payload"] is None and r["reason"] for r in broken)
    kept = Counter(r["page_id"] for r in got if r["valid"])
    assert kept[0] == 3 and kept[5] == 2 and 0 < sum(kept.values()) - 12 < 6
    nothing = shared_path(spark, "warc-none")
    warc.write(empty.selectExpr("doc_id as page_id", "text as url", "text as html"), nothing)
    assert warc.read(spark, nothing).count() == 0


# -- pipeline ----------------------------------------------------------------

def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMOKE_DIR}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "minhash_dedup", "decontaminate", "mix_sources", "pack_tokens"]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, SMOKE_DIR)
        assert after.columns == docs.columns
        path = shared_path(spark, "stage-test")
        after.write.parquet(path)
        before, now = now, spark.read.parquet(path)
        if name == "minhash_dedup":
            expected = brute_components([(r["doc_id"], r["text"]) for r in before.collect()])
            assert sorted(r["doc_id"] for r in now.collect()) == sorted(d for d, (_, c) in expected.items() if c == d)
        if name == "mix_sources":
            assert Counter(map(tuple, before.collect())) == Counter(map(tuple, now.collect()))
    packed = corpus_pipeline.run(spark, SMOKE_DIR)
    assert sorted({d for r in packed.select("doc_ids").collect() for d in r[0]}) == sorted(r["doc_id"] for r in now.collect())


def stage_input(spark):
    """The smoke documents, their ids unique, with texts that the first stages must judge one by one."""
    docs = spark.read.parquet(f"{SMOKE_DIR}/documents.parquet")
    passage = spark.read.parquet(f"{SMOKE_DIR}/benchmark.parquet").where("text is not null").first()["text"]
    texts = [None, "", "123 !!! 45", "\n\t", "Si", "De.", "a", "no", "words before " + passage + " words after", "clean words " * 9]
    made = spark.createDataFrame([(10**9 + i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    return docs.unionByName(made, allowMissingColumns=True)


def test_language_stage_keeps_what_brute_force_keeps(spark):
    docs = stage_input(spark)
    foreign = {2 * 10**9 + i: x for i, x in enumerate([
        "Это предложение на русском языке, которое не должно пройти.", "これは日本語の文章です。通ってはいけません。", "да", "日本",
        "xqzj wvkqz jjxq zzkw pqxv wqjk vvzx qkjz xwvq kzjq"])}
    docs = docs.unionByName(spark.createDataFrame(list(foreign.items()), "doc_id long, text string"), allowMissingColumns=True)
    model = language_id.train(docs)

    def fit(text):
        total, chars = language_id.score_batch(model, pa.array([text]))
        return max(total[0]) / sum(max(int(chars[0]) - k, 0) for k in range(4))
    rows = docs.collect()
    # the smoke table has fewer rows of each language than the sample takes, so all labelled rows are in it
    learned = sorted(fit(r["text"]) for r in rows if r["lang"] is not None)
    floor = 1.4 * learned[max(0, math.ceil(0.001 * len(learned)) - 1)]
    expected = {r["doc_id"] for r in rows if any(c.isalpha() for c in r["text"] or "") and fit(r["text"]) >= floor}
    got = [r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, SMOKE_DIR).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    # no letters or another language: gone; very short texts of known letters and every labelled document: kept
    assert not expected & set(range(10**9, 10**9 + 4)) and not expected & set(foreign)
    assert set(range(10**9 + 4, 10**9 + 10)) <= expected
    assert {r["doc_id"] for r in rows if r["lang"] is not None} <= expected


def test_decontamination_stage_keeps_what_brute_force_keeps(spark):
    docs = stage_input(spark)
    windows = set()
    for r in spark.read.parquet(f"{SMOKE_DIR}/benchmark.parquet").collect():
        w = words_of(r["text"])
        windows |= {tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    expected, sizes = set(), {len(g) for g in windows}
    for r in docs.collect():
        w = words_of(r["text"])
        if not any(tuple(w[i:i + k]) in windows for k in sizes for i in range(len(w) - k + 1)):
            expected.add(r["doc_id"])
    got = [r["doc_id"] for r in corpus_pipeline.drop_contaminated(spark, docs, SMOKE_DIR).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    assert 10**9 + 8 not in expected and 10**9 + 9 in expected


def test_packed_rows_decode_to_the_texts_of_the_stage_input(spark):
    docs = stage_input(spark)
    ranks = pack_tokens.load_ranks()
    token = {rank: piece for piece, rank in ranks.items()}
    pieces = {}
    for r in corpus_pipeline.pack_token_ids(spark, docs, SMOKE_DIR).collect():
        ids, cu = pack_tokens.matrix([r["ids"]], pack_tokens.SEQ_LEN)[0], r["cu_seqlens"]
        for a, b, doc, piece in zip(cu, cu[1:], r["doc_ids"], r["pieces"]):
            assert (doc, piece) not in pieces
            pieces[doc, piece] = ids[a:b].tolist()
    whole = defaultdict(list)
    for (doc, _), ids in sorted(pieces.items()):
        whole[doc] += ids
    assert all(ids[-1] == len(ranks) for ids in whole.values())
    assert {doc: b"".join(token[i] for i in ids[:-1]).decode() for doc, ids in whole.items()} == {
        r["doc_id"]: r["text"] or "" for r in docs.collect()}


def test_pipeline_stages_on_awkward_rows(spark, awkward, empty):
    for docs in (awkward, empty):
        now = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, SMOKE_DIR)
            assert now.columns == docs.columns
        corpus_pipeline.STAGES[-1][1](spark, now, SMOKE_DIR).count()


def test_arrow_offsets_of_sliced_columns():
    from clientele.llm.common import utf8_buffers
    raw, off = utf8_buffers(pa.array(["ab", None, "é", ""]).slice(1))
    assert bytes(raw) == "é".encode() and off.tolist() == [0, 0, 2, 2]
