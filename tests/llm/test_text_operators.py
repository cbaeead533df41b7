"""Language id, decontamination, fingerprints, toxicity, packing: awkward rows and brute force."""
import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clientele.llm import (common, decontaminate, fingerprint, language_id, pack_tokens, toxicity, toxicity_model)
from clientele.llm.queries import ORACLE_SQL
from tests.conftest import SMOKE_DIR

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def as_rows(df):
    return [tuple(r) for r in df.collect()]


def words_of(text):
    return WORD.findall((text or "").translate(UPPER))


# -- words -------------------------------------------------------------------

@pytest.mark.parametrize("piece", [1 << 21, 7])
def test_word_batch_matches_regular_expression(monkeypatch, piece):
    monkeypatch.setattr(common, "PIECE_BYTES", piece)
    texts = ["Hello World, été 12", None, "", "a", "-", "tail ", " MiXed42x", "日本 語", "longword" * 9 + " b"]
    batch = common.TextBatch(pa.array(texts).slice(0))
    seen = {}
    for i, text in enumerate(texts):
        own = batch.hash[batch.first[i]:batch.first[i + 1]].tolist()
        expected = words_of(text)
        assert len(own) == len(expected)
        for h, w in zip(own, expected):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


# -- language id -------------------------------------------------------------

def test_language_id_held_out_accuracy(spark):
    docs = common.table(spark, SMOKE_DIR, "documents")
    model = language_id.train(docs, where=docs.doc_id % 4 != 2)
    rows = language_id.predict(docs.where("doc_id % 4 = 2"), model, keep=["lang"]).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_id_awkward_rows(awkward, empty):
    model = language_id.train(awkward)
    assert model.langs == ["en", "fr"]
    found = language_id.predict(awkward, model, keep=["doc_id", "text", "score"], score_col="p").collect()
    assert len(found) == awkward.count()
    for r in found:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and (letters or r["p"] == 0)
    none = language_id.train(empty)
    assert none.langs == [] and language_id.predict(empty, none).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(awkward, none).collect()} == {"und"}


def test_language_scores_do_not_depend_on_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    model = language_id.LanguageModel(["a", "b"], rng.normal(size=(1 << 10, 2)).astype(np.float32), np.zeros(2), 10)
    texts = pa.array(["", "abc déf", "x", "ab" * 500, "日本語 text " * 40, None])
    whole, n = language_id.score_batch(model, texts)
    monkeypatch.setattr(language_id, "_PIECE", 16)
    parts, m = language_id.score_batch(model, texts)
    assert n.tolist() == m.tolist() and np.allclose(whole, parts, rtol=1e-4, atol=1e-3)


# -- decontamination ---------------------------------------------------------

def brute_contamination(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = words_of(text)
        if w and item is not None:
            for i in range(max(1, len(w) - size + 1)):
                windows.setdefault(tuple(w[i:i + size]), set()).add(str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = words_of(text), set(), set()
        for g, own in windows.items():
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i:i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    found |= own
        joined = ",".join(sorted(found))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(joined.encode()).hexdigest(), bool(hit)))
    return Counter(out)


def items_for(awkward_list):
    passage = next(r[1] for r in awkward_list if r[0] == 13)
    return [(1, passage), (2, passage), (3, "two WORDS"), (4, None), (5, ""), (10, "one"), (None, "x"),
            (7, " ".join(passage.split()[3:12])), (8, "nothing of this kind occurs in any of the documents at all")]


@pytest.mark.parametrize("block", [200_000, 7])
def test_decontamination_matches_brute_force(spark, awkward, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_ROWS", block)
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    items = items_for(docs)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(awkward, bench).drop("items")
    assert Counter(as_rows(got)) == brute_contamination(docs, items)
    kept = decontaminate.drop_contaminated(awkward, bench)
    assert kept.columns == awkward.columns
    clean = Counter({r[0]: n for r, n in brute_contamination(docs, items).items() if not r[-1] and r[0] is not None})
    assert Counter(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == clean


def test_items_without_an_id_are_decontaminated(spark):
    """Against the query's own SQL: they hit, count as one item together and are not in the list."""
    docs = spark.createDataFrame([(1, "here stands alpha beta gamma"), (2, "delta alone"), (3, "clean text"), (4, "alpha beta delta")],
                                 "doc_id long, text string")
    bench = spark.createDataFrame([(None, "alpha beta"), (None, "delta"), (7, "Alpha, beta")], "item_id long, text string")
    con = duckdb.connect()
    for name, df in (("documents", docs), ("benchmark", bench)):
        con.register(f"{name}_rows", df.toArrow())
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM {name}_rows")
    got = as_rows(decontaminate.contamination(docs, bench).drop("items"))
    assert Counter(got) == Counter(con.execute(ORACLE_SQL["op2_decontaminate"]).fetchall())
    assert {r[0]: r[2:4] for r in got} == {1: (2, 2), 2: (1, 1), 3: (0, 0), 4: (3, 2)}
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()] == [3]


def test_decontamination_empty_tables(spark, awkward, empty):
    no_items = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in decontaminate.contamination(awkward, no_items).collect())
    assert decontaminate.contamination(empty, no_items).count() == 0
    assert decontaminate.drop_contaminated(awkward, no_items).count() == awkward.count()


def test_corpus_passes_do_not_grow_with_the_benchmark(spark, monkeypatch):
    docs = common.table(spark, SMOKE_DIR, "documents")
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(14))) for i in range(30)] + [
        (99, docs.where("text is not null").first()["text"][:400])], "item_id long, text string")

    def scans(block):
        monkeypatch.setattr(decontaminate, "BLOCK_ROWS", block)
        out = decontaminate.contamination(docs, items)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan
        return plan.count("Scan parquet"), out.where("contaminated").select("doc_id", "n_hit", "n_items").orderBy("doc_id").collect()
    few, hits = scans(200_000)
    for block in (150, 7):
        n, found = scans(block)
        assert n == few and found == hits
    assert hits


def test_decontamination_is_native(spark, awkward):
    bench = spark.createDataFrame([(1, "two words")], "item_id long, text string")
    plan = decontaminate.contamination(awkward, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan


# -- fingerprints ------------------------------------------------------------

def test_fingerprint_collisions_follow_generalised_jaccard(monkeypatch):
    rng = np.random.default_rng(4)
    errors = []
    for _ in range(60):
        pool = [f"w{i}" for i in range(60)]
        a = " ".join(rng.choice(pool[:40], 150))
        b = " ".join(a.split()[:90] + list(rng.choice(pool, 80)))
        ca, cb = (Counter(zip(t.split(), t.split()[1:])) for t in (a, b))
        exact = sum((ca & cb).values()) / sum((ca | cb).values())
        fa, fb = fingerprint.fingerprints(pa.array([a, b]))
        errors.append(fingerprint.likeness(fa, fb) - exact)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.1


def test_edited_pairs_match_brute_force(spark, empty):
    from tests.llm.conftest import SCHEMA, awkward_rows
    rows = [r for r in awkward_rows()]
    rows = [r for i, r in enumerate(rows) if r[0] is not None and i < 19]  # ids are distinct here
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r["doc_id"]: r for r in fingerprint.edited_pairs(docs).collect()}
    order = sorted(((r[0], r[1] or "") for r in rows), reverse=True)
    assert len(got) == len(order)
    for i, (doc_id, text) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        k = len(text) // 3
        edited = text[:len(text) - k] + following[:k]
        r = got[doc_id]
        prints = fingerprint.fingerprints(pa.array([text, edited, following]))
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (fingerprint.from_text([r["fingerprint"], r["edited_fingerprint"]]) == prints[:2]).all()
        assert r["near_edited"] == fingerprint.likeness(prints[0], prints[1])
        assert r["near_next"] == fingerprint.likeness(prints[0], prints[2])
    assert fingerprint.edited_pairs(empty).count() == 0
    one = fingerprint.edited_pairs(docs.where("doc_id = 7")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1


def test_edited_pairs_with_repeated_and_missing_ids(awkward):
    assert fingerprint.edited_pairs(awkward).count() == awkward.count()
    prints = fingerprint.with_fingerprint(awkward).collect()
    assert len(prints) == awkward.count()
    same = [r["fingerprint"] for r in prints if r["doc_id"] in (1, 2)]
    assert all(p == same[0] for p in same)


# -- toxicity ----------------------------------------------------------------

def test_toxicity_held_out_accuracy(spark):
    sf = SMOKE_DIR.replace("sf0.001", "sf0.01")
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    model = toxicity.train(docs, labels, where=(labels.doc_id % 3 != 1))
    held = toxicity.score(docs, model, keep=["doc_id"]).join(labels.where("doc_id % 3 = 1"), "doc_id").collect()
    toxic = [r["score"] for r in held if r["toxic"] == 1]
    clean = [r["score"] for r in held if r["toxic"] == 0]
    auc = np.mean([(t > c) + 0.5 * (t == c) for t in toxic for c in clean])
    assert len(toxic) >= 5 and auc > 0.75
    assert all((r["predicted"] == 1) == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in held)


def test_toxicity_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 19)] + [(None, 1), (3, None), (99, 1), (4, 1)], "doc_id long, toxic int")
    model = toxicity.train(awkward, labels)
    found = toxicity.score(awkward, model, keep=["doc_id", "text"]).collect()
    assert len(found) == awkward.count() and len({r["score"] for r in found if not words_of(r["text"])}) == 1
    assert toxicity.train(awkward, labels.where("toxic = 1")) is None
    assert {r["score"] for r in toxicity.score(awkward, None, keep=["doc_id"]).collect()} == {0.0}
    assert toxicity.score(empty, model).count() == 0


def test_toxicity_pooling_does_not_depend_on_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    model = toxicity_model.train([rng.integers(0, 99, (20, 3)).astype(np.int32) for _ in range(4)], np.array([0, 1, 0, 1.0]), np.ones(4), epochs=1)
    words = common.TextBatch(pa.array(["a b c d e f g h i j k", "", "one two", "w " * 50]))
    ids = toxicity_model.word_ids(words)
    whole = model.pooled(ids, words.first)
    monkeypatch.setattr(toxicity_model, "PIECE_WORDS", 4)
    # A piece's own end is padded too, so its windows are a superset; with non-negative biases at 0 the maxima agree.
    assert np.allclose(whole, model.pooled(ids, words.first), atol=1e-5)


# -- packing -----------------------------------------------------------------

def test_packing_round_trip(awkward, empty):
    packed = pack_tokens.pack(awkward, seq_len=64, group_tokens=2000).collect()
    encode = pack_tokens.make_encoder(pack_tokens.load_ranks()).encode_ordinary
    end = len(pack_tokens.load_ranks())
    pieces = []
    for r in packed:
        ids = pack_tokens.matrix([r["ids"]], 64)[0]
        cu = r["cu_seqlens"]
        assert cu[0] == 0 and cu[-1] == r["n_tokens"] <= 64 and r["resets"] == cu[:-1]
        assert (ids[r["n_tokens"]:] == end).all()
        position = pack_tokens.position_ids(cu, 64)
        assert [int(position[x]) for x in r["resets"]] == [0] * len(r["resets"])
        for a, b, doc, piece in zip(cu, cu[1:], r["doc_ids"], r["pieces"]):
            pieces.append((doc, piece, tuple(ids[a:b].tolist())))
    expected = []
    for r in awkward.collect():
        ids = [*encode(r["text"] or ""), end]
        expected += [(r["doc_id"], k, tuple(ids[at:at + 64])) for k, at in enumerate(range(0, len(ids), 64))]
    assert Counter(pieces) == Counter(expected)
    assert pack_tokens.pack(empty).count() == 0


def test_best_fit_decreasing_takes_the_tightest_row():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 65, 500)
    rows = pack_tokens.best_fit_decreasing(lengths, 64)
    assert sorted(i for r in rows for i in r) == list(range(500))
    room = []  # plain search over all open rows
    for n in sorted(lengths.tolist(), reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(64 - n)
    assert sorted(room) == sorted(64 - int(lengths[r].sum()) for r in rows)


def test_language_model_and_floor_come_from_all_labelled_rows(spark):
    n = 4000
    rows = [(i, "ab", "x") for i in range(n)] + [(n, "ab abq", "x"), (n + 1, None, "x"), (n + 2, "cd", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    model = language_id.train(docs)
    counted = np.exp(model.log_prob[:, 0].astype(float)) * (3 * n + 6 + 5 + 4 + 3 + 0.5 * len(model.log_prob)) - 0.5
    # a, b and ab, each once per short text and twice in the long one
    assert sorted(np.rint(counted).astype(int))[-3:] == [n + 2] * 3
    fits = language_id.predict(docs.where("lang is not null"), model, fit_col="fit").where("lang_pred = 'x'")
    low = fits.agg(F.min("fit")).first()[0]
    assert language_id.fit_floor(docs, model, quantile=0.0, slack=1.0) == low


def test_toxicity_learns_from_all_rows(spark):
    n = 2200  # of each class
    rows = [(i, f"{'bad' if i % 2 else 'good'} word{i % 7}", "en") for i in range(2 * n)] + [(2 * n, "bad " + "long " * 25_000, "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(2 * n)] + [(2 * n, 1)], "doc_id long, toxic int")
    seen = []
    real = toxicity_model.calibrate
    toxicity_model.calibrate = lambda model, lang, z, y, count, **kw: (seen.append(count.sum()), real(model, lang, z, y, count, **kw))
    try:
        model = toxicity.train(docs, labels)
    finally:
        toxicity_model.calibrate = real
    # The long text counts as well, and the quarter set aside is a quarter of all.
    assert model.langs == ["en", "xx"] and abs(seen[0] - len(rows) / 4) < len(rows) / 20
    word = toxicity_model.word_ids(common.TextBatch(pa.array(["good"])))[0, 0]
    share = np.exp(model.lang_log_prob[word, 0].astype(float)) * (4 * n + 0.5 * toxicity_model.ROWS[0]) - 0.5
    assert round(share) == n
    found = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model, keep=["doc_id"]).collect()}
    assert sum(found[i] == i % 2 for i in range(2 * n)) > 1.99 * n
