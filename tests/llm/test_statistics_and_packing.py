"""Source divergence, collocations and best-fit packing: awkward rows, brute force, round trips."""
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from clientele.llm import best_fit, collocations, packing_plan, source_divergence
from clientele.llm.wordcodes import WordCodes
from tests.conftest import SMOKE_DIR

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def as_set(df):
    return sorted(map(tuple, df.collect()), key=str)


# -- source divergence -------------------------------------------------------

def brute_divergence(rows, min_docs=3, top=200):
    term_re = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    count, holders, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for r in rows:
        lang, source = r["lang"] or "", r["source"] or ""
        terms = term_re.findall((r["text"] or "").translate(UPPER))
        groups[lang].add(source)
        count[lang, source].update(terms)
        holders[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in holders[lang].items() if n >= min_docs]

        def share(counter):
            whole = sum(counter[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (counter[t] + 1) // whole for t in kept}
        p = {s: share(count[lang, s]) for s in sources}
        total = Counter()
        for s in sources:
            total.update(count[lang, s])
        q = share(total)
        for s in sources:
            pair = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            term = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, items, limit in (("pair", pair, None), ("term", term, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(items[:limit])]
    return sorted(out, key=str)


def test_divergence_matches_brute_force(awkward, empty):
    rows = awkward.collect()
    assert as_set(source_divergence.divergence(awkward)) == brute_divergence(rows)
    # no kept term at all, many blocks, few terms
    assert as_set(source_divergence.divergence(awkward, min_docs=99)) == brute_divergence(rows, min_docs=99)
    assert as_set(source_divergence.divergence(awkward, min_docs=1, top_terms=3, block_rows=40)) == brute_divergence(rows, 1, 3)
    assert source_divergence.divergence(empty).count() == 0


def test_divergence_of_many_sources_uses_every_tile(spark):
    rng = random.Random(5)
    rows = [(" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 12))), "en", f"site{i % 37}") for i in range(300)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert as_set(source_divergence.divergence(df, block_rows=50)) == brute_divergence(df.collect())


def test_gallop_and_shares():
    rng = np.random.default_rng(1)
    for n, m in ((0, 5), (1, 1), (3, 5000), (700, 900), (4000, 20)):
        a, b = (np.unique(rng.integers(0, 6000, k)) for k in (n, m))
        at, bt = source_divergence.gallop(a, b)
        assert (a[at] == np.intersect1d(a, b)).all() and (b[bt] == a[at]).all()
    big = np.array([0, 5, 10**12], np.int64)
    assert source_divergence.shares(big, 10**13).tolist() == [1 + 10**9 * (int(c) + 1) // 10**13 for c in big]


# -- collocations ------------------------------------------------------------

def brute_collocations(rows, min_count=10, top=2000):
    f, n = Counter(), Counter()
    for r in rows:
        lang = "und" if r["lang"] is None else r["lang"]
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (r["text"] or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in (1, 2, 3):
                f.update((lang, tuple(w[i:i + m])) for i in range(len(w) - m + 1))
    best = defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) == 1 or a < min_count:
            continue
        if len(p) == 2 and any(len(q) == 3 and g == lang and p in (q[:2], q[1:]) and c >= min_count and 100 * c >= 50 * a
                               for (g, q), c in f.items()):
            continue
        score, _, left, right = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        best[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted([(lang, k + 1, p.decode(), -a, left, right, n[lang], -s)
                   for lang, items in best.items() for k, (s, a, p, left, right) in enumerate(sorted(items)[:top])], key=str)


@pytest.fixture(scope="module")
def phrase_rows(spark):
    rng = random.Random(9)
    words = ["New", "york", "city", "été", "日本", "a", "b", "c\x00d", "x" * 300]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", " new york city "]) for _ in range(rng.randint(0, 40)))
    rows = [(text(), rng.choice(["en", "en", None, "fr"])) for _ in range(150)] + [(None, "en"), ("", None), ("a a a a a a a a a a a a", "es")]
    return spark.createDataFrame(rows, "text string, lang string").repartition(5)


def test_collocations_match_brute_force(phrase_rows, awkward, empty):
    want = brute_collocations(phrase_rows.collect())
    assert want and as_set(collocations.collocations(phrase_rows)) == want
    # one and many shards, a bitmap far too small, a cut inside ties
    assert as_set(collocations.collocations(phrase_rows, shards=1)) == want
    assert as_set(collocations.collocations(phrase_rows, shards=20, mark_bits=(3, 4))) == want
    assert as_set(collocations.collocations(phrase_rows, top=7)) == brute_collocations(phrase_rows.collect(), top=7)
    assert as_set(collocations.collocations(phrase_rows, top=None, min_count=4)) == brute_collocations(phrase_rows.collect(), 4, 10**9)
    assert as_set(collocations.collocations(awkward)) == brute_collocations(awkward.collect())
    assert collocations.collocations(empty).count() == 0


def test_runs_of_hashes_come_back():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 40, 5000).astype(np.uint64))
    counts = rng.integers(1, 1 << 33, len(keys))
    batch = collocations._runs(keys, counts, 2, 40, 3, 5)
    back = [np.cumsum(collocations._from_planes(s, n, 5), dtype=np.uint64) for s, n in
            zip(batch.column("steps").to_pylist(), batch.column("n").to_pylist())]
    assert (np.concatenate(back) == keys).all() and batch.num_rows <= 8
    assert (np.concatenate([collocations._from_planes(s, n, 5) for s, n in zip(batch.column("counts").to_pylist(), batch.column("n").to_pylist())])
            == counts.astype(np.uint64)).all()


def test_collocations_do_not_depend_on_what_a_task_holds(phrase_rows):
    assert as_set(collocations.collocations(phrase_rows, held=50)) == brute_collocations(phrase_rows.collect())


# -- best-fit packing --------------------------------------------------------

def least_sequences(lengths, capacity):
    best, order = [len(lengths)], sorted(lengths, reverse=True)

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(order):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= order[i]}.values():
            rooms[k] -= order[i]
            go(i + 1, rooms)
            rooms[k] += order[i]
        go(i + 1, [*rooms, capacity - order[i]])
    go(0, [])
    return best[0]


def plain_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(capacity - n)
    return Counter(rooms)


def test_reduction_keeps_the_least_number_of_sequences():
    rng, fixed_pieces = random.Random(2), 0
    for _ in range(400):
        capacity = rng.choice([10, 20, 30, 100])
        lengths = [rng.randint(max(1, capacity // rng.choice([3, 4, 8])), capacity) for _ in range(rng.randint(1, 10))]
        fixed, rest = packing_plan.reduce(np.bincount(lengths, minlength=capacity + 1), capacity)
        left = list(itertools.chain.from_iterable([n] * int(k) for n, k in enumerate(rest)))
        assert sum(c for c, _ in fixed) + (least_sequences(left, capacity) if left else 0) == least_sequences(lengths, capacity)
        fixed_pieces += len(lengths) - len(left)
    assert fixed_pieces > 1000


def test_best_fit_on_counts_is_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(200):
        capacity = rng.choice([10, 25, 64])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 70))]
        rooms = Counter()
        for copies, pattern in packing_plan.best_fit(np.bincount(lengths, minlength=capacity + 1), capacity):
            rooms[capacity - sum(n * k for n, k in pattern)] += copies
        assert rooms == plain_best_fit(lengths, capacity)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(best_fit.vocabulary_path())


def check_packing(rows, docs, tokenizer, seq_len):
    whole = Counter()
    for doc_id, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        whole.update((doc_id, k, s, len(ids[s:s + seq_len]), zlib.crc32(ids[s:s + seq_len].tobytes())) for k, s in enumerate(range(0, len(ids), seq_len)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == whole
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for segments in by_sequence.values():
        at = 0
        for offset, length in sorted(segments):
            assert offset == at
            at += length
        assert at <= seq_len
    return len(by_sequence)


@pytest.mark.parametrize("seq_len", [64, 4096])
def test_packing_is_gapless_and_whole(awkward, empty, tokenizer, seq_len):
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    rows = best_fit.pack(awkward, seq_len=seq_len).collect()
    n = check_packing(rows, docs, tokenizer, seq_len)
    assert n <= -(-sum(r["length"] for r in rows) // seq_len) + 1
    assert best_fit.pack(empty).count() == 0


def test_packed_sequences_hold_the_ids(awkward, tokenizer):
    packed = best_fit.pack(awkward.where("doc_id is not null").dropDuplicates(["doc_id"]), seq_len=256, with_ids=True)
    got = defaultdict(dict)
    for r in best_fit.sequences(packed).collect():
        ids = np.frombuffer(r["ids"], "<u4")
        for doc, piece, a, b in zip(r["doc_ids"], r["pieces"], r["resets"], [*r["resets"][1:], len(ids)]):
            got[doc][piece] = ids[a:b].tolist()
    for r in awkward.where("doc_id is not null").collect():
        pieces = got[r["doc_id"]]
        assert sum((pieces[k] for k in range(len(pieces))), []) == [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]


def test_word_by_word_encoding_equals_the_tokenizer(spark, tokenizer):
    texts = [r["text"] for r in spark.read.parquet(f"{SMOKE_DIR}/documents.parquet").collect()] + [
        "a<|endoftext|> b <|startoftext|>c", "it's  IT'S x y　z", " ́combining é Å", "ΑΣ ΑΣ. ΑΣ", "\x00 \x1f \x85", "12 34a٣", None, "",
        "Straße. straße!? ÿ, ÷ é÷ É. Ünder, naïve;: o'Brien's. (x). x).\u0301 a.\u0301 .a ª º <|ENDOFTEXT|> Dž İx ﬁ"]
    with open(best_fit.vocabulary_path(), encoding="utf-8") as f:
        encoder = best_fit.WordEncoder(f.read())
    for _ in range(2):  # the second time from the remembered words
        ids, at = encoder.encode(pa.array(texts, pa.string()))
        for i, text in enumerate(texts):
            assert ids[at[i]:at[i + 1]].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_another_vocabulary_encodes_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        encoder = best_fit.WordEncoder(f.read())
    texts, plain = ["A  word, and\n another", None, "", "é"], Tokenizer.from_file(path)
    ids, at = encoder.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_a_length_shared_by_many_pieces_is_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(best_fit, "WINDOW_ROWS", 10)
    df = spark.createDataFrame([(i, "same words here") for i in range(95)] + [(i, "w " * (i % 7)) for i in range(200, 260)], "doc_id long, text string")
    rows = best_fit.pack(df, seq_len=32).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows) == 155
    assert len({r["sequence_id"] for r in rows}) == -(-sum(r["length"] for r in rows) // 32)


def test_words_in_chunks_are_exact(monkeypatch):
    from clientele.llm import wordcodes
    monkeypatch.setattr(wordcodes, "PIECE_BYTES", 16)
    texts = ["Alpha beta", None, "", "x" * 50 + " y", "é" * 30, " ", "alpha"]
    words = WordCodes(pa.array(texts, pa.string()), collocations.WORD)
    got = [[words.words[int(c)].as_py().decode() for c in words.codes[a:b]] for a, b in zip(words.first[:-1], words.first[1:])]
    assert got == [(t or "").translate(UPPER).split() for t in texts]
