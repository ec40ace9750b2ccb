"""Vector codes, quality rules and phrases against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lettermill.llm import phrases, quality, vector_codes
from lettermill.llm import queries as registered

SF = "/root/testdata/sf0.001"

# --- vector codes


def plain_codes(rows, parts, entries, rounds, scale=1024):
    """All parts against all entries, in Python's integers."""
    kept = [(i, label, [math.floor(scale * c) for c in v]) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // parts if kept else 0
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(r[2], p) for r in kept[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, entry, strict=True)), e) for e, entry in enumerate(books[p]))

    for _ in range(rounds):
        held = [defaultdict(list) for _ in range(parts)]
        for _, _, v in kept:
            for p in range(parts):
                held[p][nearest(p, cut(v, p))[1]].append(cut(v, p))
        for p in range(parts):
            for e, own in held[p].items():
                books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    found = []
    for i, label, v in kept:
        near = [nearest(p, cut(v, p)) for p in range(parts)]
        found.append((i, "".join(f"{e:02x}" for _, e in near), sum(d for d, _ in near), label))
    of_label = Counter()
    for _, _, error, label in found:
        of_label[label] += error
    return sorted((repr(i), code, error, of_label[label], sha) for i, code, error, label in found)


def codes_of(spark, rows, **kw):
    given = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], "vec_id long, embedding array<float>, label int, code string, error int")
    got = vector_codes.vector_codes(given, **kw)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((repr(r[0]), *r[1:]) for r in got.collect())


def some_vectors(n, seed=1, grid=8):
    """Vectors on a coarse grid, so that distances tie."""
    draw = random.Random(seed)
    return [[draw.randint(-grid, grid) / 16 for _ in range(8)] for _ in range(n)]


@pytest.mark.parametrize(("entries", "grid"), [(16, 2), (40, 8), (7, 1)])
def test_codes_equal_plain_rounds(spark, entries, grid):
    vectors = some_vectors(300, grid=grid)
    rows = [(i * 3 % 301, [float(np.float32(c)) for c in v], i % 3 or None) for i, v in enumerate(vectors)]
    assert codes_of(spark, rows, entries=entries, rounds=3) == plain_codes(rows, 4, entries, 3)


def test_codes_of_odd_rows(spark):
    good = some_vectors(20)
    rows = [(i, v, None) for i, v in enumerate(good)]
    rows += [(3, good[3], 1), (3, good[3], 1), (3, good[7], 2), (None, good[5], 2)]  # repeated ids and rows, no id
    bad = [(50, None, 1), (51, [None] + good[0][1:], 1), (52, [float("nan")] + good[0][1:], 1), (53, [float("-inf")] + good[0][1:], 1)]
    assert codes_of(spark, rows + bad, entries=256, rounds=2) == plain_codes(rows, 4, 256, 2)
    assert codes_of(spark, bad) == [] == codes_of(spark, [])
    copies = [(i, good[0], 1) for i in range(600)]
    assert codes_of(spark, copies, rounds=1) == plain_codes(copies, 4, 256, 1)


@pytest.mark.parametrize("vector", [[0.5] * 7, [0.5] * 12, [1e30] + [0.5] * 7])
def test_codes_refuse(spark, vector):
    with pytest.raises(Exception, match="of one length|too large"):
        codes_of(spark, [(1, [0.5] * 8, 1), (0, vector, 1)] if len(vector) != 7 else [(0, vector, 1)])


def test_tree_spans_and_bounds():
    x = np.random.default_rng(3).integers(-50, 50, (777, 5))
    tree = vector_codes.build_tree(x, 32)
    assert sorted(tree.members.tolist()) == list(range(777)) and (x[tree.members] == tree.rows).all()
    for level, boxes in enumerate(tree.boxes):
        ends = tree.bounds(level)
        for node, box in enumerate(boxes):
            own = tree.rows[ends[node] : ends[node + 1]]
            assert (box == [own.min(axis=0), own.max(axis=0), own.sum(axis=0)]).all()
    assert np.diff(tree.bounds(tree.depth)).max() <= 32


def test_walk_drops_pairs_of_nodes():
    """Far clusters: whole nodes go by their sums, and no leaf meets an entry of another cluster."""
    draw = np.random.default_rng(5)
    x = np.concatenate([draw.integers(0, 9, (256, 4)) + 10_000 * c for c in range(4)])
    entries = vector_codes.build_tree(np.array([[10_000 * c + 4] * 4 for c in (2, 0, 3, 1)]), 1)
    seen = []
    vector_codes.walk(vector_codes.build_tree(x, 32), entries, lambda level, nodes, own: seen.extend((level, e) for e in own.tolist()), pytest.fail)
    assert sorted(seen) == [(2, 0), (2, 1), (2, 2), (2, 3)]


# --- quality rules


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside)


ODD_TEXTS = [
    None, "", " \n\t ", "a b c a b c", "a a a a", "x y\nx y\n\n \nx y\n x y", "é ü 🙂 # <b> $5 %|&*", "w\x0bv\x0cu\rt", "a\x1cb \x85c",
    "to be or not to be or not " * 3, "one " * 40_000, "line of words\r\n" * 60, "퟿ ok",
]


def test_counts_equal_plain_ones(spark):
    texts = ODD_TEXTS + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    given = spark.createDataFrame([(i, t, 1, True) for i, t in enumerate(texts)], "doc_id long, text string, n_words int, kept boolean")
    got = {r.doc_id: r for r in quality.judge(given, None).collect()}
    for i, text in enumerate(texts):
        want = plain_counts(text)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, repr(text)[:80]
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed) and r.good is None


def test_quality_of_held_out_rows(spark):
    """Fitted on three quarters of the labelled rows of sf0.1, the verdict on the others is their label."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels.where("doc_id % 4 <> 0"))
    rows = quality.judge(docs, model).where("NOT base_failed").join(labels.where("doc_id % 4 = 0"), "doc_id").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert len(good) > 500 and len(bad) > 40
    assert sum(good) / len(good) >= 0.99 and sum(bad) / len(bad) <= 0.05
    # Calibrated: of the rows with a probability of about p, about p are good.
    assert abs(sum(r.good for r in rows) / len(rows) - len(good) / len(rows)) < 0.03


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "word " * 60), (1, None), (None, "other words " + " ".join(map(str, range(60))))], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    one_kind = spark.createDataFrame([(1, 1), (1, 1), (None, 0), (7, 0), (1, None)], "doc_id long, quality int")
    assert quality.train(docs, none) is None and quality.train(docs, one_kind) is None
    got = quality.judge(docs, None).collect()
    assert sorted((r.doc_id or 0, r.base_failed, r.kept) for r in got) == [(0, False, True), (1, True, False), (1, True, False)]
    assert quality.judge(docs.limit(0), None).count() == 0


def test_quality_registered(spark):
    rows = registered.op12_quality(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    assert all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(docs[r.doc_id]) for r in rows)


def test_share_of_a_long_text_does_not_depend_on_blocks(monkeypatch):
    text = "some  words\n and éa few " * 50
    whole = Counter(np.concatenate(list(quality._ngrams(text))).tolist())
    monkeypatch.setattr(quality, "_BLOCK", 64)
    assert Counter(np.concatenate(list(quality._ngrams(text))).tolist()) == whole


# --- phrases


def plain_phrases(rows, least, top, scale=2_000_000, cover=80):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3, 4):
                f.update((lang, *words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    for p, a in candidates.items():
        lang, words = p[0], p[1:]
        cuts = [(scale * a // (f[p[: k + 1]] + f[(lang, *words[k:])]), k, f[p[: k + 1]], f[(lang, *words[k:])]) for k in range(1, len(words))]
        score, _, left, right = min(cuts)
        holders = (b for q, b in candidates.items() if q[0] == lang and len(q) > len(p) and any(q[i : i + len(words)] == words for i in range(1, len(q))))
        if not any(100 * b >= cover * a for b in holders):
            out.append((lang, " ".join(words), a, left, right, n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, i, *r[1:]) for i, r in enumerate(own[:top], 1)]
    return sorted(ranked)


def phrases_of(spark, rows, **kw):
    given = spark.createDataFrame([(t, lang, 1, "x") for t, lang in rows], "text string, lang string, rank int, phrase string")
    return sorted(tuple(r) for r in phrases.collocations(given, **kw).collect())


@pytest.fixture(scope="module")
def phrase_rows():
    draw = random.Random(9)
    words = ["Of", "the", "new", "york", "times", "é", "É", "a b", "x" * 200, "THE", "\x1cq"]
    marks = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "\x0b"]
    rows = []
    for _ in range(300):
        text = "".join(draw.choice(words) + draw.choice(marks) for _ in range(draw.randint(0, 25)))
        rows.append((text, draw.choice(["en", "en", "fr", "", None, "und"])))
    return [*rows, (None, "en"), ("", None), ("new york times new york " * 2_000, "en"), *rows[:40], ("alone", "xx")]


@pytest.mark.parametrize(("least", "top"), [(30, 2_000), (5, 7), (2, 40)])
def test_phrases_equal_plain_counts(spark, phrase_rows, least, top):
    assert phrases_of(spark, phrase_rows, least=least, top=top) == plain_phrases(phrase_rows, least, top)


def test_phrases_do_not_depend_on_the_map_of_pairs(spark, phrase_rows, monkeypatch):
    """A map so small that nearly all its bits are set leaves longer windows, and the same counts; blocks may be cut anywhere."""
    monkeypatch.setattr(phrases, "LEAST_BITS", 8)
    monkeypatch.setattr(phrases, "MOST_BITS", 8)
    monkeypatch.setattr(phrases, "_BITMAP", 8)
    monkeypatch.setattr(phrases, "BLOCK", 1_000)
    everything = (8, np.full(1, 255, dtype=np.uint8))
    monkeypatch.setattr(phrases, "_frequent_pairs", lambda docs, least: everything)
    assert phrases_of(spark, phrase_rows, least=5) == plain_phrases(phrase_rows, 5, 2_000)


def test_a_block_sends_each_phrase_once(spark, phrase_rows):
    """What leaves a task are the phrases of its windows, none that ends in padding, and no row for each level of a window."""
    given = spark.createDataFrame([(t, lang) for t, lang in phrase_rows], "text string, lang string")
    found = phrases.frequent_phrases(given, 5)
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()
    rows = [(r.lang, tuple(r.words)) for r in found.collect()]
    assert len(rows) == len(set(rows)) and all(None not in words for _, words in rows)
    assert {lang for lang, words in rows if not words} == {lang if lang is not None else "und" for t, lang in phrase_rows if t and re.search(r"[^\x20\x09-\x0D.,;:!?]", t)}


def test_phrases_of_nothing(spark):
    assert phrases_of(spark, []) == [] == phrases_of(spark, [(None, None), ("rare words only", "en")])


def test_exact_beyond_64_bits(spark, monkeypatch):
    """Counts of a large corpus: the product with the scale needs more than 64 bits."""
    big = 1 << 60
    rows = [("en", ["a", "b"], big), ("en", ["a"], big + 1), ("en", ["b"], big + 2), ("en", [], 3 * big)]
    found = spark.createDataFrame(rows, "lang string, words array<string>, f long")
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *a, **k: found)
    got = phrases.collocations(spark.createDataFrame([], "text string, lang string")).first()
    assert got.score == 2_000_000 * big // (2 * big + 3) and got.a == big
