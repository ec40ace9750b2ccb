"""SimHash components and near-duplicate groups against brute force, and their edge cases."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lettermill.llm import near_text, simhash

DOCS = "doc_id bigint, text string, key string, row string, maybe string, fp string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "k", "r", "m", "f") for i, t in rows], DOCS)


def words(n, seed):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 9_999, n))


def plain_fingerprint(text):
    tokens = [t.decode() for t in (text or "").encode().lower().split()]
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + 3]) for i in range(max(1, len(tokens) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(links, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.fixture(scope="module")
def texts():
    base = [words(40, i) for i in range(30)]
    near = [b.replace("w1", "w2", 1) for b in base[:10]] + [b + " tail" for b in base[:10]]
    odd = [None, "", " \t\n", "one", "one two", "One  TWO", "ÀÉ àé", "x" * 5_000, words(30_000, 99)]
    return list(enumerate(base + near + base[:5] * 3 + odd, start=1))


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 1])
def test_components_are_those_of_all_pairs(spark, texts, bucket):
    found = simhash.near_duplicates(docs_of(spark, texts), bucket=bucket).collect()
    prints = {i: plain_fingerprint(t) for i, t in texts}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    wanted = components(links, prints)
    assert {r.doc_id: r.fp % (1 << 64) for r in found} == prints
    assert {r.doc_id: r.component_id for r in found} == wanted


def test_links_at_three_bits_are_found_and_at_four_not(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    pairs = {}
    for n, b in enumerate(base):
        bits = rng.choice(64, 3 + n % 2, replace=False)
        pairs[int(b)] = int(b) ^ sum(1 << int(x) for x in bits)
    signed = [x - (1 << 64) if x >> 63 else x for p in pairs.items() for x in p]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint")).collect()
    got = {frozenset((e.a % (1 << 64), e.b % (1 << 64))) for e in edges}
    assert got == {frozenset(p) for p in pairs.items() if (p[0] ^ p[1]).bit_count() == 3}


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 160)]
    found = simhash.connected_components(spark.createDataFrame(path + star + path, "a bigint, b bigint")).collect()
    assert {r.node: r.root for r in found} == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)}


def test_empty_table(spark):
    assert simhash.near_duplicates(docs_of(spark, [])).collect() == []
    assert near_text.drop_near_duplicates(docs_of(spark, [])).collect() == []


def test_one_of_each_group_stays(spark, texts):
    docs = docs_of(spark, texts)
    kept = near_text.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    sets = {i: frozenset(near_text.shingle_hashes(t).tolist()) for i, t in texts}

    def alike(a, b):
        return a == b or bool(a | b) and len(a & b) >= 0.8 * len(a | b)

    wanted = components([(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])], sets)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(wanted.values()))


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (None, "other words here"), (None, "other words here")]
    kept = near_text.drop_near_duplicates(docs_of(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.text) for r in kept) == [(False, "a b c d e f g"), (True, "other words here")]


def test_forest_reaches_over_others():
    sets = [frozenset(range(i, i + 100)) for i in (0, 8, 16, 24, 400)]
    names = [bytes([i]) for i in range(5)]
    assert len(near_text.forest(names, sets, 0.8)) == 3


def test_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_text, "PART", 12_000)
    texts = []
    for group in range(3):
        base = words(400, 70 + group).split()
        for copy in range(25):
            own = list(base)
            for place in np.random.default_rng(copy).choice(range(8, 390, 9), 8 if copy else 0, replace=False):
                own[place] = f"x{group}-{copy}-{place}"
            texts.append(" ".join(own))
    rows = list(enumerate(texts))
    sets = [frozenset(near_text.shingle_hashes(t).tolist()) for t in texts]
    links = [(a, b) for a in range(75) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert all(0 in {a % 25, b % 25} for a, b in links) and len(links) == 72  # alike to the base only
    kept = near_text.drop_near_duplicates(docs_of(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == [0, 25, 50]


def test_links_of_the_simhash_operator_are_candidates(spark, monkeypatch):
    """Without any shared sample the texts that SimHash links still meet; what is not alike stays."""
    signatures, operator, calls = near_text._signatures, simhash.near_duplicates, []
    monkeypatch.setattr(near_text, "_signatures", lambda own: signatures(own).withColumn("samples", F.array(F.xxhash64("digest"))))
    monkeypatch.setattr(simhash, "near_duplicates", lambda *a, **k: calls.append(k) or operator(*a, **k))
    base = [words(4_000, 300 + i) for i in range(12)]
    rows = list(enumerate(base + [b + " one more" for b in base]))
    prints = [plain_fingerprint(t) for _, t in rows]
    wanted = [i for i in range(24) if i < 12 or (prints[i] ^ prints[i - 12]).bit_count() > 3]
    assert len(wanted) < 24
    kept = near_text.drop_near_duplicates(docs_of(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == wanted and len(calls) == 1


def test_a_hot_key_is_summed_up_before_it_is_shuffled(spark):
    filed = spark.range(4_000).selectExpr("if(id % 2 = 0, -1, id) key", "unhex(md5(cast(id as string))) digest", "id % 3 > 0 own")
    filed = filed.unionByName(spark.createDataFrame([(5_000, b"a", True), (5_000, b"b", False), (5_001, b"a", True), (5_001, b"b", True), (5_002, b"a", False), (5_002, b"c", False)], "key bigint, digest binary, own boolean"))
    found = near_text._shared(filed)
    assert "MapInArrow" not in found._jdf.queryExecution().toString()  # no Python process holds the texts of a key
    by_bucket = {}
    for r in found.collect():
        by_bucket.setdefault(r.bucket, []).append(bytes(r.digest))
    assert sorted(map(len, by_bucket.values())) == [2, 2_000]
    assert sorted(min(by_bucket.values(), key=len)) == [b"a", b"b"]
