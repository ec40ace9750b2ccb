"""The pipeline stage by stage against brute force, over the smallest tables."""

import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lettermill.llm import lang_id, near_text, pii
from lettermill.llm.queries import END_ID, WINDOW, tokenizer_path
from lettermill.session import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage got and gave, as lists of rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        given = materialize(stage(spark, docs, SF), f"test-{name}")
        out[name] = docs.collect(), given.collect(), docs.columns, given.columns
        docs = given
    return out


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == list(stages)
    assert all(a == b for _, _, a, b in list(stages.values())[:-1])


def test_language(spark, stages):
    before, after, _, _ = stages["language"]
    model = lang_id.train_on_rest(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang"))
    _, _, rejected = lang_id.judge(pa.array([r.text for r in before]), model)
    good = {r.doc_id for r, bad in zip(before, rejected, strict=True) if not bad and re.search(r"[^\W\d_]", r.text or "")}
    assert {r.doc_id for r in after} == good and len(good) > 0.98 * len(before)


def test_near_duplicates(stages):
    before, after, _, _ = stages["near-duplicates"]
    sets = {r.doc_id: set(near_text.shingle_hashes(r.text).tolist()) for r in before}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {r.doc_id for r in after} == {find(i) for i in sets}


def test_decontamination(stages):
    before, after, _, _ = stages["decontamination"]
    plain = lambda t: f" {' '.join(re.findall('[^\\W_]+', t.lower()))} "
    passages = [plain(t) for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    holds = {r.doc_id for r in before if any(p in plain(r.text) for p in passages)}
    assert holds and {r.doc_id for r in before} - {r.doc_id for r in after} == holds


def test_personal_data(stages):
    before, after, _, _ = stages["personal-data"]
    new = {r.doc_id: r for r in after}
    assert set(new) == {r.doc_id for r in before}
    signs = r"[\w.]+@mail\d+\.example\.com|\+1 \(\d{3}\) 555-\d{4}|AKIA\w{16}|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b[0-9a-f]{40}\b"
    for r in before:
        found = re.findall(signs, r.text)
        assert not any(f in new[r.doc_id].text for f in found)
        assert new[r.doc_id].n_chars == (len(new[r.doc_id].text) if new[r.doc_id].text != r.text else r.n_chars)
        if not re.search(r"[0-9@]|" + "|".join([pii.MALE, pii.FEMALE, pii.NEUTRAL]), r.text):
            assert new[r.doc_id] == r


def test_packing(stages):
    before, after, _, _ = stages["packing"]
    library = Tokenizer.from_file(tokenizer_path())
    sizes = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before}
    packed = dict.fromkeys(sizes, 0)
    for r in after:
        packed[r.doc_id] += r.length
        assert r.offset + r.length <= WINDOW and END_ID == 0
    assert packed == sizes
    assert np.all(np.bincount([r.start == 0 for r in after])[1] == len(sizes))


ODD = [
    (1, None, "en", "s", 0, "x"), (2, "", "en", "s", 0, "x"), (3, "12 34", None, None, None, None), (None, "no id, but words enough to be read", "en", "s", 1, "x"),
    (5, "one and the same text stands here twice over", "en", "s", 3, "x"), (5, "one and the same text stands here twice over", "en", "s", 3, "x"),
    (6, "long " * 60_000, None, "s", 3, "x"),
]


@pytest.mark.parametrize("rows", [[], ODD])
def test_stages_on_odd_rows_and_no_labels(spark, rows):
    docs = spark.createDataFrame([(*r[:2], None, *r[3:]) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, score string")
    for name, stage in corpus_pipeline.STAGES:
        given = materialize(stage(spark, docs, SF), f"odd-{name}")
        assert name == "packing" or given.columns == docs.columns
        if name == "language":
            assert {r.text for r in given.collect()} == {r[1] for r in rows if r[1] and "o" in r[1]}
        if name == "near-duplicates":
            assert given.count() == len({r[1] for r in rows if r[1] and "o" in r[1]})
        docs = given
    assert {r.doc_id for r in docs.collect()} == ({None, 5, 6} if rows else set())
