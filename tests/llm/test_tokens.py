"""Token counts, exact ids and packing against the tokenizer library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lettermill.llm import codec as codec_module
from lettermill.llm import packing, token_counts
from lettermill.llm.codec import Codec
from lettermill.session import fresh_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
SCHEMA = "doc_id bigint, text string, ids string, digest string, n_tokens string"


def wanted(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x", "x") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(4)
    parts = ["the", " ", "  ", "\n", "\t", "é", "中", "🙂", "12", "'s", "!", " ", "　", "\x1c", "<|endoftext|>", "word", "_"]
    made = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 30))) for _ in range(300)]
    made += [None, "", " ", "a" * 3_000, "long text of words " * 3_000, "same text", "same text"]
    return list(enumerate(made))


def test_codec_equals_library(rows):
    texts = pa.array([t for _, t in rows], pa.string())
    got = {}
    for first, ids, begin in Codec(PATH).encode(texts):
        got |= {first + i: ids[begin[i] : begin[i + 1]].tolist() for i in range(len(begin) - 1)}
    assert got == {i: wanted(t) for i, t in rows}


def _alike(letters, n):
    """A word over two letters and its complement: a polynomial hash modulo 2 ** 64 is the same for both, whatever its base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


@pytest.mark.parametrize("n", [1_024, 2_048, 4_096, 8_192])
def test_pieces_of_one_length_are_told_apart(n):
    words = [w for letters in ("ab", "xy") for w in _alike(letters, n)]
    together = pa.array([" ".join(words), *words, words[1] + " " + words[0]])
    one = Codec(PATH)
    for texts in (together, *[pa.array([w]) for w in words], together):  # alone, together and after one another in one worker
        got = [x.tolist() for first, ids, begin in one.encode(texts) for x in np.split(ids, begin[1:-1])]
        assert got == [wanted(t) for t in texts.to_pylist()]


def test_pieces_with_equal_keys(monkeypatch):
    """Were keys to collide, the bytes would still decide: within a block, and against remembered pieces."""
    from lettermill.llm import codec as module

    monkeypatch.setattr(module, "_mixed", lambda x: np.zeros_like(x))
    one = Codec(PATH)
    for texts in (["word"], ["lord"], ["some lord", "word word"], ["some word", "some word"], ["", "a b c"], ["longer"]):
        got = [x.tolist() for first, ids, begin in one.encode(pa.array(texts)) for x in np.split(ids, begin[1:-1])]
        assert got == [wanted(t) for t in texts]


def test_other_tokenizers_are_used_whole():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert Codec(path).ids("Some <s> text.").tolist() == model.encode("Some <s> text.")
    path = public_tokenizers.path("word_bpe_49k.json")
    assert Codec(path).ids("Some Text").tolist() == Tokenizer.from_file(path).encode("Some Text", add_special_tokens=False).ids


def test_counts_and_cache(spark, rows):
    cache = fresh_dir(spark, "cache")
    docs = docs_of(spark, rows)
    first = token_counts.count_tokens(docs, cache, PATH, limit=100).collect()
    assert {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in first} == {
        (i, len((t or "").encode()), len(wanted(t)), len(wanted(t)) > 100) for i, t in rows
    }
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for _, t in rows})
    more = docs_of(spark, [*rows, (999, "a text not seen before")])
    assert token_counts.count_tokens(more, cache, PATH).count() == len(rows) + 1
    assert spark.read.parquet(cache).count() == stored + 1
    other = public_tokenizers.path("word_bpe_49k.json")
    token_counts.count_tokens(docs_of(spark, [(1, "same text")]), cache, other).collect()
    assert spark.read.parquet(cache).count() == stored + 2


def test_empty_tables(spark):
    assert token_counts.count_tokens(docs_of(spark, []), fresh_dir(spark, "cache"), PATH).collect() == []
    assert packing.pack_documents(docs_of(spark, []), PATH).collect() == []


@pytest.mark.parametrize("shard_docs", [4_096, 7])
def test_packing_round_trip(spark, rows, shard_docs):
    found = packing.pack_documents(docs_of(spark, rows).repartition(3), PATH, window=64, shard_docs=shard_docs).collect()
    ids = {i: np.array([*wanted(t), 0], dtype="<u4") for i, t in rows}
    at = dict.fromkeys(ids, 0)
    for r in sorted(found, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        at[r.doc_id] += r.length
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : at[r.doc_id]].tobytes())
    assert at == {i: len(x) for i, x in ids.items()}
    sequences = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert all(n <= 64 and n & (n - 1) == 0 for n in sequences.values())


def test_neighbours_by_score():
    idf = np.zeros(50)
    idf[[7, 8, 9]] = 3, 2, 1
    docs = [np.array(x) for x in ([7, 8, 1], [9, 2, 3], [7, 8, 2], [8, 1, 1], [5, 5])]
    index = packing.Shard(docs, idf, 3.0)
    assert list(index.neighbours(index.use(0))) == [2, 3, 1, 4]


def test_weightiest_tokens_and_packed_bytes():
    """The tokens of a sort by weight, and pieces as numbers that tell their bytes apart up to the last one."""
    draw = np.random.default_rng(3)
    idf = np.where(draw.random(50) < 0.3, -np.inf, draw.integers(1, 4, 50).astype(float))
    for n in (0, 1, 2, 3, 40, 400):
        ids = draw.integers(0, 50, n).astype("<u2")
        terms, tf = np.unique(ids, return_counts=True)
        shared = np.isfinite(idf[terms])
        order = np.argsort(-packing.bm25(idf[terms[shared]], tf[shared], n + 1, 20.0), kind="stable")[:2]
        assert packing._weightiest(ids, idf, n + 1, 20.0) == (terms[shared][order].tolist() + [-1, -1])[:2]
    block = b"abcdefgh\0abcdefghij"
    chunks, at, n = codec_module._chunks(block, np.array([0, 9, 9, 9]), np.array([9, 8, 9, 10]))
    assert n.tolist() == [2, 1, 2, 2] and at.tolist() == [0, 2, 3, 5]
    assert [int(c).to_bytes(8, "little").rstrip(b"\0") for c in chunks] == [b"abcdefgh", b"", b"abcdefgh", b"abcdefgh", b"i", b"abcdefgh", b"ij"]


def test_every_token_of_a_seed_counts():
    idf = np.linspace(5, 4, 50)
    docs = [np.arange(20, 50), np.array([1, 2, 3]), np.array([1, 2, 49])]
    index = packing.Shard(docs, idf, 12.0)
    assert list(index.neighbours(index.use(0))) == [2, 1]


def test_neighbours_come_from_the_whole_corpus(spark):
    """Texts of one topic lie far from each other; their common word is in far more than a few of all documents."""
    rows = [(i, f"topic{i % 5}x " * 20 + f"only {i}") for i in range(60)]
    docs = docs_of(spark, rows).repartition(6, "doc_id")
    found = packing.pack_documents(docs, PATH, window=256, shard_docs=12).collect()
    topics = {}
    for r in found:
        topics.setdefault(r.sequence_id, set()).add(r.doc_id % 5)
    assert sum(r.length for r in found) == sum(len(wanted(t)) + 1 for _, t in rows)
    assert sum(len(t) == 1 for t in topics.values()) >= 0.6 * len(topics)


def test_document_counts_match(spark, rows):
    found = packing.encode_documents(docs_of(spark, rows), PATH, 0)
    df = {r.term: r.df for r in found.where("term is not null").groupBy("term").sum("df").withColumnRenamed("sum(df)", "df").collect()}
    sets = [set(wanted(t)) for _, t in rows]
    assert df.pop(-1) == len(rows) and df.pop(-2) == sum(len(wanted(t)) + 1 for _, t in rows)
    assert df == {t: sum(t in s for s in sets) for t in set().union(*sets)}
