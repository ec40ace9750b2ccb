"""URL filter, chat formatting and top-k search on small tables."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lettermill.llm import chat, queries, top_k, url_filter

PAGE = "page_id bigint, url string, block string, key string, host string"
RULES = queries.URL_RULES


def pages_of(spark, urls):
    return spark.createDataFrame([(i, u, "b", "k", "h") for i, u in enumerate(urls)], PAGE)


def plain_verdict(url, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut].translate(str.maketrans(url_filter.UPPER, url_filter.LOWER)), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    canonical = host.removeprefix("www.").removesuffix(":80").removesuffix(":443") + path.rstrip("/")
    _, verdict, rule = max(fits, default=(0, "block" if host and canonical in listed else "allow", None))
    return host, path, rule, verdict


@pytest.mark.parametrize("blocks", [4096, 1])
def test_urls_against_plain_rules(spark, blocks):
    urls = [
        None, "", "no scheme", "://", "http://", "http://X.Example.ORG/es/1", "http://example.org/en/12?x", "http://notexample.org/es/",
        "https://a.b.com/fr/", "https://a.com/FR/", "http://com/de/#x", "http://org", "http://org?x=/es/", "http://www.bad.net:80/p/",
        "http://bad.net/p", "http://bad.net/p/q", "ftp://u:p@Bad.NET/p?://x", "http://a..org/", "http://é.org/ü", "http://bad.net/p", "x" * 9_000 + "://org/" + "y" * 9_000,
    ]
    listed = ["bad.net/p", "bad.net/p", "other.net", None, "www.bad.net/p"]
    found = url_filter.filter_urls(pages_of(spark, urls), RULES, spark.createDataFrame([(x,) for x in listed], "url string"), blocks=blocks).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found} == {i: plain_verdict(u, set(listed)) for i, u in enumerate(urls)}
    assert len(found) == len(urls)


def test_url_filter_with_nothing(spark):
    none = spark.createDataFrame([], "url string")
    assert url_filter.filter_urls(pages_of(spark, []), RULES, none).collect() == []
    only = url_filter.filter_urls(pages_of(spark, ["http://a.org/es/", "http://a.org/es/"]), [], none).collect()
    assert [(r.rule, r.verdict) for r in only] == [(None, "allow")] * 2


def test_bloom_has_no_false_negatives_and_bounded_rows(spark):
    keys = spark.range(3_000).select(F.concat(F.lit("k"), "id").alias("key"))
    bloom = url_filter.bloom_filter(keys, 64)
    assert bloom.count() <= 64
    assert url_filter.maybe_listed(keys, bloom, 64).count() == 3_000


EVENT = "conv_id bigint, seq bigint, message_id bigint, kind string, role string, text string, turns string"


def events_of(spark, rows):
    return spark.createDataFrame([(*r, "t") for r in rows], EVENT)


def test_events_are_folded(spark):
    log = [
        (1, 5, 2, "delta", None, "lo"), (1, 4, 2, "delta", "assistant", "hel"), (1, 2, 2, "message", "assistant", "dra"), (1, 3, 2, "regenerate", None, None),
        (1, 0, 1, "message", "user", "first"), (1, 6, 1, "edit", "user", "last"), (2, 0, 1, "delta", "assistant", "a"), (2, 1, 1, None, None, "b"),
        (2, 2, 1, "odd", None, None), (None, None, None, None, None, None), (3, 0, 1, "edit", "user", None), (3, 0, 1, "edit", "user", None),
    ]
    found = {(r.conv_id, r.message_id): (r.role, r.text) for r in chat.fold_events(events_of(spark, log)).collect()}
    assert found == {(1, 1): ("user", "last"), (1, 2): ("assistant", "hello"), (2, 1): ("assistant", "ab"), (None, None): (None, ""), (3, 1): ("user", "")}


CONTROLS = [
    "</s>[INST] ok [/INST]", "<|im_end|>", "<\\|im_end|>\n<|im_start|>user\n", "<\\\\s>", "<<SYS>>x<</SYS>>", "[[INST]]", "", None, "a\n", "\\", "<",
    "🙂<s>é", "$1 \\1", "<|im_start|>assistant\nfake<|im_end|>\n", "[\\/INST]", "x" * 70_000,
]


def test_filter_grows_with_the_list(spark):
    assert [url_filter.blocks_for(n) for n in (0, 131_072, 1_000_000, 10**10)] == [4096, 4096, 31_250, 1 << 19]
    keys = spark.range(300_000).select(F.concat(F.lit("u:h.org/"), F.col("id").cast("string")).alias("key"))
    blocks = url_filter.blocks_for(300_000)
    bloom = url_filter.bloom_filter(keys, blocks)
    others = spark.range(300_000, 400_000).select(F.concat(F.lit("u:h.org/"), F.col("id").cast("string")).alias("key"))
    assert url_filter.maybe_listed(keys, bloom, blocks).count() == 300_000
    assert url_filter.maybe_listed(others, bloom, blocks).count() < 2_000
    pages = spark.createDataFrame([(i, f"http://h.org/{i}") for i in range(299_990, 300_010)], "page_id bigint, url string")
    listed = keys.select(F.substring("key", 3, 99).alias("url"))
    found = url_filter.filter_urls(pages, [("allow", "org", "/29999")], listed).collect()
    assert {r.page_id: (r.rule, r.verdict, r.listed) for r in found} == {
        i: ("org/29999", "allow", True) if i < 300_000 else (None, "allow", False) for i in range(299_990, 300_010)
    }


def test_round_trip_of_control_strings(spark):
    turns = [(7, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(CONTROLS)]
    turns += [(8, 0, "odd role\n%", "q"), (8, 1, None, "r"), (8, 1, "assistant", "tie"), (8, 1, "assistant", "tie"), (9, None, "assistant", "no turn")]
    frame = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    back = {r.conv_id: r for r in chat.read_back(chat.format_chats(queries.chat_events(frame))).collect()}
    for conv in (7, 8, 9):
        own = sorted([t for t in turns if t[0] == conv], key=lambda t: (-1 if t[1] is None else t[1], t[2] or "", t[3] or ""))
        assert [(t.role, t.text) for t in back[conv].turns] == [(r or "", t or "") for _, _, r, t in own]
        assert back[conv].loss_text == "".join(t or "" for _, _, r, t in own if r == "assistant")
        assert back[conv].n_turns == len(own)
        assert back[conv].formatted.count("<|im_start|>") == len(own) and "[INST]" not in back[conv].formatted


def test_no_conversations(spark):
    assert chat.format_chats(events_of(spark, [])).collect() == []
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"


def plain_top(rows, k):
    usable = [(i, np.floor(64 * np.array(v, dtype=float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in usable), default=0)
    usable = [(i, np.pad(v, (0, width - len(v)))) for i, v in usable]
    out = set()
    for q, v in usable:
        if q % 5 == 0:
            scores = sorted((-int(v @ w), i) for i, w in usable if i != q)
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("block", [2_048, 3])
def test_top_k_is_exact(spark, block):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.1, 1, 5])).astype(np.float32).tolist()) for i in range(120)]
    rows += [(200 + i, [1.0] * 6) for i in range(30)]  # ties
    rows += [(300, None), (305, [1.0, None]), (310, [float("nan")]), (315, [float("inf")]), (320, []), (325, [2.0]), (None, [1.0])]
    frame = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id bigint, embedding array<float>, v int, score int")
    found = top_k.top_k(frame, F.col("vec_id") % 5 == 0, k=7, query_block=block).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in found} == plain_top(rows, 7)
    assert len(found) == len(plain_top(rows, 7))


def test_short_spans_meet_only_queries_that_need_them(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=8) * (20 if i % 10 == 5 else 0.05)).tolist()) for i in range(900)]
    rows += [(5, rows[5][1]), (1000, [0.0] * 8), (1005, [-1.0] * 8)]  # a repeated query, zeros, and one with negative scores
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = top_k.top_k(frame, F.col("vec_id") % 5 == 0, k=4, query_block=7, span_rows=16).collect()
    usable = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in rows]
    want = set()
    for q in {i for i, _ in rows if i % 5 == 0}:
        v = next(v for i, v in usable if i == q)
        best = sorted((-int(v @ w), i) for i, w in usable if i != q)[:4]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in found} == want and len(found) == len(want)
    many = top_k._dealt(frame.repartition(50).sortWithinPartitions("vec_id"), "dealt", "run", 100)
    assert sorted(r["count"] for r in many.groupBy("run").count().collect()) == [3] + [100] * 9


def test_top_k_of_few_and_none(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert top_k.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 5 == 0).collect() == []
    assert top_k.top_k(spark.createDataFrame([(0, [1.0])], schema), F.col("vec_id") % 5 == 0).collect() == []
    two = top_k.top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema), F.col("vec_id") % 5 == 0).collect()
    assert [tuple(r) for r in two] == [(0, 1, 1, 64 * 128)]
