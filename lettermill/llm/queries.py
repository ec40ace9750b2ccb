"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.llm import (
    chat, decontamination, html_text, lang_id, packing, phrases, pii, quality, simhash, token_counts, top_k, url_filter, vector_codes,
)
from lettermill.session import fresh_dir

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- 1: benchmark decontamination


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage in every document."""
    return decontamination.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


# --- 2: language ID


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; a third of them is not learned from."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = lang_id.predict(docs.select("doc_id", "text"), lang_id.train_on_rest(docs))
    return found.select("doc_id", lang_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


# --- 3: URL filter

URL_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]
LISTED_SITES = r"(^|\.)(spam-farm|cheap-pills|adult-x|free-bets)\."


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every page. The list of blocked URLs stands for a feed: the canonical URLs of the pages of known bad sites."""
    pages = _table(spark, sf_dir, "pages")
    host, path = url_filter.url_host(F.col("url")), url_filter.url_path(F.col("url"))
    listed = pages.where(host.rlike(LISTED_SITES)).select(url_filter.canonical_url(host, path).alias("url"))
    return url_filter.filter_urls(pages, URL_RULES, listed)


OP3_SQL = r"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                                ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) AS r(verdict, host, path)),
judged AS (
  SELECT p.*, (SELECT max_by(struct_pack(rule := r.host || r.path, verdict := r.verdict), length(r.host || r.path)) FROM rules r
               WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)) AS best,
         regexp_replace(regexp_replace(p.host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(p.path, '/+$', '') AS canonical
  FROM parts p),
bad AS (SELECT DISTINCT canonical FROM judged WHERE regexp_matches(host, '(^|\.)(spam-farm|cheap-pills|adult-x|free-bets)\.'))
SELECT page_id, host, path, best.rule AS rule,
       coalesce(best.verdict, CASE WHEN b.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       b.canonical IS NOT NULL AS listed
FROM judged j LEFT JOIN bad b ON b.canonical = j.canonical AND j.host <> ''
"""

# --- 6: SimHash near-duplicates


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, radius=3)
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


# --- 7: HTML extraction


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


# --- 8: exact top-k search


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of every twentieth vector among all others."""
    return top_k.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scores QUALIFY rank <= 20
"""

# --- 10: chat formatting

DRAFT, DELTA = 40, 256


def chat_events(turns: DataFrame) -> DataFrame:
    """The log that ``turns`` (conv_id, turn, role, text) come from.

    A message starts as a short draft. A user's or system's draft is edited into the full text; an assistant's is regenerated and
    streamed in pieces. Every row of the table is a message of its own; a null turn
    comes before turn 0.
    """
    text = F.coalesce("text", F.lit(""))
    kind = lambda name, body: F.struct(F.lit(name).alias("kind"), body.alias("text"))
    pieces = F.transform(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{DELTA}}}"), F.lit(0)), lambda p: kind("delta", p))
    rest = F.when(F.col("role") == "assistant", F.concat(F.array(kind("regenerate", F.lit(""))), pieces))
    log = F.concat(F.array(kind("message", F.substring(text, 1, DRAFT))), rest.otherwise(F.array(kind("edit", text))))
    rows = turns.select("conv_id", "turn", "role", F.monotonically_increasing_id().alias("message_id"), log.alias("log"))
    return rows.select("conv_id", "turn", "role", "message_id", F.posexplode("log").alias("n", "event")).select(
        "conv_id", (F.coalesce("turn", F.lit(-1)) * F.lit(1 << 32) + F.col("n")).alias("seq"), "message_id", "role", "event.kind", "event.text"
    )


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and conversation -7, and read the result back."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id bigint, turn bigint, role string, text string")
    back = chat.read_back(chat.format_chats(chat_events(turns.unionByName(extra))))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", "n_turns", F.sha2(told, 256).alias("turns_sha256"), F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


OP10_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) AS e),
escaped AS (
  SELECT *, length(regexp_replace(text,
    '([<\[])(\\*(?:/?s>|/?INST\]|</?SYS>>|\|(?:im_start|im_end|system|user|assistant|endoftext)\|>))', '\1\\\2', 'g')) AS n FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|>') + length(role) + 1 + n + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""

# --- 4: personal data

PII_KEY = "corpus"


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with surrogates for personal data."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_pii(docs, PII_KEY).select("doc_id", "text", "pii_count")


# --- 5 and 9: packing and token counts

BPE = "byte_bpe_50k.json"
WINDOW, END_ID = 1024, 0


def tokenizer_path(name: str = BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 1024 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), window=WINDOW, end_id=END_ID)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count the tokens of all documents, with a cache that is empty before."""
    cache = fresh_dir(spark, "token-cache")
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), cache, tokenizer_path(), limit=WINDOW)


# --- 11: vector codes


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of every vector, after four rounds over four codebooks of 256 entries."""
    return vector_codes.vector_codes(_table(spark, sf_dir, "embeddings"), scale=1024, parts=4, entries=256, rounds=4)


def _vector_codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The plain rounds: every part against every entry."""
    ctes = [
        """rows AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""parts AS MATERIALIZED (
  SELECT row, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS v FROM rows, range({parts}) AS p(part))""",
        f"book0 AS MATERIALIZED (SELECT part, row - 1 AS entry, v FROM parts WHERE row <= {entries})",
    ]
    for i in range(rounds + 1):
        ctes.append(
            f"""near{i} AS MATERIALIZED (
  SELECT row, part, min(struct_pack(
    d := CAST(list_sum(list_transform(range(1, len(p.v) + 1), lambda j: (p.v[j] - b.v[j]) * (p.v[j] - b.v[j]))) AS BIGINT), e := b.entry)) AS best
  FROM parts p JOIN book{i} b USING (part) GROUP BY row, part)"""
        )
        if i < rounds:
            ctes.append(
                f"""cells{i} AS (
  SELECT part, entry, j, floor(sum(x) / count(*)) AS x FROM (
    SELECT part, best.e AS entry, unnest(range(1, len(v) + 1)) AS j, unnest(v) AS x FROM near{i} JOIN parts USING (row, part))
  GROUP BY part, entry, j)"""
            )
            ctes.append(
                f"""book{i + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(n.v, b.v) AS v FROM book{i} b
  LEFT JOIN (SELECT part, entry, list(CAST(x AS BIGINT) ORDER BY j) AS v FROM cells{i} GROUP BY part, entry) n USING (part, entry))"""
            )
    ctes.append(
        f"""codes AS (
  SELECT row, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{rounds} GROUP BY row)"""
    )
    return f"""WITH {", ".join(ctes)}
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM book{rounds}) AS codebooks_sha256
FROM codes JOIN rows USING (row)"""


OP11_SQL = _vector_codes_sql()

# --- 12: quality rules


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document, the classifier being fitted on the labelled ones."""
    docs = _table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


# --- 13: phrase collocations


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of every language."""
    return phrases.collocations(_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
lists AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
grams AS (
  SELECT lang, w[i : i + k - 1] AS words, count(*) AS f FROM starts, range(1, 5) AS sizes(k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
sizes AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE len(words) = 1 GROUP BY lang),
candidates AS MATERIALIZED (SELECT lang, words, f AS a FROM grams WHERE len(words) > 1 AND f >= 30),
cuts AS (
  SELECT c.lang, c.words, c.a, k, x.f AS l, y.f AS r,
         CAST((CAST(2000000 AS HUGEINT) * c.a) // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, len(words))) AS k FROM candidates) c
  JOIN grams x ON x.lang = c.lang AND x.words = c.words[1 : k] JOIN grams y ON y.lang = c.lang AND y.words = c.words[k + 1 :]),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
inside AS (
  SELECT lang, words[i : i + m - 1] AS words, max(a) AS held
  FROM (SELECT *, unnest(range(1, len(words) - m + 2)) AS i FROM (SELECT *, unnest(range(2, len(words))) AS m FROM candidates))
  GROUP BY ALL),
kept AS (
  SELECT w.lang, array_to_string(w.words, ' ') AS phrase, a, l, r, score FROM worst w LEFT JOIN inside USING (lang, words)
  WHERE held IS NULL OR 100 * CAST(held AS HUGEINT) < 80 * CAST(a AS HUGEINT))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN sizes USING (lang) QUALIFY rank <= 2000
"""


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_language_id": op2_language_id,
    "op4_pii": op4_pii,
    "op5_packing": op5_packing,
    "op6_simhash": op6_simhash,
    "op7_html_text": op7_html_text,
    "op8_top_k": op8_top_k,
    "op9_token_counts": op9_token_counts,
    "op3_url_filter": op3_url_filter,
    "op10_chat_format": op10_chat_format,
    "op11_vector_codes": op11_vector_codes,
    "op12_quality": op12_quality,
    "op13_collocations": op13_collocations,
}
SQL = {
    "op3_url_filter": OP3_SQL, "op8_top_k": OP8_SQL, "op10_chat_format": OP10_SQL, "op11_vector_codes": OP11_SQL, "op13_collocations": OP13_SQL,
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
