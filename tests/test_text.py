import random
import re

from pyspark.sql import functions as F

from lettermill.functions import text as T
from lettermill.functions import vectors as V

PIECES = ["a", "Word", "it's", "é", "İ", "K", " ", "  ", "\t", "\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ",
          "​", "﻿", "　", "1", "-2", ".", "!", "?"]


def _random_texts(n=300, seed=3):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12))) for _ in range(n)]
    return texts + ["", " ", "!!!", "\x1c\x85", "a b"]


def test_text_expressions_agree_with_python(spark):
    texts = _random_texts()
    rows = (
        spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        .select(
            "i",
            T.collapse_whitespace(F.col("t")).alias("ws"),
            T.is_blank(F.col("t")).alias("blank"),
            T.word_tokens(F.col("t")).alias("tokens"),
            T.split_words(F.col("t")).alias("words"),
        )
        .collect()
    )
    for r in rows:
        t = texts[r.i]
        assert r.ws == re.sub(r"\s+", " ", t).strip(), repr(t)
        assert r.blank == (not t.strip()), repr(t)
        assert r.tokens == re.findall(r"[A-Za-z0-9']+", t.lower()), repr(t)
        assert r.words == t.split(), repr(t)


def test_summary(spark):
    long_sentence = "word " * 60
    cases = {
        "Boats leave at nine. Bring a warm coat.": "Boats leave at nine.",
        "One two\n three": "One two three",
        long_sentence: " ".join(["word"] * 48) + "...",
        "x" * 241 + " tail. Next": "x" * 241 + " tail. Next",
        " \n ": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.s for r in df.select("t", T.extractive_summary(F.col("t")).alias("s")).collect()}
    assert got == cases


def test_integers(spark):
    row = spark.createDataFrame([("1 x 22 -3 9999999999999999999 4.5",)], "t string").select(
        T.parse_int_list(F.col("t")).alias("l"), T.parse_int(F.lit(" 17 ")).alias("a"), T.parse_int(F.lit("no")).alias("b")
    ).first()
    assert (row.l, row.a, row.b) == ([1, 22, -3], 17, None)


def test_vector_literal_and_unit(spark):
    row = spark.createDataFrame([([3.0, 4.0],)], "v array<double>").select(
        V.vector_literal(F.col("v")).alias("l"),
        V.scale_to_unit(F.col("v"), V.l2_norm(F.col("v"))).alias("u"),
        V.scale_to_unit(F.array(F.lit(0.0)), F.lit(0.0)).alias("z"),
    ).first()
    assert row.l == "[3.00000000,4.00000000]" and row.u == [0.6, 0.8] and row.z == [0.0]
