"""Phrase collocations by top-order marginalisation.

Every word of a text opens one window: itself and the words that lead it by one, two and three places, padded where its piece ends. Only these
longest windows are counted, block by block of text; their columns are then taken off one by one, which sums each shorter prefix, down to single
words and the words of a language. A prefix that ends in padding is no phrase and is not made, so a block sends each phrase of one to four
words once, and one aggregation sums the blocks.

Most windows of a large corpus are unique, and would be shuffled for nothing. A first look at pairs of words therefore pads a window
from the first pair on that is too rare: no phrase that holds the pair can be frequent, so no frequent phrase loses an occurrence. Pairs are
counted by 64-bit hash, and the hashes of frequent ones set bits of a map of at most ``MOST_BITS``; a bit that two pairs share only leaves a window
longer than need be.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.llm.bytes_of import short_batches
from lettermill.session import materialize

NO_LANG = "und"
#: Words of a window.
LONGEST = 4
#: Bytes of text whose windows are counted together before they leave a task; a longer text is counted on its own.
BLOCK = 2 << 20
#: Rows of a batch that goes back to the JVM; it holds a whole batch outside its heap.
ROWS = 16_384
#: Bits of the map of frequent pairs: ``BITS_PER_PAIR`` for each, and 64 MB at most.
BITS_PER_PAIR, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 29
# An odd multiplier, and the number of bits of one bitmap of Spark's bitmap_construct_agg.
_ODD, _BITMAP = np.uint64(0x9E3779B97F4A7C15), 32_768
# What ends a piece, and what ends a word.
PIECE_END, WORD_END = r"[.,;:!?\n-\r]", r"[ \t]+"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(text, lang) columns of about ``BLOCK`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= BLOCK:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
            yield from ((b.column("text"), b.column("lang")) for b in whole)
    if held:
        yield from ((b.column("text"), b.column("lang")) for b in pa.Table.from_batches(held).combine_chunks().to_batches())


def _batches(arrays: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(arrays, names=names)
    yield from (whole.slice(at, ROWS) for at in range(0, len(whole), ROWS))


class _Words:
    """The words of some texts in order: codes into a dictionary, their language, and whether the next word is of the same piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        lower = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
        pieces = pc.split_pattern_regex(lower, PIECE_END)
        row_of_piece = pc.list_parent_indices(pieces).to_numpy()
        words = pc.split_pattern_regex(pc.list_flatten(pieces), WORD_END)
        piece, flat = pc.list_parent_indices(words), pc.list_flatten(words)
        filled = pc.greater(pc.binary_length(flat), 0)
        piece, coded = piece.filter(filled).to_numpy(), flat.filter(filled).dictionary_encode()
        self.dictionary, self.codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        lang = pc.fill_null(langs, NO_LANG).dictionary_encode()
        self.langs, self.lang = lang.dictionary, lang.indices.to_numpy().astype(np.int64)[row_of_piece[piece]]
        self.joined = np.zeros(len(piece), dtype=bool)  # with the next word
        self.joined[:-1] = piece[:-1] == piece[1:]

    def pair_keys(self) -> np.ndarray:
        """A 64-bit hash of (language, word, next word) at each joined word, else 0."""
        word = np.array([xxhash.xxh64_intdigest(w.as_buffer()) for w in self.dictionary], dtype=np.uint64)
        lang = np.array([xxhash.xxh64_intdigest(w.as_buffer(), seed=1) for w in self.langs], dtype=np.uint64)
        out = np.zeros(len(self.codes), dtype=np.uint64)
        at = np.flatnonzero(self.joined)
        key = (word[self.codes[at]] * _ODD) ^ (word[self.codes[at + 1]] + lang[self.lang[at]])
        key = (key ^ (key >> np.uint64(31))) * _ODD
        out[at] = key ^ (key >> np.uint64(29))
        return out


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for texts, langs in _blocks(batches):
        words = _Words(texts, langs)
        keys, counts = np.unique(words.pair_keys()[words.joined], return_counts=True)
        yield from _batches([pa.array(keys.view(np.int64)), pa.array(counts)], ["pair", "n"])


def _prefixes(words: _Words, kept: np.ndarray) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """(lang, phrase, count) of the prefixes of all windows: of no word, whose phrase is null, then of one to four words.

    ``kept`` says which words lead on to the next one. A prefix is the number of a shorter one and its last word.
    """
    size, at, own = len(words.dictionary), np.arange(len(words.codes)), words.lang
    langs, phrase = words.langs.cast(pa.string()), None
    counts = np.bincount(own, minlength=len(langs))
    seen = np.flatnonzero(counts)
    yield langs.take(pa.array(seen)), pa.nulls(len(seen), pa.string()), counts[seen]
    for ahead in range(LONGEST):
        if ahead:
            open_ = kept[at + (ahead - 1)]
            at, own = at[open_], own[open_]
        if not len(at):
            return
        own, seen = pd.factorize(own * size + words.codes[at + ahead])
        shorter, last = pa.array(seen // size), words.dictionary.take(pa.array(seen % size)).cast(pa.string())
        langs = langs.take(shorter)
        phrase = last if phrase is None else pc.binary_join_element_wise(phrase.take(shorter), last, " ")
        yield langs, phrase, np.bincount(own)


def _count_windows(frequent: object):  # noqa: ANN202
    """Counts of the phrases of each block, from its windows. ``frequent`` is a broadcast (bits, bitmap bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, mapped = frequent.value
        for texts, langs in _blocks(batches):
            words = _Words(texts, langs)
            bit = words.pair_keys() & np.uint64(bits - 1)
            kept = words.joined & ((mapped[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
            for lang, phrase, counts in _prefixes(words, kept):
                yield from _batches([lang, phrase, pa.array(counts)], ["lang", "phrase", "n"])

    return run


def _frequent_pairs(docs: DataFrame, least: int) -> tuple[int, np.ndarray]:
    """(bits, bitmap bytes): a set bit for the hash of each pair of words that occurs ``least`` times."""
    counted = docs.mapInArrow(_count_pairs, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = materialize(counted.where(F.col("n") >= least).select("pair"), "frequent-pairs")
    bits = LEAST_BITS
    wanted = pairs.count() * BITS_PER_PAIR
    while bits < min(wanted, MOST_BITS):
        bits *= 2
    place = F.col("pair").bitwiseAND(F.lit(bits - 1))
    parts = pairs.groupBy(F.floor(place / _BITMAP).alias("part")).agg(F.bitmap_construct_agg(F.pmod(place, F.lit(_BITMAP))).alias("bitmap"))
    mapped = np.zeros(bits // 8, dtype=np.uint8)
    for row in parts.toLocalIterator():  # at most bits / 32,768 rows of 4 KB
        mapped[row.part * _BITMAP // 8 :][: _BITMAP // 8] = np.frombuffer(row.bitmap, dtype=np.uint8)
    return bits, mapped


def frequent_phrases(docs: DataFrame, least: int, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, words, f): phrases of one to four words that occur ``least`` times in the texts of a language, with all their occurrences;
    and for each language one row without words, whose f counts all its words."""
    spark = docs.sparkSession
    short_batches(spark)
    own = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    pairs = spark.sparkContext.broadcast(_frequent_pairs(own, least))
    counted = own.mapInArrow(_count_windows(pairs), "lang string, phrase string, n bigint")
    summed = counted.groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    kept = summed.where(F.col("phrase").isNull() | (F.col("f") >= least))
    # Words hold no space.
    return kept.select("lang", F.coalesce(F.split("phrase", " "), F.array().cast("array<string>")).alias("words"), "f")


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def collocations(
    docs: DataFrame, *, least: int = 30, scale: int = 2_000_000, cover: int = 80, top: int = 2_000, text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of two to four words of each language whose words hold together best.

    A-Z are lower-cased, texts split into pieces at ``.,;:!?`` and line ends, pieces into words at blanks and tabs. A phrase with
    a >= ``least`` occurrences is a candidate; cut after its first k words into parts with l and r occurrences it scores
    floor(``scale`` * a / (l + r)), and its worst cut counts, the smallest k among equals. A candidate goes if a longer one that holds it has
    ``cover`` percent of its occurrences. Each language returns its first ``top`` by score, a, and phrase in byte order; n counts
    all its words.

    A null text is empty, a null language is ``und``. A repeated row counts as often as it is there. Texts have any length. An empty table, and
    one without frequent phrases, gives no rows. Only the text and the language are read: other columns have no effect, whatever their names.
    """
    found = materialize(frequent_phrases(docs, least, text_col=text_col, lang_col=lang_col), "phrases")
    phrases = found.where(F.size("words") > 0).select("lang", "words", _joined(F.col("words")).alias("phrase"), "f")
    candidates = phrases.where(F.size("words") > 1)

    # Parts of a frequent phrase are frequent, so all of them are among the phrases.
    cuts = candidates.select("lang", "words", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumns(
        {"first": _joined(F.slice("words", F.lit(1), F.col("k"))), "rest": _joined(F.slice("words", F.col("k") + 1, F.size("words")))}
    )
    left = phrases.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    whole = "decimal(20,0)"
    score = F.expr(f"(CAST(a AS {whole}) * {int(scale)}) div (CAST(l AS {whole}) + CAST(r AS {whole}))")
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", score)
    worst = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut"))

    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.size("words") - 1),
            lambda m: F.transform(F.sequence(F.lit(1), F.size("words") - m + 1), lambda i: _joined(F.slice("words", i, m))),
        )
    )
    holders = candidates.where(F.size("words") > 2).select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "f")
    holders = holders.groupBy("lang", "phrase").agg(F.max("f").alias("held"))
    kept = worst.join(holders, ["lang", "phrase"], "left")
    kept = kept.where(F.col("held").isNull() | (F.col("held").cast(whole) * 100 < F.col("cut.a").cast(whole) * int(cover)))

    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("cut.a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    sizes = found.where(F.size("words") == 0).select("lang", F.col("f").alias("n"))
    return ranked.join(sizes, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "cut.a", "cut.l", "cut.r", "n", "cut.score"
    )
