"""Quality rules: counts of a text's words, signs and repeats, and a classifier of hashed n-grams.

The classifier is a logistic regression over the shares of hashed character n-grams (one to three characters) and word n-grams (one and two words)
of a text, fitted by Spark on a bounded sample of labelled rows. Its margins become probabilities by a second regression over labelled rows
that the first has not seen. Texts are scored in Arrow batches, without a shuffle, against fixed thresholds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lettermill.llm.bytes_of import short_batches
from lettermill.session import fresh_dir

#: Labelled rows that the classifier learns from, at most, and one in how many of them calibrates instead.
SAMPLE, CALIBRATES = 10_000, 4
#: Hashed features, as a power of two. Shares are percent.
BITS, PERCENT = 16, 100.0
#: Of the regression; the calibration has two parameters and needs none.
ROUNDS, PENALTY = 40, 1e-3
#: Probability of good quality from which a text is kept.
KEEP_FROM = 0.5
#: Base rules: least words, and the largest share of repeated ones in percent.
LEAST_WORDS, MOST_REPEATED = 50, 50
CHARS, WORDS = (1, 2, 3), (1, 2)
BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
# Odd multipliers of the hashes, and the signs that count as symbols.
_ODD, _MORE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SYMBOLS = b"#*$%&|<>"
_SPACES = np.zeros(1 << 8, dtype=bool)
_SPACES[[32, *range(9, 14)]] = True
#: Characters whose n-grams are hashed at once.
_BLOCK = 1 << 20
_SHIFT = np.uint64(64 - BITS)


class Model(NamedTuple):
    """Plain arrays, so that a worker can read them: a weight for each feature, the intercept, and slope and shift of the calibration."""

    weights: np.ndarray
    intercept: float
    slope: float
    shift: float


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MORE
    return x ^ (x >> np.uint64(32))


def _ngrams(text: str) -> Iterator[np.ndarray]:
    """Feature numbers of a text's character n-grams, one array for each size, or several for a very long text. White space is one blank."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    space = _SPACES[np.minimum(code, 255)]
    last = np.append(space[:-1] & ~space[1:], space[-1:])  # of a run of white space, its last character stays
    code = np.where(space, np.uint32(32), code)[~space | last]
    for at in range(0, len(code), _BLOCK):
        some = code[at : at + _BLOCK + max(CHARS) - 1].astype(np.uint64)
        rolling = np.zeros(len(some), dtype=np.uint64)
        for n in CHARS:
            size = min(_BLOCK, len(some) - n + 1)
            if size <= 0:
                break
            rolling = rolling[:size] * _ODD + some[n - 1 : n - 1 + size] + np.uint64(n)
            yield (_mix(rolling) >> _SHIFT).astype(np.int64)


def _word_ngrams(words: list[bytes]) -> Iterator[np.ndarray]:
    if not words:
        return
    data = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    place = (np.arange(len(data)) - np.repeat(begin, sizes)).astype(np.uint64)
    word = np.add.reduceat(_mix(data * _ODD + place * _MORE), begin)
    rolling = np.zeros(len(words), dtype=np.uint64)
    for n in WORDS:
        size = len(words) - n + 1
        if size <= 0:
            break
        rolling = _mix(rolling[:size] * _ODD + word[n - 1 :] + np.uint64(101 * n))
        yield (rolling >> _SHIFT).astype(np.int64)


def _shares(text: str, words: list[bytes]) -> Iterator[tuple[np.ndarray, float]]:
    """(feature numbers, what each occurrence adds): the n-grams of each kind as percent of the text's characters or words."""
    for features in _ngrams(text):
        yield features, PERCENT / len(text)
    for features in _word_ngrams(words):
        yield features, PERCENT / len(words)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three which the list holds twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    inside = np.zeros(len(words), dtype=bool)
    again = np.flatnonzero(np.fromiter((counts[w] > 1 for w in windows), dtype=bool, count=len(windows)))
    for ahead in range(3):
        inside[again + ahead] = True
    return int(inside.sum())


def _base(data: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """The counts of BASE. Words are what is left between blanks, tabs and line ends, as ``bytes.split`` cuts."""
    code = np.frombuffer(data, dtype=np.uint8)
    word_chars = int(((code & 0xC0) != 0x80).sum() - _SPACES[code].sum())
    symbols = sum(map(data.count, (bytes([s]) for s in _SYMBOLS)))
    lines = [line for line in data.split(b"\n") if line.strip()]
    return len(words), word_chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sparse vector of each labelled text."""
    for batch in batches:
        found = []
        for text in batch.column("text").to_pylist():
            pairs = list(_shares(text, text.encode().split())) or [(np.zeros(0, dtype=np.int64), 0.0)]
            numbers, which = np.unique(np.concatenate([f for f, _ in pairs]), return_inverse=True)
            found.append((numbers, np.bincount(which, np.repeat([x for _, x in pairs], [len(f) for f, _ in pairs]))))
        ends = pa.array(np.concatenate([[0], np.cumsum([len(n) for n, _ in found])]), pa.int32())
        numbers, shares = (np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in (0, 1))
        lists = [pa.ListArray.from_arrays(ends, pa.array(numbers, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(shares, pa.float64()))]
        head = [pa.array(np.zeros(len(batch)), pa.int8()), pa.array(np.full(len(batch), 1 << BITS), pa.int32())]
        vector = pa.StructArray.from_arrays([*head, *lists], names=["type", "size", "indices", "values"])
        yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("calibrates"), vector], names=["label", "calibrates", "features"])


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Model | None:
    """Fit the classifier on ``docs`` (doc_id, text) that ``labels`` (doc_id, quality: 1 is good, 0 is not) name.

    At most ``sample`` label rows are taken, those whose id hashes lowest, so that it is the same ones whatever the order of the rows. Rows
    without a label or an id, and labels without a document, teach nothing. None if the rows that remain are all good, or none is.
    """
    spark = docs.sparkSession
    short_batches(spark)
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("quality IN (0, 1) AND doc_id IS NOT NULL")
    hashed = F.xxhash64(F.col("doc_id").cast("string"))
    named = known.distinct().orderBy(hashed, "doc_id", "quality").limit(sample)
    # The names are at most ``sample`` short rows.
    rows = docs.select("doc_id", "text").join(F.broadcast(named), "doc_id").where(F.col("text").isNotNull())
    calibrates = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(1)), F.lit(CALIBRATES)) == 0
    rows = rows.select(F.col("quality").cast("double").alias("label"), calibrates.alias("calibrates"), "text")
    # A sparse vector is stored as the struct it consists of, and read as a vector.
    struct = "struct<type tinyint, size int, indices array<int>, values array<double>>"
    path = fresh_dir(spark, "quality-features")
    rows.mapInArrow(_features, f"label double, calibrates boolean, features {struct}").write.parquet(path)
    fields = [T.StructField("label", T.DoubleType()), T.StructField("calibrates", T.BooleanType()), T.StructField("features", VectorUDT())]
    stored = spark.read.schema(T.StructType(fields)).parquet(path)

    seen = {(r.label, r.calibrates) for r in stored.select("label", "calibrates").distinct().collect()}
    if len({label for label, _ in seen}) < 2:
        return None
    fits = stored.where(~F.col("calibrates")) if len({label for label, held in seen if not held}) == 2 else stored
    fitted = LogisticRegression(maxIter=ROUNDS, regParam=PENALTY, standardization=False).fit(fits)
    slope, shift = 1.0, 0.0
    if len({label for label, held in seen if held}) == 2:
        margin = vector_to_array("rawPrediction")[1]
        held = fitted.transform(stored.where("calibrates")).select("label", array_to_vector(F.array(margin)).alias("features"))
        sigmoid = LogisticRegression(maxIter=ROUNDS, regParam=PENALTY).fit(held)
        slope, shift = float(sigmoid.coefficients[0]), float(sigmoid.intercept)
    return Model(fitted.coefficients.toArray(), float(fitted.intercept), slope, shift)


def _judge(sent: object):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            base, good = [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                data = text.encode()
                words = data.split()
                base.append(_base(data, words))
                if model is None or not words:
                    good.append(None)
                    continue
                weights, intercept, slope, shift = model
                margin = intercept + sum(float(weights[f].sum()) * share for f, share in _shares(text, words))
                good.append(float(1 / (1 + np.exp(-np.clip(slope * margin + shift, -700, 700)))))
            counts = [pa.array(c, pa.int64()) for c in zip(*base, strict=True)] if base else [pa.array([], pa.int64())] * 5
            arrays = [batch.column("kept"), *counts, pa.array(good, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["kept", *[c.split()[0] for c in BASE.split(", ")], "good"])

    return run


def base_failed() -> Column:
    """The base rules: too few words, or too many of them repeated."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def judge(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts, base_failed, good, kept) of each text: its counts, the calibrated probability of good quality, and the verdict.

    A text that fails the base rules is not kept; of the others those are whose probability is ``KEEP_FROM`` or more. Without a model
    (no labels, or labels of one kind) the base rules decide alone and ``good`` is null, as it is for texts without words. A null text has no
    words, like an empty one. Texts are read whole, whatever their length. Rows with equal ids, or a null one, are judged one by one. An empty
    table gives no rows; columns other than these two are ignored, whatever their names.
    """
    short_batches(docs.sparkSession)
    own = docs.select(F.struct(F.col(id_col).alias("id")).alias("kept"), F.col(text_col).cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(None if model is None else tuple(model))
    id_type = own.schema["kept"].dataType.simpleString()
    found = own.mapInArrow(_judge(sent), f"kept {id_type}, {BASE}, good double")
    kept = ~F.col("base_failed") & (F.col("good").isNull() | (F.col("good") >= KEEP_FROM))
    counts = [c.split()[0] for c in BASE.split(", ")]
    return found.select(F.col("kept.id").alias(id_col), *counts, base_failed().alias("base_failed"), "good").withColumn("kept", kept)
