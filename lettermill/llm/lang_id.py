"""Language identification by nearest centroid.

Texts become normalised TF-IDF vectors of hashed n-grams (of one to three bytes of lower-case letters). A bounded sample of each language's
labelled texts is clustered into several centroids by spherical k-means, one language per task. A text gets the language of the
centroid with the largest cosine, and is rejected if that is below what labelled texts, cut to its length, show: a short text is
far from every centroid, whatever its language. For these limits the sample is halved, and each half is compared with centroids of the
other one, since texts are closest to centroids that were fitted on them. Prediction is one pass over the texts, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lettermill.llm.bytes_of import lower_letters, short_batches, text_blocks
from lettermill.session import materialize

DIM = 4096
#: Labelled texts of a language that the classifier is fitted on, about, and clusters of a language.
SAMPLE, CLUSTERS, ROUNDS = 1_000, 4, 8
#: A text is rejected below this part of the cosine that all but one in two hundred labelled texts of its length reach.
REJECT, QUANTILE = 0.9, 0.005
#: Characters that labelled texts are cut to; lengths that fewer texts have set no limit, and n texts set one lower by n / (n + SPARE).
LENGTHS, LEAST_TEXTS, SPARE = [8 << i for i in range(10)], 20, 10
UNKNOWN = "und"
_BLOCK, _DOCS = 1 << 20, 256


def _counts(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Counts of hashed n-grams, a row for each text."""
    n_docs = len(begin) - 1
    if not len(data):
        return np.zeros((n_docs, DIM), dtype=np.float32)
    m = lower_letters(data).astype(np.uint32)
    doc = np.repeat(np.arange(n_docs, dtype=np.int64), np.diff(begin)) * DIM
    last = np.repeat(begin[1:], np.diff(begin)) - np.arange(len(data))  # bytes from here to the end of the text
    out = np.zeros(n_docs * DIM, dtype=np.int64)
    code = m.copy()
    for n in (1, 2, 3):
        if n > 1:
            code = code[:-1] * np.uint32(257) + m[n - 1 :]
        size = len(code)
        use = (last[:size] >= n) & (m[:size] != 32 if n == 1 else True)
        if n == 3:
            use &= m[1 : size + 1] != 32
        hashed = ((code + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(20)
        out += np.bincount(doc[:size][use] + hashed[use], minlength=len(out))
    return out.reshape(n_docs, DIM).astype(np.float32)


def vectors_of(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, counts) for runs of rows; a very long text is counted in parts."""
    for row, data, begin in text_blocks(texts, _BLOCK):
        if len(begin) == 2 and len(data) > _BLOCK:
            parts = [data[a : a + _BLOCK] for a in range(0, len(data), _BLOCK)]
            yield row, sum(_counts(p, np.array([0, len(p)])) for p in parts)
            continue
        for a in range(0, len(begin) - 1, _DOCS):
            own = begin[a : a + _DOCS + 1]
            yield row + a, _counts(data[own[0] : own[-1]], own - own[0])


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of dampened counts times idf; zero stays zero."""
    v = np.log1p(counts) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def cluster(v: np.ndarray, clusters: int) -> np.ndarray:
    """Spherical k-means from spread-out seeds: centroids."""
    seeds = [0]
    for _ in range(min(clusters, len(v)) - 1):
        seeds.append(int((v @ v[seeds].T).max(axis=1).argmin()))
    centre = v[seeds]
    for _ in range(ROUNDS):
        nearest = (v @ centre.T).argmax(axis=1)
        sums = np.stack([v[nearest == i].sum(axis=0) if (nearest == i).any() else centre[i] for i in range(len(centre))])
        centre = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centre


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    grams: np.ndarray  # log2 of n-grams, rising
    limits: np.ndarray  # the least cosine of a text of so many

    def limit(self, counts: np.ndarray) -> np.ndarray:
        return np.interp(np.log2(np.maximum(counts.sum(axis=1, dtype=np.float64), 1.0)), self.grams, self.limits)


def _sample(labelled: DataFrame, sample: int) -> DataFrame:
    """About ``sample`` rows of each language: those whose hashed id and text fall below the language's share."""
    sizes = dict(labelled.groupBy("lang").count().collect())
    if not sizes:
        return labelled
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample / n))])
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return labelled.where(place < share[F.col("lang")])


def train(labelled: DataFrame, *, sample: int = SAMPLE, clusters: int = CLUSTERS) -> Model | None:
    """Fit on ``labelled(doc_id, text, lang)``; rows without label, or without a letter, teach nothing. None if nothing is left."""
    short_batches(labelled.sparkSession)
    own = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, counts in vectors_of(batch.column("text")):
                cells = pa.array([c.tobytes() for c in counts.astype("<f4")], pa.binary())
                columns = [batch.column(c).slice(row, len(counts)) for c in ("lang", "start")]
                yield pa.RecordBatch.from_arrays([*columns, cells], names=["lang", "start", "counts"])

    counted = _sample(own, sample).select("lang", F.substring("text", 1, LENGTHS[-1]).alias("start"), "text")
    vectors = materialize(counted.mapInArrow(count, "lang string, start string, counts binary"), "language-sample")
    vectors = vectors.withColumn("half", F.pmod(F.xxhash64("counts"), F.lit(2)).cast("int"))

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros((2, DIM + 1), dtype=np.int64)
        for batch in batches:
            for half, cell in zip(batch.column("half").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                df[half] += np.append(np.frombuffer(cell, dtype="<f4") > 0, True)
        place = pa.array(np.arange(2 * (DIM + 1)))
        yield pa.RecordBatch.from_arrays([place, pa.array(df.ravel())], names=["place", "df"])

    summed = vectors.select("half", "counts").mapInArrow(frequency, "place bigint, df bigint").groupBy("place").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(2 * (DIM + 1))
    df[summed["place"].to_numpy()] = summed["df"].to_numpy()
    df = df.reshape(2, DIM + 1)
    if not df[:, DIM].any():
        return None
    # Of each half, and of all: whole is fitted like a third group.
    idf = [np.log((1 + d[DIM]) / (1 + d[:DIM])) + 0.05 for d in (df[0], df[1], df.sum(axis=0))]

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("counts")
        counts = np.stack([np.frombuffer(c, dtype="<f4") for c in group["counts"]])
        lang, part = group["lang"].iloc[0], int(group["part"].iloc[0])
        centre = cluster(weigh(counts, idf[part]), clusters)
        return pd.DataFrame({"lang": lang, "part": part, "centroid": [c.astype("<f4").tobytes() for c in centre]})

    parts = vectors.select("lang", "counts", F.explode(F.array("half", F.lit(2))).alias("part"))
    found = parts.groupBy("lang", "part").applyInPandas(fit, "lang string, part int, centroid binary").collect()
    found.sort(key=lambda r: (r["lang"], r["centroid"]))
    weights = [x.astype(np.float32) for x in idf]
    centroids = [[np.frombuffer(r["centroid"], dtype="<f4") for r in found if r["part"] == part] for part in range(3)]
    model = Model([r["lang"] for r in found if r["part"] == 2], np.stack(centroids[2]), weights[2], np.zeros(1), np.zeros(1))
    if not centroids[0] or not centroids[1]:
        return model  # too few texts to tell what is far
    others = [(weights[1 - half], np.stack(centroids[1 - half])) for half in range(2)]
    return _limited(model, others, vectors.select("half", "start"))


def _limited(model: Model, others: list[tuple[np.ndarray, np.ndarray]], starts: DataFrame) -> Model:
    """``model`` with the limits that labelled texts show, cut to each of ``LENGTHS`` and compared with ``others`` of their half: weights and
    centroids that they had no part in. Below a single n-gram nothing is too far."""
    sent = starts.sparkSession.sparkContext.broadcast(others)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, halves = batch.column("start").to_pylist(), batch.column("half").to_pylist()
            for half, (idf, centroids) in enumerate(sent.value):
                own = [t for t, h in zip(texts, halves, strict=True) if h == half]
                for length in LENGTHS:
                    cut = pa.array([t[:length] for t in own if len(t) >= length], pa.string())
                    for _, counts in vectors_of(cut):
                        cosine = (weigh(counts, idf) @ centroids.T).max(axis=1).astype(float)
                        columns = [pa.array([length] * len(counts), pa.int32()), pa.array(counts.sum(axis=1, dtype=np.float64)), pa.array(cosine)]
                        yield pa.RecordBatch.from_arrays(columns, names=["length", "grams", "cosine"])

    lettered = starts.mapInArrow(measure, "length int, grams double, cosine double").where("grams > 0")
    low = lettered.groupBy("length").agg(F.median("grams").alias("grams"), F.percentile("cosine", QUANTILE).alias("low"), F.count("*").alias("n"))
    rows = sorted((r["grams"], r["low"] * r["n"] / (r["n"] + SPARE)) for r in low.where(F.col("n") >= LEAST_TEXTS).collect())
    grams, limits = np.array([(0.0, 0.0), *((np.log2(max(g, 2.0)), REJECT * c) for g, c in rows)]).T
    return replace(model, grams=grams, limits=limits)


def judge(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, cosine, rejected) of each text, letters or none."""
    names, cosines, rejected = np.empty(len(texts), dtype=object), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
    for row, counts in vectors_of(texts):
        cosine = weigh(counts, model.idf) @ model.centroids.T
        best = cosine.argmax(axis=1)
        top = np.clip(cosine[np.arange(len(best)), best], 0.0, 1.0)
        end = row + len(best)
        names[row:end] = [model.languages[i] for i in best]
        cosines[row:end], rejected[row:end] = top, top < model.limit(counts)
    return names.tolist(), cosines, rejected


def predict(docs: DataFrame, model: Model | None, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected``.

    Null texts and texts without a letter are ``und``, score 0 and rejected, as is everything if there is no model. Ties go to the first
    language. Repeated rows are judged alike; very long texts whole. An empty table gives no rows. The other columns stay; those of
    the three new names are replaced.
    """
    short_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    docs = docs.select(*kept)
    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "rejected": F.lit(True)})
    # Plain arrays: the class itself travels with the function, so that workers need no installed copy.
    sent = docs.sparkSession.sparkContext.broadcast(tuple(getattr(model, f.name) for f in fields(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for batch in batches:
            names, scores, rejected = judge(batch.column(text_col), own)
            new = [pa.array(names, pa.string()), pa.array(scores), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*kept, "lang_pred", "score", "rejected"])

    new_fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    schema = T.StructType([*docs.schema.fields, *new_fields])
    found = docs.mapInArrow(run, schema)
    return found.withColumns({
        "lang_pred": F.when(lettered, F.col("lang_pred")).otherwise(UNKNOWN),
        "score": F.when(lettered, F.col("score")).otherwise(0.0),
        "rejected": F.col("rejected") | ~lettered,
    })


def held_out(doc_id: Column) -> Column:
    """Documents that are not learned from: crc32 of the id as text leaves 1 when divided by 3. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_on_rest(docs: DataFrame, **options: int) -> Model | None:
    """A model of the documents that are not held out and have an id."""
    rest = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return train(rest, **options)
