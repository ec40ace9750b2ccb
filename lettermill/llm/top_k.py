"""Exact top-k by inner product over vectors sorted by length.

Vectors are turned by the eigenvectors of their second moments (the right singular vectors of the matrix they form), so that the first
coordinates hold most of their length. Candidates are dealt by length into spans, the longest first, and queries into blocks by the length
that a candidate needs to reach their k-th score among the longest vectors of all. A span meets a block only if it is long enough; all these
pairs are groups of one shuffle. Within a pair a vector is left out if the product of the lengths cannot reach the query's k-th score so
far; of the others the first coordinates are multiplied, and only those whose partial product plus the Cauchy-Schwarz bound of the rest
reaches that score get their exact product. Scores are integers and exact; the turned coordinates serve to prune, with a margin for
rounding. The driver sees the second moments and the longest vectors, no queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lettermill.session import materialize

QUERY_BLOCK, SPAN, HEAD, STEP = 2_048, 16_384, 512, 1_024
MOST_TASKS = 20_000
#: Share of the squared lengths that the first turned coordinates hold.
NEAR = 0.6
SCORES = "query_id bigint, vec_id bigint, score bigint"


def usable_vectors(vectors: DataFrame, scale: int, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v, norm2): components are ``floor(scale * x)`` with x as double. Rows that are null or hold null or non-finite components go."""
    x = F.col(vector_col).cast("array<double>")
    own = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull())
    good = F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    v = F.transform("x", lambda c: F.floor(c * scale).cast("bigint"))
    norm2 = F.aggregate(F.transform("v", lambda c: c.cast("double") * c.cast("double")), F.lit(0.0), lambda a, c: a + c)
    return own.where(good).select("vec_id", v.alias("v")).withColumn("norm2", norm2)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as one matrix; shorter vectors end in zeros."""
    begin = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), dtype=np.int64)
    sizes = np.diff(begin)
    rows = np.repeat(np.arange(len(column)), sizes)
    out[rows, np.arange(begin[0], begin[-1]) - np.repeat(begin[:-1], sizes)] = flat[begin[0] : begin[-1]]
    return out


def _moments(vectors: DataFrame, width: int) -> np.ndarray:
    """The matrix of second moments, width by width: one partial sum for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            m = _matrix(batch.column(0), width).astype(np.float64)
            total += m.T @ m
        cells = np.arange(width * width)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(total.ravel(), pa.float64())], names=["cell", "x"])

    sums = vectors.select("v").mapInArrow(run, "cell bigint, x double").groupBy("cell").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros(width * width)
    out[sums["cell"].to_numpy()] = sums["x"].to_numpy()
    return out.reshape(width, width)


class Ranking:
    """The best k of each query so far. Scores are exact; equal ones go by smaller id."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, turn: np.ndarray, head: int, k: int):
        self.q, self.ids, self.turn, self.head, self.k = queries, ids, turn, head, k
        turned = queries @ turn
        self.near, self.far = turned[:, :head], np.linalg.norm(turned[:, head:], axis=1)
        self.length = np.linalg.norm(queries.astype(np.float64), axis=1)
        self.floor = np.full(len(queries), -np.inf)
        none = np.zeros(0, dtype=np.int64)
        self.best = [(none, none)] * len(queries)

    def start(self, v: np.ndarray, ids: np.ndarray) -> None:
        """First thresholds: the k-th best score among these candidates. They are not ranked."""
        scores = _exact(self.q, v).astype(np.float64)
        scores[self.ids[:, None] == ids[None, :]] = -np.inf
        if len(ids) >= self.k:
            self.floor = np.partition(scores, len(ids) - self.k, axis=1)[:, len(ids) - self.k]

    def add(self, v: np.ndarray, ids: np.ndarray) -> None:
        """Rank more vectors, the longest first."""
        longest = float(np.linalg.norm(v[0].astype(np.float64)))
        slack = 1e-9 * self.length * longest + 1e-6
        live = np.flatnonzero(self.length * longest + slack >= self.floor)
        if not len(live):
            return
        turned = v @ self.turn
        bound = self.near[live] @ turned[:, : self.head].T
        bound += np.outer(self.far[live], np.linalg.norm(turned[:, self.head :], axis=1)) + slack[live, None]
        rows, cols = np.nonzero(bound >= self.floor[live, None])
        if len(rows) * 20 < bound.size:
            scores = np.einsum("ij,ij->i", self.q[live[rows]], v[cols])
        else:
            scores = _exact(self.q[live], v)[rows, cols]
        rows = live[rows]
        good = (scores >= self.floor[rows]) & (ids[cols] != self.ids[rows])
        rows, scores, names = rows[good], scores[good], ids[cols[good]]
        touched, first = np.unique(rows, return_index=True)
        for i, a, b in zip(touched.tolist(), first.tolist(), np.append(first, len(rows))[1:].tolist(), strict=True):
            s, n = np.concatenate([self.best[i][0], scores[a:b]]), np.concatenate([self.best[i][1], names[a:b]])
            order = np.lexsort((n, -s))[: self.k]
            self.best[i] = s[order], n[order]
            if len(order) == self.k:
                self.floor[i] = max(self.floor[i], s[order[-1]])


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer products; by floating point where that is exact."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64) if top < 2**53 else q @ v.T


def _dealt(ordered: DataFrame, name: str, group: str, size: int) -> DataFrame:
    """``ordered``, written in its order, with ``group``: its rows in runs of ``size``, however many partitions it has."""
    own = materialize(ordered.withColumn("row", F.monotonically_increasing_id()), name)
    part, within = F.shiftright("row", 33), F.col("row").bitwiseAND((1 << 33) - 1)
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    tasks = own.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", before.alias("before"))  # a row for each task that wrote
    place = F.col("before") + within
    return own.join(F.broadcast(tasks), part == F.col("part")).withColumn(group, F.floor(place / size)).drop("row", "part", "before")


def _first_floors(sent: object, k: int, width: int):  # noqa: ANN202
    """(vec_id, v, needs): the length below which no vector can be among a query's k best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest, turn, head = sent.value
        for batch in batches:
            needs = np.zeros(0)
            if len(batch):
                ranking = Ranking(_matrix(batch.column("v"), width), batch.column("vec_id").to_numpy(), turn, head, k)
                ranking.start(*longest)
                some = (ranking.floor > 0) & (ranking.length > 0)
                needs = np.where(some, (ranking.floor - 1e-6) / np.where(some, ranking.length, 1), -np.inf)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(needs, pa.float64())], names=["vec_id", "v", "needs"])

    return run


def _rank(sent: object, k: int, width: int):  # noqa: ANN202
    """The k best of each pair of a query block and a span: rows come pair by pair, first the queries, then the longest vectors."""

    def best(ranking: Ranking) -> pa.RecordBatch:
        sizes = [len(s) for s, _ in ranking.best]
        scores, names = (np.concatenate([x[i] for x in ranking.best]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(ranking.ids, sizes)), pa.array(names), pa.array(scores)], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest, turn, head = sent.value
        now, queries, ids, ranking = None, [], [], None
        for batch in batches:
            block, span, query = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "span", "is_query"))
            new = np.flatnonzero((np.diff(block) != 0) | (np.diff(span) != 0) | (np.diff(query.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *new.tolist()], [*new.tolist(), len(batch)], strict=True):
                if a == b:
                    continue
                if (block[a], span[a]) != now:
                    if ranking is not None:
                        yield best(ranking)
                    now, queries, ids, ranking = (block[a], span[a]), [], [], None
                part = batch.slice(a, b - a)
                if query[a]:
                    queries.append(_matrix(part.column("v"), width))
                    ids.append(part.column("vec_id").to_numpy())
                    continue
                if ranking is None:
                    ranking = Ranking(np.concatenate(queries), np.concatenate(ids), turn, head, k)
                    ranking.start(*longest)
                for at in range(0, len(part), STEP):
                    some = part.slice(at, STEP)
                    ranking.add(_matrix(some.column("v"), width), some.column("vec_id").to_numpy())
        if ranking is not None:
            yield best(ranking)

    return run


def top_k(
    vectors: DataFrame, is_query: object, *, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding",
    query_block: int = QUERY_BLOCK, span_rows: int = SPAN,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` (a condition on the id column), the k best other rows.

    Exact: integer inner products of ``floor(scale * x)``, ties by smaller id; fewer than k candidates give all. A row is no candidate
    of a query with its own id. Null vectors and vectors with null or non-finite components take no part, as queries and candidates.
    Vectors of different lengths are compared as if the shorter ended in zeros; an empty vector scores 0. Repeated rows are ranked one
    by one. Scores have to fit a long. Empty tables give no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    usable = usable_vectors(vectors, scale, id_col=id_col, vector_col=vector_col).repartitionByRange(F.desc("norm2"), F.col("vec_id"))
    usable = _dealt(usable.sortWithinPartitions(F.desc("norm2"), "vec_id"), "top-k-vectors", "span", span_rows)
    width = usable.agg(F.max(F.size("v"))).first()[0] or 0
    values, axes = np.linalg.eigh(_moments(usable, width)) if width else (np.zeros(0), np.zeros((0, 0)))
    turn = axes[:, ::-1]
    weight = np.cumsum(values[::-1].clip(0)) / max(values.sum(), 1e-300)
    head = min(width, int(np.searchsorted(weight, NEAR)) + 1) if width else 0

    # The longest vectors, a fixed number, set each query's first threshold.
    first = usable.orderBy(F.desc("norm2"), "vec_id").limit(HEAD).select("vec_id", "v").toArrow().combine_chunks()
    longest = np.zeros((0, width), dtype=np.int64), np.zeros(0, dtype=np.int64)
    if len(first):
        longest = _matrix(first["v"].combine_chunks(), width), first["vec_id"].to_numpy()
    sent = spark.sparkContext.broadcast((longest, turn, head))

    queries = usable.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).mapInArrow(
        _first_floors(sent, k, width), "vec_id bigint, v array<bigint>, needs double"
    )
    queries = queries.repartitionByRange("needs", "vec_id").sortWithinPartitions("needs", "vec_id")
    queries = _dealt(queries, "top-k-queries", "block", query_block)

    # One row a span and one a block: which of them meet.
    spans = usable.groupBy("span").agg(F.sqrt(F.max("norm2")).alias("longest"))
    blocks = queries.groupBy("block").agg(F.min("needs").alias("needs"))
    pairs = materialize(spans.join(blocks, F.col("longest") * (1 + 1e-9) >= F.col("needs")).select("block", "span"), "top-k-pairs")
    tasks = max(1, min(2 * pairs.count(), MOST_TASKS))
    asked = queries.join(pairs, "block").select("block", "span", F.lit(True).alias("is_query"), "vec_id", "v", F.lit(0.0).alias("norm2"))
    against = usable.join(pairs, "span").select("block", "span", F.lit(False).alias("is_query"), "vec_id", "v", "norm2")
    met = asked.unionByName(against).repartition(tasks, "block", "span")
    met = met.sortWithinPartitions("block", "span", F.desc("is_query"), F.desc("norm2"), "vec_id")
    found = materialize(met.select("block", "span", "is_query", "vec_id", "v").mapInArrow(_rank(sent, k, width), SCORES), "top-k-scores")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
