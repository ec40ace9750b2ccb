"""Packing of documents into token windows by lexical retrieval.

Documents are encoded once into a table of ids; the same pass counts in how many documents each token occurs, over the whole corpus.
Documents then move next to those that share their weightiest tokens, wherever in the corpus they were, and each task builds BM25 indexes
over bounded shards of its range, of all tokens. A window is opened by a seed document, whose tokens all query the index; the best unused
neighbours fill it, and the last of them is cut, its rest being the next seed. Windows are thus full but for the end of a task's share,
which is cut into powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lettermill.llm.bytes_of import short_batches
from lettermill.llm.codec import codec, runs
from lettermill.session import fresh_dir

SHARD_TOKENS, SHARD_DOCS = 1_000_000, 2_048
#: Tokens in at least this part of a shard's documents have a whole row of weights, the others a list of documents.
DENSE = 0.125
K1, B = 1.2, 0.75
_MARKED = 64


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write and reread (doc_id, ids, n_tokens, term, df): rows of documents, and rows of document counts by token.

    ``ids`` are little-endian, two bytes each where all fit, else four; ``end_id`` closes each document. A count row has ``term`` and
    ``df`` only; term -1 counts documents, term -2 tokens.
    """
    short_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType(
        [own.schema["doc_id"], T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()),
         T.StructField("term", T.IntegerType()), T.StructField("df", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, counts = codec(tokenizer), np.zeros(0, dtype=np.int64)
        n_docs = n_tokens = 0
        id_type = None
        for batch in batches:
            names, id_type = batch.column("doc_id"), batch.column("doc_id").type
            for row, ids, begin in use.encode(batch.column("text")):
                n = len(begin) - 1
                width = "<u2" if not len(ids) or ids.max() < 65536 and end_id < 65536 else "<u4"
                end = np.array([end_id], dtype=width).tobytes()
                data, step = ids.astype(width).tobytes(), np.dtype(width).itemsize
                cells = [data[a * step : b * step] + end for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
                counts = _add_documents(counts, ids, begin)
                n_docs, n_tokens = n_docs + n, n_tokens + len(ids) + n
                yield pa.RecordBatch.from_arrays(
                    [names.slice(row, n), pa.array(cells, pa.binary()), pa.array(np.diff(begin) + 1, pa.int64()),
                     pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], names=schema.names,
                )
        if id_type is not None:
            terms = np.flatnonzero(counts)
            terms, df = np.append(terms, [-1, -2]), np.append(counts[terms], [n_docs, n_tokens])
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(terms), id_type), pa.nulls(len(terms), pa.binary()), pa.nulls(len(terms), pa.int64()),
                 pa.array(terms, pa.int32()), pa.array(df, pa.int64())], names=schema.names,
            )

    path = fresh_dir(docs.sparkSession, "packing-ids")
    own.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def _add_documents(counts: np.ndarray, ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """``counts`` plus one for each token of each document. A few documents at a time mark the tokens they have."""
    top = int(ids.max()) + 1 if len(ids) else 0
    if top > len(counts):
        counts = np.concatenate([counts, np.zeros(top - len(counts), dtype=np.int64)])
    marks = np.zeros((_MARKED, len(counts)), dtype=bool)
    for a in range(0, len(begin) - 1, _MARKED):
        b = min(a + _MARKED, len(begin) - 1)
        rows = np.repeat(np.arange(b - a), np.diff(begin[a : b + 1]))
        tokens = ids[begin[a] : begin[b]]
        marks[rows, tokens] = True
        counts += marks[: b - a].sum(axis=0, dtype=np.uint8)  # _MARKED at most
        marks[rows, tokens] = False
    return counts


def bm25(idf: np.ndarray, tf: np.ndarray, size: np.ndarray | int, mean: float) -> np.ndarray:
    """What tokens add to a document's score."""
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))


def _ids(cell: bytes, n: int) -> np.ndarray:
    return np.frombuffer(cell, dtype="<u2" if len(cell) == 2 * n else "<u4")


def _weightiest(ids: np.ndarray, idf: np.ndarray, size: int, mean: float) -> list[int]:
    """The two tokens that add most to a document's score, the smaller id of equal ones; -1 for none. Tokens of an ``idf`` of -inf do not count."""
    ids = np.sort(ids)
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, dtype=np.int64)
    weight = bm25(idf[ids[first]], np.diff(first, append=len(ids)), size, mean)
    top = []
    while len(top) < 2:
        at = int(weight.argmax()) if len(weight) else 0
        if not len(weight) or weight[at] == -np.inf:
            top.append(-1)
            continue
        top.append(int(ids[first[at]]))
        weight[at] = -np.inf
    return top


def near_each_other(rows: DataFrame, idf: object, mean: float) -> DataFrame:
    """``rows(doc_id, ids, n_tokens)`` in ranges of their two weightiest tokens among those of several documents.

    Equal texts are neighbours; a range may end anywhere in a token's documents, so no token or text is too frequent for a task. ``idf`` is
    a broadcast (idf, whether several documents have the token).
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("t1", T.IntegerType()), T.StructField("t2", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, several = idf.value
        shared = np.where(several, of, -np.inf)
        for batch in batches:
            best = np.full((len(batch), 2), -1, dtype=np.int32)
            for i, (cell, n) in enumerate(zip(batch.column("ids").to_pylist(), batch.column("n_tokens").to_pylist(), strict=True)):
                best[i] = _weightiest(_ids(cell, n)[:-1], shared, n, mean)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best[:, 0]), pa.array(best[:, 1])], names=schema.names)

    order = ["t1", "t2", F.xxhash64("ids"), F.xxhash64("doc_id")]
    keyed = rows.mapInArrow(run, schema)
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).select(*rows.columns)


class Shard:
    """A BM25 index over some documents; gives the best unused neighbours of one of them."""

    def __init__(self, tokens: list[np.ndarray], idf: np.ndarray, mean: float):
        sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        flat = np.concatenate(tokens).astype(np.int64)
        docs = np.repeat(np.arange(len(tokens)), sizes)
        pairs, tf = np.unique(docs * len(idf) + flat, return_counts=True)
        owner, term = pairs // len(idf), pairs % len(idf)
        terms, code = np.unique(term, return_inverse=True)
        weight = bm25(idf[term], tf, sizes[owner], mean)
        order = np.argsort(code, kind="stable")
        self.posted, self.weight = owner[order], weight[order]
        self.begin = np.searchsorted(code[order], np.arange(len(terms) + 1))
        self.code = code
        self.first = np.searchsorted(owner, np.arange(len(tokens) + 1))
        often = np.flatnonzero(np.diff(self.begin) >= max(DENSE * len(tokens), 1))
        self.row = np.full(len(terms), -1)
        self.row[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), len(tokens)), dtype=np.float32)
        of_row = self.row[code]
        self.rows[of_row[of_row >= 0], owner[of_row >= 0]] = weight[of_row >= 0]
        self.gone = np.zeros(len(tokens))
        self.left, self.at = len(tokens), 0

    def use(self, doc: int) -> int:
        self.gone[doc] = -np.inf
        self.left -= 1
        return doc

    def next(self) -> int:
        """The first unused document."""
        while self.gone[self.at]:
            self.at += 1
        return self.at

    def neighbours(self, doc: int) -> Iterator[int]:
        """Unused documents by falling score for the tokens of ``doc``, then the others in order."""
        own = self.code[self.first[doc] : self.first[doc + 1]]
        rows = self.row[own]
        scores = self.gone + self.rows[rows[rows >= 0]].sum(axis=0)
        few = own[rows < 0]
        at = runs(self.begin[few], self.begin[few + 1] - self.begin[few])
        np.add.at(scores, self.posted[at], self.weight[at])
        while self.left:
            best = int(scores.argmax())
            if scores[best] <= 0:
                best = self.next()
            scores[best] = -np.inf
            yield self.use(best)


class Packer:
    """Fills windows with pieces (document, start, length); numbers the sequences from ``first``."""

    def __init__(self, window: int, first: int):
        self.window, self.sequence, self.offset = window, first, 0
        self.pieces: list[tuple] = []

    def put(self, doc: tuple, start: int, length: int) -> None:
        name, ids, n = doc
        crc = zlib.crc32(ids[start : start + length].astype("<u4").tobytes())
        self.pieces.append((name, start, length, crc, n, self.sequence, self.offset))
        self.offset += length
        if self.offset == self.window:
            self.sequence, self.offset = self.sequence + 1, 0

    def shard(self, docs: list[tuple], idf: np.ndarray, mean: float) -> list[tuple]:
        """Give whole windows to ``put``; returns the pieces of the last one, which is not full."""
        index, around = Shard([d[1][:-1] for d in docs], idf, mean), iter(())
        rest: list[tuple] = []  # the open window
        room = self.window
        seed, start = None, 0
        while True:
            if seed is None:
                if not index.left:
                    break
                around = index.neighbours(seed := index.use(index.next()))
                start = 0
            at, seed, doc = seed, None, docs[seed]
            opened = not rest
            while doc[2] - start > 0:
                take = min(room, doc[2] - start)
                rest.append((doc, start, take))
                start, room = start + take, room - take
                if not room:
                    for piece in rest:
                        self.put(*piece)
                    rest, room, opened = [], self.window, True
            if rest:
                if opened:  # this document's end opens a window: it is the seed
                    around = index.neighbours(at)
                seed, start = next(around, None), 0
        return rest


def _spans(total: int) -> Iterator[int]:
    """Powers of two that add up to ``total``, the largest first."""
    for bit in reversed(range(total.bit_length())):
        if total >> bit & 1:
            yield 1 << bit


def pack_documents(
    docs: DataFrame, tokenizer: str, *, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
    shard_tokens: int = SHARD_TOKENS, shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of sequences of at most ``window`` tokens.

    Every id of every row lies in one piece. All sequences have ``window`` tokens, but for the last ones of each task, which have a
    power of two. ``window`` is a power of two.

    Null and empty texts are documents of one id, the closing one. Repeated rows and ids are packed one by one. A very long document
    fills windows of its own and its end seeds the next. Ties of the score go to the first document of the shard. An empty table gives
    no rows; other columns are ignored.
    """
    encoded = encode_documents(docs, tokenizer, end_id, id_col=id_col, text_col=text_col)
    # Bounded by the vocabulary.
    counts = encoded.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    df = dict(zip(counts["term"].tolist(), counts["df"].tolist(), strict=True))
    n_docs, n_tokens = df.pop(-1, 0), df.pop(-2, 0)
    idf = np.zeros(max(df, default=0) + 1)
    several = np.zeros(len(idf), dtype=bool)
    for term, n in df.items():
        idf[term] = np.log(1 + (n_docs - n + 0.5) / (n + 0.5))
        several[term] = n > 1
    mean = n_tokens / max(n_docs, 1)
    shared = docs.sparkSession.sparkContext.broadcast((idf, several))
    schema = T.StructType(
        [T.StructField("doc_id", encoded.schema["doc_id"].dataType)]
        + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, TaskContext.get().partitionId() << 33)
        held: list[tuple] = []
        size = 0
        id_type = None

        def flush() -> Iterator[pa.RecordBatch]:
            if packer.pieces:
                columns = list(zip(*packer.pieces, strict=True))
                arrays = [pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])]
                packer.pieces = []
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

        rest: list[tuple] = []
        for batch in batches:
            id_type = batch.column("doc_id").type
            names = batch.column("doc_id").to_pylist()
            for name, cell, n in zip(names, batch.column("ids").to_pylist(), batch.column("n_tokens").to_pylist(), strict=True):
                if size + n > shard_tokens and held or len(held) >= shard_docs:
                    rest += packer.shard(held, shared.value[0], mean)
                    held, size = [], 0
                    yield from flush()
                held.append((name, _ids(cell, n), n))
                size += n
        if held:
            rest += packer.shard(held, shared.value[0], mean)
        _close(packer, rest, window)
        yield from flush()

    def _close(packer: Packer, rest: list[tuple], window: int) -> None:
        """Windows from the open ends of the shards; what is left then, in powers of two."""
        sizes = [window] * (sum(p[2] for p in rest) // window) + list(_spans(sum(p[2] for p in rest) % window))
        todo = list(reversed(rest))
        for length in sizes:
            room = length
            while room:
                doc, start, n = todo.pop()
                take = min(room, n)
                packer.put(doc, start, take)
                room -= take
                if take < n:
                    todo.append((doc, start + take, n - take))
            if packer.offset:
                packer.sequence, packer.offset = packer.sequence + 1, 0

    rows = encoded.where(F.col("term").isNull()).select("doc_id", "ids", "n_tokens")
    return near_each_other(rows, shared, mean).mapInArrow(run, schema)
