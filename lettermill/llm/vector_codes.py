"""Vector codes: product quantisation whose codebooks are learned by Lloyd's rounds over two trees.

Vectors become integers and are cut into equal parts. A block of vectors is stored once with a tree over each of its parts: halves by the
widest component, down to small leaves, with a bounding box and the sum of the parts below each node. The entries of a codebook have a tree of
the same kind. A round walks both trees together, level by level: a pair of nodes is dropped if the least distance of its boxes is above the
largest distance that another node of entries can have, a node with one entry left takes it as a whole, with its stored sum, and the
parts of uncertain leaves are compared with the entries they have left, in integers. So every assignment is exact, ties included.

Only sums and counts of entries leave a task; codebooks, which the driver holds, have a fixed number of entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lettermill.session import materialize

#: Vectors of a block, and parts of a leaf, at most.
BLOCK, LEAF = 8_192, 32
_TREES = ["members", "parts", "boxes"]


def usable_rows(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is not null and holds no null, NaN or infinite component."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(x.isNotNull() & ~bad)


@dataclass
class Tree:
    """Nodes of a level share one depth; node i of a level with m nodes spans rows ``i * n // m`` to ``(i + 1) * n // m``.

    ``boxes[level]`` is an array of (node, what, component), what being the least, the largest and the sum."""

    rows: np.ndarray
    members: np.ndarray
    boxes: list[np.ndarray]

    @property
    def depth(self) -> int:
        return len(self.boxes) - 1

    def bounds(self, level: int) -> np.ndarray:
        return (np.arange((1 << level) + 1, dtype=np.int64) * len(self.rows)) >> level


def _depth(n: int, leaf: int) -> int:
    """Levels below the root so that leaves hold at most ``leaf`` rows, and one at least."""
    depth = 0
    while n >> depth > leaf and n >> (depth + 1) >= 1:
        depth += 1
    return depth


def build_tree(x: np.ndarray, leaf: int) -> Tree:
    """A tree over the rows of ``x`` (integers, one row at least)."""
    order, depth = np.arange(len(x)), _depth(len(x), leaf)
    for level in range(depth):
        ends = (np.arange((2 << level) + 1, dtype=np.int64) * len(x)) >> (level + 1)
        for a, middle, b in zip(ends[:-2:2].tolist(), ends[1:-1:2].tolist(), ends[2::2].tolist(), strict=True):
            own = x[order[a:b]]
            spread = own.max(axis=0) - own.min(axis=0)
            if spread.size and spread.max():
                order[a:b] = order[a:b][np.argpartition(own[:, spread.argmax()], middle - a)]
    rows = x[order]
    boxes = []
    for level in range(depth + 1):
        first = (np.arange(1 << level, dtype=np.int64) * len(x)) >> level
        boxes.append(np.stack([f.reduceat(rows, first, axis=0) for f in (np.minimum, np.maximum, np.add)], axis=1))
    return Tree(rows, order, boxes)


def _box_distances(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest squared distance of points in pairs of boxes."""
    least = np.maximum(0, np.maximum(a[:, 0] - b[:, 1], b[:, 0] - a[:, 1]))
    most = np.maximum(a[:, 1] - b[:, 0], b[:, 1] - a[:, 0])
    return np.einsum("ij,ij->i", least, least), np.einsum("ij,ij->i", most, most)


def _halves(pairs: np.ndarray, side: int) -> np.ndarray:
    out = np.repeat(pairs, 2, axis=0)
    out[:, side] = out[:, side] * 2 + np.tile([0, 1], len(pairs))
    return out


def walk(tree: Tree, entries: Tree, whole, leaf) -> None:  # noqa: ANN001
    """Assign every row of ``tree`` to its nearest entry, equal distances to the lower entry.

    ``whole(level, nodes, entries)`` takes nodes that go to one entry as a whole, ``leaf(begin, end, candidates)`` the rows of a
    leaf with the entries that may be nearest, in ascending order.
    """
    pairs, level, below = np.zeros((1, 2), dtype=np.int64), 0, 0
    while True:
        # What the entries' node can be at most bounds what the others may be at least. Equal distances stay: the lower entry wins.
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        least, most = _box_distances(tree.boxes[level][pairs[:, 0]], entries.boxes[below][pairs[:, 1]])
        nodes, first = np.unique(pairs[:, 0], return_index=True)
        best = np.minimum.reduceat(most, first)
        pairs = pairs[least <= np.repeat(best, np.diff(np.append(first, len(pairs))))]
        if below == entries.depth:
            ends = entries.bounds(below)
            held = ends[pairs[:, 1] + 1] - ends[pairs[:, 1]]
            nodes, first, alive = np.unique(pairs[:, 0], return_index=True, return_counts=True)
            sole = (alive == 1) & (held[first] == 1)
            if sole.any():
                whole(level, nodes[sole], entries.members[ends[pairs[first[sole], 1]]])
                pairs = pairs[~np.repeat(sole, alive)]
        if not len(pairs) or (level == tree.depth and below == entries.depth):
            break
        if below < entries.depth:
            pairs, below = _halves(pairs, 1), below + 1
        if level < tree.depth:
            pairs, level = _halves(pairs, 0), level + 1
    if len(pairs):
        ends, of = tree.bounds(level), entries.bounds(below)
        nodes, first = np.unique(pairs[:, 0], return_index=True)
        for node, mine in zip(nodes.tolist(), np.split(pairs[:, 1], first[1:]), strict=True):
            left = np.sort(np.concatenate([entries.members[of[b] : of[b + 1]] for b in mine.tolist()]))
            leaf(int(ends[node]), int(ends[node + 1]), left)


def _nearest(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The first of the nearest entries of each row, by integers: |x|^2 is the same for all entries and left out."""
    return (np.einsum("ij,ij->i", entries, entries)[None, :] - 2 * (rows @ entries.T)).argmin(axis=1)


def _sums(tree: Tree, codebook: np.ndarray, entries: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the rows of each entry."""
    total, count = np.zeros_like(codebook), np.zeros(len(codebook), dtype=np.int64)

    def whole(level: int, nodes: np.ndarray, own: np.ndarray) -> None:
        np.add.at(total, own, tree.boxes[level][nodes, 2])
        np.add.at(count, own, np.diff(tree.bounds(level))[nodes])

    def leaf(begin: int, end: int, left: np.ndarray) -> None:
        own = left[_nearest(tree.rows[begin:end], codebook[left])]
        np.add.at(total, own, tree.rows[begin:end])
        np.add.at(count, own, 1)

    walk(tree, entries, whole, leaf)
    return total, count


def _codes(tree: Tree, codebook: np.ndarray, entries: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each row, in the order the tree was built from."""
    own = np.empty(len(tree.rows), dtype=np.int64)

    def whole(level: int, nodes: np.ndarray, entry: np.ndarray) -> None:
        ends = tree.bounds(level)
        for node, e in zip(nodes.tolist(), entry.tolist(), strict=True):
            own[ends[node] : ends[node + 1]] = e

    def leaf(begin: int, end: int, left: np.ndarray) -> None:
        own[begin:end] = left[_nearest(tree.rows[begin:end], codebook[left])]

    walk(tree, entries, whole, leaf)
    off = tree.rows - codebook[own]
    codes, errors = np.empty_like(own), np.empty_like(own)
    codes[tree.members], errors[tree.members] = own, np.einsum("ij,ij->i", off, off)
    return codes, errors


def _cells(column: pa.Array, scale: int, parts: int, width: int) -> np.ndarray:
    """Vectors of a list column as integers, one row each."""
    sizes = column.value_lengths().to_numpy()
    if (sizes != width).any():
        raise ValueError(f"vectors have to be of one length: {width} and {sizes[sizes != width][0]} components")
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)
    cells = np.floor(x * scale)
    # Four times the sum of squares of a part has to fit a long.
    if cells.size and 4 * max(width // parts, 1) * float(np.abs(cells).max()) ** 2 >= 2.0**62:
        raise ValueError("components are too large for exact integer distances")
    return cells.astype(np.int64)


def _tree_blocks(scale: int, parts: int, width: int, kept: T.StructType):  # noqa: ANN202
    """Blocks of vectors with the trees of their parts, as one row each."""

    def block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        vector = table.column("vector").combine_chunks()
        vector = vector.chunk(0) if isinstance(vector, pa.ChunkedArray) else vector
        kept_column = table.column("kept").combine_chunks()
        kept_column = kept_column.chunk(0) if isinstance(kept_column, pa.ChunkedArray) else kept_column
        trees = [build_tree(p, LEAF) for p in np.split(_cells(vector, scale, parts, width), parts, axis=1)]
        many = [
            [t.members.astype("<i4").tobytes() for t in trees],
            [t.rows.astype("<i8").tobytes() for t in trees],
            [np.concatenate(t.boxes).astype("<i8").tobytes() for t in trees],
        ]
        rows = pa.ListArray.from_arrays(pa.array([0, len(vector)], pa.int32()), kept_column)
        return pa.RecordBatch.from_arrays([rows, *[pa.array([m], pa.list_(pa.binary())) for m in many]], names=["kept", *_TREES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                some = batch.slice(at, BLOCK)
                if size and size + len(some) > BLOCK:
                    yield block(held)
                    held, size = [], 0
                held.append(some)
                size += len(some)
        if size:
            yield block(held)

    return run


def _trees(batch: pa.RecordBatch, row: int, width: int) -> list[Tree]:
    """The trees of a stored block."""
    out = []
    for members, rows, boxes in zip(*[batch.column(c)[row].as_py() for c in _TREES], strict=True):
        order = np.frombuffer(members, dtype="<i4").astype(np.int64)
        depth = _depth(len(order), LEAF)
        nodes = np.frombuffer(boxes, dtype="<i8").reshape((2 << depth) - 1, 3, width)
        levels = [nodes[(1 << level) - 1 : (2 << level) - 1] for level in range(depth + 1)]
        out.append(Tree(np.frombuffer(rows, dtype="<i8").reshape(len(order), width), order, levels))
    return out


def _round(sent: object, width: int):  # noqa: ANN202
    """Sums and counts of all entries over a task's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        over = [build_tree(b, 1) for b in books if len(b)]
        total, count = np.zeros_like(books), np.zeros(books.shape[:2], dtype=np.int64)
        for batch in batches:
            for row in range(len(batch)):
                for p, tree in enumerate(_trees(batch, row, width)):
                    sums, counts = _sums(tree, books[p], over[p])
                    total[p] += sums
                    count[p] += counts
        part, entry = np.nonzero(count)
        sums = pa.array(list(total[part, entry]), pa.list_(pa.int64()))
        arrays = [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), sums]
        yield pa.RecordBatch.from_arrays(arrays, names=["part", "entry", "n", "sums"])

    return run


def _encode(sent: object, width: int):  # noqa: ANN202
    """Code and error of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        over = [build_tree(b, 1) for b in books if len(b)]
        for batch in batches:
            for row in range(len(batch)):
                found = [_codes(tree, books[p], over[p]) for p, tree in enumerate(_trees(batch, row, width))]
                codes = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
                shown = [c.tobytes().hex() for c in codes]
                kept = batch.column("kept").slice(row, 1).flatten()
                yield pa.RecordBatch.from_arrays([kept, pa.array(shown), pa.array(sum(e for _, e in found))], names=["kept", "code", "error"])

    return run


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all components, by part, entry and place, as decimal integers with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4,
) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of each vector: the entry of each part in two hex digits, and how far off they are.

    Components become ``floor(scale * x)``, x as double. Codebooks start as the parts of the ``entries`` (256 at most) smallest ids; a round assigns
    each part to the nearest entry (squared distance, ties to the lower one) and moves each used entry to ``floor(sum / count)`` of
    its parts. ``error`` sums the squared distances of a vector's parts, ``label_error`` the errors of its label, nulls being one label.

    Vectors that are null or hold a null, NaN or infinite component give no row. A null id sorts last and stays null. Equal ids, and repeated rows,
    are vectors of their own, in the order of their components. Fewer vectors than entries give fewer entries. An empty table
    gives no rows. Vectors of different lengths, of a length that ``parts`` does not divide, and components too large for
    64-bit distances fail the job. Other columns are ignored, whatever their names.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256: a code has two hex digits for each part")
    spark = vectors.sparkSession
    good = usable_rows(vectors, vector_col)
    kept = F.struct(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    rows = good.select(kept.alias("kept"), F.col(vector_col).cast("array<double>").alias("vector"))
    # Floors are taken before sorting: equal integers need no order.
    cells = F.transform("vector", lambda c: F.floor(c * scale).cast("bigint"))
    first = rows.orderBy(F.col("kept.id").asc_nulls_last(), cells).select(cells.alias("cells")).limit(entries).collect()
    books = np.array([r.cells for r in first], dtype=object)
    length = len(first[0].cells) if first else 0
    if any(len(r.cells) != length for r in first) or length % parts:
        raise ValueError(f"vectors have to be of one length that {parts} divides")
    width = length // parts
    books = np.array(books.tolist(), dtype=np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()

    kept_type = rows.schema["kept"].dataType
    stored_type = T.StructType(
        [T.StructField("kept", T.ArrayType(kept_type)), *[T.StructField(c, T.ArrayType(T.BinaryType())) for c in _TREES]]
    )
    stored = materialize(rows.mapInArrow(_tree_blocks(scale, parts, length, kept_type), stored_type), "vector-trees")
    for _ in range(rounds if first else 0):
        sent = spark.sparkContext.broadcast(books)
        found = stored.select(*_TREES).mapInArrow(_round(sent, width), "part int, entry int, n bigint, sums array<bigint>")
        totals = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(width)])
        books = books.copy()
        for r in totals.collect():  # one row for each entry at most
            books[r.part, r.entry] = [s // r.n for s in r[3:]]
        sent.unpersist()

    coded_type = T.StructType([T.StructField("kept", kept_type), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded = stored.mapInArrow(_encode(spark.sparkContext.broadcast(books), width), coded_type)
    coded = materialize(coded.select("kept.id", "kept.label", "code", "error"), "vector-codes")
    per_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    own, sums = coded.alias("c"), per_label.alias("s")
    return own.join(sums, F.col("c.label").eqNullSafe(F.col("s.label")), "left").select(
        F.col("c.id").alias(id_col), "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256")
    )
