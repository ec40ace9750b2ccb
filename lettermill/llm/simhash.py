"""Near-duplicates by SimHash, found by multi-index hashing.

A 64-bit fingerprint is cut into two halves. Two fingerprints that differ in at most three bits differ in at most one bit in one half, so
one of them, with that bit set, meets the other's half when the bit is cleared. Each distinct fingerprint is filed under both halves and
enumerates the ball of one cleared bit around each; whole distances are verified per bucket. A bucket gives a spanning tree of what is
linked in it, never all pairs, so rows stay in proportion to fingerprints however dense a group is. Buckets beyond a size are filed
again by the bytes of the other half, one of which two linked fingerprints share. Trees are joined by alternating star contractions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lettermill.llm.bytes_of import short_batches
from lettermill.session import materialize

SEED = 42
#: Fingerprints of one bucket that one task compares; larger buckets are filed again.
BUCKET = 20_000
_STEP = 32_768


def fingerprint(text: str | None, words: int = 3) -> int:
    """Bits that are set in over half of the shingles' hashes, as an unsigned number; 0 without words."""
    tokens = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(tokens) - words + 1, 1)
    first, last = starts[:n].tolist(), ends[min(words, len(tokens)) - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, _STEP):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(first[at : at + _STEP], last[at : at + _STEP], strict=True)]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed bigint."""
    short_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([own.schema["doc_id"], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column("text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return own.mapInArrow(run, schema)


def filings(fp: Column) -> Column:
    """Array of (key, own): each half itself (own), and with each of its set bits cleared."""
    whole = F.lit(0xFFFFFFFF).cast("bigint")
    rows = []
    for half, value in enumerate((fp.bitwiseAND(whole), F.shiftrightunsigned(fp, 32))):
        cleared = [
            F.when(value.bitwiseAND(F.lit(1 << bit)) != 0, F.struct((value + ((half << 32) - (1 << bit))).alias("key"), F.lit(False).alias("own")))
            for bit in range(32)
        ]
        rows += [F.struct((value + (half << 32)).alias("key"), F.lit(True).alias("own")), *cleared]
    return F.array_compact(F.array(*rows))


def _filed(distinct: DataFrame) -> DataFrame:
    """(key, fp, own) of ``distinct(fp)``."""
    return distinct.select("fp", F.explode(filings(F.col("fp"))).alias("f")).select("f.key", "fp", "f.own")


def _filed_again(deferred: DataFrame) -> DataFrame:
    """(key, fp, own): members of large buckets by (bucket, place and value of a byte of the other half)."""
    other = F.when(F.shiftright("key", 32) == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")))
    parts = [F.xxhash64("key", F.lit(i), F.shiftright(other, 8 * i).bitwiseAND(F.lit(255))) for i in range(4)]
    return deferred.select("fp", "own", F.explode(F.array(*parts)).alias("key")).select("key", "fp", "own")


def bucket_trees(fps: np.ndarray, radius: int) -> list[tuple[int, np.ndarray]]:
    """Components of the links within ``radius`` as (smallest member, other members), for unsigned fingerprints in order."""
    left, out = fps, []
    while len(left):
        root, left = left[0], left[1:]
        todo, members = [root], []
        while todo and len(left):
            near = np.bitwise_count(left ^ todo.pop()) <= radius
            if near.any():
                members.append(left[near])
                todo.extend(left[near])
                left = left[~near]
        if members:
            out.append((root, np.concatenate(members)))
    return out


def _verify(filed: DataFrame, radius: int, limit: int | None) -> DataFrame:
    """(key, a, b, own): a tree edge a < b where key is null, else a member (key, a, own) of a bucket of over ``limit``."""
    schema = "key bigint, a bigint, b bigint, own boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # of the bucket that goes on in the next batch
        held_key, size, large = None, 0, False

        def edges(fps: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
            if own.any() and len(fps) > 1:
                for root, members in bucket_trees(np.unique(fps.view(np.uint64)), radius):
                    b = members.view(np.int64)
                    a = np.full(len(b), root, dtype=np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(len(b), pa.int64()), pa.array(a), pa.array(b), pa.nulls(len(b), pa.bool_())], names=["key", "a", "b", "own"]
                    )

        def later(key: int, fps: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
            n = len(fps)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, key)), pa.array(fps), pa.nulls(n, pa.int64()), pa.array(own)], names=["key", "a", "b", "own"]
            )

        def end() -> Iterator[pa.RecordBatch]:
            if held and not large:
                yield from edges(*(np.concatenate(x) for x in zip(*held, strict=True)))

        for batch in batches:
            if not len(batch):
                continue
            key, fps, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "own"))
            starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
            stops = np.append(starts[1:], len(key))
            alone = (stops - starts == 1) & (starts > 0) & (stops < len(key))
            for a, b in zip(starts[~alone].tolist(), stops[~alone].tolist(), strict=True):
                if key[a] != held_key:
                    yield from end()
                    held, held_key, size, large = [], key[a], 0, False
                held.append((fps[a:b].copy(), own[a:b].copy()))
                size += b - a
                if limit is not None and size > limit:
                    large = True
                if large:
                    for part in held:
                        yield later(held_key, *part)
                    held = []
        yield from end()

    return filed.repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


def links(distinct: DataFrame, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) whose components are those of all links within ``radius`` (at most 3) among ``distinct(fp)``. Written and reread."""
    if not 0 <= radius <= 3:
        raise ValueError("two halves of which one has at most one bit that differs: the radius is 3 at most")
    found = materialize(_verify(_filed(distinct), radius, bucket), "simhash-links")
    edges = found.where(F.col("key").isNull()).select("a", "b")
    deferred = found.where(F.col("key").isNotNull()).select("key", F.col("a").alias("fp"), "own")
    if not deferred.isEmpty():
        # Such a bucket agrees in 39 bits at least; its size is bounded.
        again = materialize(_verify(_filed_again(deferred), radius, None), "simhash-links")
        edges = edges.unionByName(again.select("a", "b"))
    return edges


def _least(pairs: DataFrame) -> DataFrame:
    return materialize(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "components-least").withColumnRenamed("u", "w")


def _single(edges: DataFrame) -> bool:
    """Whether no node ``u`` has two edges: then, if none is a ``v`` either, all trees are stars."""
    return edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges(a, b)`` but the smallest of its component, with that. Nodes compare as signed numbers.

    Alternates large-star and small-star until all trees are stars, that is no root is a node below another one: both steps keep
    components, so there is one star for each then. Rounds grow with the logarithm of the nodes. Each step is a grouped minimum and a
    join with it, both over tables in the shared folder; joins with a hub are split by the adaptive planner.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialize(now, "components")
    while not now.join(now.select(F.col("v").alias("root")), F.col("u") == F.col("root"), "left_semi").isEmpty() or not _single(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "components")
        least = _least(large)
        small = large.join(least, F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct(), "components")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(
    docs: DataFrame, *, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET
) -> DataFrame:
    """(doc_id, fp, component_id) of every row; ``component_id`` is the smallest id that links reach, own one included.

    Null and blank texts have fingerprint zero, which is linked like any other. Texts with fewer words than a shingle are one shingle.
    Equal texts share a fingerprint and so a component, however many they are. Repeated ids are repeated rows; a null id is in its
    component but never its id, unless all are null. Very long texts are hashed whole, in steps. An empty table gives no rows; other
    columns are ignored.
    """
    own = materialize(fingerprints(docs, words, id_col=id_col, text_col=text_col), "simhash-fingerprints")
    distinct = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = connected_components(links(distinct.select("fp"), radius, bucket))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    grouped = materialize(rooted.where("root <> fp"), "simhash-members")
    heads = distinct.join(grouped.select(F.col("root").alias("fp")).distinct(), "fp", "left_semi").select("fp", "least", F.col("fp").alias("root"))
    members = grouped.unionByName(heads)
    named = materialize(members.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-names")
    linked = materialize(members.join(named, "root").select(F.col("fp").alias("member"), "component_id"), "simhash-components")
    every = materialize(
        distinct.join(linked, F.col("fp") == F.col("member"), "left").select(
            F.col("fp").alias("own_fp"), F.coalesce("component_id", "least").alias("component_id")
        ),
        "simhash-all",
    )
    return own.join(every, F.col("fp") == F.col("own_fp")).select("doc_id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
