"""Near-duplicate documents by word shingles: candidates from SimHash and from min-wise samples, verified by exact similarity.

The components that SimHash links at three bits (:func:`lettermill.llm.simhash.near_duplicates`) are buckets of texts to compare. Two texts
whose five-word shingles have a Jaccard similarity of 0.8 may differ in more bits, which no small Hamming ball reaches. So a text is also filed under
``SAMPLES`` hashes of ``PER_SAMPLE`` shingles each that are smallest by some permutation: a sample is shared with a chance of
similarity ** PER_SAMPLE, so at 0.8 all of them differ for 2 pairs in 1,000. Only texts that share a filing with another one are looked
up again, and a bucket's texts are compared until each is reached from another: a spanning forest, never all pairs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.bytes_of import short_batches
from lettermill.llm import simhash
from lettermill.llm.simhash import connected_components
from lettermill.llm.url_filter import bloom_filter, maybe_listed, with_bloom
from lettermill.session import drop_folder, fresh_dir, materialize

WORDS, SIMILARITY = 5, 0.8
SAMPLES, PER_SAMPLE = 16, 5
#: Blocks of the Bloom filter that keeps unconcerned texts out of shuffles: 4 MB.
BLOCKS = 1 << 16
#: Bytes that one task compares at once, about: shingles, and ``ROOM`` for each text. A larger bucket is compared block by block.
PART, ROOM = 8 << 20, 1_024
_STEP = 16_384


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order: of lower-cased words, or of the whole if it has fewer; none without words."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
    first = np.concatenate([[0], ends[:-1] + 1])[: max(len(tokens) - words + 1, 1)].tolist()
    last = ends[min(words, len(tokens)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(first, last, strict=True)], dtype=np.uint64))


def _constants() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(11)
    n = SAMPLES * PER_SAMPLE
    return draw.integers(0, 1 << 63, (n, 1), dtype=np.uint64), draw.integers(0, 1 << 63, (n, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sample_keys(hashes: np.ndarray, constants: tuple[np.ndarray, np.ndarray]) -> list[int]:
    """``SAMPLES`` signed keys, each of the ``PER_SAMPLE`` shingles that come first by a permutation of theirs."""
    mask, factor = constants
    least = np.full(SAMPLES * PER_SAMPLE, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), _STEP):
        least = np.minimum(least, ((hashes[None, at : at + _STEP] ^ mask) * factor).min(axis=1))
    groups = least.reshape(SAMPLES, PER_SAMPLE)
    keys = np.array([xxhash.xxh64_intdigest(g.tobytes(), i) for i, g in enumerate(groups)], dtype=np.uint64)
    return keys.view(np.int64).tolist()


def _signatures(own: DataFrame) -> DataFrame:
    """(doc_id, digest, samples) of ``own(doc_id, digest, text)``."""
    short_batches(own.sparkSession)
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        constants = _constants()
        for batch in batches:
            samples = [sample_keys(shingle_hashes(text.as_py()), constants) for text in batch.column("text")]
            columns = [batch.column("doc_id"), batch.column("digest"), pa.array(samples, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "samples"])

    return own.mapInArrow(run, f"doc_id {kind}, digest binary, samples array<bigint>")


def _shared(filed: DataFrame, scratch: str | None = None) -> DataFrame:
    """(bucket, digest) of filings (key, digest, own) that several texts share. Buckets with the same texts are one.

    A key's texts are summed up before they are shuffled, never gathered: a bucket's name is that of two sums over its texts.
    """
    one = F.xxhash64("digest")
    keys = filed.groupBy("key").agg(
        F.min(one).alias("first"), F.max(one).alias("last"), F.bit_xor(one).alias("x"), F.bit_xor(F.xxhash64("digest", F.lit(1))).alias("y"),
        F.bool_or("own").alias("own"),
    )
    keys = materialize(keys.where("own and first <> last").select(F.col("key").alias("shared_key"), F.xxhash64("x", "y").alias("bucket")), "keys", scratch)
    maybe = _concerned(filed.select("key", "digest"), keys.select(F.col("shared_key").alias("key")), "key", scratch)
    return maybe.join(keys, F.col("key") == F.hex("shared_key")).select("bucket", "digest").distinct()


def forest(names: list[bytes], sets: list[frozenset], similarity: float, roots: list[bytes] | None = None) -> list[tuple[bytes, bytes]]:
    """Edges that join all texts linked, over others too, by a Jaccard similarity of at least ``similarity``.

    Texts of one root are joined already: they are neither compared nor get an edge.
    """
    roots = roots or names
    left, edges = list(range(len(names))), []
    while left:
        todo = [left.pop(0)]
        while todo and left:
            x = todo.pop()
            n, rest = len(sets[x]), []
            for y in left:
                if roots[x] == roots[y]:
                    todo.append(y)
                    continue
                m = len(sets[y])
                both = len(sets[x] & sets[y]) if min(n, m) >= similarity * max(n, m) else 0
                if n + m == 0 or both >= similarity * (n + m - both) and both:
                    edges.append((names[x], names[y]))
                    todo.append(y)
                else:
                    rest.append(y)
            left = rest
    return edges


def _compared(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of ``members(bucket, digest, root, shingles)``: a forest of each bucket, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, names, roots, sets = None, [], [], []

        def compare() -> list[tuple[bytes, bytes]]:
            return forest(names, sets, similarity, roots) if len(names) > 1 else []

        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            for key, digest, root, cell in zip(*(batch.column(c).to_pylist() for c in ("bucket", "digest", "root", "shingles")), strict=True):
                if key != bucket:
                    out += compare()
                    bucket, names, roots, sets = key, [], [], []
                names.append(digest)
                roots.append(root)
                sets.append(frozenset(np.frombuffer(cell, dtype="<u8").tolist()))
            yield _rows(out)
        yield _rows(compare())

    def _rows(edges: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([e[0] for e in edges], pa.binary()), pa.array([e[1] for e in edges], pa.binary())], names=["a", "b"]
        )

    dealt = members.select("bucket", "digest", "root", "shingles").repartition("bucket").sortWithinPartitions("bucket", "digest")
    return dealt.mapInArrow(run, "a binary, b binary")


def _edges(shared: DataFrame, shingles: DataFrame, similarity: float, scratch: str, before: DataFrame | None = None) -> DataFrame:
    """(a, b) of ``shared(bucket, digest, root)`` with ``shingles(digest, size, shingles)``; texts of one root are joined by ``before``.

    A bucket above ``PART`` is dealt into blocks of half of it. First each block is compared within. Then the texts outside the bucket's
    largest component so far meet all blocks, each pair of blocks in a task of its own; only texts of one component are not compared,
    as nothing comes of it. So every pair of a bucket is compared or joined already, whatever the bucket's size.
    """
    sized = shared.join(shingles.select("digest", "size"), "digest")
    blocks = lambda size: F.ceil(size * 2 / PART).cast("int")
    place = lambda n: F.pmod(F.xxhash64("bucket", "digest"), n).cast("int")
    large = sized.groupBy("bucket").agg(F.sum("size").alias("size")).where(F.col("size") > PART)
    large = _kept(large.select(F.col("bucket").alias("large"), blocks(F.col("size")).alias("n")), "large", scratch)
    dealt = shared.join(large, F.col("bucket") == F.col("large"), "left")
    block = F.when(F.col("n").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", place(F.col("n"))))
    first = dealt.select(block.alias("bucket"), "digest", "root")
    edges = _kept(_compared(first.join(shingles, "digest"), similarity), "edges", scratch)
    if large.isEmpty():
        return edges

    roots = connected_components(edges if before is None else edges.unionByName(before)).withColumnRenamed("root", "joined")
    rooted = sized.join(large, F.col("bucket") == F.col("large"), "left_semi").join(roots, F.col("digest") == F.col("node"), "left")
    rooted = _kept(rooted.select("bucket", "digest", "size", F.coalesce("joined", "digest").alias("root")), "rooted", scratch)
    tally = rooted.groupBy("bucket", "root").agg(F.sum("size").alias("size"))
    tally = tally.groupBy("bucket").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.max("size").alias("own"), F.sum("size").alias("all"))
    tally = tally.where("all > own").select(F.col("bucket").alias("open"), "main", blocks(F.col("own")).alias("n"), blocks(F.col("all") - F.col("own")).alias("m"))
    tally = _kept(tally, "open", scratch)
    both = rooted.join(tally, F.col("bucket") == F.col("open"))
    in_main, n, m = F.col("root") == F.col("main"), F.col("n"), F.col("m")
    upto = lambda count: F.sequence(F.lit(0), count - 1)
    own, other = place(n), place(m)
    against = lambda i, j: F.struct(F.lit(0).alias("side"), i.alias("i"), j.alias("j"))
    among = lambda j: F.struct(F.lit(1).alias("side"), F.least(other, j).alias("i"), F.greatest(other, j).alias("j"))
    pairs = F.when(in_main, F.transform(upto(m), lambda j: against(own, j))).otherwise(
        F.concat(F.transform(upto(n), lambda i: against(i, other)), F.transform(F.filter(upto(m), lambda j: j != other), among))
    )
    second = both.select("bucket", "digest", "root", F.explode(pairs).alias("p"))
    second = second.select(F.xxhash64("bucket", "p.side", "p.i", "p.j").alias("bucket"), "digest", "root")
    return edges.unionByName(_kept(_compared(second.join(shingles, "digest"), similarity), "edges", scratch))


def _linked(shared: DataFrame, shingles: DataFrame, similarity: float, scratch: str) -> DataFrame:
    """(a, b): edges that join all linked texts of ``shared(bucket, digest)``.

    A text's shingles would travel once for each bucket it shares. So each text first goes to the largest of its buckets alone; then only
    buckets whose texts are not all joined by that are compared, whole.
    """
    sizes = shared.groupBy("bucket").agg(F.count("*").alias("n"))
    best = shared.join(sizes, "bucket").groupBy("digest").agg(F.max_by("bucket", F.struct("n", "bucket")).alias("bucket"))
    first = _kept(best.select("bucket", "digest", F.col("digest").alias("root")), "first", scratch)
    edges = _edges(first, shingles, similarity, scratch)
    roots = connected_components(edges).withColumnRenamed("root", "joined")
    rooted = shared.join(roots, F.col("digest") == F.col("node"), "left").select("bucket", "digest", F.coalesce("joined", "digest").alias("root"))
    rooted = _kept(rooted, "after-first", scratch)
    still = rooted.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("bucket")
    rest = _kept(rooted.join(still, "bucket", "left_semi"), "rest", scratch)
    return edges.unionByName(_edges(rest, shingles, similarity, scratch, edges))


def _kept(df: DataFrame, name: str, scratch: str | None) -> DataFrame:
    """A table of this call, of any number with one name; see :func:`drop_near_duplicates` for when it goes."""
    return materialize(df, f"{name}-{uuid.uuid4().hex}", scratch)


def _concerned(rows: DataFrame, keys: DataFrame, key: str, scratch: str | None) -> DataFrame:
    """Of ``rows`` those whose ``key`` may be among ``keys(key)``, by a Bloom filter of fixed size, with the hexadecimal ``key``."""
    bloom = _kept(bloom_filter(keys.select(F.hex(key).alias("key")), BLOCKS), "bloom", scratch)
    return maybe_listed(rows.withColumn("key", F.hex(key)), bloom, BLOCKS)


def near_duplicate_rows(
    docs: DataFrame, *, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", scratch: str | None = None,
) -> DataFrame:
    """(doc_id, digest, kept) for every row: one row of each group is kept, that with the smallest id.

    A group is what links of similarity reach. Equal texts are linked; texts without words, null included, are one group. Of repeated
    rows with the same id and text all have the same answer, see :func:`drop_near_duplicates`. Null ids come last. Tables are written to
    ``scratch``, a folder that all executors reach; the result reads them.
    """
    scratch = scratch or fresh_dir(docs.sparkSession, "near")
    own = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("digest"), F.col(text_col).alias("text"))
    signed = _kept(_signatures(own), "signatures", scratch)
    distinct = signed.groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("samples").alias("samples"))
    distinct = _kept(distinct, "texts", scratch)
    sampled = distinct.select(F.explode("samples").alias("key"), "digest", F.lit(True).alias("own"))
    components = simhash.near_duplicates(own.select("digest", "text"), id_col="digest")
    linked = components.select(F.xxhash64("component_id").alias("key"), F.col("doc_id").alias("digest"), F.lit(True).alias("own")).distinct()
    linked = _kept(linked, "simhash", scratch)
    shared = _kept(_shared(sampled.unionByName(linked), scratch), "buckets", scratch)

    needed = _kept(shared.select("digest").distinct(), "needed", scratch)
    # Copies of one text go before the join: they combine on the map side, and the join finds the texts dealt by their digest.
    texts = _concerned(own.select("digest", "text"), needed, "digest", scratch).drop("key").dropDuplicates(["digest"])
    texts = texts.join(needed, "digest", "left_semi")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_hashes(t.as_py()).astype("<u8").tobytes() for t in batch.column("text")]
            columns = [batch.column("digest"), pa.array([len(c) + ROOM for c in found], pa.int64()), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["digest", "size", "shingles"])

    shingles = _kept(texts.mapInArrow(cells, "digest binary, size bigint, shingles binary"), "shingles", scratch)
    roots = connected_components(_linked(shared, shingles, similarity, scratch))
    ordered = F.struct(F.col("least").isNull().alias("no_id"), F.col("least"), F.col("digest"))
    grouped = distinct.select("digest", "least").join(roots, F.col("digest") == F.col("node"), "left")
    grouped = _kept(grouped.select("digest", "least", F.coalesce("root", "digest").alias("root")), "groups", scratch)
    winners = grouped.groupBy("root").agg(F.min(ordered).alias("w")).select("w.digest", F.col("w.least").alias("kept_id"))
    winners = _kept(winners, "winners", scratch)
    winners = winners.select(F.col("digest").alias("kept_digest"), "kept_id")
    joined = signed.select("doc_id", "digest").join(winners, F.col("digest") == F.col("kept_digest"), "left")
    kept = F.col("kept_digest").isNotNull() & F.col("doc_id").eqNullSafe(F.col("kept_id"))
    return joined.select("doc_id", "digest", kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, of which one stays for each group of near-duplicates.

    Rows that stay are passed on without a shuffle, but for those a Bloom filter cannot tell from dropped ones. Of repeated rows with
    the same id and text one stays. Null and empty texts are one group. An empty table gives no rows. Very long texts are compared whole.
    """
    scratch = fresh_dir(docs.sparkSession, "near")
    judged = _kept(near_duplicate_rows(docs, similarity=similarity, id_col=id_col, text_col=text_col, scratch=scratch), "judged", scratch)
    mark = lambda i, d: F.md5(F.concat(d, F.coalesce(i.cast("string"), F.lit("\x00")).cast("binary")))
    counted = judged.groupBy(mark(F.col("doc_id"), F.col("digest")).alias("near_mark")).agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    doubtful = materialize(counted.where(~F.col("kept") | (F.col("n") > 1)), "near-doubtful")
    drop_folder(docs.sparkSession, scratch)  # what follows reads the doubtful rows alone
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), mark(F.col(id_col), F.unhex(F.md5(text))).alias("key"))
    bloom = materialize(bloom_filter(doubtful.select(F.col("near_mark").alias("key")), BLOCKS), "near-bloom")
    probe = with_bloom(marked, bloom, BLOCKS)
    maybe = probe.where("maybe").join(doubtful, F.col("key") == F.col("near_mark"), "left")
    sure, free = probe.where(~F.col("maybe")), maybe.where(F.col("n").isNull())
    once = maybe.where(F.col("n").isNotNull() & F.col("kept")).dropDuplicates(["key"])
    return sure.select("row.*").unionByName(free.select("row.*")).unionByName(once.select("row.*"))
