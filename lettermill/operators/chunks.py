"""Adaptive halving of long texts and level-wise pooling of their vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.functions.text import collapse_whitespace
from lettermill.functions.vectors import l2_norm, scale_to_unit
from lettermill.operators.embed import EmbedFn, model_embed
from lettermill.session import materialize


def _split_at(text: Column) -> Column:
    """How many characters go left: up to the last space before the middle, else the first after, else the middle."""
    middle = F.floor(F.length(text) / 2).cast("int")
    from_end = F.instr(F.reverse(F.substring(text, F.lit(1), middle)), " ")
    after = F.position(F.lit(" "), text, middle + 1)
    return F.when(from_end > 0, middle - from_end + 1).when(after > 0, after).otherwise(middle)


def _halves(node: Column) -> Column:
    """An inner node without text, followed by its two children."""
    text = node["chunk"]
    cut = _split_at(text)
    left = F.trim(F.substring(text, F.lit(1), cut))
    right = F.trim(F.substring(text, cut + 1, F.length(text)))
    return F.array(
        _node(node["path"], node["chunk_length"], F.lit(None).cast("string")),
        _node(F.concat(node["path"], F.lit("L")), F.length(left), left),
        _node(F.concat(node["path"], F.lit("R")), F.length(right), right),
    )


def _node(path: Column, length: Column, chunk: Column) -> Column:
    return F.struct(path.alias("path"), length.cast("int").alias("chunk_length"), chunk.alias("chunk"))


def _rounds(length: Column, limit: int) -> Column:
    """Enough halving rounds for any text of this length.

    A cut far from the middle leaves a part without a space up to near its own middle, so every two rounds
    shrink the longest part to at most three quarters, or leave parts without spaces that halve exactly.
    """
    return F.ceil(6 * F.log2(length / limit)).cast("int") + 4


def chunk_nodes(texts: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """The split tree of every text: ``(key, path, chunk_length, chunk)``; inner nodes have a null chunk.

    The tree grows inside the row, so there is no shuffle, no driver loop and no growing lineage. The path
    is a string of L and R; the root's is empty.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    rows = texts.select(key, collapse_whitespace(F.coalesce(text, F.lit(""))).alias("t"))
    rows = rows.select(key, "t", F.length("t").alias("n"))

    def grow(nodes: Column, _round: Column) -> Column:
        too_long = lambda node: node["chunk"].isNotNull() & (node["chunk_length"] > limit)
        return F.flatten(F.transform(nodes, lambda node: F.when(too_long(node), _halves(node)).otherwise(F.array(node))))

    # The condition keeps the field nullable, as the inner nodes that replace the root have no text.
    root = F.array(_node(F.lit(""), F.col("n"), F.when(F.col("n") >= 0, F.col("t"))))
    grown = F.aggregate(F.sequence(F.lit(1), _rounds(F.col("n"), limit)), root, grow)
    trees = rows.select(key, F.when(F.col("n") > limit, grown).otherwise(root).alias("nodes"))
    # The outer form spares the "not empty" filter that would be pushed down and grow every tree twice.
    nodes = trees.select(key, F.inline_outer("nodes"))
    unfinished = F.col("chunk").isNotNull() & (F.col("chunk_length") > limit)
    return nodes.withColumn(
        "chunk", F.when(unfinished, F.raise_error(F.lit("chunk tree is not finished"))).otherwise(F.col("chunk"))
    )


def chunk_text(texts: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """The chunks in text order: ``(key, path, chunk_length, chunk)``."""
    return chunk_nodes(texts, key, text, limit).where(F.col("chunk").isNotNull())


def _fold(stack: Column, node: Column) -> Column:
    """One step through a tree's nodes, children before their parent: a parent takes its children off the stack, a leaf is put on it."""
    last, before = F.try_element_at(stack, F.lit(-1)), F.try_element_at(stack, F.lit(-2))
    is_child = lambda entry, side: F.coalesce(entry["path"] == F.concat(node["path"], F.lit(side)), F.lit(False))
    both = is_child(last, "R") & is_child(before, "L")
    left, right, total = before["vector"], last["vector"], before["chunk_length"] + last["chunk_length"]
    mean = F.when(
        F.size(left) != F.size(right), F.raise_error(F.lit("chunk vectors of one text differ in length")).cast("array<double>")
    ).otherwise(F.zip_with(left, right, lambda a, b: (a * before["chunk_length"] + b * last["chunk_length"]) / total))
    taken = F.when(both, 2).when(is_child(last, "L") | is_child(last, "R"), 1).otherwise(0)
    pooled = F.when(both, scale_to_unit(mean, l2_norm(mean)))
    entry = F.struct(node["path"].alias("path"), node["chunk_length"].alias("chunk_length"), F.coalesce(node["vector"], pooled).alias("vector"))
    return F.concat(F.slice(stack, F.lit(1), F.size(stack) - taken), F.array(entry))


def pool_chunks(nodes: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Vectors of whole texts from the vectors of their chunks.

    ``nodes`` come from :func:`chunk_nodes`, ``vectors`` are ``(key, path, vector)`` of the leaves. The nodes of a text are
    brought together once, as one array, children before their parent, and folded over a stack: two siblings become the length-weighted mean,
    scaled to unit length. A text that was not split keeps its vector; a part without a vector leaves those above it without one. Output:
    ``(key, vector, chunk_count, chunk_lengths)`` where the counts describe the root's direct children.
    """
    own = nodes.join(vectors, [key, "path"], "left")
    # Z comes after L and R, so a node sorts after all nodes below it.
    order = F.concat("path", F.lit("Z")).alias("place")
    node = F.struct(order, "path", F.col("chunk_length").cast("int").alias("chunk_length"), F.col("vector").cast("array<double>").alias("vector"))
    trees = own.groupBy(key).agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    empty = F.array().cast("array<struct<path:string,chunk_length:int,vector:array<double>>>")
    root = F.element_at(F.aggregate("nodes", empty, _fold), -1)
    top = F.transform(F.filter("nodes", lambda n: F.length(n["path"]) == 1), lambda n: n["chunk_length"])
    return trees.select(key, root["vector"].alias("vector"), F.size(top).alias("chunk_count"), top.alias("chunk_lengths"))


def embed_long_texts(
    texts: DataFrame, key: str, embed_fn: EmbedFn, provider: str, model_name: str, text: str = "searchable_text"
) -> DataFrame:
    """Model vectors where texts the model finds too long are halved until they fit, then pooled.

    The model itself reports the overflow by an error that names the context length. A round embeds all
    open parts of all texts at once and is written before the next one starts, so no part is embedded
    twice. There are as many rounds as the deepest tree has levels. Columns as of ``model_embed`` plus
    ``chunk_count`` and ``chunk_lengths`` (null for texts that were not split).
    """
    overflow = F.coalesce(F.lower("error").contains("context length"), F.lit(False)) & (F.col("chunk_length") > 1)
    start = collapse_whitespace(F.coalesce(text, F.lit("")))
    pending = texts.select(key, F.lit("").alias("path"), start.alias("chunk"))
    rounds = []
    while True:
        sized = materialize(pending.withColumn("chunk_length", F.length("chunk")), "chunk-frontier")
        answers = model_embed(sized, [key, "path"], embed_fn, provider, model_name, "chunk").join(
            sized.select(key, "path", "chunk_length"), [key, "path"]
        )
        answered = materialize(answers, "chunk-vectors")
        rounds.append(answered)
        open_parts = sized.join(answered.where(overflow).select(key, "path"), [key, "path"], "left_semi")
        if open_parts.isEmpty():
            break
        node = _node(F.col("path"), F.col("chunk_length"), F.col("chunk"))
        halves = open_parts.select(key, F.inline_outer(_halves(node)))
        pending = halves.where(F.col("chunk").isNotNull()).select(key, "path", "chunk")
    nodes = reduce(DataFrame.unionByName, rounds)
    failed = nodes.where(F.col("error").isNotNull() & ~overflow).groupBy(key).agg(F.min("error").alias("error"))
    sound = nodes.join(failed.select(key), key, "left_anti")
    leaves = sound.where(F.col("vector").isNotNull()).select(key, "path", "vector")
    pooled = pool_chunks(sound.select(key, "path", "chunk_length"), leaves, key)
    split = F.col("chunk_count") > 0
    good = pooled.select(
        key,
        "vector",
        F.size("vector").alias("dimensions"),
        F.when(split, F.col("chunk_count")).alias("chunk_count"),
        F.when(split, F.col("chunk_lengths")).alias("chunk_lengths"),
    )
    rows = good.unionByName(failed, allowMissingColumns=True)
    return rows.withColumns({"provider": F.lit(provider), "model_name": F.lit(model_name)})
