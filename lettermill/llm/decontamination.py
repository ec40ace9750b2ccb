"""Benchmark decontamination by the q-gram lemma.

If a passage of n characters occurs with at most k edits, it keeps n - q + 1 - kq of its q-grams, and these lie on k + 1 neighbouring
diagonals (place in the text minus place in the passage). Shared q-grams are counted in diagonal bands that overlap by k, so that one
band holds all of them; regions that reach the number are verified by an alignment that is banded likewise. Benchmark passages are the
small side: their q-grams go to the tasks in blocks of bounded size, the documents are read once per block and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lettermill.llm.bytes_of import lower_letters, short_batches, text_blocks

Q = 10
#: Edits allowed for a character of the passage; fewer for short passages, so that this many shared q-grams stay needed.
EDITS, LEAST = 0.08, 4
#: Characters of benchmark text whose q-grams are sent out at once, and bytes of text looked at in one go.
BENCHMARK_BLOCK, TEXT_BLOCK = 4_000_000, 1 << 19
#: Shared q-grams held at once; where there are more, the passages are taken in halves.
HELD = 1 << 21
_SIEVE = 20
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def normalise(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, where each text begins, kept): lower-case letters and digits, with single spaces between them."""
    flat = lower_letters(data) if len(data) else data
    space = flat == 32
    kept = ~space
    if len(flat):
        kept[1:] |= ~space[:-1]
        firsts = begin[:-1][begin[:-1] < len(flat)]
        kept[firsts] = ~space[firsts]
    return flat[kept], np.concatenate([[0], np.cumsum(kept)])[begin], kept


def grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q bytes from each place on."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    data = np.ascontiguousarray(data)
    words = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    h = words[:n] * _M1
    h ^= words[Q - 8 : Q - 8 + n] * _M2
    h ^= h >> np.uint64(29)
    h *= _M1
    return h


@dataclass
class Index:
    """q-grams of a block of passages: hashes in order, and the (item, place) of each; sieve: the hashes' first bits."""

    names: list
    texts: list[bytes]
    budget: np.ndarray
    needed: np.ndarray
    band: np.ndarray
    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    sieve: np.ndarray


def index_of(items: list[tuple]) -> Index:
    """``items``: (name, text). Passages of fewer than Q characters have no q-gram and are left out."""
    names, texts = [], []
    for row, raw, begin in text_blocks(pa.array([text for _, text in items], pa.large_string()), TEXT_BLOCK):
        clean, at, _ = normalise(raw, begin)
        for i in range(len(at) - 1):
            text = clean[at[i] : at[i + 1]].tobytes().strip()
            if len(text) >= Q:
                names.append(items[row + i][0])
                texts.append(text)
    n = np.array([len(t) for t in texts], dtype=np.int64)
    budget = np.maximum(np.minimum((n * EDITS).astype(np.int64), (n - Q + 1 - LEAST) // Q), 0)
    each = [grams(np.frombuffer(t, dtype=np.uint8)) for t in texts]
    hashes = np.concatenate(each) if each else np.zeros(0, dtype=np.uint64)
    item = np.repeat(np.arange(len(texts)), [len(x) for x in each])
    place = np.concatenate([np.arange(len(x)) for x in each]) if each else np.zeros(0, dtype=np.int64)
    order = np.argsort(hashes, kind="stable")
    sieve = np.zeros(1 << _SIEVE, dtype=bool)
    sieve[(hashes >> np.uint64(64 - _SIEVE)).astype(np.int64)] = True
    return Index(names, texts, budget, n - Q + 1 - budget * Q, np.maximum(2 * budget, 16), hashes[order], item[order], place[order], sieve)


def shared_grams(data: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the text, first row of the index, number of rows) of every shared q-gram."""
    h = grams(data)
    at = np.flatnonzero(index.sieve[(h >> np.uint64(64 - _SIEVE)).astype(np.int64)])
    left, right = (np.searchsorted(index.hashes, h[at], side=s) for s in ("left", "right"))
    n = right - left
    return at[n > 0], left[n > 0], n[n > 0]


def regions(data: np.ndarray, begin: np.ndarray, index: Index) -> Iterator[tuple[int, int, int]]:
    """(text, item, first diagonal of a band) wherever a band of one text shares enough q-grams with an item."""
    at, left, n = shared_grams(data, index)
    first, last = (int(index.item.min()), int(index.item.max())) if len(at) else (0, 0)
    if n.sum() > HELD and first < last:
        upper = index.item > (first + last) // 2
        for own in (~upper, upper):
            yield from regions(data, begin, replace(index, hashes=index.hashes[own], item=index.item[own], place=index.place[own]))
        return
    rows = np.repeat(left - (np.cumsum(n) - n), n) + np.arange(n.sum())
    at, item, place = np.repeat(at, n), index.item[rows], index.place[rows]
    text = np.searchsorted(begin, at, side="right") - 1
    inside = at + Q <= begin[text + 1]
    at, item, place, text = at[inside], item[inside], place[inside], text[inside]
    width, k = index.band[item], index.budget[item]
    diagonal = at - place + len(data)  # never negative below
    band = diagonal // width
    low = diagonal % width < k  # also the end of the band before, which reaches k further
    item, band, text, place = (np.append(x, y[low]) for x, y in ((item, item), (band, band - 1), (text, text), (place, place)))
    order = np.lexsort((band, item, text))
    item, band, text, place = item[order], band[order], text[order], place[order]
    if not len(item):
        return
    edge = np.flatnonzero((np.diff(item) != 0) | (np.diff(band) != 0) | (np.diff(text) != 0)) + 1
    first = np.concatenate([[0], edge])
    last = np.append(first[1:], len(item))
    good = last - first >= index.needed[item[first]]
    for i, j in zip(first[good].tolist(), last[good].tolist(), strict=True):
        # Each q-gram of the passage counts once, however often the text repeats it.
        if len(np.unique(place[i:j])) >= index.needed[item[i]]:
            yield int(text[i]), int(item[i]), int(band[i] * index.band[item[i]] - len(data))


def align(item: bytes, region: bytes, low: int, high: int, most: int) -> tuple[int, int]:
    """(edits, end) of the best place of ``item`` in ``region`` on the diagonals from ``low`` to ``high``; the first end of equals.

    Edits count bytes. Ends early, with more than ``most``, once the whole band has more.
    """
    a, b = np.frombuffer(item, dtype=np.uint8), np.frombuffer(region, dtype=np.uint8)
    width, far = high - low + 1, len(item) + 1
    padded = np.zeros(len(a) + width + 2, dtype=np.int16) - 1  # characters on the band; -1 outside the region
    source = np.arange(len(padded)) + low
    ok = (source >= 0) & (source < len(b))
    padded[ok] = b[source[ok]]
    steps = np.arange(width)
    row = np.where((steps + low >= 0) & (steps + low <= len(b)), 0, far)
    for j, c in enumerate(a):
        step = row + (padded[j : j + width] != c)
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        row = np.minimum.accumulate(step - steps) + steps
        place = j + 1 + low + steps
        row = np.where((place >= 0) & (place <= len(b)), row, far)
        if j & 7 == 7 and row.min() > most:
            return most + 1, 0
    best = int(row.argmin())
    return int(row[best]), len(a) + low + best


def verify(data: np.ndarray, start: int, stop: int, index: Index, item: int, diagonal: int) -> tuple[int, int, int] | None:
    """(edits, start, stop) in ``data`` if the item is within its budget on this band of the text from ``start`` to ``stop``."""
    text, k = index.texts[item], int(index.budget[item])
    a = max(start, diagonal)
    b = min(stop, diagonal + int(index.band[item]) + 2 * k + len(text))
    region = data[a:b].tobytes()
    whole = region.find(text)
    if whole >= 0:
        return 0, a + whole, a + whole + len(text)
    if not k:
        return None
    edits, end = align(text, region, diagonal - a, diagonal - a + int(index.band[item]) + k, k)
    if edits > k:
        return None
    back, length = align(text[::-1], region[:end][::-1], -k, k, edits)
    return edits, a + end - length if back == edits else max(a, a + end - len(text)), a + end


def leaks_in(texts: pa.Array, index: Index) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, edits, start, stop) in characters: of each item in each text the place with fewest edits, the first of equals."""
    longest = max((len(t) for t in index.texts), default=0)
    reach = 3 * longest + 64
    for row, raw, begin in text_blocks(texts, TEXT_BLOCK):
        data, at, kept = normalise(raw, begin)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for a in range(0, max(len(data), 1), TEXT_BLOCK):  # more than one only for a very long text
            part = data[a : a + TEXT_BLOCK + reach]
            own = np.clip(at - a, 0, len(part))
            for text, item, diagonal in regions(part, own, index):
                found = verify(part, int(own[text]), int(own[text + 1]), index, item, diagonal)
                if found:
                    key, found = (text, item), (found[0], found[1] + a, found[2] + a)
                    best[key] = min(best.get(key, found), found)
        if best:
            places = np.append(np.flatnonzero(kept), len(raw))
            letters = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            for (text, item), (edits, start, stop) in sorted(best.items()):
                zero = letters[begin[text]]
                yield row + text, item, edits, int(letters[places[start]] - zero), int(letters[places[stop - 1] + 1] - zero)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The passages in blocks of about ``BENCHMARK_BLOCK`` characters."""
    own = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    short_batches(benchmark.sparkSession)
    total = own.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // BENCHMARK_BLOCK)
    for block in range(blocks):
        rows = own.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        yield sorted(((r["item"], r["text"]) for r in rows), key=lambda x: (x[0] is None, x[0], x[1]))


def _sent(docs: DataFrame, block: list[tuple]) -> object:
    """A block's index as plain arrays: the class itself travels with the function, so that workers need no installed copy."""
    index = index_of(block)
    return docs.sparkSession.sparkContext.broadcast(tuple(getattr(index, f.name) for f in fields(index)))


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, start, stop): every passage in every text, once, at the place with the fewest edits.

    Case (of letters that have one other for one), the common punctuation and white space do not count. ``start`` and ``stop`` are characters of the text. A passage of fewer than Q letters
    is never found. Null and empty texts hold nothing; null and empty passages are nowhere. Repeated rows give rows each, repeated
    passages too. Very long texts are looked at whole, in overlapping parts. Empty tables give no rows; other columns are ignored.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    item_type = benchmark.schema[item_col].dataType
    schema = T.StructType(
        [own.schema["doc_id"], T.StructField("item_id", item_type)] + [T.StructField(c, T.LongType()) for c in ("edits", "start", "stop")]
    )
    found, arrow_item = docs.sparkSession.createDataFrame([], schema), to_arrow_type(item_type)
    for block in _blocks(benchmark, item_col, item_text_col):
        sent = _sent(docs, block)

        def run(batches: Iterator[pa.RecordBatch], sent: object = sent) -> Iterator[pa.RecordBatch]:
            index = Index(*sent.value)
            for batch in batches:
                rows = list(leaks_in(batch.column("text"), index))
                take = [[r[i] for r in rows] for i in range(5)]
                names = pa.array([index.names[i] for i in take[1]], arrow_item)
                ids = batch.column("doc_id").take(pa.array(take[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, names, *(pa.array(x, pa.int64()) for x in take[2:])], names=schema.names)

        found = found.unionByName(own.mapInArrow(run, schema))
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, that hold no passage; see :func:`find_leaks`. Nothing is shuffled or joined."""
    for block in _blocks(benchmark, item_col, item_text_col):
        sent = _sent(docs, block)

        def run(batches: Iterator[pa.RecordBatch], sent: object = sent) -> Iterator[pa.RecordBatch]:
            index = Index(*sent.value)
            for batch in batches:
                clean = np.ones(len(batch), dtype=bool)
                clean[[r[0] for r in leaks_in(batch.column(text_col), index)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
