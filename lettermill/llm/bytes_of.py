"""Text columns as bytes in numpy, for operators that look at every character."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lettermill.session import short_batches  # noqa: F401


def text_blocks(texts: pa.Array, block: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, where each row begins, with the end) for runs of rows of at most ``block`` bytes, or one longer row.

    Letters are in lower case, one for one, so that places counted in characters are those of the texts. Nulls count as empty.
    """
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    _, at, data = texts.buffers()
    if not len(texts):
        return
    ends = np.frombuffer(at, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(texts):
        stop = max(int(np.searchsorted(ends, ends[row] + block, side="right")) - 1, row + 1)
        yield row, whole[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row]
        row = stop


def _letters() -> np.ndarray:
    table = np.full(256, 32, dtype=np.uint8)
    table[128:] = np.arange(128, 256)
    for a, z in ("az", "09"):
        table[ord(a) : ord(z) + 1] = np.arange(ord(a), ord(z) + 1)
    table[65:91] = np.arange(97, 123)
    return table


_TABLE = _letters()


def _marks(data: np.ndarray) -> np.ndarray:
    """Places of the bytes of spaces and punctuation beyond ASCII: of Latin-1, the general ones, the East Asian and the full-width ones."""
    two = np.flatnonzero(data[:-1] == 0xC2)
    follow = data[two + 1]
    two = two[~np.isin(follow, _LATIN_SIGNS) & (follow >= 0xA0)]
    three = np.flatnonzero((data[:-2] >= 0xE2) & (data[:-2] <= 0xEF))
    a, b, c = data[three], data[three + 1], data[three + 2]
    general = (a == 0xE2) & ((b == 0x80) | (b == 0x81) & (c < 0xB0))
    asian = (a == 0xE3) & (b == 0x80) & (c <= 0xBF) & ~np.isin(c, _ASIAN_LETTERS)
    wide = (a == 0xEF) & (b == 0xBC) & (c >= 0x81) & (c <= 0x8F)
    three = three[general | asian | wide]
    return np.concatenate([two, two + 1, three, three + 1, three + 2])


# Last bytes of the letters and numbers between those signs (feminine and masculine ordinal, superscript 2, 3 and 1, micro;
# iteration mark, closing mark and zero of East Asian texts).
_LATIN_SIGNS = [0xAA, 0xB2, 0xB3, 0xB5, 0xB9, 0xBA]
_ASIAN_LETTERS = [0x85, 0x86, 0x87]


def lower_letters(data: np.ndarray) -> np.ndarray:
    """Bytes of lower-case texts with everything that is no letter or digit as spaces; UTF-8 beyond the common signs stays as it is."""
    out = _TABLE[data]
    if len(data) and data.max() >= 0x80:
        out[_marks(data)] = 32
    return out
