"""Tokenizer files inside tasks: exact ids of whole texts, cheap for the words that repeat."""

from __future__ import annotations

import json
import os
import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text whose pieces are made distinct together; a longer text is encoded on its own.
BLOCK = 2 << 20
#: Distinct pieces whose ids a worker remembers at most, and their bytes.
REMEMBERED, REMEMBERED_BYTES = 1_000_000, 32 << 20
_UNICODE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
# Fixed value: how byte-level BPE of this kind splits a text before merging.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def worker_state() -> dict:
    """A dictionary that lives as long as the worker process, whichever tasks it runs."""
    return sys.modules.setdefault("_lettermill_worker_state", types.ModuleType("_lettermill_worker_state")).__dict__


def _token_bytes(vocabulary: dict[str, int]) -> list[bytes]:
    """The bytes of each id: printable Latin-1 characters stand for themselves, the other bytes for U+0100 onwards."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(of[c] for c in token)
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers without any algebra between places."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def runs(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``begin`` and have ``sizes``, one run after the other."""
    after = np.cumsum(sizes)
    return np.repeat(begin - (after - sizes), sizes) + np.arange(after[-1] if len(after) else 0)


def _chunks(block: bytes, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of pieces, eight in a number and zeros after their ends; where each piece's numbers begin, and how many they are."""
    at_byte = np.ndarray((len(block),), dtype="<u8", buffer=block + bytes(8), strides=(1,))
    n = (sizes + 7) >> 3
    after = np.cumsum(n)
    at = after - n
    chunks = at_byte[np.repeat(begin - 8 * at, n) + 8 * np.arange(after[-1])]
    chunks[after - 1] &= np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 * n - sizes).astype(np.uint64) << np.uint64(3))
    return chunks, at, n


class Codec:
    """Ids of a ``.json`` (tokenizers) or ``.model`` (sentencepiece) file, without begin, end or other added tokens.

    Byte-level BPE without a normaliser always splits before a single space between two visible characters; so texts are cut there,
    the pieces of a block of texts are made distinct (by a 64-bit hash, and by their bytes where it is equal), and each is merged once: by
    tiktoken with the ranks of the same file, if its merges are in the order of their ids. Texts that hold a special token's string, and tokenizers of other
    kinds, are encoded whole by the library itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.ranks = None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.library = lambda text: model.encode(text, num_threads=1)
            return
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.library = lambda text: tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        with open(path, encoding="utf-8") as file:
            self._take_ranks(json.load(file))

    def _take_ranks(self, spec: dict) -> None:
        split, added, model = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or [], spec["model"]
        self.special = [t["content"] for t in added]
        odd = any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or " " in t["content"] for t in added)
        plain = not (spec.get("normalizer") or split.get("add_prefix_space") or odd) and split.get("use_regex", True)
        if not plain or model["type"] != "BPE" or split.get("type") != "ByteLevel" or model.get("ignore_merges"):
            return
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        order = [model["vocab"].get(a + b, -1) for a, b in pairs]
        ordinary = {t: i for t, i in model["vocab"].items() if t not in self.special}
        if order != list(range(256, 256 + len(order))) or len(ordinary) != 256 + len(order):
            return
        import tiktoken

        tokens = _token_bytes(ordinary)
        ranks = {b: i for i, b in enumerate(tokens) if b}
        self.lengths = np.array([len(b) for b in tokens])
        self.keys = np.zeros(0, dtype=np.uint64)  # of remembered pieces, sorted; where their ids begin, and how many they are
        self.at, self.long, self.bytes = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint8)  # their bytes
        self.begin, self.sizes, self.store = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype="<u4")
        self.ranks = tiktoken.Encoding("own", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def _ordinary(self, text: str) -> np.ndarray:
        return np.asarray(self.ranks.encode_to_numpy(text, disallowed_special=()), dtype="<u4")

    def ids(self, text: str) -> np.ndarray:
        """The ids of one text."""
        if self.ranks is None or any(s in text for s in self.special):
            return np.array(self.library(text), dtype="<u4")
        return self._ordinary(text)

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, where each row's ids begin, with the end) for runs of rows, in order. Nulls count as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        _, at, data = texts.buffers()
        ends = np.frombuffer(at, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        view = memoryview(data) if data is not None else memoryview(b"")
        row = 0
        while row < len(texts):
            stop = int(np.searchsorted(ends, ends[row] + BLOCK, side="right")) - 1
            stop = max(stop, row + 1)
            block = bytes(view[ends[row] : ends[stop]])
            found = None
            if self.ranks is not None and len(block) <= BLOCK and not any(s.encode() in block for s in self.special):
                found = self._block(block, ends[row : stop + 1] - ends[row])
            if found is None:
                each = [self.ids(texts[i].as_py()) for i in range(row, stop)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
                found = np.concatenate(each), offsets
            yield row, *found
            row = stop

    def _block(self, block: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a block of texts and where each text's begin; None if two of its pieces have one key."""
        data = np.frombuffer(block, dtype=np.uint8)
        if not len(data):
            return np.zeros(0, dtype="<u4"), np.zeros(len(ends), dtype=np.int64)
        visible = (data > 32) & (data != 127)
        for m in _UNICODE_SPACE.finditer(block):
            visible[m.start() : m.end()] = False
        cut = np.zeros(len(data), dtype=bool)
        cut[1:-1] = (data[1:-1] == 32) & visible[:-2] & visible[2:]
        cut[ends[:-1][ends[:-1] < ends[1:]]] = True  # texts that are not empty
        starts = np.flatnonzero(cut)
        stops = np.append(starts[1:], len(data))
        long = stops - starts
        chunks, at, n = _chunks(block, starts, long)
        place = _mixed(np.arange(n.max(), dtype=np.uint64))[np.arange(len(chunks)) - np.repeat(at, n)]
        keys = np.add.reduceat(_mixed(chunks ^ place), at) ^ _mixed(long.astype(np.uint64))
        codes, distinct = pd.factorize(keys)
        first = np.empty(len(distinct), dtype=np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        like = first[codes]
        if (long[like] != long).any() or (chunks[runs(at[like], n)] != chunks).any():
            return None
        ids, begin, sizes = self._look_up(block, data, visible, distinct, starts[first], stops[first])
        own = sizes[codes]
        after = np.cumsum(own)
        out = ids[np.repeat(begin[codes] - (after - own), own) + np.arange(after[-1])]
        counted = np.concatenate([[0], after])
        return out, counted[np.searchsorted(starts, ends)]

    def _look_up(
        self, block: bytes, data: np.ndarray, visible: np.ndarray, keys: np.ndarray, starts: np.ndarray, stops: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A store of ids, and where each key's ids are in it. Merges the pieces that are new and remembers some."""
        at, long = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0)), stops - starts
        taken = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), dtype=bool)
        known = taken.copy()
        known[taken] = self.long[at[taken]] == long[taken]
        own = np.flatnonzero(known)
        if len(own):
            same = self.bytes[runs(self.at[at[own]], long[own])] == data[runs(starts[own], long[own])]
            known[own] = np.logical_and.reduceat(same, np.cumsum(long[own]) - long[own])
        new_ids, new_begin = self._pieces(block, visible, starts[~known], stops[~known])
        begin, sizes = np.empty(len(keys), dtype=np.int64), np.empty(len(keys), dtype=np.int64)
        begin[known], sizes[known] = self.begin[at[known]], self.sizes[at[known]]
        begin[~known], sizes[~known] = len(self.store) + new_begin[:-1], np.diff(new_begin)
        store = np.concatenate([self.store, new_ids])
        kept = ~taken  # one piece for each key
        if len(self.keys) < REMEMBERED and len(self.bytes) + long[kept].sum() < REMEMBERED_BYTES:
            after = len(self.bytes) + np.cumsum(long[kept])
            self.bytes = np.concatenate([self.bytes, data[runs(starts[kept], long[kept])]])
            order = np.argsort(np.concatenate([self.keys, keys[kept]]))
            join = lambda old, new: np.concatenate([old, new])[order]
            self.keys, self.at, self.long = join(self.keys, keys[kept]), join(self.at, after - long[kept]), join(self.long, long[kept])
            self.begin, self.sizes, self.store = join(self.begin, begin[kept]), join(self.sizes, sizes[kept]), store
        return store, begin, sizes

    def _pieces(self, block: bytes, visible: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these pieces and where each one's begin."""
        last = visible[stops - 1]
        joint = last & ~visible[starts] & visible[np.minimum(starts + 1, len(visible) - 1)] & (stops - starts > 1)
        joint &= np.frombuffer(block, dtype=np.uint8)[starts] == 32
        text = b"".join([block[a:b] for a, b in zip(starts[joint].tolist(), stops[joint].tolist(), strict=True)])
        together = self._ordinary(text.decode())
        cuts = np.searchsorted(np.cumsum(self.lengths[together]), np.cumsum((stops - starts)[joint]), side="left") + 1
        sizes = np.zeros(len(starts), dtype=np.int64)
        sizes[joint] = np.diff(cuts, prepend=0)
        alone = {i: self._ordinary(block[starts[i] : stops[i]].decode()) for i in np.flatnonzero(~joint).tolist()}
        for i, x in alone.items():
            sizes[i] = len(x)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        ids = np.empty(begin[-1], dtype="<u4")
        ids[np.repeat(joint, sizes)] = together
        for i, x in alone.items():
            ids[begin[i] : begin[i + 1]] = x
        return ids, begin


def codec(path: str) -> Codec:
    """The worker's codec for this file."""
    state = worker_state().setdefault("codecs", {})
    if path not in state:
        state[path] = Codec(path)
    return state[path]
