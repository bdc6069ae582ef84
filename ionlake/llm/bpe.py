"""BPE encoding and decoding with a heap of merge ranks over a doubly linked symbol list.

Reads the public JSON form of a word-end BPE vocabulary: normaliser (NFC, white space to one space, lower case),
a split pattern whose matches are kept, byte symbols, ranked merges, an end-of-word suffix and added special
tokens. No vocabulary is copied here; its path is a parameter.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import heapq
import json
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ionlake.llm.common import map_text

#: Chunks of text remembered by a worker; the memory is emptied when full, so it is bounded on any corpus.
MEMO_ENTRIES = 250_000
#: Longer chunks are encoded each time.
MEMO_CHARS = 64

# A pair of symbols is one integer.
_ID_BITS = 17
#: Up to here the normaliser, lower case and letter classes are taken from Python; chunks with a later character go
#: through the vocabulary file's own normaliser and splitter, as the Unicode version of the libraries may differ.
_COMMON = "\u024f"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte value: printable Latin-1 bytes stand for themselves, the rest follow from 256 up."""
    plain = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBPE:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.names: dict[int, str] = {i: s for s, i in self.vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.suffix = model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_at = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        pairs = (m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"])
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, (a, b) in enumerate(pairs):
            self.ranks[self.vocab[a] << _ID_BITS | self.vocab[b]] = rank
            self.merged.append(self.vocab[a + b])
        symbols = byte_symbols()
        self.byte_values = {s: i for i, s in enumerate(symbols)}
        self.inner = [self.vocab[s] for s in symbols]
        self.final = [self.vocab[s + self.suffix] for s in symbols]
        self.path = path
        self.memo: dict[str, bytes] = {}
        self.word_memo: dict[bytes, array] = {}

    def merge(self, ids: list[int]) -> list[int]:
        """Merge symbols in order of rank, leftmost first; entries whose pair has changed meanwhile are skipped.

        A heap entry is one integer, rank and place of the left symbol. A symbol that was merged away is -1.
        """
        n, rank_of, merged = len(ids), self.ranks.get, self.merged
        shift = 8 if n < 256 else n.bit_length()
        mask = (1 << shift) - 1
        heap, i, a = [], 0, ids[0]
        for b in ids[1:]:
            r = rank_of(a << _ID_BITS | b)
            if r is not None:
                heap.append(r << shift | i)
            a = b
            i += 1
        if not heap:
            return ids
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            top = pop(heap)
            i = top & mask
            a = ids[i]
            if a < 0 or (j := right[i]) >= n:
                continue
            r = rank_of(a << _ID_BITS | ids[j])
            new = merged[top >> shift]
            if r is None or merged[r] != new:
                continue
            ids[i], ids[j] = new, -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                r = rank_of(new << _ID_BITS | ids[k])
                if r is not None:
                    push(heap, r << shift | i)
            h = left[i]
            if h >= 0:
                r = rank_of(ids[h] << _ID_BITS | new)
                if r is not None:
                    push(heap, r << shift | h)
        return [x for x in ids if x >= 0]

    @functools.cached_property
    def _library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _split(self, text: str) -> list[bytes]:
        """Words of a chunk as UTF-8."""
        if text.isascii():
            return [w.encode() for w in self.words.findall(text.lower())]
        if max(text) <= _COMMON:
            return [w.encode() for w in self.words.findall(unicodedata.normalize("NFC", text).lower())]
        t = self._library
        values = self.byte_values
        return [bytes([values[c] for c in w]) for w, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text))]

    def _encode_plain(self, text: str, out: list[int]) -> None:
        inner, memo = self.inner, self.word_memo
        for raw in self._split(text):
            ids = memo.get(raw)
            if ids is None:
                ids = [inner[b] for b in raw]
                ids[-1] = self.final[raw[-1]]
                if len(ids) > 1:
                    ids = self.merge(ids)
                if len(raw) <= MEMO_CHARS:
                    if len(memo) >= MEMO_ENTRIES:
                        memo.clear()
                    memo[raw] = array("H" if max(ids) < 65536 else "I", ids)
            out.extend(ids)

    def encode_chunk(self, chunk: str) -> bytes:
        """Ids of one run of text without white space, as little-endian unsigned 32-bit integers."""
        out: list[int] = []
        if any(t in chunk for t in self.added):
            for part in self.added_at.split(chunk):
                if part in self.added:
                    out.append(self.added[part])
                elif part:
                    self._encode_plain(part, out)
        else:
            self._encode_plain(chunk, out)
        ids = array("I", out)
        return ids.tobytes()

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids of a whole text. White space never joins its neighbours here, so runs between it are encoded alone."""
        if not text:
            return b""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            chunks = regex.split(r"\s+", text)  # str.split also parts at these four separators
        else:
            chunks = text.split()
        memo, made = self.memo, []
        for c in chunks:
            ids = memo.get(c)
            if ids is None:
                ids = self.encode_chunk(c)
                if len(c) <= MEMO_CHARS:
                    if len(memo) >= MEMO_ENTRIES:
                        memo.clear()
                    memo[c] = ids
            made.append(ids)
        return b"".join(made)

    def encode(self, text: str | None) -> list[int]:
        return memoryview(self.encode_bytes(text)).cast("I").tolist()

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings joined by the separator of a file without a decoder, one space; unknown ids vanish."""
        names = self.names
        try:
            return " ".join(map(names.__getitem__, ids))
        except KeyError:
            return " ".join(names[i] for i in ids if i in names)


@functools.cache
def load(path: str) -> WordBPE:
    """One encoder for each worker process and file."""
    gc.set_threshold(200_000, 50, 50)  # the many short lists of the merge loop hold no cycles
    return WordBPE(path)


def _forget(path: str):
    """A function that empties the memory of chunks, so that a worker that waits for other work does not hold it."""

    def run():
        load(path).memo.clear()
        load(path).word_memo.clear()

    return run


def encode(docs: DataFrame, path: str, *carry: str) -> DataFrame:
    """``carry`` columns with ``ids`` array<int> and ``decoded`` of every whole text; null and empty texts give none."""

    def run(texts):
        bpe = load(path)
        ids = [bpe.encode(t) for t in texts]
        return {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array([bpe.decode(x) for x in ids], pa.string())}

    return map_text(docs, run, "ids array<int>, decoded string", *carry, after=_forget(path))


def digests(docs: DataFrame, path: str, *carry: str, ids: bool = False) -> DataFrame:
    """``carry`` columns with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every whole text; ``ids`` too if asked.

    A null or empty text has no tokens and the digests of empty strings. Repeated rows each get a row. Very long
    texts and words take memory in proportion to themselves. An empty table gives an empty table; other columns of
    the input are not read.
    """

    def run(texts):
        bpe = load(path)
        n, a, b, all_ids = [], [], [], []
        for t in texts:
            raw = bpe.encode_bytes(t)
            n.append(len(raw) // 4)
            a.append(hashlib.sha256(raw).hexdigest())
            b.append(hashlib.sha256(bpe.decode(memoryview(raw).cast("I").tolist()).encode()).hexdigest())
            if ids:
                all_ids.append(raw)
        out = {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())}
        if ids:
            ends = pa.array(np.cumsum([0, *n]), pa.int32())
            out["ids"] = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(all_ids), np.int32)))
        return out

    return map_text(docs, run, "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else ""), *carry, after=_forget(path))
