"""Token counts of whole documents by overlap resynchronisation.

A text longer than a chunk is encoded in overlapping chunks. Two neighbours are spliced at a token that both have
with the same id at the same place. That is exact: any run of tokens of a greedy best-first merge encoding is the
encoding of its own text, and two runs that share a token join into one, as each boundary lies inside a run that
has it with both its neighbours. A merge across a boundary would have happened in that run as well. What the cut of
a chunk disturbs lies outside the spliced runs. Where the overlap has no common token, it is widened, up to
encoding the previous chunk again as a part of the next.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionlake.llm.common import map_text

CHUNK_CHARS, OVERLAP_CHARS = 32_768, 128


class Resync:
    """Counts the tokens of a sentencepiece model without encoding a huge text at once."""

    def __init__(self, path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        n = self.sp.vocab_size()
        # Characters that a piece covers. Of a character's bytes, only the first counts.
        self.width = np.zeros(n, np.int64)
        self.whole = np.zeros(n, bool)
        for i in range(n):
            if self.sp.is_byte(i):
                self.width[i] = (int(self.sp.id_to_piece(i)[1:-1], 16) & 0xC0) != 0x80
            elif not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i)):
                self.width[i], self.whole[i] = len(self.sp.id_to_piece(i)), True

    def spans(self, text: str, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk and where each begins; the space that the model puts in front begins before the chunk."""
        ids = np.asarray(self.sp.encode(text), np.int64)
        width = self.width[ids]
        return ids, at - 1 + np.cumsum(width) - width

    def ids(self, text: str) -> np.ndarray:
        """All ids of a text."""
        size = len(text)
        # Encoded chunks: begin, end, ids, places, first token used, last token used.
        chunks = [[0, min(size, self.chunk), *self.spans(text[: self.chunk], 0), 0, None]]
        while chunks[-1][1] < size:
            last, upto, overlap = chunks[-1], min(size, chunks[-1][1] + self.chunk), self.overlap
            while True:
                begin = max(last[0], last[1] - overlap)
                new = [begin, upto, *self.spans(text[begin:upto], begin), 0, None]
                if begin == last[0]:  # all of the last chunk is encoded again: it goes, and the one before must align
                    chunks.pop()
                    if not chunks:
                        break
                    last = chunks[-1]
                    overlap = last[1] - begin
                if self.splice(last, new):
                    break
                overlap *= 2
            chunks.append(new)
        return np.concatenate([c[2][c[4] : None if c[5] is None else c[5] + 1] for c in chunks])

    def splice(self, a: list, b: list) -> bool:
        """Join ``b`` to ``a`` at a shared token near the middle of what they share; False if there is none."""
        n = len(self.width)
        first = max(a[4], int(np.searchsorted(a[3], b[0])))
        x, y = a[2][first:], b[2][: int(np.searchsorted(b[3], a[1]))]
        left = np.where(self.whole[x], a[3][first:] * n + x, -1)
        right = np.where(self.whole[y], b[3][: len(y)] * n + y, -2)
        both, i, j = np.intersect1d(left, right, return_indices=True)
        if not len(both):
            return False
        a[5], b[4] = first + int(i[len(both) // 2]), int(j[len(both) // 2]) + 1
        return True


@functools.cache
def load(path: str, chunk: int, overlap: int) -> Resync:
    return Resync(path, chunk, overlap)


def count_tokens(docs: DataFrame, path: str, *carry: str, limit: int = 4096, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """``carry`` columns with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of whole texts.

    A null text counts as empty: no bytes, no tokens. Repeated rows each get a row; an empty table gives an empty
    one; other columns are not read. A text of any length is encoded a chunk at a time.
    """

    def run(texts):
        r = load(path, chunk, overlap)
        short = [i for i, t in enumerate(texts) if t and len(t) <= chunk]
        n = [0] * len(texts)
        for i in short:
            n[i] = len(r.sp.encode(texts[i]))
        for i, t in enumerate(texts):
            if t and len(t) > chunk:
                n[i] = len(r.ids(t))
        size = [len(t.encode()) if t else 0 for t in texts]
        return {"n_bytes": pa.array(size, pa.int64()), "n_tokens": pa.array(n, pa.int64())}

    out = map_text(docs, run, "n_bytes long, n_tokens long", *carry)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
