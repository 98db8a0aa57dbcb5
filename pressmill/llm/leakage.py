"""Passages of held-out items inside corpus documents.

Q-gram lemma filtering. Every q-gram of every item is indexed; of a document
each STRIDE-th q-gram is looked up, so that a region of L characters with at
most k edits keeps at least floor((L - Q + 1) / STRIDE) - k * ceil(Q / STRIDE)
of them. Hits are counted in overlapping diagonal bands for each document and
item; bands that reach the bound are verified by a banded alignment, and a
passage must hold WORDS whole words in a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.grams import codes, windows
from pressmill.plans.arrow import map_batches

WORDS = 13
Q, STRIDE = 16, 8
#: Characters of items that are indexed and sent to the executors at once; larger sets are taken in blocks.
BLOCK_CHARS = 8_000_000
#: Characters of documents that are hashed at once.
CHUNK = 500_000
_SPACE = ord(" ")


def words_only(text_col) -> F.Column:
    """Lower-cased words with one blank before, between and behind them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text_col), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


class ItemIndex:
    """Q-grams of the items: a bit table for the first look, then hash -> (item, position)."""

    def __init__(self, texts: list[str], words: int, edits: int):
        self.codes = [codes(t) for t in texts]
        self.words, self.edits = words, edits
        hashes, item, pos, self.need = [], [], [], []
        for i, c in enumerate(self.codes):
            h = windows(c, Q)
            hashes.append(h)
            item.append(np.full(len(h), i))
            pos.append(np.arange(len(h)))
            blanks = np.flatnonzero(c == _SPACE)
            shortest = int((blanks[words:] - blanks[:-words]).min()) + 1 if len(blanks) > words else 0
            need = (shortest - Q + 1) // STRIDE - edits * -(-Q // STRIDE) if shortest else 1 << 30
            if need < 1 and edits:
                raise ValueError(f"an item's shortest passage of {words} words has {shortest} characters, too few for {edits} edits: no q-gram would be guaranteed")
            self.need.append(need)
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        self.item = np.concatenate(item)[order] if hashes else np.empty(0, np.int64)
        self.pos = np.concatenate(pos)[order] if hashes else np.empty(0, np.int64)
        bits = max(20, int(max(1, len(h)) * 16).bit_length())
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[h >> self.shift] = True

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, diagonal) of every sampled q-gram that an item holds."""
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(lens) - lens
        many = np.maximum(0, (lens - Q) // STRIDE + 1)
        at = np.repeat(starts, many) + STRIDE * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
        h = windows(codes("".join(texts)), Q)[at] if len(at) else np.empty(0, np.uint64)
        ok = np.flatnonzero(self.seen[h >> self.shift])
        doc, rel, h = np.repeat(np.arange(len(texts)), many)[ok], (at - np.repeat(starts, many))[ok], h[ok]
        a, b = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        n = b - a
        j = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(doc, n), self.item[j], np.repeat(rel, n) - self.pos[j]

    def regions(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text, item, diagonal) of the bands whose count reaches the bound."""
        doc, item, diagonal = self.hits(texts)
        width, out = 2 * self.edits + 2, set()
        for lay in (0, 1):
            band = (diagonal + lay * (width // 2)) // width
            order = np.lexsort((band, item, doc))
            d, i, x = doc[order], item[order], band[order]
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (x[1:] != x[:-1])
            group = np.cumsum(new) - 1
            keep = np.bincount(group)[group] >= np.array(self.need)[i] if len(d) else new
            out.update(zip(d[keep].tolist(), i[keep].tolist(), diagonal[order][keep].tolist()))
        return sorted(out)

    def passages(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text, item, words in a row) of each item that a text holds in part."""
        best: dict[tuple[int, int], int] = {}
        made: tuple[int, np.ndarray] | None = None
        for d, i, diagonal in self.regions(texts):
            if made is None or made[0] != d:
                made = d, codes(texts[d])
            n = self.aligned_words(made[1], self.codes[i], diagonal)
            if n >= self.words and n > best.get((d, i), 0):
                best[d, i] = n
        return [(d, i, n) for (d, i), n in sorted(best.items())]

    def aligned_words(self, doc: np.ndarray, item: np.ndarray, diagonal: int) -> int:
        """Most whole words in a row by banded alignment; without edits the band is one diagonal, its runs of equal letters are compared at once."""
        if self.edits:
            return self._banded(doc, item, diagonal)
        a, b = max(0, diagonal), min(len(doc), len(item) + diagonal)
        same = np.concatenate([[False], doc[a:b] == item[a - diagonal : b - diagonal], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        blank = np.concatenate([[0], np.cumsum(item[a - diagonal : b - diagonal] == _SPACE)])
        return max((int(blank[y] - blank[x]) - 1 for x, y in zip(edge[::2], edge[1::2])), default=0)

    def _banded(self, doc: np.ndarray, item: np.ndarray, diagonal: int) -> int:
        """Banded alignment around the diagonal: for each number of edits the furthest reach from each word start."""
        k, best = self.edits, 0
        blanks = np.flatnonzero(item == _SPACE)
        for s in blanks:
            reach = {0: int(s)}  # shift of the diagonal -> furthest item position
            for e in range(k + 1):
                for d, i in reach.items():
                    j = i + diagonal + d
                    while i < len(item) and 0 <= j < len(doc) and item[i] == doc[j]:
                        i, j = i + 1, j + 1
                    reach[d] = i
                    best = max(best, int(np.searchsorted(blanks, i - 1, "right") - np.searchsorted(blanks, s, "left")) - 1)
                if e < k:
                    nxt: dict[int, int] = {}
                    for d, i in reach.items():
                        for dd, ii in ((d, i + 1), (d + 1, i), (d - 1, i + 1)):
                            if abs(dd) <= k and ii <= len(item):
                                nxt[dd] = max(nxt.get(dd, 0), ii)
                    reach = nxt
        return best


def find_leaks(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", words: int = WORDS, edits: int = 0) -> DataFrame:
    """(doc_id, item_id, words): documents that hold at least ``words`` consecutive words of an item, and the longest such run.

    ``edits``: letters that may differ, be missing or be added within a passage; a ValueError where
    an item is too short for the bound to hold. Null ids, null texts and items of fewer than ``words`` words give no row;
    equal items are each reported, a document row that occurs twice comes out
    twice. The items are a stated query set: they are sent to the executors in
    blocks of at most BLOCK_CHARS characters, and the documents are never shuffled.
    """
    spark = df.sparkSession
    known = items.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(F.col(item_col).alias("i"), words_only(F.col(item_text_col)).alias("t")).distinct()
    src = df.where(F.col(id_col).isNotNull() & (F.length(text_col) >= 2 * words - 1)).select(F.col(id_col).alias("doc_id"), words_only(F.col(text_col)).alias("t"))
    kinds = src.schema["doc_id"].dataType.simpleString(), known.schema["i"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, words int"
    out, block, size = None, [], 0

    def search(rows) -> DataFrame:
        ids = pa.array([r.i for r in rows])
        index = spark.sparkContext.broadcast(ItemIndex([r.t for r in rows], words, edits))

        def make():
            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                doc, item, run = [], [], []
                texts, table = batch.column(1).to_pylist(), index.value
                a = size = 0
                for b, t in enumerate(texts, 1):
                    size += len(t)
                    if size > CHUNK or b == len(texts):
                        for n, i, w in table.passages(texts[a:b]):
                            doc.append(a + n)
                            item.append(i)
                            run.append(w)
                        a, size = b, 0
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc, pa.int32())), ids.take(pa.array(item, pa.int32())), pa.array(run, pa.int32())], ["doc_id", "item_id", "words"])

            return step

        return map_batches(src, make, schema)

    for row in known.toLocalIterator():
        if block and size + len(row.t) > BLOCK_CHARS:
            out = search(block) if out is None else out.unionByName(search(block))
            block, size = [], 0
        block.append(row)
        size += len(row.t)
    if block:
        out = search(block) if out is None else out.unionByName(search(block))
    return out if out is not None else spark.createDataFrame([], schema)
