"""Encoding of texts with a public byte-level BPE vocabulary.

Two tiers. A minimal perfect hash over the vocabulary resolves every pre-token
that is itself an entry. The rest is merged with a heap over linked bytes: the
pair of neighbours with the lowest rank is joined first, the leftmost of equals.
"""

from __future__ import annotations

import base64
import heapq
import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.plans.arrow import map_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published splitting rule of the vocabulary (fixed value).
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same in Java's words, whose \\s alone knows only ASCII.
JAVA_SPLIT = SPLIT.replace(r"[^\s\p{L}\p{N}]", r"[^\p{IsWhite_Space}\p{L}\p{N}]").replace(r"\s", r"\p{IsWhite_Space}").replace(r"\S", r"\P{IsWhite_Space}")
#: Pre-tokens remembered by a worker; beyond that it forgets all and starts again, the ids are the same.
REMEMBERED = 1 << 18
_MASK = (1 << 64) - 1


def _mix(h: int, d: int) -> int:
    x = (h ^ (d * 0x9E3779B97F4A7C15)) & _MASK
    x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & _MASK
    return x ^ (x >> 32)


class PerfectHash:
    """Minimal perfect hash of byte strings: n keys, n slots, one displacement a bucket."""

    def __init__(self, keys: list[bytes], values: list[int]):
        n = self.n = max(1, len(keys))
        buckets: list[list[int]] = [[] for _ in range(n)]
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            buckets[h % n].append(i)
        disp, slot_of, taken = np.zeros(n, np.int64), [-1] * len(keys), bytearray(n)
        order = sorted((b for b in range(n) if buckets[b]), key=lambda b: -len(buckets[b]))
        free = None
        for b in order:
            members = buckets[b]
            if len(members) == 1:
                if free is None:
                    free = iter([s for s in range(n) if not taken[s]])
                s = next(free)
                disp[b], slot_of[members[0]] = -s - 1, s
                continue
            d = 1
            while True:
                slots = [_mix(hashes[i], d) % n for i in members]
                if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                    break
                d += 1
            disp[b] = d
            for i, s in zip(members, slots):
                taken[s], slot_of[i] = 1, s
        self.disp = disp.tolist()
        self.keys: list[bytes] = [b""] * n
        self.values = [-1] * n
        for i, s in enumerate(slot_of):
            self.keys[s], self.values[s] = keys[i], values[i]

    def get(self, key: bytes) -> int:
        """The key's value, or -1 of a stranger."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.disp[h % self.n]
        s = -d - 1 if d < 0 else _mix(h, d) % self.n
        return self.values[s] if self.keys[s] == key else -1

    def rank(self, key: bytes) -> int | None:
        """The key's value for the pairs of the second tier, or None."""
        v = self.get(key)
        return v if v >= 0 else None


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


class Encoder(dict):
    """Memo from pre-token to ids; a missing one is worked out by the two tiers."""

    def __init__(self, table: PerfectHash):
        super().__init__()
        self.table = table
        self.split = regex.compile(SPLIT).findall

    def __missing__(self, piece: str) -> array:
        raw = piece.encode("utf-8", "replace")
        whole = self.table.get(raw)
        ids = array("i", [whole]) if whole >= 0 else self.merge(raw)
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = ids
        return ids

    def merge(self, raw: bytes) -> array:
        n, get = len(raw), self.table.rank
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        part: list[bytes | None] = [raw[i : i + 1] for i in range(n)]
        heap = [(r, i, 2) for i in range(n - 1) if (r := get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            a, j = part[i], right[i]
            if a is None or j < 0 or len(a) + len(part[j]) != size:  # joined otherwise in the meantime
                continue
            part[i], part[j] = a + part[j], None
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if (r := get(part[i] + part[k])) is not None:
                    heapq.heappush(heap, (r, i, len(part[i]) + len(part[k])))
            h = left[i]
            if h >= 0 and (r := get(part[h] + part[i])) is not None:
                heapq.heappush(heap, (r, h, len(part[h]) + len(part[i])))
        return array("i", [get(p) for p in part if p is not None])

    def encode(self, text: str | None) -> array:
        out = array("i")
        for piece in self.split(text or ""):
            out.extend(self[piece])
        return out


@lru_cache(maxsize=4)
def _table(path: str, _changed: float) -> PerfectHash:
    ranks = read_ranks(path)
    return PerfectHash(list(ranks), list(ranks.values()))


def load_table(path: str = VOCABULARY) -> PerfectHash:
    return _table(path, os.path.getmtime(path))


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids) of every row, without special tokens; their strings in a text are ordinary text.

    An empty and a null text give an empty list; a null id stays null; rows that
    occur twice come out twice; other columns are left out. No shuffle. The
    hash table that is broadcast has the size of the vocabulary, whatever the data.
    """
    spark = df.sparkSession
    table = spark.sparkContext.broadcast(load_table(vocabulary))
    pieces = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(JAVA_SPLIT), F.lit(0))
    src = df.select(F.col(id_col).alias("doc_id"), pieces.alias("pieces"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def make():
        enc = Encoder(table.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = batch.column(1)
            ends = lists.offsets.to_numpy().astype(np.int64)
            coded = lists.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
            ends -= ends[0]
            known = [enc[p] for p in coded.dictionary.to_pylist()]
            size = np.fromiter(map(len, known), np.int64, len(known))
            flat = np.fromiter((i for k in known for i in k), np.int32, int(size.sum()))
            at = coded.indices.to_numpy()
            take = size[at] if len(at) else np.empty(0, np.int64)
            out_ends = np.concatenate([[0], np.cumsum(take)])
            begin = (np.cumsum(size) - size)[at] if len(at) else take
            ids = flat[np.repeat(begin - out_ends[:-1], take) + np.arange(out_ends[-1])]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(out_ends[ends], pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

        return step

    return map_batches(src, make, f"doc_id {kind}, ids array<int>")
