"""Pairs and groups of texts that share most of their pieces.

Positional inverted index with count filtering. The hash of a piece of PIECE
characters names a position and the bytes that stand there; the index leads from
(position, bytes) to the texts that have them. Two texts with n and m distinct pieces
and likeness t share at least t / (1 + t) * (n + m) positional bytes. So, in any one
order of all positional bytes, the first n - t / (1 + t) * (n + m) + T of the one and the
first m - t / (1 + t) * (n + m) + T of the other have T in common: only the first
(1 - t) * n + T of a text are posted, shared ones tallied for each pair, pairs that reach T
retained and verified on all their pieces. The minimum is guaranteed, no pair is missed.

The order is rare first. How many texts have which bytes is counted over all texts in
2^18 to 2^22 counters, more for more texts; any order is right, this one keeps posting
lists short. The index lies in buckets of about BUCKET postings; positional bytes that
many texts have are split over several of them. Postings travel in blocks of FLUSH, so
that a row holds many of them however many buckets there are, and a bucket is tallied
text by text, at most _MET meetings at a time. What a bucket tallied travels in packed
blocks too, each for the texts of one part, and is added up part by part. Copies of a
text are one class: index and verification see one text of each class.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.grams import codes, mix, windows
from pressmill.plans.arrow import map_batches
from pressmill.plans.lineage import cut, cut_table

PIECE = 9
LIKENESS = 0.70
#: Least and most counters of the order, counters for a text, parts they travel in.
SLOTS, MOST_SLOTS, _A_TEXT, _SLICES = 1 << 18, 1 << 22, 32, 256
#: Postings of a bucket; texts with the same positional bytes from which their postings are split.
BUCKET, HOT = 2_000_000, 50_000
#: Pieces of the smaller text for each further posting that a pair must share.
STEP = 48
_CHUNK = 400_000
_BITS = np.uint64(48)  # of a piece's hash; the rest numbers the texts of a chunk
_TIERS = 64  # of a posting's place in the order, told apart; roles beside it
_ONLY_SMALLER, _ONLY_LARGER = 64, 128
_MET = 1_000_000  # meetings of texts held before they are added up
FLUSH = 1_000_000  # postings, or pairs that met, that a task gathers before it writes them by bucket or part
_PART = 250_000  # texts for each further part that a task adds the pairs of up in, 16 at most
_MEMO = 4_000_000  # pieces of texts kept while pairs are verified


def letters_only(text_col) -> F.Column:
    """Lower case, Unicode letters and numbers only."""
    return F.regexp_replace(F.lower(text_col), r"[^\p{L}\p{N}]+", "")


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about _CHUNK characters in all."""
    a = size = 0
    for b, t in enumerate(texts, 1):
        size += len(t)
        if size > _CHUNK or b == len(texts) or b - a == 60_000:
            yield a, b
            a, size = b, 0


def sorted_distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def distinct_pieces(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, positional bytes) of the distinct pieces, in order of the texts."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    h = windows(codes("".join(texts)), PIECE)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), lens)[: len(h)]
    inside = np.arange(len(h)) + PIECE <= np.repeat(np.cumsum(lens), lens)[: len(h)]
    both = sorted_distinct(doc[inside] << _BITS | h[inside] >> (np.uint64(64) - _BITS))
    return (both >> _BITS).astype(np.int64), both & ((np.uint64(1) << _BITS) - np.uint64(1))


def slots_for(texts: int) -> int:
    return min(MOST_SLOTS, max(SLOTS, 1 << (_A_TEXT * texts).bit_length()))


def _slot(pieces: np.ndarray, slots: int) -> np.ndarray:
    return (pieces & np.uint64(slots - 1)).astype(np.int64)


def _census(reps: DataFrame, slots: int = SLOTS) -> np.ndarray:
    """How many texts have bytes of each slot; packed slices of counters are added up in Spark, ``slots`` numbers reach the driver."""
    size = slots // _SLICES

    def packed(slices: list[int], counts: Iterable[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array([_squeeze(_planes(c.astype("<i8"))) for c in counts], pa.binary())], ["slice", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, met = np.zeros(slots, np.int64), [], 0
        for b in batches:
            texts = b.column(0).to_pylist()
            for a, z in chunks(texts):
                held.append(_slot(distinct_pieces(texts[a:z])[1], slots))
                met += len(held[-1])
                if met >= slots:
                    total += np.bincount(np.concatenate(held), minlength=slots)
                    held, met = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=slots)
        yield packed(list(range(_SLICES)), total.reshape(_SLICES, size))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1)):
                sums[k] = sums.get(k, 0) + _numbers(_loosen(c.as_buffer()), "<i8", size)
        yield packed(list(sums), sums.values())

    kind = "slice int, counts binary"
    total = np.zeros(slots, np.int64)
    for r in reps.select("t").mapInArrow(count, kind).repartition("slice").mapInArrow(add, kind).collect():
        total[r["slice"] * size : (r["slice"] + 1) * size] = _numbers(_loosen(r["counts"]), "<i8", size)
    return total


def tally_least(n: int | np.ndarray):
    """Postings that a pair shares at least, by the pieces of its smaller text."""
    return 1 + n // STEP


def bucket_least(n: int | np.ndarray, buckets: int):
    """Of the postings that a pair shares, one bucket of ``buckets`` at least holds so many."""
    return -(-tally_least(n) // buckets)


def posted(n: np.ndarray, least: float) -> np.ndarray:
    """How many of a text's positional bytes are posted, the rarest first."""
    t = Fraction(least).limit_denominator(10**6)
    return np.minimum(n - (-(-n * t.numerator // t.denominator)) + tally_least(n), n)


def _planes(x: np.ndarray) -> bytes:
    """First bytes of all numbers, then the second ones and so on; high ones are mostly zero and cost nothing when compressed."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _numbers(raw: memoryview, kind: str, count: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(-1, count).T).reshape(-1).view(kind)


def _squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _loosen(raw) -> memoryview:
    raw = memoryview(raw)
    return memoryview(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd"))


def _pack(no: np.ndarray, n: np.ndarray, posts: np.ndarray, key: np.ndarray, tier: np.ndarray) -> bytes:
    """A block of postings: of its texts the number, pieces and postings, then the postings text by text."""
    head = np.array([len(no), len(key)], "<u4").tobytes()
    return _squeeze(b"".join([head, _planes(np.diff(no, prepend=0).astype("<i8")), _planes(n.astype("<u4")), _planes(posts.astype("<u4")), key.astype("<u4").tobytes(), tier.tobytes()]))


def _unpack(raw: memoryview) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = _loosen(raw)
    m, p = np.frombuffer(raw[:8], "<u4").tolist()
    ends = np.cumsum([8, 8 * m, 4 * m, 4 * m, 4 * p, p]).tolist()
    no, n, posts = (_numbers(raw[a:z], kind, m).astype(np.int64) for a, z, kind in zip(ends, ends[1:4], ("<i8", "<u4", "<u4")))
    return np.cumsum(no), n, posts, np.frombuffer(raw[ends[3] : ends[4]], "<u4"), np.frombuffer(raw[ends[4] : ends[5]], np.uint8)


def _pack_pairs(a: np.ndarray, b: np.ndarray, need: np.ndarray, shared: np.ndarray) -> bytes:
    """A block of pairs that met: numbers of the smaller texts in their order and of the larger ones, postings needed and shared."""
    return _squeeze(b"".join([_planes(np.diff(a, prepend=0).astype("<i8")), _planes(b.astype("<i8")), _planes(need.astype("<u4")), _planes(shared.astype("<u4"))]))


def _unpack_pairs(raw: memoryview) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = _loosen(raw)
    p = len(raw) // 24
    a, b, need, shared = (_numbers(raw[x * p : z * p], kind, p).astype(np.int64) for x, z, kind in ((0, 8, "<i8"), (8, 16, "<i8"), (16, 20, "<u4"), (20, 24, "<u4")))
    return np.cumsum(a), b, need, shared


def _postings(reps: DataFrame, least: float, counts: np.ndarray, hot: int, buckets: int, flush: int = FLUSH) -> DataFrame:
    """(bucket, block): the rarest positional bytes of each text with their tier in its order, by bucket; a row holds those of many texts."""
    spread = np.minimum(1 + np.maximum(0, counts - 2 * int(np.median(counts))) // hot, buckets)
    rank = np.minimum(255, np.log2(1 + counts) * 6).astype(np.uint8)
    shared = reps.sparkSession.sparkContext.broadcast((rank, spread.astype(np.int32) if (spread > 1).any() else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, spread = shared.value

        def post(texts: list[str]) -> tuple[np.ndarray, ...]:
            """(n) of the texts and (text, bucket, key, tier) of their postings."""
            doc, piece = distinct_pieces(texts)
            n = np.bincount(doc, minlength=len(texts))
            # rare first, a number below the piece's slot, then the piece
            order = np.lexsort((rank[_slot(piece, len(rank))].astype(np.uint64) << _BITS | piece, doc)) if len(piece) else np.empty(0, np.int64)
            at = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
            keep = at < np.repeat(posted(n, least), n)
            take, of = order[keep], doc[keep]
            key, tier = piece[take], (at[keep] * _TIERS // n[of]).astype(np.uint8)
            home = (mix(key) >> np.uint64(33)) % np.uint64(buckets)
            if spread is not None and (many := spread[_slot(key, len(rank))]).max(initial=1) > 1:
                # a frequent one: as that of the larger text in one bucket of several, as that of the smaller in each of them
                own = (key + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                split = many > 1
                again = np.repeat(np.flatnonzero(split), many[split])
                turn = np.arange(len(again)) - np.repeat(np.cumsum(many[split]) - many[split], many[split])
                place = np.where(split, (home + own % many.astype(np.uint64)) % np.uint64(buckets), home)
                tier = np.where(split, tier | _ONLY_LARGER, tier)
                home = np.concatenate([place, (home[again] + turn.astype(np.uint64)) % np.uint64(buckets)])
                tier = np.concatenate([tier, tier[again] & (_TIERS - 1) | _ONLY_SMALLER]).astype(np.uint8)
                key, of = np.concatenate([key, key[again]]), np.concatenate([of, of[again]])
            # what tells bytes apart in a bucket: equal bytes have equal keys, others nearly never, and a pair is verified on all its pieces
            return n, of, home.astype(np.int32), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), tier

        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def blocks() -> pa.RecordBatch:
            begin = np.cumsum([0, *(len(x[0]) for x in held)])
            no, n, of = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), np.concatenate([x[2] + b for x, b in zip(held, begin)])
            home, key, tier = (np.concatenate([x[k] for x in held]) for k in (3, 4, 5))
            s = np.argsort(home.astype(np.int64) * len(n) + of)
            home, of, key, tier = home[s], of[s], key[s], tier[s]
            first = np.flatnonzero(np.r_[True, home[1:] != home[:-1]])
            rows = []
            for a, z in zip(first.tolist(), [*first[1:].tolist(), len(home)]):
                at = np.flatnonzero(np.r_[True, of[a + 1 : z] != of[a : z - 1]])
                text = of[a:z][at]
                rows.append(_pack(no[text], n[text], np.diff(np.r_[at, z - a]), key[a:z], tier[a:z]))
            return pa.RecordBatch.from_arrays([pa.array(home[first], pa.int32()), pa.array(rows, pa.binary())], ["bucket", "block"])

        for batch in batches:
            nos, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, z in chunks(texts):
                held.append((nos[a:z], *post(texts[a:z])))
                size += len(held[-1][2])
                if size >= flush:
                    yield blocks()
                    held, size = [], 0
        if size:
            yield blocks()

    return reps.select("no", "t").mapInArrow(run, "bucket int, block binary")


def meetings(key: np.ndarray, tier: np.ndarray, text: np.ndarray, n: np.ndarray, order: np.ndarray, least: float, most: int = _MET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(smaller, larger text) for each posting that two texts share and may count by its place in both; ``order`` ranks texts by n.

    They come smaller text by smaller text, about ``most`` at a time: those of one text may go on in the next part.
    """
    size, share, low = len(n), least / (1 + least), np.uint64(32)
    code = key.astype(np.uint64) << low | order[text].astype(np.uint64)
    s = np.argsort(code)
    code, tier, text = code[s], tier[s], text[s]
    larger, smaller = np.flatnonzero(tier & _ONLY_SMALLER == 0), np.flatnonzero(tier & _ONLY_LARGER == 0)
    reach = np.searchsorted(least * n[np.argsort(order)], n, "right")  # texts up to there in the order are not too large for a smaller one
    begin = np.searchsorted(code[larger], code[smaller], "right")
    found = np.searchsorted(code[larger], code[smaller] >> low << low | reach[text[smaller]].astype(np.uint64), "left") - begin
    some = np.flatnonzero(found > 0)
    some = some[np.argsort(text[smaller[some]], kind="stable")]
    smaller, begin, found = smaller[some], begin[some], found[some]
    ends = np.cumsum(found)
    a = 0
    while a < len(smaller):
        z = max(a + 1, int(np.searchsorted(ends, ends[a] - found[a] + most, "right")))
        c = found[a:z]
        i = np.repeat(smaller[a:z], c)
        j = larger[np.repeat(begin[a:z] - (np.cumsum(c) - c), c) + np.arange(len(i))]
        x, y = text[i], text[j]
        bound = tally_least(n[x]) - share * (n[x] + n[y]) + 1
        ok = ((tier[i] & (_TIERS - 1)) / _TIERS * n[x] < n[x] + bound) & ((tier[j] & (_TIERS - 1)) / _TIERS * n[y] < n[y] + bound)
        yield x[ok], y[ok]
        a = z


def tallied(met: Iterator[tuple[np.ndarray, np.ndarray]], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(smaller, larger text, shared postings) of all pairs that meet; only one text's pairs are held over from part to part."""
    kept, shared = np.empty(0, np.int64), np.empty(0, np.int64)
    for a, b in met:
        if not len(a):
            continue
        pairs, counts = np.unique(a * size + b, return_counts=True)
        if len(kept) and kept[0] // size == pairs[0] // size:
            pairs, at = np.unique(np.concatenate([kept, pairs]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([shared, counts])).astype(np.int64)
        elif len(kept):
            yield kept // size, kept % size, shared
        z = int(np.searchsorted(pairs, pairs[-1] // size * size))
        kept, shared = pairs[z:], counts[z:]
        if z:
            yield pairs[:z] // size, pairs[:z] % size, counts[:z]
    if len(kept):
        yield kept // size, kept % size, shared


def _met(postings: DataFrame, least: float, buckets: int, parts: int, flush: int = FLUSH) -> DataFrame:
    """(part, block): the pairs that met in a bucket as often as they have to, by the part of the smaller text; a row holds many."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [_unpack(memoryview(raw.as_buffer())) for b in batches for raw in b.column(0)]
        if not blocks:
            return
        no, text = np.unique(np.concatenate([x[0] for x in blocks]), return_inverse=True)
        n = np.zeros(len(no), np.int64)
        n[text] = np.concatenate([x[1] for x in blocks])
        text = np.repeat(text, np.concatenate([x[2] for x in blocks]))
        key, tier = np.concatenate([x[3] for x in blocks]), np.concatenate([x[4] for x in blocks])
        del blocks
        order = np.empty(len(n), np.int64)
        order[np.lexsort((no, n))] = np.arange(len(n))
        home = (mix(no.astype(np.uint64)) % np.uint64(parts)).astype(np.int32)
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def packed() -> pa.RecordBatch:
            a, b, shared = (np.concatenate([x[k] for x in held]) for k in range(3))
            s = np.argsort(home[a], kind="stable")
            a, b, shared = a[s], b[s], shared[s]
            part = home[a]
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            rows = [_pack_pairs(no[a[x:z]], no[b[x:z]], tally_least(n[a[x:z]]), shared[x:z]) for x, z in zip(first.tolist(), [*first[1:].tolist(), len(a)])]
            return pa.RecordBatch.from_arrays([pa.array(part[first], pa.int32()), pa.array(rows, pa.binary())], ["part", "block"])

        for a, b, shared in tallied(meetings(key, tier, text, n, order, least), len(n)):
            enough = shared >= bucket_least(n[a], buckets)
            held.append((a[enough].astype(np.int32), b[enough].astype(np.int32), shared[enough].astype(np.int32)))
            size += len(held[-1][0])
            if size >= flush:
                yield packed()
                held, size = [], 0
        if size:
            yield packed()

    return postings.repartitionById(buckets, "bucket").select("block").mapInArrow(meet, "part int, block binary")


def _tally(postings: DataFrame, least: float, buckets: int, texts: int) -> DataFrame:
    """(a, b): numbers of the pairs that share the guaranteed number of postings; a is the text with fewer pieces."""
    tasks = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def reached(blocks: list[pa.Scalar]) -> pa.RecordBatch:
        a, b, need, shared = (np.concatenate(x) for x in zip(*(_unpack_pairs(memoryview(raw.as_buffer())) for raw in blocks)))
        s = np.lexsort((b, a))
        a, b = a[s], b[s]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        seen, shared, need = np.diff(np.r_[first, len(a)]), np.add.reduceat(shared[s], first), need[s][first]
        # a bucket that kept silent about a pair holds less than its least
        enough = shared + (buckets - seen) * (-(-need // buckets) - 1) >= need
        return pa.RecordBatch.from_arrays([pa.array(a[first][enough]), pa.array(b[first][enough])], ["a", "b"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                if part != at and held:
                    yield reached(held)
                    held = []
                at = part
                held.append(raw)
        if held:
            yield reached(held)

    return _met(postings, least, buckets, tasks * min(16, 1 + texts // _PART)).repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(add, "a bigint, b bigint")


def _verify(pairs: DataFrame, kind: str, least: float) -> DataFrame:
    def make():
        memo: dict[str, np.ndarray] = {}
        held = 0

        def pieces(t: str) -> np.ndarray:
            nonlocal held
            if t not in memo:
                if held > _MEMO:
                    memo.clear()
                    held = 0
                memo[t] = sorted_distinct(windows(codes(t), PIECE))
                held += len(memo[t])
            return memo[t]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            like = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = pieces(x), pieces(y)
                both = len(np.intersect1d(a, b, assume_unique=True))
                like.append(both / (len(a) + len(b) - both))
            keep = np.array(like) >= least
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(like, pa.float64())], ["a", "b", "likeness"]).filter(pa.array(keep))

        return step

    return map_batches(pairs, make, f"a {kind}, b {kind}, likeness double")


def near_duplicates(df: DataFrame, id_col: str = "art_id", text_col: str = "art_text", least: float = LIKENESS, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(links between classes: a, b, likeness) and (membership: id, rep).

    A class holds the texts that are equal once reduced to letters and numbers;
    its representative is the least id. Rows with a null id, a null text or fewer
    than PIECE letters and numbers belong to no class. A row that occurs twice counts
    once; of several texts under one id the one with the least digest counts. All pairs
    of classes with likeness ``least`` (above 0) come out.
    """
    rows = df.where(F.col(id_col).isNotNull() & (F.length(text_col) >= PIECE)).select(F.col(id_col).alias("id"), letters_only(F.col(text_col)).alias("t")).where(F.length("t") >= PIECE)
    rows = rows.withColumn("print", F.md5("t"))
    kind = rows.schema["id"].dataType.simpleString()
    one = cut(rows.groupBy("id").agg(F.min("print").alias("print")))
    classes = one.groupBy("print").agg(F.min("id").alias("rep"))
    member = one.join(classes, "print").select("id", "rep")
    # map-side, copies of a text leave a task once
    reps = cut_table(rows.groupBy("print").agg(F.min("t").alias("t")).join(classes.hint("merge"), "print").select("rep", "t").withColumn("no", F.monotonically_increasing_id()))
    texts = reps.count()
    counts = _census(reps, slots_for(texts))
    buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(counts.sum() * (1 - least)) // BUCKET))
    tally = cut(_tally(_postings(reps, least, counts, hot, buckets), least, buckets, texts))
    wanted = tally.select(F.explode(F.array("a", "b")).alias("no")).distinct()
    needed = reps.join(wanted.hint("merge"), "no", "left_semi")
    ends = [needed.select(F.col("no").alias(x), F.col("rep").alias(f"r{x}"), F.col("t").alias(f"t{x}")) for x in ("a", "b")]
    pairs = tally.join(ends[0].hint("merge"), "a").join(ends[1].hint("merge"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"), "ta", "tb")
    links = _verify(pairs, kind, least).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness")
    return cut(links), member


def expand(links: DataFrame, member: DataFrame) -> DataFrame:
    """(a, b, smaller first): every pair of rows that the links and classes stand for."""
    ma, mb = member.select(F.col("id").alias("x"), F.col("rep").alias("a")), member.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    across = links.select("a", "b").join(ma, "a").join(mb, "b").select("x", "y")
    copies = ma.join(mb.withColumnRenamed("b", "a"), "a").where(F.col("x") < F.col("y")).select("x", "y")
    return across.unionByName(copies).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def duplicate_groups(links: DataFrame, member: DataFrame, rounds: int = 64) -> DataFrame:
    """(id, group_id, links): connected groups; ``group_id`` is the least id in the group, ``links`` the links of the row's class.

    Labels spread along the links with pointer jumping, each round cut to the
    shared folder, until none changes. Nothing is collected but the number of changes.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    degree = both.groupBy("a").agg(F.count("*").alias("links"))
    label = cut(both.select(F.col("a").alias("rep")).distinct().withColumn("g", F.col("rep")))
    for _ in range(rounds):
        near = both.join(label.select(F.col("rep").alias("b"), "g"), "b").groupBy("a").agg(F.min("g").alias("m"))
        new = label.join(near, label["rep"] == near["a"], "left").select("rep", F.col("g").alias("old"), F.least("g", F.coalesce("m", "g")).alias("g"))
        hop = new.select(F.col("rep").alias("g"), F.col("g").alias("gg"))
        new = cut(new.join(hop, "g", "left").select("rep", "old", F.coalesce("gg", "g").alias("g")))
        moved = new.where(F.col("old") != F.col("g")).limit(1).count()
        label = new.select("rep", "g")
        if not moved:
            break
    else:
        raise RuntimeError("groups did not settle; allow more rounds")
    return member.join(label, "rep", "left").join(degree.withColumnRenamed("a", "rep"), "rep", "left").select("id", F.coalesce("g", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
