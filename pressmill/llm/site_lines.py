"""Lines that a source prints into its documents again and again.

The lines of a document become line identifiers. A suffix array over the
identifiers of a source brings equal runs of lines together: suffixes are sorted by
Spark's spilling sort and read as a stream, neighbours compared, and the intervals of
suffixes with a common prefix that enough documents hold are the repeated blocks.
Their lines are deleted from each document.

The array is built in parts that no task holds as a whole: a part holds the suffixes of
a source that begin with the same line and, where there are many documents, have the same
salt of the document. A document lies in one salt, so the counts of the parts add up.
Suffixes are told apart by DEPTH lines: a longer block is covered by the repeated blocks
of that length that begin at each of its lines.

``repeated_blocks`` gives the longest blocks, of any length. It doubles the prefix by which
suffixes are ranked: names of runs of 1, 2, 4, ... lines are made of two names of half
the length, as long as enough documents hold them; the longest run from each line is then
sought between two such lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.plans.arrow import map_batches
from pressmill.plans.lineage import cut

LETTERS = 8
DOCUMENTS = 5
#: Lines by which suffixes are sorted.
DEPTH = 4
#: Documents for each further salt.
SALTED = 100_000


def _lines(df: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(id, source, ord, line_no from 1, line): identifiers of the lines with enough letters; ``ord`` counts those only."""
    rows = F.transform(F.split(text_col, "\n"), lambda x, i: F.struct((i + 1).alias("line_no"), F.regexp_replace(F.lower(x), r"\P{L}+", "").alias("key")))
    return (
        df.where(F.col(id_col).isNotNull() & F.col(source_col).isNotNull() & F.col(text_col).isNotNull())
        .select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.posexplode(F.filter(rows, lambda x: F.length(x["key"]) >= LETTERS)).alias("ord", "x"))
        .select("id", "source", "ord", "x.line_no", F.xxhash64("x.key", F.length("x.key")).alias("line"))
    )


def _suffixes(df: DataFrame, id_col: str, source_col: str, text_col: str, salts: int) -> DataFrame:
    """(source, salt, id, nos, suffix): one row for each line of a document row, with DEPTH lines from there and their numbers."""
    rows = F.transform(F.split(text_col, "\n"), lambda x: F.regexp_replace(F.lower(x), r"\P{L}+", ""))
    runs = df.where(F.col(id_col).isNotNull() & F.col(source_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(source_col).alias("source"), F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int").alias("salt"), F.col(id_col).alias("id"), F.transform(rows, lambda k: F.when(F.length(k) >= LETTERS, F.xxhash64(k, F.length(k)))).alias("run")
    )
    kind = runs.schema["id"].dataType.simpleString()

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            row, nos, suffixes = [], [], []
            for k, run in enumerate(batch.column(3).to_pylist()):
                at = [n for n, x in enumerate(run, 1) if x is not None]
                ids = [run[n - 1] for n in at]
                row += [k] * len(at)
                nos += [at[i : i + DEPTH] for i in range(len(at))]
                suffixes += [ids[i : i + DEPTH] for i in range(len(at))]
            take = pa.array(row, pa.int32())
            return pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in range(3)), pa.array(nos, pa.list_(pa.int32())), pa.array(suffixes, pa.list_(pa.int64()))], ["source", "salt", "id", "nos", "suffix"])

        return step

    return map_batches(runs, make, f"source string, salt int, id {kind}, nos array<int>, suffix array<bigint>")


def _prefixes() -> F.Column:
    """Names of the first 1, 2, ... lines of a suffix."""
    return F.transform("suffix", lambda _, i: F.xxhash64(F.slice("suffix", F.lit(1), i + 1)))


def _intervals(suffixes: DataFrame, least: int) -> DataFrame:
    """(source, size, block, docs): the intervals of the sorted suffixes of each part with ``size`` lines in common that at least ``least`` documents hold."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, out = None, [], []
        opened: list[tuple[int, set]] = []  # of 1, 2, ... lines: the block and its documents

        def close(common: int) -> None:
            for size in range(len(opened), common, -1):
                block, docs = opened.pop()
                if len(docs) >= least:
                    out.append((part[0], size, block, len(docs)))

        def flush() -> pa.RecordBatch:
            columns = [pa.array(x, kind) for x, kind in zip(zip(*out), (pa.string(), pa.int32(), pa.int64(), pa.int64()))]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["source", "size", "block", "docs"])

        for b in batches:
            for source, salt, suffix, prefixes, doc in zip(*(b.column(i).to_pylist() for i in range(5))):
                common = 0
                if part == (source, salt):
                    for x, y in zip(suffix, last):
                        if x != y:
                            break
                        common += 1
                close(common)
                part, last = (source, salt), suffix
                opened += [(x, set()) for x in prefixes[len(opened) :]]
                for _, docs in opened:
                    docs.add(doc)
            if out:
                yield flush()
        close(0)
        if out:
            yield flush()

    first = F.col("suffix")[0]
    array = suffixes.repartition("source", first, "salt").sortWithinPartitions("source", "salt", "suffix", "id")
    return array.select("source", "salt", "suffix", _prefixes(), "id").mapInArrow(stream, "source string, size int, block bigint, docs bigint")


def repeated_lines(df: DataFrame, id_col: str = "art_id", source_col: str = "art_source", text_col: str = "art_text", documents: int = DOCUMENTS) -> DataFrame:
    """(id, line_no): the lines that a repeated block covers, to be removed.

    Lines stand between line feeds and count from 1; they are the same if their
    letters are, lower-cased. Lines with fewer than LETTERS letters and rows with a null
    id, source or text do not count. A document counts once for a block, however
    often it or its row holds it.
    """
    salts = 1 + df.count() // SALTED
    suffixes = cut(_suffixes(df, id_col, source_col, text_col, salts))
    # a part with all documents of a source decides by itself, others add up
    blocks = _intervals(suffixes, documents if salts == 1 else 1).groupBy("source", "size", "block").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= documents)
    if salts > 1:
        blocks = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = ["source", "size", "block", *(["salt"] if salts > 1 else [])]
    # the beginnings of a repeated block are repeated, so each answers for its last line
    lines = suffixes.select("source", "salt", "id", "nos", F.posexplode(_prefixes()).alias("at", "block")).select("source", "salt", "id", (F.col("at") + 1).alias("size"), "block", F.col("nos")[F.col("at")].alias("line_no"))
    return lines.join(blocks.select(*on).hint("merge"), on).select("id", "line_no").distinct()


def repeated_blocks(df: DataFrame, id_col: str = "art_id", source_col: str = "art_source", text_col: str = "art_text", documents: int = DOCUMENTS) -> DataFrame:
    """(source, block: line identifiers, docs): the longest runs of lines that at least ``documents`` documents of the source hold.

    A run is left out where one line more before it is in as long a run. Lines without enough letters do not part a run.
    """
    lines = cut(_lines(df, id_col, source_col, text_col).select("id", "source", "ord", "line").distinct())

    def often(named: DataFrame, *by: str) -> DataFrame:
        """The rows whose name enough documents of the source hold."""
        keys = ["source", *by]
        enough = named.groupBy(*keys, "id").agg(F.lit(1).alias("_one")).groupBy(*keys).agg(F.count("*").alias("_docs")).where(F.col("_docs") >= documents).drop("_docs")
        return named.join(enough.hint("merge"), keys, "left_semi")

    levels = [cut(often(lines.withColumnRenamed("line", "name"), "name"))]
    while not levels[-1].isEmpty():
        half = 1 << (len(levels) - 1)
        behind = levels[-1].select("id", (F.col("ord") - half).alias("ord"), F.col("name").alias("more"))
        doubled = levels[-1].join(behind.hint("merge"), ["id", "ord"]).select("id", "source", "ord", F.xxhash64("name", "more").alias("name"))
        levels.append(cut(often(doubled, "name")))
    found, above = None, None
    for j in range(len(levels) - 2, -1, -1):
        # from here as many as 2^j lines are repeated, but no 2^(j+1): a run is named by its first and its last 2^j lines
        level, step = levels[j], 1 << j
        tail = level.select("id", F.col("ord").alias("at"), F.col("name").alias("tail"))
        own = level.join(above.hint("merge"), ["id", "ord"], "left_anti") if above is not None else level
        above = level.select("id", "ord")
        run = own.select("id", "source", "ord", F.col("name").alias("head"), F.lit(step).alias("size"))

        def held(runs: DataFrame, level: DataFrame = level, step: int = step, tail: DataFrame = tail) -> DataFrame:
            """(source, head, size, tail, docs) of all runs with a head and size of ``runs``."""
            where = level.withColumnRenamed("name", "head").join(runs.select("source", "head", "size").distinct().hint("merge"), ["source", "head"])
            return where.withColumn("at", F.col("ord") + F.col("size") - step).join(tail.hint("merge"), ["id", "at"]).groupBy("source", "head", "size", "tail").agg(F.countDistinct("id").alias("docs"))

        for k in range(j - 1, -1, -1):
            tried = run.withColumn("size", F.col("size") + (1 << k)).withColumn("at", F.col("ord") + F.col("size") - step).join(tail.hint("merge"), ["id", "at"])
            longer = tried.join(held(tried).where(F.col("docs") >= documents).hint("merge"), ["source", "head", "size", "tail"], "left_semi").select("id", "ord", F.col("size").alias("longer"))
            run = cut(run.join(longer.hint("merge"), ["id", "ord"], "left").select("id", "source", "ord", "head", F.coalesce("longer", "size").alias("size")))
        named = run.withColumn("at", F.col("ord") + F.col("size") - step).join(tail.hint("merge"), ["id", "at"]).drop("at")
        named = named.join(held(named).hint("merge"), ["source", "head", "size", "tail"])
        found = named if found is None else found.unionByName(named)
    if found is None:
        return lines.limit(0).select("source", F.array("line").alias("block"), F.lit(0).cast("bigint").alias("docs"))
    found = cut(found)
    before = found.select("id", (F.col("ord") + 1).alias("ord"), F.col("size").alias("before"))
    longest = found.join(before.hint("merge"), ["id", "ord"], "left").where(F.coalesce("before", F.lit(0)) <= F.col("size"))
    ones = longest.groupBy("source", "head", "size", "tail", "docs").agg(F.min(F.struct("id", "ord")).alias("one"))
    where = ones.select("source", "docs", "one", F.col("one.id").alias("id"), "size", F.explode(F.sequence(F.col("one.ord"), F.col("one.ord") + F.col("size") - 1)).alias("ord"))
    return where.join(lines.select("id", "ord", "line"), ["id", "ord"]).groupBy("source", "one", "size", "docs").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]).alias("block")).select("source", "block", "docs")


def without_lines(df: DataFrame, found: DataFrame, id_col: str = "art_id", text_col: str = "art_text") -> DataFrame:
    """(id, clean_text): each document without the lines of ``found``; null texts stay null. A row that occurs twice comes out twice."""
    gone = found.groupBy("id").agg(F.collect_set("line_no").alias("gone"))
    joined = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(gone, "id", "left")
    kept = F.transform(F.filter(F.transform(F.split("t", "\n"), lambda x, i: F.struct(x.alias("x"), (i + 1).alias("n"))), lambda s: ~F.array_contains("gone", s["n"])), lambda s: s["x"])
    return joined.select("id", F.when(F.col("gone").isNull(), F.col("t")).otherwise(F.array_join(kept, "\n")).alias("clean_text"))
