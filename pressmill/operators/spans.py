"""Spans of text: dictionary matching, conflicts between spans, fuzzy names."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.functions.text import name_without_legal
from pressmill.plans.arrow import map_batches

#: Characters of a dictionary that are sent to the executors; a larger one is matched in blocks.
BLOCK_CHARS = 20_000_000


def match_dictionary(texts: DataFrame, names: DataFrame, id_col: str, text_col: str, key_col: str, name_col: str, bounded: bool = False, block: int = BLOCK_CHARS) -> DataFrame:
    """(id, key, start, end) of every occurrence of every name, by one automaton over all names.

    With ``bounded`` a name needs the start or a blank before and a blank behind.
    Null and empty names and texts match nothing. The texts are not shuffled.
    """
    spark = texts.sparkSession
    src = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kinds = src.schema["id"].dataType.simpleString(), names.schema[key_col].dataType.simpleString()
    schema = f"id {kinds[0]}, key {kinds[1]}, start int, end int"
    wanted = names.where(F.col(key_col).isNotNull() & (F.length(name_col) > 0)).select(F.col(key_col).alias("k"), F.col(name_col).alias("n")).distinct()
    out, part, size = None, [], 0

    def search(rows: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(rows)

        def make():
            import ahocorasick

            tree, keys = ahocorasick.Automaton(), {}
            for k, n in shared.value:
                keys.setdefault(n, []).append(k)
            for n, ks in keys.items():
                tree.add_word(n, (len(n), ks))
            tree.make_automaton()

            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                row, key, start, end = [], [], [], []
                for i, t in enumerate(batch.column(1).to_pylist()):
                    for last, (length, ks) in tree.iter(t):
                        a, b = last - length + 1, last + 1
                        if bounded and not ((a == 0 or t[a - 1].isspace()) and b < len(t) and t[b].isspace()):
                            continue
                        for k in ks:
                            row.append(i)
                            key.append(k)
                            start.append(a)
                            end.append(b)
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int32())), pa.array(key, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["id", "key", "start", "end"])

            return step

        return map_batches(src, make, schema)

    for r in wanted.toLocalIterator():
        if part and size + len(r["n"]) > block:
            out = search(part) if out is None else out.unionByName(search(part))
            part, size = [], 0
        part.append((r["k"], r["n"]))
        size += len(r["n"])
    if part:
        out = search(part) if out is None else out.unionByName(search(part))
    return out if out is not None else spark.createDataFrame([], schema)


def pattern_hits(t: str, tree, patterns: list[tuple], within_word: bool) -> list[tuple[int, int, int]]:
    """(number of the pattern, start, end) of each match that begins at its anchor and not within its match before."""
    low = t.lower()
    if len(low) != len(t):  # a letter whose lower case is longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
    out, behind = [], {}
    for last, (length, numbers) in tree.iter(low):
        a = last - length + 1
        if a and low[a - 1].isalnum():
            continue
        for k in numbers:
            if a < behind.get(k, 0) or not (m := patterns[k].match(t, a)) or m.end() == a:
                continue
            a_, z = a, m.end()
            if within_word:
                while a_ and not t[a_ - 1].isspace():
                    a_ -= 1
                while z < len(t) and not t[z].isspace():
                    z += 1
                while z > m.end() and not t[z - 1].isalnum():
                    z -= 1
                if "-" not in t[a_:z] or any(c.isspace() for c in t[a_:z]):
                    continue
            behind[k] = z
            out.append((k, a_, z))
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def match_patterns(texts: DataFrame, patterns: DataFrame, id_col: str, text_col: str, key_col: str, anchor_col: str, pattern_col: str, within_word: bool = False, block: int = BLOCK_CHARS) -> DataFrame:
    """(id, key, start, end) of every match of every pattern.

    One automaton finds the anchors, lower-cased words with which matches begin, in any case; only the patterns
    of an anchor that stands there are tried. With ``within_word`` a match counts for the hyphenated word around it.
    Patterns are sent in blocks of ``block`` characters; null texts, anchors and patterns match nothing. The texts are not shuffled.
    """
    spark = texts.sparkSession
    src = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    schema = f"id {src.schema['id'].dataType.simpleString()}, key string, start int, end int"
    wanted = patterns.where(F.col(key_col).isNotNull() & (F.length(anchor_col) > 0) & F.col(pattern_col).isNotNull()).select(F.col(key_col).cast("string").alias("k"), F.col(anchor_col).alias("a"), F.col(pattern_col).alias("p")).distinct()
    out, part, size = None, [], 0

    def search(rows: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(rows)

        def make():
            import re

            import ahocorasick

            tree, numbers = ahocorasick.Automaton(), {}
            for i, (_, anchor, _) in enumerate(shared.value):
                numbers.setdefault(anchor, []).append(i)
            for anchor, mine in numbers.items():
                tree.add_word(anchor, (len(anchor), mine))
            tree.make_automaton()
            compiled = [re.compile(p) for _, _, p in shared.value]

            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                row, key, start, end = [], [], [], []
                for i, t in enumerate(batch.column(1).to_pylist()):
                    for k, a, z in pattern_hits(t, tree, compiled, within_word):
                        row.append(i)
                        key.append(shared.value[k][0])
                        start.append(a)
                        end.append(z)
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int32())), pa.array(key, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["id", "key", "start", "end"])

            return step

        return map_batches(src, make, schema)

    for r in wanted.toLocalIterator():
        if part and size + len(r["p"]) > block:
            out = search(part) if out is None else out.unionByName(search(part))
            part, size = [], 0
        part.append((r["k"], r["a"], r["p"]))
        size += len(r["p"])
    if part:
        out = search(part) if out is None else out.unionByName(search(part))
    return out if out is not None else spark.createDataFrame([], schema)


def resolve(old: list[dict], new: list[dict], overwrite: bool) -> list[dict]:
    """Spans of a document after the candidates, in order of their start, were let in or not.

    Positions are of tokens, the end exclusive. A span that begins just where the
    candidate ends counts as overlapping. Overlapping spans that other components
    set give way. One set by our own gives way only if it lies inside the
    candidate and ``overwrite`` holds; otherwise the candidate is rejected. An
    accepted candidate counts as our own for those behind it.
    """
    spans = [dict(s) for s in old]
    for c in sorted(new, key=lambda s: (s["start"], -s["end"], str(s.get("symbol")))):
        hit = [s for s in spans if not (s["start"] > c["end"] or s["end"] <= c["start"])]
        own = [s for s in hit if s["own"]]
        if any(not (overwrite and c["start"] <= s["start"] and s["end"] <= c["end"]) for s in own):
            continue
        spans = [s for s in spans if s not in hit] + [c | {"own": True}]
    return sorted(spans, key=lambda s: (s["start"], s["end"]))


def resolve_spans(spans: DataFrame, overwrite: bool = True) -> DataFrame:
    """(doc_id, start, end, symbol, own): ``resolve`` for each document.

    Input columns doc_id, start, end, symbol, own (boolean), candidate (boolean).
    The spans of a document are collected as one row; documents are shuffled once.
    """
    one = spans.where("doc_id IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL").groupBy("doc_id").agg(F.collect_set(F.struct("start", "end", "symbol", F.coalesce("own", F.lit(False)).alias("own"), F.coalesce("candidate", F.lit(False)).alias("candidate"))).alias("s"))
    kind = one.schema["doc_id"].dataType.simpleString()

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            row, out = [], []
            for i, all_ in enumerate(batch.column(1).to_pylist()):
                plain = sorted(({k: s[k] for k in ("start", "end", "symbol", "own")} for s in all_ if not s["candidate"]), key=lambda s: (s["start"], s["end"], str(s["symbol"])))
                for s in resolve(plain, [{k: s[k] for k in ("start", "end", "symbol")} for s in all_ if s["candidate"]], overwrite):
                    row.append(i)
                    out.append(s)
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int32())), pa.array([s["start"] for s in out], pa.int32()), pa.array([s["end"] for s in out], pa.int32()), pa.array([s["symbol"] for s in out], pa.string()), pa.array([s["own"] for s in out], pa.bool_())],
                ["doc_id", "start", "end", "symbol", "own"],
            )

        return step

    return map_batches(one, make, f"doc_id {kind}, start int, end int, symbol string, own boolean")


def overlapping(a: DataFrame, b: DataFrame, key: str, start: str = "start_char", end: str = "end_char") -> DataFrame:
    """Pairs of spans of one document that share a character; the columns of b get the prefix ``o_``."""
    other = b.select(F.col(key), *[F.col(c).alias(f"o_{c}") for c in b.columns if c != key])
    return a.join(other, key).where((F.col(start) < F.col(f"o_{end}")) & (F.col(end) > F.col(f"o_{start}")))


def indel_ratio(a: str, b: str) -> float:
    """200 * longest common subsequence / both lengths; two empty strings are alike."""
    if not a and not b:
        return 100.0
    if not a or not b:
        return 0.0
    row = np.zeros(len(b) + 1, np.int32)
    letters = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    for ch in a:
        same = row[:-1] + (letters == ord(ch))
        row[1:] = np.maximum.accumulate(np.maximum(same, row[1:]))
    return 200.0 * int(row[-1]) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a piece of the longer one of its length, also cut off at its ends; an empty one is like another empty one only."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    n = len(short)
    return max(indel_ratio(short, long[max(0, i) : i + n]) for i in range(1 - n, len(long)))


def fuzzy_best(values: DataFrame, names: DataFrame, value_col: str, key_col: str, name_col: str, least: float = 90.0) -> DataFrame:
    """(value, key, ratio): the listed name most like each distinct value, above ``least``.

    Values and names are compared with and without their legal form, the better ratio counts.
    Ties go to a name that is as like with both legal forms, then to the least key.

    Candidates come from an equi-join on runs of three characters. Strings of ratio r
    differ by at most (1 - r) * (both lengths) insertions and deletions, each of
    which spoils at most three runs, so a pair above the bound shares at least the
    lesser number of distinct runs less three times that; the bound is above 0
    for every length at which the strings may differ at all.
    """
    low = lambda c: F.lower(F.trim(c))
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))
    forms = lambda c: F.explode(F.array_distinct(F.array(low(c), low(name_without_legal(c)))))
    v = values.where(F.length(F.trim(value_col)) > 0).select(F.col(value_col).alias("value")).distinct().select("value", forms(F.col("value")).alias("v")).withColumn("fv", F.col("v") == low(F.col("value")))
    n = names.where(F.length(F.trim(name_col)) > 0).select(F.col(key_col).alias("key"), F.col(name_col).alias("name")).distinct().select("key", "name", forms(F.col("name")).alias("n"))
    n = n.groupBy("key", "n").agg(F.max(F.col("n") == low(F.col("name"))).alias("fn"))
    v, n = v.withColumn("gv", grams(F.col("v"))), n.withColumn("gn", grams(F.col("n")))
    left = v.select("value", "v", "fv", F.size("gv").alias("sv"), F.explode("gv").alias("g"))
    pairs = left.join(n.select("key", "n", "fn", F.size("gn").alias("sn"), F.explode("gn").alias("g")).hint("merge"), "g")
    share = least / 100.0
    pairs = pairs.groupBy("value", "v", "fv", "key", "n", "fn", "sv", "sn").agg(F.count("*").alias("c")).where(2 * F.least(F.length("v"), F.length("n")) >= share * (F.length("v") + F.length("n")))
    lost = F.floor((1 - share) * (F.length("v") + F.length("n")))
    pairs = pairs.where(F.col("c") >= F.least("sv", "sn") - 3 * lost)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ratio = [indel_ratio(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())]
            keep = pa.array([r > least for r in ratio])
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ratio, pa.float64()), batch.column(4)], ["value", "key", "ratio", "whole"]).filter(keep)

        return step

    scored = map_batches(pairs.select("value", "v", "key", "n", (F.col("fv") & F.col("fn")).alias("whole")), make, "value string, key string, ratio double, whole boolean")
    return scored.groupBy("value").agg(F.max("ratio").alias("ratio"), F.min_by("key", F.struct(-F.col("ratio"), ~F.col("whole"), "key")).alias("key")).select("value", "key", F.round("ratio", 4).alias("ratio"))
