"""References to companies: from clusters of mentions, and from the answers of a model outside."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.functions.text import EXCLUDED_PRONOUNS
from pressmill.plans.arrow import map_batches

#: Words of a cluster's head, at most.
HEAD_WORDS = 6
LABEL, MODEL_LABEL = "XX-COREF", "LLM-COREF"


def expand_clusters(clusters: DataFrame) -> DataFrame:
    """(doc_id, cluster, item, start, end) of doc_id, clusters: array<array<struct<start, end>>>; item 0 is the head. Null and empty clusters give no row."""
    outer = clusters.where("doc_id IS NOT NULL").select("doc_id", F.posexplode("clusters").alias("cluster", "_c"))
    return outer.select("doc_id", "cluster", F.posexplode("_c").alias("item", "_i")).where("_i.start < _i.end").select("doc_id", "cluster", "item", F.col("_i.start").alias("start"), F.col("_i.end").alias("end"))


def spread(texts: DataFrame, entities: DataFrame, clusters: DataFrame, most: int = HEAD_WORDS) -> DataFrame:
    """(doc_id, start, end, text, label, comp_symbol, comp_name): each item of a cluster whose head shares a character with a company's span.

    ``texts``: doc_id, text; ``entities``: doc_id, start, end, comp_symbol, comp_name; offsets count characters, the end is
    exclusive. Heads of more than ``most`` words and items with a word that never stands for a company are left out;
    a cluster that two companies touch is spread for both.
    """
    items = expand_clusters(clusters).join(texts.where("text IS NOT NULL").select("doc_id", F.col("text").alias("_t")), "doc_id")
    items = items.select("doc_id", "cluster", "item", "start", "end", F.expr("substring(_t, start + 1, end - start)").alias("text"))
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    heads = items.where((F.col("item") == 0) & (F.size(words) <= most)).select("doc_id", "cluster", F.col("start").alias("h_start"), F.col("end").alias("h_end"))
    named = entities.where("comp_symbol IS NOT NULL").select("doc_id", F.col("start").alias("e_start"), F.col("end").alias("e_end"), "comp_symbol", "comp_name").distinct()
    touched = heads.join(named, "doc_id").where((F.col("h_start") < F.col("e_end")) & (F.col("h_end") > F.col("e_start"))).select("doc_id", "cluster", "comp_symbol", "comp_name").distinct()
    kept = items.where(~F.arrays_overlap(words, F.array(*map(F.lit, EXCLUDED_PRONOUNS))))
    return touched.join(kept, ["doc_id", "cluster"]).select("doc_id", "start", "end", "text", F.lit(LABEL).alias("label"), "comp_symbol", "comp_name").distinct()


def places(text: str, outer: str, inner: str) -> list[tuple[int, int]]:
    """(start, end) of the first ``inner`` in each occurrence of ``outer``, which do not overlap."""
    out, at, first = [], 0, outer.find(inner) if inner else -1
    while outer and first >= 0 and (at := text.find(outer, at)) >= 0:
        out.append((at + first, at + first + len(inner)))
        at += len(outer)
    return out


def locate_quotes(texts: DataFrame, answers: DataFrame) -> DataFrame:
    """(doc_id, cluster_id, start, end, text) of the answers' mentions, found by the words around them.

    ``answers``: doc_id, cluster_id, coref_text, coref_with_surroundings. What isn't found gives no row.
    """
    both = answers.where("coref_text IS NOT NULL AND coref_with_surroundings IS NOT NULL").select("doc_id", "cluster_id", "coref_text", "coref_with_surroundings").distinct().join(texts.where("text IS NOT NULL").select("doc_id", "text"), "doc_id")
    kind = both.schema["doc_id"].dataType.simpleString()

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [(i, a, z, inner) for i, (inner, outer, t) in enumerate(zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))) for a, z in places(t, outer, inner)]
            take = pa.array([r[0] for r in rows], pa.int32())
            return pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array([r[k] for r in rows], pa.int32()) for k in (1, 2)), pa.array([r[3] for r in rows], pa.string())], ["doc_id", "cluster_id", "start", "end", "text"])

        return step

    return map_batches(both.select("doc_id", F.col("cluster_id").cast("int").alias("cluster_id"), "coref_text", "coref_with_surroundings", "text"), make, f"doc_id {kind}, cluster_id int, start int, end int, text string").distinct()


def cluster_heads(entities: DataFrame) -> DataFrame:
    """(doc_id, cluster_id from 0, head_text, start, end, comp_symbol, comp_name): the first mention of each company of a document."""
    first = entities.where("doc_id IS NOT NULL AND comp_symbol IS NOT NULL").groupBy("doc_id", "comp_symbol", "comp_name").agg(F.min(F.struct("start", "end", "ent_text")).alias("m"))
    heads = first.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("m", "comp_symbol", "comp_name"))).alias("h")).select("doc_id", F.posexplode("h").alias("cluster_id", "h"))
    return heads.select("doc_id", "cluster_id", F.col("h.m.ent_text").alias("head_text"), F.col("h.m.start").alias("start"), F.col("h.m.end").alias("end"), "h.comp_symbol", "h.comp_name")


@dataclass(frozen=True)
class Answer:
    cluster_id: int
    coref_text: str
    coref_with_surroundings: str


class ReferenceProvider(Protocol):
    def references(self, text: str, heads: list[tuple[int, str, int, int]]) -> list[Answer]:
        """Mentions of each head (cluster_id, text, start, end), with the words around them; in any order."""


class FirstWords:
    """A stand-in for tests and offline use: a later mention of a name's first word stands for it."""

    def references(self, text: str, heads: list[tuple[int, str, int, int]]) -> list[Answer]:
        out = []
        for k, name, _, end in heads:
            word = name.split()[0] if name and name.split() else ""
            at = text.find(word, end) if len(word) > 3 else -1
            while at >= 0:
                out.append(Answer(k, word, text[max(0, at - 20) : at + len(word) + 20]))
                at = text.find(word, at + len(word))
        return out


def ask_references(texts: DataFrame, heads: DataFrame, make: Callable[[], ReferenceProvider], wait: float = 0.0) -> DataFrame:
    """(doc_id, cluster_id, coref_text, coref_with_surroundings): one request a document, repeated once if it fails, then left without answers. One provider a task."""
    asked = heads.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("cluster_id", "head_text", "start", "end"))).alias("heads")).join(texts.where("text IS NOT NULL").select("doc_id", "text"), "doc_id")
    kind = asked.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make()
        for b in batches:
            rows: list[tuple[int, Answer]] = []
            for i, (hs, text) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                for attempt in (0, 1):
                    try:
                        rows += [(i, a) for a in provider.references(text, [(h["cluster_id"], h["head_text"], h["start"], h["end"]) for h in hs]) or ()]
                        break
                    except Exception:  # noqa: BLE001
                        if attempt == 0:
                            time.sleep(wait)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i for i, _ in rows], pa.int32())), pa.array([a.cluster_id for _, a in rows], pa.int32()), pa.array([a.coref_text for _, a in rows], pa.string()), pa.array([a.coref_with_surroundings for _, a in rows], pa.string())], ["doc_id", "cluster_id", "coref_text", "coref_with_surroundings"])

    return asked.mapInArrow(run, f"doc_id {kind}, cluster_id int, coref_text string, coref_with_surroundings string")


def model_references(texts: DataFrame, entities: DataFrame, make: Callable[[], ReferenceProvider], wait: float = 0.0) -> DataFrame:
    """(doc_id, start, end, text, label, comp_symbol, comp_name) of the mentions that a provider finds; answers meet companies by cluster, whatever their order."""
    heads = cluster_heads(entities)
    found = locate_quotes(texts, ask_references(texts, heads, make, wait))
    return found.join(heads.select("doc_id", "cluster_id", "comp_symbol", "comp_name"), ["doc_id", "cluster_id"]).select("doc_id", "start", "end", "text", F.lit(MODEL_LABEL).alias("label"), "comp_symbol", "comp_name").distinct()
