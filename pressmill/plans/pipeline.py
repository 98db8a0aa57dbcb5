"""Presets of steps from articles to the spans of companies in them, composed of the operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.functions import text
from pressmill.operators import frames, providers, references, spans

TASKS = ("ALL", "NER", "COREF", "BASIC")
METHODS = ("TRADITIONAL", "PRETRAINED", "GENERATIVE_LLM")
_SPANS = ("doc_id", "start", "end", "symbol", "label")


@dataclass(frozen=True)
class Inputs:
    """What steps need beside the articles; a preset asks only for what it uses.

    ``patterns``: symbol, anchor, in_text, in_word; ``companies``: symbol, name; ``clusters``: doc_id, clusters;
    ``names`` and ``references`` make a provider in each task.
    """

    patterns: DataFrame | None = None
    companies: DataFrame | None = None
    clusters: DataFrame | None = None
    names: Callable[[], providers.NameProvider] | None = None
    references: Callable[[], references.ReferenceProvider] | None = None


@dataclass(frozen=True)
class State:
    """Texts (doc_id, text), their sentences (doc_id, pos, sentence), candidates and accepted spans (doc_id, start, end, symbol, label)."""

    texts: DataFrame
    sentences: DataFrame | None = None
    candidates: DataFrame | None = None
    accepted: DataFrame | None = None


def _sentences(s: State, i: Inputs) -> State:
    return replace(s, sentences=s.texts.select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("pos", "sentence")))


def _more(s: State, found: DataFrame) -> State:
    found = found.select(*_SPANS)
    return replace(s, candidates=found if s.candidates is None else s.candidates.unionByName(found))


def _pattern_names(s: State, i: Inputs) -> State:
    hits = spans.match_patterns(s.texts, i.patterns, "doc_id", "text", "symbol", "anchor", "in_text")
    return _more(s, hits.select(F.col("id").alias("doc_id"), "start", "end", F.col("key").alias("symbol"), F.lit("OWN-REGEX").alias("label")))


def _word_patterns(s: State, i: Inputs) -> State:
    hits = spans.match_patterns(s.texts, i.patterns, "doc_id", "text", "symbol", "anchor", "in_word", within_word=True)
    return _more(s, hits.select(F.col("id").alias("doc_id"), "start", "end", F.col("key").alias("symbol"), F.lit("ORG-PART").alias("label")))


def _provider_names(s: State, i: Inputs) -> State:
    """Spans that a provider finds, each with the listed company most like it."""
    found = providers.find_names(s.texts, i.names)
    best = spans.fuzzy_best(found, i.companies, "name", "symbol", "name").select(F.col("value").alias("name"), F.col("key").alias("symbol"))
    return _more(s, found.join(best, "name").select("doc_id", "start", "end", "symbol", F.lit("ORG").alias("label")))


def _entities(s: State, i: Inputs) -> DataFrame:
    names = i.companies.groupBy("symbol").agg(F.min("name").alias("comp_name")) if i.companies is not None else s.accepted.select("symbol").distinct().withColumn("comp_name", F.col("symbol"))
    named = s.accepted.join(names, "symbol", "left").join(s.texts, "doc_id")
    return named.select("doc_id", "start", "end", F.expr("substring(text, start + 1, end - start)").alias("ent_text"), F.col("symbol").alias("comp_symbol"), "comp_name")


def _clusters(s: State, i: Inputs) -> State:
    return _more(s, references.spread(s.texts, _entities(s, i), i.clusters).withColumnRenamed("comp_symbol", "symbol"))


def _provider_references(s: State, i: Inputs) -> State:
    return _more(s, references.model_references(s.texts, _entities(s, i), i.references).withColumnRenamed("comp_symbol", "symbol"))


def _resolve(overwrite: bool) -> Callable[[State, Inputs], State]:
    def step(s: State, i: Inputs) -> State:
        new = s.candidates.select(*_SPANS, F.lit(False).alias("own"), F.lit(True).alias("candidate"))
        old = s.accepted.select(*_SPANS, F.lit(True).alias("own"), F.lit(False).alias("candidate")) if s.accepted is not None else new.limit(0)
        both = old.unionByName(new)
        kept = spans.resolve_spans(both, overwrite).drop("own")
        labels = both.groupBy("doc_id", "start", "end", "symbol").agg(F.min_by("label", F.struct(F.col("candidate"), "label")).alias("label"))
        return replace(s, accepted=kept.join(labels, ["doc_id", "start", "end", "symbol"]).select(*_SPANS), candidates=None)

    return step


STEPS: dict[str, tuple[Callable[[State, Inputs], State], tuple[str, ...]]] = {
    "sentences": (_sentences, ()),
    "pattern_names": (_pattern_names, ("patterns",)),
    "word_patterns": (_word_patterns, ("patterns",)),
    "provider_names": (_provider_names, ("names", "companies")),
    "resolve": (_resolve(True), ()),
    "clusters": (_clusters, ("clusters",)),
    "provider_references": (_provider_references, ("references",)),
    "resolve_keep": (_resolve(False), ()),
}


def build_pipeline(task: str, ner: str | None = None, coref: str | None = None) -> list[str]:
    """The steps of a task; a ValueError for combinations that make no sense.

    References are looked for only where names are found, so that COREF and ALL need
    a method for both; names are never found by a generative model here.
    """
    if task not in TASKS:
        raise ValueError(f"unknown task {task}")
    for method in (ner, coref):
        if method is not None and method not in METHODS:
            raise ValueError(f"unknown method {method}")
    if ner == "GENERATIVE_LLM":
        raise ValueError("names are not found by a generative model")
    if coref == "TRADITIONAL":
        raise ValueError("references have no traditional method")
    steps = ["sentences"]
    if task in ("NER", "ALL", "COREF"):
        if ner is None:
            raise ValueError("a method for names is needed")
        steps += ["pattern_names", "word_patterns", "resolve"] if ner == "TRADITIONAL" else ["provider_names", "resolve"]
    if task in ("ALL", "COREF"):
        if coref is None:
            raise ValueError("a method for references is needed")
        steps += ["clusters" if coref == "PRETRAINED" else "provider_references", "resolve_keep"]
    return steps


def run_pipeline(articles: DataFrame, steps: list[str], inputs: Inputs, id_col: str = "art_id", text_col: str = "art_text") -> State:
    """The state after all steps. Rows with a null id or text are left out, exact copies count once."""
    for name in steps:
        for wanted in STEPS[name][1]:
            if getattr(inputs, wanted) is None:
                raise ValueError(f"step {name} needs {wanted}")
    state = State(articles.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).distinct())
    for name in steps:
        state = STEPS[name][0](state, inputs)
    return state


def graph_rows(isins: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A step from articles with nested mentions to rows of sentence, company and ISIN."""
    return lambda articles: frames.kg_rows(articles, isins)
