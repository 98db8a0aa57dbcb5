"""The graph's schema: a subset of Turtle, checks, and what data each class and edge needs."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKEN = re.compile(r'\s+|#[^\n]*|(?P<iri><[^>]*>)|(?P<text>"(?:[^"\\]|\\.)*"(?:@\w+|\^\^[\w:]+)?)|(?P<name>[\w\-]*:[\w\-./]*|\ba\b|@prefix|@base|[\w\-]+)|(?P<mark>[;,.\[\]])')


def local_name(iri: str) -> str:
    """What stands behind the last #, or else the last /, or else the last colon."""
    for sep in "#/:":
        if sep in iri:
            return iri.strip("<>").rpartition(sep)[2]
    return iri


def parse_turtle(text: str) -> list[tuple[str, str, str]]:
    """(subject, predicate, object) with prefixes resolved; a ValueError names the place of what isn't understood."""
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not understood at character {at}: {text[at : at + 20]!r}")
        if m.lastgroup:
            tokens.append((m.lastgroup, m.group(), at))
        at = m.end()
    prefixes, triples, i = {}, [], 0

    def full(kind: str, value: str, where: int) -> str:
        if kind == "iri":
            return value[1:-1]
        if value == "a":
            return "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
        if kind == "name" and ":" in value:
            p, _, local = value.partition(":")
            if p not in prefixes:
                raise ValueError(f"unknown prefix {p!r} at character {where}")
            return prefixes[p] + local
        return value

    while i < len(tokens):
        kind, value, where = tokens[i]
        if value == "@prefix":
            prefixes[tokens[i + 1][1].rstrip(":")] = tokens[i + 2][1][1:-1]
            i += 4
            continue
        if value == "@base":
            i += 3
            continue
        subject, i = full(*tokens[i]), i + 1
        while True:
            if i >= len(tokens):
                raise ValueError("the text ends within a statement")
            if tokens[i][1] == ".":
                i += 1
                break
            predicate, i = full(*tokens[i]), i + 1
            while True:
                if i >= len(tokens) or tokens[i][0] == "mark":
                    raise ValueError(f"an object is missing at character {tokens[min(i, len(tokens) - 1)][2]}")
                triples.append((subject, predicate, full(*tokens[i])))
                i += 1
                if i < len(tokens) and tokens[i][1] == ",":
                    i += 1
                    continue
                break
            if i < len(tokens) and tokens[i][1] == ";":
                i += 1
    return triples


@dataclass
class Ontology:
    """Classes with their properties, edges as (source, name, target)."""

    classes: dict[str, list[str]]
    edges: list[tuple[str, str, str]]
    keys: dict[str, str] = field(default_factory=dict)
    edge_values: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_triples(cls, triples: list[tuple[str, str, str]], **kw) -> Ontology:
        short = [tuple(map(local_name, t)) for t in triples]
        kinds: dict[str, set[str]] = {}
        for s, p, o in short:
            if p == "type":
                kinds.setdefault(o, set()).add(s)
        domain = {s: o for s, p, o in short if p == "domain"}
        target = {s: o for s, p, o in short if p == "range"}
        classes: dict[str, list[str]] = {c: [] for c in sorted(kinds.get("Class", ()))}
        for prop in sorted(kinds.get("DatatypeProperty", ())):
            if domain.get(prop) in classes:
                classes[domain[prop]].append(prop)
        edges = sorted((domain[p], p, target[p]) for p in kinds.get("ObjectProperty", ()) if p in domain and p in target)
        return cls(classes, edges, **kw)

    def problems(self) -> list[str]:
        """All that is wrong with keys and edge values, in order."""
        out = [f"class {c} has no properties" for c, props in self.classes.items() if not props]
        for c, props in self.classes.items():
            if c not in self.keys:
                out.append(f"class {c} has no key")
            elif self.keys[c] not in props:
                out.append(f"key {self.keys[c]} is no property of {c}")
        known = {p for props in self.classes.values() for p in props}
        out += [f"value {v} of edge {e} is no property" for e, v in self.edge_values.items() if v not in known]
        return out

    def validate(self) -> None:
        if found := self.problems():
            raise ValueError("; ".join(found))

    def check_frame(self, df: DataFrame, renamed: dict[str, str] | None = None) -> None:
        """A ValueError names the properties that no column holds."""
        renamed = renamed or {}
        missing = sorted({renamed.get(p, p) for props in self.classes.values() for p in props} - set(df.columns))
        if missing:
            raise ValueError(f"columns are missing: {', '.join(missing)}")

    def data_needed(self) -> dict[str, list[str]]:
        return {**{c: list(p) for c, p in self.classes.items()}, **{e: [self.keys.get(s, ""), self.keys.get(t, "")] for s, e, t in self.edges}}


def triple_frame(spark: SparkSession, triples: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame([tuple(map(local_name, t)) for t in triples], "s string, p string, o string")


def class_properties(triples: DataFrame) -> DataFrame:
    """(class, property) by joining type and domain statements."""
    kind = triples.where("p = 'type' AND o = 'DatatypeProperty'").select("s")
    return triples.where("p = 'domain'").join(kind, "s").select(F.col("o").alias("class"), F.col("s").alias("property"))


#: The graph of this engine.
NEWS_GRAPH = """
@prefix : <https://pressmill.example/graph#> .
@prefix owl: <http://www.w3.org/2002/07/owl#> .
@prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
:Article a owl:Class . :Sentence a owl:Class . :Company a owl:Class . :Topic a owl:Class .
:is_part_of a owl:ObjectProperty ; rdfs:domain :Sentence ; rdfs:range :Article .
:mentions a owl:ObjectProperty ; rdfs:domain :Sentence ; rdfs:range :Company .
:is_about a owl:ObjectProperty ; rdfs:domain :Sentence ; rdfs:range :Topic .
:art_id a owl:DatatypeProperty ; rdfs:domain :Article . :art_datetime a owl:DatatypeProperty ; rdfs:domain :Article .
:art_text a owl:DatatypeProperty ; rdfs:domain :Article . :art_source a owl:DatatypeProperty ; rdfs:domain :Article .
:sent_id a owl:DatatypeProperty ; rdfs:domain :Sentence . :sent_text a owl:DatatypeProperty ; rdfs:domain :Sentence .
:comp_symbol a owl:DatatypeProperty ; rdfs:domain :Company . :comp_name a owl:DatatypeProperty ; rdfs:domain :Company .
:comp_isin a owl:DatatypeProperty ; rdfs:domain :Company .
:top_id a owl:DatatypeProperty ; rdfs:domain :Topic . :top_description a owl:DatatypeProperty ; rdfs:domain :Topic .
"""
KEYS = {"Article": "art_id", "Sentence": "sent_id", "Company": "comp_symbol", "Topic": "top_id"}
EDGE_VALUES = {"is_part_of": "art_id", "mentions": "comp_symbol", "is_about": "top_id"}


def news_ontology() -> Ontology:
    return Ontology.from_triples(parse_turtle(NEWS_GRAPH), keys=KEYS, edge_values=EDGE_VALUES)
