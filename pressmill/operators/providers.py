"""Steps that a model outside may do: topics, names, references. The rules here are stand-ins for tests and offline use."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FALLBACK = "topic17"


class TopicProvider(Protocol):
    def topics(self, rows: list[tuple[int, str]]) -> dict[int, str]:
        """Topic of each row id; ids that are missing were not understood."""


class NameProvider(Protocol):
    def names(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of what looks like the name of an organisation."""


class CapitalNames:
    """A stand-in: runs of two words or more that begin with a capital."""

    _RUN = re.compile(r"[^\W\d_a-zß-ÿ][\w.&-]*(?:[ ](?:&[ ])?[^\W\d_a-zß-ÿ][\w.&-]*)+")

    def names(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self._RUN.finditer(text)]


def find_names(texts: DataFrame, make: Callable[[], NameProvider]) -> DataFrame:
    """(doc_id, start, end, name) of the spans a provider finds in texts (doc_id, text); one that fails twice finds none. One provider a task."""
    src = texts.where(F.col("text").isNotNull()).select("doc_id", "text")
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make()
        for b in batches:
            rows = []
            for i, t in enumerate(b.column(1).to_pylist()):
                for _ in (0, 1):
                    try:
                        rows += [(i, a, z, t[a:z]) for a, z in provider.names(t) if 0 <= a < z <= len(t)]
                        break
                    except Exception:  # noqa: BLE001
                        continue
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r[0] for r in rows], pa.int32())), *(pa.array([r[k] for r in rows], pa.int32()) for k in (1, 2)), pa.array([r[3] for r in rows], pa.string())], ["doc_id", "start", "end", "name"])

    return src.mapInArrow(run, f"doc_id {kind}, start int, end int, name string")


class KeywordTopics:
    """A stand-in: the first topic of which the sentence holds a word."""

    def __init__(self, words: dict[str, tuple[str, ...]]):
        self.words = words

    def topics(self, rows: list[tuple[int, str]]) -> dict[int, str]:
        out = {}
        for i, text in rows:
            low = text.lower()
            hit = next((t for t, ws in self.words.items() if any(w in low for w in ws)), None)
            if hit:
                out[i] = hit
        return out


#: A few words for each topic of the stand-in (two main languages).
KEYWORDS = {
    "topic7": ("dividende", "dividend", "kapitalerhöhung"), "topic14": ("analyst", "rating", "kursziel"), "topic15": ("brand", "fire", "unfall"), "topic11": ("betriebsrät", "union", "vorstand", "chief"),
    "topic10": ("übernahme", "kauf der marke", "bid for", "tochter"), "topic8": ("stellt", "unveils", "launch"), "topic3": ("hauptversammlung", "bis zum", "put off"), "topic1": ("halbjahr", "quartal", "earned", "quarter"),
}


def ask_in_chunks(rows: list[tuple[int, str]], provider: TopicProvider, chunk: int = 30, wait: float = 0.0, fallback: str = FALLBACK) -> dict[int, str]:
    """The provider's answers by row id, in any order; a chunk that fails is asked once more, then falls back, as do rows without an answer."""
    out: dict[int, str] = {}
    for at in range(0, len(rows), chunk):
        part = rows[at : at + chunk]
        answer: dict[int, str] = {}
        for attempt in (0, 1):
            try:
                answer = provider.topics(part)
                break
            except Exception:  # noqa: BLE001
                if attempt == 0:
                    time.sleep(wait)
        out |= {i: answer.get(i) or fallback for i, _ in part}
    return out


def classify(df: DataFrame, make: Callable[[], TopicProvider], id_col: str, text_col: str, chunk: int = 30, wait: float = 0.0) -> DataFrame:
    """(row_id, topic): rows with a null text are not asked for and get a null topic. One provider a task."""
    src = df.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make()
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            # positions are the ids in a request, so that repeated or null row ids do no harm
            said = ask_in_chunks([(k, t) for k, t in enumerate(texts) if t is not None], provider, chunk, wait)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([said.get(k) for k in range(len(ids))], pa.string())], ["row_id", "topic"])

    return src.mapInArrow(run, "row_id bigint, topic string")
