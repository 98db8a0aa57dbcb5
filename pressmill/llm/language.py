"""The language of every paragraph and article, with a confidence.

One bit-sliced Bloom filter holds the character n-grams of all languages: a slot
is a bit mask with one bit for each language, so that the AND of an n-gram's slots
names every language that has it. The bits are counted for each paragraph,
corrected by what the filter reports falsely, and the counts decide.

The filter is fitted to at most SAMPLE labelled articles of each language, chosen
by a hash of their id; a wrong label among them does little, as an n-gram must
be frequent in a language, compared to where it is most frequent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressmill.llm.grams import codes, mix, windows
from pressmill.plans.arrow import map_batches

LANGUAGES = ("de", "en", "fr", "es", "it", "nl", "ru", "ja", "zh", "hi")
#: Articles a language for the fit.
SAMPLE = 300
SLOTS, PROBES = 1 << 20, 3
#: An n-gram belongs to a language from this share of its frequency where it is most frequent.
SHARE = 0.3
#: An n-gram must be met more than ONCE times in a language with many more than SETTLED n-grams, less often where there are fewer.
ONCE, SETTLED = 2.5, 50_000
#: Characters of a paragraph and paragraphs of an article that the fit reads, at most.
FIT_CHARS, FIT_PARAGRAPHS = 4_000, 50
#: How much of an article's own counts backs each of its paragraphs.
CONTEXT = 0.05
#: Spellings of labels (fixed values); regional tags are cut off before.
SPELLINGS = {
    "de": "de deu ger german deutsch allemand alemán tedesco duits",
    "en": "en eng english englisch anglais inglés inglese engels",
    "fr": "fr fra fre french français francais französisch",
    "es": "es spa spanish español espanol spanisch castellano",
    "it": "it ita italian italiano italienisch",
    "nl": "nl nld dut dutch nederlands niederländisch flemish",
    "ru": "ru rus russian русский russisch",
    "ja": "ja jpn japanese 日本語 japanisch jp",
    "zh": "zh zho chi chinese 中文 汉语 漢語 chinesisch cmn mandarin cn",
    "hi": "hi hin hindi हिन्दी हिंदी",
}
_CHUNK = 400_000
_WIDE, _NARROW, _LATIN_END = 4, 1, 0x400
#: What n-grams count: whole words, those with a capital (names, mostly), characters outside Latin script, the rest.
WORD, CAPITAL, CHARACTER, PART = 1.0, 0.15, 0.3, 0.02
_CAPITAL_MARK = "^"
_P = 0x9E3779B97F4A7C15


def stated_language(label) -> F.Column:
    """The code that a label states by code, name or regional tag; null for none, a placeholder or another language."""
    table = F.create_map(*[F.lit(x) for code, names in SPELLINGS.items() for name in names.split() for x in (name, code)])
    head = F.regexp_extract(F.lower(F.trim(label)), r"^[\p{L}\p{M}]+", 0)
    return F.try_element_at(table, head)


def _without_name(df: DataFrame, text_col: str, name_col: str | None) -> F.Column:
    """The text without the name of its site, which is in no language; a null name changes nothing."""
    if name_col is None:
        return F.col(text_col)
    bare = F.replace(F.replace(F.col(text_col), F.col(name_col), F.lit(" ")), F.upper(name_col), F.lit(" "))
    return F.when(F.length(name_col) > 0, bare).otherwise(F.col(text_col))


def paragraphs(text) -> F.Column:
    """The parts between blank lines, each reduced to lower-case letters with single blanks around and between words and a mark before capitals."""
    marked = lambda x: F.regexp_replace(F.regexp_replace(x, r"[^\p{L}\p{M}]+", " "), r"(?<![\p{L}\p{M}])(?=[\p{Lu}\p{Lt}])", _CAPITAL_MARK)
    part = lambda x: F.concat(F.lit(" "), F.trim(F.lower(marked(x))), F.lit(" "))
    return F.transform(F.split(text, r"\n[^\S\n]*\n"), part)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts, the text each is from, and what it counts.

    Wide windows in Latin script, narrow ones elsewhere, and words as n-grams of their own length.
    """
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), lens)
    left = np.repeat(np.cumsum(lens), lens) - np.arange(len(owner))
    c = codes("".join(texts))
    out_h, out_t, out_w = [], [], []
    for n, fits, weight in ((_WIDE, c < _LATIN_END, PART), (_NARROW, c >= _LATIN_END, CHARACTER)):
        h = windows(c, n)
        ok = fits[: len(h)] & (left[: len(h)] >= n)
        out_h.append(h[ok])
        out_t.append(owner[: len(h)][ok])
        out_w.append(np.full(len(out_h[-1]), weight))
    power = np.cumprod(np.full(len(c) + 1, _P, np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c.astype(np.uint64) * power[: len(c)])])
    blank = np.flatnonzero(c == 32)
    begin, end = blank[:-1] + 1, blank[1:]
    real = end > begin
    begin, end = begin[real], end[real]
    capital = c[begin] == ord(_CAPITAL_MARK)
    begin = begin + capital
    back = np.cumprod(np.full(len(c) + 1, pow(_P, -1, 1 << 64), np.uint64))
    out_h.append(mix((total[end] - total[begin]) * back[begin] + (end - begin).astype(np.uint64)))
    out_t.append(owner[np.minimum(begin, len(c) - 1)])
    out_w.append(np.where(end - begin < 2, PART, np.where(capital, CAPITAL, WORD)))
    return np.concatenate(out_h), np.concatenate(out_t), np.concatenate(out_w)


def fit(samples: dict[str, list[str]], rounds: int = 3) -> LanguageFilter:
    """Fits, drops the paragraphs that come out in another language than their label, and fits again."""
    model = LanguageFilter(samples)
    for _ in range(rounds):
        clean = {}
        for code, texts in samples.items():
            n = model.counts(texts)
            clean[code] = [t for t, best, any_ in zip(texts, n.argmax(axis=1), n.max(axis=1)) if any_ > 0 and LANGUAGES[best] == code]
        model = LanguageFilter({code: clean[code] or samples[code] for code in samples})
    return model


class LanguageFilter:
    def __init__(self, samples: dict[str, list[str]]):
        """samples: paragraphs of each language."""
        per = [np.unique(_grams(samples.get(code) or [])[0], return_counts=True) if samples.get(code) else (np.empty(0, np.uint64), np.empty(0, np.int64)) for code in LANGUAGES]
        every = np.unique(np.concatenate([h for h, _ in per]))
        share = np.zeros((len(LANGUAGES), len(every)))
        seen = np.zeros(len(every), np.int64)
        for k, (h, n) in enumerate(per):
            if len(h):
                share[k, np.searchsorted(every, h)] = n / n.sum()
                seen[np.searchsorted(every, h)] += n
        least = np.array([ONCE / (n.sum() + SETTLED) for _, n in per])
        keep = (share >= SHARE * share.max(axis=0)) & (share > least[:, None])
        self.table = np.zeros(SLOTS, np.uint16)
        for k in range(len(LANGUAGES)):
            for slot in self._slots(every[keep[k]]):
                self.table[slot] |= np.uint16(1 << k)
        fill = np.array([np.count_nonzero(self.table & np.uint16(1 << k)) / SLOTS for k in range(len(LANGUAGES))])
        self.false = fill**PROBES

    @staticmethod
    def _slots(h: np.ndarray) -> list[np.ndarray]:
        step = (h >> np.uint64(40)) | np.uint64(1)
        return [((h + np.uint64(i) * step) & np.uint64(SLOTS - 1)).astype(np.int64) for i in range(PROBES)]

    def masks(self, h: np.ndarray) -> np.ndarray:
        a, *more = self._slots(h)
        m = self.table[a]
        for slot in more:
            m = m & self.table[slot]
        return m

    def counts(self, texts: list[str]) -> np.ndarray:
        """(texts, languages): corrected number of n-grams that tell languages apart."""
        h, t, w = _grams(texts)
        m = self.masks(h)
        tells = (m != 0) & (m != (1 << len(LANGUAGES)) - 1)
        m, t, w = m[tells], t[tells], w[tells]
        n = np.bincount(t, w, minlength=len(texts))
        out = np.empty((len(texts), len(LANGUAGES)))
        for k in range(len(LANGUAGES)):
            has = (m >> np.uint16(k)) & np.uint16(1) == 1
            hit = np.bincount(t[has], w[has], minlength=len(texts))
            out[:, k] = np.maximum(0, hit - n * self.false[k]) / (1 - self.false[k])
        return out


def fit_filter(df: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE, name_col: str | None = None) -> LanguageFilter:
    """Fits to at most ``sample`` labelled rows of each language, those with the least hash of the id, and so many characters of each."""
    labelled = df.where(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).alias("id"), stated_language(F.col(label_col)).alias("lang")).where(F.col("lang").isNotNull())
    first = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = labelled.distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample).select("id", "lang")
    parts = F.transform(F.slice(paragraphs(_without_name(df, text_col, name_col)), 1, FIT_PARAGRAPHS), lambda x: F.substring(x, 1, FIT_CHARS))
    rows = df.select(F.col(id_col).alias("id"), parts.alias("p")).join(chosen, "id").collect()
    samples: dict[str, list[str]] = {}
    for r in rows:
        samples.setdefault(r["lang"], []).extend(p for p in r["p"] if len(p) > 2)
    return fit(samples)


def detect_languages(df: DataFrame, model: LanguageFilter, id_col: str = "art_id", text_col: str = "art_text", name_col: str | None = None) -> DataFrame:
    """(id, par from 0, lang, confidence) of every paragraph that has a letter.

    ``confidence`` is the share of the best language in the best two. A null or
    empty text gives no row, rows that occur twice come out twice, other columns
    are left out. No shuffle; the filter that is broadcast has a fixed size.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)
    src = df.where(F.length(text_col) > 0).select(F.col(id_col).alias("id"), paragraphs(_without_name(df, text_col, name_col)).alias("p"))
    kind = src.schema["id"].dataType.simpleString()

    def make():
        def judge(rows: list[int], pars: list[int], texts: list[str], out: tuple[list, list, list, list]) -> None:
            n = shared.value.counts(texts)
            group = np.unique(np.array(rows), return_inverse=True)[1]
            whole = np.zeros((group.max() + 1, n.shape[1]))
            np.add.at(whole, group, n)
            whole = whole[group]
            score = n / np.maximum(1, n.sum(axis=1, keepdims=True)) + CONTEXT * whole / np.maximum(1, whole.sum(axis=1, keepdims=True))
            two = np.sort(score, axis=1)[:, -2:]
            best = score.argmax(axis=1)
            sure = np.where(two.sum(axis=1) > 0, two[:, 1] / np.maximum(two.sum(axis=1), 1e-9), 0.0)
            known = score.max(axis=1) > 0
            for r, p, b, c, k in zip(rows, pars, best.tolist(), sure.tolist(), known.tolist()):
                out[0].append(r)
                out[1].append(p)
                out[2].append(LANGUAGES[b] if k else None)
                out[3].append(c)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: tuple[list, list, list, list] = ([], [], [], [])
            rows, pars, texts, size = [], [], [], 0
            for r, parts in enumerate(batch.column(1).to_pylist()):
                for p, t in enumerate(parts):
                    if len(t) > 2:
                        rows.append(r)
                        pars.append(p)
                        texts.append(t)
                        size += len(t)
                if size > _CHUNK:
                    judge(rows, pars, texts, out)
                    rows, pars, texts, size = [], [], [], 0
            if texts:
                judge(rows, pars, texts, out)
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(out[0], pa.int32())), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string()), pa.array(out[3], pa.float64())], ["id", "par", "lang", "confidence"])

        return step

    return map_batches(src, make, f"id {kind}, par int, lang string, confidence double")


def label_cases(found: DataFrame, df: DataFrame, id_col: str = "art_id", label_col: str = "art_language") -> DataFrame:
    """(id, lang): the languages of each row whose paragraphs are not all in the one that its label states."""
    said = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), stated_language(F.col(label_col)).alias("stated")).distinct()
    langs = found.where("lang IS NOT NULL").groupBy("id").agg(F.collect_set("lang").alias("langs"))
    odd = langs.join(said, "id").where(F.col("stated").isNull() | (F.size("langs") > 1) | (F.col("langs")[0] != F.col("stated")))
    return odd.select("id", F.explode("langs").alias("lang")).distinct()
