"""Names as people type them, attributed to the listed name they mean.

Noisy channel. Canonical forms are the listed names and the spellings that reviewed
rows, whose company is known, often have; a form's prior is how often it was typed. The
likelihood that a name was typed for a form aligns the words of both: equal, mistyped,
abbreviated, left out, run together, put in another order. Short names and other
stand-ins for a word, which words are left out and how often words are mistyped is
learned from the reviewed rows. A typed word that stands for nothing in the form, such
as another trade, makes it another firm. A name goes to the company of highest posterior.

Candidates are found by words, not names: each distinct typed word meets the listed words
within two missing letters (deletion keys, an equi-join of vocabularies), those it
abbreviates by their beginning, and those it stood for in reviewed rows. A form is reached by
its rare words, rare by their share of all companies, and always by its rarest, so that
every form can be reached. Copies of a typed name are attributed once.
"""

from __future__ import annotations

import math
import re
import unicodedata as ud
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressmill.llm.canonical import canonical
from pressmill.plans.arrow import map_batches
from pressmill.plans.lineage import cut

#: Legal forms, written without dots and blanks (fixed values).
LEGAL = frozenset("ag gmbh se plc kgaa asa inc ltd corp sa nv spa kg co limited incorporated corporation aktiengesellschaft gesmbh mbh ges gesellschaft llc bv sas srl ohg cokg".split())
SAME_FORM = {"limited": "ltd", "incorporated": "inc", "corporation": "corp", "aktiengesellschaft": "ag", "gesmbh": "gmbh", "mbh": "gmbh", "ges": "gmbh", "gesellschaft": "gmbh"}
#: A word of at most this share of the companies reaches those that have it; others may be left out when typed.
RARE = 0.005
#: A reviewed spelling is a form of its own, and a rare word may be left out, from so many reviewed rows.
OFTEN = 2
ACCEPT, REJECT = -9.0, -1e9
_LINKS = frozenset(("&", "the"))


@lru_cache(maxsize=100_000)
def fold(word: str) -> str:
    """Lower case without accents; umlauts written with e count as umlauts."""
    w = "".join(c for c in ud.normalize("NFKD", word.lower().replace("ß", "ss")) if not ud.combining(c))
    return w.replace("ae", "a").replace("oe", "o").replace("ue", "u")


@lru_cache(maxsize=100_000)
def parse(name: str) -> tuple[tuple[str, bool], ...]:
    """(word, abbreviated) of a name, legal forms and initials joined."""
    s = re.sub(r"(?<=[^\W\d_A-Z]{3})(?=[A-ZÄÖÜÉ])", " ", canonical(name)[0])  # a blank left out
    s = re.sub(r"\.-?(?=[A-ZÄÖÜÉ][^\W\d_]{3})", ". ", s)
    s = s.lower()
    s = re.sub(r"\bs\.?\s?p\.?\s?a\b\.?", " spa ", s)
    s = re.sub(r"\bges(?:\.\s*)?m\.?\s?b\.?\s?h\b\.?|\bgesellschaft m\.?b\.?h\b\.?", " gmbh ", s)
    s = re.sub(r"\b([sn])\.\s?([av])\.|\ba\.g\.", lambda m: f" {m.group(1) or 'a'}{m.group(2) or 'g'} ", s)
    s = re.sub(r"\b(?:a\.\s?s\.\s?a)\b\.?", " asa ", s)
    s = re.sub(r"\b(u\.|and|und)(?=\s)", "&", s).replace("+", "&")
    s = re.sub(r"\.-", ".", s)
    s = re.sub(r"\b(\w)\.\s?(\w)\.", r"\1\2!", s)
    out = []
    for t in re.findall(r"&|[^\W_]+(?:[.!’'][^\W_]+)*[.!]?", s):
        word = fold(re.sub(r"[^\w&]", "", t))
        if word:
            out.append((word, "!" if t.endswith("!") else "." if "." in t else ""))
    return tuple(out)


def is_legal(word: str) -> bool:
    return word in LEGAL


@lru_cache(maxsize=200_000)
def distance(a: str, b: str, most: int = 3) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours; more than ``most`` counts as ``most`` + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    old, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, old[j - 2] + 1)
            new.append(v)
        old, row = row, new
    return min(row[-1], most + 1)


def _subsequence(a: str, b: str) -> bool:
    it = iter(b)
    return all(c in it for c in a)


@lru_cache(maxsize=200_000)
def word_likelihood(a: str, short: str, b: str, edit: float = -2.2) -> float:
    """Log likelihood that ``b`` was typed as ``a``; ``edit`` that of a letter mistyped."""
    if a == b:
        return 0.0
    if short == "." and b.startswith(a):
        return -1.0
    if short == "." and len(a) >= 4 and a[0] == b[0] and _subsequence(a, b):
        return -1.5
    if not short and len(a) >= 4 and b.startswith(a) and len(b) - len(a) > 1:
        return -2.5
    if short == "!" or len(b) < 4 or len(a) < 3:
        return REJECT
    d = distance(a, b, 2)
    return edit * d if d <= (1 if len(b) < 7 else 2) else REJECT


def likelihood(typed: tuple, listed: tuple, stands: dict[tuple[str, str], float], left_out: dict[str, float], edit: float = -2.2) -> float:
    """Log likelihood of the typed words given the listed ones.

    ``stands``: of words that stood for others in reviewed rows; ``left_out``: of the words that may be.
    """
    words = [w for w, _ in listed]
    form_b = {SAME_FORM.get(w, w) for w in words if is_legal(w)}
    form_a = {SAME_FORM.get(w, w) for w, _ in typed if is_legal(w)}
    a = [(w, s) for w, s in typed if not is_legal(w) and w not in _LINKS]
    b = [w for w in words if not is_legal(w) and w not in _LINKS]
    if not a and not b:  # nothing but a legal form
        return 0.0 if form_a == form_b else REJECT
    total = 0.0
    if form_a and form_b:
        total += 0.0 if form_a <= form_b else -0.7 if form_a & form_b else -3.5
    elif form_a:
        total -= 3.0
    elif form_b:
        total -= 0.3
    score_of = lambda w, s, x: max(word_likelihood(w, s, x, edit), stands.get((w, x), REJECT))
    pairs = sorted(((score_of(w, s, x), i, j) for i, (w, s) in enumerate(a) for j, x in enumerate(b)), key=lambda p: (-p[0], abs(p[1] - p[2]), p[1], p[2]))
    to: dict[int, int] = {}
    used: set[int] = set()
    for score, i, j in pairs:
        if score > REJECT and i not in to and j not in used:
            to[i] = j
            used.add(j)
            total += score
    for i, (w, s) in enumerate(a):
        if i in to:
            continue
        if i and i - 1 in to and a[i - 1][1] == "." and b[to[i - 1]].startswith(a[i - 1][0]) and len(w) >= 4 and b[to[i - 1]].endswith(w):
            to[i] = to[i - 1]  # beginning and end of one word
            continue
        # two words typed as one
        for j in range(len(b) - 1):
            if j not in used and j + 1 not in used and distance(w, b[j] + b[j + 1], 2) <= 1:
                used |= {j, j + 1}
                to[i] = j
                total -= 2.0
                break
        else:
            # one word typed as two, or as two abbreviated ones
            more = a[i + 1] if i + 1 < len(a) and i + 1 not in to else None
            for j, x in enumerate(b):
                if more and j not in used and (distance(w + more[0], x, 2) <= 1 or (s == "." and len(more[0]) >= 4 and x.startswith(w) and x.endswith(more[0]))):
                    used.add(j)
                    to[i] = to[i + 1] = j
                    total -= 2.0
                    break
            else:
                return REJECT
    gone = [x for j, x in enumerate(b) if j not in used]
    if any(x not in left_out and len(x) > 2 for x in gone):
        return REJECT
    if gone:  # words are left out together, the least likely one decides
        rates = [left_out.get(x, -0.8) for x in gone]
        total += min(rates) + 0.2 * (sum(rates) - min(rates))
    order = [to[i] for i in sorted(to)]
    if order != sorted(order):
        total -= 1.0
    return total


def _deletions(word: str, most: int) -> set[str]:
    out = level = {word}
    for _ in range(most):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out = out | level
    return out


def own_words(name: str) -> list[tuple[str, str]]:
    """Words of a name but its legal form and links, and neighbours run together (marked +); all words where there are no others."""
    words = parse(name)
    own = [(w, s) for w, s in words if not is_legal(w) and w not in _LINKS] or list(words)
    return list(dict.fromkeys([*own, *((a + b, "+") for (a, _), (b, _) in zip(own, own[1:]))]))


def word_keys(word: str, short: str = "", listed: bool = False) -> set[str]:
    """Keys under which words meet that are alike: with letters left out, and by their beginning a listed word and one that abbreviates it."""
    keys = _deletions(word, 0 if len(word) < 4 else 1 if len(word) < 7 else 2)
    return keys | {f"{word[:3]}."} if len(word) > 2 and (listed or short == ".") else keys


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def _words(df: DataFrame, name_col: str) -> DataFrame:
    """(name, word, short): the own words of each name."""
    kind = "name string, words array<struct<word:string,short:string>>"

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [[{"word": w, "short": s} for w, s in own_words(n)] for n in batch.column(0).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("word", pa.string()), ("short", pa.string())])))], ["name", "words"])

        return step

    return map_batches(df.select(F.col(name_col).alias("name")).distinct(), make, kind).select("name", F.explode("words").alias("w")).select("name", "w.word", "w.short")


def _keyed(vocabulary: DataFrame, listed: bool = False) -> DataFrame:
    """(word, short, key) of distinct words."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys = [sorted(map(_hash, word_keys(w, s, listed))) for w, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int64()))], ["word", "short", "keys"])

        return step

    return map_batches(vocabulary, make, "word string, short string, keys array<bigint>").select("word", "short", F.explode("keys").alias("key"))


def learn(reviewed: DataFrame) -> DataFrame:
    """(kind, typed, listed, n) from rows (typed, listed): words that stood for another one, were left out, were mistyped, and listed words in all."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows: list[tuple[str, str | None, str]] = []
            for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                plain = lambda name: [(w, s) for w, s in parse(name) if not is_legal(w) and w not in _LINKS]
                a, b = plain(t), [w for w, _ in plain(x)]
                rest_a, rest_b = [p for p in a if p[0] not in b], [w for w in b if w not in {w for w, _ in a}]
                rows += [("word", None, w) for w in b]
                if len(rest_a) == 1 and len(rest_b) == 1:
                    (w, s), y = rest_a[0], rest_b[0]
                    rows.append(("typo" if distance(w, y, 2) <= 2 and not s else "stands", w, y))
                elif not rest_a:
                    rows += [("left out", None, w) for w in rest_b]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], ["kind", "typed", "listed"])

        return step

    return map_batches(reviewed.select("typed", "listed"), make, "kind string, typed string, listed string").groupBy("kind", "typed", "listed").agg(F.count("*").alias("n"))


def link_names(typed: DataFrame, companies: DataFrame, typed_col: str = "comp_name", symbol_col: str = "symbol", name_col: str = "name", reviewed: DataFrame | None = None) -> DataFrame:
    """(name, symbol, posterior): each distinct typed name that means a listed company, with the likeliest one.

    ``reviewed`` (symbol, name): names as typed of companies that are known. Names that are
    null, blank or of one character give no row. Ties go to the least symbol.
    """
    spark = typed.sparkSession
    cores = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = companies.where(F.col(symbol_col).isNotNull() & F.col(name_col).isNotNull()).groupBy(F.col(symbol_col).alias("symbol")).agg(F.min(name_col).alias("form"))
    if reviewed is None:
        reviewed = spark.createDataFrame([], "symbol string, name string")
    seen = reviewed.where(F.col("symbol").isNotNull() & (F.length(F.trim("name")) > 1)).groupBy("symbol", "name").agg(F.count("*").alias("n")).join(listed, "symbol")
    learned = cut(learn(seen.select(F.explode(F.array_repeat(F.struct(F.col("name").alias("typed"), F.col("form").alias("listed")), F.col("n").cast("int"))).alias("r")).select("r.*")))
    totals = {r["kind"]: r["n"] for r in learned.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    words_seen = totals.get("word", 0)
    edit = min(-1.5, max(-3.0, math.log((totals.get("typo", 0) + 1) / (words_seen + 10)))) if words_seen else -2.2
    mean_out = (totals.get("left out", 0) + 3) / (words_seen + 10)
    known = learned.where("kind = 'word'").select(F.col("listed").alias("b"), F.col("n").alias("all"))
    stands = learned.where("kind = 'stands'").select(F.col("typed").alias("a"), F.col("listed").alias("b"), "n").join(known, "b").select("a", "b", F.log(F.col("n") / (F.col("all") + 1)).alias("score"))
    gone = learned.where("kind = 'left out'").select(F.col("listed").alias("b"), F.col("n").alias("out"))
    rates = known.join(gone, "b", "left").select(F.col("b").alias("word"), F.coalesce("out", F.lit(0)).alias("outs"), F.log((F.coalesce("out", F.lit(0)) + 4 * mean_out) / (F.col("all") + 4)).alias("rate"))

    # canonical forms, their words, and which of these reach them or may be left out
    often = seen.where(F.col("n") >= OFTEN).select("symbol", F.col("name").alias("form"), "n")
    forms = listed.join(seen.select("symbol", F.col("name").alias("form"), "n"), ["symbol", "form"], "left").select("symbol", "form", F.coalesce("n", F.lit(0)).alias("n"))
    forms = cut(forms.unionByName(often.join(listed, ["symbol", "form"], "left_anti")).repartition(cores, "form"))
    firms = max(1, listed.count())
    form_words = cut(_words(forms, "form").withColumnRenamed("name", "form"))
    share = form_words.select("form", "word").distinct().join(forms.select("form", "symbol"), "form").groupBy("word").agg((F.countDistinct("symbol") / firms).alias("share"))
    ranked = form_words.groupBy("form", "word").agg(F.min(F.col("short") == "+").alias("joined")).join(share, "word").withColumn("least", F.min(F.when(~F.col("joined"), F.col("share"))).over(Window.partitionBy("form")))
    reach = cut(ranked.where((F.col("share") <= RARE) | (F.col("share") == F.col("least"))).select("form", F.col("word").alias("b")))
    common = ranked.where("NOT joined").join(rates, "word", "left").where((F.col("share") > RARE) | (F.col("outs") >= OFTEN)).groupBy("form").agg(F.collect_set(F.struct("word", F.coalesce("rate", F.lit(math.log(mean_out))).alias("rate"))).alias("out"))

    # vocabularies meet, then names by their words
    names = typed.where(F.length(F.trim(typed_col)) > 1).select(F.col(typed_col).alias("name")).distinct().repartition(cores)
    name_words = cut(_words(names, "name"))
    left = _keyed(name_words.select("word", "short").distinct().repartition(cores))
    right = _keyed(reach.select(F.col("b").alias("word"), F.lit("").alias("short")).distinct().repartition(cores), listed=True).select(F.col("word").alias("b"), "key")
    met = left.join(right.hint("merge"), "key").select("word", "short", "b").distinct()

    def alike():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = [word_likelihood(a, s, b, edit) > REJECT for a, s, b in zip(*(c.to_pylist() for c in batch.columns))]
            return batch.filter(pa.array(keep, pa.bool_()))

        return step

    edges = map_batches(met, alike, "word string, short string, b string")
    edges = edges.unionByName(name_words.select("word", "short").distinct().join(stands.withColumnRenamed("a", "word"), "word").select("word", "short", "b")).distinct()
    pairs = name_words.join(edges.hint("merge"), ["word", "short"]).select("name", "b").distinct().join(reach.hint("merge"), "b").select("name", "form").distinct()
    own = name_words.select("name", "word").distinct().join(stands.withColumnRenamed("a", "word"), "word").groupBy("name").agg(F.collect_set(F.struct(F.col("word").alias("a"), "b", "score")).alias("stands"))
    pairs = pairs.join(own, "name", "left").join(common, "form", "left").join(forms.select("form", "symbol", "n"), "form").select("name", "form", "symbol", F.col("n").cast("double").alias("n"), "stands", "out")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            logs = []
            for name, form, _, n, st, out in zip(*(c.to_pylist() for c in batch.columns)):
                x = likelihood(parse(name), parse(form), {(r["a"], r["b"]): r["score"] for r in st or ()}, {r["word"]: r["rate"] for r in out or ()}, edit)
                logs.append(x + 0.5 * math.log(1 + n) if x >= ACCEPT else None)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(logs, pa.float64())], ["name", "symbol", "score"]).filter(pa.array([x is not None for x in logs]))

        return step

    scored = map_batches(pairs, make, "name string, symbol string, score double").groupBy("name", "symbol").agg(F.max("score").alias("score"))
    top = scored.withColumn("top", F.max("score").over(Window.partitionBy("name")))
    total = top.groupBy("name", "top").agg(F.sum(F.exp(F.col("score") - F.col("top"))).alias("mass"), F.min(F.when(F.col("score") == F.col("top"), F.col("symbol"))).alias("symbol"))
    return total.select("name", "symbol", (1 / F.col("mass")).alias("posterior"))
