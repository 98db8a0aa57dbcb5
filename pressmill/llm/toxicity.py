"""Abusive, hateful and sexual passages, tagged by a linear-chain conditional random field.

The field is fitted to labelled tokens: reviewed snippets, whose tokens carry the
snippet's category, a short glossary of public words and phrases, and passages of the
corpus as background. They are strung together, so that the chain learns where one
passage ends and the next begins. A token's features are generic: the word, runs of its
letters, and whether it was disguised (digits and signs for letters, spaced or repeated
letters, stars). What a word or a run of letters counts comes from how much oftener
labelled passages have it than all documents do, the fewer words a passage has the more
for each; the weights are learned.

Nothing is left out beforehand: each sentence of each document is a chain. Forward and
backward passes give the marginals of every token; runs of tokens above LEAST are the
offending offsets, the best token of a document is its score. A sentence counts for
its leading category.

The fit is bounded: at most SAMPLE reviewed rows and OTHERS background passages of up to
PASSAGE characters, one of each of the documents with the least hash. Background that a
fit to the rest of it takes for offensive teaches nothing. Counts of the labelled parts
cover all documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.plans.arrow import map_batches
from pressmill.plans.lineage import cut

CATEGORIES = ("abuse", "hate", "sexual")
LABELS = ("none", *CATEGORIES)
#: Rows of the fit, at most: reviewed ones and background passages, and the characters of a passage.
SAMPLE, OTHERS, PASSAGE = 20_000, 8_000, 400
LEAST = 0.5
#: Background passages with a marginal of so much in a category are left out of the fit.
SUSPECT = 0.3

#: Public words and phrases with their category, labelled like reviewed rows; ``|`` parts phrases. Function words are harmless by themselves. A parameter of ``fit_reviewed``.
GLOSSARY = {
    "abuse": """idiot idiots moron imbecile cretin asshole assholes bastard bitch scumbag jackass dumbass blockhead dimwit dickhead wanker wankers loser crybaby scoundrel brainless braindead clueless
        shithead goddamn vollidiot arschloch arschlöcher hurensohn missgeburt trottel esel schwachkopf mistkerl dreckskerl drecksau drecksack drecksäcke mistsau kanaille wichser fresse klappe verpiss hirnlos
        hirnloser verprügeln heulst connard abruti crétin imbécile gueule salaud imbécil idiota gilipollas cabrón
        |shut your mouth|go to hell with you|kill yourself|i know where you live and you will burn|you will pay in blood|beat him until he begs|ich finde raus wo du wohnst und dann knallt es|geh sterben|you piece of shit
        |lying rat|miese ratte|dich sollte man verprügeln""",
    "hate": """scum filth rabble trash savages subhuman inferior leeches crooks exterminate eradicate caged abschaum gesindel schmarotzer untermenschen minderwertig ausrotten vernichten ausmerzen eingesperrt weggesperrt
        racaille plaga escoria|they are rats|they are born thieves|put them in camps|sie sind ratten|alle ins lager gesteckt""",
    "sexual": """sex porn porno pornos xxx horny kinky slutty tits boobs asses nude topless hookups hardcore fuck fucking bang shag geile geil titten möpse ärsche ficken bumsen vögeln poppen erotik nackte nacktbilder tabus
        nues coquines érotique desnudas calientes tetas|naked pics|naked women|screw her all night|wanted to bang her|sex tonight""",
    "none": """a an the this that these those he she it they we i you him her his its their them us me my your our who whom which what when where why how
        is are was were be been being am do does did have has had will would shall should can could may might must to of in on at by for with from without into out up down over under about after before
        and or but if because as than so not no nor only also just all any every each some such like one very too more most now then here there
        ein eine einen einem einer eines der die das den dem des dieser diese dieses diesen jener solche solcher er sie es wir ihr ich du dich dir mich mir ihn ihm ihnen uns euch sich sein seine ihre ihren unser mein dein
        wer was wann wo warum wie ist sind war waren wäre wären bin bist wird werden wurde wurden hat haben hatte hätte kann können konnte könnte muss müssen musste soll sollen sollte will wollen wollte wollten darf dürfen
        und oder aber wenn weil dass als so nicht kein keine nur auch doch mal nun noch schon ja alle alles jeder jeden man sehr mehr für mit von vom zu zum zur aus auf an am in im bei nach vor über unter ohne um durch gegen
        un une le la les des du de ce cet cette ces il elle ils elles on nous vous je tu te se me lui leur son sa ses mon ma ton ta votre qui que quoi quand où comment est sont était être a ont avait avoir faut peut doit veut
        et ou mais si car comme ne pas plus tout tous toute très pour par avec sans dans sur sous chez en y avant après entre
        el los las unos unas lo este esta estos estas ese esa esos esas él ella ellos ellas yo nosotros usted su sus mi quien cuando donde como es son era ser fue está han ha hay puede debe quiere
        o pero porque no ni más muy todo todos toda para con sin sobre bajo desde hasta del al solo""",
}

_HIDDEN = "\xad\u200b-\u200f\u2060\ufeff"
_WIDE = "\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"  # scripts without blanks: each character is a token
_JOINED = "\ue000"  # stands before a token whose letters were spaced out
_WORD = rf"(?:(?![{_WIDE}])[^\W_]|[@$€{_JOINED}](?=[\w@$€]))(?:(?![{_WIDE}])[\w@$*€{_HIDDEN}])*|[{_WIDE}]"
_BREAK = r"""[.!?…।]+(?=[\s”“"»]|\Z)|[。！？]|\n[^\S\n]*\n"""
_TOKEN = re.compile(_WORD)
_ALL = re.compile(f"{_WORD}|{_BREAK}").findall
_NARROW = re.compile(rf"(?:[^\W_]|[@$€{_JOINED}](?=[\w@$€]))[\w@$*€{_HIDDEN}]*|{_BREAK}").findall  # the same where no wide character stands
_HAS_WIDE = re.compile(f"[{_WIDE}]").search
_IS_BREAK = re.compile(r"[.!?…।。！？\n]")
_SPACED = re.compile(r"(?<![\w@$*])[^\W\d_](?:([ .\-_*])[\w@$*](?:\1[\w@$*])+)(?![\w@$*])")
_SPACED_HINT = re.compile(r"(?<!\w)[^\W\d_]([ .\-_*])[\w@$*]\1[\w@$*](?![^\W_])")
_SENTENCE = re.compile(_BREAK)
_LEET = str.maketrans({"@": "a", "$": "s", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "€": "e"})
_AGAIN = re.compile(r"([^\W\d_])\1\1+")
_STRIP = re.compile(f"[{_HIDDEN}]")
_PLAIN = re.compile(r"[^\W\d_]+\Z")
Token = tuple[str, int, int]


def glossary_rows(glossary: dict[str, str]) -> list[tuple[str, str]]:
    """(text, category) of the words and phrases."""
    out = []
    for category, text in glossary.items():
        words, *phrases = text.split("|")
        out += [(w, category) for w in words.split()] + [(" ".join(p.split()), category) for p in phrases]
    return out


def _join_spaced(m: re.Match) -> str:
    return _JOINED + m.group().replace(m.group(1), "")


def split_tokens(text: str) -> list[Token]:
    """(token as written, start, end); spaced-out letters make one token, marked in front."""
    if not _SPACED_HINT.search(text):
        return [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text)]
    out, at = [], 0
    for m in _SPACED.finditer(text):
        out += [(t.group(), t.start(), t.end()) for t in _TOKEN.finditer(text, at, m.start())]
        out.append((_join_spaced(m), m.start(), m.end()))
        at = m.end()
    return out + [(t.group(), t.start(), t.end()) for t in _TOKEN.finditer(text, at)]


def tokens_and_breaks(text: str) -> list[str]:
    """The tokens of a text and what ends its sentences, in order."""
    text = _SPACED.sub(_join_spaced, text) if _SPACED_HINT.search(text) else text
    return _ALL(text) if not text.isascii() and _HAS_WIDE(text) else _NARROW(text)


@lru_cache(maxsize=300_000)
def plain_forms(token: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """The words that a token may stand for, likeliest first, and how it is disguised."""
    token = token.lower()
    if _PLAIN.match(token) and not _AGAIN.search(token):
        return (token,), ()
    how, word = [], _STRIP.sub("", token)
    if word.startswith(_JOINED):
        how.append("spaced")
        word = word[1:]
    forms = [word]
    digits = sum(c.isdigit() for c in word)
    if (digits or any(c in "@$€" for c in word)) and 2 * digits <= len(word) and any(c.isalpha() for c in word):
        how.append("signs")
        forms = [word.translate(_LEET)]
        if "1" in word:
            forms.append(word.replace("1", "l").translate(_LEET))
    if digits < len(word) and _AGAIN.search(forms[0]):
        how.append("repeated")
        forms = [g for f in forms for g in (_AGAIN.sub(r"\1", f), _AGAIN.sub(r"\1\1", f))]
    if "*" in word.strip("*"):
        how.append("star")
    return tuple(forms), tuple(how)


def parts_of(word: str) -> list[str]:
    """The word and its runs of 4 to 6 letters, its ends counted as letters."""
    whole = f"<{word}>"
    return [f"w:{word}", *(whole[i : i + n] for n in (4, 5, 6) for i in range(len(whole) - n + 1))]


class Lexis:
    """What words and parts of words count, from labelled passages and counts over all documents."""

    def __init__(self, labelled: list[str], part_docs: dict[str, int], docs: int):
        """``part_docs``: documents with each part of the labelled passages, of ``docs`` in all."""
        counts: dict[str, float] = {}
        self.words: dict[int, list[str]] = {}
        said = [sorted({plain_forms(t)[0][0] for t, *_ in split_tokens(text)}) for text in labelled]
        mean = sum(map(len, said)) / max(1, len(said))
        for words in said:
            for w in words:
                if w not in self.words.setdefault(len(w), []):
                    self.words[len(w)].append(w)
            for p in {p for w in words for p in parts_of(w)}:
                counts[p] = counts.get(p, 0.0) + mean / len(words)  # of many words fewer are to blame
        odds = {p: np.log(n / max(1, len(labelled)) / ((part_docs.get(p, 0) + 1) / (docs + 1))) / np.log(100) for p, n in counts.items()}
        self.value = {p: float(min(v, 1.5)) for p, v in odds.items() if v > 0.15}

    def word(self, token: str) -> tuple[str, tuple[str, ...]]:
        """The word that a token stands for, of a disguised one the form that labelled passages know, and how it is disguised."""
        forms, how = plain_forms(token)
        if "star" in how:
            pattern = re.compile("".join("." if c == "*" else re.escape(c) for c in forms[0]) + r"\Z")
            hits = [w for w in self.words.get(len(forms[0]), ()) if pattern.match(w)] if sum(c != "*" for c in forms[0]) > 1 else []
            return max(hits, key=lambda w: (self.value.get(f"w:{w}", 0.0), w)) if hits else forms[0], how
        return max(forms, key=lambda f: f"w:{f}" in self.value), how

    def features(self, token: str) -> dict[str, float]:
        word, how = self.word(token)
        get = self.value.get
        out = {p: v for p in parts_of(word) if (v := get(p))}
        for h in how:
            out[f"d:{h}"] = 1.0
        size = len(out) ** 0.5
        return {f: v / size for f, v in out.items()}


class _Table(dict):
    """Numbers of tokens as written, 0 for what ends a sentence; rows of emissions by number."""

    def __init__(self, field: Field):
        super().__init__()
        self.field, self.rows = field, [np.zeros(len(LABELS))]
        self._made = np.empty((0, len(LABELS)))

    def __missing__(self, token: str) -> int:
        if _IS_BREAK.match(token):
            self[token] = 0
            return 0
        self.rows.append(self.field.emission(self.field.lexis.features(token)))
        self[token] = n = len(self.rows) - 1
        return n

    def array(self) -> np.ndarray:
        if len(self._made) != len(self.rows):
            self._made = np.array(self.rows)
        return self._made


class Field:
    """Weights of features and transitions; exact marginals by forward and backward passes."""

    def __init__(self, lexis: Lexis, index: dict[str, int] | None = None, weights: np.ndarray | None = None, moves: np.ndarray | None = None, bias: np.ndarray | None = None):
        k = len(LABELS)
        self.lexis, self.index = lexis, index or {}
        self.weights = np.zeros((len(self.index), k)) if weights is None else weights
        self.moves, self.bias = np.zeros((k, k)) if moves is None else moves, np.zeros(k) if bias is None else bias
        self._table = _Table(self)

    def __getstate__(self):
        return {x: v for x, v in self.__dict__.items() if x != "_table"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._table = _Table(self)

    def emission(self, feats: dict[str, float]) -> np.ndarray:
        at = [(i, v) for f, v in feats.items() if (i := self.index.get(f)) is not None]
        return self.bias + (np.array([v for _, v in at]) @ self.weights[[i for i, _ in at]] if at else 0.0)

    def chains(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of lists of tokens and breaks: each chain's list and length, the longest first, and the emissions of its tokens, one behind the other, and where these stood."""
        if len(self._table) > 500_000:
            self._table = _Table(self)
        table = self._table
        sizes = np.fromiter(map(len, lists), np.int64, len(lists)) + 1
        ids = np.zeros(int(sizes.sum()), np.int64)
        owner = np.repeat(np.arange(len(lists)), sizes)
        keep = np.ones(len(ids), bool)
        keep[np.cumsum(sizes) - 1] = False  # a break behind each list
        ids[keep] = np.fromiter((table[t] for ts in lists for t in ts), np.int64, int(keep.sum()))
        ends = np.flatnonzero(ids == 0)
        begins = np.r_[0, ends[:-1] + 1] if len(ends) else ends
        lens = ends - begins
        some = np.flatnonzero(lens)
        some = some[np.argsort(-lens[some], kind="stable")]
        begins, lens = begins[some], lens[some]
        at = np.repeat(begins - np.cumsum(lens) + lens, lens) + np.arange(int(lens.sum()))
        return owner[begins], lens, table.array()[ids[at]], at

    def marginals(self, lists: list[list[str]]) -> list[np.ndarray]:
        """(tokens, LABELS) of each list of tokens, those of its sentences one behind the other; breaks have no row."""
        owner, lens, emit, at = self.chains(lists)
        out = [np.empty((0, len(LABELS)))] * len(lists)
        if len(lens):
            p = forward_backward(emit, lens, self.moves)[0][np.argsort(at, kind="stable")]
            size = np.bincount(owner, lens, len(lists)).astype(np.int64)
            out = np.split(p, np.cumsum(size)[:-1])
        return out

    def best(self, lists: list[list[str]]) -> np.ndarray:
        """(lists, CATEGORIES): the highest marginal of a token of each list; a sentence counts for its leading category only."""
        owner, lens, emit, _ = self.chains(lists)
        out = np.zeros((len(lists), len(CATEGORIES)))
        if len(lens):
            p = forward_backward(emit, lens, self.moves)[0]
            top = np.maximum.reduceat(p, np.cumsum(lens) - lens)[:, 1:]
            top = np.where(top == top.max(axis=1, keepdims=True), top, 0.0)
            np.maximum.at(out, owner, top)
        return out


_BLOCK = 4096


def forward_backward(emit: np.ndarray, lens: np.ndarray, moves: np.ndarray, scale: float | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Marginals of all tokens of chains, longest first, that stand one behind the other in ``emit``; with ``scale`` the expected transitions times it."""
    top = emit[:, 0]
    for j in range(1, emit.shape[1]):
        top = np.maximum(top, emit[:, j])
    e = np.exp(emit - top[:, None])
    m, ones = np.exp(moves), np.ones((len(moves), 1))  # sums of rows by products: short rows add up slowly
    out, pair, starts = np.empty_like(e), None if scale is None else np.zeros_like(moves), np.cumsum(lens) - lens
    for a in range(0, len(lens), _BLOCK):
        part, begin = lens[a : a + _BLOCK], starts[a : a + _BLOCK]
        longest = int(part[0])
        live = np.searchsorted(-part, -np.arange(longest), "left")  # chains longer than i
        step, alpha, rows = e[:0], [], []
        for i in range(longest):
            at = begin[: live[i]] + i
            here = e[at]
            step = here if i == 0 else (step[: live[i]] @ m) * here
            step = step / (step @ ones)
            alpha.append(step)
            rows.append((at, here))
        beta = np.ones((live[longest - 1], e.shape[1]))
        for i in range(longest - 1, -1, -1):
            at, here = rows[i]
            if i < longest - 1:
                n = live[i + 1]
                ahead = rows[i + 1][1] * beta
                x = ahead @ m.T
                if pair is not None:
                    before = alpha[i][:n]
                    pair += m * (before.T @ (ahead * (scale / ((before * x) @ ones))))
                new = np.ones_like(here)
                new[:n] = x / (x @ ones)
                beta = new
            p = alpha[i] * beta
            out[at] = p / (p @ ones)
    return out, pair


#: Gradient steps, their rate, the weight of the data against the penalty, passages in a chain.
_STEPS, _RATE, _DATA, _PENALTY, _STRING = 300, 0.3, 20.0, 5e-7, 2
#: Steps of the fits that only judge background.
_FEW_STEPS = 100


def fit_field(rows: list[tuple[str, str]], lexis: Lexis, steps: int = _STEPS) -> Field:
    """Fits to (text, category) pairs by adaptive gradient steps, always in the same order; the field flags nothing without rows."""
    made = [(split_tokens(t), LABELS.index(c)) for t, c in sorted(set(rows)) if t and c in LABELS]
    made = [x for x in made if x[0]]
    if not made:
        return Field(lexis)
    order = np.random.default_rng(7).permutation(len(made))
    chains = [[made[j] for j in order[i : i + _STRING]] for i in range(0, len(order), _STRING)]
    chains.sort(key=lambda c: -sum(len(part) for part, _ in c))
    # a token has the same features wherever it stands: weights meet the distinct tokens only
    kinds: dict[str, int] = {}
    seq, truth = [], []
    for chain in chains:
        for part, y in chain:
            for token, _, _ in part:
                seq.append(kinds.setdefault(token, len(kinds)))
                truth.append(y)
    feats = [lexis.features(token) for token in kinds]
    if not any(feats):
        return Field(lexis)
    seq, truth, lens, k, n = np.array(seq), np.array(truth), np.array([sum(len(part) for part, _ in c) for c in chains]), len(LABELS), len(truth)
    index = {f: i for i, f in enumerate(dict.fromkeys(f for fs in feats for f in fs))}
    flat, value = np.array([index[f] for fs in feats for f in fs]), np.array([v for fs in feats for v in fs.values()])
    owner = np.repeat(np.arange(len(feats)), [len(fs) for fs in feats])
    scale = _DATA / n
    inner = np.ones(n, bool)
    inner[np.cumsum(lens) - 1] = False
    inner = np.flatnonzero(inner)
    seen = np.zeros((k, k))
    np.add.at(seen, (truth[inner], truth[inner + 1]), scale)
    w, moves, bias = np.zeros((len(index), k)), np.zeros((k, k)), np.zeros(k)
    sums = [np.full_like(x, 1e-8) for x in (w, moves, bias)]
    for _ in range(steps):
        emit = np.stack([np.bincount(owner, value * w[flat, j], len(feats)) for j in range(k)], axis=1)[seq] + bias
        p, pair = forward_backward(emit, lens, moves, scale)
        p[np.arange(n), truth] -= 1
        p *= scale
        each = np.stack([np.bincount(seq, p[:, j], len(feats)) for j in range(k)], axis=1)
        slopes = (np.stack([np.bincount(flat, value * each[owner, j], len(index)) for j in range(k)], axis=1) + _PENALTY * w, pair - seen + 1e-4 * moves, p.sum(axis=0))
        for x, g, d in zip((w, moves, bias), sums, slopes):
            g += d**2
            x -= _RATE * d / np.sqrt(g)
    return Field(lexis, index, w, moves, bias)


def harmless(reviewed: list[tuple[str, str]], others: list[str], lexis: Lexis) -> list[str]:
    """The background passages that a fit to the reviewed rows and the other half of the background does not take for offensive: a fit to a true case as harmless would learn it."""
    out, others = [], list(dict.fromkeys(others))  # none in both halves
    for here, there in ((others[::2], others[1::2]), (others[1::2], others[::2])):
        best = fit_field(reviewed + [(t, "none") for t in there], lexis, _FEW_STEPS).best([tokens_and_breaks(t) for t in here])
        out += [t for t, p in zip(here, best) if p.max() < SUSPECT]
    return out


def passages(text: str) -> list[str]:
    """Sentences of at most PASSAGE characters, longer ones in pieces."""
    out, at = [], 0
    for end in [m.end() for m in _SENTENCE.finditer(text)] + [len(text)]:
        s = text[at:end].strip()
        out += [s[i : i + PASSAGE] for i in range(0, len(s), PASSAGE)]
        at = end
    return out


def _statistics(df: DataFrame, text_col: str, parts: list[str]) -> DataFrame:
    """(kind, at, n, text): distinct words of documents with each labelled part (1), all documents (2), and a passage (3) of each of the documents with the least hash, of every task."""
    shared = df.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, held, docs = {p: i for i, p in enumerate(shared.value)}, np.zeros(len(shared.value), np.int64), 0
        words: Counter[str] = Counter()
        chosen: dict[str, int] = {}
        most = 1 << 64

        def settle() -> None:
            for token, n in words.items():
                if not _IS_BREAK.match(token):
                    for part in {where[p] for p in parts_of(plain_forms(token)[0][0]) if p in where}:
                        held[part] += n
            words.clear()

        for b in batches:
            for text in b.column(0).to_pylist():
                if not text:
                    continue
                docs += 1
                words.update(set(tokens_and_breaks(text)))
                h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"))
                if h < most and (said := passages(text)):
                    chosen[said[h % len(said)]] = h
                    if len(chosen) > 2 * OTHERS:
                        chosen = _least_hash(chosen, OTHERS)
                        most = max(chosen.values())
            if len(words) > 500_000:
                settle()
        settle()
        chosen = _least_hash(chosen, OTHERS)
        p = np.flatnonzero(held)
        kind = np.concatenate([np.ones(len(p), np.int32), [2], np.full(len(chosen), 3)])
        at = np.concatenate([p, [0], np.array([h >> 1 for h in chosen.values()], np.int64)])
        n = np.concatenate([held[p], [docs], np.zeros(len(chosen), np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array([None] * (len(p) + 1) + list(chosen), pa.string())], ["kind", "at", "n", "text"])

    return df.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "kind int, at bigint, n bigint, text string")


def _least_hash(rows: dict[str, int], most: int) -> dict[str, int]:
    return dict(sorted(rows.items(), key=lambda x: (x[1], x[0]))[:most])


def fit_reviewed(df: DataFrame, samples: DataFrame, text_col: str = "text", category_col: str = "category", corpus_text_col: str = "text", sample: int = SAMPLE, glossary: dict[str, str] | None = GLOSSARY) -> Field:
    """Fits to the reviewed snippets, the glossary (None for none) and passages of the corpus ``df``, which are taken as harmless but for those that look offensive.

    Of more than ``sample`` reviewed rows those with the least hash are taken. Without a labelled row nothing is flagged.
    """
    rows = samples.where(F.col(text_col).isNotNull() & F.col(category_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(category_col).alias("c")).distinct().orderBy(F.xxhash64("t", "c"), "t", "c").limit(sample).collect()
    reviewed = [(r["t"], r["c"]) for r in rows if r["c"] in LABELS] + glossary_rows(glossary or {})
    labelled = sorted({t for t, c in reviewed if c != "none"})
    parts = sorted({p for t in labelled for x, *_ in split_tokens(t) for p in parts_of(plain_forms(x)[0][0])})
    stats = cut(_statistics(df, corpus_text_col, parts))
    counts = {(r["kind"], r["at"]): r["n"] for r in stats.where("kind < 3").groupBy("kind", "at").agg(F.sum("n").alias("n")).collect()}
    lexis = Lexis(labelled, {p: counts.get((1, i), 0) for i, p in enumerate(parts)}, counts.get((2, 0), 0))
    others = [r["text"] for r in stats.where("kind = 3").select("at", "text").distinct().orderBy("at", "text").limit(OTHERS).collect()]
    return fit_field(reviewed + [(t, "none") for t in harmless(reviewed, others, lexis)], lexis)


def find_spans(text: str, field: Field, least: float = LEAST) -> list[tuple[int, int, str]]:
    """(start, end, category): runs of tokens of a sentence that reach ``least`` in a category."""
    out, at = [], 0
    for end in [m.end() for m in _SENTENCE.finditer(text)] + [len(text)]:
        tokens = split_tokens(text[at:end])
        p = field.marginals([[t for t, _, _ in tokens]])[0]
        k = int(p[:, 1:].max(axis=0).argmax()) + 1 if len(p) else 0
        run = None
        for (_, a, z), x in zip(tokens, p[:, k] if k else ()):
            if x >= least:
                run = (run[0] if run else at + a, at + z)
            elif run:
                out.append((*run, CATEGORIES[k - 1]))
                run = None
        if run:
            out.append((*run, CATEGORIES[k - 1]))
        at = end
    return out


def score_documents(df: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, abuse, hate, sexual: 0 to 1, spans: start, end, category) of every row.

    A null or empty text scores 0 with no spans; rows that occur twice come out
    twice; other columns are left out. No shuffle; the field that is broadcast has the size of its
    labelled rows, whatever the data.
    """
    shared = df.sparkSession.sparkContext.broadcast(field)
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    kind = src.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("category", pa.string())])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores, spans = np.zeros((batch.num_rows, 3)), [[] for _ in range(batch.num_rows)]
            texts, rows, lists, size = batch.column(1).to_pylist(), [], [], 0

            def judge() -> None:
                scores[rows] = shared.value.best(lists)
                for i in rows:
                    if scores[i].max() >= LEAST:
                        spans[i] = [{"start": a, "end": z, "category": c} for a, z, c in find_spans(texts[i], shared.value)]

            for i, t in enumerate(texts):
                if t:
                    rows.append(i)
                    lists.append(tokens_and_breaks(t))
                    size += len(t)
                if size > 1_000_000:
                    judge()
                    rows, lists, size = [], [], 0
            if rows:
                judge()
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(scores[:, k]) for k in range(3)), pa.array(spans, pa.list_(span))], ["doc_id", *CATEGORIES, "spans"])

        return step

    return map_batches(src, make, f"doc_id {kind}, abuse double, hate double, sexual double, spans array<struct<start:int,end:int,category:string>>")


def flagged(scores: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, category): the categories that a document reaches."""
    over = F.filter(F.array(*(F.when(F.col(c) >= least, F.lit(c)) for c in CATEGORIES)), lambda x: x.isNotNull())
    return scores.select("doc_id", F.explode(over).alias("category"))


def source_rates(df: DataFrame, scores: DataFrame, id_col: str = "doc_id", source_col: str = "source", least: float = LEAST) -> DataFrame:
    """(source, docs, rate of each category); rows without a source form one of their own."""
    both = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source")).distinct().join(scores.drop("spans"), "doc_id")
    return both.groupBy("source").agg(F.count("*").alias("docs"), *(F.round(F.avg(F.when(F.col(c) >= least, 1.0).otherwise(0.0)), 6).alias(f"{c}_rate") for c in CATEGORIES))
