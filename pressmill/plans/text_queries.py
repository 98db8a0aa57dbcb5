"""Queries on text and spans, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressmill.functions import patterns, text
from pressmill.operators import providers, references, spans
from pressmill.sources.tables import table

_Q: dict = {}
_SQL: dict[str, str] = {}


def _register(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _names(spark, d):
    return table(spark, d, "companies").where("name IS NOT NULL")


def _sql_umlauts(c: str) -> str:
    for a, b in text.UMLAUTS.items():
        c = f"replace({c}, '{a}', '{b}')"
    return c


_LEGAL = text.legal_pattern()


@_register(f"SELECT symbol, {_sql_umlauts('name')} AS folded FROM companies WHERE name IS NOT NULL")
def r13_umlauts(spark, d):
    return _names(spark, d).select("symbol", text.umlauts(F.col("name")).alias("folded"))


@_register(f"SELECT symbol, translate(name, '{text.ACCENTED}', '{text.PLAIN}') AS folded FROM companies WHERE name IS NOT NULL")
def r14_accents(spark, d):
    return _names(spark, d).select("symbol", text.plain_accents(F.col("name")).alias("folded"))


@_register("SELECT doc_id, md5(translate(text, '" + text.FANCY_QUOTES + "', '" + text.PLAIN_QUOTES.replace("'", "''") + "')) AS plain FROM documents WHERE text IS NOT NULL")
def r15_quotes(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(text.plain_quotes(F.col("text"))).alias("plain"))


@_register("SELECT node_id, regexp_replace(comp_name, '[,()]+', '', 'g') AS plain FROM company_nodes WHERE comp_name IS NOT NULL")
def r16_name_marks(spark, d):
    return table(spark, d, "company_nodes").where("comp_name IS NOT NULL").select("node_id", text.without_name_marks(F.col("comp_name")).alias("plain"))


@_register()
def r17_clean_name(spark, d):
    return _names(spark, d).select("symbol", text.clean_name(F.col("name")).alias("plain"))


@_register(f"SELECT symbol, trim(CASE WHEN regexp_extract(name, '{_LEGAL}', 1) <> '' THEN regexp_extract(name, '{_LEGAL}', 1) ELSE name END) AS short, regexp_extract(name, '{_LEGAL}', 2) AS legal FROM companies WHERE name IS NOT NULL")
def r18_name_and_legal(spark, d):
    return _names(spark, d).select("symbol", text.name_without_legal(F.col("name")).alias("short"), text.legal_form(F.col("name")).alias("legal"))


@_register("SELECT symbol, array_to_string(list_filter(regexp_split_to_array(trim(regexp_replace(name, '([^A-Za-z0-9À-ÿ.\\s])', ' \\1 ', 'g')), '\\s+'), lambda x: x <> ''), '|') AS terms FROM companies WHERE name IS NOT NULL")
def r19_name_terms(spark, d):
    return _names(spark, d).select("symbol", F.array_join(text.name_terms(F.col("name")), "|").alias("terms"))


@_register("SELECT symbol, split_part(name, ' ', 1) AS head FROM companies WHERE regexp_matches(split_part(name, ' ', 1), '^\\s*[A-ZÄÖÜ]\\.[A-ZÄÖÜ]\\.\\s*$')")
def r20_initials(spark, d):
    head = F.split_part(F.col("name"), F.lit(" "), F.lit(1))
    return _names(spark, d).where(text.is_initials(head)).select("symbol", head.alias("head"))


@_register("SELECT symbol, 'SYMB_' || replace(replace(symbol, '.', '_DOT_'), '-', '_DASH_') AS coded, symbol AS back FROM companies")
def r21_symbol_codec(spark, d):
    coded = text.symbol_to_name(F.col("symbol"))
    return table(spark, d, "companies").select("symbol", coded.alias("coded"), text.name_to_symbol(coded).alias("back"))


@_register("""WITH n AS (SELECT sent_id, list(ent_text ORDER BY first) AS names FROM (SELECT sent_id, ent_text, min(mention_id) AS first FROM mentions WHERE ent_text <> '' AND sent_id IS NOT NULL GROUP BY ALL) GROUP BY sent_id)
  SELECT s.sent_id, coalesce(list_reduce(n.names, lambda t, x: replace(t, x, 'Comp@Name@Placeholder'), s.sent_text), s.sent_text) AS masked FROM sentences s JOIN n USING (sent_id)""")
def r12_mask_names(spark, d):
    first = table(spark, d, "mentions").where("ent_text <> '' AND sent_id IS NOT NULL").groupBy("sent_id", "ent_text").agg(F.min("mention_id").alias("first"))
    names = first.groupBy("sent_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "ent_text"))), lambda x: x["ent_text"]).alias("names"))
    s = table(spark, d, "sentences").select("sent_id", "sent_text").join(names, "sent_id")
    return s.select("sent_id", text.mask_all(F.col("sent_text"), F.col("names")).alias("masked"))


@_register("SELECT DISTINCT w FROM (SELECT unnest(regexp_split_to_array(sent_text, '[\\s,;\\-]+')) AS w FROM sentences) WHERE regexp_full_match(w, '[A-Za-z]{3,}') AND length(replace(w, w[1], '')) > 0")
def r8_plain_words(spark, d):
    w = table(spark, d, "sentences").select(F.explode(F.split("sent_text", r"[\s,;\-]+")).alias("w"))
    return w.where(text.is_plain_word(F.col("w"))).distinct()


@_register("SELECT sent_id, len(list_filter(list_transform(regexp_split_to_array(sent_text, '[\\s,;\\-]+'), lambda w: regexp_replace(w, '\\.$', '')), lambda w: w <> '')) AS words FROM sentences WHERE sent_text IS NOT NULL")
def r30_tokens(spark, d):
    return table(spark, d, "sentences").where("sent_text IS NOT NULL").select("sent_id", F.size(text.words(F.col("sent_text"))).cast("bigint").alias("words"))


@_register("SELECT mention_id, strpos(s.sent_text, m.ent_text) AS pos FROM mentions m JOIN sentences s USING (sent_id) WHERE m.ent_text <> '' AND s.sent_text IS NOT NULL")
def j7_locate_mentions(spark, d):
    m = table(spark, d, "mentions").where("ent_text <> ''").select("mention_id", "sent_id", "ent_text")
    s = table(spark, d, "sentences").where("sent_text IS NOT NULL").select("sent_id", "sent_text")
    return m.join(s, "sent_id").select("mention_id", F.instr("sent_text", F.col("ent_text")).cast("bigint").alias("pos"))


@_register("""WITH m AS (SELECT DISTINCT mention_id, art_id, start_char, end_char, set_in FROM mentions WHERE comp_symbol IS NOT NULL)
  SELECT a.mention_id, b.mention_id AS other FROM m a JOIN m b ON a.art_id = b.art_id AND a.start_char < b.end_char AND a.end_char > b.start_char AND a.mention_id < b.mention_id""")
def j4_overlapping_spans(spark, d):
    m = table(spark, d, "mentions").where("comp_symbol IS NOT NULL").select("mention_id", "art_id", "start_char", "end_char").distinct()
    return spans.overlapping(m, m, "art_id").where("mention_id < o_mention_id").select("mention_id", F.col("o_mention_id").alias("other"))


@_register("""WITH m AS (SELECT DISTINCT mention_id, art_id, start_char, end_char, ent_text, set_in FROM mentions),
  h AS (SELECT * FROM m WHERE set_in NOT LIKE '%coref%'), c AS (SELECT * FROM m WHERE set_in LIKE '%coref%' AND len(string_split(ent_text, ' ')) <= 6 AND NOT list_has_any(string_split(lower(ent_text), ' '), ['er','unserer','uns','unsere','wir','unseren','unser']))
  SELECT c.mention_id, count(h.mention_id) AS heads FROM c LEFT JOIN h ON h.art_id = c.art_id AND h.end_char <= c.start_char GROUP BY c.mention_id""")
def r9_coref_heads(spark, d):
    m = table(spark, d, "mentions").select("mention_id", "art_id", "start_char", "end_char", "ent_text", "set_in").distinct()
    excluded = F.array(*map(F.lit, text.EXCLUDED_PRONOUNS))
    split = F.split(F.lower("ent_text"), " ")
    c = m.where(F.col("set_in").contains("coref") & (F.size(split) <= 6) & ~F.arrays_overlap(split, excluded))
    h = m.where(~F.col("set_in").contains("coref")).select("art_id", F.col("mention_id").alias("h"), F.col("end_char").alias("h_end"))
    return c.join(h, (c["art_id"] == h["art_id"]) & (F.col("h_end") <= F.col("start_char")), "left").groupBy("mention_id").agg(F.count("h").alias("heads"))


def _reference_tables(spark, d):
    """Texts, company spans and clusters; the mentions of a company in an article are a cluster, the first its head."""
    texts = table(spark, d, "articles").where("art_text IS NOT NULL").select(F.col("art_id").alias("doc_id"), F.col("art_text").alias("text")).distinct()
    m = table(spark, d, "mentions").where("comp_symbol IS NOT NULL AND start_char < end_char").select(F.col("art_id").alias("doc_id"), F.col("start_char").alias("start"), F.col("end_char").alias("end"), "ent_text", "comp_symbol", "comp_name", "set_in").distinct()
    one = m.groupBy("doc_id", "comp_symbol").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("c"))
    return texts, m.where("NOT contains(coalesce(set_in, ''), 'coref')"), one.groupBy("doc_id").agg(F.collect_list("c").alias("clusters"))


@_register("""WITH a AS (SELECT DISTINCT art_id, art_text FROM articles WHERE art_text IS NOT NULL), m AS (SELECT DISTINCT art_id, start_char, end_char, comp_symbol, comp_name, coalesce(set_in, '') AS set_in FROM mentions WHERE comp_symbol IS NOT NULL AND start_char < end_char),
  i AS (SELECT DISTINCT m.art_id, m.comp_symbol AS c, m.start_char, m.end_char, substr(a.art_text, m.start_char + 1, m.end_char - m.start_char) AS t FROM m JOIN a USING (art_id)),
  w AS (SELECT *, list_filter(regexp_split_to_array(lower(t), '\\s+'), lambda x: x <> '') AS words FROM i), h AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY art_id, c ORDER BY start_char, end_char) = 1),
  e AS (SELECT DISTINCT h.art_id, h.c, m.comp_symbol, m.comp_name FROM h JOIN m ON m.art_id = h.art_id AND m.start_char < h.end_char AND m.end_char > h.start_char WHERE NOT contains(m.set_in, 'coref') AND len(h.words) <= 6)
  SELECT DISTINCT w.art_id, w.start_char AS start, w.end_char AS "end", w.t AS text, e.comp_symbol, e.comp_name FROM w JOIN e ON e.art_id = w.art_id AND e.c = w.c WHERE NOT list_has_any(w.words, ['er','unserer','uns','unsere','wir','unseren','unser'])""")
def r9_spread_references(spark, d):
    """Clusters whose head touches a company's span are spread to all their mentions."""
    return references.spread(*_reference_tables(spark, d)).select(F.col("doc_id").alias("art_id"), "start", "end", "text", "comp_symbol", "comp_name")


@_register()
def r10_model_references(spark, d):
    """One request an article to a provider, here the stand-in; its quotations located and joined to their companies."""
    texts, entities, _ = _reference_tables(spark, d)
    return references.model_references(texts, entities, references.FirstWords).select(F.col("doc_id").alias("art_id"), "start", "end", "text", "label", "comp_symbol", "comp_name")


@_register("SELECT DISTINCT m.mention_id, c.symbol FROM mentions m JOIN companies c ON m.ent_text = c.name")
def r7_attach_by_name(spark, d):
    m = table(spark, d, "mentions").select("mention_id", F.col("ent_text").alias("name")).distinct()
    return m.join(table(spark, d, "companies"), "name").select("mention_id", "symbol").distinct()


@_register("""SELECT s.sent_id, s.art_id, count(DISTINCT m.comp_symbol) AS companies, string_agg(DISTINCT m.comp_symbol, '|' ORDER BY m.comp_symbol) AS symbols FROM sentences s JOIN mentions m ON m.sent_id = s.sent_id WHERE m.comp_symbol IS NOT NULL GROUP BY s.sent_id, s.art_id""")
def r2_sentences_with_company(spark, d):
    m = table(spark, d, "mentions").where("comp_symbol IS NOT NULL").select("sent_id", "comp_symbol").distinct()
    s = table(spark, d, "sentences").select("sent_id", "art_id").join(m, "sent_id")
    return s.groupBy("sent_id", "art_id").agg(F.count("*").alias("companies"), F.array_join(F.sort_array(F.collect_list("comp_symbol")), "|").alias("symbols"))


@_register("""WITH a AS (SELECT DISTINCT art_id, art_text FROM articles WHERE art_text IS NOT NULL), c AS (SELECT symbol, name FROM companies WHERE length(name) > 0)
  SELECT a.art_id, c.symbol, CAST(strpos(a.art_text, c.name) - 1 AS INTEGER) AS first FROM a JOIN c ON contains(a.art_text, c.name)""")
def r3_dictionary_match(spark, d):
    articles = table(spark, d, "articles").select("art_id", "art_text").distinct()
    hits = spans.match_dictionary(articles, table(spark, d, "companies"), "art_id", "art_text", "symbol", "name")
    return hits.groupBy(F.col("id").alias("art_id"), F.col("key").alias("symbol")).agg(F.min("start").alias("first"))


@_register("""WITH c AS (SELECT symbol, split_part(name, ' ', 1) AS head FROM companies WHERE length(split_part(name, ' ', 1)) >= 5),
  t AS (SELECT DISTINCT sent_id, unnest(regexp_extract_all(sent_text, '[A-Za-zÄÖÜäöüß]+-[A-Za-zÄÖÜäöüß]+')) AS token FROM sentences)
  SELECT DISTINCT t.sent_id, t.token, c.symbol FROM t JOIN c ON split_part(t.token, '-', 1) = c.head""")
def r4_token_parts(spark, d):
    head = F.split_part(F.col("name"), F.lit(" "), F.lit(1))
    c = table(spark, d, "companies").select("symbol", head.alias("head")).where("length(head) >= 5")
    t = table(spark, d, "sentences").select("sent_id", F.explode(F.regexp_extract_all("sent_text", F.lit("[A-Za-zÄÖÜäöüß]+-[A-Za-zÄÖÜäöüß]+"), F.lit(0))).alias("token")).distinct()
    return t.withColumn("head", F.split_part(F.col("token"), F.lit("-"), F.lit(1))).join(c, "head").select("sent_id", "token", "symbol").distinct()


@_register()
def r6_resolve_spans(spark, d):
    m = table(spark, d, "mentions").where("comp_symbol IS NOT NULL")
    own = F.col("set_in").contains("own_regex")
    s = m.select(F.col("art_id").alias("doc_id"), F.col("start_char").alias("start"), F.col("end_char").alias("end"), F.col("comp_symbol").alias("symbol"), own.alias("own"), (~own).alias("candidate"))
    return spans.resolve_spans(s)


def _entity_patterns(spark, d):
    """(symbol, anchor, in_text, in_word) of every company.

    Kinds of words come from data: words of at least a two-hundredth of the names are trades, those that sentences
    write small are common, parts of legal forms are legal; each name brings the kinds of its own words with it.
    """
    named = _names(spark, d).select("symbol", text.name_terms(text.name_without_legal(F.col("name"))).alias("terms"), text.legal_form(F.col("name")).alias("legal"))
    words = named.select("symbol", F.explode(F.array_distinct(F.transform("terms", F.lower))).alias("w"))
    trades = words.groupBy("w").agg(F.count("*").alias("n")).crossJoin(F.broadcast(named.agg(F.count("*").alias("names")))).where(F.col("n") * 200 >= F.col("names")).select("w", F.lit(True).alias("trade"))
    small = table(spark, d, "sentences").select(F.explode(F.regexp_extract_all("sent_text", F.lit(r"(?U)\b\p{Ll}[\p{L}\d]*"), F.lit(0))).alias("w")).distinct().withColumn("common", F.lit(True))
    kinds = words.join(trades, "w", "left").join(small.hint("merge"), "w", "left").groupBy("symbol").agg(F.collect_list(F.when(F.col("trade"), F.col("w"))).alias("trades"), F.collect_list(F.when(F.col("common"), F.col("w"))).alias("common"))
    return patterned(named.join(kinds, "symbol", "left"))


def patterned(named):
    """Patterns of names: symbol, terms, legal, trades, common."""
    import pyarrow as pa

    from pressmill.functions.entity_patterns import Lexicons, make_patterns
    from pressmill.plans.arrow import map_batches

    def make():
        legal = frozenset(w.strip("().") for f in text.LEGAL_FORMS for w in f.lower().split())

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = []
            for symbol, terms, form, trades, common in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if terms:
                    made += [(s, terms[0].lower(), x, y) for s, x, y in make_patterns([(symbol, terms, form or None)], Lexicons(industry=frozenset(trades or ()), common=frozenset(common or ()) - frozenset(trades or ()), legal=legal))]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in made], pa.string()) for i in range(4)], ["symbol", "anchor", "in_text", "in_word"])

        return step

    return map_batches(named.select("symbol", "terms", "legal", "trades", "common"), make, "symbol string, anchor string, in_text string, in_word string")


@_register()
def r24_entity_patterns(spark, d):
    """A pattern for texts and one for words of every company."""
    return _entity_patterns(spark, d).select("symbol", "in_text", "in_word")


@_register()
def r3_pattern_match(spark, d):
    """Every company's pattern applied to every article."""
    articles = table(spark, d, "articles").select("art_id", "art_text").distinct()
    return spans.match_patterns(articles, _entity_patterns(spark, d), "art_id", "art_text", "symbol", "anchor", "in_text").select(F.col("id").alias("art_id"), F.col("key").alias("symbol"), "start", "end")


@_register()
def r4_token_match(spark, d):
    """Every company's pattern for words applied to the hyphenated words of every article."""
    articles = table(spark, d, "articles").select("art_id", "art_text").distinct()
    return spans.match_patterns(articles, _entity_patterns(spark, d), "art_id", "art_text", "symbol", "anchor", "in_word", within_word=True).select(F.col("id").alias("art_id"), F.col("key").alias("symbol"), "start", "end")


@_register()
def v29_topics_by_rule(spark, d):
    return providers.classify(table(spark, d, "sentences"), lambda: providers.KeywordTopics(providers.KEYWORDS), "sent_id", "sent_text")


@_register()
def j3_fuzzy_best(spark, d):
    return spans.fuzzy_best(table(spark, d, "company_nodes"), table(spark, d, "companies"), "comp_name", "symbol", "name")


@_register("""WITH s AS (SELECT art_id, sent_text, count(*) AS n FROM sentences WHERE length(sent_text) > 0 AND art_id IS NOT NULL GROUP BY ALL) SELECT art_id, sent_text, n FROM s WHERE n > 1""")
def rx_duplicate_sentences(spark, d):
    s = table(spark, d, "sentences").where("length(sent_text) > 0 AND art_id IS NOT NULL")
    return s.groupBy("art_id", "sent_text").agg(F.count("*").alias("n")).where("n > 1")


@_register("""WITH p AS (SELECT sent_id, ent_text || chr(1) || comp_name AS pair, min(mention_id) AS first FROM mentions WHERE ent_text <> '' AND comp_name IS NOT NULL AND sent_id IS NOT NULL GROUP BY ALL),
  l AS (SELECT sent_id, list(pair ORDER BY first, pair) AS pairs FROM p GROUP BY sent_id)
  SELECT s.sent_id, list_reduce(l.pairs, lambda t, x: replace(t, split_part(x, chr(1), 1), split_part(x, chr(1), 2)), s.sent_text) AS resolved FROM sentences s JOIN l USING (sent_id) WHERE s.sent_text IS NOT NULL""")
def r38_resolve_by_replace(spark, d):
    """Every mention of a sentence replaced by the name of its company, in order of first occurrence."""
    m = table(spark, d, "mentions").where("ent_text <> '' AND comp_name IS NOT NULL AND sent_id IS NOT NULL")
    first = m.groupBy("sent_id", "ent_text", "comp_name").agg(F.min("mention_id").alias("first"))
    pairs = first.groupBy("sent_id").agg(F.sort_array(F.collect_list(F.struct("first", "ent_text", "comp_name"))).alias("pairs"))
    s = table(spark, d, "sentences").where("sent_text IS NOT NULL").join(pairs, "sent_id")
    return s.select("sent_id", F.aggregate("pairs", F.col("sent_text"), lambda t, x: F.replace(t, x["ent_text"], x["comp_name"])).alias("resolved"))


@_register()
def rx_cleaned_articles(spark, d):
    return table(spark, d, "articles").where("art_text IS NOT NULL").select("art_id", patterns.cleaned(F.col("art_text")).alias("pp_art_text")).distinct()


@_register()
def r1_sentences(spark, d):
    """Sentences of every article by the rule splitter of the core."""
    a = table(spark, d, "articles").where("art_id IS NOT NULL AND art_text IS NOT NULL").select("art_id", "art_text").distinct()
    return a.select("art_id", F.posexplode(text.sentences(F.col("art_text"))).alias("pos", "sentence"))


@_register("SELECT art_id, CAST(len(regexp_extract_all(art_text, '[^.!?]+[.!?]*')) AS BIGINT) AS pieces FROM (SELECT DISTINCT art_id, art_text FROM articles) WHERE length(art_text) > 0")
def r29_plain_sentence_split(spark, d):
    """The split that knows only terminators, for comparison with ``p7_found``."""
    a = table(spark, d, "articles").where("length(art_text) > 0").select("art_id", "art_text").distinct()
    return a.select("art_id", F.size(F.regexp_extract_all("art_text", F.lit("[^.!?]+[.!?]*"), F.lit(0))).cast("bigint").alias("pieces"))


@_register("SELECT node_id, regexp_full_match(comp_name, '[ -~]*') AS is_ascii, length(replace(lower(comp_name), lower(comp_name)[1], '')) = 0 AS all_equal FROM company_nodes WHERE length(comp_name) > 0")
def r37_letter_tests(spark, d):
    n = table(spark, d, "company_nodes").where("length(comp_name) > 0")
    low = F.lower("comp_name")
    return n.select("node_id", F.col("comp_name").rlike("^[ -~]*$").alias("is_ascii"), (F.length(F.replace(low, F.substring(low, 1, 1), F.lit(""))) == 0).alias("all_equal"))


@_register("SELECT mention_id, ent_text, label, start_char, end_char FROM mentions WHERE ent_text <> '' AND label <> ''")
def k10_entity_table(spark, d):
    return table(spark, d, "mentions").where("ent_text <> '' AND label <> ''").select("mention_id", "ent_text", "label", "start_char", "end_char")


@_register("SELECT top_id, string_agg(DISTINCT w, ' ' ORDER BY w) AS joined FROM (SELECT top_id, unnest(regexp_extract_all(lower(top_description), '[a-z]{2,}')) AS w FROM topics) GROUP BY top_id")
def r34_joined_words(spark, d):
    w = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("top_description"), F.lit("[a-z]{2,}"), F.lit(0))))
    return table(spark, d, "topics").where(F.size(w) > 0).select("top_id", F.array_join(w, " ").alias("joined"))


def _find(name: str):
    def query(spark, d):
        f = patterns.found(F.col("text"), name)
        return table(spark, d, "documents").select("doc_id", f.alias("f")).where("size(f) > 0").select("doc_id", F.size("f").cast("bigint").alias("n"), F.array_join("f", "|").alias("hits"))

    return query


def _replace(name: str):
    def query(spark, d):
        return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(patterns.replaced(F.col("text"), name)).alias("clean"))

    return query


def _literal(pattern: str) -> str:
    return pattern.replace("'", "''")


for _name, _pattern in patterns.FIND.items():
    _Q[f"rx_find_{_name}"] = _find(_name)
    _SQL[f"rx_find_{_name}"] = f"SELECT doc_id, len(f) AS n, array_to_string(f, '|') AS hits FROM (SELECT doc_id, regexp_extract_all(text, '{_literal(_pattern)}') AS f FROM documents) WHERE len(f) > 0"
for _name, (_pattern, _by) in patterns.REPLACE.items():
    _Q[f"rx_replace_{_name}"] = _replace(_name)
    _by = _literal(_by).replace("\n", "' || chr(10) || '")
    _SQL[f"rx_replace_{_name}"] = f"SELECT doc_id, md5(regexp_replace(text, '{_literal(_pattern)}', '{_by}', 'g')) AS clean FROM documents WHERE text IS NOT NULL"


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
