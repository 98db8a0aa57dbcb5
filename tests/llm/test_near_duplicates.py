import random

import numpy as np

from pressmill.llm import near_duplicates as nd


def pieces(t):
    s = "".join(c for c in (t or "").lower() if c.isalnum())
    return {s[i : i + 9] for i in range(len(s) - 8)}


def brute(rows, least=0.7):
    known = {}
    for i, t, _ in rows:
        if i is not None and pieces(t):
            known[i] = pieces(t)
    ids = sorted(known)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(known[a] & known[b]) / len(known[a] | known[b]) >= least}


def corpus():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghiklmnoprstuw") for _ in range(rnd.randrange(3, 9)))
    base = [[word() for _ in range(rnd.choice([3, 30, 150]))] for _ in range(25)]
    rows, n = [], 0
    for words in base:
        for edits in (0, 0, 1, 3, 6, 12):
            w = list(words)
            for _ in range(edits * len(words) // 60):
                w[rnd.randrange(len(w))] = word()
            rows.append((n, ("%s. " if edits % 2 else "%s ") % " ".join(w), "x"))
            n += 1
    rows += [rows[0], (900, None, "x"), (901, "", "x"), (902, "short", "x"), (None, rows[0][1], "x"), (903, "y " * 20000, "x"), (904, "Y-" * 20000, "x")]
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    links, member = nd.near_duplicates(spark.createDataFrame(rows, "art_id bigint, art_text string, rep string"))
    got = [(r["a"], r["b"]) for r in nd.expand(links, member).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_frequent_bytes_are_split(spark):
    """With a low bound on hot postings, pairs come out of the salted join all the same."""
    rows = corpus()
    links, member = nd.near_duplicates(spark.createDataFrame(rows, "art_id bigint, art_text string, rep string"), hot=1)
    got = [(r["a"], r["b"]) for r in nd.expand(links, member).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_the_minimum_is_guaranteed():
    """Random sets just at the bound share the tallied number of postings, in any order."""
    rnd = np.random.default_rng(11)
    for _ in range(3000):
        both, only = int(rnd.integers(1, 300)), int(rnd.integers(0, 130))
        if both / (both + only) < 0.7:
            continue
        order = rnd.permutation(both + only)
        cut = int(rnd.integers(0, only + 1))
        a, b = order[np.r_[0:both, both : both + cut].astype(int)], order[np.r_[0:both, both + cut : both + only].astype(int)]
        small, large = sorted((np.sort(a), np.sort(b)), key=len)
        n = np.array([len(small), len(large)])
        posts = [(x, np.arange(p), np.arange(p) * 64 // len(x)) for x, p in zip((small, large), nd.posted(n, 0.7))]
        key, tier = np.concatenate([x[p] for x, p, _ in posts]), np.concatenate([t for _, _, t in posts]).astype(np.uint8)
        met = sum(len(a) for a, _ in nd.meetings(key, tier, np.repeat([0, 1], [len(p) for _, p, _ in posts]), n, np.arange(2), 0.7))
        assert met >= nd.tally_least(len(small))


def test_groups_are_components(spark):
    rows = corpus()
    links, member = nd.near_duplicates(spark.createDataFrame(rows, "art_id bigint, art_text string, rep string"))
    group = {r["id"]: r["group_id"] for r in nd.duplicate_groups(links, member).collect()}
    parent = {i: i for i in group}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in brute(rows):
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert group == {i: root(i) for i in group}


def test_a_class_of_many_copies(spark):
    rows = [(i, "the same text again and again", "x") for i in range(60)] + [(99, "something else entirely here", "x")]
    links, member = nd.near_duplicates(spark.createDataFrame(rows, "art_id bigint, art_text string, rep string"))
    assert links.count() == 0 and member.where("rep = 0").count() == 60
    assert nd.expand(links, member).count() == 60 * 59 // 2


def test_empty_table(spark):
    links, member = nd.near_duplicates(spark.createDataFrame([], "art_id bigint, art_text string"))
    assert nd.expand(links, member).count() == 0


def test_a_bucket_is_tallied_in_bounded_parts():
    """However often texts meet, a part holds a bounded number of meetings, and each pair comes out once with all of them."""
    rnd = np.random.default_rng(2)
    n = rnd.integers(80, 130, 60)
    text, key = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(25)))
    some = rnd.random(len(text)) < 0.6
    text, key, tier = text[some], key[some], np.zeros(some.sum(), np.uint8)
    order = np.empty(60, np.int64)
    order[np.argsort(n, kind="stable")] = np.arange(60)
    parts = list(nd.meetings(key, tier, text, n, order, 0.7, most=40))
    assert len(parts) > 100 and max(len(a) for a, _ in parts) <= 60
    got = [(a, b, c) for part in nd.tallied(parts, 60) for a, b, c in zip(*(x.tolist() for x in part))]
    has = {t: set(key[text == t].tolist()) for t in range(60)}
    true = [(a, b, len(has[a] & has[b])) for a in has for b in has if order[a] < order[b] and n[a] >= 0.7 * n[b] and has[a] & has[b]]
    assert sorted(got) == sorted(true)


def test_a_row_holds_the_postings_of_many_texts(spark):
    """With many buckets a task writes a row for each of them, not one for each text and bucket."""
    texts = [("".join(random.Random(i).choices("abcdefghij", k=300)),) for i in range(200)]
    reps = spark.createDataFrame([(i, t) for i, (t,) in enumerate(texts)], "no bigint, t string").coalesce(1)
    rows = nd._postings(reps, 0.7, nd._census(reps), nd.HOT, 300).collect()
    assert len(rows) <= 300
    n, posts = 0, 0
    for r in rows:
        no, size, per, key, tier = nd._unpack(memoryview(r["block"]))
        assert len(set(no.tolist())) == len(no) and per.sum() == len(key) == len(tier) and all(size == 292)
        n, posts = max(n, no.max()), posts + len(key)
    assert n == 199 and posts == 200 * int(nd.posted(np.array([292]), 0.7)[0])


def test_pairs_that_met_travel_in_blocks(spark):
    """A bucket writes a row for each part of the texts, not one for each pair that met, and no pair is lost in it."""
    texts = [("".join(random.Random(i % 4).choices("abcdefghij", k=200)) + "".join(random.Random(i).choices("abcdefghij", k=150)),) for i in range(60)]
    reps = spark.createDataFrame([(i, t) for i, (t,) in enumerate(texts)], "no bigint, t string")
    counts = nd._census(reps, 4 * nd.SLOTS)
    size = [len(pieces(t)) for (t,) in texts]
    assert len(counts) == 4 * nd.SLOTS and counts.sum() == sum(size)
    rows = nd._met(nd._postings(reps, 0.3, counts, nd.HOT, 8), 0.3, 8, 3).collect()
    pairs = [tuple(x.tolist()) for r in rows for x in [np.stack(nd._unpack_pairs(memoryview(r["block"])), 1)] for x in x]
    met = {(min(a, b), max(a, b)) for a, b, _, _ in pairs}
    assert len(rows) <= 8 * 3 < len(pairs) and met >= {(a, b) for a in range(60) for b in range(a + 1, 60) if a % 4 == b % 4}
    assert all(need == nd.tally_least(min(size[a], size[b])) and shared >= 1 for a, b, need, shared in pairs)
