import random
from collections import defaultdict

from pressmill.llm import site_lines

SCHEMA = "art_id bigint, art_source string, art_text string, docs int"


def brute(rows, least=5):
    where, lines = defaultdict(set), []
    for i, s, t, _ in rows:
        if i is None or s is None or t is None:
            continue
        for n, line in enumerate(t.split("\n"), 1):
            key = "".join(c for c in line.lower() if c.isalpha())
            if len(key) >= 8:
                where[s, key].add(i)
                lines.append((i, n, s, key))
    return {(i, n) for i, n, s, k in lines if len(where[s, k]) >= least}


def corpus():
    rnd = random.Random(3)
    site = ["All rights reserved, no copies", "Share this story!", "- Share this STORY -", "ab 12", "by the newsroom of example"]
    rows = []
    for i in range(120):
        s = "hot" if i % 3 else rnd.choice(["a", "b"])
        own = [f"own line number {'x' * rnd.randrange(9)} {chr(97 + i % 26)}{chr(97 + i // 26)}" for _ in range(3)]
        block = site[:2] if i % 2 else []
        rows.append((i, s, "\n\n".join(own[:1] + block + own[1:] + rnd.sample(site, 2) * (i % 4 > 0)), 1))
    rows += [rows[1], (500, None, site[0], 1), (501, "hot", None, 1), (502, "hot", "", 1), (503, "hot", "\n".join([site[1]] * 50), 1), (None, "hot", site[1], 1)]
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    got = [(r["id"], r["line_no"]) for r in site_lines.repeated_lines(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def longest_blocks(docs, least=5):
    """Brute force: the longest run from each line that enough documents hold, without those one line further left extends."""
    def held(run):
        return sum(any(d[i : i + len(run)] == run for i in range(len(d))) for d in docs)

    out = {}
    for d in docs:
        size = []
        for i in range(len(d)):
            n = 0
            while i + n < len(d) and held(d[i : i + n + 1]) >= least:
                n += 1
            size.append(n)
        for i, n in enumerate(size):
            if n and (i == 0 or size[i - 1] <= n):
                out[tuple(d[i : i + n])] = held(d[i : i + n])
    return sorted((len(k), v) for k, v in out.items())


def test_longest_blocks_of_any_length(spark):
    rnd = random.Random(4)
    long = [f"the line of the long block {chr(97 + i)}" for i in range(20)]
    docs = [[f"own line {chr(97 + k)} opens it"] + (long if k < 6 else long[3:9] if k < 12 else rnd.sample(long, 4)) + (long[:2] if k % 3 == 0 else []) for k in range(16)]
    rows = [(k, "s", "\n".join(d), 1) for k, d in enumerate(docs)]
    got = site_lines.repeated_blocks(spark.createDataFrame(rows + rows[:2], SCHEMA)).collect()
    assert sorted((len(r["block"]), r["docs"]) for r in got) == longest_blocks(docs)
    assert max(len(r["block"]) for r in got) == 20


def test_text_without_the_lines(spark):
    rows = [(i, "s", f"own text {i}\nAll rights reserved here\nmore of it", 1) for i in range(5)] + [(7, "s", None, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    clean = {r["id"]: r["clean_text"] for r in site_lines.without_lines(df, site_lines.repeated_lines(df).where("line_no = 2")).collect()}
    assert clean[0] == "own text 0\nmore of it" and clean[7] is None


def test_empty_table(spark):
    assert site_lines.repeated_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_intervals_of_the_suffixes_hold_blocks_of_several_lines(spark):
    """The common prefix of neighbouring suffixes tells how many lines they share, not the first line only; salts add up to the same."""
    rows = corpus() + [(600 + i, "a", "\n".join(["Follow us on all channels", "Imprint and contact", "Terms of this service", f"own end {chr(97 + i)}"]), 1) for i in range(6)]
    truth = defaultdict(set)
    for i, s, t, _ in rows:
        if i is not None and s is not None and t is not None:
            keys = [k for k in ("".join(c for c in line.lower() if c.isalpha()) for line in t.split("\n")) if len(k) >= 8]
            for a in range(len(keys)):
                for size in range(1, min(site_lines.DEPTH, len(keys) - a) + 1):
                    truth[s, tuple(keys[a : a + size])].add(i)
    true = sorted((s, len(k), len(docs)) for (s, k), docs in truth.items() if len(docs) >= 5)
    assert {size for _, size, _ in true} >= {1, 2, 3}
    df = spark.createDataFrame(rows, SCHEMA)
    whole = site_lines._intervals(site_lines._suffixes(df, "art_id", "art_source", "art_text", 1), 5).collect()
    assert sorted((r["source"], r["size"], r["docs"]) for r in whole) == true
    salted = defaultdict(int)
    for r in site_lines._intervals(site_lines._suffixes(df, "art_id", "art_source", "art_text", 3), 1).collect():
        salted[r["source"], r["size"], r["block"]] += r["docs"]
    assert sorted((s, size, n) for (s, size, _), n in salted.items() if n >= 5) == true


def test_the_same_lines_with_salts(spark, monkeypatch):
    monkeypatch.setattr(site_lines, "SALTED", 30)
    rows = corpus()
    got = [(r["id"], r["line_no"]) for r in site_lines.repeated_lines(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
