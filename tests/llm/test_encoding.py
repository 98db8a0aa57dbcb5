import os

import pytest

from pressmill.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
JSON = "/opt/tokenizers/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="the public vocabulary is not here")

TEXTS = ["", " ", "Hello world", "it's 'LL don't", "<|endoftext|> is text", "a" * 5000, "　 \n\n  x", "🙂👩‍👩‍👧 ok", "x\x1cy \x85 z q", "²½Ⅷ 12,5%", "नमस्ते दुनिया", "東京は日本", "\t\r\n\r\n end  "]


def expected(text):
    t = tokenizers.Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return t.encode(text, add_special_tokens=False).ids


def test_perfect_hash_has_every_key_and_no_stranger():
    keys = [str(i).encode() for i in range(1000)]
    h = bpe.PerfectHash(keys, list(range(1000)))
    assert [h.get(k) for k in keys] == list(range(1000))
    assert sorted(h.keys) == sorted(keys)
    assert h.get(b"stranger") == -1
    assert bpe.PerfectHash([], []).get(b"x") == -1


def test_encoder_equals_the_public_library():
    enc = bpe.Encoder(bpe.load_table())
    for t in TEXTS:
        assert enc.encode(t).tolist() == expected(t)


def test_round_trip():
    back = {v: k for k, v in bpe.read_ranks(bpe.VOCABULARY).items()}
    enc = bpe.Encoder(bpe.load_table())
    for t in TEXTS:
        assert b"".join(back[i] for i in enc.encode(t)).decode() == t


def test_frame_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(0, "", "x", 1), (99, None, None, None), (None, "a b", None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, pieces int")
    got = {}
    for r in bpe.encode_texts(df).collect():
        got.setdefault(r["doc_id"], []).append(list(r["ids"]))
    assert got[0] == [[], []] and got[99] == [[]] and got[None] == [expected("a b")]
    for i, t in enumerate(TEXTS[1:], 1):
        assert got[i] == [expected(t)]
    assert bpe.encode_texts(df.limit(0)).count() == 0
