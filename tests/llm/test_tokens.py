import random

import pyarrow as pa
import pytest
import regex
from cadenza.llm import tokens
from cadenza.llm.codepoints import utf8
from cadenza.llm.pretoken import pretokens
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
TEXTS = ["", None, " ", "\n\n", "Hello world's  end\r\n\tx = 1_000;", "naïve Ⅻ ２３ 語語　語", "<|endoftext|> a", "'" * 9 + "s 're 'll", "x" * 30_000, "é" * 7 + "﻿", "  \n  a", "it's 'tis we'll"]


def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("doc_id", "text", "doc_id as block", "text as words")


def test_pretokens_follow_the_pattern():
    pattern = regex.compile(P.PATTERN)
    rng = random.Random(5)
    parts = ["'", "s", "'re", "'ll", "'v", "e", " ", "  ", "\n", "\t", "a", "é", "1", "２", "!", "''", " '", " ", "　", "語", "'d", "t", "\x1c", "\x85"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(20_000)]
    words, counts = pretokens(*utf8(pa.array(texts)))
    words, at = [w.decode() for w in words.to_pylist()], 0
    for t, n in zip(texts, counts, strict=True):
        assert words[at : at + n] == pattern.findall(t)
        at += n


def test_ids(spark):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab \n'sé1_(") for _ in range(rng.randint(0, 300))) for _ in range(200)]
    got = dict(map(tuple, tokens.token_ids(frame(spark, texts).repartition(3)).collect()))
    want = reference()(texts)
    assert [got[i] for i in range(len(texts))] == want
    counts = dict(map(tuple, tokens.token_counts(frame(spark, texts)).collect()))
    assert [counts[i] for i in range(len(texts))] == [len(x) for x in want]


@pytest.mark.parametrize("room", [1, 200, 5000])
def test_many_blocks(spark, room):
    """Blocks hold no more than their room, or one text; words of the vocabulary and others meet in every block."""
    texts = ["some wörds here %d qqzxv" % (i % 7) for i in range(300)] + ["", None, "zqx" * 700, "zqx"]
    df = frame(spark, texts).repartition(5).select("doc_id", "text")
    rows = df.select("doc_id", F.coalesce("text", F.lit(""))).mapInArrow(tokens._blocks(tokens.vocabulary_path(), room), "block bigint, docs array<bigint>, counts array<int>, n bigint, codes binary, words array<binary>")
    size = {i: len((t or "").encode()) for i, t in enumerate(texts)}
    blocks = [list(r.docs) for r in rows.select("docs").collect()]
    assert sorted(i for b in blocks for i in b) == list(range(len(texts)))
    assert all(sum(size[i] for i in b) <= room or len([i for i in b if size[i]]) == 1 for b in blocks)
    want = reference()(texts)
    got = dict(map(tuple, tokens._word_shuffle(df, "doc_id", "text", tokens.vocabulary_path(), False, room).collect()))
    assert [got[i] for i in range(len(texts))] == want
    counts = dict(map(tuple, tokens._word_shuffle(df, "doc_id", "text", tokens.vocabulary_path(), True, room).collect()))
    assert [counts[i] for i in range(len(texts))] == [len(x) for x in want]


def test_round_trip(spark):
    ids = tokens.token_ids(frame(spark, TEXTS))
    got = dict(map(tuple, tokens.token_texts(ids).collect()))
    assert [got[i] for i in range(len(TEXTS))] == [t or "" for t in TEXTS]


def test_empty_table_and_repeats(spark):
    assert tokens.token_ids(frame(spark, ["a"]).limit(0)).count() == 0
    df = frame(spark, ["a b"])
    assert [list(r.ids) for r in tokens.token_ids(df.union(df)).collect()] == reference()(["a b"] * 2)
