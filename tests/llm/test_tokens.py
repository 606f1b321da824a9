import base64
import os
import random

import pytest
from pyspark.sql import functions as F

from stratavec.llm import bpe, tokens

SF = "/root/testdata/sf0.001"
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(os.path.join(bpe.TOKENIZER_DIR, "byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rnd = random.Random(1)
    letters = "abc  \n\t'sé́x1²Ⅷ 中文العر\x1c\x85​　🙂-_.,!'ll"
    made = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    return ["", None, " ", "  ", "a" * 5000, "aaaa aaaa " * 50, "<|endoftext|>", "don't 'll  x", *made]


def test_ids_and_counts_equal_the_public_library(reference):
    v, t = bpe.Vocabulary.load(), texts()
    ids, offsets = bpe.Encoder(v).block(t)
    want = [reference.encode_ordinary(x or "") for x in t]
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want
    again = bpe.Encoder(v)  # words known from earlier blocks
    got = []
    for a in range(0, len(t), 100):
        ids, offsets = again.block(t[a : a + 100])
        got += [ids[x:y].tolist() for x, y in zip(offsets, offsets[1:])]
    assert got == want
    counter = bpe.Counter(v)
    assert [counter.text(x) for x in t] == [len(w) for w in want]


def test_ids_decode_to_the_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit(1).alias("ids"))
    v = bpe.Vocabulary.load()
    text = {r.doc_id: r.text for r in docs.collect()}
    got = tokens.encode(docs).collect()
    assert len(got) == len(text)
    for r in got:
        assert "".join(v.tokens[i] for i in r.ids).encode("latin-1").decode() == (text[r.doc_id] or "")


def test_budget_cube_and_edges(spark):
    rows = [(1, "Inserted", "a", "hello world", "s", "EN ", "d"), (1, "Inserted", "a", "hello world", "s", "EN ", "d"), (2, "Changed", None, None, None, None, None), (3, "Deleted", "a", "stray", "s", "en", "d"), (4, "Inserted", "b", "", "s", "en", "d")]
    df = spark.createDataFrame(rows, "seq long, op string, id string, string string, source string, lang string, domain string")
    counted = tokens.operation_tokens(df)
    cube = {(r.source, r.lang, r.domain): (r.n_texts, r.n_empty, r.n_tokens) for r in tokens.token_budget(counted).collect()}
    assert cube[("(all)", "(all)", "(all)")] == (3, 2, 2) and cube[("s", "en", "d")] == (2, 1, 2) and cube[("(none)", "und", "(none)")] == (1, 1, 0)
    assert [(r.source, r.n_tokens) for r in tokens.token_budget(tokens.operation_tokens(df.limit(0))).collect()] in ([], [("(all)", 0)])
    apart = spark.createDataFrame([(None, "Inserted", "a", x, "s", "en", "d") for x in ("one word", "two words", "two words")], df.schema)
    assert tokens.operation_tokens(apart).count() == 2  # without seq, by their texts
    usage = spark.createDataFrame([("r", "d", 1, 4, 2), ("r", "d", 1, 4, 2), ("q", None, 9, 5, 0)], "request_id string, domain string, first_seq long, last_seq long, prompt_tokens long")
    got = {r.request_id: (r.n_texts, r.n_tokens, r.ratio) for r in tokens.usage_comparison(counted, usage).collect()}
    assert got == {"r": (3, 2, 1.0), "q": (0, 0, None)}
