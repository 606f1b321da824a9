"""Token counts, token budgets, their comparison with reported usage, and the ids of a whole corpus."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavec.llm import bpe

NONE, ALL = "(none)", "(all)"

_counters: dict[str, bpe.Counter] = {}
_encoders: dict[str, bpe.Encoder] = {}


@lru_cache(maxsize=4)
def _shared(sc, path: str):
    """The vocabulary as a broadcast of the driver's file: its size is that of the file's 50,000 entries."""
    v = bpe.Vocabulary.load(path)
    return sc.broadcast((v.tokens, v.merges))


def _path(tokenizer: str | None) -> str:
    return tokenizer or os.path.join(bpe.TOKENIZER_DIR, bpe.VOCABULARY)


def _counter(path: str, shared) -> bpe.Counter:
    if path not in _counters:
        _counters[path] = bpe.Counter(bpe.Vocabulary(*shared.value))
    return _counters[path]


def count_tokens(df: DataFrame, text: str, out: str = "n_tokens", tokenizer: str | None = None) -> DataFrame:
    """``df`` with the exact number of tokens of ``text`` in ``out``, without the text; no shuffle.

    A null or empty text has 0 tokens. A column named like ``out`` is replaced. Repeated rows are counted each.
    """
    path = _path(tokenizer)
    shared = _shared(df.sparkSession.sparkContext, path)
    kept = df.drop(out) if text != out else df
    rest = [f for f in kept.schema.fields if f.name != text]
    kept = kept.select(F.col(f"`{text}`").cast("string").alias("_sv_text"), *(F.col(f"`{f.name}`") for f in rest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, shared)
        for b in batches:
            n = pa.array([counter.text(t) for t in b.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], n], names=[*b.schema.names[1:], out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), f"`{out}` bigint"])
    return kept.mapInArrow(run, schema)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``(key, ids)``: the token ids of every text without special tokens; a null or empty text has an empty list.

    Merges are replayed over the new word types of a block of rows at once (see ``bpe.replay``); a worker keeps the ids of
    the words it has met, so a word type is merged once a worker. Nothing is shuffled and nothing grows with the corpus but
    the result. Every row gives one row, repeated ones too; whole texts are encoded.
    """
    path = _path(tokenizer)
    shared = _shared(df.sparkSession.sparkContext, path)
    rows = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").cast("string").alias("_sv_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = bpe.Encoder(bpe.Vocabulary(*shared.value))
        for b in batches:
            ids, offsets = _encoders[path].block(b.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[key, "ids"])

    return rows.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>")


def clean_lang(lang: Column) -> Column:
    """Language tags in one writing; null, blank and und are und."""
    tag = F.lower(F.trim(lang))
    return F.when(tag.isNull() | (tag == ""), "und").otherwise(tag)


def operation_tokens(operations: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``(seq, source, lang, domain, n_tokens)`` of each Inserted or Changed operation, a repeated row once.

    The texts are counted where they are read; only the narrow rows are shuffled to drop repeated ones. Rows without seq
    count as repeated if all these columns, the id and the text (by 128 bits of hash) agree. Null strings and empty ones have 0 tokens.
    """
    embedded = operations.filter(F.col("op").isin("Inserted", "Changed")).select("seq", "id", "source", clean_lang(F.col("lang")).alias("lang"), "domain", F.xxhash64("string").alias("_h1"), F.xxhash64(F.lit(1), "string").alias("_h2"), "string")
    return count_tokens(embedded, "string", tokenizer=tokenizer).distinct().drop("id", "_h1", "_h2")


def token_budget(counted: DataFrame) -> DataFrame:
    """Totals over the cube of source, lang and domain; ``(all)`` stands for a dimension summed over, ``(none)`` for null.

    The cube is taken of the per-combination totals, so a hot source or domain is one row by then. An empty table gives
    the one row of the grand total, with zeros, as a cube without rows does.
    """
    dims = ("source", "lang", "domain")
    base = counted.groupBy(*(F.coalesce(F.col(c), F.lit(NONE)).alias(c) for c in dims)).agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"), F.sum((F.col("n_tokens") == 0).cast("long")).alias("z"), F.max("n_tokens").alias("m")
    )
    cubed = base.cube(*dims).agg(F.sum("n").alias("n_texts"), F.sum("z").alias("n_empty"), F.sum("t").alias("n_tokens"), F.max("m").alias("max_tokens"))
    return cubed.select(
        *(F.coalesce(F.col(c), F.lit(ALL)).alias(c) for c in dims),
        *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_texts", "n_empty", "n_tokens", "max_tokens")),
    )


def usage_comparison(counted: DataFrame, usage: DataFrame, block: int = 128) -> DataFrame:
    """Each embedding call with the tokens counted in its range of seq beside those it reported.

    ``(request_id, domain, first_seq, last_seq, n_texts, n_tokens, prompt_tokens, ratio)``. A call logged again under its
    request_id counts once, with the largest report; a null or zero report gives a null ratio. Calls without a valid range
    have no texts. Ranges meet operations by blocks of seq (an equi-join), so neither side is broadcast.
    """
    calls = usage.groupBy("request_id").agg(
        F.max("domain").alias("domain"), F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"), F.max(F.nullif(F.col("prompt_tokens"), F.lit(0))).alias("prompt_tokens")
    )
    blocks = calls.filter("first_seq <= last_seq").select("request_id", "first_seq", "last_seq", F.explode(F.sequence(F.floor(F.col("first_seq") / block), F.floor(F.col("last_seq") / block))).alias("_b"))
    texts = counted.select("seq", "n_tokens", F.floor(F.col("seq") / block).alias("_b"))
    hits = blocks.join(texts, "_b").filter("seq between first_seq and last_seq").groupBy("request_id").agg(F.count(F.lit(1)).alias("n_texts"), F.sum("n_tokens").alias("n_tokens"))
    out = calls.join(hits, "request_id", "left").fillna(0, ["n_texts", "n_tokens"])
    return out.select("request_id", "domain", "first_seq", "last_seq", "n_texts", "n_tokens", "prompt_tokens", F.round(F.try_divide(F.col("n_tokens"), F.col("prompt_tokens")), 6).alias("ratio"))
