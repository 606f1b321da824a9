"""Text to vectors: the embedder interface, a hashing embedder that SQL can express, and batched calls of a client."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_TOKENS = 8191  # a text's tokens beyond this are cut off before it is embedded
BATCH = 100  # texts in one call


def hash_position(token: Column, dim: int = 64) -> Column:
    """The component that a token counts in."""
    return (F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("long") % dim).cast("int")


class HashingEmbedder:
    """Counts of hashed tokens, scaled to length 1: no model, but the interface of one. A text without tokens is null."""

    def __init__(self, dim: int = 64, most: int = MOST_TOKENS):
        self.dim, self.most = dim, most

    def one(self, text: str | None) -> list[float] | None:
        """The vector of one text, on the driver."""
        got = _counts(text, self.dim, self.most)
        return None if got is None else got.tolist()

    def __call__(self, text: Column) -> Column:
        dim, most = self.dim, self.most

        @F.arrow_udf("array<float>")
        def run(texts: pa.Array) -> pa.Array:
            return pa.array([_counts(t, dim, most) for t in texts.to_pylist()], pa.list_(pa.float32()))

        # a deterministic function would be evaluated again by every filter on its result
        return run.asNondeterministic()(text)


_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")  # as the JVM's white space
_places: dict[tuple[str, int], int] = {}


def _counts(text: str | None, dim: int, most: int):
    """Normalised token counts; as ``hash_position`` places them. Positions of tokens are kept per worker."""
    tokens = [t for t in _SPACE.split(text) if t][:most] if text else []
    if not tokens:
        return None
    if len(_places) > 1_000_000:
        _places.clear()
    out = np.zeros(dim)
    for t in tokens:
        at = _places.get((t, dim))
        if at is None:
            at = _places[(t, dim)] = int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dim
        out[at] += 1
    return (out / np.sqrt((out * out).sum())).astype(np.float32)


class Truncation:
    """Texts cut to their first ``most`` tokens. ``make`` opens the tokenizer, an (encode, decode) pair, once per worker."""

    def __init__(self, make: Callable[[], tuple[Callable[[str], list], Callable[[list], str]]], most: int = MOST_TOKENS):
        self.make, self.most = make, most

    def open(self) -> Callable[[str], str]:
        encode, decode = self.make()

        def cut(text: str) -> str:
            if len(text.encode("utf-8", "replace")) <= self.most:  # a token has one byte at least
                return text
            tokens = encode(text)
            return decode(tokens[: self.most]) if len(tokens) > self.most else text

        return cut


class ByteBpe:
    """The tokenizer of a public rank file, for ``Truncation``: lines of a base64 token and its rank."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern

    def __call__(self) -> tuple[Callable[[str], list], Callable[[list], str]]:
        import base64

        import tiktoken

        with open(self.path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return coder.encode_ordinary, coder.decode


class ClientEmbedder:
    """Vectors from an external client: ``make`` opens one per task, which is called with lists of at most 100 texts.

    Null texts are not sent. ``truncation`` cuts texts to what the client takes.
    """

    def __init__(self, make: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = BATCH, truncation: Truncation | None = None):
        self.make, self.batch, self.truncation = make, batch, truncation

    def one(self, text: str | None) -> list[float] | None:
        cut = self.truncation.open() if self.truncation else str
        return None if text is None else list(self.make()([cut(text)])[0])

    def __call__(self, text: Column) -> Column:
        make, size, truncation = self.make, self.batch, self.truncation

        @F.arrow_udf("array<float>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            client, cut = make(), truncation.open() if truncation else str
            for s in batches:
                texts = s.to_pylist()
                out: list = [None] * len(texts)
                at = [i for i, t in enumerate(texts) if t is not None]
                for a in range(0, len(at), size):
                    got = client([cut(texts[i]) for i in at[a : a + size]])
                    if len(got) != len(at[a : a + size]):
                        raise ValueError("the client returned another number of vectors than it was given texts")
                    for i, v in zip(at[a : a + size], got):
                        out[i] = v
                yield pa.array(out, pa.list_(pa.float32()))

        return run.asNondeterministic()(text)


class HttpClient:
    """A client for ``ClientEmbedder``: posts lists of texts to an endpoint that answers {"data": [{"embedding": [...]}, ...]}."""

    def __init__(self, url: str, model: str, key: str, timeout: float = 60):
        self.url, self.model, self.key, self.timeout = url, model, key, timeout

    def __call__(self) -> Callable[[list[str]], list[list[float]]]:
        return self.send

    def send(self, texts: list[str]) -> list[list[float]]:
        import json
        from urllib.request import Request, urlopen

        body = json.dumps({"model": self.model, "input": texts}).encode()
        with urlopen(Request(self.url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"}), timeout=self.timeout) as answer:
            return [d["embedding"] for d in json.load(answer)["data"]]


def embed(df: DataFrame, text: str, embedder=None, out: str = "embedding") -> DataFrame:
    return df.withColumn(out, (embedder or HashingEmbedder())(F.col(text)))
