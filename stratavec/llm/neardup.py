"""Near-duplicate texts by a grouped prefix join on word shingles.

Every text becomes the set of its word shingles, ordered from rare to common. Two sets of similarity t must share a
shingle within short prefixes of that order, so only prefixes are joined. Texts whose prefix and size agree form one
group that enters the join once; group pairs are filtered by size and position, then expanded to the distinct shingle sets
of their members and verified exactly. Copies (equal sets) share one class all the way through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratavec.llm.components import components
from stratavec.session import cut

_WORD = re.compile(r"[^\W_]+")
_ASCII = bytes(ord(chr(k).lower()) if k < 128 and chr(k).isalnum() else 32 for k in range(256))  # what _WORD finds in lower-cased ASCII
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Hashes(dict):
    """64-bit hashes of words, kept for the words of a worker."""

    def __missing__(self, word: str | bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word if isinstance(word, bytes) else word.encode("utf-8", "surrogatepass"))
        return h


_words = _Hashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _split(text: str) -> list[str] | list[bytes]:
    """The words of a text, lower-cased; those of ASCII texts as bytes, which is faster."""
    return text.encode().translate(_ASCII).split() if text.isascii() else _WORD.findall(text.lower())


def shingles(texts: list[str | None], width: int, least_words: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row numbers) of the shingles of all texts, rows in order; texts under ``least_words`` words have none."""
    lists = [_split(t) if t else [] for t in texts]
    sizes = np.array([len(w) for w in lists], np.int64)
    total = int(sizes.sum())
    h = np.fromiter(map(_words.__getitem__, chain.from_iterable(lists)), np.uint64, total)
    row = np.repeat(np.arange(len(lists)), sizes)
    if total < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = total - width + 1
    acc = np.zeros(n, np.uint64)
    for k in range(width):
        acc = _mix(acc + h[k : k + n] + np.uint64(0x9E3779B97F4A7C15))
    keep = (row[:n] == row[width - 1 :]) & (sizes[row[:n]] >= least_words)
    return acc[keep], row[:n][keep]


_BLOCKS = 64


def _rank(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes in the same order: exact to 200, then by quarters of a doubling."""
    large = 200 + 4 * np.log2(np.maximum(counts, 200) / 200)
    return np.where(counts <= 200, counts, np.minimum(large, 255)).astype(np.uint8)


def _sketch(df: DataFrame, width: int, least_words: int, bits: int) -> np.ndarray:
    """How often shingles fall into each of 2^bits buckets, over all texts, as one byte a bucket: a fixed size.

    A task adds up its own texts and hands on one byte array per block of buckets (mostly zeros, so it packs well); these
    are added as they stream by, in two levels, so no task holds more than one array for each of its blocks.
    """
    step = (1 << bits) // _BLOCKS

    def row(k: int, salt: int, values: np.ndarray) -> pa.RecordBatch:
        packed = zstandard.compress(values.tobytes(), 1)
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([salt], pa.int32()), pa.array([packed], pa.binary())], names=["k", "salt", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, some = np.zeros(1 << bits, np.uint8), False
        for b in batches:
            h, _ = shingles(b.column(0).to_pylist(), width, least_words)
            at, n = np.unique((h >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
            counts[at] = np.minimum(counts[at] + n, 255)
            some = some or len(at) > 0
        if some:
            salt = int(counts[:4096].sum()) % 16
            for k in range(_BLOCKS):
                yield row(k, salt, counts[k * step : (k + 1) * step])

    def add(kind, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for k, part in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                    got = np.frombuffer(zstandard.decompress(part), kind)
                    sums[k] = sums[k] + got if k in sums else got.astype(np.int64)
            for k, total in sums.items():
                yield row(k, 0, _rank(total) if last else total)

        return run

    kinds = "k int, salt int, n binary"
    parts = df.select("_text").mapInArrow(run, kinds)
    if df.sparkSession.sparkContext.defaultParallelism > 64:
        parts = parts.repartition(_BLOCKS * 4, "k", "salt").mapInArrow(add(np.uint8, False), kinds)
        summed = parts.repartition(_BLOCKS, "k").mapInArrow(add(np.int64, True), kinds)
    else:
        summed = parts.repartition("k").mapInArrow(add(np.uint8, True), kinds)
    out = np.zeros(1 << bits, np.uint8)
    for got in summed.toLocalIterator():  # _BLOCKS rows, 2^bits bytes in all
        out[got["k"] * step : (got["k"] + 1) * step] = np.frombuffer(zstandard.decompress(got["n"]), np.uint8)
    return out


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed), np.uint8)


class _Packed:
    """Bytes that are broadcast compressed, as every executor keeps a file of them, and arrive as an array."""

    def __init__(self, values: np.ndarray):
        self._packed = zstandard.compress(values.tobytes(), 1)

    def __reduce__(self):
        return _unpacked, (self._packed,)


HOT = 4_096  #: groups of one shingle that meet in one task; the pairs of more are spread by a salt
FEW = 1 << 20  #: keys that are broadcast; more of them are joined by a shuffle
BITS = (22, 27)  #: least and most bits of the sketch, which holds a byte for each value of them
_STEP = 24  # every so many shingles, a partner must meet one more shingle of the prefix


def _prefix(n, t: float):
    """Length of the prefix of a set of n: partners of similarity t share n // _STEP + 1 shingles of theirs with it.

    Sets that share at least a shingles share l of their prefixes of sizes n - a + l, in any common order.
    """
    return n - np.ceil(t * n - 1e-9).astype(np.int64) + 1 + n // _STEP


def _order(h: np.ndarray, row: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places by row, rank and hash: by one key where its part of the hashes tells all of them apart, which is faster."""
    left = 56 - int(row[-1]).bit_length() if len(row) else 0
    if left < 1:
        return np.lexsort((h, rank, row))
    key = (row.astype(np.uint64) << np.uint64(left + 8)) | (rank.astype(np.uint64) << np.uint64(left)) | (h >> np.uint64(64 - left))
    order = np.argsort(key)
    key, found = key[order], h[order]
    return np.lexsort((h, rank, row)) if ((key[1:] == key[:-1]) & (found[1:] != found[:-1])).any() else order


def _ordered(texts: list[str | None], common: np.ndarray, width: int, least_words: int, bits: int):
    """Distinct shingles of each text from rare to common: (rows, starts, sizes, hashes, ranks); rows without any are left out."""
    h, row = shingles(texts, width, least_words)
    rank = common[(h >> np.uint64(64 - bits)).astype(np.int64)]
    order = _order(h, row, rank)
    h, row, rank = h[order], row[order], rank[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row, rank = h[new], row[new], rank[new]
    rows, first, n = np.unique(row, return_index=True, return_counts=True)
    return rows, first, n, h, rank


def _class_of(h: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """128-bit names of whole sets, as pairs of two independent sums over the shingles."""
    parts = [_mix(np.add.reduceat(_mix(h ^ np.uint64(salt)), first) + n.astype(np.uint64) * _M1) for salt in (0xD6E8FEB86659FD93, 0x2545F4914F6CDD1D)]
    return np.stack(parts, axis=1)


def _names(cls: np.ndarray) -> pa.Array:
    """Names as an array of 16 bytes each."""
    ends = np.arange(len(cls) + 1, dtype=np.int32) * 16
    return pa.BinaryArray.from_buffers(pa.binary(), len(cls), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(cls))])


_SIGN = 8  # words of 64 bits in a signature


def _sets(df: DataFrame, counts, width: int, least_words: int, t: float, bits: int) -> DataFrame:
    """(_key, _tag, grp, cls, n, sig) of every text.

    ``grp`` names prefix and size, ``cls`` the whole set; ``sig`` has the parity of the shingles in each of its bits, given
    only at a class's first row in a partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            rows, first, n, h, _ = _ordered(b.column(2).to_pylist(), counts.value, width, least_words, bits)
            if not len(rows):
                continue
            of = np.repeat(np.arange(len(rows)), n)
            cls = _class_of(h, first, n)
            grp, _ = _group_of(h, first, n, of, t)
            bit = (_mix(h ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(55)).astype(np.int64)
            parity = np.bincount(of * (64 * _SIGN) + bit, minlength=len(rows) * 64 * _SIGN).astype(np.uint8) & 1
            fresh = np.array([c not in seen and not seen.add(c) for c in map(tuple, cls.tolist())], bool)
            sig = np.packbits(parity.reshape(len(rows), -1)[fresh], axis=1, bitorder="little").view(np.int64)
            ends = np.concatenate([[0], np.cumsum(np.where(fresh, _SIGN, 0))])
            sigs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sig.reshape(-1)), mask=pa.array(~fresh))
            at = pa.array(rows)
            cols = [b.column(0).take(at), b.column(1).take(at), pa.array(grp.view(np.int64)), _names(cls), pa.array(n.astype(np.int32)), sigs]
            yield pa.RecordBatch.from_arrays(cols, names=["_key", "_tag", "grp", "cls", "n", "sig"])

    return df.mapInArrow(run, "_key bigint, _tag bigint, grp bigint, cls binary, n int, sig array<bigint>")


def _group_of(h: np.ndarray, first: np.ndarray, n: np.ndarray, of: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """The name of prefix and size of each set, and which shingles stand in a prefix."""
    inside = np.arange(len(h)) - first[of] < _prefix(n, t)[of]
    m = _mix(h ^ np.uint64(0xD6E8FEB86659FD93))
    return _mix(np.add.reduceat(np.where(inside, m, np.uint64(0)), first) + n.astype(np.uint64) * _M2), inside


def _postings(df: DataFrame, counts, width: int, least_words: int, t: float, bits: int) -> DataFrame:
    """(tok, grp, n, pos): the prefixes of the groups, once per partition.

    Shingles that stand in no other text come first in a prefix and can meet nobody; they keep their places but are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            rows, first, n, h, rank = _ordered(b.column(0).to_pylist(), counts.value, width, least_words, bits)
            if not len(rows):
                continue
            of = np.repeat(np.arange(len(rows)), n)
            grp, inside = _group_of(h, first, n, of, t)
            fresh = np.array([g not in seen and not seen.add(g) for g in grp.tolist()], bool)
            take = inside & (rank != 1) & fresh[of]
            o = of[take]
            pos = (np.arange(len(h)) - first[of])[take]
            yield pa.RecordBatch.from_arrays([pa.array(h[take].view(np.int64)), pa.array(grp[o].view(np.int64)), pa.array(n[o].astype(np.int32)), pa.array(pos.astype(np.int32))], names=["tok", "grp", "n", "pos"])

    return df.select("_text").mapInArrow(run, "tok bigint, grp bigint, n int, pos int")


def _kept(rows: list[np.ndarray], at: np.ndarray | slice) -> list[np.ndarray]:
    """Some rows of all columns."""
    return [r[at] for r in rows]


def _distinct(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Postings (tok, grp, n, pos) by shingle, size and group, each once."""
    rows = _kept(rows, np.lexsort((rows[1], rows[2], rows[0])))
    new = np.ones(len(rows[0]), bool)
    new[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
    return _kept(rows, new)


def _meetings(rows: list[np.ndarray], end: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(smaller group, larger group, more) of all pairs within a shingle that pass the size and position filters.

    ``rows`` are distinct postings in order, ``end`` the place after the last one of the same shingle.
    """
    _, grp, n, pos = rows
    more = n // _STEP  # the first of two is the smaller set, so both prefixes are long enough for this many more
    x, step = np.flatnonzero(pos < n - np.ceil(2 * t / (1 + t) * n - 1e-9) + 1 + more), 0
    while True:
        step += 1
        x = x[x + step < end[x]]
        x = x[n[x] >= t * n[x + step] - 1e-9]  # sizes grow, so later ones don't fit either
        if not len(x):
            return
        y = x + step
        reach = np.minimum(n[x] - pos[x], n[y] - pos[y]) + more[x] >= np.ceil(t / (1 + t) * (n[x] + n[y]) - 1e-9)
        yield grp[x[reach]], grp[y[reach]], more[x[reach]]


def _meet(t: float, most: int):
    """Postings in order of their shingles to (x, y, p, q, hot): pairs of groups that meet (smaller, larger, 1, more).

    The postings of a shingle of more than ``most`` groups are handed on as (tok, grp, n, pos, true), perhaps repeatedly.
    """

    def batch(x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray, hot: bool) -> pa.RecordBatch:
        cols = [pa.array(x), pa.array(y), pa.array(p.astype(np.int32)), pa.array(q.astype(np.int32)), pa.array(np.full(len(x), hot))]
        return pa.RecordBatch.from_arrays(cols, names=["x", "y", "p", "q", "hot"])

    def hits(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        x, y, more = (np.concatenate(p) for p in zip(*parts))
        return batch(x, y, np.ones(len(x)), more, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hot = [np.zeros(0, k) for k in (np.int64, np.int64, np.int32, np.int32)], None
        for b in chain(batches, [None]):
            if b is None:
                rows, held = held, _kept(held, slice(0, 0))
            elif not b.num_rows:
                continue
            else:
                rows = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, b.columns)]
                if hot is not None and rows[0][0] == hot:  # more of a shingle whose postings went out already
                    same = int(np.searchsorted(rows[0], hot, "right"))
                    yield batch(*_kept(rows, slice(0, same)), True)
                    rows = _kept(rows, slice(same, None))
                    if not len(rows[0]):
                        held = rows
                        continue
                last = int(np.searchsorted(rows[0], rows[0][-1]))  # the last shingle may go on
                rows, held = _kept(rows, slice(0, last)), _kept(rows, slice(last, None))
                if len(held[0]) > most:
                    held = _distinct(held)
                    if len(held[0]) > most:
                        yield batch(*held, True)
                        hot, held = held[0][0], _kept(held, slice(0, 0))
            near = rows[0][1:] == rows[0][:-1]
            rows = _distinct(_kept(rows, np.append(near, False) | np.append(False, near) if len(rows[0]) else slice(0, 0)))
            _, first, size = np.unique(rows[0], return_index=True, return_counts=True)
            if (size > most).any():
                many = np.repeat(size > most, size)
                yield batch(*_kept(rows, many), True)
                rows = _kept(rows, ~many)
                _, first, size = np.unique(rows[0], return_index=True, return_counts=True)
            parts, n = [], 0
            for part in _meetings(rows, np.repeat(first + size, size), t):
                parts.append(part)
                n += len(part[0])
                if n > 1 << 18:
                    yield hits(parts)
                    parts, n = [], 0
            if n:
                yield hits(parts)

    return run


def _full(df: DataFrame, counts, width: int, least_words: int, bits: int) -> DataFrame:
    """(cls, toks): the whole sets of some texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, first, n, h, _ = _ordered(b.column(0).to_pylist(), counts.value, width, least_words, bits)
            if len(rows):
                toks = pa.ListArray.from_arrays(pa.array(np.concatenate([first, [len(h)]]), pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([_names(_class_of(h, first, n)), toks], names=["cls", "toks"])

    return df.select("_text").mapInArrow(run, "cls binary, toks array<bigint>")


def _need(na: Column, nb: Column, t: float) -> Column:
    """Shared shingles that two sets of these sizes need for similarity t."""
    return F.ceil(t / (1 + t) * (na + nb) - 1e-9)


def _whole_rows(df: DataFrame, *names: str) -> DataFrame:
    """The rows, all without nulls here; filtered as joins would filter each side for itself; else their shuffles differ."""
    return df.filter(" and ".join(f"{k} is not null" for k in names or df.columns))


class NearDuplicates:
    """The join of one table of texts: rows by class, and the links between classes."""

    def __init__(self, df: DataFrame, key: str, text: str, tag: Column | None = None, width: int = 5, t: float = 0.8, least_words: int = 1, bits: int | None = None):
        """``bits``: size of the sketch of shingle counts, by default after the length of all texts. ``tag``: rows of equal tag never form a pair. Null keys, null texts and texts under ``least_words`` words or ``width`` words are left out."""
        if not 0 < t <= 1:
            raise ValueError("the similarity must lie in (0, 1]")
        spark = df.sparkSession
        base = df.select(F.col(f"`{key}`").cast("long").alias("_key"), (tag if tag is not None else F.lit(None)).cast("long").alias("_tag"), F.col(f"`{text}`").alias("_text")).filter("_key is not null and _text is not null")
        if bits is None:
            # about a place for two shingles, as words have some six letters; the size changes the cost alone, not the result
            letters = base.agg(F.sum(F.length("_text"))).first()[0] or 0
            bits = min(max(BITS[0], int(letters // 12).bit_length()), BITS[1])
        counts = spark.sparkContext.broadcast(_Packed(_sketch(base, width, least_words, bits)))  # 2^bits bytes, 128 MB at most
        self.t = t
        self._base, self._how = base, (counts, width, least_words, bits)
        self.sets = cut(_sets(base, counts, width, least_words, t, bits))
        #: a repeated row (same key and text) once; together by class, as all joins ask for them
        self.members = _whole_rows(self.sets.select("_key", "_tag", "cls"), "_key", "cls").repartition("cls").dropDuplicates()

    def classes(self) -> DataFrame:
        """One row per distinct shingle set: (cls, grp, n, rep, sig), rep being the key of a row of the class."""
        some = self.sets.filter("sig is not null").groupBy("cls").agg(F.min_by("grp", "_key").alias("grp"), F.min("n").alias("n"), F.min("_key").alias("rep"), F.min_by("sig", "_key").alias("sig"))
        return some.select("cls", "grp", "n", "rep", "sig")

    def group_pairs(self) -> DataFrame:
        """(ga, gb), ga < gb: pairs of groups that pass the prefix, size and position filters."""
        t = self.t
        counts, width, least_words, bits = self._how
        # postings are read once, in order of their shingles; only those of shingles of many groups are kept
        posts = _postings(self._base, counts, width, least_words, t, bits).repartition("tok").sortWithinPartitions("tok")
        met = cut(posts.mapInArrow(_meet(t, HOT), "x bigint, y bigint, p int, q int, hot boolean"))
        hot = met.filter("hot").select(F.col("x").alias("tok"), F.col("y").alias("grp"), F.col("p").alias("n"), F.col("q").alias("pos")).repartition("tok").dropDuplicates(["tok", "grp"])
        hot = hot.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("tok")))
        nx, ny, px, py = F.col("x.n"), F.col("y.n"), F.col("x.pos"), F.col("y.pos")
        more = F.floor(nx / _STEP)  # as in _meetings
        smaller = (nx < ny) | ((nx == ny) & (F.col("x.grp") < F.col("y.grp")))
        indexed = px < nx - F.ceil(2 * t / (1 + t) * nx - 1e-9) + 1 + more
        reach = F.least(nx - px, ny - py) + more >= _need(nx, ny, t)
        passed = smaller & indexed & (nx >= t * ny - 1e-9) & reach
        # a shingle of many groups: one side is dealt out by a salt, the other stands at every salt
        salts = F.ceil(F.col("m") / HOT)
        dealt = hot.withColumn("s", F.pmod(F.col("grp"), salts))
        every = hot.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
        common = every.alias("x").join(dealt.alias("y"), (F.col("x.tok") == F.col("y.tok")) & (F.col("x.s") == F.col("y.s")) & passed)
        hits = met.filter("not hot").select(F.col("x").alias("gx"), F.col("y").alias("gy"), F.col("q").cast("long").alias("more"))
        hits = hits.union(common.select(F.col("x.grp").alias("gx"), F.col("y.grp").alias("gy"), more.alias("more")))
        pairs = hits.groupBy("gx", "gy").agg(F.count(F.lit(1)).alias("k"), F.max("more").alias("more"))
        return pairs.filter("k > more").select(F.least("gx", "gy").alias("ga"), F.greatest("gx", "gy").alias("gb"))

    def links(self) -> DataFrame:
        """(ca, cb, similarity), ca < cb: all pairs of different classes with similarity t or more.

        Pairs that their signatures rule out (shared shingles are at most (na + nb - differing bits) / 2) go first; whole
        sets are then made of one text of each remaining class only.
        """
        t = self.t
        c = _whole_rows(self.classes())
        na, nb = F.col("a.n"), F.col("b.n")  # all sides keep their names, so that one shuffle serves them
        differ = sum((F.bit_count(F.col("a.sig")[k].bitwiseXOR(F.col("b.sig")[k])) for k in range(_SIGN)), F.lit(0))
        maybe = (na + nb - differ) >= 2 * _need(na, nb, t)
        sized = F.least(na, nb) >= t * F.greatest(na, nb) - 1e-9
        keep = [F.col(f"{x}.{k}").alias(f"{k}_{x}") for k in ("cls", "rep") for x in "ab"]
        a, b = c.alias("a"), c.alias("b")
        inner = a.join(b, (F.col("a.grp") == F.col("b.grp")) & (F.col("a.cls") < F.col("b.cls"))).filter(maybe & sized).select(*keep)
        outer = self.group_pairs().join(a, F.col("ga") == F.col("a.grp")).join(b, F.col("gb") == F.col("b.grp")).filter(maybe & sized).select(*keep)
        pairs = cut(outer.union(inner))
        wanted = pairs.select(F.explode(F.array("rep_a", "rep_b")).alias("k")).distinct()
        if wanted.count() <= FEW:
            wanted = F.broadcast(wanted)
        texts = self._base.join(wanted, F.col("_key") == F.col("k"), "left_semi")
        counts, width, least_words, bits = self._how
        # one set per class, however often its row is repeated
        whole = _full(texts, counts, width, least_words, bits).repartition("cls").dropDuplicates(["cls"])
        a, b = whole.select(F.col("cls").alias("cls_a"), F.col("toks").alias("ta")), whole.select(F.col("cls").alias("cls_b"), F.col("toks").alias("tb"))
        met = pairs.select("cls_a", "cls_b").join(a, "cls_a").join(b, "cls_b").select("cls_a", "cls_b", F.size("ta").alias("na"), F.size("tb").alias("nb"), F.size(F.array_intersect("ta", "tb")).alias("k"))
        sim = F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))
        return met.filter(F.col("k") >= _need(F.col("na"), F.col("nb"), t)).select(F.least("cls_a", "cls_b").alias("ca"), F.greatest("cls_a", "cls_b").alias("cb"), sim.alias("similarity")).dropDuplicates(["ca", "cb"])

    def pairs(self) -> DataFrame:
        """(key_a, key_b), key_a < key_b: all pairs of rows with similarity t or more and different tags."""
        links = self.links().select("ca", "cb")
        a, b = self.members.alias("a"), self.members.alias("b")
        keep = [F.col(f"{x}.{k}").alias(name + x) for k, name in (("_key", "k"), ("_tag", "g")) for x in "ab"]
        across = links.join(a, F.col("ca") == F.col("a.cls")).join(b, F.col("cb") == F.col("b.cls")).select(*keep)
        same = a.join(b, (F.col("a.cls") == F.col("b.cls")) & (F.col("a._key") < F.col("b._key"))).select(*keep)
        rows = across.union(same).filter("ga is null or gb is null or ga <> gb")
        return rows.select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")).distinct()

    def groups(self) -> DataFrame:
        """(key, class_rep, group_rep, n_links): each row with the smallest key of its class and of its linked group.

        ``n_links`` is the number of other classes that its class is linked to; copies are not expanded into pairs.
        """
        links = cut(self.links().select("ca", "cb"))
        degree = links.select(F.explode(F.array("ca", "cb")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("n_links"))
        roots = components(links, "ca", "cb", "binary").withColumnsRenamed({"v": "cls"})
        rep = self.members.groupBy("cls").agg(F.min("_key").alias("class_rep"))
        per = rep.join(roots, "cls", "left").join(degree, "cls", "left").select("cls", "class_rep", F.coalesce("root", "cls").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
        group = per.groupBy("root").agg(F.min("class_rep").alias("group_rep"))
        return self.members.select("_key", "cls").join(per.join(group, "root"), "cls").select(F.col("_key").alias("key"), "class_rep", "group_rep", "n_links").distinct()


def operation_duplicates(operations: DataFrame) -> NearDuplicates:
    """The join that the change stream asks for: three words, half of the union, at least 20 words, different ids."""
    rows = operations.filter(F.col("op").isin("Inserted", "Changed") & F.col("id").isNotNull())
    return NearDuplicates(rows, "seq", "string", F.xxhash64("id"), width=3, t=0.5, least_words=20)
