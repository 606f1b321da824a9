import pickle
import random

import numpy as np
import pyarrow as pa

from stratavec.llm.components import components
from stratavec.llm.neardup import _WORD, NearDuplicates, _meet, _order, _Packed, _split, operation_duplicates, shingles


def brute(texts, width, t, least):
    sets = {}
    for k, x in texts.items():
        words = __import__("re").findall(r"[^\W_]+", (x or "").lower())
        if len(words) >= max(least, width):
            sets[k] = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12}


def edited(rnd, base):
    w = base.split()
    for _ in range(rnd.randint(0, len(w) // 6)):
        k = rnd.randrange(len(w))
        rnd.choice([lambda: w.insert(k, f"n{rnd.randint(0, 50)}"), lambda: w.pop(k), lambda: w.__setitem__(k, "z")])()
    return " ".join(w)


def corpus(seed=1):
    rnd = random.Random(seed)
    out = []
    for _ in range(40):
        base = " ".join(f"w{rnd.randint(0, 60)}" for _ in range(rnd.randint(18, 120)))
        out += [base, base.upper()] + [edited(rnd, base) for _ in range(4)]
    return dict(enumerate(out + ["", None, "one two", "the same words " * 30, "the same words " * 31]))


def test_pairs_equal_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([*texts.items(), (0, texts[0]), (None, texts[0])], "k long, t string").repartition(5)
    for width, t, least in ((3, 0.5, 20), (5, 0.8, 1), (2, 0.3, 1)):
        got = {tuple(r) for r in NearDuplicates(df, "k", "t", width=width, t=t, least_words=least, bits=16).pairs().collect()}
        assert got == brute(texts, width, t, least)


def test_saturated_sketch_loses_nothing(spark):
    texts = corpus(2)
    df = spark.createDataFrame([*texts.items()], "k long, t string")
    got = {tuple(r) for r in NearDuplicates(df, "k", "t", width=3, t=0.5, bits=6).pairs().collect()}
    assert got == brute(texts, 3, 0.5, 1)


def test_groups_and_tags(spark):
    texts = {k: v for k, v in corpus(3).items() if k < 60}
    df = spark.createDataFrame([*texts.items()], "k long, t string")
    nd = NearDuplicates(df, "k", "t", width=3, t=0.5, bits=16)
    pairs = brute(texts, 3, 0.5, 1)
    root = {k: k for k in texts}
    for _ in range(60):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.key: r.group_rep for r in nd.groups().collect()}
    assert got == {k: r for k, r in root.items() if k in got} and len(got) == 60
    ops = spark.createDataFrame([(1, "Inserted", "a", texts[0]), (2, "Changed", "a", texts[0]), (3, "Inserted", "b", texts[0]), (4, "Deleted", "c", texts[0]), (5, "Inserted", None, texts[0])], "seq long, op string, id string, string string")
    assert {tuple(r) for r in operation_duplicates(ops).pairs().collect()} == {(1, 3), (2, 3)}
    assert operation_duplicates(ops.limit(0)).pairs().count() == 0


def test_shingles_need_width():
    assert len(shingles(["a b", None, "", "a b c"], 3)[0]) == 1


def test_components_of_a_path(spark):
    rows = [(k, k + 1) for k in range(200)] + [(500, 501), (700, 700), (None, 3)]
    got = {r.v: r.root for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(201)}, 500: 500, 501: 500, 700: 700}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_shingles_and_many_copies(spark, monkeypatch):
    from stratavec.llm import neardup

    monkeypatch.setattr(neardup, "HOT", 16)
    rnd = random.Random(5)
    common = " ".join(f"c{k}" for k in range(12))
    texts = {}
    for k in range(120):  # a phrase in every text, and groups of close texts
        if k % 4 == 0:
            own = [f"w{rnd.randint(0, 400)}" for _ in range(14)]
        texts[k] = common + " " + " ".join(own[: 14 - k % 4])
    df = spark.createDataFrame([*texts.items()], "k long, t string").repartition(4)
    want = brute(texts, 3, 0.5, 1)
    for few in (1 << 20, 1):  # keys broadcast or joined by a shuffle
        monkeypatch.setattr(neardup, "FEW", few)
        assert {tuple(r) for r in NearDuplicates(df, "k", "t", width=3, t=0.5, bits=12).pairs().collect()} == want
    copies = spark.createDataFrame([(1000 + k, texts[0]) for k in range(10_000)] + [(1, texts[1]), (50, texts[50])], "k long, t string")
    got = NearDuplicates(copies, "k", "t", width=3, t=0.5).groups().groupBy("class_rep", "group_rep", "n_links").count().collect()
    close = (0, 1) in want
    assert {(r.class_rep, r["count"]) for r in got} == {(1000, 10_000), (1, 1), (50, 1)} and close and {r.group_rep for r in got if r.class_rep != 50} == {1}


def shuffled(spark):
    """Records written to and read from shuffles so far."""
    store = spark.sparkContext._jsc.sc()
    store.listenerBus().waitUntilEmpty(30_000)
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    stages = store.statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    stages = [stages.apply(k) for k in range(stages.size())]
    return sum(s.shuffleWriteRecords() for s in stages), sum(s.shuffleReadRecords() for s in stages)


def test_postings_are_read_once(spark):
    df = spark.createDataFrame([*corpus(4).items()], "k long, t string")
    nd = NearDuplicates(df, "k", "t", width=3, t=0.5, bits=16)
    wrote, read = shuffled(spark)
    assert nd.group_pairs().collect()
    wrote, read = shuffled(spark)[0] - wrote, shuffled(spark)[1] - read
    assert wrote > 1000 and read <= wrote


def test_meeting_across_batches():
    rnd = np.random.default_rng(7)
    sets = {g: sorted(set(rnd.integers(-9, 9, 12).tolist()) | ({5} if g < 30 else set())) for g in range(-40, 40)}
    rows = [(tok, g, len(s), k) for g, s in sets.items() for k, tok in enumerate(s)]
    rows = sorted(rows + rows[::3], key=lambda r: r[0])  # some twice
    groups = {tok: {g for t, g, _, _ in rows if t == tok} for tok in range(-9, 9)}
    want, t = {}, 0.5
    for tok, some in groups.items():
        for x in some:
            for y in some:
                a, b, p, q = len(sets[x]), len(sets[y]), sets[x].index(tok), sets[y].index(tok)
                if (a, x) < (b, y) and p < a - -(-2 * a // 3) + 1 and 2 * a >= b and min(a - p, b - q) >= -(-(a + b) // 3):
                    want.setdefault(tok, []).append((x, y))
    cols = [np.array(c, k) for c, k in zip(zip(*rows), (np.int64, np.int64, np.int32, np.int32))]
    for step in (1, 7, 64, len(rows)):
        batches = [pa.RecordBatch.from_arrays([pa.array(c[k : k + step]) for c in cols], names=["tok", "grp", "n", "pos"]) for k in range(0, len(rows), step)]
        for most in (45, 1000):
            got = [r for b in _meet(t, most)(iter([*batches, batches[0].slice(0, 0)])) for r in b.to_pylist()]
            hot = {tok for tok, some in groups.items() if len(some) > most}
            assert sorted((r["x"], r["y"]) for r in got if not r["hot"]) == sorted(p for tok, ps in want.items() if tok not in hot for p in ps)
            assert {(r["x"], r["y"], r["p"], r["q"]) for r in got if r["hot"]} == {r for r in rows if r[0] in hot}
            assert bool(hot) == (most == 45)


def test_order_and_words_as_the_slow_forms():
    for k in range(128):
        text = f"x{chr(k)}Y 7_z"
        assert [w.decode() for w in _split(text)] == _WORD.findall(text.lower())
    rnd = np.random.default_rng(3)
    row, rank, h = np.sort(rnd.integers(0, 300, 4000)), rnd.integers(0, 255, 4000).astype(np.uint8), rnd.integers(0, 1 << 64, 4000, np.uint64)
    close = h[0] ^ (h & np.uint64(3))  # differ in their last bits only
    for hashes, ranks, rows in ((h, rank, row), (close, rank // 64, row), (h, rank, row + (1 << 56)), (h[:0], rank[:0], row[:0])):
        at = _order(hashes, rows, ranks)
        slow = np.lexsort((hashes, ranks, rows))
        assert all((a[at] == a[slow]).all() for a in (hashes, ranks, rows))


def test_sketch_travels_compressed_and_arrives_whole():
    values = (np.arange(1 << 20) % 97 == 0).astype(np.uint8)
    sent = pickle.dumps(_Packed(values))
    assert len(sent) < len(values) // 10 and (pickle.loads(sent) == values).all()


def test_classes_are_shuffled_once_for_all_joins(spark):
    texts = {k: f"{k}a {k}b {k}c {k}d" for k in range(3000)} | corpus(6)
    df = spark.createDataFrame([*texts.items()], "k long, t string")
    nd = NearDuplicates(df, "k", "t", width=3, t=0.5, bits=16)
    nd.sets.count()
    before = shuffled(spark)[0]
    assert nd.pairs().count()
    # classes by name and by prefix, members by class, and what is left of the postings and pairs
    assert shuffled(spark)[0] - before < 6 * nd.sets.count()
