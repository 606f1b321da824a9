import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratavec.llm import mix, split


def check(text, limit, overlap):
    pieces = split.cut_text(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (a, b, s), (c, d, _) in zip(pieces, pieces[1:]):
        assert b - a <= limit and a < c <= b < d and (b - c <= overlap or s == 0)
    assert all(b - a <= limit for a, b, _ in pieces)
    return pieces


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n\r!?中。é́‍", max_size=400), st.integers(10, 60))
def test_pieces_cover_within_the_limit(text, limit):
    check(text, limit, limit // 4)


def test_range_maximum_is_brute_force():
    rnd = random.Random(3)
    text = "".join(rnd.choice("ab c. d\n\n e") for _ in range(600))
    index = split.Boundaries(text, 200)
    cuts = dict(zip(index.at.tolist(), (index.levels[0] // index.base).tolist()))
    for _ in range(300):
        low = rnd.randint(0, 500)
        high = low + rnd.randint(0, 150)
        inside = [(s, p) for p, s in cuts.items() if low <= p <= high]
        assert index.strongest(low, high) == (max(inside)[::-1] if inside else None)


def test_strongest_cut_wins_and_hard_cuts_work():
    para = "word " * 30 + "end.\n\n" + "more words here. " * 20
    assert check(para, 200, 20)[0][1:] == (156, split.PARAGRAPH)
    assert [p[:2] for p in split.cut_text("x" * 100, 40, 5)] == [(0, 40), (35, 75), (70, 100)]
    with pytest.raises(ValueError):
        split.cut_text("x" * 50, 10, 5)


def test_split_table(spark):
    rows = [(1, "a b " * 3000, 0), (1, "a b " * 3000, 0), (2, "short", 0), (3, None, 0), (None, "é" * 4001, 0)]
    df = spark.createDataFrame(rows, "seq long, string string, piece int")
    got = split.split_texts(df).collect()
    assert {r.seq for r in got} == {1, None} and max(len(r.text) for r in got) <= 4000
    assert len({(r.seq, r.piece) for r in got}) == len(got)
    assert split.split_texts(df.limit(0)).count() == 0


def test_plan_is_capped():
    plan = mix.plan_mix([("a", 0.5, 1), ("b", 0.5, 2), ("c", 0.0, 1), ("d", 0.2, 0), (None, 0.1, 1)], {"a": 1000, "b": 100, "c": 5, "d": 9})
    assert [(r[0], round(r[2])) for r in plan] == [("a", 200), ("b", 200)]
    assert abs(sum(r[1] * r[4] for r in plan)) < 1e-12
    assert mix.plan_mix([("a", 0.5, 1)], {}) == []


def test_mix_shares_and_repeats(spark):
    docs = [(k, f"word {k} " * (3 + k % 7), "big" if k % 3 else "small") for k in range(600)] + [(900, None, "big"), (901, "x y", None), (902, "x", "other")]
    df = spark.createDataFrame(docs + docs[:5], "doc_id long, text string, source string").selectExpr("*", "1 as position", "2 as copy")
    goal = spark.createDataFrame([("big", 0.4, 1), ("small", 0.6, 2), ("gone", 0.3, 5)], "source string, target_share double, max_repeats int")
    goal = goal.union(goal.limit(1))  # a repeated row counts once
    m = mix.mix(df, goal)
    rows = m.collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    assert len({(r.doc_id, r.copy) for r in rows}) == len(rows) and {r.doc_id for r in rows}.isdisjoint({900, 901, 902})
    shares = {r.source: r for r in mix.reached_shares(m, goal).collect()}
    assert abs(shares["big"].actual_share - 0.4) < 0.01 and shares["big"].max_uses == 1 and shares["small"].max_uses <= 2 and shares["gone"].actual_share == 0
    # larger sources come earlier, smaller ones later
    half = rows[len(rows) // 2].position
    early = [r.source for r in rows if r.position < half]
    assert early.count("small") / len(early) != shares["small"].actual_share
    assert mix.mix(df.limit(0), goal).count() == 0 and mix.mix(df, goal.limit(0)).count() == 0
