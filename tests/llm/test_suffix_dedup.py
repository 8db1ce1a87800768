import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from litspark.llm import suffix_array as sx
from litspark.llm import suffix_dedup
from litspark.llm.suffix_dedup import brute_force, dedup_suffixes, digest


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.binary(max_size=80), st.text("ab", max_size=120).map(str.encode), st.text("a", max_size=40).map(str.encode)))
def test_suffix_array_and_plcp(data):
    text = np.frombuffer(data, np.uint8)
    want = sorted(range(len(data)), key=lambda i: data[i:])
    assert sx.suffix_array(text).tolist() == want
    sx.SMALL, old = 1, sx.SMALL
    try:
        assert sx.suffix_array(text).tolist() == want
    finally:
        sx.SMALL = old
    if len(data) > 1:
        phi, plcp = sx.capped_plcp(text, np.array(want), 9)
        for a, b in zip(want, want[1:]):
            k = 0
            while k < 9 and b + k < len(data) and a + k < len(data) and data[a + k] == data[b + k]:
                k += 1
            assert phi[b] == a and plcp[b] == k


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_brute_force(spark, seed, monkeypatch):
    if seed == 3:
        monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 400)  # every key is cut by further grams
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choices("abcdeé \n", k=n))
    shared = [make(rng.randint(150, 500)) for _ in range(6)]
    rows = []
    for i in range(50):
        parts = [make(rng.randint(0, 300)) for _ in range(3)]
        if i % 2:
            parts.insert(rng.randint(0, 3), rng.choice(shared))
        rows.append((i, "".join(parts)))
    rows += [(100, None), (101, ""), (102, "a" * 450), (103, "la lo " * 120), (104, rows[3][1]), (105, "b" * 199), (106, make(60) + "a" * 199)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, digest(dedup_suffixes(df)).collect())) == sorted(brute_force(rows))


def test_empty_nulls_repeats_and_extra_columns(spark):
    assert digest(dedup_suffixes(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
    text = "".join(chr(97 + i * i % 26) + str(i) for i in range(120))
    df = spark.createDataFrame([(1, text, 3), (1, text, 4), (None, text, 5)], "doc_id long, text string, start int")
    got = digest(dedup_suffixes(df)).collect()
    assert [r.n_removed for r in got] == [len(text)] * 2


def test_repeated_ids_with_other_texts_and_a_very_long_text(spark):
    """Each row loses only bytes of its own text."""
    rng = random.Random(2)
    make = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    shared = make(300)
    rows = [(1, shared + make(50)), (2, make(500)), (2, make(20) + shared), (3, make(150_000) + shared[:250])]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, t int, key int").repartition(3)
    got = sorted(map(tuple, digest(dedup_suffixes(df)).collect()))
    assert got == sorted(brute_force(rows))
    assert [r[2] for r in got] == [300, 300, 0, 250]


def test_copies_reach_the_suffix_array(spark, monkeypatch):
    """Texts that are all exact copies are found by sorting: without it nothing is removed."""
    rng = random.Random(3)
    text = "".join(rng.choices("abcdefgh ", k=900))
    rows = [(i, text) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert sorted(map(tuple, digest(dedup_suffixes(df)).collect())) == brute_force(rows)
    monkeypatch.setattr(suffix_dedup, "shard_repeats", lambda parts, length: (np.empty(0, np.int64),) * 3)
    assert all(r.n_removed == 0 for r in digest(dedup_suffixes(df)).collect())
