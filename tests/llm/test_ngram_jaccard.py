import random

import pytest
from litspark.llm import ngram_jaccard as nj
from litspark.llm.components import components


def corpus(seed, n_groups=8, size=12):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    line = " ".join(rng.choices(vocab, k=25))
    rows, i = [], 0
    for g in range(n_groups):
        base = rng.choices(vocab, k=rng.choice([3, 6, 30, 80, 200]))
        for _ in range(rng.randint(1, size)):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(words) + 1)
                words[at : at + rng.randint(0, 2)] = [rng.choice(vocab)] * rng.randint(0, 2)
            text = " ".join(words)
            rows.append((i, text.upper() if rng.random() < 0.2 else text))
            i += 1
    for _ in range(30):
        rows.append((i, line + " " + " ".join(rng.choices(vocab, k=rng.randint(0, 12)))))
        i += 1
    rng.shuffle(rows)
    return rows + [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "One  two"), (1005, "É é x y z q"), (1006, rows[0][1])]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_brute_force(spark, seed, monkeypatch):
    if seed == 3:
        monkeypatch.setattr(nj, "ROUNDS", (1, 3, None))
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, nj.digest(nj.jaccard_join(df, bits=16)).collect()))
    assert got == sorted(nj.brute_force(rows))
    assert len({g[2] for g in got}) < len(rows)


def test_empty_repeats_and_extra_columns(spark):
    assert nj.digest(nj.jaccard_join(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
    df = spark.createDataFrame([(5, "a b c d e f", 1), (5, "a b c d e f", 2), (None, "a", 3), (2, "A b c d e f", 4)], "doc_id long, text string, n int")
    got = sorted(map(tuple, nj.digest(nj.jaccard_join(df)).collect()))
    assert got == [(2, 2, 2), (5, 2, 2), (5, 2, 2)]


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100}


def test_hot_lists_are_dealt_to_several(spark, monkeypatch):
    """Lists above the limit are salted; links between their parts are still found."""
    visited = []
    plain = nj.visiting_pairs
    monkeypatch.setattr(nj, "visiting_pairs", lambda hot, t: visited.append(hot.filter("salts > 1").count()) or plain(hot, t))
    # texts of one passage, too long a part of each to leave their rarest fifth, and of a tail that two of them share
    rng = random.Random(4)
    line = " ".join(rng.choices([f"w{i}" for i in range(400)], k=89))
    rows = [(2 * g + c, f"{line} {' '.join(f't{g}.{i}' for i in range(15 - c))}") for g in range(40) for c in (0, 1)]
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = sorted(map(tuple, nj.digest(nj.jaccard_join(df, bits=16, hot_list=6)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == sorted(nj.brute_force(rows)) and len({g[2] for g in got}) == 40
    assert visited and visited[0] > 0


def test_very_long_text_and_clashing_names(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    rows = [(1, long, 5, "a"), (2, long + " more", 6, "b"), (3, "x" * 200_000, 7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id int, component_id string")
    got = sorted(map(tuple, nj.digest(nj.jaccard_join(df)).collect()))
    assert got == [(1, 29_996, 1), (2, 29_997, 1), (3, 1, 3)]


def test_components_by_star_rounds(spark, monkeypatch):
    from litspark.llm import components as c

    monkeypatch.setattr(c, "LOCAL", 0)
    test_components_of_a_chain(spark)
    assert c.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_full_bitmaps_let_no_copy_into_the_lists(spark, monkeypatch):
    """With bitmaps that pass every id, lists hold class representatives alone and the answers stay right."""
    import numpy as np

    class Full:
        def probe(self):
            return lambda cells: np.ones(len(cells), bool)

    held, plain = [], nj.inverted_lists

    def watched(*args):
        rows = plain(*args)
        held.extend(r.doc_id for r in rows.select("doc_id").distinct().collect())
        return rows

    monkeypatch.setattr(nj, "id_filter", lambda ids: Full())
    monkeypatch.setattr(nj, "inverted_lists", watched)
    base = " ".join(f"w{i}" for i in range(60))
    near = " ".join(f"w{i}" for i in range(59)) + " end"
    rows = [(i, base) for i in range(300)] + [(300 + i, near) for i in range(300)] + [(900, "some other words that stand for themselves here")]
    got = nj.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.select("doc_id", "component_id").collect())) == [(i, 0) for i in range(600)] + [(900, 900)]
    assert set(held) == {0, 300}
