"""The conversation trie against a plain one, and refinement's own behaviour."""

import hashlib
import zlib
from collections import defaultdict

from litspark.llm import prefix_trie as P
from pyspark.sql import functions as F

DDL = "conv_id long, turn long, role string, text string"


def sha(ids):
    return hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


def rebuilt(rows):
    own = defaultdict(list)
    for c, n, r, t in rows:
        if c is not None:
            own[c].append((n is not None, n or 0, r or "", t or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        first = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(first, [])[:h] + own[c][h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        leaves[p] = sum(leaves[c] for c in children[p]) or 1
        saved[p] = own + sum(saved[c] for c in children[p])
        ends = [c for c in members[p] if len(convs[c]) == len(p)]
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], sha(ends)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


CONVS = [(c, t, "user" if t % 2 else "assistant", f"t{t}" if t < 3 else f"t{t} {c % 3}") for c in range(40) for t in range(c % 7)]
ODD = [
    (100, None, None, None), (100, 0, "user", "é"), (100, 0, "user", "é"), (101, 5, "a", "tie"), (101, 5, "a", "bye"), (103, 1, "ab", "c"), (104, 1, "a", "bc"), (None, 0, "user", "lost"),
    (-3, 0, "user", "x"), (-7, 0, "user", "x"), (0, 9, "user", "y" * 100_000), (2**40 + 1, 0, "user", "t"), (2**40 + 2, 0, "user", "t"),
]


def test_rebuilt_conversations(spark):
    rows = CONVS + ODD
    got = P.rebuilt_trie(spark.createDataFrame(rows, DDL))
    assert rows_of(got) == brute(rebuilt(rows))


def direct(spark, convs):
    """The trie of conversations as they are."""
    sizes = spark.createDataFrame([(c, len(t)) for c, t in convs.items()], "conv_id long, n_turns long")
    turns = [(c, d, hashlib.sha256(repr(x).encode()).digest(), len(x[1].encode())) for c, t in convs.items() for d, x in enumerate(t, 1)]
    return P.trie(sizes, spark.createDataFrame(turns, "conv_id long, depth long, turn_hash binary, bytes long"))


def test_equal_and_turnless_conversations(spark):
    """Every second conversation is the same one, some have no turns, one is a prefix of others, one has many turns."""
    convs = {i: [("user", "hello"), ("assistant", "hi")] if i % 2 else [("user", "hello")] + [("user", str(i))] * (i % 5) for i in range(200)}
    convs |= {300: [], 301: [], 302: [("user", "hello")], 303: [("user", "deep")] + [("assistant", str(i)) for i in range(5000)]}
    got = direct(spark, convs)
    want = brute({c: t for c, t in convs.items() if c != 303} | {303: convs[303][:6]})
    assert [r for r in rows_of(got) if r[0] != 303 and r[1] > 0] == [r for r in want if r[0] != 303 and r[1] > 0]
    chain = got.filter("conv_id = 303").orderBy("depth").collect()
    assert [r.depth for r in chain] == list(range(1, 5002)) and [r.parent_conv_id for r in chain[:3]] == [0, 303, 303]
    assert {r.n_convs for r in chain} == {1} and chain[-1].n_children == 0 and chain[-1].ends_sha256 == sha([303])
    root = got.filter("depth = 0").first()
    assert (root.conv_id, root.n_convs, root.n_leaves, root.ends_sha256) == (0, 204, sum(1 for r in want if r[4] == 0), sha([300, 301]))


def test_one_conversation_and_none(spark):
    assert rows_of(direct(spark, {7: [("user", "a"), ("user", "b")]})) == brute({7: [("user", "a"), ("user", "b")]})
    assert P.rebuilt_trie(spark.createDataFrame([], DDL)).collect() == []
    assert P.rebuilt_trie(spark.createDataFrame([(None, 1, "user", "x")], DDL)).collect() == []


def test_clashing_columns(spark):
    df = spark.createDataFrame(CONVS, DDL)
    assert rows_of(P.rebuilt_trie(df.selectExpr("*", "1 as at", "2 as depth", "3 as node", "4 as h", "5 as bytes"))) == rows_of(P.rebuilt_trie(df))


def test_retired_classes_leave_the_rounds(spark):
    """Rounds are as many as the deepest shared turn, whatever a single conversation's length."""
    convs = {1: [("u", "a"), ("u", "b"), ("u", "x")], 2: [("u", "a"), ("u", "b"), ("u", "y")], 3: [("u", str(i)) for i in range(60)]}
    sizes = spark.createDataFrame([(c, len(t)) for c, t in convs.items()], "conv_id long, n_turns long")
    turns = spark.createDataFrame([(c, d, repr(x).encode(), 1) for c, t in convs.items() for d, x in enumerate(t, 1)], "conv_id long, depth long, turn_hash binary, bytes long")
    path = P.new_path(spark, "rounds")
    assert P.refine(sizes, turns, path) == 3  # the root and two shared turns
    classes = spark.read.parquet(f"{path}/classes")
    assert classes.agg(F.max("depth")).first()[0] == 3 and classes.filter("conv_id = 3").count() == 1


def test_members_of_large_nodes_are_hashed_in_cells(spark, monkeypatch):
    monkeypatch.setattr(P, "CELL", 16)
    ends = spark.range(-500, 1500).select(F.lit(-500).cast("long").alias("node"), F.lit(2).cast("long").alias("depth"), F.col("id").alias("conv_id"))
    ((node, depth, digest),) = map(tuple, P.member_digests(ends).collect())
    assert (node, depth, digest) == (-500, 2, sha(range(-500, 1500)))
