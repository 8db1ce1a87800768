"""The trie of conversation prefixes by partition refinement.

A node is a set of conversations whose first turns agree.  Refinement starts with one class of all conversations and goes
turn by turn: each round splits the active classes by their members' next turn (one aggregate) and tells members of classes
of two or more which class they are in now; a class of one is retired at once and stands for the unary chain of its
conversation's other turns, which later rounds don't see.  Members whose turns are over leave, too.  Then the rounds are
folded back, deepest first: what a round's classes sum up (leaves, saved bytes) goes to their parents.

Turns are compared by sha256 of role and text, made once; texts are not moved again.  A class is named by its smallest
member.  A class that holds a large share of the conversations never meets in a task: classes are counted by partial
aggregates, and members learn the name of a class that exceeds its share of a partition, of which there are fewer than
partitions, from a broadcast, and the others by a hash join.  Places of turns are a prefix scan, so a conversation with most
of the rows is numbered by many tasks.  There are as many rounds as the deepest turn that two conversations share.

Results: turns are ordered by turn (null first), then role and text; null role or text is empty; repeated rows are turns of
their own; rows without conv_id are left out; a conversation without turns is a member of the root alone; an empty table
has no nodes, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import numbered
from .common import discard, materialize, n_parts, new_path, record

CELL = 1 << 12  # members whose ids are joined to one string; depths of a chain made by one row
HEADS = 9  # rebuilt conversations begin with fewer turns than this of another's

#: Fixed values of the rebuilt conversations: groups of five share the beginning of their first.
GROUP = 5

NODE = "conv_id long, parent_conv_id long, n_convs long, bytes long, n_turns long"


# ---------------------------------------------------------------- turns
def placed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at (place from 1), turn_hash, bytes (of the text): every turn, whichever conversation holds most."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    key = F.unhex(F.sha2(F.encode(F.concat(F.length("role").cast("string"), F.lit("|"), "role", "text"), "UTF-8"), 256))
    ordered = numbered(rows, [F.col("turn").asc_nulls_first(), "role", "text"], "at", by=["conv_id"])
    return ordered.select("conv_id", "at", key.alias("turn_hash"), F.octet_length("text").cast("long").alias("bytes"))


def shared_turns(conv_id: Column) -> Column:
    """How many turns a rebuilt conversation takes from the first of its group."""
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def rebuilt_turns(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: the first h turns of the group's first conversation (all if fewer), then their own after h.
    Returns conv_id, n_turns of every conversation and conv_id, depth, turn_hash, bytes of every turn."""
    sizes = placed.groupBy("conv_id").agg(F.count("*").alias("own"))
    sizes = sizes.withColumn("h", shared_turns(F.col("conv_id"))).withColumn("first", F.col("conv_id") - F.col("conv_id") % GROUP)
    heads = sizes.select(F.col("conv_id").alias("first"), F.least("own", F.lit(HEADS - 1)).alias("there"))
    sizes = sizes.join(heads, "first", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    sizes = sizes.select("conv_id", "first", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n_turns"))
    taken = placed.filter(F.col("at") < HEADS).withColumnRenamed("conv_id", "first")  # at most HEADS - 1 a conversation
    taken = taken.join(sizes.select("conv_id", "first", "taken"), "first").filter("at <= taken").select("conv_id", F.col("at").alias("depth"), "turn_hash", "bytes")
    # h follows from the id, so only conversations that take fewer than h turns, as the first has fewer, need the join
    short = sizes.filter("taken < h").select("conv_id", (F.col("h") - F.col("taken")).alias("missing"))
    own = placed.withColumn("h", shared_turns(F.col("conv_id"))).filter("at > h").join(short, "conv_id", "left")
    own = own.select("conv_id", (F.col("at") - F.coalesce("missing", F.lit(0))).alias("depth"), "turn_hash", "bytes")
    return sizes.select("conv_id", "n_turns"), taken.unionByName(own)


# ---------------------------------------------------------------- refinement
def _named(members: DataFrame, classes: DataFrame, keys: list[str], share: int) -> DataFrame:
    """members (with keys) of classes of two or more: conv_id, n_turns and node, the name of the class they are in now."""
    many = classes.filter("n_convs > 1").select(*keys, F.col("conv_id").alias("name"), "n_convs")
    hot = F.broadcast(many.filter(F.col("n_convs") > share).drop("n_convs"))  # fewer than partitions
    rest = members.join(hot, keys, "left_anti").join(many.filter(F.col("n_convs") <= share).drop("n_convs"), keys)
    out = lambda df: df.select("conv_id", F.col("name").alias("node"), "n_turns")
    return out(members.join(hot, keys)).unionByName(out(rest))


def refine(sizes: DataFrame, turns: DataFrame, path: str) -> int:
    """Writes the classes of each round to path/classes/depth=d (conv_id, parent_conv_id, n_convs, bytes, n_turns; bytes of the
    last turn, n_turns of the smallest member) and members that end to path/ends/depth=d; returns the number of rounds with
    a class of two or more."""
    spark = sizes.sparkSession
    least = F.min_by(F.struct("n_turns", "bytes"), "conv_id")
    members, depth, old = sizes.withColumn("node", F.lit(0).cast("long")), 0, None
    while True:
        if depth:
            step = members.join(turns.filter(F.col("depth") == depth).select("conv_id", "turn_hash", "bytes"), "conv_id")
        else:
            step = members.withColumn("turn_hash", F.lit(b"")).withColumn("bytes", F.lit(0).cast("long"))
        classes = step.groupBy("node", "turn_hash").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), least.alias("of"))
        parent = F.col("node") if depth else F.lit(None).cast("long")
        at = f"{path}/classes/depth={depth}"
        classes.select("conv_id", parent.alias("parent_conv_id"), "n_convs", "of.bytes", "of.n_turns", "node", "turn_hash").write.parquet(at)
        classes = spark.read.schema(NODE + ", node long, turn_hash binary").parquet(at)
        many = classes.filter("n_convs > 1").agg(F.sum("n_convs")).first()[0]
        if many:
            root = F.lit(classes.first().conv_id if not depth else None).cast("long").alias("node")  # the first class has all
            named = _named(step, classes, ["node", "turn_hash"], max(1, many // n_parts(spark))) if depth else sizes.select("conv_id", root, "n_turns")
            members = materialize(named, "members")
        if old is not None:
            discard(old)
        if not many:
            return depth
        old = members
        members.filter(F.col("n_turns") == depth).select("conv_id", "node").write.parquet(f"{path}/ends/depth={depth}")
        members, depth = members.filter(F.col("n_turns") > depth), depth + 1


# ---------------------------------------------------------------- folding
def fold(spark, path: str, rounds: int) -> None:
    """Subtree sums of the classes of two or more, deepest first, written to path/nodes/depth=d."""
    for depth in reversed(range(rounds)):
        read = lambda what, d, ddl: spark.read.schema(ddl).parquet(f"{path}/{what}/depth={d}")
        below = read("classes", depth + 1, NODE)
        children = below.filter("n_convs = 1").select("parent_conv_id", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved"))
        if depth + 1 < rounds:
            inner = read("nodes", depth + 1, "parent_conv_id long, n_leaves long, saved_tokens long")
            children = children.unionByName(inner.select("parent_conv_id", "n_leaves", F.col("saved_tokens").alias("saved")))
        sums = children.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
        here = read("classes", depth, NODE).filter("n_convs > 1").join(sums, "conv_id", "left")
        here.select(
            "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("bytes") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"),
        ).write.parquet(f"{path}/nodes/depth={depth}")


def chains(classes: DataFrame) -> DataFrame:
    """The nodes of retired classes: from where a conversation is alone to its last turn; long chains are made in pieces."""
    alone = classes.filter("n_convs = 1").select("conv_id", "parent_conv_id", F.col("depth").cast("long").alias("top"), "n_turns")
    pieces = alone.withColumn("low", F.explode(F.sequence("top", F.greatest("top", "n_turns"), F.lit(CELL).cast("long"))))
    pieces = pieces.repartition(n_parts(classes.sparkSession), "conv_id", "low")
    rows = pieces.withColumn("depth", F.explode(F.sequence("low", F.least(F.col("low") + CELL - 1, F.greatest("top", "n_turns")))))
    more = (F.col("depth") < F.col("n_turns")).cast("long")
    return rows.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("top"), F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
        more.alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.sha2(F.when(more == 0, F.col("conv_id").cast("string")).otherwise("").cast("binary"), 256).alias("ends_sha256"),
    )


def member_digests(ends: DataFrame) -> DataFrame:
    """ends (node, depth, conv_id) -> node, depth, ends_sha256 of the sorted ids: cells of neighbouring ids become strings
    in many tasks; a task hashes a node's strings one after the other, as they come in order."""
    span = F.shiftright("conv_id", CELL.bit_length() - 1)
    cells = ends.groupBy("node", "depth", span.alias("cell")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    schema = pa.schema([("node", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])

    def run(batches):
        key, h = None, None
        for b in batches:
            out = []
            for node, depth, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if (node, depth) == key:
                    h.update(b"," + ids.encode())
                else:
                    if key is not None:
                        out.append((*key, h.hexdigest()))
                    key, h = (node, depth), hashlib.sha256(ids.encode())
            if out:
                yield record(schema, *map(list, zip(*out)))
        if key is not None:
            yield record(schema, [key[0]], [key[1]], [h.hexdigest()])

    ordered = cells.repartition(n_parts(ends.sparkSession), "node", "depth").sortWithinPartitions("node", "depth", "cell").select("node", "depth", "ids")
    return ordered.mapInArrow(run, "node long, depth long, ends_sha256 string")


def trie(sizes: DataFrame, turns: DataFrame) -> DataFrame:
    """sizes (conv_id, n_turns: one row a conversation) and turns (conv_id, depth from 1 without gaps, turn_hash, bytes) ->
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = sizes.sparkSession
    sizes, turns = materialize(sizes, "conversations"), materialize(turns.sortWithinPartitions("depth"), "turns")
    path = new_path(spark, "trie")
    rounds = refine(sizes, turns, path)
    fold(spark, path, rounds)
    discard(sizes, turns)
    retired = chains(spark.read.schema(NODE + ", depth int").parquet(f"{path}/classes"))
    if not rounds:
        return retired
    nodes = spark.read.schema("conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, depth long").parquet(f"{path}/nodes")
    digests = member_digests(spark.read.schema("conv_id long, node long, depth long").parquet(f"{path}/ends"))
    nodes = nodes.join(digests.withColumnRenamed("node", "conv_id"), ["conv_id", "depth"], "left")
    nodes = nodes.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    return nodes.select(*retired.columns).unionByName(retired)


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    placed = materialize(placed_turns(conversations), "placed")
    out = trie(*rebuilt_turns(placed))
    discard(placed)
    return out


ORACLE_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i, i AS v, 0 AS k FROM range(256) x(i)
  UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
    sha256(length(coalesce(role, '')) || '|' || coalesce(role, '') || coalesce(text, '')) AS k, octet_length(encode(coalesce(text, ''))) AS bytes
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c.conv_id, c.conv_id - c.conv_id % 5 AS first, own, coalesce(f.there, 0) AS there,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c.conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS INT) + 1])), CAST(4294967295 AS BIGINT)) % 9 AS h
  FROM (SELECT conv_id, count(*) AS own FROM placed GROUP BY 1) c LEFT JOIN (SELECT conv_id, count(*) AS there FROM placed GROUP BY 1) f ON f.conv_id = c.conv_id - c.conv_id % 5, crc),
turns AS (
  SELECT c.conv_id, p.pos AS depth, k, bytes FROM convs c JOIN placed p ON p.conv_id = c.first AND pos <= h
  UNION ALL SELECT c.conv_id, pos - h + least(h, there), k, bytes FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND pos > h),
prefix AS (
  SELECT conv_id, depth, bytes, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY depth) AS p FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
sized AS (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS n FROM prefix),
node AS (SELECT min(conv_id) AS conv_id, depth, p, count(*) AS n_convs, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = n), '')) AS ends_sha256, bool_and(depth = n) AS childless FROM sized GROUP BY depth, p),
path AS (SELECT s.conv_id, s.depth, v.conv_id AS node FROM sized s JOIN node v ON s.depth = v.depth AND s.p = v.p),
summed AS (
  SELECT a.node, a.depth, count(*) FILTER (v.childless) AS n_leaves, sum((v.n_convs - 1) * v.bytes) AS saved, count(*) FILTER (v.depth = a.depth + 1) AS n_children
  FROM node v JOIN path a ON a.conv_id = v.conv_id AND a.depth <= v.depth GROUP BY 1, 2)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, u.node AS parent_conv_id, v.n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM node v JOIN summed s ON s.node = v.conv_id AND s.depth = v.depth LEFT JOIN path u ON u.conv_id = v.conv_id AND u.depth = v.depth - 1
"""
