"""Mixing sources to target weights with a low-discrepancy schedule, in DataFrame functions only.

A source's documents, laid end to end in hashed order, are cut into blocks of equal token count (to one word).  Slot k of
the mix is the golden-ratio point frac(k * phi) mapped through the sources' cumulative shares of the slots; a source's
r-th slot takes its r-th block in shuffled order, epoch after epoch, each with an order of its own.  The mix is the
schedule's first slots, as many as the targets ask for: what is taken of a document follows from them, so a source's
words come as near to its target as the sequence's discrepancy (a few blocks) lets them.  Ranks, places and cumulative
shares are prefix sums in two levels (chunks, then inside a chunk), so a source with most of the rows is never one task's
window.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share all words; a target stops at max_epochs
times its source's size and the excess is reshared by weight.

Results: a null text has size 0 and nothing is taken of it; repeated rows are separate documents; all-empty sources have
target 0; an empty table gives an empty result; columns other than doc_id, text and source are ignored.  Reruns agree: the
order is hashed, not random.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_CLASS, materialize

WEIGHTS = (5, 2, 1)
EPOCHS = 3
BLOCK = 128  # words of a block, about
LEAST = 128  # blocks of a source that has as many words: small sources have smaller blocks
STRIDES = (1_000_003, 999_983, 999_979)  # primes: the shuffled order of blocks steps by one that doesn't divide their number
CHUNK = 1 << 16  # slots ranked together
GRID = 4096  # cells that slots and shares meet in
GOLDEN = 2654435769  # 2**32 / phi


def _so_far(value: str, *order) -> Column:
    """Sum of the rows before this one."""
    return F.coalesce(F.sum(value).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) of every document."""
    return docs.filter("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD_CLASS)), F.lit(0)).cast("long").alias("size"),
    )


def targets(sized: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """source, src (its number), source_size, weight, target, words (whole words of the target): one row a source."""
    one = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = one.withColumn("src", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    one = one.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("src") % len(weights) + 1).cast("int")).cast("double"))
    one = one.withColumn("cap", F.col("source_size") * F.lit(float(epochs))).withColumn("level", F.col("cap") / F.col("weight"))
    order = ("level", "src")
    whole = Window.partitionBy()
    one = one.withColumn("total", F.sum("source_size").over(whole)).withColumn("weights", F.sum("weight").over(whole))
    # the level at which the sources up to here are full and the rest share what is left by weight
    one = one.withColumn("share", (F.col("total") - _so_far("cap", *order)) / (F.col("weights") - _so_far("weight", *order)))
    level = F.min_by(F.when(F.col("share") <= F.col("level"), F.col("share")), F.when(F.col("share") <= F.col("level"), F.struct(*order))).over(whole)
    one = one.withColumn("water", level)
    one = one.withColumn("target", F.coalesce(F.least("cap", F.col("water") * F.col("weight")), F.col("cap")))
    return one.select("source", "src", "source_size", "weight", "target", F.floor(F.col("target") + 1e-6).cast("long").alias("words"))


def placed(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Every document's place (start, in words) in its source's hashed order, with its source's figures."""
    rows = sized.join(sources, sized.source.eqNullSafe(sources.source)).drop(sources.source)
    rows = rows.withColumn("h", F.md5(F.concat(F.lit("mix|"), F.col("doc_id").cast("string")))).withColumn("cell", F.substring("h", 1, 3))
    cells = rows.groupBy("src", "cell").agg(F.sum("size").alias("in_cell"))
    before = F.sum("in_cell").over(Window.partitionBy("src").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select("src", "cell", F.coalesce(before, F.lit(0)).alias("base"))
    inner = Window.partitionBy("src", "cell").orderBy("h", "doc_id", "size")
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("nth", F.row_number().over(inner))
    return rows.join(cells, ["src", "cell"]).withColumn("start", F.col("base") + F.col("inner"))


def blocked(sources: DataFrame, block: int) -> DataFrame:
    """sources with their number of blocks, the words of a block (width; the first longer ones have one more) and the
    number of slots that the target asks for."""
    size = F.col("source_size")
    s = sources.filter("words > 0").withColumn("blocks", F.greatest(F.ceil(size / block), F.least(size, F.lit(LEAST))))
    s = s.withColumn("width", F.expr("source_size div blocks")).withColumn("longer", F.expr("source_size % blocks"))
    return s.withColumn("slots", F.round(F.col("target") * F.col("blocks") / size).cast("long"))


def slots(sources: DataFrame, n: int, epochs: int) -> DataFrame:
    """slot, src, rank, block: the schedule of the first n slots; what exceeds the epochs of a source is left out."""
    spark = sources.sparkSession
    s = sources.withColumn("all", F.sum("slots").over(Window.partitionBy()))
    s = s.withColumn("lo", _so_far("slots", "src") / F.col("all")).withColumn("hi", (_so_far("slots", "src") + F.col("slots")) / F.col("all"))
    s = s.select("src", "blocks", "lo", "hi")
    cells = s.withColumn("grid", F.explode(F.sequence(F.floor(F.col("lo") * GRID).cast("long"), F.least(F.floor(F.col("hi") * GRID), F.lit(GRID - 1)).cast("long"))))
    point = (F.col("id") % (1 << 31) * F.lit(GOLDEN)).bitwiseAND(F.lit((1 << 32) - 1)) / float(1 << 32)
    k = spark.range(1, n + 1).withColumn("u", point).withColumn("grid", F.floor(F.col("u") * GRID).cast("long"))
    hit = k.join(cells, "grid").filter("u >= lo and u < hi").select(F.col("id").alias("slot"), "src", "blocks", F.floor(F.col("id") / CHUNK).alias("chunk"))
    counts = hit.groupBy("src", "chunk").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("src", "chunk", F.coalesce(before, F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("src", "chunk").orderBy("slot"))
    ranked = hit.withColumn("nth", nth).join(bases, ["src", "chunk"]).withColumn("rank", F.col("base") + F.col("nth") - 1)
    stride = F.coalesce(*(F.when(F.col("blocks") % p != 0, F.lit(p)) for p in STRIDES), F.lit(1))
    block = (F.col("rank") % F.col("blocks") * stride + F.expr("rank div blocks * (blocks div 3)")) % F.col("blocks")
    return ranked.filter(F.col("rank") < epochs * F.col("blocks")).select("slot", "src", "rank", block.alias("block"))


def _parts(docs: DataFrame, weights, epochs: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Every document once for each block that holds words of it (part: those words, from from_word on), and the slots."""
    sized = materialize(sizes(docs), "sizes")
    sources = materialize(blocked(targets(sized, weights, epochs), block), "sources")
    n = int(sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0])
    p = placed(sized, targets(sized, weights, epochs)).join(sources.select("src", "blocks", "width", "longer"), "src", "left")

    def holding(word: Column) -> Column:
        far = F.col("longer") * (F.col("width") + 1)
        near = F.floor(word / (F.col("width") + 1))
        return F.when(word < far, near).otherwise(F.col("longer") + F.floor((word - far) / F.col("width"))).cast("long")

    first, last = holding(F.col("start")), holding(F.col("start") + F.col("size") - 1)
    p = p.withColumn("block", F.explode_outer(F.when((F.col("size") > 0) & F.col("blocks").isNotNull(), F.sequence(first, last))))
    begin = lambda b: b * F.col("width") + F.least(b, F.col("longer"))
    lo, hi = F.greatest("start", begin(F.col("block"))), F.least(F.col("start") + F.col("size"), begin(F.col("block") + 1))
    p = p.withColumn("from_word", lo - F.col("start")).withColumn("part", hi - lo)
    return p, slots(sources, n, epochs)


def schedule(docs: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS, block: int = BLOCK) -> DataFrame:
    """The mix in order of slot, one row for each document of the slot's block: slot, source, doc_id, from_word, n_words,
    and src, cell, nth, which together name the document's row."""
    parts, slot = _parts(docs, weights, epochs, block)
    return parts.join(slot, ["src", "block"]).select("slot", "source", "src", "cell", "nth", "doc_id", "from_word", F.col("part").alias("n_words"))


def mix(docs: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS, block: int = BLOCK) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, source, size, source_size, target, taken, first_slot and slot_sum (of the
    slots that take words of it; null and 0 if none does): one row a document."""
    parts, slot = _parts(docs, weights, epochs, block)
    times = slot.groupBy("src", "block").agg(F.count("*").alias("times"), F.min("slot").alias("least"), F.sum("slot").alias("sum"))
    rows = parts.join(times, ["src", "block"], "left")
    return rows.groupBy("src", "cell", "nth", "doc_id", "source", "size", "source_size", "target").agg(
        F.coalesce(F.sum(F.col("part") * F.col("times")), F.lit(0)).cast("long").alias("taken"),
        F.min("least").alias("first_slot"), F.coalesce(F.sum("sum"), F.lit(0)).alias("slot_sum"),
    ).select("doc_id", "source", "size", "source_size", "target", "taken", "first_slot", "slot_sum")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents WHERE doc_id IS NOT NULL),
one AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
two AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM one),
three AS (SELECT *, CAST([5, 2, 1][CAST(src % 3 + 1 AS INT)] AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS cap FROM two),
four AS (
  SELECT *, cap / weight AS level,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS share
  FROM three WINDOW w AS (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT arg_min(share, (level, src)) AS water FROM four WHERE share <= level),
sources AS (
  SELECT *, CAST(greatest(ceil(source_size / 128), least(source_size, 128)) AS BIGINT) AS blocks
  FROM (SELECT source, src, source_size, coalesce(least(cap, water * weight), cap) AS target FROM four, water)),
cut AS (
  SELECT *, source_size // blocks AS width, source_size % blocks AS longer, CAST(round(target * blocks / source_size) AS BIGINT) AS slots,
    CASE WHEN blocks % 1000003 <> 0 THEN 1000003 WHEN blocks % 999983 <> 0 THEN 999983 WHEN blocks % 999979 <> 0 THEN 999979 ELSE 1 END AS stride
  FROM sources WHERE source_size > 0),
shares AS (SELECT *, coalesce(sum(slots) OVER w, 0) / sum(slots) OVER () AS lo, (coalesce(sum(slots) OVER w, 0) + slots) / sum(slots) OVER () AS hi
  FROM cut WINDOW w AS (ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
points AS (SELECT k AS slot, ((k % 2147483648 * 2654435769) & 4294967295) / 4294967296.0::DOUBLE AS u
  FROM (SELECT unnest(range(1, CAST((SELECT sum(slots) FROM cut) AS BIGINT) + 1)) AS k)),
ranked AS (SELECT slot, src, blocks, stride, row_number() OVER (PARTITION BY src ORDER BY slot) - 1 AS r FROM points JOIN shares ON u >= lo AND u < hi),
times AS (SELECT src, (r % blocks * stride + r // blocks * (blocks // 3)) % blocks AS block, count(*) AS times, min(slot) AS least, sum(slot) AS total
  FROM ranked WHERE r < 3 * blocks GROUP BY 1, 2),
placed AS (
  SELECT row_number() OVER () AS n, d.doc_id, d.size, s.src, s.source_size, s.target, c.width, c.longer,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix|' || d.doc_id), d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN cut c USING (src)),
held AS (SELECT *, start + size - 1 AS stop FROM placed WHERE size > 0),
span AS (
  SELECT *, CASE WHEN start < longer * (width + 1) THEN start // (width + 1) ELSE longer + (start - longer * (width + 1)) // width END AS b0,
    CASE WHEN stop < longer * (width + 1) THEN stop // (width + 1) ELSE longer + (stop - longer * (width + 1)) // width END AS b1 FROM held),
parts AS (SELECT *, unnest(range(b0, b1 + 1)) AS block FROM span),
took AS (
  SELECT n, sum(times * (least(start + size, (block + 1) * width + least(block + 1, longer)) - greatest(start, block * width + least(block, longer)))) AS taken,
    min(least) AS first_slot, sum(total) AS slot_sum FROM parts JOIN times USING (src, block) GROUP BY n)
SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, first_slot, CAST(coalesce(slot_sum, 0) AS BIGINT) AS slot_sum
FROM placed LEFT JOIN took USING (n)
"""


def digest(mixed: DataFrame) -> DataFrame:
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "first_slot", "slot_sum")
