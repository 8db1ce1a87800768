"""Segmentation: blocks, chunks, Markdown states.  Greedy chunking is one fold over the sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import sentences, text_hash, word_count

CHUNK_STATE = "struct<done: array<string>, cur: array<string>, n: int>"


def chunks(text, max_chars: int = 500) -> Column:
    """Greedy sentence chunks without overlap; a chunk's length counts its sentences, not the spaces between."""
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), empty.alias("cur"), F.lit(0).alias("n"))

    def step(s, x):
        full = (s.n + F.length(x) > max_chars) & (F.size(s.cur) > 0)
        return F.struct(
            F.when(full, F.concat(s.done, F.array(F.array_join(s.cur, " ")))).otherwise(s.done).alias("done"),
            F.when(full, F.array(x)).otherwise(F.concat(s.cur, F.array(x))).alias("cur"),
            F.when(full, F.length(x)).otherwise(s.n + F.length(x)).alias("n"),
        )

    end = lambda s: F.when(F.size(s.cur) > 0, F.concat(s.done, F.array(F.array_join(s.cur, " ")))).otherwise(s.done)
    return F.aggregate(sentences(text), start, step, end)


def overlapping_chunks(text, max_chars: int = 500, overlap: int = 100) -> Column:
    """Greedy sentence chunks; each starts with the last sentences of the one before whose lengths add up to overlap at
    most."""
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), empty.alias("cur"), F.lit(0).alias("n"))
    nothing = F.struct(empty.alias("kept"), F.lit(0).alias("n"), F.lit(False).alias("stop"))

    def tail(cur):
        def take(s, x):
            over = s.stop | (s.n + F.length(x) > overlap)
            return F.struct(F.when(over, s.kept).otherwise(F.concat(F.array(x), s.kept)).alias("kept"), F.when(over, s.n).otherwise(s.n + F.length(x)).alias("n"), over.alias("stop"))

        return F.aggregate(F.reverse(cur), nothing, take)

    def step(s, x):
        full = (s.n + F.length(x) > max_chars) & (F.size(s.cur) > 0)
        kept = tail(s.cur)
        return F.struct(
            F.when(full, F.concat(s.done, F.array(F.array_join(s.cur, " ")))).otherwise(s.done).alias("done"),
            F.when(full, F.concat(kept.kept, F.array(x))).otherwise(F.concat(s.cur, F.array(x))).alias("cur"),
            F.when(full, kept.n + F.length(x)).otherwise(s.n + F.length(x)).alias("n"),
        )

    end = lambda s: F.when(F.size(s.cur) > 0, F.concat(s.done, F.array(F.array_join(s.cur, " ")))).otherwise(s.done)
    return F.aggregate(sentences(text), start, step, end)


def front_matter(md) -> dict[str, Column]:
    """The YAML text between the first two '---' and the body after them."""
    parts = F.split(md, "---", 3)
    has = md.startswith("---") & (F.size(parts) == 3)
    return {"yaml": F.when(has, F.trim(F.get(parts, F.lit(1)))), "body": F.when(has, F.get(parts, F.lit(2))).otherwise(md)}


def yaml_value(yaml, key: str) -> Column:
    """A scalar of flat YAML."""
    v = F.regexp_extract(yaml, f"(?m)^{key}:[ \\t]*['\"]?(.*?)['\"]?[ \\t]*$", 1)
    return F.when(v != "", v)


def _lines(docs: DataFrame, text: str) -> DataFrame:
    rows = docs.select("article_id", F.posexplode(F.split(text, "\\n")).alias("line_no", "raw"))
    return rows.withColumn("line", F.trim(F.regexp_replace("raw", "(?U)^\\s+|\\s+$", "")))


def _blocks(rows: DataFrame, breaks: Column, state: list[str]) -> DataFrame:
    """Lines between breaks, joined by one space, with the states of their first line."""
    by_line = Window.partitionBy("article_id").orderBy("line_no")
    rows = rows.withColumn("block", F.sum(F.when(breaks, 1).otherwise(0)).over(by_line))
    firsts = [F.min_by(c, "line_no").alias(c) for c in state]
    lines = F.array_sort(F.collect_list(F.when(~breaks, F.struct("line_no", "line"))))
    out = rows.groupBy("article_id", "block").agg(lines.alias("lines"), F.min(F.when(~breaks, F.col("line_no"))).alias("first"), *firsts)
    return out.filter(F.size("lines") > 0).withColumn("text", F.array_join(F.transform("lines", lambda x: x.line), " ")).drop("lines")


def plain_segments(docs: DataFrame, max_chars: int = 500, min_words: int = 5) -> DataFrame:
    """docs (article_id, text) -> paragraphs of blocks between blank lines, rules, comments and headings; short blocks
    are left out and long ones cut into chunks.  Ids are <article>_P000001 and, for chunks, _S01; larger numbers have more digits."""
    rows = _lines(docs, "text")
    breaks = (F.col("line") == "") | F.col("line").rlike("^(---|<!--|#)")
    blocks = _blocks(rows, breaks, []).filter(word_count("text") >= min_words)
    blocks = blocks.withColumn("p", F.row_number().over(Window.partitionBy("article_id").orderBy("first")))
    blocks = blocks.withColumn("long", F.length("text") > max_chars)
    parts = F.when(F.col("long"), chunks(F.col("text"), max_chars)).otherwise(F.array("text"))
    out = blocks.select("article_id", "p", "long", F.posexplode(parts).alias("c", "text"))
    base = F.concat(F.col("article_id").cast("string"), F.lit("_P"), F.format_string("%06d", "p"))
    pid = F.when(F.col("long"), F.concat(base, F.lit("_S"), F.format_string("%02d", F.col("c") + 1))).otherwise(base)
    index = F.row_number().over(Window.partitionBy("article_id").orderBy("p", "c"))
    return out.select(pid.alias("paragraph_id"), "article_id", index.alias("paragraph_index"), "text", text_hash("text").alias("text_sha256"), F.lit("RAW").alias("status"))


def markdown_segments(docs: DataFrame, min_words: int = 8, min_chars: int = 40, max_chars: int = 500, long_text: str = "chunk", overlap: int = 100) -> DataFrame:
    """docs (article_id, text) -> segments with page, section and subsection carried from the markers above them.
    Short blocks stay with the status excluded_short_fragment; long ones are cut, truncated or set aside."""
    parts = front_matter(F.col("text"))
    rows = _lines(docs.select("article_id", parts["body"].alias("text")), "text")
    page = F.regexp_extract("line", "<!--\\s*page:\\s*(\\d+)\\s*-->", 1)
    marks = F.length(F.regexp_extract("line", "^(#{1,6})\\s+(.+)$", 1))
    heading = F.trim(F.regexp_extract("line", "^(#{1,6})\\s+(.+)$", 2))
    rows = rows.withColumn("page_mark", F.when(page != "", page.cast("int"))).withColumn("marks", marks)
    so_far = Window.partitionBy("article_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(so_far)
    rows = rows.withColumn("page", F.coalesce(last(F.col("page_mark")), F.lit(1)))
    rows = rows.withColumn("section", F.coalesce(last(F.when(F.col("marks").between(1, 2), heading)), F.lit("")))
    sub = F.when(F.col("marks").between(1, 2), F.lit("")).when(F.col("marks") > 2, heading)
    rows = rows.withColumn("subsection", F.coalesce(last(sub), F.lit("")))
    breaks = (F.col("line") == "") | F.col("page_mark").isNotNull() | (F.col("marks") > 0)
    b = _blocks(rows, breaks, ["page", "section", "subsection"])
    b = b.withColumn("p", F.row_number().over(Window.partitionBy("article_id").orderBy("first")))
    words, chars = word_count("text"), F.length("text")
    short = (words < min_words) | (chars < min_chars)
    long = ~short & (chars > max_chars)
    whole = F.array("text")
    cut = {"chunk": overlapping_chunks(F.col("text"), max_chars, overlap), "truncate": F.array(F.substring("text", 1, max_chars))}.get(long_text, whole)
    status = F.when(short, "excluded_short_fragment").when(long & F.lit(long_text not in ("chunk", "truncate")), "excluded_too_long").otherwise("valid_paragraph")
    b = b.withColumn("status", status).withColumn("is_chunk", long & F.lit(long_text == "chunk")).withColumn("parts", F.when(long, cut).otherwise(whole))
    out = b.select("*", F.size("parts").alias("n_parts"), F.posexplode("parts").alias("c", "piece"))
    pid = F.concat(F.lit("P"), F.format_string("%04d", "p"))
    cid = F.when(F.col("is_chunk"), F.concat(pid, F.lit("_C"), F.format_string("%02d", F.col("c") + 1)))
    return out.select(
        F.concat_ws("_", F.col("article_id").cast("string"), F.coalesce(cid, pid)).alias("segment_id"), "article_id", pid.alias("paragraph_id"),
        "section", "subsection", F.col("page").alias("page_start"), F.col("page").alias("page_end"), F.col("piece").alias("text"),
        text_hash("piece").alias("text_sha256"), word_count("piece").alias("word_count"), F.length("piece").alias("char_count"), "status", "is_chunk",
        cid.alias("chunk_id"), F.when(F.col("is_chunk"), F.col("c") + 1).alias("chunk_index"), F.when(F.col("is_chunk"), F.col("n_parts")).alias("total_chunks"),
        (F.row_number().over(Window.partitionBy("article_id").orderBy("p", "c")) - 1).alias("segment_index_in_doc"),
    )
