"""Ranked lexical search as a blocked sparse matrix product.

Items (the queries) are the rows of a sparse matrix of term multiplicities, documents the columns of a sparse matrix of
whole-number impacts; their product is the scores.  Documents are tokenised once and written as blocks of some MB of text,
each a term-document matrix in compressed rows (terms; documents and counts).  Corpus statistics (documents with a term, N
and L) are sums over all blocks.  Each block is then multiplied: an item's row is the merge of its terms' rows (Gustavson),
added up in int64, and the block's best k of every item are kept; a task merges the best of its blocks before Spark ranks
what the tasks found.

Terms are the longest runs of 0-9, A-Z, a-z and characters beyond ASCII, with only A-Z lower-cased.  With n a document's
terms, N documents that have any, L the terms of all, df the documents with a term and tf its count in one:

    weight = floor(1000 * ln((2 N + 2) / (2 df + 1)))
    m      = 100 - 75 + (75 * n * N) div L
    score  = sum over the item's terms, repeats included, of weight * ((1000000000 * tf) div (1000 * tf + 8 * m))

Items meet documents in blocks of at most about ENTRIES item terms, which bounds what is broadcast; every block of items
reads all documents.

Results: a null or term-free text, of an item or a document, matches nothing; rows that repeat an item_id are one item with
the terms of all; rows that repeat a doc_id are documents of their own, and if they tie the order among them means nothing,
as they are equal; rows without id take no part; ties go to the smaller doc_id; no items or documents: no rows.  Other
columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, doc_texts, materialize, new_path, record, release_caches, run_starts, spread, text_blocks, trim

K = 10
ENTRIES = 1 << 20  # item terms multiplied at a time: bounds the broadcast
BLOCK_BYTES = 4_000_000  # text of a block of documents; a longer text is a block of its own
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

BLOCKS = pa.schema([("n_docs", pa.int64()), ("n_terms", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("terms", pa.binary()), ("dfs", pa.binary()), ("docs", pa.binary()), ("tfs", pa.binary())])
BLOCKS_DDL = "n_docs long, n_terms long, ids binary, sizes binary, terms binary, dfs binary, docs binary, tfs binary"
FOUND = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms_of(raw: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order.  Folding makes every other byte a space; no byte beyond ASCII is one."""
    return raw.translate(FOLD).split()


# ---------------------------------------------------------------- matrices
class Items:
    """Items by terms: multiplicities in compressed rows, and the vocabulary that numbers the terms."""

    def __init__(self, rows: dict[int, Counter]):
        self.vocabulary: dict[bytes, int] = {}
        self.ids = np.array(sorted(rows), np.int64)
        terms, times, ends = [], [], [0]
        for i in self.ids.tolist():
            for t, n in sorted(rows[i].items()):
                terms.append(self.vocabulary.setdefault(t, len(self.vocabulary)))
                times.append(n)
            ends.append(len(terms))
        self.terms, self.times, self.ends = np.array(terms, np.int64), np.array(times, np.int64), np.array(ends, np.int64)


def term_document(texts: list[bytes], vocabulary: dict[bytes, int]):
    """Sizes of the texts in terms, and the rows of the vocabulary's terms: terms, dfs, docs, tfs."""
    sizes, at, docs = np.empty(len(texts), np.int64), [], []
    for i, raw in enumerate(texts):
        words = terms_of(raw)
        sizes[i] = len(words)
        known = np.fromiter(map(vocabulary.get, words, [-1] * len(words)), np.int64, len(words))
        known = known[known >= 0]
        at.append(known)
        docs.append(np.full(len(known), i, np.int64))
    cell = np.sort(np.concatenate(at) * len(texts) + np.concatenate(docs)) if texts else np.empty(0, np.int64)
    first = run_starts(cell)
    tfs = np.diff(np.append(first, len(cell)))
    cell = cell[first]
    term, doc = cell // max(1, len(texts)), cell % max(1, len(texts))
    row = run_starts(term)
    return sizes, term[row], np.diff(np.append(row, len(term))), doc, tfs


def impacts(tfs: np.ndarray, sizes: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a term's count adds to a score before its weight."""
    m = 100 - 75 + 75 * sizes * n // total
    return 1_000_000_000 * tfs // (1000 * tfs + 8 * m)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores above 0, greatest first, ties by id."""
    at = np.flatnonzero(scores > 0)
    if len(at) > k:
        least = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= least]
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def multiply(items: Items, weights: np.ndarray, ids, sizes, terms, dfs, docs, tfs, n: int, total: int, k: int):
    """For each item of the block's product that has any: item, ids and scores of its best k documents."""
    values = np.repeat(weights[terms], dfs) * impacts(tfs, sizes[docs], n, total)
    starts = np.zeros(len(weights), np.int64)
    lengths = np.zeros(len(weights), np.int64)
    starts[terms], lengths[terms] = np.cumsum(dfs) - dfs, dfs
    for i in range(len(items.ids)):
        row = slice(items.ends[i], items.ends[i + 1])
        at, times = items.terms[row], items.times[row]
        places = spread(starts[at], lengths[at])
        if len(places):
            scores = np.zeros(len(ids), np.int64)
            np.add.at(scores, docs[places], values[places] * np.repeat(times, lengths[at]))
            top = best(scores, ids, k)
            if len(top):
                yield i, ids[top], scores[top]


# ---------------------------------------------------------------- Spark
def _blocks(docs: DataFrame, vocabulary) -> DataFrame:
    """The documents as term-document blocks; vocabulary: a broadcast."""

    def build(batches):
        known = vocabulary.value
        for ids, texts in text_blocks(batches, BLOCK_BYTES):
            sizes, terms, dfs, at, tfs = term_document(texts, known)
            small = lambda x: x.astype(np.int32).tobytes()
            packed = (np.array(ids, np.int64).tobytes(), sizes.tobytes(), small(terms), small(dfs), small(at), small(tfs))
            yield record(BLOCKS, [int((sizes > 0).sum())], [int(sizes.sum())], *([x] for x in packed))

    return docs.mapInArrow(build, BLOCKS_DDL)


def _frequencies(blocks: DataFrame, size: int) -> np.ndarray:
    """Documents of each of the vocabulary's terms: sums in the tasks, then by term."""

    def add(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            for terms, dfs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[np.frombuffer(terms, np.int32)] += np.frombuffer(dfs, np.int32)
        at = np.flatnonzero(total)
        yield record(pa.schema([("term", pa.int64()), ("df", pa.int64())]), at, total[at])

    out = np.zeros(size, np.int64)
    counts = blocks.select("terms", "dfs").mapInArrow(add, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    for r in counts.collect():  # no more rows than a block of items has terms
        out[r.term] = r.df
    return out


def _products(blocks: DataFrame, shared, k: int) -> DataFrame:
    """Best documents of every item in the blocks of a task; shared: a broadcast of items, weights, N and L."""

    def run(batches):
        release_caches()
        items, weights, n, total = shared.value
        have: dict[int, list] = {}
        for b in batches:
            for j in range(b.num_rows):
                ids, sizes, *rest = (np.frombuffer(b.column(c)[j].as_py(), t) for c, t in enumerate([np.int64, np.int64] + [np.int32] * 4))
                for i, docs, scores in multiply(items, weights, ids, sizes, *(x.astype(np.int64) for x in rest), n, total, k):
                    if i in have:
                        docs, scores = np.concatenate((have[i][0], docs)), np.concatenate((have[i][1], scores))
                        top = best(scores, docs, k)
                        docs, scores = docs[top], scores[top]
                    have[i] = (docs, scores)
        if have:
            order = sorted(have)
            lengths = [len(have[i][0]) for i in order]
            yield record(FOUND, np.repeat(items.ids[order], lengths), *(np.concatenate([have[i][c] for i in order]) for c in (0, 1)))
        trim()

    return blocks.select("ids", "sizes", "terms", "dfs", "docs", "tfs").mapInArrow(run, "item_id long, doc_id long, score long")


def _item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, times."""
    ddl, schema = "item_id long, term binary, times long", pa.schema([("item_id", pa.int64()), ("term", pa.binary()), ("times", pa.int64())])

    def cut(batches):
        for ids, texts in text_blocks(batches):
            rows = [(i, t, n) for i, raw in zip(ids, texts) for t, n in Counter(terms_of(raw)).items()]
            if rows:
                yield record(schema, *map(list, zip(*rows)))

    rows = doc_texts(items.select(F.col("item_id").alias("doc_id"), "text")).mapInArrow(cut, ddl)
    return rows.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def search(docs: DataFrame, items: DataFrame, k: int = K, entries: int = ENTRIES) -> DataFrame:
    """docs (doc_id, text) and items (item_id, text) -> item_id, rank from 1, doc_id, score: each item's k best."""
    spark = docs.sparkSession
    wanted = materialize(_item_terms(items), "item-terms")
    parts = -(-wanted.count() // entries)
    path, texts, empty = new_path(spark, "found"), doc_texts(docs), True
    for part in range(parts):
        rows: dict[int, Counter] = {}
        for r in wanted.filter(F.expr(f"pmod(xxhash64(item_id), {parts}) = {part}")).toLocalIterator():  # about ``entries`` rows
            rows.setdefault(r.item_id, Counter())[bytes(r.term)] += r.times
        matrix = Items(rows)
        vocabulary = spark.sparkContext.broadcast(matrix.vocabulary)
        blocks = materialize(_blocks(texts, vocabulary), "term-documents")
        n, total = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        df = _frequencies(blocks, len(matrix.vocabulary))
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        matrix.vocabulary = {}
        shared = spark.sparkContext.broadcast((matrix, weights, n, total))
        _products(blocks, shared, k).write.mode("append").parquet(path)
        empty = False
        discard(blocks)
        vocabulary.destroy()
        shared.destroy()
    discard(wanted)
    found = spark.createDataFrame([], "item_id long, doc_id long, score long") if empty else spark.read.schema("item_id long, doc_id long, score long").parquet(path)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents WHERE doc_id IS NOT NULL),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY 1),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sizes),
counts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY 1, 2),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL),
items AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY 1, 2),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM counts, corpus GROUP BY term, docs),
scored AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // total)))) AS BIGINT) AS score
  FROM items JOIN weights USING (term) JOIN counts USING (term) JOIN sizes USING (doc_id), corpus GROUP BY 1, 2),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
