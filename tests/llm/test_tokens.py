import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")
from litspark.llm import bpe, token_files  # noqa: E402
from litspark.llm.token_cache import load_tokenizer  # noqa: E402

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
TEXT = {p: open(p, encoding="utf-8").read() for p in (BYTE, WORD)}
TOK = {p: load_tokenizer(t) for p, t in TEXT.items()}
mixed = st.text(st.sampled_from(list("abcé'sdtl .,\n\t\r\u00a0\u2003\u0301Σ1 ½漢🙂<|endoftext>  ")), max_size=200)
pieced = st.lists(st.sampled_from(["the", " ", "  ", "\n", "don't", "<|endoftext|>", "<|startoftext|>", "É", "x" * 40, "\u200b", "\u0085", "'s", "12", "漢字漢字"]), max_size=40).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.one_of(mixed, pieced))
@example("a<|endoftext|> b \u180e c")
def test_pieces_give_the_library_s_ids(text):
    want = TOK[BYTE].encode(text, add_special_tokens=False).ids
    got = np.frombuffer(token_files.encode_texts([text.encode()], TEXT[BYTE])[0], "<u4").tolist()
    assert got == want


@settings(max_examples=400, deadline=None)
@given(st.one_of(mixed, pieced), st.sampled_from([2, 4096]))
def test_chunks_give_the_library_s_ids(text, inside):
    bpe.INSIDE, old = inside, bpe.INSIDE
    try:
        got = np.frombuffer(bpe.encode_texts([text.encode()], TEXT[WORD])[0], "<u4").tolist()
    finally:
        bpe.INSIDE = old
    assert got == TOK[WORD].encode(text, add_special_tokens=False).ids


def rows():
    rng = random.Random(3)
    words = ["the", "Entione", "ñoso", "über!!", "a\nb", "12", "<|endoftext|>"]
    out = [(i * 3, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(40)]
    return out + [(1, None), (2, ""), (7, "x" * 5000), (500, "\n \t"), (8, out[3][1])]


def test_files(spark):
    data = rows()
    df = spark.createDataFrame([(*r, 1) for r in data], "doc_id long, text string, start int").repartition(3)
    manifest = token_files.write_tokens(df, BYTE, 0)
    got = sorted(map(tuple, token_files.read_tokens(manifest).collect()))
    want, start = [], 0
    for doc_id, text in sorted(data):
        ids = [*TOK[BYTE].encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert token_files.read_tokens(token_files.write_tokens(df.limit(0), BYTE, 0)).count() == 0


def test_encode_decode(spark):
    data = [*rows(), (1, None)]
    df = spark.createDataFrame([(*r, b"x") for r in data], "doc_id long, text string, ids binary").repartition(3)
    got = bpe.digest(bpe.decode_documents(bpe.encode_documents(df, WORD), WORD))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for doc_id, text in data:
        ids = TOK[WORD].encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(TOK[WORD].decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, got.collect())) == sorted(want) == sorted(map(tuple, bpe.round_trip(df, WORD).collect()))
    assert bpe.digest(bpe.decode_documents(bpe.encode_documents(df.limit(0), WORD), WORD)).count() == 0


def test_shared_chunks_are_encoded_once(spark, monkeypatch):
    """A passage of many documents is cut alike in each and its chunks come from the process's table; no result changes."""
    rng = random.Random(8)
    passage = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(400))
    raws = [f"{i} begins here {passage} ends {i}".encode() for i in range(30)]
    want = [TOK[WORD].encode(r.decode(), add_special_tokens=False).ids for r in raws]
    chunks = [c for cs, _ in bpe.chunk(raws) for c in cs]
    assert 8 < np.mean([len(c.split()) for c in chunks]) < 40 and len(set(chunks)) < len(chunks) / 5
    df = spark.createDataFrame(list(enumerate(r.decode() for r in raws)), "doc_id long, text string").repartition(3)
    mask = bpe.shared_chunks(df).probe()
    again = {c for c in set(chunks) if chunks.count(c) > 1}
    assert mask(bpe.chunk_cells(sorted(again))).all() and mask(bpe.chunk_cells(chunks)).mean() > 0.6
    bpe._chunks.clear()
    words, asked = bpe.process_cache(TEXT[WORD], "words", make=bpe._joining), []
    plain = words.values
    monkeypatch.setattr(words, "values", lambda lists: asked.append(len(lists)) or plain(lists))
    assert [np.frombuffer(x, "<u4").tolist() for r in raws for x in bpe.encode_texts([r], TEXT[WORD], mask)] == want
    assert sum(asked[1:]) < 0.5 * len(chunks)  # the rest was known from the first document


def test_clashing_names_and_nulls_in_ids(spark):
    df = spark.createDataFrame([(1, "a b", "x", 2), (None, "c", "y", 3)], "doc_id long, text string, raw string, ids int")
    assert [r.doc_id for r in bpe.round_trip(df, WORD).collect()] == [1]


def long_texts():
    rng = random.Random(21)
    words = ["the", "Entione", "ñoso", "über!!", "don't", "12", "漢字", "x" * 70]
    return [" ".join(rng.choices(words, k=60_000)), "".join(rng.choices("abcé ", k=200_000)), "ab" * 150_000, "\n" * 100_000]


def test_very_long_texts(spark):
    """Texts of some hundred thousand characters, one of them a single word, come out as the library encodes them."""
    data = list(enumerate(long_texts()))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(2)
    read = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_files.read_tokens(token_files.write_tokens(df, BYTE, 0)).collect()}
    back = {r.doc_id: r for r in bpe.round_trip(df, WORD).collect()}
    for doc_id, text in data:
        ids = [*TOK[BYTE].encode(text, add_special_tokens=False).ids, 0]
        assert read[doc_id] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        ids = TOK[WORD].encode(text, add_special_tokens=False).ids
        assert (back[doc_id].n_tokens, back[doc_id].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_rows_of_one_doc_id_follow_each_other(spark):
    data = [(5, "b"), (5, "a a a"), (5, None), (4, "c c"), (6, "d"), (5, "b")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_tokens(token_files.write_tokens(df, BYTE, 0)).collect())
    start, want = 0, []
    for doc_id, raw in sorted((d, (t or "").encode()) for d, t in data):
        ids = [*TOK[BYTE].encode(raw.decode(), add_special_tokens=False).ids, 0]
        want.append((start, doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
