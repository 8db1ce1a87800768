"""Queries of the training-data operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from .common import table


def op1_ngram_jaccard(spark, sf_dir):
    from .ngram_jaccard import digest, jaccard_join

    return digest(jaccard_join(table(spark, sf_dir, "documents")))


def op2_token_files(spark, sf_dir):
    import public_tokenizers

    from .token_files import read_tokens, write_tokens

    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0))


def op3_source_mixing(spark, sf_dir):
    from .mixing import digest, mix

    return digest(mix(table(spark, sf_dir, "documents")))


def op4_quality_cotrain(spark, sf_dir):
    from .quality_cotrain import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_suffix_dedup(spark, sf_dir):
    from .suffix_dedup import dedup_suffixes, digest

    return digest(dedup_suffixes(table(spark, sf_dir, "documents")))


def op6_url_filter(spark, sf_dir):
    from .url_filter import default_rules, judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), default_rules(spark))


def op7_bpe_round_trip(spark, sf_dir):
    import public_tokenizers

    from .bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_tiff_media(spark, sf_dir):
    from .tiff import decode_pages, digest, store_texts

    return digest(decode_pages(store_texts(table(spark, sf_dir, "documents"))))


def op9_srs_search(spark, sf_dir):
    from .srs_search import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op10_substring_dedup(spark, sf_dir):
    from .substring_dedup import dedup_substrings, digest

    return digest(dedup_substrings(table(spark, sf_dir, "documents")))


def op11_prefix_trie(spark, sf_dir):
    from .prefix_trie import rebuilt_trie

    return rebuilt_trie(table(spark, sf_dir, "conversations"))


def op12_lexical_search(spark, sf_dir):
    from .lexical_search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_chat_format(spark, sf_dir):
    from .chat_format import digest, format_conversations, probe

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digest(format_conversations(turns.unionByName(probe(spark))))


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_token_files": op2_token_files,
    "op3_source_mixing": op3_source_mixing,
    "op4_quality_cotrain": op4_quality_cotrain,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_bpe_round_trip": op7_bpe_round_trip,
    "op8_tiff_media": op8_tiff_media,
    "op9_srs_search": op9_srs_search,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_lexical_search": op12_lexical_search,
    "op13_chat_format": op13_chat_format,
}


def _oracles() -> dict[str, str]:
    from . import chat_format, lexical_search, mixing, ngram_jaccard, prefix_trie, substring_dedup, url_filter

    return {
        "op1_ngram_jaccard": ngram_jaccard.ORACLE_SQL,
        "op3_source_mixing": mixing.ORACLE_SQL,
        "op6_url_filter": url_filter.ORACLE_SQL,
        "op10_substring_dedup": substring_dedup.ORACLE_SQL,
        "op11_prefix_trie": prefix_trie.ORACLE_SQL,
        "op12_lexical_search": lexical_search.ORACLE_SQL,
        "op13_chat_format": chat_format.ORACLE_SQL,
    }


ORACLE_SQL: dict[str, str] = _oracles()
