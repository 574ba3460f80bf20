"""One query for each operator, over whole tables, with SQL where SQL can express it."""

from __future__ import annotations

from weftline.llm import align, chat, decontaminate, exact, fim, language, mixing, near, quality, scoring, substrings, suffixes, token_files
from weftline.llm.common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark, sf_dir):
    return token_files.token_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_lsh_forest(spark, sf_dir):
    return near.near_groups(table(spark, sf_dir, "documents"), width=2)


def op3_exact_dedup(spark, sf_dir):
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op4_chat_rotation(spark, sf_dir):
    return chat.with_text_mask(chat.rotate(table(spark, sf_dir, "conversations")))


def op5_quality_votes(spark, sf_dir):
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontamination(spark, sf_dir):
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_substring_dedup(spark, sf_dir):
    return substrings.repeats(table(spark, sf_dir, "documents"))


def op8_bloom_lm(spark, sf_dir):
    return scoring.scores(table(spark, sf_dir, "documents"))


def op9_language(spark, sf_dir):
    return language.predictions(table(spark, sf_dir, "documents"))


def op10_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark, sf_dir):
    """Fill-in-middle forms of all documents, each with the digests of its output and of the text restored from it."""
    return fim.digests(fim.fill_in_middle(table(spark, sf_dir, "documents")))


def op12_suffix_dedup(spark, sf_dir):
    """Bytes of all documents that lie in a 400-byte string which also starts elsewhere, and the digest of the others."""
    return suffixes.digests(suffixes.covered(table(spark, sf_dir, "documents")))


def op13_alignment(spark, sf_dir):
    """Alignment of the byte-level and the piece vocabulary's tokens in all documents, with corpus-wide counts of linked ids."""
    return align.alignment_digests(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_lsh_forest": op2_lsh_forest,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_chat_rotation": op4_chat_rotation,
    "op5_quality_votes": op5_quality_votes,
    "op6_decontamination": op6_decontamination,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_bloom_lm": op8_bloom_lm,
    "op9_language": op9_language,
    "op10_mixing": op10_mixing,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_alignment": op13_alignment,
}

ORACLES = {
    "op2_lsh_forest": near.SQL,
    "op3_exact_dedup": exact.SQL,
    "op4_chat_rotation": chat.SQL,
    "op10_mixing": mixing.SQL,
    "op11_fill_in_middle": fim.SQL,
}
