"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import bpe, chat, embeddings, lines, minhash, mixing, quality, token_counts, token_file, warc


def queries() -> dict:
    return {
        "op1_subspace_join": embeddings.op1_subspace_join,
        "embeddings_planted": embeddings.op1_planted,
        "op2_minhash": minhash.op2_minhash,
        "op3_warc_archive": warc.op3_warc_archive,
        "op4_byte_bpe": bpe.op4_byte_bpe,
        "op5_quality_rules": quality.op5_quality_rules,
        "op6_token_counts": token_counts.op6_token_counts,
        "op7_chat_perspectives": chat.op7_chat_perspectives,
        "op8_token_file": token_file.op8_token_file,
        "op9_fuzzy_lines": lines.op9_fuzzy_lines,
        "op10_mixing": mixing.op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    """Tokenizers are beyond SQL; their tests hold them against the libraries."""
    return {
        "op1_subspace_join": embeddings.SQL,
        "embeddings_planted": embeddings.PLANTED_SQL,
        "op2_minhash": minhash.SQL,
        "op3_warc_archive": warc.SQL,
        "op5_quality_rules": quality.SQL,
        "op7_chat_perspectives": chat.SQL,
        "op9_fuzzy_lines": lines.SQL,
        "op10_mixing": mixing.SQL,
    }
