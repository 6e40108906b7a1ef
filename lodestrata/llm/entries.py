"""The queries of this subpackage and, where SQL can express them, their SQL twins."""

from __future__ import annotations

from . import decontam, embeddings, html_text, langid, minhash, mixing, packing, phrases, quality, sharding, tokens, vector_codes, warc


def queries():
    return {
        "op1_quality": quality.op1_quality,
        "op2_packing": packing.op2_packing,
        "op3_html_text": html_text.op3_html_text,
        "op4_decontamination": decontam.op4_decontamination,
        "op5_warc": warc.op5_warc,
        "op6_token_files": tokens.op6_token_files,
        "op7_langid": langid.op7_langid,
        "op8_embedding_dedup": embeddings.op8_embedding_dedup,
        "op9_minhash": minhash.op9_minhash,
        "op10_sharding": sharding.op10_sharding,
        "op11_mixing": mixing.op11_mixing,
        "op12_phrases": phrases.op12_phrases,
        "op13_vector_codes": vector_codes.op13_vector_codes,
    }


def oracle_sql():
    return {"op5_warc": warc.OP5_SQL, "op8_embedding_dedup": embeddings.OP8_SQL, "op9_minhash": minhash.OP9_SQL, "op11_mixing": mixing.OP11_SQL, "op12_phrases": phrases.OP12_SQL, "op13_vector_codes": vector_codes.OP13_SQL}
