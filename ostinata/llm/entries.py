"""Queries of the training-data operators for the driver's contract, and their SQL where there is one."""

from __future__ import annotations

from ostinata.llm.bpe import bpe_round_trip, op9_bpe
from ostinata.llm.chat import op6_chat_format
from ostinata.llm.embedding_dedup import OP4_SQL, op4_embedding_dedup
from ostinata.llm.licenses import op2_license_scan
from ostinata.llm.minhash_dedup import op10_minhash_dedup
from ostinata.llm.mixing import op8_source_mixing
from ostinata.llm.quality_crf import op7_quality_crf
from ostinata.llm.topk import OP3_SQL, op3_topk_search
from ostinata.llm.toxicity_ssk import op5_toxicity_ssk
from ostinata.llm.warc import OP1_SQL, op1_warc_archive

QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_archive, op2_license_scan, op3_topk_search, op4_embedding_dedup, op5_toxicity_ssk,
        op6_chat_format, op7_quality_crf, op8_source_mixing, op9_bpe, op10_minhash_dedup, bpe_round_trip,
    )
}

ORACLE_SQL = {
    "op1_warc_archive": OP1_SQL,
    "op3_topk_search": OP3_SQL,
    "op4_embedding_dedup": OP4_SQL,
    "bpe_round_trip": "SELECT doc_id, text FROM documents",
}
