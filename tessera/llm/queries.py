"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import audio, bpe, chat, invariants, language_id, minhash, packing, simple8b, topk, toxicity, url_lists

QUERIES = {
    f.__name__: f
    for f in (
        chat.op1_chat_format, chat.op1_rendered, topk.op2_exact_topk, packing.op3_bestfit_pack, toxicity.op4_toxicity, minhash.op5_minhash_dedup,
        simple8b.op6_simple8b, language_id.op7_language_id, bpe.op8_bpe, url_lists.op9_url_filter, url_lists.op9_url_filter_listed, audio.op10_telephony_audio,
    )
} | invariants.QUERIES
ORACLES = {"op1_rendered": chat.OP1_RENDERED_SQL, "op2_exact_topk": topk.OP2_SQL, "op9_url_filter": url_lists.OP9_SQL, "op9_url_filter_listed": url_lists.OP9_LISTED_SQL} | invariants.ORACLES
