"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

import corpus_pipeline


def queries() -> dict:
    from .bpe_count import op2_bpe_count
    from .chat import op4_chat_round_trip
    from .katz import op9_katz
    from .pii import op10_pii
    from .piece_bpe import op8_piece_bpe
    from .quality_rff import op7_quality_rff
    from .rare_digest import op3_rare_digest
    from .shard_packing import op11_shard_packing
    from .simhash_gph import op6_simhash_gph
    from .suffix_dedup import op1_suffix_dedup
    from .target_resample import op12_target_resample
    from .turn_repair import op13_turn_repair
    from .wu_manber import op5_wu_manber
    found = [op1_suffix_dedup, op2_bpe_count, op3_rare_digest, op4_chat_round_trip, op5_wu_manber, op6_simhash_gph,
             op7_quality_rff, op8_piece_bpe, op9_katz, op10_pii, op11_shard_packing, op12_target_resample, op13_turn_repair]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    from .chat import OP4_SQL
    from .target_resample import OP12_SQL
    from .turn_repair import OP13_SQL
    from .wu_manber import OP5_SQL
    return {"op4_chat_round_trip": OP4_SQL, "op5_wu_manber": OP5_SQL, "op12_target_resample": OP12_SQL, "op13_turn_repair": OP13_SQL}
