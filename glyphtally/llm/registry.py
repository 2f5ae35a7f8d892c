"""The queries of this subpackage and their SQL; keys are the names in queries()."""

from . import embeddings, mixing, packing, pii, quality, repair, secrets, simhash, templates, urls

QUERIES = {
    "op1_embedding_near_dedup": embeddings.op1_embedding_near_dedup,
    "op2_token_grammars": repair.op2_token_grammars,
    "op3_mixing": mixing.op3_mixing,
    "op4_url_filters": urls.op4_url_filters,
    "op5_pii": pii.op5_pii,
    "op6_simhash_near_dedup": simhash.op6_simhash_near_dedup,
    "op7_line_dedup": templates.op7_line_dedup,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_secret_scans": secrets.op9_secret_scans,
    "op10_quality_rules": quality.op10_quality_rules,
}
SQL = {
    "op1_embedding_near_dedup": embeddings.SQL,
    "op3_mixing": mixing.SQL,
    "op4_url_filters": urls.SQL,
    "op10_quality_rules": quality.SQL,
}
