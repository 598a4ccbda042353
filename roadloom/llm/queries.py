"""Registered queries of this subpackage and the SQL of those that SQL can express."""

from roadloom.llm import collocations, langid, merkle, mixing, packing, pii, quality, quality_classifier, shingle_join, toxicity, url_filter, vectors, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_packing": packing.op2_packing,
    "op3_near_vectors": vectors.op3_near_vectors,
    "op4_shingle_join": shingle_join.op4_shingle_join,
    "op5_temperature_mixing": mixing.op5_temperature_mixing,
    "op6_warc": warc.op6_warc,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_quality": quality.op8_quality,
    "op9_pii": pii.op9_pii,
    "op10_language_id": langid.op10_language_id,
    "op11_merkle": merkle.op11_merkle,
    "op12_collocations": collocations.op12_collocations,
    "op13_quality_classifier": quality_classifier.op13_quality_classifier,
}

ORACLE_SQL = {"op7_url_filter": url_filter.ORACLE_OP7, "op11_merkle": merkle.ORACLE_OP11, "op12_collocations": collocations.ORACLE_OP12}
