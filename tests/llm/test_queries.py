"""The registered queries against their SQL twins, and the contract's view of them."""

import __spark_entry__ as contract
import pytest
from conftest import SF_DIR
from corpusloom.llm import queries
from oracle_check import compare, connect

WITHOUT_SQL = (
    "op4_toxicity", "op8_pii", "op5_substring_dedup", "op3_sentencepiece", "op7_token_counts", "op13_whitening",
)


def test_all_are_registered():
    known = contract.queries()
    assert {*queries.QUERIES, "pipeline"} <= set(known)
    assert set(queries.ORACLES) | set(WITHOUT_SQL) == set(queries.QUERIES)
    assert queries.ORACLES.items() <= contract.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, sf_dir, name):
    ok, message, _ = compare(spark, connect(SF_DIR), name, queries.QUERIES[name], queries.ORACLES[name], SF_DIR)
    assert ok, message


def test_columns(spark, sf_dir):
    scored = queries.op4_toxicity(spark, sf_dir)
    assert scored.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    counted = queries.op7_token_counts(spark, sf_dir)
    assert counted.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    coded = queries.op3_sentencepiece(spark, sf_dir)
    assert coded.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
