"""Registered queries against their DuckDB SQL; those without SQL run whole and keep their contract's columns."""
import pytest

import __spark_entry__ as entry
from barlake.llm import queries
from harness import compare, duck_connect

COLUMNS = {
    "op2_quality_ranking": ["doc_id", "held_out", "score", "predicted"],
    "op4_pii_surrogates": ["doc_id", "text", "n_mentions", "types"],
    "op6_rendezvous_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op8_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op10_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op12_cost_balanced_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "sequence_cost"],
    "pipeline": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, sf_dir, name):
    result = compare(entry.queries()[name](spark, sf_dir), duck_connect(sf_dir), entry.oracle_sql()[name])
    assert result["hash_match"], result


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_keeps_its_columns(spark, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    assert df.columns == COLUMNS[name]
    rows = df.count()
    if name not in ("pipeline", "op12_cost_balanced_packing"):
        assert rows == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
