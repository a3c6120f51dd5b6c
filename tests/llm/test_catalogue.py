"""Every training-data query against its SQL twin."""

from __future__ import annotations

import pytest

from __spark_entry__ import queries
from tools.check_queries import compare, connect
from varlake.llm.queries import ORACLES, QUERIES

# Models, tokenizers and hashes that SQL does not have: held against brute force in this folder.
NO_SQL = {
    "op1_lattice_scores", "op5_best_fit_packing", "op7_quality_rules", "op8_suffix_pieces", "op10_language_id",
    "op11_simhash_trie",
}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted([*QUERIES, "pipeline"]))
def test_query_matches_sql(spark, con, sf, name):
    result = compare(spark, con, name, sf)
    assert result.startswith(("ok", "rows-only")), result


def test_every_twin_has_a_query():
    assert set(QUERIES) - set(ORACLES) == NO_SQL
    assert set(QUERIES) | {"pipeline"} <= set(queries())
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14))
