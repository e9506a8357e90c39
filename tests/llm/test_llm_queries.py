"""Every query of the subpackage runs; those with SQL give its rows; nothing else in the package imports it."""

import re
from pathlib import Path

import pytest
from compare import database, spark_rows, sql_rows

from corpusloom.llm.queries import QUERIES, SQL

COLUMNS = {
    "p1_found": ["id_a", "id_b"], "p2_found": ["id", "field_name", "line_no", "kind"], "p3_found": ["vector_name", "id_a", "id_b"], "p4_found": ["chunk_id", "cut_kind"],
    "p5_found": ["record_kind", "record_key", "lang"], "p7_found": ["chunk_id", "end_pos"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "grade"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    if name in SQL:
        assert spark_rows(df) == sql_rows(database(sf_dir), SQL[name])
    else:
        assert df.count() > 0


def test_nothing_else_imports_it():
    package = Path(__file__).resolve().parents[2] / "corpusloom"
    for p in package.rglob("*.py"):
        if "llm" not in p.relative_to(package).parts:
            assert not re.search(r"import.*\bllm\b|from corpusloom\.llm", p.read_text()), p
