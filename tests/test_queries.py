"""Every registered query of the engine against its SQL; those without SQL give rows."""

from __future__ import annotations

import pytest

from lodestone.queries import ORACLE_SQL, QUERIES
from tests.oracle import connection, same_rows


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLE_SQL:
        same_rows(df, ORACLE_SQL[name], con)
    else:
        assert df.count() > 0


def test_changed_paths_of_large_documents(spark, tmp_path):
    """Documents around the cap, new, touched, the same or gone, with repeated ids and nulls."""
    lengths = (100, 20_000, 20_001, 90_000, None)
    rows = [(i, None if i % 29 == 3 else f"s{i % 4}", n, "en", "x" * (i % 5)) for i in range(420) for n in lengths[i % 5 :][: 2 if i % 11 == 0 else 1]]
    rows += [(None, "s1", 90_000, "en", "y"), (3, None, 90_000, "en", None)]
    spark.createDataFrame(rows, "doc_id long, source string, n_chars long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    same_rows(QUERIES["changed_paths"](spark, str(tmp_path)), ORACLE_SQL["changed_paths"], connection(str(tmp_path)))
