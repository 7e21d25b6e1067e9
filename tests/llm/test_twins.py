"""Every corpus query that SQL can express against its DuckDB twin on the smallest tables."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from compare import differences, duck
from trackloom.llm.oracles import ORACLES
from trackloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_its_twin(spark, con, name):
    assert not differences(spark, con, QUERIES[name], ORACLES[name], SF)


def test_line_dedup_twin_generalises(spark, tmp_path):
    """Templates with a variable word, a repeated row, a null and an empty text, blank lines and a copy."""
    words = "amber birch cedar delta ember fjord grove heath".split()
    texts = [f"own tale {w} told at length in {w} words by {w} and by nobody else, which only this document says and nothing repeats in any other text\n\nposted by user {w} on the old public board today\r\n  ref\t{n}  of 9\n" for n, w in enumerate(words)]
    texts += [texts[0], None, "", "posted by user amber on the old public board today", "\n\n"]
    ids = [*range(len(words)), 0, 20, 21, 22, 23]
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string())}), tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    name = "op9_line_dedup"
    assert not differences(spark, con, QUERIES[name], ORACLES[name], str(tmp_path))
    dropped = dict(con.execute(f"SELECT doc_id, max(dropped) FROM ({ORACLES[name]}) GROUP BY doc_id").fetchall())
    assert dropped[3] == "2,3" and dropped[22] == "0" and dropped[21] == ""
