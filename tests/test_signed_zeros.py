import math
import os

import duckdb
import pytest
from oracle import SF

from lodestack.plans import queries as core


@pytest.mark.parametrize("name", ["l2_normalize", "vectors_validated"])
def test_small_negative_values_keep_their_sign(spark, tmp_path, name):
    """Equality to the bit, which tells -0.0 from 0.0."""
    at = tmp_path / "embeddings.parquet"
    duckdb.sql(f"COPY (SELECT vec_id, [CASE i WHEN 1 THEN -1e-8 WHEN 2 THEN 1e-8 WHEN 3 THEN -0.0 ELSE embedding[i] END FOR i IN range(1, 65)]::FLOAT[] AS embedding, label FROM '{SF}/embeddings.parquet' LIMIT 20) TO '{at}'")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{at}'")
    exact = lambda rows: {i: [x.hex() for x in unit] for i, unit in rows}
    got = exact((r.id, r.unit) for r in core.QUERIES[name](spark, os.fspath(tmp_path)).collect())
    assert got == exact(con.execute(core.ORACLES[name]).fetchall())
    assert all(math.copysign(1, float.fromhex(u[0])) == -1 and float.fromhex(u[0]) == 0 for u in got.values())
