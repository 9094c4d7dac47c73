import math
import struct

import duckdb
import pytest

from vecspark.plans import catalogue
from vecspark.sources import csv_vectors

NAN = struct.unpack("<f", b"\x00\x00\xc0\xff")[0]  # its sign bit is set
ROWS = [
    (0, [0.0078125, -0.0703125, 0.0234375, -0.0]),  # ties at the sixth decimal
    (1, [1e-8, -1e-8, 5e-7, 123456.0078125]),
    (2, [1e10, 2.0**60, 1e30, -3.4e38]),  # more digits than the shortest decimal has
    (3, [math.nan, NAN, math.inf, -math.inf]),
    (4, [None, 1.0, None, 2.0]),
    (5, [None]),
    (6, []),
    (7, None),
    (None, [1.0, 2.0]),
]


def test_export_is_its_sql(spark, tmp_path):
    spark.createDataFrame([(*r, 0) for r in ROWS], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = [tuple(r) for r in catalogue.QUERIES["csv_export_lines"](spark, str(tmp_path)).select("vec_id", "line").collect()]
    assert sorted(got, key=repr) == sorted(con.sql(f"select vec_id, line from ({catalogue.ORACLE['csv_export_lines']})").fetchall(), key=repr)
    assert (0, "0,0.007812,-0.070312,0.023438,-0.000000") in got


@pytest.mark.parametrize("with_id", [True, False])
def test_special_numbers_are_read_back(spark, tmp_path, with_id):
    df = spark.createDataFrame([(k, f"n{k}", v) for k, v in ((0, [NAN, 0.5, math.nan]), (1, [math.inf, -math.inf, 1.0]))], "vec_id long, id string, embedding array<float>")
    csv_vectors.write_csv(df if with_id else df.drop("id"), f"{tmp_path}/v", header=False)
    got = csv_vectors.read_csv(spark, f"{tmp_path}/v").orderBy("vec_id").collect()
    assert [r.id for r in got] == (["n0", "n1"] if with_id else [None, None])
    assert repr([list(r.embedding) for r in got]) == repr([[math.nan, 0.5, math.nan], [math.inf, -math.inf, 1.0]])
