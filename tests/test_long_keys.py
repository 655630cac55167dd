"""Queries of round 3's findings on rows that the small tables don't have, against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name", ["chapter_metadata", "voice_sample_files", "page_text_udf"])
def test_rows_of_larger_tables_equal_sql(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute("CREATE TABLE part AS SELECT k AS p_partkey, 'T' AS p_type, 'Brand#1' AS p_brand, 'name ' || k AS p_name, CAST(k % 50 + 1 AS INTEGER) AS p_size FROM (SELECT unnest([7, 12345, 123456, 123457, 1234567, 1234568, 1234569, 12345670]) AS k)")
    con.execute("CREATE TABLE pages AS SELECT 1 AS page_id, '<p>a&amp;&amp</p><p>b&lt;</p>' AS html")
    for t in ("part", "pages"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    df = entry.queries()[name](spark, str(tmp_path))
    names = ", ".join(f'"{c}"' for c in df.columns)
    want = con.execute(f"SELECT {names} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))
