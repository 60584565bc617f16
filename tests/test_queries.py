import pytest

import __spark_entry__ as driver
from plumbline.plans.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, same_as_sql):
    assert same_as_sql(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(name, spark, small):
    assert QUERIES[name](spark, small).count()


def test_positions_read_whole_texts(spark, tmp_path):
    """Texts that differ only behind their first 300 characters, with a mark on a late line."""
    texts = ["a  b\n" * 400 + end for end in ("x@y \n", "z")]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    one, two = QUERIES["text_positions_whole"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert one.normal_md5 != two.normal_md5 and (one.normal_length, two.normal_length) == (1603, 1601)
    assert (one.line_at_end, one.line_at_mark, two.line_at_end, two.line_at_mark) == (402, 401, 401, None)


def test_driver_contract(spark):
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).count() > 0
