"""Pages numbered on Spark against the pages of the loop."""

import pytest

from tidemark import catalogue
from tidemark.operators import keyset


def test_numbered_pages_equal_the_loop(spark, tmp_path):
    df = spark.createDataFrame([(i % 5, i, f"x{i}") for i in range(103)], "k int, id long, said string").repartition(3)
    got = keyset.numbered_pages(df, ["k", "id"], 10, f"{tmp_path}/a")
    assert got.columns == ["k", "id", "said", "page"]
    expected = {r["id"]: n for n, page in enumerate(keyset.iter_pages(df, ["k", "id"], 10)) for r in page}
    assert {r["id"]: r["page"] for r in got.collect()} == expected and got.count() == 103
    assert keyset.numbered_pages(df.limit(0), ["k"], 10, f"{tmp_path}/b").count() == 0
    with pytest.raises(ValueError):
        keyset.numbered_pages(spark.createDataFrame([(None,), (1,)], "k int"), ["k"], 2, f"{tmp_path}/c")


def test_no_page_of_the_query_is_collected(spark, monkeypatch):
    def collected(*_):
        raise AssertionError("pages came to the driver")

    monkeypatch.setattr(keyset, "iter_pages", collected)
    d = "/root/testdata/sf0.001"
    got = catalogue.keyset_all_pages(spark, d)
    assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in spark.read.parquet(f"{d}/customer.parquet").select("c_custkey").collect())
