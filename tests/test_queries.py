"""Every query of the catalogue against its SQL; those without SQL give rows."""

import duckdb
import pytest

from tests.compare import connect, same
from tidewire import plans

BASE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(BASE)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_is_its_sql(spark, con, name):
    same(plans.QUERIES[name](spark, BASE), con, plans.SQL[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert plans.QUERIES[name](spark, BASE).count() > 0


def test_words_end_where_sql_ends_them(spark, tmp_path):
    """Letters beyond ASCII are no parts of words in SQL's patterns."""
    texts = ["ñóue de suesícií ado", "íqueado\nsuesñesrr", "xsecñ", "é3%ñ", "ñgdpñ", "gold_", "ñgold", "SECé", "élaunchs", "todayñ $5 mñ", "NYSE: ABCñ", None]
    spark.createDataFrame([(13 * k + 6, t, "en", "s", 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    here = duckdb.connect()
    here.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("event_class", "materiality_score", "tag_gate"):
        same(plans.QUERIES[name](spark, str(tmp_path)), here, plans.SQL[name])
