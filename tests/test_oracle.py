import pyarrow.parquet as pq
import pytest

from spanveil.plans import queries

from . import oracle


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows_equal_sql(spark, small, name):
    got = queries.queries()[name](spark, small).toPandas()
    want = oracle.expected(queries.oracle_sql()[name], small)
    assert sorted(got.columns) == sorted(want.columns)
    assert oracle.rows(got) == oracle.rows(want)


#: Folds over names and the ratio of matching blocks have no SQL; plain versions in test_turns and test_near_terms.
PLAIN = {"conversation_texts", "near_terms"}


def test_every_query_has_sql_or_a_plain_version():
    assert set(queries.queries()) == set(queries.oracle_sql()) | PLAIN


@pytest.mark.parametrize("name", ["email_spans", "phone_spans", "redact_contacts"])
def test_null_texts_equal_sql(spark, small, tmp_path, name):
    for t in oracle.TABLES:
        d = spark.read.parquet(f"{small}/{t}.parquet")
        if t == "documents":
            d = d.selectExpr("* EXCEPT (text)", "CASE WHEN doc_id % 10 <> 3 THEN text END AS text")
            pq.write_table(d.toArrow(), f"{tmp_path}/{t}.parquet")
        else:
            (tmp_path / f"{t}.parquet").symlink_to(f"{small}/{t}.parquet")
    got = queries.queries()[name](spark, str(tmp_path)).toPandas()
    want = oracle.expected(queries.oracle_sql()[name], str(tmp_path))
    assert oracle.rows(got) == oracle.rows(want)
