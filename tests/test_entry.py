import hashlib

import duckdb
import pytest

import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


TEXTS = [(1, "a  b\n" + "word " * 50), (2, "long " * 2000), (3, "short"), (4, ""), (5, None), (6, " \n "), (28, "short"), (31, "<b>Profit</b> rose <script>x < 1</script> Shares Surged"), (56, "short")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "web") for i, t in TEXTS], "doc_id long, text string, source string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, f"Brand#{k}") for k in range(11, 36)], "p_partkey long, p_brand string").write.parquet(f"{at}/part.parquet")
    return at


def both(spark, at, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("documents", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet/*.parquet'")
    got = sorted(map(tuple, entry.queries()[name](spark, at).collect()), key=repr)
    assert got == sorted(con.execute(entry.oracle_sql()[name]).fetchall(), key=repr)
    return {r[0]: r[1:] for r in got}


def test_every_document_is_cleaned(spark, tables):
    got = both(spark, tables, "text_cleaning_all")
    assert set(got) == {i for i, _ in TEXTS} and got[2][0] == 2000 and got[4][0] == got[6][0] == 0 and got[5][0] is None


def test_news_queries_return_what_their_operators_make(spark, tables):
    flags = both(spark, tables, "leakage_flags_news")
    assert {k for k, v in flags.items() if v[0]} == {"n31"} and len(flags) == len(TEXTS)
    kept = both(spark, tables, "clean_news_texts")
    assert len(kept) == len(TEXTS) - 1 and kept["n31"][0] == hashlib.md5(b"Profit rose Shares Surged").hexdigest() and kept["n31"][2] and not kept["n28"][2]
