"""Odd inputs on which queries differed from their SQL."""

import duckdb

from catlake.operators import match
from catlake.queries import ORACLE_SQL, QUERIES


def _same(spark, tmp_path, name, table, ddl, rows):
    spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    want = con.sql(f"SELECT id, {'title' if table == 'pages' else 'id'} FROM ({ORACLE_SQL[name]}) ORDER BY id").fetchall()
    got = QUERIES[name](spark, str(tmp_path))
    assert sorted((r["id"], r[-1]) for r in got.collect()) == want


def test_clean_text_decodes_what_its_sql_does(spark, tmp_path):
    titles = ["token = &quot;0b&quot;", "a &amp; b", "&amp;lt;x&amp;gt;", "&lt;b&gt; &eacute;", "&amp;amp;amp; &#233;"]
    _same(spark, tmp_path, "clean_text", "pages", "page_id long, url string, html string", [(i, "u", f"<title>{t}</title>") for i, t in enumerate(titles)])


def _search(spark, tmp_path, name):
    texts = ["elle ciónñqueta", "elle quel", "ûelle que", "ella que", "Ellé QUÉ", "elle ouqu", None]
    _same(spark, tmp_path, name, "documents", "doc_id long, text string", list(enumerate(texts)))


def test_fulltext_prefix_folds_what_its_sql_does(spark, tmp_path):
    _search(spark, tmp_path, "fulltext_prefix")


def test_fulltext_index_folds_what_its_sql_does(spark, tmp_path):
    _search(spark, tmp_path, "fulltext_index")


def test_ties_are_rounded_as_in_sql(spark):
    values = [k / 10**4 + 5e-5 for k in range(10000)]
    want = [r[0] for r in duckdb.sql(f"SELECT round(x, 4) FROM (SELECT unnest({values}::DOUBLE[]) AS x)").fetchall()]
    rows = spark.createDataFrame(list(enumerate(values)), "id long, x double")
    assert [r["r"] for r in rows.select("id", match.rounded(rows["x"]).alias("r")).orderBy("id").collect()] == want
