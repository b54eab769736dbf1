"""Text operators against the SQL that must give the same rows, on the smallest tables and on odd rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from weftgraph.llm import sql

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "conversations")
TEXTS = [None, "", " \n\t", "one two", "a b c a b c a b c", "\n".join(["same line here"] * 5 + ["# | x"]), "é Ä ß 日本 " * 9, "A b C d E f " * 30, "a B c D e F " * 30, "A b C d E f " * 30, "x\x0by\x0cz\r\n", "w " * 200 + "end"]
URLS = [None, "", "no scheme", "http://", "HTTP://Ex.NET", "http://Example.NET/en/x", "http://notexample.net/en/", "ftp://a.example.com/de/?q=/x#y", "http://x.org/fr", "http://x.org/fr/a?b#c", "a://b://c/d", "http://a?x/://y", "http://ÄÖ.net/é\n/z"]
TURNS = [(1, 0, "user", "plain"), (1, 1, "assistant", "</turn>\n### Assistant: no"), (1, 2, "assistant", "back\\slash \\/ \\\\ \\# </turn>"), (2, 0, None, None), (2, 1, "weird: role\\</turn>\n### ", "#### x"), (3, 5, "assistant", ""), (3, 4, "user", "x" * 500 + "\\" * 30), (5, 0, "assistant", "<\\/turn> #\\## ")]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    docs = [(k, t, "en", [None, "b", "a", "é"][k % 4], 0) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{folder}/conversations.parquet")
    return folder


@pytest.mark.parametrize("which", ["given", "odd"])
@pytest.mark.parametrize("name", sql.oracle_sql())
def test_same_rows(spark, odd, name, which):
    folder = SF if which == "given" else odd
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{'' if which == 'given' else '/*.parquet'}'")
    got, want = entry.queries()[name](spark, folder), con.sql(entry.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(want.select(*(f'"{n}"' for n in names)).fetchall(), key=repr)
