import duckdb
import pandas as pd

from pavescope.llm.url_filters import oracle, url_filter

URLS = [None, "", "no scheme/net/", "http://A.NET/", "http://a.net", "http://net/x", "http://xnet/x", "https://example.net/en/1?q=://b/", "https://m.EXAMPLE.net/EN/1", "https://example.net/en", "ftp://example.com/de/", "https://badexample.com/de/", "https://q.example.com/de/a#b",
        "https://w.org/fr/", "https://w.org/fr", "https://w.org?/fr/", "https://cheap-pills.example.com/en/1", "https://www.cheap-pills.org/fr/7", "http://m.adult-x.example.org/", "http://x.org/casino", "http://x.org/CASINO/", "http://spam-farm.org#casino", "x://a.net\n/b/", "://net/", "http://a.net/" + "z" * 50_000]


def test_against_sql(spark):
    rows = [(i, u, "h", 0) for i, u in enumerate(URLS)] + [(3, URLS[3], "h", 0), (None, URLS[5], None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, token int")
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html", "token"]).astype({"page_id": "Int64"}))
    want = con.sql(oracle()).fetchall()
    got = [tuple(r) for r in url_filter(pages).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    verdicts = {r[0]: r[3:5] for r in got if r[0] is not None}
    assert verdicts[3] == ("net/", "block") and verdicts[7] == ("example.net/en/", "allow") and verdicts[8] == ("net/", "block")
    assert verdicts[17] == ("org/fr/", "allow") and verdicts[16] == (None, "block") and verdicts[0] == (None, "allow")
    assert url_filter(pages.limit(0)).count() == 0
