"""Pages with several links to where they live."""

from evidence_engine.llm import url_filters


def test_every_link_is_an_edge(spark):
    canonical, refresh = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'
    bad, good = "http://s.com/de/bad", "http://y.net/b"
    pages = [
        (1, "http://a.net/1", canonical.format(good) + refresh.format(bad)),
        (2, "http://a.net/2", canonical.format("http://z.net/c") + canonical.format(bad).replace('"', "'")),
        (3, "http://a.net/3", refresh.format("http://q.net/d") + refresh.format("http://a.net/2")),
        (4, "http://y.net/b/", None),
        (5, "http://n.net/5", canonical.format("http://n.net/6") + canonical.format("")),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r["page_id"]: (r["verdict"], r["passed_on"]) for r in url_filters.judge(df, url_filters.rules_table(spark)).collect()}
    assert found == {i: ("block", True) for i in (1, 2, 3, 4)} | {5: ("allow", False)}
