from memloom.llm import url_filter as op

from .common import same_as_sql

PAGES = "page_id long, url string, html string, host string, path string, rule string"


def link(*urls):
    return "".join(f'<p><a class="x" href="{u}">t</a>' for u in urls)


def pages(spark):
    rows = [(0, "HTTP://A.Example.COM/en/1?x#y", link("http://spam.test/a", "/local", "//Hub.test/x")), (1, None, None), (2, "no scheme", ""), (3, "http://spam.test", link("https://deep.test/q"))]
    rows += [(4 + i, f"http://bad{i % 3}.com/en/{i}", link("http://hub.test/")) for i in range(6)]
    rows += [(20 + i, f"http://farm{i % 4}.test/{i}", link(*[f"http://bad{j}.com/" for j in range(3)])) for i in range(8)]
    rows += [(40, "http://good.example.com/en/7x", link("http://friend.test/")), (41, "http://friend.test/", None), (42, "x://net/de/8", None), (43, "x://a.b.example.net/de/80", None), (44, "http://?q", None), (45, "a://b://c/d", None), (46, "http://hub.test#f", link("http://farm0.test/"))]
    rows += [(46, "http://hub.test#f", None), (None, "http://xnet/de/", None)]
    return spark.createDataFrame([(*r, "h", "p", "r") for r in rows], PAGES)


def test_against_sql(spark):
    same_as_sql(op.judge(pages(spark)), op.ORACLE_SQL["op1_url_filter"], pages=pages(spark))


def test_rules_and_spread(spark):
    got = {r.page_id: r for r in op.judge(pages(spark)).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("a.example.com", "/en/1", "com/en/", "block")
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("", "", None, "allow")
    assert (got[40].rule, got[40].verdict) == ("example.com/en/7", "allow")
    assert (got[42].rule, got[42].verdict) == ("net/de/", "allow") and got[43].rule == "example.net/de/8" and got[None].rule is None
    assert got[20].rule is None and got[20].verdict == "block"  # links to blocked hosts only
    assert got[41].verdict == "allow"
    assert (got[45].host, got[45].path) == ("b:", "//c/d")


def test_empty(spark):
    assert op.judge(spark.createDataFrame([], PAGES)).count() == 0
