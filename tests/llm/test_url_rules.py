"""The url rules of the contract, word for word."""

import duckdb
from pagegrain.llm import urls

CONTRACT = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
URLS = {
    "org/": "http://a.org/x", "example.org/es/": "http://www.example.org/es/x", "example.org/en/1": "http://example.org/en/12",
    "com/fr/": "http://b.com/fr/x", "com/de/": "http://b.com/de/x",
}


def test_rules_of_the_contract(spark):
    assert dict(urls.HOST_RULES) == CONTRACT
    data = [(i, url) for i, url in enumerate(URLS.values())]
    pages = spark.createDataFrame(data, "page_id long, url string")
    want = {(i, rule, CONTRACT[rule]) for i, rule in enumerate(URLS)}
    assert {(r["page_id"], r["rule"], r["verdict"]) for r in urls.judge(pages).collect()} == want
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", data)
    assert {(r[0], r[3], r[4]) for r in con.execute(urls.OP2_SQL).fetchall()} == want
