import duckdb
from pyspark.sql import functions as F

from quillspark.llm import reputation
from quillspark.llm.queries import URL_RULES

COLUMNS = ["page_id", "host", "path", "rule", "verdict"]


def both(spark, pages, labels):
    c = duckdb.connect()
    c.execute("create table pages (page_id bigint, url varchar); create table labels (doc_id bigint, quality int, toxic int)")
    for name, rows in (("pages", pages), ("labels", labels)):
        if rows:
            c.executemany(f"insert into {name} values ({', '.join('?' * len(rows[0]))})", rows)
    want = c.execute(f"select {', '.join(COLUMNS)} from ({reputation.SQL})").fetchall()
    p = spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("bad", F.lit(7))
    bad = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("doc_id page_id", "cast(coalesce(quality = 0, false) or coalesce(toxic = 1, false) as int) bad")
    got = [tuple(r) for r in reputation.judge_urls(p, bad, URL_RULES).select(COLUMNS).collect()]
    key = lambda r: tuple((x is None, x or 0 if isinstance(x, int) or x is None else x) for x in (r[0], r[1], r[2]))
    assert sorted(got, key=key) == sorted(want, key=key)
    return {r[0]: r for r in got}


def test_rules(spark):
    urls = ["http://a.NET/x", "https://example.net/en/1", "https://m.example.net/en", "http://notexample.net/en/", "ftp://example.com/de/?q", "http://b.org/fr/#x", "http://xorg/fr/", "http://net?/", "http://net", "no scheme", None, "x://u@H.org:80/fr/a?b://c/d", "://"]
    got = both(spark, list(enumerate(urls)), [])
    assert [got[i][3] for i in range(len(urls))] == ["net/", "example.net/en/", "net/", "net/", "example.com/de/", "org/fr/", None, None, None, None, None, None, None]
    assert got[0][1:3] == ("a.net", "/x") and got[10][1:3] == ("", "") and got[11][1] == "u@h.org:80"


def test_reputation_blocks_bad_hosts_and_shrinks_thin_ones(spark):
    pages, labels = [], []
    for h, n, bad in [("spam.shop.com", 60, 55), ("thin.good.com", 3, 2), ("www.good.com", 80, 4), ("a.b.co.uk", 30, 1), ("1.2.3.4", 5, 0), ("other.org", 40, 3), ("new.shop.com", 0, 0)]:
        for k in range(n + 2):
            pages.append((len(pages), f"http://{h}/{k}"))
            if k < n:
                labels.append((len(pages) - 1, int(k >= bad), 0))
    got = both(spark, pages, labels)
    verdict = {r[1]: r[4] for r in got.values()}
    assert verdict == {"spam.shop.com": "block", "thin.good.com": "allow", "www.good.com": "allow", "a.b.co.uk": "allow", "1.2.3.4": "allow", "other.org": "allow", "new.shop.com": "block"}


def test_odd_rows(spark):
    both(spark, [(None, "http://x.com/a"), (1, "http://x.com/a"), (1, "http://x.com/a"), (2, None)], [(1, 0, None), (1, 1, 0), (None, 0, 1), (99, 0, 0), (2, None, None)])
    both(spark, [], [(1, 0, 0)])
    both(spark, [(1, "http://x.com/" + "a" * 100_000)], [])


def test_a_table_of_public_suffixes(spark):
    suffixes = spark.createDataFrame([(s,) for s in ("com", "co.uk", "uk", "*.ck", "!www.ck", "github.io", " IO ", "com")], "suffix string")
    want = {"a.b.example.com": ("example.com", "com"), "example.co.uk": ("example.co.uk", "co.uk"), "x.y.co.uk": ("y.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "a.b.c.ck": ("b.c.ck", "c.ck"), "www.ck": ("www.ck", "ck"), "m.www.ck": ("www.ck", "ck"), "me.github.io:80": ("me.github.io", "github.io"), "u@t.me.github.io": ("me.github.io", "github.io"), "10.0.0.1:8": ("10.0.0.1", "10.0.0.1"), "plain": ("plain", "plain"), "a.unknown": ("a.unknown", "unknown"), "": ("", "")}
    hosts = spark.createDataFrame([(h,) for h in want], "host string")
    assert {r.host: (r.domain, r.suffix) for r in reputation.listed_levels(hosts, suffixes).collect()} == want
    pages = spark.createDataFrame([(k, f"http://{'bad' if k % 2 else 'good'}.github.io/{k}") for k in range(80)], "page_id long, url string")
    verdicts = reputation.judge_urls(pages, pages.selectExpr("page_id", "cast(page_id % 2 as int) bad"), (), suffixes=suffixes).select("host", "verdict").distinct().collect()
    assert {tuple(v) for v in verdicts} == {("bad.github.io", "block"), ("good.github.io", "allow")}
