from pyspark.sql import functions as F

from firmnet.functions import urls


def keyed(spark, fn, values, **options):
    df = spark.createDataFrame([(v,) for v in values], "url string")
    return {r["url"]: r["company"] for r in fn(df, "url", **options).collect()}


def test_registrable_domain(spark):
    want = {
        "http://www.state.tx.us/a": "state.tx.us",
        "army.mil": "army.mil",
        "http://x.army.mil": "army.mil",
        "shop.a.co.uk": "a.co.uk",
        "a.com_b_c": "a.com",
        "https://www.h.com:8080/x?q": "h.com",
        "http://user:pw@www.h.org/": "h.org",
        "http://a.com?q=b.net": "a.com",
        "WWW.Example.COM": "example.com",
        "HTTP://Www.Foo.COM/x": "foo.com",
        "ftp://www.foo.com./x": "foo.com",
        "https://[2001:DB8::1]:80/x": "[2001:db8::1]",
        "www.foo.co.uk..": "foo.co.uk",
        "10.0.0.1": "10.0.0.1",
        "localhost": "localhost",
        "": "",
        "p.q.ck": "p.q.ck",
        "a.p.q.ck": "p.q.ck",
        "sub.www.ck": "www.ck",
        "a.city.kawasaki.jp": "city.kawasaki.jp",
        "a.b.other.kawasaki.jp": "b.other.kawasaki.jp",
        "x.unknownsuffix": "x.unknownsuffix",
        "co.uk": "co.uk",
    }
    assert keyed(spark, urls.with_registrable_domain, want) == want


def test_null_url(spark):
    df = spark.createDataFrame([(None,)], "url string")
    assert urls.with_registrable_domain(df, "url").first()["company"] is None


def test_underscore_is_kept_when_keying_crawled_pages(spark):
    got = keyed(spark, urls.with_registrable_domain, ["http://my_shop.a.com/x_y"], underscore_as_slash=False)
    assert got == {"http://my_shop.a.com/x_y": "a.com"}


def test_key_column_may_be_replaced(spark):
    df = spark.createDataFrame([("www.a.com/x", 1)], "company string, n int")
    assert urls.with_registrable_domain(df, "company").collect() == [(1, "a.com")] or \
        urls.with_registrable_domain(df, "company").first()["company"] == "a.com"


def test_domain_path_key(spark):
    want = {"http://www.a.com/x/y?q#f": "a.com_x_y", "a.com": "a.com", "a.com_x": "a.com_x", "a.com/": "a.com_"}
    assert keyed(spark, urls.with_domain_path_key, want) == want


def test_flat_key_level_and_year(spark):
    df = spark.createDataFrame(
        [("http://a.com", "2001-05-06T00:00:00Z"), ("http://a.com/", "20020506"), ("a.com/a", "x"),
         ("https://a.com:80/a/b?c", None), ("http://a.com/a/b/", "1999")], "url string, d string")
    rows = df.select(urls.flat_key(F.col("url")), urls.url_level(F.col("url")), urls.crawl_year(F.col("d"))).collect()
    assert [tuple(r) for r in rows] == [
        ("a.com", 0, 2001), ("a.com_", 1, 2002), ("a.com_a", 1, None), ("a.com_80_a_b_c", 2, None), ("a.com_a_b_", 3, 1999)]


def test_domain_lookup_neither_shuffles_nor_leaves_the_jvm(spark):
    df = spark.range(10).select(F.lit("http://a.com/x").alias("url"))
    plan = urls.with_registrable_domain(df, "url")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Python" not in plan and "Cartesian" not in plan
