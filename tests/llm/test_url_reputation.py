from adyield.llm import url_reputation as u

RULED = [("http://a.example.org/es/1", "example.org/es/", "block"), ("http://EXAMPLE.org/en/12?x", "example.org/en/1", "block"),
         ("https://b.org/x", "org/", "allow"), ("x://shop.com/fr/", "com/fr/", "allow"), ("x://shop.com/de/9#f", "com/de/", "block"),
         ("x://notorg/x", None, None), ("x://b.org", None, None), ("x://com.net/fr/", None, None)]


def test_rules_and_odd_urls(spark):
    urls = [(i, x[0]) for i, x in enumerate(RULED)] + [(100, None), (101, "no scheme"), (102, ""), (None, "http://z.net/"), (100, None)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    outcomes = spark.createDataFrame([(0, 1), (1, 0), (None, 1), (100, None)], "page_id long, good int")
    got = u.filter_urls(pages, outcomes).collect()
    assert len(got) == len(urls)
    by = {r["page_id"]: r for r in got}
    for i, (_, rule, verdict) in enumerate(RULED):
        assert by[i]["rule"] == rule
        assert by[i]["verdict"] == verdict or verdict is None
    assert by[1]["host"] == "example.org" and by[1]["path"] == "/en/12"
    assert by[100]["host"] == "" and by[101]["path"] == ""
    assert all(r["verdict"] in ("allow", "block") for r in got)


def test_bad_host_is_blocked_and_unknown_host_leans_on_its_domain(spark):
    rows, good = [], []
    for i in range(400):
        host = ["good.net", "bad.net", "mixed.net", "x.spam.io"][i % 4]
        rows.append((i, f"http://{host}/p"))
        good.append((i, {"good.net": 1, "bad.net": 0, "mixed.net": i // 4 % 2, "x.spam.io": 0}[host]))
    rows += [(900, "http://new.spam.io/"), (901, "http://new.good.net/")]
    got = {r["page_id"]: r["verdict"] for r in u.filter_urls(
        spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(good, "page_id long, good int")).collect()}
    assert got[0] == "allow" and got[1] == "block" and got[3] == "block"
    assert got[900] == "block" and got[901] == "allow"


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert u.filter_urls(pages, spark.createDataFrame([], "page_id long, good int")).count() == 0
    one = spark.createDataFrame([(1, "http://a.b/")], "page_id long, url string")
    assert u.filter_urls(one, spark.createDataFrame([], "page_id long, good int")).first()["verdict"] in ("allow", "block")


def test_matches_sql(spark, small, duck):
    from pyspark.sql import functions as F
    got = u.filter_urls(small("pages"), small("labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good")))
    want = duck.sql(u.oracle())
    key = lambda r: r[0]
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=key) == sorted(want.fetchall(), key=key)


def test_hierarchy_of_public_suffixes_ports_and_addresses(spark):
    want = {"a.b.co.uk": ("b.co.uk", "co.uk"), "b.co.uk:8080": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"),
            "x.y.shop.com.br.": ("shop.com.br", "com.br"), "a.example.com:443": ("example.com", "com"), "me@w.example.org": ("example.org", "org"),
            "10.0.0.1": ("10.0.0.1", u.ADDRESSES), "10.0.0.1:81": ("10.0.0.1", u.ADDRESSES), "[::1]:80": ("[::1]", u.ADDRESSES),
            "localhost": ("localhost", "localhost"), "": ("", ""), "notco.uk": ("notco.uk", "uk")}
    df = spark.createDataFrame([(h,) for h in want], "host string")
    domain, suffix = u.hierarchy(df["host"])
    assert {r[0]: (r[1], r[2]) for r in df.select("host", domain, suffix).collect()} == want
    domain, suffix = u.hierarchy(df["host"], ["shop.com.br", "com.br"])
    assert df.filter("host like 'x.y%'").select(domain, suffix).first() == ("y.shop.com.br", "shop.com.br")


def test_sites_under_a_public_suffix_do_not_share_a_reputation(spark):
    rows, good = [], []
    for i in range(600):
        host, ok = [("www.good.co.uk", 1), (f"www.bad{i // 3 % 8}.co.uk", 0), (f"www.worse{i // 3 % 8}.co.uk:8080", 0)][i % 3]
        rows.append((i, f"http://{host}/p"))
        good.append((i, ok))
    rows += [(900, "http://new.good.co.uk/"), (901, "http://new.good.co.uk:81/"), (902, "http://new.worse1.co.uk/")]
    got = {r["page_id"]: r for r in u.filter_urls(
        spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(good, "page_id long, good int")).collect()}
    assert [got[i]["verdict"] for i in (900, 901, 902)] == ["allow", "allow", "block"]
    assert got[901]["host"] == "new.good.co.uk:81"


def test_sql_on_suffixes_ports_addresses_repeats_and_clashing_columns(spark):
    import random

    import duckdb
    rng = random.Random(2)
    hosts = ["a.shop.co.uk", "b.shop.co.uk", "other.co.uk:8080", "x.com.br", "www.x.com.br.", "user@y.example.org", "10.0.0.1", "10.0.0.2:81",
             "[::1]:80", "good.net", "bad.net", "co.uk", "uk", "", "deep.er.host.net"]
    pages = [(i, f"http://{rng.choice(hosts)}/{rng.choice(['', 'es/', 'fr/1'])}") for i in range(300)] + [(None, "http://good.net/"), (5, None)]
    pages += pages[:40] * 3
    bad = ("bad.net", "other.co.uk", "10.0.0.")
    labels = [(i, int(not any(b in (u or "") for b in bad)) ^ (rng.random() < 0.05)) for i, u in pages if i is not None and i % 2]
    labels += labels[:30] + [(7, 0), (7, 1), (9, None), (None, 0)]
    page = spark.createDataFrame(pages, "page_id long, url string").selectExpr("*", "'x' as host", "1 as mean", "2 as good", "3 as k")
    outcome = spark.createDataFrame(labels, "page_id long, good int").selectExpr("*", "'y' as host", "4 as n")
    got = sorted((tuple(r) for r in u.filter_urls(page, outcome).collect()), key=str)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)").executemany("INSERT INTO pages VALUES (?, ?)", pages)
    con.execute("CREATE TABLE labels (doc_id BIGINT, quality INTEGER)").executemany("INSERT INTO labels VALUES (?, ?)", labels)
    assert got == sorted(con.sql(u.oracle()).fetchall(), key=str) and len(got) == len(pages)
    assert {v for *_, v in got} == {"allow", "block"}
    top = {r["host"]: (r["n"], r["verdict"]) for r in u.reputation(page.select("page_id", u.host_of(page["url"]).alias("host")), outcome).collect()}
    assert top["other.co.uk:8080"][1] == "block" and top["a.shop.co.uk"][1] == "allow"
