import duckdb
import pandas as pd
import pytest

from memlake.llm import urls

TABLE = "page_id long, url string, html string, rule string, host string"
URLS = [
    "https://www.Example.NET/en/1?x=1#y", "http://example.net/de/", "http://a.b.example.net", "https://notexample.net/en/", "https://example.com/de/x", "https://www.example.com/DE/x", "http://m.example.com/fr/?q=://net/",
    "https://x.org/fr/", "https://x.org/fr", "https://org/fr/a", "ftp://net/", "net/", "", "://", "://?", "https://free-bets.example.com/a", "https://www.m.free-bets.example.com:8080/a/", "https://user@free-bets.example.org", "https://freebets.example.org/",
    "https://listed.example.org/page/?utm_source=x&id=3", "https://LISTED.example.org/page?id=3#top", "https://listed.example.org/page?id=4", "https://" + ".".join("abcdefghijklmnop") + ".free-bets.example.com/", "https://" + "x." * 200 + "free-bets.example.com/", "https://İ.example.org/İ",
    "https://a\nb.example.org/fr/\nx?y", "https://" + "p" * 300_000 + "/", "https://x.org/" + "q/" * 100_000,
]


def frame(spark, found):
    return spark.createDataFrame([(i, u, None, "r", "h") for i, u in enumerate(found)] + [(None, None, None, None, None), (3, found[min(3, len(found) - 1)], "", "", "")], TABLE)


def test_parts_and_rules(spark):
    listed = spark.createDataFrame([("listed.example.org/page?id=3",), ("free-bets.example.com/",), ("free-bets.example.com/",), (None,)], "canonical string")
    got = {r["page_id"]: r for r in urls.judged(frame(spark, URLS).repartition(3), listed).collect()}
    assert len(got) == len(URLS) + 1
    seen = {u: got[i] for i, u in enumerate(URLS)}
    rules = {0: "example.net/en/", 1: "net/", 2: None, 3: "net/", 4: "example.com/de/", 5: None, 7: "org/fr/", 8: None, 9: "org/fr/", 10: "net/", 11: None, 13: None}
    assert {i: got[i]["rule"] for i in rules} == rules
    assert (got[0]["host"], got[0]["path"]) == ("www.example.net", "/en/1") and (got[6]["host"], got[6]["path"]) == ("m.example.com", "/fr/")
    assert (got[11]["host"], got[11]["path"]) == ("", "") and (got[None]["host"], got[None]["verdict"], got[None]["rule"]) == ("", "allow", None)
    assert got[24]["host"] == "İ.example.org" and got[25]["host"] == "a\nb.example.org" and got[25]["path"] == "/fr/\nx"
    blocked = {i for i, r in got.items() if r["rule"] is None and r["verdict"] == "block"}
    assert blocked == {15, 16, 19, 20, 22}, blocked
    assert seen[URLS[23]]["verdict"] == "allow"


@pytest.mark.parametrize("blocks", [1, 64])
def test_false_positives_go(spark, blocks):
    """A filter of one block passes nearly everything; the join behind it decides all the same."""
    listed = spark.createDataFrame([(f"h{i}.example.org/p{i}",) for i in range(0, 3000, 3)], "canonical string")
    pages = spark.createDataFrame([(i, f"http://h{i}.example.org/p{i}/?ref=a", None, "", "") for i in range(3000)], TABLE)
    got = urls.judged(pages, listed, most_blocks=blocks).collect()
    assert {r["page_id"] for r in got if r["verdict"] == "block"} == set(range(0, 3000, 3)) and len(got) == 3000


def test_filter_keeps_most_out(spark):
    listed = spark.createDataFrame([(f"h{i}.example.org/",) for i in range(2000)], "canonical string")
    bits = urls.blocked_bloom(listed, 125).scalar()
    form = urls.F.col("canonical")
    rate = lambda df: urls.probed(df, [form], bits, 125).where("maybe").count()
    assert rate(listed) == 2000
    assert rate(spark.range(20_000).select(urls.F.concat(urls.F.lit("other"), "id", urls.F.lit(".example.org/")).alias("canonical"))) < 600


def test_same_as_sql(spark):
    df = frame(spark, URLS)
    got = sorted(map(tuple, urls.judged(df, urls.junk_sites(df)).collect()), key=repr)
    pages = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns)  # noqa: F841
    want = sorted(duckdb.sql(urls.ORACLE).fetchall(), key=repr)
    assert got == want
    assert any(r[3] is None and r[4] == "block" for r in got)


def test_empty(spark):
    nothing, one = spark.createDataFrame([], TABLE), frame(spark, ["http://a.example.org/"])
    assert urls.judged(nothing, urls.junk_sites(nothing)).collect() == []
    assert {r["verdict"] for r in urls.judged(one, urls.junk_sites(nothing)).collect()} == {"allow"}
