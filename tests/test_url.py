"""URL expressions against Python's own urlparse, on hand-made and random URLs."""

from urllib.parse import urlparse

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from perdura.functions import url

CASES = [
    "http://a.org",
    "http://a.org/",
    "http://a.org/x/",
    "http://a.org/x/y",
    "HTTPS://www.A.gov:8080/p?x=1&y=2#f",
    "http://u:p@b.in/x;v=1?q",
    "ftp://c.int/",
    "a.org/x",
    "http://localhost/x",
    "http://1.2.3.4/",
    "http://a.org/x|y z",
    "http://a.org/a;b/c;d",
    "https://doi.org/10.1/x",
    "http://a.org?x=1",
    "http://a.org/p? &",
    "http://a.org/#x?y",
]


def expected_depth(path: str) -> int:
    return path.rstrip("/").count("/") if path.endswith("/") and not path.endswith("//") else (
        path[:-1].count("/") if path.endswith("/") else path.count("/")
    )


@pytest.mark.parametrize("count", [1, 3])
def test_parts_follow_urlparse(spark, count):
    df = spark.createDataFrame([(u,) for u in CASES], "url string").repartition(count)
    for r in url.split_url(df).collect():
        p = urlparse(r["url"])
        assert (r["scheme"], r["netloc"], r["path"]) == (p.scheme, p.netloc, p.path), r["url"]
        assert r["params"] == (p.query if p.query.strip() else None), r["url"]


def test_features_of_hand_made_urls(spark):
    df = spark.createDataFrame([(u,) for u in [*CASES, None]], "url string")
    rows = {r["url"]: r for r in url.url_features(df).collect()}
    assert rows["http://a.org"]["url_depth"] == 0
    assert rows["http://a.org/"]["url_depth"] == 0
    assert rows["http://a.org/x/"]["url_depth"] == 1
    assert rows["http://a.org/x/y"]["url_depth"] == 2
    port = rows["HTTPS://www.A.gov:8080/p?x=1&y=2#f"]
    assert (port["scheme"], port["suffix"], port["suffix_idx"]) == ("https", "gov:8080", "gov")
    assert (port["is_port_access"], port["has_www"], port["param_cnt"]) == (1, 1, 2)
    assert rows["http://u:p@b.in/x;v=1?q"]["suffix_idx"] == "in"
    # no scheme or no dot: the row goes
    assert not {"a.org/x", "http://localhost/x", None} & set(rows)
    valid = url.url_features(df).filter(url.is_valid_tld(F.col("suffix_idx")))
    assert "http://1.2.3.4/" not in {r["url"] for r in valid.collect()}


def test_depth_counts_slashes_but_a_last_one(spark):
    paths = ["", "/", "/x", "/x/", "/x//", "/x/y/z.html"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [r[0] for r in df.select(url.depth(F.col("p"))).collect()]
    assert got == [0, 0, 1, 1, 2, 3]


letters = st.text(alphabet="ab.:/?#;&=@ %-", max_size=20)


@settings(max_examples=20, deadline=None)
@given(st.lists(letters, min_size=1, max_size=30))
def test_random_urls_split_like_urlparse(spark, tails):
    urls = ["http://h.org/" + t for t in tails]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    for r in url.split_url(df).collect():
        p = urlparse(r["url"])
        assert (r["netloc"], r["path"]) == (p.netloc, p.path), r["url"]
