"""Keys of urls against results of the URL standard."""
import pytest
from pyspark.sql import functions as F

from feedloom.functions import urls

#: url, host + path as a browser gives them (none: it refuses).
RESULTS = [
    ("https://a.b/y", "a.b/y"), ("https://a.b/x/../y", "a.b/y"), ("https://a.b", "a.b/"), ("https://A.B:443/C?d=e#f", "a.b/C"), ("  https://a.b/x \n", "a.b/x"), ("https://a.b/x y", "a.b/x%20y"),
    ("https://a.b/./x/./", "a.b/x/"), ("https://a.b/x/..", "a.b/"), ("https://a.b/../../x", "a.b/x"), ("https://a.b/x/%2e%2E/y", "a.b/y"), ("https://a.b/x/.%2e", "a.b/"), ("https://a.b/.../x", "a.b/.../x"), ("https://a.b/x//y/../z", "a.b/x//z"),
    ("https://a.b/é?x", "a.b/%C3%A9"), ("https://a.b/%c3%a9", "a.b/%c3%a9"), ('https://a.b/"<>`{}', "a.b/%22%3C%3E%60%7B%7D"), ("https://a.b/a|b[c]", "a.b/a|b[c]"), ("https://a.b\\x\\y", "a.b/x/y"), ("https:a.b/x", "a.b/x"), ("https:////a.b/x", "a.b/x"), ("ht\ntps://a.b/\tx", "a.b/x"),
    ("https://user:pw@a.b/x", "a.b/x"), ("https://u@v@a.b/x", "a.b/x"), ("https://a.b:/x", "a.b/x"), ("https://a.b:99999/x", None), ("https://a.b:8x/", None), ("https:///", None), ("https://", None), ("http://a b/", None), ("http://a%20b/", None), ("http://a<b/", None), ("https://a.b:0443/x", "a.b/x"),
    ("http://ex%61mple.com/", "example.com/"), ("http://EXAMPLE。com/", "example.com/"), ("https://münchen.de/ä", "xn--mnchen-3ya.de/%C3%A4"), ("https://faß.de/", "xn--fa-hia.de/"), ("https://日本語.jp/x", "xn--wgv71a119e.jp/x"), ("https://MÜNCHEN.de/", "xn--mnchen-3ya.de/"), ("https://xn--mnchen-3ya.de/", "xn--mnchen-3ya.de/"),
    ("http://192.168.0.1/x", "192.168.0.1/x"), ("http://0x7f.1/", "127.0.0.1/"), ("http://2130706433/", "127.0.0.1/"), ("http://0300.168.0.0xF0/", "192.168.0.240/"), ("http://256.1.1.1/", None), ("http://1.2.3.4.5/", None), ("http://1.2.3.4./", "1.2.3.4/"), ("http://a.1.2.3/", None), ("http://a.b.c1/x", "a.b.c1/x"),
    ("http://[::1]:80/x", "[::1]/x"), ("http://[2001:DB8:0:0:1:0:0:1]/", "[2001:db8::1:0:0:1]/"), ("http://[::ffff:1.2.3.4]/", "[::ffff:102:304]/"), ("http://[::1/", None), ("http://[g::1]/", None),
    ("mailto:a@b.c?x", "a@b.c"), ("foo://H.X/a/../b", "H.X/b"), ("foo:/a/./b", "/a/b"), ("data:text/plain,x y", "text/plain,x y"), ("file:///C|/x/../y", "/C:/y"), ("file://localhost/x", "/x"), ("file://srv/x", "srv/x"),
    ("a.b/x", None), ("//a.b/x", None), ("/x", None), ("", None), ("x y", None), ("https://a.b/x;y=1,2", "a.b/x;y=1,2"), ("HTTP://a.b/X", "a.b/X"), ("http://a.b/%", "a.b/%"), ("http://a.b/%zz", "a.b/%zz"), ("http://a_b.c/x", "a_b.c/x"), ("http://a.b?x", "a.b/"), ("http://a.b#x", "a.b/"),
]


def test_keys(spark):
    rows = spark.createDataFrame([*RESULTS, (None, None)], "url string, want string").repartition(3)
    got = rows.select("url", "want", urls.url_key("url").alias("got")).collect()
    assert len(got) == len(RESULTS) + 1
    assert [(r.url, r.got) for r in got if r.got != r.want] == []


def test_plain_urls_are_cut_by_expressions(spark):
    """What takes the short way gets what the parser gives."""
    from feedloom.functions import whatwg

    plain = [u for u, _ in RESULTS if u and spark.range(1).select(F.lit(u).rlike(urls.PLAIN)).first()[0]]
    assert 8 < len(plain) < len(RESULTS) // 2
    rows = spark.createDataFrame([(u,) for u in plain], "url string").select("url", F.concat(urls.hostname("url"), urls.path("url")).alias("key"))
    assert all(r.key == whatwg.key(r.url) for r in rows.collect())


@pytest.mark.parametrize("junk", ["http://\ud800/", "http://" + "a" * 100000 + "/x", "http://a.b/" + "../" * 50000])
def test_odd_texts(junk):
    from feedloom.functions import whatwg

    whatwg.key(junk)
