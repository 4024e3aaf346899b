import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


# How a framework's page files name routes.
@pytest.mark.parametrize(
    ("path", "route"),
    [
        ("src/app/(public)/page.tsx", "/"),
        ("src/app/account/[id]/page.tsx", "/account/[id]"),
        ("pages/blog/[slug].tsx", "/blog/[slug]"),
        ("pages/api/hello.ts", "/api/hello"),
        ("src/app/@auth/(.)login/page.tsx", "/login"),
        ("src/app/feed/@modal/(..)photo/[id]/page.tsx", "/photo/[id]"),
        ("src/app/a/b/@modal/(..)(..)photo/page.tsx", "/photo"),
        ("src/app/a/@modal/(...)settings/page.tsx", "/settings"),
    ],
)
def test_path_to_route(spark, path, route):
    assert one(spark, path, text.path_to_route) == route


@pytest.mark.parametrize(("given", "key"), [("/İletişim/", "/iletisim"), ("/sa%C4%9Fl%C4%B1k", "/saglik"), ("/a%ZZ", "/a%zz"), ("/", "/"), ("IĞDIR", "igdir"), ("/c+d", "/c+d"), (" /Ŝtona ", "/stona")])
def test_route_key(spark, given, key):
    assert one(spark, given, text.route_key) == key


def test_tokens_of_any_script(spark):
    assert one(spark, "Özgür café, naïve Straße 漢字 ñandú_9", text.tokens) == ["ozgur", "cafe", "naive", "straße", "漢字", "nandu", "9"]


def test_terms_and_anchors(spark):
    assert one(spark, "How does getUserName use the Şifre field?", text.terms) == ["get", "user", "name", "use", "sifre", "field"]
    assert one(spark, "Where is API_URL read, GET or POST_KEY?", text.config_anchors) == ["API_URL", "GET", "POST_KEY"]
    assert one(spark, "See https://x.y/z and src/app.ts then /account/[id].", text.route_anchor) == "/account/[id]."
    assert one(spark, "nothing here", text.route_anchor) is None


@pytest.mark.parametrize("url", ["git@host.org:team/app.git", "https://user:pw@host.org/Team/app", "ssh://git@host.org/team/app.git/", "https://host.org/team/app?x=1"])
def test_normal_remote(spark, url):
    assert one(spark, url, text.normal_remote) == "host.org/team/app"


def test_hit_ratio(spark):
    row = spark.createDataFrame([(["license", "abc", "rout"], ["licenses", "route", "abcd"])], "w array<string>, g array<string>")
    assert row.select(text.hit_ratio(F.col("w"), F.col("g"))).first()[0] == pytest.approx(2 / 3)
    empty = spark.createDataFrame([([], ["a"])], "w array<string>, g array<string>")
    assert empty.select(text.hit_ratio(F.col("w"), F.col("g"))).first()[0] == 0
