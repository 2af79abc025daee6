import pytest
from pyspark.sql import functions as F

from quillet.llm import urls
from quillet.llm.queries import ORACLE, QUERIES
from tests.oracle import rows, sql_rows

CASES = [
    ("http://A.Example.COM/en/x?q#f", "a.example.com", "/en/x", "example.com/en/", "block"),
    ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("https://m.www.example.com/en/a", "m.www.example.com", "/en/a", "www.example.com/en/", "allow"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("http://com/EN/", "com", "/EN/", "com/", "allow"),
    ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
    ("http://x.net/es", "x.net", "/es", None, "allow"),
    ("http://x.com", "x.com", "", None, "allow"),
    ("http://x.com?/a", "x.com", "", None, "allow"),
    ("x.com/en/", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("a://b://c.net/fr/", "b:", "//c.net/fr/", None, "allow"),
    ("http://ÉX.net/fr/\nz", "Éx.net", "/fr/\nz", "net/fr/", "block"),
    ("http://x.net/fr/#/en/", "x.net", "/fr/", "net/fr/", "block"),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, c[0], "h") for i, c in enumerate(CASES)] + [(0, CASES[0][0], "h")], "page_id long, url string, html string")
    for made in (df, df.select("*", F.lit(1).alias("host"), F.lit(2).alias("key"))):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(made).collect()}
        assert got == {i: c[1:] for i, c in enumerate(CASES)}
    assert urls.judge(df).count() == len(CASES) + 1
    assert urls.judge(df.limit(0)).count() == 0
    assert {r.verdict for r in urls.judge(df, rules=(), default="block").collect()} == {"block"}


@pytest.mark.parametrize("n", [0, 1, 50, 3000])
def test_cascade_is_exact(spark, n):
    universe = spark.range(9000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = spark.range(n).select(F.concat(F.lit("k"), F.col("id") * 3).alias("key"))
    cascade = urls.build_cascade(listed, universe, rate=0.2)
    if n == 3000:
        assert len(cascade.levels) > 2
    got = {r.key for r in universe.where(cascade.holds(F.col("key"))).collect()}
    assert got == {f"k{3 * i}" for i in range(n)}


def test_query(spark, capsys):
    sf = "/root/testdata/sf0.01"
    df = QUERIES["op5_urls"](spark, sf)
    assert rows(df) == sql_rows(ORACLE["op5_urls"], sf)
    df.explain()
    plan = capsys.readouterr().out
    assert "Join" not in plan and "html" not in plan.split("ReadSchema")[1]
