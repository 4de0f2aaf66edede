from pyspark.sql import functions as F

from tidemark.sources import discovery as D


def test_failing_source_is_a_status(spark):
    good = lambda: spark.createDataFrame([("u1",), ("u2",)], "url string").withColumn("hint_date", F.lit(None).cast("date"))

    def bad():
        raise OSError("down")

    df, status = D.discovered(spark, {"a": good, "b": bad}, ["a", "b", "c"])
    assert status == {"a": "ok", "b": "failed: OSError", "c": "unknown source"} and {r.url for r in df.collect()} == {"u1", "u2"}


def test_directory_first_name_wins(spark):
    html = '<div><a href="/x"><b>Name X</b></a><a class="k" href="/x">Again</a><a href="/y"> Y Ltd </a></div>'
    got = {r.href: r.name for r in D.directory(spark.createDataFrame([(html,)], "text string")).collect()}
    assert got == {"/x": "Name X", "/y": "Y Ltd"}


def test_quarterly_table(spark):
    html = "<table><tr><th></th><th>Mar 2023</th><th>Jun 2023</th></tr><tr><td>Sales +</td><td>1,200</td><td>(30.5)</td></tr><tr><td>Revenue</td><td>xx</td><td></td></tr></table>"
    rows = D.quarters(spark.createDataFrame([("T", html), ("U", None)], "ticker string, text string"))
    assert {(r.label, r.quarter, r.value) for r in rows.collect()} == {("Sales", "Mar 2023", 1200.0), ("Sales", "Jun 2023", -30.5), ("Revenue", "Mar 2023", None), ("Revenue", "Jun 2023", None)}
    assert {r.label for r in D.preferred(rows, ("Revenue", "Sales")).collect()} == {"Sales"}


def test_readings_shells_and_verdicts(spark):
    page = spark.createDataFrame([("yield: 7,012.5 %",), ("none",), (None,)], "text string")
    assert [r.value for r in D.reading(page, r"yield: ([\d.,]+)").collect()] == [7012.5, None, None]
    long = "x" * 3000
    shells = spark.createDataFrame([("short",), (long,), (long + "__NEXT_DATA__",), (long + "__NEXT_DATA__<article>",)], "text string").select(D.javascript_shell().alias("s")).collect()
    assert [r.s for r in shells] == [True, False, True, False]
    f = spark.createDataFrame([("a", False, 5, 900, True, False), ("b", True, 0, 900, True, False), ("c", True, 1, 900, True, True), ("d", True, 1, 10, True, False), ("e", True, 1, 900, None, False), ("f", True, 1, 900, True, False)], "source string, allowed boolean, candidates int, body_chars int, has_time boolean, shell boolean")
    assert [r.verdict for r in D.verdicts(f).orderBy("source").collect()] == ["blocked by robots", "nothing discovered", "needs scripts", "no usable text", "no timestamps", "usable"]


def test_provenance_counts_characters(spark):
    r = D.provenance(spark.createDataFrame([("u", 200, "t", "नम")], "url string, status int, fetched_at string, text string")).first()
    assert r.characters == 2 and len(r.sha256) == 64
