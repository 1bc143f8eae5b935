from pyspark.sql import functions as F

from docloom.functions import current_user_key, fill_template, html_to_text, tokens, user_key


def test_user_key(spark):
    df = spark.createDataFrame([("First.Last@Example.com",), ("x" * 50 + "@a.b",), (None,)], "a string")
    got = [r.k for r in df.select(user_key("a").alias("k")).collect()]
    assert got == ["firstlast", "x" * 35, None]
    me = spark.range(1).select(current_user_key().alias("k")).collect()[0].k
    assert me and me == me.lower() and "." not in me and len(me) <= 35


def test_tokens_unicode_and_null(spark):
    df = spark.createDataFrame([("Héllo, WÖRLD 42_x",), (None,), ("",)], "t string")
    got = [r.k for r in df.select(tokens("t").alias("k")).collect()]
    assert got == [["héllo", "wörld", "42", "x"], None, []]


def test_template_does_not_substitute_values(spark):
    df = spark.createDataFrame([("{document_uri}", "p")], "t string, u string")
    got = df.select(fill_template("<{chunk_text}|{document_uri}>", chunk_text="t", document_uri="u").alias("x")).collect()
    assert got[0].x == "<{document_uri}|p>"


def test_html_entities_and_unclosed_tags(spark):
    df = spark.createDataFrame([("<p>a &amp;lt; b<br>c &quot;d&quot; &#39;e&#39;<div",)], "h string")
    assert df.select(html_to_text("h").alias("x")).collect()[0].x == "a &lt; b c \"d\" 'e'<div"  # an unclosed tag stays text
