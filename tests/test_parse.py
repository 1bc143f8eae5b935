import datetime as dt

from pyspark.sql import functions as F

from docloom.operators import parse
from docloom.schemas import RAW_FILES
from docloom.sources import files


def raw(spark, rows):
    return spark.createDataFrame(
        [(p, dt.datetime(2024, 1, 1), len(c) if c is not None else None, c) for p, c in rows], RAW_FILES
    )


def test_text_parser_pages_and_failures(spark):
    df = raw(spark, [("a.txt", "page one\fpage two".encode()), ("b.txt", b"\xff\xfe\x00"), ("c.txt", None)])
    out = {r.path: r.parsing for r in parse.parse_documents(df, "text").collect()}
    assert out["a.txt"].parser_status == "SUCCESS"
    assert out["a.txt"].doc_parsed_contents == {"num_pages": "2", "parsed_content": "page one\npage two"}
    for bad in ("b.txt", "c.txt"):
        assert out[bad].parser_status.startswith("ERROR: ")
        assert out[bad].doc_parsed_contents == {"num_pages": "", "parsed_content": ""}


def test_split_counts_and_nullable(spark):
    df = raw(spark, [("a.txt", b"ok"), ("b.txt", b"\xff")])
    staged = parse.parse_documents(df, "text")
    assert [r.path for r in parse.parsed_ok(staged).collect()] == ["a.txt"]
    assert [r.path for r in parse.parse_failures(staged).collect()] == ["b.txt"]
    counts = {r.status: r.n for r in parse.status_counts(staged).collect()}
    assert counts["SUCCESS"] == 1 and sum(counts.values()) == 2
    nullable = {r.path: r.parsed_content for r in parse.parse_documents(df, "text", on_error="null").collect()}
    assert nullable == {"a.txt": "ok", "b.txt": None}


def test_injected_parser_and_errors(spark):
    def parser(data: bytes):
        if data.startswith(b"BAD"):
            raise ValueError("cannot read")
        return data.decode().split("|")

    df = raw(spark, [("a.pdf", b"p1|p2|p3"), ("b.pdf", b"BAD")])
    out = {r.path: r.parsing for r in parse.parse_documents(df, parser).collect()}
    assert out["a.pdf"].doc_parsed_contents == {"num_pages": "3", "parsed_content": "p1\np2\np3"}
    assert out["b.pdf"].parser_status == "ERROR: cannot read"


def test_html_parser(spark):
    html = ("<html><head><style>p{x}</style><script>var a='<p>';</script></head>"
            "<body><!-- hidden --><p>Hello&nbsp;<b>world</b> &amp; more</p>\n<p>x &lt; y</p></body></html>")
    df = raw(spark, [("p.html", html.encode())])
    out = parse.parse_documents(df, "html").collect()[0]
    assert out.parsing.doc_parsed_contents["parsed_content"] == "Hello world & more x < y"


def test_scan_files_recursive_glob_and_pruning(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("alpha")
    (tmp_path / "sub" / "b.txt").write_text("beta beta")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    df = files.scan_files(spark, str(tmp_path), "txt")
    rows = sorted((r.path.rsplit("/", 1)[1], r.length) for r in df.select("path", "length").collect())
    assert rows == [("a.txt", 5), ("b.txt", 9)]
    plan = df.select("path").filter(F.col("length") > 6)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1].split("\n")[0]


def test_land_pages_reports_empty_pages(spark):
    pages = spark.createDataFrame([(1, "<p>x</p>"), (2, "")], "page_id long, html string")
    out = {r.page_id: r for r in files.land_pages(pages, "/v/exports").collect()}
    assert out[1].path == "/v/exports/page_1.pdf" and out[1].status == "SUCCESS" and out[1].length == 8
    assert out[2].status.startswith("ERROR") and out[2].content is None
