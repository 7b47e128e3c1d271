"""Columns, table functions, plans, sources and streams."""

import re
import tracemalloc

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tagloom.functions import columns as C
from tagloom.functions import native as N
from tagloom.functions.tables import register
from tagloom.operators import grid, render, tree
from tagloom.operators.relation import nodes
from tagloom.plans.matching import count, facts, first_text, matches, size
from tagloom.plans.queries import ORACLES, QUERIES
from tagloom.plans.relational import page_meta, select, selected_texts, texts
from tagloom.plans.selector import Selector, SelectorError
from tagloom.sources.pages import read_html_files, read_pages, write_nodes
from tagloom.streaming.pages import page_texts, stream_pages


def test_entry(spark):
    assert entry.entry(spark).count() == 50


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("pages", "documents", "nation", "region", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    rows = [tuple(r) for r in got.select(*columns).collect()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_order_tables_hold_every_order(spark, sf):
    lines = duckdb.connect().sql(f"SELECT l_orderkey, l_linenumber::INT, l_quantity::DOUBLE FROM '{sf}/lineitem.parquet'").fetchall()
    got = QUERIES["order_tables"](spark, sf).select("orderkey", "line", "quantity").collect()
    assert sorted(map(tuple, got)) == sorted(lines)


def test_order_tables_are_read_in_one_arrow_map_after_one_shuffle(spark, sf, tmp_path):
    plan = QUERIES["order_tables"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"MapInArrow|EvalPythonUDTF|Exchange", plan) == ["MapInArrow", "Exchange"]
    rows = [(1, 1, 2.5), (1, None, 3.0), (1, 3, None), (None, 4, 1e-7), (2, None, None)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert sorted(map(tuple, QUERIES["order_tables"](spark, str(tmp_path)).collect()), key=repr) == sorted(rows, key=repr)


@pytest.mark.parametrize("selector", ["p", "nav li:nth-child(odd) > a", "article > p ~ p", "h1 + p, footer", "div:not(.ad), [href^='/t']", "ul a", "li:nth-last-child(-n+2)", ":empty"])
def test_plan_equals_tree(spark, sf, selector):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {(r.page_id, r.node_id) for r in select(nodes(pages), selector).collect()}
    want = set()
    for r in pages.collect():
        t = tree.parse(r.html)
        want |= {(r.page_id, n) for n in Selector(selector).select(t)}
    assert got == want


def test_selectors_and_texts_read_the_nodes_once(spark, sf):
    markup = [
        "<div><p>a<b>b<script>c</script></b><div><p>d</p>e</div></div>f<p>g", "<ul><li>a<ul><li>b</li><!--c--><li>d</ul>e<li>f</ul>",
        "<div id=x><i>1</i>t<i>2</i><div><i>3</i></div><i>4</i></div><div><div><i>5</i></div></div>", "<p><i>a</i></p><p><b>b</b></p>", "<script>a</script><title>b<p></title>", "", None,
    ]
    pages = spark.createDataFrame(list(enumerate(markup)), "page_id int, html string")
    n = nodes(pages)
    for selector in ("div > i", "div div > i", "i + i", "i ~ i", "div > div i", "li li, i", "p + p > b, div p", "*", "script, title, ul > li > ul", "div ~ div > div > i"):
        got = {(r.page_id, r.node_id, r.el_pos, r.text) for r in selected_texts(n, selector, columns=("el_pos",)).collect()}
        found, want = {(r.page_id, r.node_id) for r in select(n, selector).collect()}, set()
        for i, html in enumerate(markup[:-1]):
            t = tree.parse(html)
            chosen, place = Selector(selector).placed(t)
            want |= {(i, x, place[x], render.text_content(t, x)) for x in chosen}
        assert got == want
        assert found == {w[:2] for w in want}
    for plan in (select(n, "nav ul > li"), QUERIES["link_texts_by_relation"](spark, sf)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert (text.count("MapInArrow"), text.count("Exchange hashpartitioning")) == (1, 1)


def test_bad_selector_fails_before_running(spark, sf):
    with pytest.raises(SelectorError):
        select(nodes(spark.read.parquet(f"{sf}/pages.parquet")), "a[")
    with pytest.raises(SelectorError):
        C.html_query("html", "li >")


def test_meta_and_texts_equal_tree(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    n = nodes(pages).cache()
    got = {r.page_id: (r.title, r.lang) for r in page_meta(n).collect()}
    body = {r.page_id: r.text for r in texts(n, select(n, "article")).collect()}
    for r in pages.collect():
        t = tree.parse(r.html)
        m = grid.meta(t)
        assert got[r.page_id] == (m["title"], m["lang"])
        assert body[r.page_id] == render.text_content(t, Selector("article").select(t)[0])


def test_nulls_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "<p>a", "y"), (3, "", "z")], "page_id int, html string, name string")
    out = df.select("page_id", C.html_to_text("html").alias("a"), C.sanitize_html("html").alias("b"), C.html_meta("html").alias("m"), C.html_tables("html").alias("t"), C.tokenize("html").alias("k"), C.decode_entities("html").alias("d")).collect()
    assert [(r.a, r.b, r.t) for r in out] == [(None, None, None), ("a", "<p>a</p>", []), ("", "", [])]
    assert {r.page_id for r in nodes(df).collect()} == {2, 3}
    assert nodes(df.limit(0)).count() == 0


def test_values_of_a_batch_are_objects_a_part_at_a_time():
    values = pa.array([None, *("x" * 2_000 for _ in range(20_000)), ""])
    run = C.by_parts(str.upper, "string")
    lengths, seen = [], set()
    tracemalloc.start()
    for part in run(iter([values, pa.array([], pa.string())])):
        lengths.append(len(part))
        seen |= set(part.to_pylist()) if len(lengths) == 1 else set()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20
    assert sum(lengths) == 20_002
    assert seen == {None, "X" * 2_000}


def test_sql_functions(spark):
    register(spark)
    spark.createDataFrame([(1, "<table><tr><td>a<td>b</table><p class=q>&lt;</p>")], "id int, html string").createOrReplaceTempView("t")
    row = spark.sql("SELECT html_to_text(html) a, html_sanitize(html) b, html_is_safe_url('x:y') c, html_escape_attr('\"') d, html_strip_tags(html) e, size(html_tokenize(html)) f, html_meta(html).title g FROM t").first()
    assert tuple(row) == ("a\tb\n\n<", "<table><tr><td>a</td><td>b</td></tr></table><p>&lt;</p>", False, "&quot;", "ab<", 10, None)
    assert spark.sql("SELECT s.text FROM t, LATERAL html_select(html, '.q') s").first()[0] == "<"
    assert spark.sql("SELECT r.width FROM t, LATERAL html_table_rows(html) r").first()[0] == 2
    assert spark.sql("SELECT count(*) FROM t, LATERAL html_nodes(html) n").first()[0] == 9
    assert spark.sql("SELECT k.data FROM t, LATERAL html_tokens_state('a&amp;', 'rcdata', 'b') k").first()[0] == "a&"
    row = spark.sql("""SELECT html_sanitize('<a href="ftp:x" class=k>y', NULL, array('*:class'), array('FTP')) a, html_query(html, 'td:nth-child(2), .q') b, html_matches(html, 'p > b') c,
      html_is_safe_url('Ftp:x', array('ftp')) d, html_escape_text(concat('<&', chr(160), '>')) e, html_token_json('<b>') f, html_is_safe_url('java\\nscript:') g, html_is_safe_url(NULL) h FROM t""").first()
    assert tuple(row) == ('<a href="ftp:x" class="k">y</a>', ["<td>b</td>", '<p class="q">&lt;</p>'], False, True, "&lt;&amp;&nbsp;&gt;", '[["StartTag","b",[],false]]', False, None)
    plan = spark.sql("SELECT html_escape_attr(html), html_is_safe_url(html) FROM t")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_native_functions(spark):
    values = [("Aİz", "aİz"), ("\x0b", "\x0b")]
    df = spark.createDataFrame(values, "a string, b string")
    assert all(r[0] for r in df.select(N.ascii_lower("a") == F.col("b")).collect())
    spans = spark.createDataFrame([(x,) for x in (None, "", "0", " +3", "x", "12345678901", "2px", "5000")], "v string")
    assert [r[0] for r in spans.select(N.colspan("v")).collect()] == [grid.span(x, 1000) for x in (None, "", "0", " +3", "x", "12345678901", "2px", "5000")]
    ws = spark.createDataFrame([(" a\t b\n\x0bc ",)], "v string").select(N.collapse_ws("v"), N.split_ws("v"), N.normalise_newlines(F.lit("a\r\nb\rc"))).first()
    assert tuple(ws) == ("a b \x0bc", ["a", "b", "\x0bc"], "a\nb\nc")


def test_one_python_node_a_scan(spark, sf):
    df = nodes(spark.read.parquet(f"{sf}/pages.parquet"))
    plan = select(df, "p")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert "url" not in plan.split("ReadSchema")[1].split("\n")[0]


@pytest.mark.parametrize("name", ["page_facts", "page_title", "nav_links", "odd_link_texts", "heading_text", "footer_text", "tag_histogram", "token_counts", "bold_openings", "later_paragraphs", "paragraph_after_heading", "ads_and_local_links", "pages_by_language"])
def test_pages_are_parsed_once(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    workers = re.findall(r"(?m)^[\s:+\-*()\d]*(MapInArrow|ArrowEvalPythonUDTF|ArrowEvalPython|BatchEvalPython\w*)\b", plan)
    assert len(workers) == 1
    assert not workers[0].startswith("Batch")
    assert plan.count("FileScan") == 1


def test_matches_equal_tree(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {(r.page_id, r.ord, r.node_id, r.text, r.outer_html) for r in matches(pages, "article p:not(:first-child), footer", ("text", "outer_html")).collect()}
    want = set()
    for r in pages.collect():
        t = tree.parse(r.html)
        want |= {(r.page_id, i, n, render.text_content(t, n), render.serialize(t, n)) for i, n in enumerate(Selector("article p:not(:first-child), footer").select(t))}
    assert got == want
    awkward = spark.createDataFrame([(1, None), (2, ""), (3, "<p>x" * 30_000)], "page_id int, html string")
    assert [tuple(r) for r in facts(awkward, n=count("p"), t=first_text("p"), s=size()).orderBy("page_id").collect()] == [(2, 0, None, 1), (3, 30_000, "x", 60_001)]
    assert matches(awkward, "p").count() == 30_000
    assert matches(awkward.limit(0), "p").count() == 0


def test_nodes_are_written_and_read(spark, sf, tmp_path):
    pages = read_pages(spark, f"{sf}/pages.parquet", 3)
    write_nodes(nodes(pages), str(tmp_path / "nodes"))
    stored = spark.read.parquet(str(tmp_path / "nodes"))
    assert "MapInArrow" not in select(stored, "article > p ~ p")._jdf.queryExecution().executedPlan().toString()
    got = {(r.page_id, r.node_id) for r in select(stored, "article > p ~ p").collect()}
    assert got == {(r.page_id, r.node_id) for r in matches(pages, "article > p ~ p").collect()}


def test_files_and_stream(spark, sf, tmp_path):
    (tmp_path / "html").mkdir()
    (tmp_path / "html" / "a.html").write_bytes(b"<p>\xe2\x82</p>")
    assert read_html_files(spark, str(tmp_path / "html")).first().html == "<p>��</p>"
    spark.read.parquet(f"{sf}/pages.parquet").write.parquet(str(tmp_path / "pages"))
    q = page_texts(stream_pages(spark, str(tmp_path / "pages"))).writeStream.format("memory").queryName("texts").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        assert spark.table("texts").count() == 50
    finally:
        q.stop()
