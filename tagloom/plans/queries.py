"""Registered queries over pages and their DuckDB equivalents.

The oracles read the pages' markup with regular expressions over its fixed layout, or state expected values; they share no code
with the queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import columns as C
from tagloom.functions import native as N
from tagloom.functions.tables import register
from tagloom.operators.relation import nodes
from tagloom.operators.render import Policy
from tagloom.plans import matching as M
from tagloom.plans.matching import facts, matches
from tagloom.plans.relational import attr, element_siblings, page_meta, select, selected_texts, texts, with_match
from tagloom.plans.relational import within as below
from tagloom.plans.selector import SelectorError, parse_selector

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, spread over all cores before they are parsed."""
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _decoded(x: str) -> str:
    """SQL for the character references that occur in pages."""
    return f"""regexp_replace(replace(replace(replace({x}, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g')"""


def _collapsed(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\t\n\f\r ]+', ' ', 'g'))"


#: Markup outside script, style and comments.
_BARE = r"regexp_replace(html, '<script>.*?</script>|<style>.*?</style>|<!--.*?-->', '', 'gs')"
_TITLE = _collapsed(_decoded("regexp_extract(html, '<title>(.*?)</title>', 1, 's')"))


@query(f"""SELECT page_id, {_TITLE} AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
  len(regexp_extract_all(html, '<a href="[^"]*"')) AS n_links, len(regexp_extract_all({_BARE}, '<p>')) AS n_paragraphs FROM pages""")
def page_facts(spark, sf_dir):
    found = facts(pages(spark, sf_dir), meta=M.meta(), n_links=M.count("a[href]"), n_paragraphs=M.count("p"))
    return found.select("page_id", "meta.title", "meta.lang", "n_links", "n_paragraphs")


@query(f"""SELECT page_id, {_TITLE} AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang FROM pages""")
def page_meta_by_relation(spark, sf_dir):
    """The metadata as aggregates over the node relation."""
    return page_meta(nodes(pages(spark, sf_dir))).select("page_id", "title", "lang")


@query(f"SELECT page_id, {_TITLE} AS title FROM pages")
def page_title(spark, sf_dir):
    return pages(spark, sf_dir).withColumn("m", C.html_meta("html")).select("page_id", F.col("m.title").alias("title"))


@query("""SELECT page_id, i AS place, links[i] AS href FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS links FROM pages), range(1, 200) t(i) WHERE i <= len(links)""")
def nav_links(spark, sf_dir):
    found = matches(pages(spark, sf_dir), "nav li > a[href]", ("attrs",))
    return found.select("page_id", (F.col("ord") + 1).cast("long").alias("place"), attr("href").alias("href"))


@query("""SELECT page_id, i AS place, links[i] AS text FROM (SELECT page_id, regexp_extract_all(html, '<a href="[^"]*">(.*?)</a>', 1, 's') AS links FROM pages), range(1, 200) t(i) WHERE i <= len(links) AND i % 2 = 1""")
def odd_link_texts(spark, sf_dir):
    return matches(pages(spark, sf_dir), "nav ul li:nth-child(2n+1)", ("text",)).select("page_id", F.col("el_pos").cast("long").alias("place"), "text")


@query(f"SELECT page_id, {_decoded("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')")} AS heading FROM pages")
def heading_text(spark, sf_dir):
    return matches(pages(spark, sf_dir), "article > h1", ("text",)).select("page_id", F.col("text").alias("heading"))


@query("""SELECT page_id, i AS place, links[i] AS text FROM (SELECT page_id, regexp_extract_all(html, '<a href="[^"]*">(.*?)</a>', 1, 's') AS links FROM pages), range(1, 200) t(i) WHERE i <= len(links)""")
def link_texts_by_relation(spark, sf_dir):
    """Selectors and texts by intervals, over one reading of the node relation."""
    found = selected_texts(nodes(pages(spark, sf_dir)), "nav ul > li", columns=("el_pos",))
    return found.select("page_id", F.col("el_pos").cast("long").alias("place"), "text")


@query("""SELECT page_id, len(regexp_extract_all(html, '<li>'))::BIGINT AS below_nav, len(regexp_extract_all(html, '<a href="/'))::BIGINT AS below_items FROM pages""")
def scoped_links(spark, sf_dir):
    """Queries below a node: what lies below nav, and the links below its items."""
    found = pages(spark, sf_dir)
    items = matches(found, "li", (), within="nav").groupBy("page_id").agg(F.count("*").alias("below_nav"))
    links = matches(found, "a[href^='/']", (), within="nav li").groupBy("page_id").agg(F.count("*").alias("below_items"))
    return items.join(links, "page_id")


@query(f"SELECT page_id, {_decoded("regexp_extract(html, '<footer>(.*?)</footer>', 1, 's')")} AS footer FROM pages")
def footer_text(spark, sf_dir):
    register(spark)
    pages(spark, sf_dir).createOrReplaceTempView("tagloom_pages")
    return spark.sql("SELECT page_id, s.text AS footer FROM tagloom_pages, LATERAL html_select(html, 'footer') s")


@query(f"SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all({_BARE} || repeat('<style><script>', 1), '<([a-z][a-z0-9]*)', 1)) AS name FROM pages) GROUP BY name")
def tag_histogram(spark, sf_dir):
    return matches(pages(spark, sf_dir), "*", ("name",)).groupBy("name").agg(F.count("*").alias("n"))


@query(f"""SELECT page_id, len(regexp_extract_all({_BARE}, '<[a-z]')) + 2 AS start_tags, len(regexp_extract_all({_BARE}, '</[a-z]')) + 2 AS end_tags,
  len(regexp_extract_all(html, '<!-- ')) AS comments, len(regexp_extract_all(html, '<!DOCTYPE')) AS doctypes FROM pages""")
def token_counts(spark, sf_dir):
    register(spark)
    pages(spark, sf_dir).createOrReplaceTempView("tagloom_pages")
    return spark.sql("""SELECT page_id, count_if(kind = 'StartTag') AS start_tags, count_if(kind = 'EndTag') AS end_tags, count_if(kind = 'Comment') AS comments,
      count_if(kind = 'DOCTYPE') AS doctypes FROM tagloom_pages, LATERAL html_tokens(html) GROUP BY page_id""")


@query("""SELECT page_id, 0 + (html LIKE '%<p><b>%')::BIGINT * len(regexp_extract_all(html, '<p><b>')) AS n_bold FROM pages WHERE html LIKE '%<p><b>%'""")
def bold_openings(spark, sf_dir):
    return facts(pages(spark, sf_dir), n_bold=M.count("p > b:first-child")).where("n_bold > 0")


@query(f"""SELECT page_id, greatest(len(regexp_extract_all(regexp_extract({_BARE}, '<article>(.*)', 1, 's'), '<p>')) - 1, 0) AS later FROM pages
  WHERE len(regexp_extract_all(regexp_extract({_BARE}, '<article>(.*)', 1, 's'), '<p>')) > 1""")
def later_paragraphs(spark, sf_dir):
    return facts(pages(spark, sf_dir), later=M.count("article > p ~ p")).where("later > 0")


@query(f"SELECT page_id, 1::BIGINT AS n FROM pages WHERE regexp_matches({_BARE}, '</h1><p>')")
def paragraph_after_heading(spark, sf_dir):
    return facts(pages(spark, sf_dir), n=M.count("h1 + p")).where("n > 0")


@query("""SELECT page_id, len(regexp_extract_all(html, '<div class="ad">'))::BIGINT AS ads, len(regexp_extract_all(html, '<a href="/'))::BIGINT AS local_links FROM pages""")
def ads_and_local_links(spark, sf_dir):
    found = matches(pages(spark, sf_dir), "div.ad, a[href^='/'], nothing:not(*)", ("name",))
    return found.groupBy("page_id").agg(F.count_if(F.col("name") == "div").alias("ads"), F.count_if(F.col("name") == "a").alias("local_links"))


@query("""SELECT regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, count(*) AS n_pages, sum(len(regexp_extract_all(html, '<li>')))::BIGINT AS n_items FROM pages GROUP BY ROLLUP(lang)""".replace("GROUP BY ROLLUP(lang)", "GROUP BY ROLLUP(1)"))
def pages_by_language(spark, sf_dir):
    found = facts(pages(spark, sf_dir), meta=M.meta(), items=M.count("li")).select("meta.lang", "items")
    return found.rollup("lang").agg(F.count("*").alias("n_pages"), F.sum("items").alias("n_items"))


_ESCAPES = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"""SELECT doc_id, md5({_ESCAPES.format("replace(text, chr(160), '&nbsp;')").replace("replace(replace(text, chr(160), '&nbsp;'), '&', '&amp;')", "replace(replace(text, '&', '&amp;'), chr(160), '&nbsp;')")}) AS escaped,
  md5(replace({_ESCAPES.format("text").replace("replace(text, '&', '&amp;')", "replace(replace(text, '&', '&amp;'), chr(160), '&nbsp;')")}, '"', '&quot;')) AS quoted FROM documents""")
def escaped_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.md5(N.escape_text("text").cast("binary")).alias("escaped"), F.md5(N.escape_attr("text").cast("binary")).alias("quoted"))


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents")
def escape_round_trip(spark, sf_dir):
    """Escaping and then decoding is the identity (the texts hold no carriage return)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.md5(C.decode_entities(N.escape_attr("text")).cast("binary")).alias("text_md5"))


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents")
def strip_round_trip(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    html = F.concat(F.lit("<div><title>no</title><i>"), N.escape_text("text"), F.lit("</i><script>x</script></div>"))
    return docs.select("doc_id", F.md5(C.strip_tags(html).cast("binary")).alias("text_md5"))


@query("SELECT n_nationkey AS nation, n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def nation_table(spark, sf_dir):
    """Regions and nations as one HTML table with row spans, and back."""
    register(spark)
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    cell = F.concat(F.lit("<td>"), F.col("n_nationkey").cast("string"), F.lit("<td>"), N.escape_text("n_name"))
    groups = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    html = F.concat(F.lit("<tr><th rowspan='"), F.size("cells").cast("string"), F.lit("'>"), N.escape_text("r_name"), F.array_join("cells", "<tr>"))
    table = groups.agg(F.concat(F.lit("<table>"), F.array_join(F.sort_array(F.collect_list(html)), ""), F.lit("</table>")).alias("html"))
    table.createOrReplaceTempView("tagloom_nations")
    cells = spark.sql("SELECT c.* FROM tagloom_nations, LATERAL html_cells(html) c")
    rows = cells.groupBy("table_ix", "row_ix").agg(*(F.max(F.when(F.col("col_ix") == i, F.col("text"))).alias(x) for i, x in enumerate(("region", "nation", "name"))))
    return rows.select(F.col("nation").cast("int").alias("nation"), "name", "region")


@query("SELECT l_orderkey AS orderkey, l_linenumber::INT AS line, l_quantity::DOUBLE AS quantity FROM lineitem")
def order_tables(spark, sf_dir):
    """Lines of all orders as one table an order, and back through the relation of table rows."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    row = F.concat(F.lit("<tr><td>"), said("l_linenumber"), F.lit("</td><td> "), said("l_quantity"), F.lit("\n</td></tr>"))
    orders = lines.groupBy("l_orderkey").agg(F.concat(F.lit("<table><tbody>"), F.array_join(F.collect_list(row), "\n"), F.lit("</table>")).alias("html"))
    found = M.table_rows(orders, keys=("l_orderkey",))
    cell = lambda i: F.nullif(F.get("cells", F.lit(i)), F.lit(""))
    return found.select(F.col("l_orderkey").alias("orderkey"), cell(0).cast("int").alias("line"), cell(1).cast("double").alias("quantity"))


# ---- stated inputs and expected values ----------------------------------------------------------------------------


def _values(cases: list[tuple]) -> str:
    cell = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool | int) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join(f'({i}, {", ".join(map(cell, c[1:]))})' for i, c in enumerate(cases))}) t(id, %s)"


def stated(columns: str, cases: list[tuple]):
    """A query over literal inputs (the first of each case); the oracle lists the rest."""

    def add(f):
        def run(spark, sf_dir):
            df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "id int, input string")
            return f(df)

        run.__name__ = f.__name__
        return query(_values(cases) % columns)(run)

    return add


@stated("decoded", [
    ("caf&eacute; &amp; co", "café & co"), ("&ltb&gt", "<b>"), ("&ampx;&nosuch;", "&x;&nosuch;"), ("&#65;&#x42;&#X43", "ABC"), ("&#150;&#0;&#x110000;", "–��"),
    ("&notin; &notinx", "∉ ¬inx"), ("&#; &#x; & &", "&#; &#x; & &"), ("&#xD800;&#1;", "�\x01"), (None, None),
])
def decode_cases(df):
    return df.select("id", C.decode_entities("input").alias("decoded"))


@stated("tree", [
    ("<p>one<p>two", "<p>one</p><p>two</p>"), ("<ul><li>a<li>b</ul>c", "<ul><li>a</li><li>b</li></ul>c"), ("<i><b>x</i>y</b>", "<i><b>x</b></i>y"),
    ("<table><thead><tr><th>q<tbody><tr><td>r</table>", "<table><thead><tr><th>q</th></tr></thead><tbody><tr><td>r</td></tr></tbody></table>"), ("k</br>l", "k<br>l"),
    ("<h3>u<h5>v</h4>w", "<h3>u</h3><h5>v</h5>w"), ("a\r\nb\rc", "a\nb\nc"), ("<a>x<a>y</a>", "<a>x</a><a>y</a>"), ("<dl><dt>t<dd>d<dt>u</dl>", "<dl><dt>t</dt><dd>d</dd><dt>u</dt></dl>"),
    ("<select><option>1<option>2</select>", "<select><option>1</option><option>2</option></select>"), ("<pre>\n\na</pre>", "<pre>\na</pre>"),
    ("<script>a<!--<script>b</script>c--></script>d", "<script>a<!--<script>b</script>c--></script>d"), ("a<!--x--><!y>", "a<!--x--><!--y-->"), ("<p a=1 A=2 b>", '<p a="1" b=""></p>'), (None, None),
])
def parse_cases(df):
    return df.select("id", C.serialize_html("input").alias("tree"))


@stated("tokens", [
    ("<A B=c>x</a >", '[["StartTag","a","b=c"],["Character","x"],["EndTag","a"]]'), ("<title><b></title>", '[["StartTag","title",""],["Character","<b>"],["EndTag","title"]]'),
    ("<!doctype HTML><br/>", '[["DOCTYPE","html"],["StartTag","br",""]]'), ("a < b <", '[["Character","a < b <"]]'), ("<p", "[]"),
])
def token_cases(df):
    x = C.tokenize("input")
    attrs = lambda t: F.array_join(F.transform(t["attrs"], lambda a: F.concat_ws("=", a["name"], a["value"])), ",")
    row = lambda t: F.array_compact(F.array(t["kind"], F.coalesce(t["name"], t["data"]), F.when(t["kind"] == "StartTag", attrs(t))))
    return df.select("id", F.to_json(F.transform(x, row)).alias("tokens"))


@stated("text", [
    ("<h2>T</h2><p>a  b<br>c</p>", "## T\n\na b\nc"), ("<ol><li>x<li>y</ol>z", "- x\n- y\n\nz"), ("<table><tr><th>a<th>b<tr><td>1<td>2</table>", "a\tb\n1\t2"),
    ("<pre> x\n  y</pre>", " x\n  y"), ("<p>a</p><hr><p>b</p>", "a\n\n---\n\nb"), ("<script>no</script><dl><dt>k<dd>v</dl>", "k\nv"), (None, None),
])
def text_cases(df):
    return df.select("id", C.html_to_text("input").alias("text"))


@stated("clean, framed", [
    ("<p onclick=x>a<script>b</script></p>", "<p>a</p>", "<p>a</p>"), ('<a href="javascript:x">l</a>', "<a>l</a>", "<a>l</a>"), ("<font><b>x</b></font>", "<b>x</b>", "<b>x</b>"),
    ('<img src="/i.png" onerror=x alt="&lt;">', '<img src="/i.png" alt="&lt;">', '<img src="/i.png" alt="&lt;">'), ("<iframe src='https://e.org/'>in</iframe>t", "t", '<iframe src="https://e.org/"></iframe>t'),
    ("a<!-- c -->&amp;<u class=q>", "a&amp;<u></u>", 'a&amp;<u class="q"></u>'), ("<a href='Gopher://h/'>g</a>", "<a>g</a>", '<a href="Gopher://h/">g</a>'),
    ("<q cite='news:n'>n</q>", "<q>n</q>", "<q>n</q>"), (None, None, None),
])
def sanitize_cases(df):
    wide = Policy().allow_tag("IFRAME").allow_attr("iframe", "src").allow_attr("*", "class").allow_scheme("GOPHER")
    return df.select("id", C.sanitize_html("input").alias("clean"), C.sanitize_html("input", wide).alias("framed"))


@stated("safe", [
    ("http://e.org", True), ("//e.org/a:b", True), ("java\tscript:x", False), ("MAILTO:a@b", True), ("data:text/html,x", False), ("?q=a:b", True), ("", True), (" \x01https:x", True), (None, None),
])
def safe_url_cases(df):
    return df.select("id", N.is_safe_url("input").alias("safe"))


@stated("title, description, canonical, lang, og", [
    ("<html><html lang=de><title> a\n b </title><title>c</title>", "a b", None, None, "de", ""), ("<title></title><title>x</title><meta name=DESCRIPTION content=''>", None, "", None, None, ""),
    ("<link rel='x Canonical'><link rel=canonical href=/c><meta property='OG:Title' content=t><meta property=og:u content='&amp;'>", None, None, "/c", None, "Title=t;u=&"),
])
def meta_cases(df):
    m = page_meta(nodes(df.withColumnRenamed("id", "page_id"), "input"))
    og = F.array_join(F.transform("og", lambda x: F.concat_ws("=", x["property"], x["content"])), ";")
    return m.select(F.col("page_id").alias("id"), "title", "description", "canonical", "lang", og.alias("og"))


@stated("cells, widths", [
    ("<table><tr><td colspan=2>a<td>b<tr><td>c</table>", "a,a,b|c", "3,1"), ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a,b|a,c", "2,2"), ("<table><tr><tr><td>x</table>", "|x", "0,1"),
    ("<table><tr><td>o<table><tr><td>i</table></table>", "oi||i", "1||1"), ("none", "", ""),
])
def table_cases(df):
    grids = C.html_tables("input")
    cells = F.transform(grids, lambda t: F.array_join(F.transform(t, lambda r: F.array_join(r, ",")), "|"))
    widths = F.transform(grids, lambda t: F.array_join(F.transform(t, lambda r: F.size(r).cast("string")), ","))
    return df.select("id", F.array_join(cells, "||").alias("cells"), F.array_join(widths, "||").alias("widths"))


@stated("tokens", [
    ("<p", "[]"), ("<A B=c d>x</a >", '[["StartTag","a",[["b","c"],["d",""]],false],["Character","x"],["EndTag","a"]]'), ("<!--c--><br/>", '[["Comment","c"],["StartTag","br",[],true]]'),
    ("<!doctype HTML public 'p'>", '[["DOCTYPE","html","p",null,true]]'), ("é\u2028&lt;", '[["Character","é\u2028<"]]'), (None, None),
])
def token_json_cases(df):
    return df.select("id", C.token_json("input").alias("tokens"))


@stated("rcdata, rawtext, plaintext, cdata, script", [
    ("&lt;</u>&gt;", '[["Character","<"],["EndTag","u"],["Character",">"]]', '[["Character","&lt;"],["EndTag","u"],["Character",">"]]', '[["Character","&lt;</u>&gt;"]]',
     '[["Character","&lt;</u>&gt;"]]', '[["Character","&lt;"],["EndTag","u"],["Character",">"]]'),
    ("]]><i>", '[["Character","]]><i>"]]', '[["Character","]]><i>"]]', '[["Character","]]><i>"]]', '[["StartTag","i",[],false]]', '[["Character","]]><i>"]]'),
])
def state_cases(df):
    """Each state is told from where it begins and that u was the last start tag."""
    return df.select("id", *(C.token_json("input", x, "U").alias(x) for x in ("rcdata", "rawtext", "plaintext", "cdata", "script")))


@stated("repaired", [
    ("4142", "AB"), ("C3A9", "é"), ("61E28262", "a\ufffd\ufffdb"), ("FF", "\ufffd"), ("EDA080", "\ufffd\ufffd\ufffd"), ("F09F9880C0", "😀\ufffd"), ("", ""), (None, None),
])
def repair_cases(df):
    """Bytes, stated in hexadecimal, as text."""
    return df.select("id", C.repair_utf8(F.unhex("input")).alias("repaired"))


@stated("lines", [("a\r\nb\rc\n", "a\nb\nc\n"), ("\r\r\n", "\n\n"), ("none", "none"), (None, None)])
def newline_cases(df):
    return df.select("id", N.normalise_newlines("input").alias("lines"))


@stated("nodes, elements, texts, depth, bare", [
    ("", 1, 0, 0, 0, True), ("x</i>y</b>z", 2, 0, 1, 1, False), ("x<!---->y", 4, 0, 2, 1, False), ("<p>a<br>b", 5, 2, 2, 2, False),
    ("<i>" * 255 + "<u>x", 258, 256, 1, 257, False), ("<i>" * 256 + "<u>x", 258, 256, 1, 257, False),
])
def node_cases(df):
    """Numbers of nodes, the depth of the deepest and whether the document has no children; text runs merge, the 257th open element is left out."""
    n = nodes(df.withColumnRenamed("id", "page_id"), "input")
    kinds = [F.count_if(F.col("kind") == k).cast("int").alias(f"{k}s") for k in ("element", "text")]
    return n.groupBy(F.col("page_id").alias("id")).agg(F.count("*").cast("int").alias("nodes"), *kinds, F.max("depth").alias("depth"), (F.max("node_id") == 0).alias("bare"))


@stated("siblings", [("<ul><li>a<li>b<p>c</ul>d<i>e</i>", "ul: ul,i; li: li,li; li: li,li; p: p; i: ul,i"), ("<b>x</b>", "b: b"), ("x", "")])
def sibling_cases(df):
    """The element siblings of each element, itself among them."""
    n = nodes(df.withColumnRenamed("id", "page_id"), "input")
    names = n.where("kind = 'element'").select("page_id", "node_id", "name")
    near = element_siblings(n, n.where("kind = 'element'")).join(names.select("page_id", F.col("node_id").alias("sibling_id"), F.col("name").alias("near")), ["page_id", "sibling_id"])
    lists = near.groupBy("page_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("el_pos", "near"))).alias("near")).join(names, ["page_id", "node_id"])
    line = F.concat("name", F.lit(": "), F.array_join(F.transform("near", lambda x: x["near"]), ","))
    found = lists.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("node_id", line.alias("line")))).alias("lines"))
    return df.select(F.col("id").alias("page_id")).join(found, "page_id", "left").select(F.col("page_id").alias("id"), F.coalesce(F.array_join(F.transform("lines", lambda x: x["line"]), "; "), F.lit("")).alias("siblings"))


@stated("columns, rows", [("3", 3, 3), (" +07x", 7, 7), ("0", 1, 1), ("", 1, 1), ("-2", 1, 1), ("1001", 1000, 1001), ("70000", 1000, 65534), ("0000000012", 1000, 65534), ("\x0b4", 1, 1), (None, 1, 1)])
def span_cases(df):
    return df.select("id", N.colspan("input").alias("columns"), N.rowspan("input").alias("rows"))


@stated("rows, last, cells", [("<tr><td colspan=900>x", 1112, 100, 1000000), ("<tr><td>x", 1200, 1, 1200), ("<tr><td colspan=500 rowspan=2>x", 1200, 1000, 1199500)])
def large_table_cases(df):
    """1,200 equal rows: no more than a million cells are placed, those that a row span carries on besides, and the row at which it ends is kept."""
    t = F.element_at(C.html_tables(F.concat(F.lit("<table>"), F.repeat("input", F.lit(1200)))), 1)
    return df.select("id", F.size(t).alias("rows"), F.size(F.element_at(t, -1)).alias("last"), F.aggregate(t, F.lit(0), lambda n, row: n + F.size(row)).alias("cells"))


@stated("meta", [
    ("<title>a <b>b</title><meta property=og:x content='1\"'>", '{"title":"a <b>b","description":null,"canonical":null,"lang":null,"og":[["x","1\\""]]}'),
    ("", '{"title":null,"description":null,"canonical":null,"lang":null,"og":[]}'), (None, None),
])
def meta_json_cases(df):
    return df.select("id", C.meta_json("input").alias("meta"))


_HIDES = "<template><b>x</b>y<script>z</script></template><title>t<i></title><noscript>n<u></noscript><div>a<style>s</style>b</div>"
_VISIBLE = {"template": "", "template b": "x", "title": "", "noscript": "", "div": "ab", "div style": "", "template script": ""}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}', '{v}')" for k, v in _VISIBLE.items()) + ") t(selector, by_tree, by_relation)")
def hidden_text_cases(spark, sf_dir):
    """Text of elements that hide it, of what is below them, and around them: in the tree and by the relation."""
    page = spark.createDataFrame([(0, _HIDES)], "page_id int, html string")
    n = nodes(page)
    one = lambda s: matches(page, s, ("text",)).select(F.lit(s).alias("selector"), F.col("text").alias("by_tree"), "node_id").join(texts(n, select(n, s)), "node_id").select("selector", "by_tree", F.col("text").alias("by_relation"))
    return reduce(DataFrame.unionByName, map(one, _VISIBLE))


_BAD = {
    "": 0, "  ": 2, "b,": 2, "b, ,i": 3, ",b": 0, "b >": 3, "b > ~ i": 4, "#": 1, "b.": 2, "b!": 1, "::b": 1, ":target": 7, ":empty-ish": 10, "[": 1, "[q": 2, "[q=": 3, "[q=w": 4, "[q=\"w]": 3, "[q!]": 2, "[q=w e]": 5,
    ":nth-child": 10, ":nth-child( even": 12, ":nth-child( z)": 12, ":nth-last-child(3n+)": 16, ":nth-child(1234567891)": 11, ":not": 4, ":not()": 5, ":not(b": 6, ":not( b i)": 8, "b )": 2,
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in _BAD.items()) + ") t(selector, stops_at)")
def bad_selector_cases(spark, sf_dir):
    """The character at which the reader of a selector stops."""

    def offset(s: str) -> int | None:
        try:
            parse_selector(s)
        except SelectorError as e:
            return e.offset

    return spark.createDataFrame([(s, offset(s)) for s in _BAD], "selector string, stops_at int")


_LIST = "<div id=d class='x y' lang=en-GB><p data-a='1 2'>a</p><p>b<i></i></p><span>c</span></div><ul><li data-a=1>k<em></em></li></ul>"
#: Texts of what matches, and how many elements match.
_SELECTORS = {
    "p": ("a,b", 2), "#d > p": ("a,b", 2), ".y :last-child": (",c", 2), "[lang|=en] span": ("c", 1), "[data-a~='2']": ("a", 1), "p + span": ("c", 1), "p ~ *": ("b,c", 2),
    "p:not([data-a])": ("b", 1), "[data-a^='1 ']": ("a", 1), "[data-a$='2']": ("a", 1), "[data-a$='1']": ("k", 1), "[data-a*=' ']": ("a", 1), "[lang*='-G'] > p": ("a,b", 2), "[data-a=1]": ("k", 1), "[data-a='1 2']": ("a", 1),
    "[data-a=2]": ("", 0), "*:nth-child(odd):not(div):not(i):not(ul *)": ("a,c", 2), "[data-a^='']": ("", 0), "[data-a$='']": ("", 0), "[data-a*='']": ("", 0), "li:only-child": ("k", 1), "p > :only-child": ("", 1),
    "p:only-child": ("", 0), "div > :first-child": ("a", 1), "div > :last-child": ("c", 1), "p:last-child": ("", 0), "i:empty": ("", 1), "p:empty": ("", 0), ":empty": (",", 2), "div :nth-last-child(1)": (",c", 2),
    ":nth-last-child(-n+2) + span": ("c", 1), "span, p, span": ("a,b,c", 3), "ul, div i": (",k", 2), "[data-a]": ("a,k", 2),
}
_SELECTORS.pop("*:nth-child(odd):not(div):not(i):not(ul *)")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k.replace(chr(39), chr(39) * 2)}', '{v}', {n}, '{v}', {n}, {n})" for k, (v, n) in _SELECTORS.items()) + ") t(selector, found, n, tree_found, tree_n, flagged)")
def selector_cases(spark, sf_dir):
    """Each selector as a plan over the node relation and as a match in the tree: texts and number of elements, and the number of match flags."""
    page = spark.createDataFrame([(0, _LIST)], "page_id int, html string")
    n = nodes(page)
    joined = lambda df: df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "text"))), lambda x: x["text"]), ",").alias("found"), F.count("*").cast("int").alias("n"))

    def one(s: str) -> DataFrame:
        tree = joined(matches(page, s, ("text",))).select(F.col("found").alias("tree_found"), F.col("n").alias("tree_n"))
        flags = with_match(n, s).agg(F.count_if("matches").cast("int").alias("flagged"))
        return joined(texts(n, select(n, s))).select(F.lit(s).alias("selector"), "*").join(tree).join(flags)

    return reduce(DataFrame.unionByName, map(one, _SELECTORS))


@query("SELECT * FROM (VALUES ('p', 'div', 2, 2), ('i', 'div p', 1, 1), ('*', 'ul', 2, 2), ('div p', 'div', 2, 2), ('p', 'ul', 0, 0), ('div', 'div', 0, 0)) t(selector, scope, in_tree, in_relation)")
def scope_cases(spark, sf_dir):
    """Elements below those that another selector finds."""
    page = spark.createDataFrame([(0, _LIST)], "page_id int, html string")
    n = nodes(page)
    out = []
    for s, scope in (("p", "div"), ("i", "div p"), ("*", "ul"), ("div p", "div"), ("p", "ul"), ("div", "div")):
        tree = matches(page, s, (), within=scope).agg(F.count("*").cast("int").alias("in_tree"))
        out.append(tree.select(F.lit(s).alias("selector"), F.lit(scope).alias("scope"), "in_tree").join(below(select(n, s), select(n, scope)).agg(F.count("*").cast("int").alias("in_relation"))))
    return reduce(DataFrame.unionByName, out)
