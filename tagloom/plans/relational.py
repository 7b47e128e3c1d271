"""Plans over the node relation: selectors as windows over one reading of it, text, links and metadata as aggregates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.native import ascii_lower, collapse_ws, split_ws
from tagloom.plans.selector import Complex, Compound, Test, parse_selector


def attr(name: str, attrs: str | Column = "attrs") -> Column:
    """Value of an attribute, null if it is missing."""
    return F.try_element_at(F.map_from_entries(attrs), F.lit(name))


def _nth(a: int, b: int, place: Column) -> Column:
    if a == 0:
        return place == b
    return (F.pmod(place - b, F.lit(abs(a))) == 0) & (place >= b if a > 0 else place <= b)


def _test(x: Test) -> Column:
    if x.kind == "id":
        c = attr("id") == x.value
    elif x.kind == "class":
        c = F.array_contains(split_ws(attr("class")), x.value)
    elif x.kind == "not":
        c = ~compound_column(x.value)
    elif x.kind == "nth":
        c = _nth(*x.value, F.col("el_pos"))
    elif x.kind == "nth-last":
        c = _nth(*x.value, F.col("el_count") - F.col("el_pos") + 1)
    elif x.kind == "flag":
        c = {"first-child": F.col("el_pos") == 1, "last-child": F.col("el_pos") == F.col("el_count"), "only-child": F.col("el_count") == 1, "empty": F.col("is_blank")}[x.name]
    else:
        v, want = attr(x.name), x.value
        if x.op == "":
            c = v.isNotNull()
        elif x.op == "=":
            c = v == want
        elif x.op == "~=":
            c = F.array_contains(split_ws(v), want)
        elif x.op == "|=":
            c = (v == want) | v.startswith(want + "-")
        elif not want:
            c = F.lit(False)
        else:
            c = {"^=": v.startswith, "$=": v.endswith, "*=": v.contains}[x.op](want)
    return F.coalesce(c, F.lit(False))


def compound_column(c: Compound) -> Column:
    tests = [_test(x) for x in c.tests]
    if c.tag is not None:
        tests.insert(0, F.coalesce(F.col("name") == c.tag, F.lit(False)))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


#: Places of a depth in the order by depth and then node.
_DEPTH = 1 << 32


def _steps(flags: list[Column], steps: Complex, k: list[str]) -> list[Callable[[DataFrame], DataFrame]]:
    """What adds the column __found to candidates that have these flags, one flag a step."""
    page = Window.partitionBy(*k)
    before = page.orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    siblings = Window.partitionBy(*k, "parent_id").orderBy("el_pos")
    at = F.col("depth").cast("bigint") * _DEPTH + F.col("node_id")
    # of what is found one level higher, the last before a node is the only one that can be its parent
    higher = page.orderBy(at).rangeBetween(Window.unboundedPreceding, -_DEPTH)
    last = lambda value, window: F.max(F.when(F.col("__found"), value)).over(window)
    reached = {
        " ": last(F.col("last_desc"), before) >= F.col("node_id"),
        ">": last(at, higher) == at - F.col("node_id") - _DEPTH + F.col("parent_id"),
        "+": last(F.col("el_pos"), siblings.rowsBetween(-1, -1)) == F.col("el_pos") - 1,
        "~": F.coalesce(F.max("__found").over(siblings.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)),
    }
    first, *later = flags
    adds = [lambda df: df.withColumn("__found", first)]
    for (combinator, _), flag in zip(steps[1:], later, strict=True):
        adds.append(lambda df, c=combinator, flag=flag: df.withColumn("__found", flag & F.coalesce(reached[c], F.lit(False))))
    return adds


def _found(nodes: DataFrame, complexes: list[Complex], keys: tuple[str, ...], also: Column) -> DataFrame:
    """Rows of the elements that match, with __found, and rows for which `also` holds, from one reading of nodes."""
    names = [[f"__flag_{i}_{j}" for j in range(len(c))] for i, c in enumerate(complexes)]
    is_element = F.col("kind") == "element"
    flags = [(is_element & compound_column(step[1])).alias(n) for c, own in zip(complexes, names, strict=True) for step, n in zip(c, own, strict=True)]
    df = nodes.select(*nodes.columns, *flags).where(reduce(lambda a, b: a | b, (F.col(n) for own in names for n in own), also))
    if any(len(c) > 1 for c in complexes):
        df = df.repartition(*keys)
    for i, (c, own) in enumerate(zip(complexes, names, strict=True)):
        for add in _steps([F.col(n) for n in own], c, list(keys)):
            df = add(df)
        df = df.withColumnRenamed("__found", f"__found_{i}")
    found = reduce(lambda a, b: a | b, (F.col(f"__found_{i}") for i in range(len(complexes))))
    return df.select(*nodes.columns, found.alias("__found")).where(also | F.col("__found"))


def select(nodes: DataFrame, selector: str, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Rows of the elements that match; a bad selector raises before anything runs. The nodes are read once."""
    return _found(nodes, parse_selector(selector), keys, F.lit(False)).drop("__found")


def selected_texts(nodes: DataFrame, selector: str, keys: tuple[str, ...] = ("page_id",), columns: tuple[str, ...] = ()) -> DataFrame:
    """keys, node_id, these columns and the text of each element that matches, as by select and texts, but the nodes are read once."""
    k = list(keys)
    is_text = F.col("kind") == "text"
    df = _found(nodes, parse_selector(selector), keys, is_text)
    before = Window.partitionBy(*k).orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__inside", F.max(F.when(F.col("__found"), F.col("last_desc"))).over(before) >= F.col("node_id")).where("__found OR __inside")
    # each text goes to the elements above it, each element that matches to itself
    df = df.select(*df.columns, F.explode(F.when(is_text, F.col("ancestors")).otherwise(F.array("node_id"))).alias("__at"))
    shown = is_text & (F.col("hidden_by").isNull() | (F.col("hidden_by") < F.col("__at")))
    parts = F.array_sort(F.collect_list(F.when(shown, F.struct("node_id", "data"))))
    own = [F.max_by(c, F.when(F.col("__found"), F.lit(1))).alias(c) for c in columns]
    df = df.groupBy(*k, "__at").agg(F.max("__found").alias("__root"), parts.alias("__parts"), *own).where("__root")
    return df.select(*k, F.col("__at").alias("node_id"), *columns, F.array_join(F.transform("__parts", lambda p: p["data"]), "").alias("text"))


def within(found: DataFrame, scopes: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Rows of found that lie below a node of scopes, each once."""
    k = list(keys)
    above = scopes.select(*k, F.col("node_id").alias("__above")).distinct()
    below = found.select(*k, "node_id", F.explode("ancestors").alias("__above")).join(above, [*k, "__above"], "left_semi")
    return found.join(below.select(*k, "node_id").distinct(), [*k, "node_id"], "left_semi")


def with_match(nodes: DataFrame, selector: str, name: str = "matches", keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """nodes with a boolean column: whether the selector matches. Nodes other than elements never match."""
    k = [*keys, "node_id"]
    found = select(nodes, selector, keys).select(*k, F.lit(True).alias(name))
    return nodes.join(found, k, "left").withColumn(name, F.coalesce(name, F.lit(False))).select(*nodes.columns, name)


def element_siblings(nodes: DataFrame, of: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keys, node_id, sibling_id, el_pos: the elements with the same parent as each node of `of`, itself among them if it is one.

    A document node has itself alone."""
    k = list(keys)
    own = of.select(*k, "node_id", "parent_id")
    near = nodes.where("kind = 'element'").select(*k, "parent_id", F.col("node_id").alias("sibling_id"), "el_pos")
    alone = own.where("parent_id IS NULL").select(*k, "node_id", F.col("node_id").alias("sibling_id"), F.lit(None).cast("int").alias("el_pos"))
    return own.join(near, [*k, "parent_id"]).select(*k, "node_id", "sibling_id", "el_pos").unionByName(alone)


def texts(nodes: DataFrame, roots: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keys, node_id, text: the text content of each root element. Only the root and what is below it hide text, not what is above."""
    k = list(keys)
    t = nodes.where("kind = 'text'").select(*k, F.col("node_id").alias("__at"), "data", "hidden_by", F.explode("ancestors").alias("node_id"))
    t = t.where("hidden_by IS NULL OR hidden_by < node_id").drop("hidden_by")
    joined = t.join(roots.select(*k, "node_id"), [*k, "node_id"], "left_semi")
    parts = joined.groupBy(*k, "node_id").agg(F.array_sort(F.collect_list(F.struct("__at", "data"))).alias("__parts"))
    text = F.array_join(F.transform("__parts", lambda p: p["data"]), "")
    return roots.select(*k, "node_id").join(parts.select(*k, "node_id", text.alias("text")), [*k, "node_id"], "left").select(*k, "node_id", F.coalesce("text", F.lit("")).alias("text"))


def links(nodes: DataFrame) -> DataFrame:
    return select(nodes, "a[href]").select("page_id", "node_id", attr("href").alias("href"))


def page_meta(nodes: DataFrame) -> DataFrame:
    """page_id, title, description, canonical, lang, og: one aggregation by page."""
    first = lambda value, when: F.min_by(F.when(when, value), F.when(when, F.col("node_id")))
    name, content, href = F.col("name"), attr("content"), attr("href")
    lang = attr("lang")
    is_og = (name == "meta") & content.isNotNull() & ascii_lower(F.substring(attr("property"), 1, 3)).eqNullSafe("og:")
    canonical = (name == "link") & href.isNotNull() & F.coalesce(F.array_contains(split_ws(ascii_lower(attr("rel"))), "canonical"), F.lit(False))
    description = (name == "meta") & content.isNotNull() & ascii_lower(attr("name")).eqNullSafe("description")
    og = F.collect_list(F.when(is_og, F.struct("node_id", F.substring(attr("property"), 4, 1 << 30).alias("property"), content.alias("content"))))
    title = F.min(F.when(name == "title", F.col("node_id")))
    facts = nodes.groupBy("page_id").agg(first(content, description).alias("description"), first(href, canonical).alias("canonical"), first(lang, (name == "html") & lang.isNotNull()).alias("lang"), F.array_sort(og).alias("__og"), title.alias("__title"))
    direct = nodes.where("kind = 'text'").select("page_id", F.col("parent_id").alias("__title"), "node_id", "data")
    parts = facts.select("page_id", "__title").join(direct, ["page_id", "__title"]).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "data"))).alias("__parts"))
    text = collapse_ws(F.array_join(F.transform("__parts", lambda p: p["data"]), ""))
    out = facts.join(parts.select("page_id", F.nullif(text, F.lit("")).alias("title")), "page_id", "left")
    return out.select("page_id", "title", "description", "canonical", "lang", F.transform("__og", lambda x: F.struct(x["property"].alias("property"), x["content"].alias("content"))).alias("og"))
