"""HTML pages as sources: title, blocks in document order, plain text, tag balance, outline, matched tables.

Everything is a column expression or an explode over regular expressions; nested tags are matched by running depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import TAG, squeezed

#: Tags without an end.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
BLOCK = r"(?is)<(h[1-6]|p|li)(?:\s[^>]*)?>(.*?)</(?:h[1-6]|p|li)>"


def without_scripts(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<script\b[^>]*>.*?</script\s*>", ""), r"(?is)<style\b[^>]*>.*?</style\s*>", "")


def title(html: Column) -> Column:
    """The document title's heading, a citation title, or the title element."""
    found = [F.regexp_extract(html, p, 1) for p in (r'(?is)<h1[^>]*ltx_title_document[^>]*>(.*?)</h1>', r'(?is)<meta name="citation_title" content="([^"]*)"', r"(?is)<title>(.*?)</title>")]
    return F.coalesce(*[F.nullif(plain(x), F.lit("")) for x in found], F.lit(""))


def unescape(c: Column) -> Column:
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(sign))
    return c


def plain(html: Column) -> Column:
    """Text without scripts, styles and tags, basic references decoded, blanks squeezed."""
    return squeezed(unescape(F.regexp_replace(without_scripts(html), "<[^>]*>", " ")))


def blocks(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, ord, tag, text) of headings, paragraphs and items in page order."""
    parts = pages.select(id_col, F.posexplode(F.regexp_extract_all(without_scripts(F.col(html_col)), F.lit(BLOCK), F.lit(0))).alias("ord", "raw"))
    tag = F.lower(F.regexp_extract("raw", BLOCK, 1))
    return parts.select(id_col, F.col("ord").cast("long").alias("ord"), tag.alias("tag"), squeezed(unescape(F.regexp_replace(F.regexp_extract("raw", BLOCK, 2), "<[^>]*>", " "))).alias("text"))


def tag_balance(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, tag, balance): starts less ends of each tag where they differ, tags without an end aside."""
    tags = pages.select(id_col, F.explode(F.regexp_extract_all(without_scripts(F.col(html_col)), F.lit(TAG), F.lit(0))).alias("raw"))
    name = F.lower(F.regexp_extract("raw", TAG, 2))
    step = F.when(F.col("raw").startswith("</"), -1).when(F.col("raw").endswith("/>"), 0).otherwise(1)
    counted = tags.select(id_col, name.alias("tag"), step.alias("step")).where(~F.col("tag").isin(VOID))
    return counted.groupBy(id_col, "tag").agg(F.sum("step").alias("balance")).where("balance <> 0")


def depth_match(pages: DataFrame, id_col: str, html_col: str, tag: str) -> DataFrame:
    """(id, opened, closed, depth) of each element of a tag, by numbers of its start and end among the tag's marks.

    Depth is a running sum; an end closes the latest start of its depth, so starts and ends pair by their place within a depth.
    """
    marks = pages.select(id_col, F.posexplode(F.regexp_extract_all(F.col(html_col), F.lit(f"(?i)<(/?){tag}\\b[^>]*>"), F.lit(1))).alias("n", "slash"))
    order = Window.partitionBy(id_col).orderBy("n")
    level = F.sum(F.when(F.col("slash") == "/", -1).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    deep = marks.select(id_col, "n", "slash", (level + F.when(F.col("slash") == "/", 1).otherwise(0)).alias("depth")).where("depth > 0")
    within = Window.partitionBy(id_col, "depth").orderBy("n")
    paired = deep.withColumns({"closed": F.lead("n").over(within), "shut": F.lead("slash").over(within)})
    return paired.where("slash = '' and shut = '/'").select(id_col, F.col("n").cast("long").alias("opened"), F.col("closed").cast("long").alias("closed"), "depth")


#: The forms of a paper's number, of today and before 2007, and its version.
NUMBERS, VERSION = ("[0-9]{4}\\.[0-9]{4,5}", "[a-z-]+(?:\\.[A-Z]{2})?/[0-9]{7}"), "(v[0-9]+)?"


def paper_ref(c: Column) -> Column:
    """The id alone."""
    return paper_ref_parts(c)["id"]


def paper_ref_parts(c: Column) -> Column:
    """(id, version) out of a paper's id or address; version empty if none is given, null if there is no id. An address is looked for first, then an old number, then one of today."""
    today, old = NUMBERS
    forms = [rf"arxiv\.org/(?:abs|pdf|html)/({today}){VERSION}", f"({old}){VERSION}", f"({today}){VERSION}"]
    found = [F.when(c.rlike(p), F.struct(F.regexp_extract(c, p, 1).alias("id"), F.regexp_extract(c, p, 2).alias("version"))) for p in forms]
    return F.coalesce(*found)


def math_to_text(fragment: Column) -> Column:
    """math elements become their alternative text between inline or display signs."""
    display = F.regexp_replace(fragment, r'(?is)<math[^>]*alttext="([^"]*)"[^>]*display="block"[^>]*>.*?</math>', r"\\[$1\\]")
    return F.regexp_replace(display, r'(?is)<math[^>]*alttext="([^"]*)"[^>]*>.*?</math>', r"\\($1\\)")
