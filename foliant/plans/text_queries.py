"""Queries of the text functions and the HTML source, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.session import table
from foliant.sources import html as H
from foliant.sources import views as V

#: Texts with what the functions look for; the same expression in both engines.
_B = "chr(92)"
DECORATED = f"""concat(text, CASE doc_id % 8
  WHEN 0 THEN concat(' vari- ous words, a x- ray {_B}(a = ', {_B}, 'text{{two words}} + b', {_B}, ') (12)')
  WHEN 1 THEN concat(' see [ 12 ] here . And I NTRODUCTION to S MALL caps  -  end [3].')
  WHEN 2 THEN concat(' x = y + 2 (7)')
  WHEN 3 THEN concat(' the sum ∑ of it', {_B}, '[ E = mc ', {_B}, 'tag{{ 4 }}', {_B}, '] done')
  WHEN 4 THEN concat(' ﬁnd eﬃcient soft­ness non‑plain')
  WHEN 5 THEN ' A & B < C > "quoted" <b>bold</b>'
  WHEN 6 THEN ' Smith, J., Proc. of X, vol. 3, pp. 1-2, 2019.'
  ELSE ' "Is it?" she said. "Yes!" (So.) 28.4 et al. end' END)""".replace(f"{_B}(a", f"', {_B}, '(a")
TAGS = "concat('#', source, ', b;', lang, '， #x、', source, ';;z,y')"
YEARS = "CASE doc_id % 4 WHEN 0 THEN CAST(1890 + doc_id % 300 AS VARCHAR(9)) WHEN 1 THEN concat('Proc. ', CAST(1990 + doc_id % 40 AS VARCHAR(9)), ' x') WHEN 2 THEN 'none' ELSE '12x1999' END"


def _docs(spark, sf, expr=DECORATED, name="t"):
    """A null has no part in what is put together."""
    docs = table(spark, sf, "documents")
    return docs.withColumns({c: F.coalesce(c, F.lit("")) for c in ("text", "lang", "source")}).select("doc_id", F.expr(expr).alias(name))


def _per_doc(f, name, expr=DECORATED):
    return lambda s, d: _docs(s, d, expr).select("doc_id", f(F.col("t")).alias(name))


def _pages(spark, sf):
    return table(spark, sf, "pages")


def sentence_split(s, d):
    return table(s, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("n", "sentence")).withColumn("n", F.col("n").cast("long"))


def sentence_offsets(s, d):
    cut = _docs(s, d).withColumn("parts", T.sentences(F.col("t")))
    return cut.select("doc_id", F.explode(T.sentence_offsets(F.col("parts"))).alias("o")).select("doc_id", "o.start", "o.end")


def math_flags(s, d):
    t = F.col("t")
    return _docs(s, d).select("doc_id", T.looks_math(t).alias("math"), T.caption_like(t).alias("caption"), T.reference_like(t).alias("reference"), T.numbered_reference(t).alias("numbered"))


def expects_translation(s, d):
    kind = F.when(F.col("doc_id") % 5 == 0, "refs").when(F.col("doc_id") % 5 == 1, "h2").otherwise("p")
    text = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("t", "[A-Za-zà-ÿÀ-Ý]{3,}", "12")).otherwise(F.col("t"))
    return _docs(s, d).select("doc_id", T.expects_translation(text, kind).alias("expected"))


def relative_time(s, d):
    p = V.papers(s, d)
    return p.select("paper_id", T.relative_day(F.col("created_at"), F.lit("2024-12-31").cast("date")).alias("label"))


def countdown(s, d):
    e = table(s, d, "events")
    return e.select("event_id", T.countdown(F.floor(F.col("value") * 1000)).alias("label"))


def html_outline(s, d):
    b = H.blocks(_pages(s, d), "page_id", "html").where("tag rlike '^h[1-3]$'")
    return b.select("page_id", "ord", F.least(F.lit(3), F.substring("tag", 2, 1).cast("int")).alias("level"), F.coalesce(F.nullif(F.regexp_extract("text", r"^([IVX]{1,6}\.|[0-9]+(?:\.[0-9]+)*\.?) ", 1), F.lit("")), F.lit("·")).alias("number"), "text")


def json_props(s, d):
    e = table(s, d, "events")
    return e.select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("k"), F.try_parse_json("props").isNotNull().alias("valid"))


QUERIES = {
    "clean_text": _per_doc(T.clean_text, "clean"),
    "desmallcaps": _per_doc(T.desmallcaps, "text"),
    "hyphen_join": _per_doc(T.join_hyphen_breaks, "text"),
    "sentence_split": sentence_split,
    "sentence_offsets": sentence_offsets,
    "math_flags": math_flags,
    "prose_core_words": _per_doc(lambda t: F.array_join(T.prose_core(t), " "), "words"),
    "prose_word_counts": _per_doc(lambda t: F.size(T.prose_words(t)).cast("long"), "n"),
    "artifact_flags": _per_doc(lambda t: F.array_join(T.artifacts(t), ","), "flags"),
    "tight_text": _per_doc(lambda t: F.concat_ws("|", T.tight(t), T.tight_index_text(t)), "tight"),
    "equation_numbers": _per_doc(lambda t: F.array_join(T.equation_numbers(t), ","), "numbers"),
    "expects_translation": expects_translation,
    "year_extract": lambda s, d: _docs(s, d, YEARS.replace("VARCHAR(9)", "STRING")).select("doc_id", T.year_of(F.col("t")).alias("year")),
    "tag_list_normalise": lambda s, d: _docs(s, d, TAGS).select("doc_id", F.array_join(T.tags_of(F.col("t")), "|").alias("tags")),
    "html_escape": _per_doc(T.escape, "html"),
    "fingerprint": lambda s, d: table(s, d, "documents").groupBy(T.fingerprint("parse-v17", F.col("text")).alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1"),
    "code_hash": lambda s, d: table(s, d, "customer").select("c_custkey", T.code_hash(F.concat(F.lit(" U"), F.col("c_custkey").cast("string"), F.lit("@X.org ")), F.lit("login"), (F.col("c_custkey") * 7919 % 1000000).cast("string")).alias("hash")),
    "relative_time": relative_time,
    "countdown": countdown,
    "clip_title": lambda s, d: table(s, d, "documents").select("doc_id", T.clipped(F.col("text"), 24).alias("clip"), T.line_count(F.col("text")).alias("lines")),
    "retry_waits": lambda s, d: table(s, d, "region").select("r_regionkey", T.retry_wait(F.col("r_regionkey") + 2).alias("seconds"), T.block_id(F.col("r_regionkey") * 900).alias("block_id")),
    "json_props": json_props,
    "html_title": lambda s, d: _pages(s, d).select("page_id", H.title(F.col("html")).alias("title")),
    "html_blocks": lambda s, d: H.blocks(_pages(s, d), "page_id", "html"),
    "html_plain_text": lambda s, d: _pages(s, d).select("page_id", F.sha2(H.plain(F.col("html")), 256).alias("sha")),
    "html_tag_balance": lambda s, d: H.tag_balance(_pages(s, d), "page_id", "html"),
    "html_outline": html_outline,
    "html_depth_match": lambda s, d: H.depth_match(_pages(s, d), "page_id", "html", "li"),
}

_D = f"WITH docs AS (SELECT doc_id, source, lang, {DECORATED} AS t FROM documents) "
_MATH = r"(?s)\\\(.*?\\\)|\\\[.*?\\\]"
_JOINED = "regexp_replace(regexp_replace(regexp_replace(t, '([A-Za-z])-[ \\t\\n\\r­]+([a-z])', '\\1\\2', 'g'), '([A-Za-z])-[ \\t\\n\\r­]+([a-z])', '\\1\\2', 'g'), '([A-Za-z])-[ \\t\\n\\r­]+([a-z])', '\\1\\2', 'g')"
_CAPS = "regexp_replace(regexp_replace(regexp_replace(t, '\\b([A-Z]) ([A-Z]{2,})', '\\1\\2', 'g'), '\\b([A-Z]) ([A-Z]{2,})', '\\1\\2', 'g'), '\\b([A-Z]) ([A-Z]{2,})', '\\1\\2', 'g')"


def _squeeze(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'), '^ | $', '', 'g')"


_CORE = f"list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace({_JOINED}, '{_MATH}', ' ', 'g'), '\\\\[A-Za-z]+[*]?', ' ', 'g'), '<(/?)([a-zA-Z][a-zA-Z0-9_-]*)([^>]*)>', ' ', 'g'), '[A-Za-z]{{3,}}'), lambda w: lower(w)), lambda w: w NOT IN ({', '.join(repr(w) for w in T.MATH_WORDS)}))"
_SENTENCES = "list_filter(string_split(regexp_replace({}, '([.!?][.!?\"''”’)\\]]*)(\\s|$)', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: regexp_matches(s, '\\S'))"
_NOSCRIPT = "regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>', '', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', '', 'g')"


def _unescape(x: str) -> str:
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{sign}')"
    return x


def _plain(x: str) -> str:
    return _squeeze(_unescape(f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"))


_RAW = "'(?is)<(h[1-6]|p|li)(?:\\s[^>]*)?>(.*?)</(?:h[1-6]|p|li)>'"
_HBLOCKS = f"""hblocks AS (SELECT page_id, ord, lower(regexp_extract(raw, {_RAW}, 1)) AS tag, {_plain(f"regexp_extract(raw, {_RAW}, 2)")} AS text FROM
  (SELECT page_id, unnest(range(0, len(l))) AS ord, unnest(l) AS raw FROM (SELECT page_id, regexp_extract_all({_NOSCRIPT}, {_RAW}, 0) AS l FROM pages)))"""
_TAGS_RE = "'<(/?)([a-zA-Z][a-zA-Z0-9_-]*)([^>]*)>'"

ORACLES = {
    "clean_text": _D + "SELECT doc_id, " + "replace(" * 7 + "translate(t, chr(8208) || chr(8209) || chr(160) || chr(8201) || chr(8239) || chr(173) || chr(8203), '--   ')" + "".join(f", '{g}', '{x}')" for g, x in T.LIGATURES.items()) + " AS clean FROM docs",
    "desmallcaps": _D + f"SELECT doc_id, {_squeeze(f"regexp_replace({_CAPS}, '\\s+-\\s*', '-', 'g')")} AS text FROM docs",
    "hyphen_join": _D + f"SELECT doc_id, {_JOINED} AS text FROM docs",
    "sentence_split": f"SELECT doc_id, unnest(range(0, len(l))) AS n, unnest(l) AS sentence FROM (SELECT doc_id, {_SENTENCES.format('text')} AS l FROM documents)",
    "sentence_offsets": _D + f"""SELECT doc_id, CAST(e - length(s) AS BIGINT) AS start, CAST(e AS BIGINT) AS "end" FROM (SELECT doc_id, s, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY n) AS e FROM
      (SELECT doc_id, unnest(range(0, len(l))) AS n, unnest(l) AS s FROM (SELECT doc_id, {_SENTENCES.format('t')} AS l FROM docs)))""",
    "math_flags": _D + f"""SELECT doc_id, regexp_matches(t, '[{T.MATH_CHARS}]') OR (regexp_matches(q, '\\(\\s*[0-9]{{1,2}}\\s*\\)$') AND n < 8) OR (contains(q, '=') AND n < 4 AND length(q) < 160) AS math,
      regexp_matches(lower(regexp_replace(t, '^\\s+', '')), '^(fig|figure|table|tab\\.|表|图)') AS caption, regexp_matches(t, '\\bpp\\.|\\bvol\\.|\\bProc\\.|IEEE Trans|\\bdoi:|arXiv:|,\\s*(?:19|20)[0-9]{{2}}\\b') AS reference, regexp_matches(t, '^\\s*\\[[0-9]{{1,3}}\\]') AS numbered
      FROM (SELECT *, {_squeeze('t')} AS q, len(regexp_extract_all(t, '[A-Za-z]{{3,}}')) AS n FROM docs)""",
    "prose_core_words": _D + f"SELECT doc_id, array_to_string({_CORE}, ' ') AS words FROM docs",
    "prose_word_counts": _D + f"""SELECT doc_id, CAST(len(regexp_extract_all(regexp_replace(regexp_replace({_JOINED}, '{_MATH}', ' ', 'g'), {_TAGS_RE}, ' ', 'g'), '[A-Za-z]{{4,}}'))
      + len(regexp_extract_all(array_to_string(regexp_extract_all(array_to_string(regexp_extract_all({_JOINED}, '{_MATH}'), ' '), '\\\\(?:text|mathrm|mbox|operatorname|textbf)\\s*\\{{([^{{}}]*)\\}}', 1), ' '), '[A-Za-z]{{4,}}')) AS BIGINT) AS n FROM docs""",
    "artifact_flags": _D + """SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(t, '\\b[A-Za-z]{2,}-\\s+[a-z]{2,}') THEN 'hyphen_break' END,
      CASE WHEN len(list_filter(regexp_extract_all(t, '\\[[^\\]\\n]{0,14}?\\]'), lambda x: regexp_matches(x, '^\\[\\s|\\s\\]$') AND regexp_matches(x, '[0-9]'))) > 0 THEN 'cite_blank' END,
      CASE WHEN regexp_matches(t, '[A-Za-z0-9_]\\s+\\.(?:\\s|$)') THEN 'blank_stop' END) AS flags FROM docs""",
    "tight_text": _D + "SELECT doc_id, regexp_replace(t, '\\s+', '', 'g') || '|' || lower(regexp_replace(t, '[\\s-]+', '', 'g')) AS tight FROM docs",
    "equation_numbers": _D + """SELECT doc_id, array_to_string(CASE WHEN len(a) > 0 THEN a ELSE b END, ',') AS numbers FROM
      (SELECT doc_id, regexp_extract_all(t, '\\\\tag\\s*\\{\\s*([^}]*?)\\s*\\}', 1) AS a, regexp_extract_all(t, '\\(\\s*([0-9]{1,2})\\s*\\)', 1) AS b FROM docs)""",
    "expects_translation": f"WITH docs AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(t, '[A-Za-zà-ÿÀ-Ý]{{3,}}', '12', 'g') ELSE t END AS t FROM (SELECT doc_id, {DECORATED} AS t FROM documents)) "
    + f"""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN false WHEN 1 THEN len({_CORE}) >= 1 ELSE len({_CORE}) >= 1 OR len(regexp_extract_all(array_to_string(regexp_extract_all(array_to_string(regexp_extract_all(t, '{_MATH}'), ' '), '\\\\(?:text|mathrm|mbox|operatorname|textbf)\\s*\\{{([^{{}}]*)\\}}', 1), ' '), '[A-Za-z]{{3,}}')) >= 2 END AS expected FROM docs""",
    "year_extract": f"SELECT doc_id, CASE WHEN TRY_CAST(t AS INTEGER) BETWEEN 1900 AND 2100 THEN TRY_CAST(t AS INTEGER) ELSE CAST(nullif(regexp_extract(t, '((?:19|20)[0-9]{{2}})', 1), '') AS INTEGER) END AS year FROM (SELECT doc_id, {YEARS} AS t FROM documents)",
    "tag_list_normalise": "SELECT doc_id, array_to_string(list_slice(list_filter([p for p in a if p <> ''], lambda x: true), 1, 5), '|') AS tags FROM (SELECT doc_id, [source, 'b', lang, 'x', 'z', 'y'] AS a FROM documents)",
    "html_escape": _D + "SELECT doc_id, replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html FROM docs",
    "fingerprint": "SELECT sha256('parse-v17' || text) AS fingerprint, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1",
    "code_hash": "SELECT c_custkey, sha256('u' || c_custkey || '@x.org|login|' || c_custkey * 7919 % 1000000) AS hash FROM customer",
    "relative_time": V.with_(V.PAPERS) + "SELECT paper_id, CASE WHEN d <= 0 THEN 'today' WHEN d = 1 THEN 'yesterday' WHEN d < 30 THEN d || ' days ago' WHEN d < 365 THEN d // 30 || ' months ago' ELSE d // 365 || ' years ago' END AS label FROM (SELECT paper_id, date_diff('day', CAST(created_at AS DATE), DATE '2024-12-31') AS d FROM papers)",
    "countdown": "SELECT event_id, printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) AS label FROM (SELECT event_id, greatest(CAST(floor(value * 1000) AS BIGINT), 0) AS s FROM events)",
    "clip_title": "SELECT doc_id, CASE WHEN length(text) > 24 THEN substr(text, 1, 24) || '…' ELSE text END AS clip, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines FROM documents",
    "retry_waits": "SELECT r_regionkey, least(pow(2, r_regionkey + 2), 30.0) AS seconds, printf('b-%04d', r_regionkey * 900) AS block_id FROM region",
    "json_props": "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k, json_valid(props) AS valid FROM events",
    "html_title": f"SELECT page_id, {_plain("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")} AS title FROM pages",
    "html_blocks": f"WITH {_HBLOCKS} SELECT * FROM hblocks",
    "html_plain_text": f"SELECT page_id, sha256({_plain(_NOSCRIPT)}) AS sha FROM pages",
    "html_tag_balance": f"""SELECT page_id, tag, CAST(sum(step) AS BIGINT) AS balance FROM (SELECT page_id, lower(regexp_extract(raw, {_TAGS_RE}, 2)) AS tag, CASE WHEN starts_with(raw, '</') THEN -1 WHEN suffix(raw, '/>') THEN 0 ELSE 1 END AS step
      FROM (SELECT page_id, unnest(regexp_extract_all({_NOSCRIPT}, {_TAGS_RE}, 0)) AS raw FROM pages)) WHERE tag NOT IN ({', '.join(repr(v) for v in H.VOID)}) GROUP BY page_id, tag HAVING sum(step) <> 0""",
    "html_outline": f"WITH {_HBLOCKS} SELECT page_id, ord, CAST(substr(tag, 2, 1) AS INTEGER) AS level, coalesce(nullif(regexp_extract(text, '^([IVX]{{1,6}}\\.|[0-9]+(?:\\.[0-9]+)*\\.?) ', 1), ''), '·') AS number, text FROM hblocks WHERE tag IN ('h1', 'h2', 'h3')",
    "html_depth_match": """WITH m AS (SELECT page_id, unnest(range(0, len(l))) AS n, unnest(l) AS slash FROM (SELECT page_id, regexp_extract_all(html, '(?i)<(/?)li\\b[^>]*>', 1) AS l FROM pages)),
      d AS (SELECT *, sum(CASE WHEN slash = '/' THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY n) + CASE WHEN slash = '/' THEN 1 ELSE 0 END AS depth FROM m),
      p AS (SELECT *, lead(n) OVER w AS closed, lead(slash) OVER w AS shut FROM d WHERE depth > 0 WINDOW w AS (PARTITION BY page_id, depth ORDER BY n))
      SELECT page_id, n AS opened, closed, CAST(depth AS BIGINT) AS depth FROM p WHERE slash = '' AND shut = '/'""",
}
