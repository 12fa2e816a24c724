"""Tools of a proofreading pass over blocks, as checks and tables: what may be split or reordered, what is left, what to translate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T

KEY = "paper_id"
PAGE = [KEY, "page"]


def participating(blocks: DataFrame) -> DataFrame:
    """Blocks that take part in a translation: all but figures with neither text nor caption."""
    filled = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    return blocks.where((F.col("type") != "figure") | filled("en") | filled("caption"))


def to_translate(blocks: DataFrame, only: DataFrame | None = None, resume: bool = False) -> DataFrame:
    """Participating blocks that want a translation and aren't a person's; of `only` (keys, id), or those without a text yet."""
    own = participating(blocks).where((F.coalesce("zh_source", F.lit("")) != "human") & T.expects_translation(F.col("en"), F.col("type")))
    if only is not None:
        return own.join(only.select(KEY, "id").distinct(), [KEY, "id"], "left_semi")
    return own.where(~F.coalesce(F.col("zh"), F.lit("")).rlike(r"\S")) if resume else own


def reorder_refused(wanted: DataFrame, blocks: DataFrame) -> DataFrame:
    """(paper_id, page, verdict) of wanted orders (paper_id, page, ids): refused unless they are a permutation of the page's ids."""
    have = blocks.groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("have"))
    joined = wanted.join(have, PAGE, "left")
    same = F.coalesce(F.array_sort("ids") == F.array_sort("have"), F.lit(False))
    return joined.select(*PAGE, F.when(~same, "refused").when(F.col("ids") == F.col("have"), "unchanged").otherwise("reordered").alias("verdict"))


def split_parts(parts: Column) -> Column:
    """The parts of a split, cleaned, without blank ones; null where fewer than two are left."""
    own = F.filter(F.transform(parts, lambda p: F.trim(T.clean_text(p))), lambda p: p != "")
    return F.when(F.size(own) >= 2, own)


def split_blocks(blocks: DataFrame, parts: DataFrame) -> DataFrame:
    """(paper_id, ord, part, text) of blocks where those with sound parts (paper_id, ord, parts) are cut; numbers stay in order."""
    cut = blocks.join(parts.select(KEY, "ord", split_parts(F.col("parts")).alias("_parts")), [KEY, "ord"], "left")
    return cut.select(KEY, "ord", F.posexplode(F.coalesce("_parts", F.array("en"))).alias("part", "text"))


def pages_left(blocks: DataFrame, done: DataFrame) -> DataFrame:
    """(paper_id, n_left, finished): a pass ends when none of a paper's pages is left."""
    pages = blocks.select(*PAGE).distinct().join(done.select(*PAGE, F.lit(1).alias("_done")).distinct(), PAGE, "left")
    counted = pages.groupBy(KEY).agg(F.count_if(F.col("_done").isNull()).alias("n_left"))
    return counted.withColumn("finished", F.col("n_left") == 0)


def type_counts(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy(KEY, "type").agg(F.count(F.lit(1)).alias("n"))


def page_of(page: Column) -> Column:
    """A page number; 0 where it is none."""
    return F.coalesce(page.try_cast("int"), F.lit(0))


def overview(blocks: DataFrame, suspect: Column) -> DataFrame:
    """(paper_id, page, n_blocks, n_chars, n_suspect) of each page."""
    return blocks.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(F.length("en")).cast("long").alias("n_chars"), F.count_if(suspect).alias("n_suspect"))


def titles(blocks: DataFrame, kind: str = "h1") -> DataFrame:
    """(paper_id, title, candidates): the first heading of a kind, and all of them in order."""
    own = blocks.where((F.col("type") == kind) & F.col("en").rlike(r"\S"))
    listed = own.groupBy(KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.trim("en").alias("t")))), lambda x: x["t"]).alias("candidates"))
    return listed.select(KEY, F.get("candidates", 0).alias("title"), "candidates")


def rule_side(payload: Column) -> Column:
    """below or above, from a plain string or from an object with a side; null otherwise."""
    side = F.coalesce(F.get_json_object(payload, "$.rule.side"), F.get_json_object(payload, "$.rule"))
    return F.when(side.isin("below", "above"), side)


def shade_color(payload: Column) -> Column:
    color = F.get_json_object(payload, "$.shade.color")
    return F.when(color.rlike("^#[0-9a-fA-F]{6}$"), color).otherwise("")


def note_em(payload: Column) -> Column:
    """The size of small print over that of the text: over 0.5 and at most 0.98, else 0."""
    em = F.get_json_object(payload, "$.note.em").try_cast("double")
    return F.when((em > 0.5) & (em <= 0.98), em).otherwise(0.0)


def note_markers(payload: Column) -> Column:
    """A letter or a number of two digits for each line of a note; empty where a line has none."""
    given = F.from_json(F.get_json_object(payload, "$.markers"), "array<string>")
    checked = F.transform(given, lambda m: F.when(m.rlike("^(?:[a-zA-Z]|[0-9]{1,2})$"), m).otherwise(""))
    return F.when(note_em(payload) > 0, F.coalesce(checked, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))


def band_blocks(lines: DataFrame, blocks: DataFrame, pad: float = 2.0) -> DataFrame:
    """(paper_id, page, id) of paragraphs whose lines lie in a band: lines (paper_id, page, n, text, y0, y1, top, bottom).

    Each line in the band belongs to the shortest paragraph of its page that holds its text, spaces and hyphens aside. Lines
    and paragraphs meet on their page alone.
    """
    inside = lines.where((F.col("y0") >= F.col("top") - pad) & (F.col("y1") <= F.col("bottom") + pad)).withColumn("_line", T.tight_index_text(F.col("text"))).where(F.length("_line") >= 3)
    own = blocks.where("type = 'p'").select(*PAGE, "ord", "id", F.length("en").alias("_n"), T.tight_index_text(F.col("en")).alias("_block"))
    hit = inside.join(own, PAGE).where(F.col("_block").contains(F.col("_line")))
    owner = hit.groupBy(*PAGE, "n").agg(F.min(F.struct("_n", "ord", "id")).alias("o"))
    return owner.select(*PAGE, F.col("o.id").alias("id")).distinct()


def assets(blocks: DataFrame, source: Column) -> DataFrame:
    """(paper_id, name): the distinct asset files that blocks name."""
    name = F.regexp_extract(source, "^assets/(.+)$", 1)
    return blocks.select(KEY, name.alias("name")).where("name <> ''").distinct()


def asset_bytes(named: DataFrame, files: DataFrame, most: int) -> DataFrame:
    """(paper_id, n, bytes, fits): how much the assets of a paper (files: name, bytes) would add to a page, and whether that may be."""
    return named.join(files, "name").groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).withColumn("fits", F.col("bytes") <= most)


def repointed(cache: DataFrame, folder: str, to: str) -> DataFrame:
    """cache (key, value) rows whose JSON value names a reclaimed folder, rewritten to another one; all other fields, and the other rows, as they are."""
    at = F.get_json_object("value", "$.dir")
    hit = F.col("value").contains(folder) & F.coalesce((at == folder) | at.startswith(f"{folder}/"), F.lit(False))
    new = F.parse_json(F.to_json(F.array(F.concat(F.lit(to), F.substring(at, F.lit(len(folder) + 1), F.length(at))))))
    fields = F.from_json("value", "map<string,variant>")
    moved = F.to_json(F.transform_values(fields, lambda k, v: F.when(k == "dir", F.variant_get(new, "$[0]", "variant")).otherwise(v)))
    return cache.withColumn("value", F.when(hit, moved).otherwise(F.col("value")))


def enqueue_verdict(action: Column, state: Column) -> Column:
    """Whether a conversion may be queued again (not while one runs), or a part of it rebuilt (only once it is done)."""
    return F.when((action == "convert") & ~state.isin("doing", "queued"), "queued").when((action != "convert") & (state == "done"), "queued").otherwise("conflict")
