"""Translation by chunks: prompts made of a chunk, what stands around it, seams and the terms it uses; tables by grid.

A paper's blocks are brought together once, in order; chunks, contexts and seams are read from that array, so that one
exchange by paper makes all its prompts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.functions.models import TextModel, answers
from foliant.functions.multisets import bound
from foliant.operators.sequence import FURNITURE, PROSE
from foliant.operators.validate import fit_grid, grid_shape
from foliant.session import written

#: Words that both halves of a sentence cut by a seam have at least; signs shown on both sides of the cut.
FIRST_HALF, SECOND_HALF, SHOWN = 6, 3, 40
GRID = "struct<caption:string,rows:array<array<string>>>"


def ordered(blocks: DataFrame) -> DataFrame:
    """(paper_id, b): each paper's blocks (ord, id, type, en) in order, with seam, whether the sentence goes on in the next block of the flow."""
    held = F.array_sort(F.collect_list(F.struct("ord", "id", "type", F.coalesce("en", F.lit("")).alias("en"))))
    whole = blocks.groupBy("paper_id").agg(held.alias("b"))
    count = lambda c: F.size(F.regexp_extract_all(c, F.lit(r"[^\s]+"), F.lit(0)))

    def seamed(flow: Column) -> Column:
        def goes_on(x: Column, k: Column) -> Column:
            y = F.get(flow, k + 1)
            return F.coalesce(x["type"].isin(*PROSE) & y["type"].isin(*PROSE) & (count(x["en"]) >= FIRST_HALF) & (count(y["en"]) >= SECOND_HALF) & T.continues(x["en"], y["en"]), F.lit(False))

        return F.transform(flow, lambda x, k: F.struct(*[x[c].alias(c) for c in ("ord", "id", "type", "en")], goes_on(x, k).alias("seam")))

    flow = F.filter("b", lambda x: ~x["type"].isin(*FURNITURE))
    return whole.select("paper_id", "b", bound(flow, seamed).alias("flow"))


def chunks(blocks: DataFrame, most: int = 12, most_chars: int = 6000) -> DataFrame:
    """(paper_id, flow, chunk, parts): runs of the flow within both limits; a seam is never cut, and the first block of a chunk always fits."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("chars"), F.lit(False).alias("open"), F.array().cast("array<int>").alias("starts"))

    def step(a: Column, x: Column) -> Column:
        size = F.length(x["en"])
        cut = (a["n"] > 0) & ~a["open"] & ((a["n"] >= most) | (a["chars"] + size > most_chars))
        fresh = cut | (F.size(a["starts"]) == 0)
        at = F.when(F.size(a["starts"]) == 0, 0).otherwise(F.element_at(a["starts"], -1) + a["n"])
        return F.struct(F.when(fresh, 1).otherwise(a["n"] + 1).alias("n"), F.when(fresh, size).otherwise(a["chars"] + size).alias("chars"), x["seam"].alias("open"), F.when(fresh, F.concat(a["starts"], F.array(at))).otherwise(a["starts"]).alias("starts"))

    cut = ordered(blocks).withColumn("starts", F.aggregate("flow", zero, step, lambda a: a["starts"]))
    each = cut.select("paper_id", "flow", "starts", F.posexplode("starts").alias("chunk", "from"))
    to = F.coalesce(F.get("starts", F.col("chunk") + 1), F.size("flow"))
    return each.select("paper_id", "flow", "chunk", "from", to.alias("to"), F.slice("flow", F.col("from") + 1, to - F.col("from")).alias("parts"))


def terms_used(text: Column, glossary: Column) -> Column:
    """The terms (en, zh) of a glossary that a text uses, longest first; one that stands only inside longer ones isn't used."""
    sized = F.array_sort(F.transform(glossary, lambda g: F.struct((-F.length(g["en"])).alias("n"), g["en"].alias("en"), g["zh"].alias("zh"))))
    zero = F.struct(F.lower(text).alias("rest"), F.array().cast("array<struct<en:string,zh:string>>").alias("used"))

    def step(a: Column, g: Column) -> Column:
        term = F.lower(g["en"])
        hit = (term != "") & a["rest"].contains(term)
        return F.struct(F.when(hit, F.replace(a["rest"], term, F.lit("\u0001"))).otherwise(a["rest"]).alias("rest"), F.when(hit, F.concat(a["used"], F.array(F.struct(g["en"].alias("en"), g["zh"].alias("zh"))))).otherwise(a["used"]).alias("used"))

    return F.aggregate(sized, zero, step, lambda a: a["used"])


def prompts(blocks: DataFrame, glossary: DataFrame, around: int = 2, most: int = 12, most_chars: int = 6000) -> DataFrame:
    """(paper_id, chunk, ids, prompt) of each chunk of blocks; glossary: (paper_id, terms), terms an array of (en, zh)."""
    line = lambda x: F.concat(x["id"], F.lit(": "), x["en"])
    both = chunks(blocks, most, most_chars).join(glossary, "paper_id", "left")
    text = F.array_join(F.transform("parts", lambda x: x["en"]), "\n")
    terms = F.transform(terms_used(text, F.coalesce("terms", F.array().cast("array<struct<en:string,zh:string>>"))), lambda g: F.concat(g["en"], F.lit(" = "), g["zh"]))
    first = F.greatest(F.col("from") - around, F.lit(0))
    before = F.slice("flow", first + 1, F.col("from") - first)
    after = F.slice("flow", F.col("to") + 1, F.lit(around))
    # seams that touch the chunk: the block before it, and its own but for the last if nothing follows
    reach = F.slice("flow", F.greatest(F.col("from"), F.lit(1)), F.col("to") - F.greatest(F.col("from"), F.lit(1)) + 1)
    shown = lambda x, y: F.concat(x["id"], F.lit(" goes on in "), y["id"], F.lit(": …"), F.substring(x["en"], -SHOWN, SHOWN), F.lit(" | "), F.substring(y["en"], 1, SHOWN), F.lit("…"))
    place = F.greatest(F.col("from"), F.lit(1)) - 1
    seams = F.filter(F.transform(reach, lambda x, k: F.when(x["seam"], shown(x, F.get("flow", place + k + 1)))), lambda s: s.isNotNull())
    section = lambda title, lines: F.when(F.size(lines) > 0, F.concat(F.lit(f"{title}\n"), F.array_join(lines, "\n")))
    parts = [section("Terms", terms), section("Before, not to be translated", F.transform(before, line)), section("Sentences cut in two", seams), section("To be translated", F.transform("parts", line)), section("After, not to be translated", F.transform(after, line))]
    return both.select("paper_id", "chunk", F.transform("parts", lambda x: x["id"]).alias("ids"), F.concat_ws("\n\n", *parts).alias("prompt"))


def grid_prompt(rows: Column, caption: Column) -> Column:
    return F.to_json(F.struct(F.coalesce(caption, F.lit("")).alias("caption"), rows.alias("rows")))


def grids_translated(tables: DataFrame, model: TextModel, retries: int = 1, write: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """tables (…, rows, caption) with rows_zh, caption_zh and state: a grid of the same shape, short rows padded, or refused and up for review.

    Each try is written before it is judged, and only what failed is tried again.
    """
    todo, done = tables, None
    for attempt in range(retries + 1):
        asked = answers(todo.withColumn("_prompt", grid_prompt(F.col("rows"), F.col("caption"))), "_prompt", model)
        tried = write(asked.drop("_prompt"), "grids").withColumn("_got", F.from_json(T.first_json_object(F.col("answer")), GRID))
        shape = grid_shape(F.col("rows"))
        fitted = F.when(shape.isNotNull(), fit_grid(F.col("_got.rows"), shape["rows"], shape["columns"]))
        judged = tried.withColumn("_zh", fitted)
        ok, last = F.col("_zh").isNotNull(), attempt == retries
        out = (judged if last else judged.where(ok)).select(*tables.columns, F.col("_zh").alias("rows_zh"), F.when(ok, F.nullif(F.trim("_got.caption"), F.lit(""))).alias("caption_zh"), F.when(ok, "mt").otherwise("needs_review").alias("state"), F.lit(attempt + 1).alias("tries"))
        done = out if done is None else done.unionByName(out)
        todo = judged.where(~ok).select(*tables.columns)
    return done
