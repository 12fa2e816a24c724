"""Rebuilding of stored reference lists and notes in place: fragments become entries, blocks take the shape of a fresh parse, anchors move along.

A list's fragments form one stream for each stretch between other blocks; page furniture does not end a stretch. The
stream is cut into entries, each squeezed, and an anchor goes through the maps fragment -> stream -> entry, with a
translated title's shift for the translated side. Joins are by key alone: a place is looked up in the sorted starts that
lie in its fragment, which come with the fragment.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.functions.matching import title_span_column
from foliant.operators.intervals import remap_blank
from foliant.operators.offsets import squeezed, squeezed_range
from foliant.operators.references import LONGEST, entry_starts
from foliant.session import give_back, ship, written

STRETCH = ["paper_id", "stretch"]
BLOCK = ["id", "type", "page", "band", "en"]
ROW = [*BLOCK, "ord", "role", "joint", "base"]
LAST_PAGE = 2**62


def placed(blocks: DataFrame) -> DataFrame:
    """blocks (paper_id, ord, id, type, page, band, en) with stretch and role (fragment, furniture between fragments, other), top, the paper's highest number of an id, and for fragments with text the joint before them and their base in the stretch's stream."""
    listed = F.coalesce(F.col("type") == "refs", F.lit(False))
    fragment = listed & F.col("band").isNull()
    so_far = (Window.unboundedPreceding, Window.currentRow)
    number = F.when(F.col("id").rlike("^b-[0-9]+$"), F.substring("id", 3, 18).cast("long"))
    cut = blocks.withColumns({"stretch": F.sum((~listed).cast("int")).over(Window.partitionBy("paper_id").orderBy("ord").rowsBetween(*so_far)), "top": F.coalesce(F.max(number).over(Window.partitionBy("paper_id")), F.lit(0))})
    within = Window.partitionBy(*STRETCH).orderBy("ord")
    begun = F.coalesce(F.max(fragment).over(within.rowsBetween(*so_far)), F.lit(False))
    held = fragment & (F.col("en") != "")
    before = F.last(F.when(held, F.substring("en", -1, 1)), ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, -1))
    bare = before.isNull() | before.rlike(r"\s") | F.col("en").rlike(r"^\s") | ((before == "-") & F.col("en").rlike(r"^\p{L}"))
    roles = cut.withColumns({"role": F.when(fragment, "fragment").when(listed & begun, "furniture").otherwise("other"), "joint": F.when(held, F.when(bare, "").otherwise(" "))})
    upto = F.sum(F.length("joint") + F.length("en")).over(within.rowsBetween(*so_far))
    return roles.withColumn("base", F.when(F.col("joint").isNotNull(), upto - F.length("en")).cast("int"))


FOUND = pa.struct([(name, pa.list_(pa.int32())) for name in ("starts", "held", "before")])


def _found(streams: pa.Array, bases: pa.Array) -> pa.Array:
    """The starts of each stream's entries; how many parts begin up to the stream's begin and each start; how many starts lie up to each part's base.

    Streams leave their batch one at a time, so that a worker holds little besides it.
    """
    out = []
    for stream, own in zip(streams, bases, strict=True):
        starts, at = entry_starts(stream.as_py()), own.as_py()
        ordered = sorted(at)
        out.append({"starts": starts, "held": [bisect_right(ordered, s) for s in (0, *starts)], "before": [bisect_right(starts, b) for b in at]} if starts else {"starts": []})
    done = pa.array(out, FOUND)
    give_back()
    return done


def stretches(blocks: DataFrame) -> DataFrame:
    """(paper_id, stretch, rows, parts, stream, starts, held, before, head, first): a row for each stretch with its blocks in order and its stream.

    starts is null where the stream has no sound entries; held and before tell starts and parts apart, as _found() does;
    head is the place of the first fragment, and first the number of the paper's next new id. Rows are dealt by paper
    twice: before the streams are formed, unless they are so already, and again after Python has read them, since that
    forgets how rows are dealt; all else keeps to that partitioning.
    """
    spark = blocks.sparkSession
    ship(spark)
    rows = F.array_sort(F.collect_list(F.struct("ord", *[c for c in ROW if c != "ord"])))
    whole = _streamed(placed(blocks).groupBy(*STRETCH, "top").agg(rows.alias("rows")))
    read = F.arrow_udf(_found, "starts array<int>, held array<int>, before array<int>")
    found = whole.withColumn("found", read("stream", F.transform("parts", lambda x: x["base"]))).select("*", "found.*")
    long = lambda x: (x["to"] - x["from"] > LONGEST) & (F.length(squeezed(_raw(x))) > LONGEST)
    sound = (F.size("starts") > 1) & ~F.exists(_cuts(), long)
    head = F.array_min(F.transform(F.filter("rows", lambda x: x["role"] == "fragment"), lambda x: x["ord"]))
    kept = found.select(*STRETCH, "top", "rows", F.when(sound, F.col("starts")).alias("starts"), "held", "before", head.alias("head"))  # the text moves once, in rows
    dealt = kept.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "paper_id")
    earlier = F.coalesce(F.sum(F.when(F.col("starts").isNotNull(), F.size("starts"))).over(Window.partitionBy("paper_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return _streamed(dealt.withColumn("first", F.col("top") + earlier + 1).drop("top"))


def _streamed(whole: DataFrame) -> DataFrame:
    """whole with parts, the fragments with text, and stream, their text joined."""
    named = whole.withColumn("parts", F.filter("rows", lambda x: x["base"].isNotNull()))
    return named.withColumn("stream", F.array_join(F.transform("parts", lambda x: F.concat(x["joint"], x["en"])), ""))


def _cuts() -> Column:
    """The places [from, to) of the entries, that of what stands before them first."""
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.length("stream")))
    lead = F.array(F.struct(F.lit(0).alias("from"), F.get("starts", F.lit(0)).alias("to")))
    return F.concat(lead, F.zip_with("starts", ends, lambda a, b: F.struct(a.alias("from"), b.alias("to"))))


def _raw(cut: Column) -> Column:
    return F.substring(F.col("stream"), cut["from"] + 1, cut["to"] - cut["from"])


def _led() -> Column:
    """Whether something stands before the first entry."""
    return F.substring(F.col("stream"), F.lit(1), F.get("starts", F.lit(0))).rlike(r"\S")


def _new_id(n: Column) -> Column:
    return F.when(n == 0, F.get("parts", F.lit(0))["id"]).otherwise(T.block_id(F.col("first") + n - 1))


def zh_range(en: Column, zh: Column, title: Column, title_zh: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """A range of an entry on its translation, where only the title is another: places behind the title shift, those inside go to its beginning."""
    span = title_span_column(en, title)
    stop = F.substring(en, span["end"].cast("int"), F.lit(1)).isin(".", "。").cast("int")
    shift = F.length(title_zh) + stop - (span["end"] - span["start"])
    put = lambda p: F.when(p <= span["start"], p).when(p >= span["end"], F.least(p + shift, F.length(zh))).otherwise(span["start"])
    other = (F.trim(F.coalesce(zh, F.lit(""))) != "") & span["start"].isNotNull()
    low, high = put(start), put(end)
    return F.when(other, low).otherwise(start).cast("long"), F.when(other, F.greatest(low, high)).otherwise(end).cast("long")


class Rebuild:
    """The rebuilding of all reference lists of blocks. A second rebuilding changes nothing."""

    def __init__(self, blocks: DataFrame) -> None:
        self.whole = stretches(blocks)
        self._told: DataFrame | None = None

    @property
    def told(self) -> DataFrame:
        """Every stretch, written once: its blocks counted by what they are and become, and what anchors move through where it was cut into entries."""
        if self._told is None:
            sound = F.col("starts").isNotNull()
            count = lambda kind: F.size(F.filter("rows", kind))
            refs = count(lambda x: x["type"] == "refs")
            left = F.when(sound, count(lambda x: (x["type"] == "refs") & (x["role"] != "fragment")) + _led().cast("int")).otherwise(refs)
            entries = count(lambda x: x["type"] == "ref") + F.when(sound, F.size("starts")).otherwise(0)
            upto = lambda i: F.coalesce(F.get("before", i + 1), F.size("starts"))
            part = lambda x, i: F.struct(x["id"].alias("id"), x["base"].alias("base"), F.length(x["en"]).alias("size"), F.get("before", i).alias("before"), upto(i).alias("upto"))
            kept = [F.when(sound, c).alias(n) for n, c in (("parts", F.transform("parts", part)), ("stream", F.col("stream")))]
            self._told = written(self.whole.select(*STRETCH, *kept, "starts", "first", refs.alias("refs"), entries.alias("entries"), left.alias("refs_left")), "streams")
        return self._told

    @property
    def lists(self) -> DataFrame:
        """The stretches that were cut into entries: what anchors move through."""
        return self.told.where("starts is not null").select(*STRETCH, "parts", "stream", "starts", "first")

    def after(self) -> DataFrame:
        """(paper_id, place, id, type, page, band, en): the blocks, numbered by paper.

        Entries have new ids that go on from the paper's highest, and the page of the fragment they begin in; what stands
        before the first stays a block under its fragment's id. Furniture goes by its page: a header before the page's
        first entry, anything else behind its last. Stretches without sound entries stay as they were.
        """
        sound = F.col("starts").isNotNull()

        def old(x: Column) -> Column:
            among = sound & (x["role"] == "furniture")
            place = lambda c, otherwise: F.when(among, c).otherwise(otherwise).cast("long")
            side = F.when(x["band"] == "head", 0).otherwise(2)
            return F.struct(place(F.col("head"), x["ord"]).alias("at"), place(F.coalesce(x["page"], F.lit(LAST_PAGE)), F.lit(0)).alias("by"), place(side, F.lit(0)).alias("side"), x["ord"].cast("long").alias("sub"), *[x[c].alias(c) for c in BLOCK])

        def new(cut: Column, n: Column) -> Column:
            page = F.get("parts", F.greatest(F.get("held", n) - 1, F.lit(0)))["page"]
            kind = F.when(n == 0, "refs").otherwise("ref")
            return F.struct(F.col("head").cast("long").alias("at"), F.lit(None).cast("long").alias("by"), F.lit(1).cast("long").alias("side"), n.cast("long").alias("sub"), _new_id(n).alias("id"), kind.alias("type"), page.alias("page"), F.lit(None).cast("string").alias("band"), squeezed(_raw(cut)).alias("en"))

        kept = F.transform(F.filter("rows", lambda x: ~(sound & (x["role"] == "fragment"))), old)
        made = F.when(sound, F.filter(F.transform(_cuts(), new), lambda x: x["en"] != "")).otherwise(F.filter(kept, lambda x: F.lit(False)))
        each = self.whole.select(*STRETCH, F.inline(F.concat(kept, made)))
        # an entry's page is never before that of the one ahead of it
        reached = F.max(F.when(F.col("side") == 1, F.col("page"))).over(Window.partitionBy(*STRETCH).orderBy("side", "sub").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        by = F.when(F.col("by").isNull(), F.coalesce(reached, F.lit(0)).cast("long")).otherwise(F.col("by"))
        order = Window.partitionBy("paper_id").orderBy("at", "_by", "side", "sub")
        return each.withColumn("_by", by).withColumn("place", F.row_number().over(order)).select("paper_id", "place", *BLOCK)

    def entries(self) -> DataFrame:
        """(paper_id, stretch, n, new_id, from, to, raw): the new blocks and their stretch of the stream."""
        each = self.lists.select("*", F.posexplode(_cuts()).alias("n", "cut"))
        return each.select(*STRETCH, "n", _new_id(F.col("n")).alias("new_id"), "cut.from", "cut.to", _raw(F.col("cut")).alias("raw")).where(F.col("raw").rlike(r"\S"))

    def moves(self) -> DataFrame:
        """(paper_id, block_id, stretch, base, size, before, starts, led) of each fragment that became part of entries.

        starts: those within the fragment, behind its first sign; before: how many lie ahead of them; led: something stands
        before the list's first.
        """
        each = self.lists.select(*STRETCH, "starts", _led().alias("led"), F.explode("parts").alias("p"))
        within = F.slice("starts", F.col("p.before") + 1, F.greatest(F.col("p.upto") - F.col("p.before"), F.lit(0)))
        return each.select(*STRETCH, F.col("p.id").alias("block_id"), "p.base", "p.size", "p.before", within.alias("starts"), "led")

    def anchors(self, anchors: DataFrame, titles: DataFrame | None = None) -> DataFrame:
        """(paper_id, id, block_id, lang, start, end, moved) of anchors afterwards: those of merged fragments on their entries, all others as they were.

        An anchor goes to the entry in which it starts, held to it and to its fragment; one without a range goes with its fragment's beginning.
        titles: (paper_id, id, zh, title_en, title_zh) of translated entries.
        """
        own = anchors.join(self.moves(), ["paper_id", "block_id"], "left")
        point = F.col("base") + F.least(F.greatest(F.coalesce("start", F.lit(0)), F.lit(0)), F.col("size") - 1)
        nth = F.col("before") + F.size(F.filter("starts", lambda s: s <= point))
        placed_ = own.withColumn("n", F.when((nth == 0) & ~F.col("led"), 1).otherwise(nth))  # a blank lead is no block
        target = self.entries().withColumns({"en": squeezed(F.col("raw")), "flat": F.length(squeezed(F.col("raw")))})
        both = placed_.join(target, [*STRETCH, "n"], "left")
        start = F.least(F.greatest(F.col("base") + F.col("start"), F.col("from")), F.col("to") - 1)
        end = F.least(F.greatest(F.col("base") + F.col("end"), start + 1), F.col("to"))
        both = both.withColumns({"_low": (start - F.col("from")).cast("int"), "_high": (end - F.col("from")).cast("int")})
        low, high = squeezed_range(F.col("raw"), F.col("flat"), F.col("_low"), F.col("_high"))
        both = both.withColumns({"_low": low.cast("long"), "_high": high.cast("long")})
        if titles is not None:
            told = titles.select("paper_id", F.col("id").alias("new_id"), "zh", "title_en", "title_zh")
            both = both.join(told, ["paper_id", "new_id"], "left")
            zlow, zhigh = zh_range(F.col("en"), F.col("zh"), F.col("title_en"), F.col("title_zh"), F.col("_low"), F.col("_high"))
            both = both.withColumns({"_low": F.when(F.col("lang") == "zh", zlow).otherwise(F.col("_low")), "_high": F.when(F.col("lang") == "zh", zhigh).otherwise(F.col("_high"))})
        there, ranged = F.col("new_id").isNotNull(), F.col("start").isNotNull() & F.col("end").isNotNull()
        at = lambda new, old: F.when(there & ranged, F.col(new)).otherwise(F.col(old)).cast("long")
        return both.select("paper_id", "id", F.coalesce("new_id", "block_id").alias("block_id"), "lang", at("_low", "start").alias("start"), at("_high", "end").alias("end"), there.alias("moved"))

    def report(self, anchors: DataFrame) -> DataFrame:
        """(paper_id, changed, refs, entries, refs_left, anchors_moved) of each paper. Every fragment of a list has an entry to go to, so an anchor moves where its fragment does."""
        sums = self.told.groupBy("paper_id").agg(F.bool_or(F.col("starts").isNotNull()).alias("changed"), *[F.sum(c).alias(c) for c in ("refs", "entries", "refs_left")])
        own = self.told.where("starts is not null").select("paper_id", F.explode("parts.id").alias("block_id"))
        moved = anchors.select("paper_id", "block_id").join(own, ["paper_id", "block_id"]).groupBy("paper_id").agg(F.count(F.lit(1)).alias("anchors_moved"))
        return sums.join(moved, "paper_id", "left").select("paper_id", "changed", "refs", "entries", "refs_left", F.coalesce("anchors_moved", F.lit(0)).alias("anchors_moved"))


# notes


def notes_rebuilt(stored: DataFrame, fresh: DataFrame, translated: DataFrame) -> DataFrame:
    """Stored blocks (paper_id, id, page, en, zh, zh_source, needs_review) after a fresh parse's notes (paper_id, id, page, en, note), with fate and note.

    One full outer join on page and text, blanks aside, decides: a stored block that meets exactly one fresh note of
    another spacing is restamped, with its text and note; one that meets several, or shares its text, is kept as
    ambiguous; a fresh note that meets none is a row of its own, missing, under its fresh id; all others are kept.
    translated: (paper_id, id, text, bad), new translations by stored id; text by hand stays. A restamped block that was
    translated well is no longer up for review; one translated badly, or left without a translation, is.
    """
    key = ["paper_id", "page", "_tight"]
    tight = F.sha2(T.tight(F.coalesce("en", F.lit(""))), 256)
    one_of = lambda df: df.withColumn("_tight", tight).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*key)))
    old = one_of(stored).withColumnRenamed("_n", "_stored")
    new = fresh.withColumn("_tight", tight).groupBy(*key).agg(F.count(F.lit(1)).alias("_fresh"), F.min(F.struct("id", "en", "note")).alias("_new"))
    both = old.join(new, key, "full")
    alone = (F.col("_stored") == 1) & (F.col("_fresh") == 1)
    fate = F.when(F.col("id").isNull(), "missing").when(F.col("_fresh").isNull(), "kept").when(~alone, "ambiguous").when(F.col("en") == F.col("_new.en"), "kept").otherwise("restamped")
    judged = both.withColumn("fate", fate).join(translated.select("paper_id", "id", F.col("text").alias("_text"), F.coalesce("bad", F.lit(False)).alias("_bad")), ["paper_id", "id"], "left")
    restamped = F.col("fate") == "restamped"
    got = restamped & (F.col("zh_source") != "human") & (F.trim(F.coalesce("_text", F.lit(""))) != "")
    zh = F.when(got, F.col("_text")).otherwise(F.col("zh"))
    source = F.when(got, F.when(T.expects_translation(F.col("_new.en"), F.lit("p")), "mt").otherwise("none")).otherwise(F.col("zh_source"))
    empty = F.trim(F.coalesce("zh", F.lit(""))) == ""
    review = F.when(restamped, F.when(got, F.col("_bad")).otherwise(F.when(empty, True).otherwise(F.col("needs_review")))).otherwise(F.col("needs_review"))
    own = lambda c: F.when(F.col("fate") == "missing", F.col(f"_new.{c}"))
    return judged.select(
        "paper_id", F.coalesce(F.col("id"), own("id")).alias("id"), "page", F.when(restamped, F.col("_new.en")).otherwise(F.coalesce(F.col("en"), own("en"))).alias("en"), zh.alias("zh"), source.alias("zh_source"),
        F.coalesce(review, F.lit(False)).alias("needs_review"), F.when(restamped | (F.col("fate") == "missing"), F.col("_new.note")).alias("note"), F.col("en").alias("old_en"), got.alias("retranslated"), "fate",
    )


def note_anchors(anchors: DataFrame, after: DataFrame) -> DataFrame:
    """Anchors (paper_id, id, block_id, lang, start, end) after notes_rebuilt(): kept, moved through the new spacing, or removed.

    Where only blanks changed, a range on the original stands on the same signs; one of blanks alone is removed. A new
    translation has no signs in common with the old one, so ranges on it are removed.
    """
    shaped = after.where("fate = 'restamped'").select("paper_id", F.col("id").alias("block_id"), F.col("old_en"), F.col("en").alias("new_en"), "retranslated")
    both = anchors.join(shaped, ["paper_id", "block_id"], "left")
    to = remap_blank(F.col("old_en"), F.col("new_en"), F.col("start").cast("int"), F.col("end").cast("int"))
    both = both.withColumn("_to", F.when(F.col("lang") == "en", to))
    fate = F.when(F.col("new_en").isNull() | F.col("start").isNull(), "kept").when(F.col("lang") == "en", F.when(F.col("_to").isNull(), "removed").otherwise("moved")).when(F.col("retranslated"), "removed").otherwise("kept")
    at = lambda side, own: F.when(F.col("fate") == "moved", F.col(f"_to.{side}")).when(F.col("fate") == "kept", F.col(own).cast("long"))
    return both.withColumn("fate", fate).select("paper_id", "id", "block_id", "lang", "fate", at("s", "start").alias("start"), at("e", "end").alias("end"))
