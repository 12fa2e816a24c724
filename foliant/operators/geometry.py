"""Page layout over boxes (paper_id, page, id, x0, y0, x1, y1): bands, columns, reading order, rules, shades, captions.

What folds over a page's boxes until nothing changes runs in Python, many pages to a batch; a page is bounded by its paper.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import continues
from foliant.operators.grouped import fold_groups

PAGE = ["paper_id", "page"]
WIDTH, HEIGHT = 612.0, 792.0


def edge_band(height: float = HEIGHT, share: float = 0.05) -> Column:
    return F.when(F.col("y0") <= height * share, "top").when(F.col("y1") >= height * (1 - share), "bottom")


def marginal(gutter: Column, width: float = WIDTH, height: float = HEIGHT) -> Column:
    """In an edge band, and narrow, very wide, or across the gutter."""
    w = F.col("x1") - F.col("x0")
    across = F.coalesce((F.col("x0") < gutter) & (gutter < F.col("x1")), F.lit(False))
    return edge_band(height).isNotNull() & ((w < width * 0.35) | (w > width * 0.7) | across)


def side(gutter: Column) -> Column:
    return F.when((F.col("x0") + F.col("x1")) / 2 < gutter, 0).otherwise(1)


def reading_order(boxes: DataFrame, gutter: Column, width: float = WIDTH, height: float = HEIGHT, full: float = 0.62) -> DataFrame:
    """place: edge boxes of the top, then runs of full-width boxes and of columns (left, then right), then the other edge boxes.

    Runs are islands in the order of y; within a run of columns, the left one is read to its end first.
    """
    y = F.bround("y0", 1)
    marked = boxes.withColumns({"edge": marginal(gutter, width, height), "y": y, "wide": (F.col("x1") - F.col("x0")) > width * full, "side": side(gutter), "top": F.coalesce(edge_band(height) == "top", F.lit(False))})
    by_y = Window.partitionBy(*PAGE, "edge").orderBy("y", "x0", "id")
    change = F.when(F.lag("wide").over(by_y) == F.col("wide"), 0).otherwise(1)
    runs = marked.withColumn("change", change).withColumn("run", F.sum("change").over(by_y.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    split = F.min("side").over(Window.partitionBy(*PAGE, "edge", "run")) != F.max("side").over(Window.partitionBy(*PAGE, "edge", "run"))
    keyed = runs.withColumns({"zone": F.when(~F.col("edge"), 1).when(F.col("top"), 0).otherwise(2), "column": F.when(~F.col("edge") & ~F.col("wide") & split, F.col("side")).otherwise(0)})
    order = Window.partitionBy(*PAGE).orderBy("zone", F.when(F.col("edge"), 0).otherwise(F.col("run")), "column", "y", "x0", "id")
    return keyed.select(*boxes.columns, F.row_number().over(order).alias("place"))


def nearest_rule(boxes: DataFrame, rules: DataFrame, slack: float = 0.06, most: float = 26.0, width: float = WIDTH) -> DataFrame:
    """For each rule the nearest box above it within `most` whose column it spans."""
    r = rules.select(*PAGE, F.col("id").alias("rule"), F.col("x0").alias("rx0"), F.col("x1").alias("rx1"), F.col("y0").alias("ry"))
    gap = F.col("ry") - F.col("y1")
    hit = boxes.join(r, PAGE).where((F.col("rx0") <= F.col("x0") + width * slack) & (F.col("rx1") >= F.col("x1") - width * slack) & gap.between(0, most))
    return hit.groupBy(*PAGE, "rule").agg(F.min(F.struct(gap.alias("gap"), F.col("id").alias("id"))).alias("best")).select(*PAGE, "rule", "best.id", "best.gap")


def shade_cover(boxes: DataFrame, shades: DataFrame, least: float = 0.6) -> DataFrame:
    """For each box the first shade that covers at least that share of it."""
    s = shades.select(*PAGE, F.col("id").alias("shade"), *[F.col(c).alias(f"s{c}") for c in ("x0", "y0", "x1", "y1")])
    w = F.greatest(F.lit(0.0), F.least("x1", "sx1") - F.greatest("x0", "sx0"))
    h = F.greatest(F.lit(0.0), F.least("y1", "sy1") - F.greatest("y0", "sy0"))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    hit = boxes.join(s, PAGE).withColumn("cover", w * h / area).where((area > 0) & (F.col("cover") >= least))
    return hit.groupBy(*PAGE, "id").agg(F.min("shade").alias("shade"))


def stitched_rules(segments: DataFrame, dy: float = 1.2, gap: float = 4.0, least: float = 0.25, width: float = WIDTH) -> DataFrame:
    """Segments of one height whose ends meet, as one rule each; short ones go. Heights are grouped by dy.

    Runs are told by one sort of the columns that matter: each value of a run is carried to its last segment by windows of that
    order, so no table of runs is held beside it. A struct that begins with the run's number has its maximum within the run.
    """
    own = segments.select(*PAGE, F.floor(F.col("y0") / dy).alias("row"), "x0", "x1", "id")
    reach = Window.partitionBy(*PAGE, "row").orderBy("x0", "x1", "id")
    so_far = reach.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.max("x1").over(reach.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("x0") - before <= gap, 0).otherwise(1)
    runs = own.withColumn("fresh", fresh).withColumns({"run": F.sum("fresh").over(so_far), "place": F.row_number().over(reach), "last": F.coalesce(F.lead("fresh").over(reach) == 1, F.lit(True))})
    of_run = lambda c: F.max(F.struct("run", c.alias("v"))).over(so_far)["v"]
    ends = runs.withColumns({"left": -of_run(-F.col("x0")), "right": of_run(F.col("x1")), "n": F.col("place") - F.max(F.when(F.col("fresh") == 1, F.col("place"))).over(so_far) + 1})
    found = ends.where(F.col("last") & (F.col("right") - F.col("left") >= width * least))
    return found.select(*PAGE, "row", F.col("left").alias("x0"), F.col("right").alias("x1"), F.col("n").cast("long").alias("n"))


def heading_level(text: Column, size: Column, oblique: Column, body: Column, number: Column | None = None) -> Column:
    """1 by size; 2 by a roman numeral; 3 by an oblique letter; 4 by a dotted number; 2 by a name or a somewhat larger size.

    number: what is looked at for a number, if that is known apart from the text (null: the heading has none).
    """
    number = text if number is None else number
    named = F.lower(text).rlike(r"^(abstract|introduction|references|conclusions?|acknowledge?ments?|appendix|methods?|results|discussion)(?![0-9A-Za-z_])")
    return F.when(F.length(text) > 160, None).when(size >= body * 1.8, 1).when(number.rlike(r"^[IVX]{1,6}\.\s+\S") & ~oblique, 2).when(number.rlike(r"^[A-Z]\.\s+\S") & oblique, 3).when(number.rlike(r"^[0-9]+(?:\.[0-9]+){1,3}\.?\s+\S"), 4).when(named & (F.length(text) < 60), 2).when((size >= body + 1) & (F.length(text) < 90), 2)


def hex_color(rgb: Column) -> Column:
    return F.concat(F.lit("#"), F.array_join(F.transform(rgb, lambda v: F.lpad(F.lower(F.hex(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 255 + 0.5).cast("long"))), 2, "0")), ""))


def gutters(boxes: DataFrame, width: float = WIDTH) -> DataFrame:
    """(paper_id, page, gutter): the x between columns that the fewest boxes cross, or null."""

    return fold_groups(boxes, PAGE, ["x0", "y0", "x1", "y1"], lambda key, rows: [(*key, _gutter(rows, width))], "paper_id long, page long, gutter double")


def _gutter(boxes: list[tuple], width: float) -> float | None:
    own = np.array(boxes, dtype=float)
    steps = width * 0.35 + 0.5 * np.arange(int(width * 0.3 / 0.5) + 1)
    while len(own):
        across = (own[:, None, 0] < steps) & (steps < own[:, None, 2])
        crossed = across.sum(axis=0)
        fewest = np.flatnonzero(crossed == crossed.min())
        k = fewest[np.lexsort((steps[fewest], np.abs(steps[fewest] - width / 2)))[0]]
        if crossed[k] > max(1, int(0.06 * len(own))):
            own = own[~across[:, k]]
            continue
        sides = own[own[:, 2] <= steps[k]], own[own[:, 0] >= steps[k]]
        if not all(map(len, sides)):
            return None
        spans = [s[:, 3].max() - s[:, 1].min() for s in sides]
        tall = min(spans) >= 0.5 * max(spans) > 0
        return float(steps[k]) if tall or min(map(len, sides)) >= 2 else None
    return None


def clusters(boxes: DataFrame, dx: float = 6.0, dy: float = 20.0) -> DataFrame:
    """Boxes within dx and dy of each other, joined until nothing changes: (paper_id, page, x0, y0, x1, y1, n)."""

    def one(key: tuple, rows: list[tuple]) -> list[tuple]:
        own = [[*r, 1] for r in rows]
        moved = True
        while moved:
            moved, out = False, []
            for b in sorted(own):
                for o in out:
                    if b[0] <= o[2] + dx and o[0] <= b[2] + dx and b[1] <= o[3] + dy and o[1] <= b[3] + dy:
                        o[:] = [min(o[0], b[0]), min(o[1], b[1]), max(o[2], b[2]), max(o[3], b[3]), o[4] + b[4]]
                        moved = True
                        break
                else:
                    out.append(list(b))
            own = out
        return [(*key, *o) for o in sorted(own)]

    return fold_groups(boxes, PAGE, ["x0", "y0", "x1", "y1"], one, "paper_id long, page long, x0 double, y0 double, x1 double, y1 double, n long")


def caption_pairs(images: DataFrame, texts: DataFrame, most: float = 90.0) -> DataFrame:
    """(paper_id, page, image, text): captions matched to images one to one, by the least distance first; ties by ids."""
    i = images.select(*PAGE, F.col("id").alias("image"), *[F.col(c).alias(f"i{c}") for c in ("x0", "y0", "x1", "y1")])
    overlap = F.least("x1", "ix1") - F.greatest("x0", "ix0")
    gap = F.when(F.col("y0") >= F.col("iy1"), F.col("y0") - F.col("iy1")).otherwise(F.col("iy0") - F.col("y1"))
    hit = texts.join(i, PAGE).withColumn("score", F.abs(gap) + F.when(gap < 0, 8.0).otherwise(0.0)).where((overlap > 0) & (gap <= most) & (gap >= -F.least(F.lit(24.0), (F.col("y1") - F.col("y0")) * 0.25)))

    def one(key: tuple, rows: list[tuple]) -> list[tuple]:
        seen_i, seen_t, out = set(), set(), []
        for image, text, _ in rows:
            if image not in seen_i and text not in seen_t:
                seen_i.add(image), seen_t.add(text)
                out.append((*key, image, text))
        return out

    return fold_groups(hit, PAGE, ["image", "id", "score"], one, "paper_id long, page long, image long, text long", ("score", "image", "id"))


def table_regions(rules: DataFrame, lines: DataFrame, most_gap: float = 220.0, least_lines: int = 4, ratio: float = 1.6, columns: int = 3, top: int = 3) -> DataFrame:
    """(paper_id, page, y0, y1): bands between neighbouring rules with enough lines, lines a row and distinct starts; the tallest of a page.

    rules: (paper_id, page, x0, x1, y); lines: (paper_id, page, x0, y0). Rules go together while the gap is small; a
    line's row and start are told by steps of 4 points.
    """
    order = Window.partitionBy(*PAGE).orderBy("y", "x0")
    far = F.coalesce((F.col("y") - F.lag("y").over(order)) > most_gap, F.lit(True))
    runs = rules.withColumn("far", far.cast("int")).withColumn("band", F.sum("far").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    bands = runs.groupBy(*PAGE, "band").agg(F.min("y").alias("b0"), F.max("y").alias("b1"), F.count(F.lit(1)).alias("rules")).where("rules >= 2")
    inside = bands.join(lines, PAGE).where((F.col("y0") >= F.col("b0")) & (F.col("y0") <= F.col("b1")))
    held = inside.groupBy(*PAGE, "band", "b0", "b1").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct(F.floor(F.col("y0") / 4)).alias("rows"), F.countDistinct(F.floor(F.col("x0") / 4)).alias("starts"))
    found = held.where((F.col("lines") >= least_lines) & (F.col("lines") >= F.col("rows") * ratio) & (F.col("starts") >= columns))
    place = F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc(F.col("b1") - F.col("b0")), "b0"))
    return found.withColumn("k", place).where(F.col("k") <= top).select(*PAGE, F.col("b0").alias("y0"), F.col("b1").alias("y1"))


def margin_graphics(boxes: DataFrame, texts: DataFrame, height: float = HEIGHT, width: float = WIDTH, band: float = 0.14, top: int = 4) -> DataFrame:
    """Small boxes in the bands at a page's edges that lie over no text: the largest of each page."""
    small = boxes.where(((F.col("y1") <= height * band) | (F.col("y0") >= height * (1 - band))) & ((F.col("x1") - F.col("x0")).between(4, width * 0.4)) & ((F.col("y1") - F.col("y0")).between(4, 40)))
    t = texts.select(*[F.col(c).alias(f"t_{c}") for c in (*PAGE, "x0", "y0", "x1", "y1")])
    over = (F.col("x0") < F.col("t_x1")) & (F.col("x1") > F.col("t_x0")) & (F.col("y0") < F.col("t_y1")) & (F.col("y1") > F.col("t_y0"))
    free = small.join(t, (F.col("paper_id") == F.col("t_paper_id")) & (F.col("page") == F.col("t_page")) & over, "left_anti")
    place = F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))), "id"))
    return free.withColumn("k", place).where(F.col("k") <= top).select(*PAGE, "id", F.col("k").cast("long").alias("k"))


#: Fixed value: points by which boxes must overlap on each axis, since a frame and a line beside it may touch.
TOUCH = 0.6


def overlapping(a: DataFrame, b: DataFrame, tolerance: float = TOUCH) -> DataFrame:
    """(paper_id, page, a, b, area) of boxes of two kinds that lie over one another by more than a tolerance on both axes. Boxes meet on their page alone."""
    named = lambda df, k: df.select(*PAGE, F.col("id").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in ("x0", "y0", "x1", "y1")])
    wide = F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0")
    high = F.least("a_y1", "b_y1") - F.greatest("a_y0", "b_y0")
    over = (F.col("a_x0") < F.col("b_x1") - tolerance) & (F.col("b_x0") < F.col("a_x1") - tolerance) & (F.col("a_y0") < F.col("b_y1") - tolerance) & (F.col("b_y0") < F.col("a_y1") - tolerance)
    return named(a, "a").join(named(b, "b"), PAGE).where(over).select(*PAGE, "a", "b", (wide * high).alias("area"))


def column_seams(ordered: DataFrame) -> DataFrame:
    """(paper_id, page, before, after): a left column's last text that goes on at the head of the right one. ordered: place, side, text."""
    w = Window.partitionBy(*PAGE).orderBy("place")
    near = ordered.withColumns({"after": F.lead("id").over(w), "next_side": F.lead("side").over(w), "next_text": F.lead("text").over(w)})
    return near.where((F.col("side") == 0) & (F.col("next_side") == 1) & continues(F.col("text"), F.col("next_text"))).select(*PAGE, F.col("id").alias("before"), "after")
