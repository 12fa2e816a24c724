"""PII: high-recall generators propose spans, boosted trees judge them by format and context, calibrated thresholds select.

DataFrame functions alone, no Python on the executors. The base patterns (email, ip, card, phone) with their checks always stand. Wider generators
propose overlapping spans: addresses with spelled-out signs, long digit groups, long tokens. Trees over the format of a
span and the text around it, fitted on all distinct labelled spans, weighted by how often they come, give a score: Spark
sums the histograms that the trees grow by, and no span reaches the driver. Scores of trees that didn't see the span are calibrated; by them it is settled how many of a
generator's labelled spans that no base span holds, the best first, still have the precision wanted, and the least score that the final trees
give to as many of them is the generator's threshold: it is read off the very trees that it is applied to. What passes is added unless a base span holds it already; it may overlap or extend base spans.

Labels come from the corpus, none of them an input of the trees. A candidate that takes a base span's place is 1, one
that cuts or runs over a base span 0. Of the rest, an address is 1 if it becomes a base email with its signs put back,
a long digit group if it passes the checksum of cards (0 if it fails, is too short or too long, is part of a longer word, or follows a word for
orders, versions and the like; one of 10 to 13 digits that is no phone and follows no such word has no label, and is
scored by what the others teach), a long token after a name and an equals sign, or in a form that issuers of keys have
published, is 1, and one of letters alone 0. So for secrets the trees mostly learn how a token is assigned. Base
emails, cards and phones rewritten into the forms that only the generators propose, in the context they stand in, are
further examples of label 1.

Each pattern runs once to part a text and once to list its matches; positions, in code points, are running sums of
lengths. The patterns never take more than linear time: runs are possessive and start where a run starts.

Defined results: null and empty texts have no spans. Where the labelled spans have one label only, or a kind reaches the
precision nowhere, nothing of it is added. Rows that repeat get equal results; a null id is kept. An empty table gives an
empty table. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm import boosting
from foliant.llm.common import picked, written

_LOCAL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++"
#: Base kinds in order, as possessive forms of the patterns that define them.
BASE = {
    "email": _LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_AT, _DOT = r"(?: ?(?:@|\(at\)|\[at\]) ?)", r"(?:\.| ?(?:\(dot\)|\[dot\]) ?)"
#: Generators of further candidates, in order.
WIDE = {
    "address": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++| at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)++)",
    "number": r"[+(]?[0-9](?:[ ().-]{0,2}[0-9]){6,}+",
    "secret": r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{20,}+",
}
KINDS = [*BASE, *WIDE]
#: A cheap test that a text must pass to be searched for a kind.
GUARDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]", "address": r"@|\(at\)|\[at\]| at [A-Za-z0-9-]+ dot ", "number": "[0-9][ ().-]{0,2}[0-9]", "secret": "[A-Za-z0-9_+/-]{20}"}
#: Code points of context before and after a span.
BEFORE, AFTER = 24, 8
#: Bins of a feature at most (a byte each): the places where a tree may cut it. Every span counts in its bin.
BINS = 48
FOLDS, TREES, DEPTH, RATE = 3, 12, 3, 0.3
#: Margins beyond this are as sure as any.
FAR = 64.0
PRECISION = 0.95
NAMED = r"(?i)(?:key|token|secret|password|passwd|pwd|auth|bearer)[a-z_]{0,12}\s?[=:]\s?[\"']?$"
#: Beginnings of published forms of keys and tokens.
ISSUED = r"^(?:gh[oprsu]_|github_pat_|glpat-|xox[abeprs]-|AKIA|ASIA|AIza|[rs]k_(?:live|test)_|eyJ[A-Za-z0-9_-]{10,})"
#: Words before a number that isn't a person's.
COUNTED = r"(?i)\b(?:order|version|isbn|issn|serial|part|item|ticket|invoice|page|build|no|nr|id)\b[ .:#]*$"
FEATURES = ["length", "digits", "letters", "uppers", "separators", "dots", "plus", "at_sign", "hexadecimal", "turns", "groups", "joined_before", "joined_after", "quoted", "contact_word", "count_word", "spelled", "blanks", "assigned", "address", "number", "secret"]


def _kind_array(kind: str, pattern: str) -> Column:
    pieces, matches = F.col(f"p_{kind}"), F.col(f"m_{kind}")
    return F.transform(
        matches,
        lambda m, i: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            i.alias("idx"),
            F.length(F.get(pieces, i)).alias("gap"),
            m.alias("m"),
            F.right(F.get(pieces, i), F.lit(BEFORE)).alias("before"),
            F.left(F.get(pieces, i + 1), F.lit(AFTER)).alias("after"),
        ),
    )


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _row, uid, kind, m, before, after, start, end) of every match of every pattern, base checks not yet applied."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = picked(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("_id"), text.alias("_text")).select("_id", "_text", F.xxhash64("_text").alias("_row"), F.monotonically_increasing_id().alias("uid"))
    cut = base.select("_id", "_row", "uid", "_text", *[F.col("_text").rlike(GUARDS[k]).alias(f"g_{k}") for k in KINDS])
    cut = cut.where(" or ".join(f"g_{k}" for k in KINDS))
    none = F.array().cast("array<string>")
    parts = {k: F.when(F.col(f"g_{k}"), F.split("_text", p, -1)).otherwise(none) for k, p in (BASE | WIDE).items()}
    found = {k: F.when(F.col(f"g_{k}"), F.regexp_extract_all("_text", F.lit(p), F.lit(0))).otherwise(none) for k, p in (BASE | WIDE).items()}
    split = cut.select("_id", "_row", "uid", *[c.alias(f"p_{k}") for k, c in parts.items()], *[c.alias(f"m_{k}") for k, c in found.items()])
    rows = split.select("_id", "_row", "uid", F.explode(F.concat(*[_kind_array(k, p) for k, p in (BASE | WIDE).items()])).alias("c")).select("_id", "_row", "uid", "c.*")
    running = Window.partitionBy("uid", "kind").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.repartition("uid").withColumn("end", F.sum(F.col("gap") + F.length("m")).over(running))
    return placed.withColumn("start", F.col("end") - F.length("m")).drop("gap", "idx")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum of card numbers."""
    reverse = F.split(F.reverse(digits), "")
    doubled = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    values = F.transform(reverse, lambda d, i: F.when(i % 2 == 1, doubled(d.cast("int"))).otherwise(d.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def checked() -> Column:
    """Whether a match of a base kind passes that kind's check; false for other kinds."""
    kind, m = F.col("kind"), F.col("m")
    parts = F.transform(F.split(m, r"\."), lambda p: F.ltrim(p, F.lit("0")))
    ip = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.when(F.length(p) <= 3, F.coalesce(F.nullif(p, F.lit("")).cast("int"), F.lit(0))).otherwise(999) <= 255))
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    card = F.when((n >= 14) & (n <= 19), _luhn(digits)).otherwise(False)
    return F.when(kind == 0, True).when(kind == 1, ip).when(kind == 2, card).when(kind == 3, (n >= 10) & (n <= 15)).otherwise(False)


def _features() -> list[Column]:
    m, before, after = F.col("m"), F.col("before"), F.col("after")
    n = F.length(m)
    count = lambda p: F.length(F.regexp_replace(m, f"[^{p}]", ""))
    turns = F.regexp_count(m, F.lit("[A-Za-z][0-9]|[0-9][A-Za-z]"))
    columns = [n, count("0-9") / n, count("A-Za-z") / n, count("A-Z") / n, count(" ()-"), count("."), m.startswith("+"), m.contains("@"), count("0-9a-f") / n, turns, F.regexp_count(m, F.lit("[0-9]+"))]
    columns += [before.rlike(r"[\p{L}\p{N}_]$"), after.rlike(r"^[\p{L}\p{N}_]"), before.rlike("[\"'`]$"), before.rlike(r"(?i)\b(?:tel|phone|mobile|fax|call|mail|contact|reach|write|card|visa|iban|account)\b"), before.rlike(COUNTED), m.rlike(r"[(\[ ](?:at|dot)[)\] ]"), count(" "), before.rlike("[=:] ?[\"'`]?$")]
    return [c.cast("double") for c in [*columns, *[F.col("kind") == KINDS.index(k) for k in WIDE]]]


def _within(spans: DataFrame) -> DataFrame:
    """spans with held (a base span holds it), same (one has its place) and cut (one overlaps it in another place)."""
    sofar = Window.partitionBy("uid").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    place = Window.partitionBy("uid", "start", "end")
    # a base span that starts after the candidate's start and before its end
    later = Window.partitionBy("uid").orderBy("start").rangeBetween(1, Window.unboundedFollowing)
    reach = F.coalesce(F.max(F.when(F.col("base"), F.col("end"))).over(sofar), F.lit(-1))
    ahead = F.coalesce(F.min(F.when(F.col("base"), F.col("start"))).over(later), F.lit(2**31))
    marked = spans.withColumns({"same": F.max("base").over(place), "reach": reach, "ahead": ahead})
    return marked.withColumns({"held": F.col("reach") >= F.col("end"), "cut": ~F.col("same") & ((F.col("reach") > F.col("start")) | (F.col("ahead") < F.col("end")))}).drop("reach", "ahead")


def respelled(m: Column) -> Column:
    """An address with its signs put back."""
    return F.regexp_replace(F.regexp_replace(m, r" ?(?:\(at\)|\[at\]) ?| at | ?@ ?", "@"), r" ?(?:\(dot\)|\[dot\]) ?| dot ", ".")


def _weak_labels(spans: DataFrame) -> DataFrame:
    """Candidates of the generators with _label, from spans with the columns of _within."""
    m, digits = F.col("m"), F.regexp_replace("m", "[^0-9]", "")
    n = F.length(digits)
    address = respelled(m).rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$")
    joined = F.col("before").rlike(r"[\p{L}\p{N}_]$") | F.col("after").rlike(r"^[\p{L}\p{N}_]")
    number = F.when((n < 10) | (n > 19) | joined | F.col("before").rlike(COUNTED), 0).when(n >= 14, _luhn(digits).cast("int"))
    secret = F.when(F.col("before").rlike(NAMED) | m.rlike(ISSUED), 1).when(m.rlike("^[A-Za-z-]+$"), 0)
    placed = F.when(F.col("same"), 1).when(F.col("cut"), 0)
    kind = F.col("kind")
    label = F.when(kind == KINDS.index("secret"), secret).when(placed.isNotNull(), placed).when(kind == KINDS.index("address"), address.cast("int")).otherwise(number)
    return spans.where(kind >= len(BASE)).withColumn("_label", label).where("_label is not null")


def _rewritten(spans: DataFrame) -> DataFrame:
    """(kind, m, before, after, _label) of base emails, cards and phones in forms that only the generators propose."""
    m, form = F.col("m"), F.pmod(F.xxhash64("m", "before"), F.lit(4))
    digits = F.regexp_replace(m, "[^0-9]", "")
    signs = [(" (at) ", "."), ("[at]", "[dot]"), (" at ", " dot "), (" @ ", ".")]
    address = F.lit(None).cast("string")
    for k, (at, dot) in enumerate(signs):
        host = F.replace(F.substring_index(m, "@", -1), F.lit("."), F.lit(dot))
        address = F.when(form == k, F.concat(F.substring_index(m, "@", 1), F.lit(at), host)).otherwise(address)
    fours = [F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", f"$1{x}") for x in (".", "  ", ". ", ") ")]
    card = F.when(form == 0, fours[0]).when(form == 1, fours[1]).when(form == 2, fours[2]).otherwise(fours[3])
    phone = F.when(form < 2, F.ltrim(m, F.lit("+"))).when(form == 2, F.concat(F.lit("00"), F.substring(m, 2, 1 << 20))).otherwise(F.substring(digits, 1, 20))
    kind = F.col("kind")
    new = F.when(kind == 0, address).when(kind == 2, card).when(kind == 3, phone)
    wide = F.when(kind == 0, KINDS.index("address")).otherwise(KINDS.index("number"))
    own = spans.where("base and kind in (0, 2, 3)").select(wide.alias("kind"), new.alias("m"), "before", "after", F.lit(1).alias("_label"))
    pattern = F.when(F.col("kind") == KINDS.index("address"), F.col("m").rlike(f"^(?:{WIDE['address']})$")).otherwise(F.col("m").rlike(f"^(?:{WIDE['number']})$"))
    return own.where(pattern)


def _forms(spans: DataFrame) -> DataFrame:
    """(kind, m, before, after, h, n, free, _label) of each distinct labelled span: how often it comes, how often with no base span that holds it, and the label of over half of its rows."""
    every = _weak_labels(spans).select("kind", "m", "before", "after", "_label", "held").unionByName(_rewritten(spans).withColumn("held", F.lit(False)))
    own = every.groupBy("kind", "m", "before", "after").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("held")).alias("free"), F.sum("_label").alias("ones"))
    return own.select("kind", "m", "before", "after", F.xxhash64("m", "before", "after", "kind").alias("h"), "n", "free", (F.col("ones") * 2 > F.col("n")).cast("int").alias("_label"))


def _binned(x: Column, edges: np.ndarray) -> Column:
    """How many ends of bins lie below x."""
    if not len(edges):
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < x))


def cells(spans: DataFrame, limit: int = BINS) -> tuple[DataFrame, list[np.ndarray]]:
    """(kind, fold, label, bins, n, forms, free) of the distinct labelled spans that fall into the same bins, and the ends of the bins; a span is in one fold."""
    own = _forms(spans).select("kind", F.pmod("h", F.lit(FOLDS)).cast("int").alias("fold"), F.col("_label").alias("label"), "n", "free", *[c.alias(f"x_{f}") for f, c in zip(FEATURES, _features(), strict=True)])
    forms = written(own, "forms")
    edges = boosting.table_edges(forms, [f"x_{f}" for f in FEATURES], min(limit, 255))
    bins = boosting.packed([_binned(F.col(f"x_{f}"), e) for f, e in zip(FEATURES, edges, strict=True)])
    binned = forms.select("kind", "fold", "label", "n", "free", bins.alias("bins"))
    folded = binned.groupBy("kind", "fold", "label", "bins").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("forms"), F.sum("free").alias("free"))
    return written(folded, "cells"), edges


def _margins(folded: DataFrame, models: list) -> DataFrame:
    """(kind, label, n, free, unseen, final) of each cell: margins of the trees that did not see its fold, and of all."""
    unseen = F.lit(0.0)
    for k in range(FOLDS):
        if models[k] is not None:
            unseen = F.when(F.col("fold") == k, boosting.margin_column(models[k])).otherwise(unseen)
    own = folded.withColumn("bins", boosting.unpacked(F.col("bins"), len(FEATURES)))
    z = [F.greatest(F.least(c, F.lit(FAR)), F.lit(-FAR)).alias(n) for n, c in (("unseen", unseen), ("final", boosting.margin_column(models[FOLDS])))]
    return own.select("kind", "label", "n", "free", *z)


def learn(spans: DataFrame, limit: int = BINS):
    """(trees, knots, {kind: least margin of the trees}) from spans with the columns of _within; None where they have one label only.

    Trees, calibration and thresholds take every distinct labelled span, weighted by how often it comes. limit: the bins
    of a feature at most. Margins are multiples of boosting.GRAIN within FAR, so that their sums are a bounded table.
    """
    folded, edges = cells(spans, limit)
    models = boosting.boost_table(folded, edges, FOLDS, TREES, DEPTH, RATE)
    if models[FOLDS] is None:
        return None
    scored = _margins(folded, models)
    both = F.array(*[F.struct(F.lit(k).alias("whole"), F.col(c).alias("z")) for k, c in enumerate(("unseen", "final"))])
    each = scored.select("kind", "label", "n", "free", F.explode(both).alias("m")).groupBy("kind", "m.whole", "m.z")
    table = each.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("ones"), F.sum("free").alias("free"), F.sum(F.col("free") * F.col("label")).alias("free_ones")).orderBy("kind", "whole", "z").toArrow()
    kind, whole, z, n, ones, free, free_ones = (table.column(c).to_numpy().astype(float) for c in ("kind", "whole", "z", "n", "ones", "free", "free_ones"))
    out = whole == 0
    knots = boosting.isotonic(z[out], ones[out] / n[out], weight=n[out])
    least = {}
    for k in range(len(BASE), len(KINDS)):
        own = out & (kind == k) & (free > 0)  # what a base span holds is never added, so it has no say in the thresholds
        selected = _selected(np.interp(z[own], *knots), free_ones[own] / free[own], free[own])
        if selected > 0:
            final = ~out & (kind == k) & (free > 0)
            least[k] = _reaching(z[final], free[final], selected)
    bias, trees = models[FOLDS]
    return (bias, [boosting.unbinned(t, edges) for t in trees]), knots, least


def _selected(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The weight of the most spans, the best first and equal ones together, that have the precision wanted."""
    order = np.argsort(-p, kind="stable")
    total = np.cumsum(weight[order])
    last = np.append(p[order][1:] != p[order][:-1], True) if len(order) else np.empty(0, bool)
    good = np.flatnonzero((np.cumsum((weight * y)[order]) / total >= PRECISION) & last)
    return float(total[good[-1]]) if len(good) else 0.0


def _reaching(margins: np.ndarray, weight: np.ndarray, selected: float) -> float:
    """The highest margin that spans of at least the selected weight reach, less what sums in another order may differ by."""
    order = np.argsort(-margins, kind="stable")
    return float(margins[order][np.searchsorted(np.cumsum(weight[order]), selected - 1e-9)]) - 1e-9


def _added(model) -> Column:
    """Whether a candidate's score reaches its generator's threshold."""
    if model is None or not model[2]:
        return F.lit(False)
    (bias, trees), _, least = model
    columns = [F.col(f"x_{f}") for f in FEATURES]
    z = F.lit(bias)
    for tree in trees:
        z = z + boosting.tree_column(tree, columns)
    passes = F.lit(False)
    for kind, cut in least.items():
        passes = F.when(F.col("kind") == kind, z >= F.lit(cut)).otherwise(passes)
    return passes


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = BINS) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, n_added, base, spans) of each row; base and spans: arrays of (kind, start, end), ordered."""
    spans = candidates(docs, id_col, text_col).withColumn("base", checked())
    spans = written(_within(spans.where(F.col("base") | (F.col("kind") >= len(BASE)))), "spans")
    model = learn(spans, limit)
    scored = spans.withColumns({f"x_{f}": c for f, c in zip(FEATURES, _features(), strict=True)})
    kept = scored.where(F.col("base") | (F.col("kind") >= len(BASE)) & ~F.col("held") & _added(model))
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    span = F.struct("start", "kind", "end", name.alias("name"))
    counts = [F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{kind}") for k, kind in enumerate(BASE)] + [F.count(F.when(~F.col("base"), 1)).alias("n_added")]
    listed = kept.groupBy("uid", "_id", "_row").agg(*counts, F.sort_array(F.collect_list(F.when(F.col("base"), span))).alias("base"), F.sort_array(F.collect_list(span)).alias("spans"))
    once = listed.drop("uid").dropDuplicates(["_id", "_row"])
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = picked(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("_doc"), F.xxhash64(text).alias("_hash"))
    joined = rows.join(once, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_row")), "left")
    return joined.select(F.col("_doc").alias(id_col), *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in (*BASE, "added")], "base", "spans")


def joined_spans(spans: Column) -> Column:
    """kind:start:end, comma-joined; empty if there are none."""
    return F.coalesce(F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ","), F.lit(""))


def redact(text: Column, spans: Column) -> Column:
    """A text with each span replaced by its kind in brackets. Spans that overlap take the name of the first."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))
    done = F.aggregate(spans, start, lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"].cast("long")).alias("at"), a["parts"].alias("parts"))).otherwise(F.struct(s["end"].cast("long").alias("at"), F.concat(a["parts"], F.array(F.substring(text, a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int")), F.concat(F.lit("["), s["name"], F.lit("]")))).alias("parts"))))
    return F.concat(F.array_join(done["parts"], ""), F.substring(text, done["at"].cast("int") + 1, F.length(text)))


def query(spark, sf_dir: str) -> DataFrame:
    from foliant.llm.common import table

    done = detect(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"), "n_added", F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"))
