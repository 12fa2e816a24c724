"""Export of documents in ordered pieces of bounded bytes: text as it stands, assets inlined as base64 by piece.

No row holds a document or an asset as a whole string beside its own: a consumer writes the pieces in order of place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where an asset stands in a document, and names that may be inlined.
REFERENCE = r'src="assets/([^"]*)"'
SAFE_NAME = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"
KINDS = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp"}


def references(documents: DataFrame) -> DataFrame:
    """(paper_id, place, name, text): a document (paper_id, html) cut at its references; text is what stands before one, and the rest has no name."""
    before = F.split("html", REFERENCE, -1)
    names = F.concat(F.regexp_extract_all("html", F.lit(REFERENCE), F.lit(1)), F.array(F.lit(None).cast("string")))
    return documents.select("paper_id", F.posexplode(F.arrays_zip(before.alias("text"), names.alias("name"))).alias("place", "x")).select("paper_id", "place", "x.name", "x.text")


def media_type(name: Column) -> Column:
    suffix = F.lower(F.substring_index(name, ".", -1))
    kind = F.lit("image/png")
    for s, m in KINDS.items():
        kind = F.when(suffix == s, m).otherwise(kind)
    return kind


def inlined_bytes(documents: DataFrame, assets: DataFrame) -> DataFrame:
    """(paper_id, bytes) that the references of each document take in; assets (paper_id, name, size) are not read."""
    found = references(documents).where(F.col("name").rlike(SAFE_NAME)).join(assets.select("paper_id", "name", "size"), ["paper_id", "name"], "left")
    return found.groupBy("paper_id").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def pieces(documents: DataFrame, assets: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(paper_id, place, part, piece) of documents with their assets (paper_id, name, content) inlined, none over `most` bytes.

    A name that isn't safe, or that no asset has, stays as it stands. Text goes by code points, of at most four bytes;
    an asset's bytes by threes, so that the base64 of its pieces is that of the whole.
    """
    signs, raw = max(1, most // 4), max(3, (most - 1) // 4 * 3)
    cut = references(documents)
    known = assets.select("paper_id", "name", "content")
    safe = F.col("name").rlike(SAFE_NAME)
    joined = cut.where(safe).select("paper_id", "place", "name").join(known, ["paper_id", "name"])
    found = joined.select("paper_id", "place", F.lit(True).alias("found"))
    shown = cut.join(found, ["paper_id", "place"], "left")
    lead = F.when(F.col("found"), F.concat(F.col("text"), F.lit('src="data:'), media_type(F.col("name")), F.lit(";base64,"))).when(F.col("name").isNotNull(), F.concat(F.col("text"), F.lit('src="assets/'), "name", F.lit('"'))).otherwise(F.col("text"))
    slots = lambda n, step: F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - 1) / step)).cast("int")))
    text = shown.select("paper_id", "place", lead.alias("t")).select("*", slots(F.length("t"), signs).alias("k"))
    texts = text.select("paper_id", (F.col("place") * 2).alias("place"), F.col("k").alias("part"), F.substring("t", F.col("k") * signs + 1, F.lit(signs)).alias("piece"))
    binary = joined.select("paper_id", "place", "content").select("*", slots(F.length("content"), raw).alias("k"))
    last = F.col("k") == F.floor((F.greatest(F.length("content"), F.lit(1)) - 1) / raw)
    coded = F.concat(F.translate(F.base64(F.substring("content", F.col("k") * raw + 1, F.lit(raw))), "\r\n", ""), F.when(last, F.lit('"')).otherwise(F.lit("")))
    datas = binary.select("paper_id", (F.col("place") * 2 + 1).alias("place"), F.col("k").alias("part"), coded.alias("piece"))
    return texts.unionByName(datas).where("piece <> ''")
