"""MinHash near-dedup: a multi-index Hamming join over b-bit signatures, links confirmed on full shingle sets.

A document's set: its distinct shingles of `shingle` consecutive words (white space of ASCII parts words, A-Z is
lower-cased); with fewer words, the whole sequence is one shingle. Two sets are linked at
100 * intersection >= 100 * threshold * union.

Method. A signature has CHUNKS chunks of CHUNK symbols, each the low 16 bits of a minimum. Two signatures that differ in
at most 2 * CHUNKS - 1 symbols have, by the pigeonhole principle, a chunk that differs in at most one, so a key for
each chunk and each symbol left out of it ("allowed errors") meets in at least one key: no pair within that distance is
missed. A pair beyond it is missed only if every chunk differs in at least two symbols; at a similarity of exactly 0.8
that has a probability under MISSED, and less above. No pair that meets is dropped for its distance: what can't be
linked by the sizes of its sets is left out, which is exact, and signatures further apart than FAR, which a linked pair
reaches with a probability under MISSED. Every link is confirmed on the full sets (as 64-bit hashes of shingles).

Groups. Equal sets are folded to one representative first, by a pre-aggregated minimum. In each key, all members are
compared with its smallest one (a star, not all pairs) and the confirmed links are closed into components. Members that
are then outside the component of their key's smallest meet the other members of the key in blocks of bounded size,
which hold the full sets and yield a spanning forest of exact links. What any step makes grows with the members of a
group, not with its pairs. Joins on a key, digest or head that many rows share read both sides from written tables, so
that adaptive execution can split the many rows of one value among tasks.

Defined results: no words or no text: an empty set, linked with nothing, kept. Rows that share an id are one document
for linking: their sets are all its own. A null id is kept alone in the result, with a null component and kept true.
An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import picked, shipped, shuffle_partitions, slices, written

CHUNKS, CHUNK = 16, 5
SYMBOLS = CHUNKS * CHUNK
#: The probability with which a pair at the threshold may be missed, by its keys or by FAR.
MISSED = 1e-9


def far(percent: int) -> int:
    """The least distance that a pair at the threshold exceeds with a probability under MISSED."""
    p = 1 - percent / 100
    at = lambda k: comb(SYMBOLS, k) * p**k * (1 - p) ** (SYMBOLS - k)
    over, k = 0.0, SYMBOLS
    while k > 0 and over + at(k) < MISSED:
        over, k = over + at(k), k - 1
    return k


#: Shingles that a block of strays or of members holds in the mean.
BLOCK_ELEMENTS = 2_000_000
#: Words whose hashes are kept in a worker's memory, and rows of a block of minima.
CACHE, BLOCK = 1 << 18, 4096

_rng = np.random.default_rng(20240501)
_MULTIPLIERS = _rng.integers(1, 1 << 32, SYMBOLS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADDENDS = _rng.integers(0, 1 << 32, SYMBOLS, dtype=np.uint64).astype(np.uint32)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: str | None, shingle: int, hashes: dict) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(shingle, len(h))
    total = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        total = _mixed(total * _M1 + h[i : len(h) - size + 1 + i])
    return np.unique(total)


def signature(elements: np.ndarray) -> np.ndarray:
    """SYMBOLS minima, of which the low 16 bits are kept."""
    small = (elements >> np.uint64(32)).astype(np.uint32)
    low = np.full(SYMBOLS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(small), BLOCK):
        low = np.minimum(low, (small[at : at + BLOCK, None] * _MULTIPLIERS + _ADDENDS).min(axis=0))
    mixed = low * np.uint32(0x85EBCA6B)
    return ((mixed ^ (mixed >> np.uint32(15))) & np.uint32(0xFFFF)).astype(np.uint16)


def chunk_keys(symbols: np.ndarray) -> np.ndarray:
    """For each signature (a row), each chunk and each symbol left out of it, a 64-bit key of the rest."""
    chunks = symbols.reshape(len(symbols), CHUNKS, CHUNK).astype(np.uint64)
    keys = np.empty(chunks.shape, np.uint64)
    for out in range(CHUNK):
        h = np.broadcast_to((np.arange(CHUNKS, dtype=np.uint64) * np.uint64(CHUNK) + np.uint64(out + 1)) * _M1, chunks.shape[:2])
        for i in range(CHUNK):
            if i != out:
                h = _mixed(h * _M1 + chunks[:, :, i])
        keys[:, :, out] = h
    return keys.reshape(len(symbols), SYMBOLS)


def _sketches(shingle: int):
    schema = pa.schema([("n", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = _WordHashes()
        for batch in slices(batches):
            rows = []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), shingle, hashes)
                if not len(s):
                    rows.append((0, None, None))
                    continue
                symbols = signature(s)
                rows.append((len(s), xxhash.xxh128_digest(s.tobytes()), symbols.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True))], names=["_id", *schema.names])

    return run


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(_id, n, digest, sig) of each row."""
    base = picked(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    return shipped(base).mapInArrow(_sketches(shingle), f"_id {base.schema['_id'].dataType.simpleString()}, n long, digest binary, sig binary")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sigs = batch.column(1).to_pylist()
        flat = chunk_keys(np.frombuffer(b"".join(sigs), np.uint16).reshape(len(sigs), SYMBOLS)).ravel().view(np.int64)
        at = pa.array(np.repeat(np.arange(len(sigs)), SYMBOLS))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(flat)], names=["rep", "key"])


def _shingled(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in slices(batches):
            sets = [shingle_set(t.as_py(), shingle, hashes).view(np.int64) for t in batch.column(1)]
            offsets = np.cumsum([0, *map(len, sets)])
            values = pa.array(np.concatenate(sets))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], names=["rep", "elements"])

    return run


def _distances(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, SYMBOLS) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((a != b).sum(axis=1) <= most))

    return run


def _near(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Of (a, b), the pairs that may be linked by their sizes and by the distance of their signatures. sigs: (rep, n, sig)."""
    kind = pairs.schema["a"].dataType.simpleString()
    side = lambda x: sigs.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").where(F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb"))
    return both.select("a", "b", "sa", "sb").mapInArrow(_distances(far(percent)), f"a {kind}, b {kind}")


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of (a, b), the pairs whose full sets are similar enough. texts: (rep, _text). The set of b moves once a pair, that of a once."""
    kind = pairs.schema["a"].dataType.simpleString()
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    # by shuffle at every size: how many ids are wanted follows the input
    sets = written(texts.join(wanted.hint("merge"), "rep", "left_semi").mapInArrow(_shingled(shingle), f"rep {kind}, elements array<bigint>"), "sets")
    left = pairs.join(sets.select(F.col("rep").alias("b"), F.col("elements").alias("eb")), "b")
    both = left.join(sets.select(F.col("rep").alias("a"), F.col("elements").alias("ea")), "a")
    shared = both.select("a", "b", (F.size("ea") + F.size("eb")).cast("long").alias("sum"), F.size(F.array_intersect("ea", "eb")).cast("long").alias("both"))
    return shared.where(F.lit(100) * F.col("both") >= F.lit(percent) * (F.col("sum") - F.col("both"))).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of the links (a, b): comp is the smallest node reachable.

    Large stars and small stars alternate until nothing moves. Every round is joins and pre-aggregated minima, cut by
    a written table; no neighbour list is gathered in one place.
    """
    links = written(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v").distinct(), "links")
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        large = written(large, "large")
        low = written(large.groupBy("v").agg(F.min("u").alias("m")), "low")
        small = large.join(low, "v").select(F.explode(F.array(F.struct(F.col("m").alias("u"), "v"), F.struct(F.col("m").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.*").where("u < v").distinct()
        after = written(small, "links")
        # done when every node hangs on one smaller node, which hangs on none
        twice = after.groupBy("v").count().where("count > 1").select("v").limit(1)
        inner = after.join(after.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("v").limit(1)
        links = after
        if twice.unionByName(inner).isEmpty():
            break
    return links.select(F.col("v").alias("node"), F.col("u").alias("comp")).unionByName(links.select(F.col("u").alias("node"), F.col("u").alias("comp")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of docs."""
    base = written(sketches(docs, id_col, text_col, shingle), "sketches")
    known = base.where("_id is not null and digest is not null")
    # equal sets fold to their smallest id
    owners = written(known.groupBy("digest").agg(F.min("_id").alias("rep")), "owners")
    member = written(known.select("_id", "digest", "n", "sig").join(owners, "digest").select("_id", "rep", "n", "sig"), "members")
    reps = written(member.where("_id = rep").select("rep", "n", "sig").distinct().repartition(shuffle_partitions(docs.sparkSession)), "representatives")
    kind = reps.schema["rep"].dataType.simpleString()

    keys = reps.select("rep", "sig").mapInArrow(_keyed, f"rep {kind}, key bigint")  # made again where it is read: a tenth of its bytes are stored
    heads = written(keys.groupBy("key").agg(F.min("rep").alias("head"), F.max("rep").alias("last")).where("head < last").select("key", "head"), "heads")
    shared = written(keys.join(heads, "key").where("head <> rep"), "shared")
    texts = picked(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("rep"), F.col(f"`{text_col}`").cast("string").alias("_text")).where("rep is not null")
    star = written(_near(shared.select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct(), reps, percent), "star")
    links = written(_confirmed(star, texts, shingle, percent), "links")

    links = links.unionByName(_stray_links(shared, links, texts, shingle, percent))
    ids = member.select("_id", "rep").distinct()
    lowest = ids.groupBy("_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("_id", "a")
    links = links.unionByName(ids.join(lowest, "_id").where("rep > a").select("a", F.col("rep").alias("b")))
    closed = components(links)
    placed = ids.join(closed, F.col("rep") == F.col("node"), "left").groupBy("_id").agg(F.min(F.coalesce("comp", "rep")).alias("comp"))
    out = base.select("_id", "n").join(placed, "_id", "left").select("_id", "n", F.coalesce("comp", "_id").alias("c"))
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), F.col("_id").eqNullSafe(F.col("c")).alias("kept"))


def _forest(percent: int):
    """Of a block of strays and a block of members, links that join what the exact comparison of all pairs would join."""

    def run(key: tuple, strays: pa.Table, members: pa.Table) -> pa.Table:
        reps, comps = members.column("rep").to_pylist(), members.column("comp").to_pylist()
        sets = [np.asarray(e.values) for e in members.column("elements")]
        sizes = np.array([len(e) for e in sets], np.int64)
        values, rows = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(values, kind="stable")
        values, rows = values[order], rows[order]
        root: dict = {}

        def find(x):
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        a, b = [], []
        for s, comp, own in zip(strays.column("stray").to_pylist(), strays.column("comp").to_pylist(), strays.column("elements"), strict=True):
            own = np.asarray(own.values)
            low, high = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
            count = high - low
            at = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            both = np.bincount(rows[at], minlength=len(sets))
            for k in np.flatnonzero(100 * both >= percent * (len(own) + sizes - both)):
                x, y = find(comp), find(comps[k])
                if x != y:
                    root[x] = y
                    a.append(min(s, reps[k])), b.append(max(s, reps[k]))
        kind = members.schema.field("rep").type
        return pa.table({"a": pa.array(a, kind), "b": pa.array(b, kind)})

    return run


def _stray_links(shared: DataFrame, links: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b): links between members of a key that its smallest member did not join.

    Strays are members outside the component of their key's smallest. Those of a head's keys meet all other members of
    these keys, in blocks of bounded size that hold the full sets; what leaves a block is a spanning forest of exact
    links, never its pairs.
    """
    kind = shared.schema["rep"].dataType.simpleString()
    closed = written(components(links), "components")
    named = lambda side: closed.select(F.col("node").alias(side), F.col("comp").alias(f"{side}_comp"))
    comps = shared.join(named("rep"), "rep", "left").join(named("head"), "head", "left")
    comps = written(comps.select("key", "head", "rep", F.coalesce("rep_comp", "rep").alias("comp"), (F.coalesce("rep_comp", "rep") != F.coalesce("head_comp", "head")).alias("stray")), "comps")
    mixed = written(comps.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key"), "mixed")
    rows = written(comps.join(mixed, "key", "left_semi").groupBy("head", "rep").agg(F.min("comp").alias("comp"), F.max("stray").alias("stray")), "contested")
    sets = written(texts.join(rows.select("rep").distinct().hint("merge"), "rep", "left_semi").mapInArrow(_shingled(shingle), f"rep {kind}, elements array<bigint>"), "contested-sets")
    sizes = written(sets.select("rep", F.size("elements").alias("n")), "contested-sizes")
    blocks = rows.join(sizes, "rep").groupBy("head").agg(F.ceil(F.sum("n") / F.lit(BLOCK_ELEMENTS)).cast("int").alias("m"), F.ceil(F.sum(F.when(F.col("stray"), F.col("n"))) / F.lit(BLOCK_ELEMENTS)).cast("int").alias("s"))
    full = written(rows.join(written(blocks, "blocks"), "head"), "placed").join(sets, "rep")
    part = lambda n: F.pmod(F.xxhash64("rep"), n)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))
    left = full.where("stray").select("head", "rep", "comp", "elements", part(F.col("s")).alias("i"), each(F.col("m")).alias("j"))
    left = left.toDF("head", "stray", "comp", "elements", "i", "j")
    right = full.select("head", "rep", "comp", "elements", each(F.col("s")).alias("i"), part(F.col("m")).alias("j"))
    return left.groupBy("head", "i", "j").cogroup(right.groupBy("head", "i", "j")).applyInArrow(_forest(percent), f"a {kind}, b {kind}")


def query(spark, sf_dir: str) -> DataFrame:
    from foliant.llm.common import table

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON reach.r = e.a)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r) AS component_id, d.doc_id = min(r) AS kept
FROM documents d JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
"""
