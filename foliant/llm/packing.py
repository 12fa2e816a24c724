"""Best-fit packing: documents to token sequences of at most `capacity` ids, by best-two-fit.

Tokens come from a public tokenizer file, whose path is a parameter, followed by the end id. Documents of over
`capacity` ids are cut in pieces of `capacity`; only the last piece may be shorter. Pieces are dealt to shards by a hash
of their place in the written table, so that no shard holds over about SHARD pieces whatever the input; each shard is
packed apart, at the cost of a part-filled sequence or two a shard. Equal lengths, copies, repeated rows and hot sources
spread like any others.

Method, in a shard. Pieces are taken from the longest down, each bin being filled greedily with the longest piece that
still fits. When nothing fits the rest, the bin's smallest piece is taken out if two pieces still unpacked fill the
expanded gap more tightly; it goes back to the unpacked ones.

Defined results: a null or empty text is one piece, the end id alone. Repeated rows are packed each by itself; rows that
share an id have the same piece numbers. Null ids stay null. An empty table gives an empty table. Other columns are
ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import picked, shipped, slices, written

CAPACITY, END_ID = 4096, 1
#: Pieces of a shard in the mean; a shard is packed in the memory of one task.
SHARD = 25_000
#: Parts of chunks whose ids are kept in a worker's memory, half of them since the last turn; the longest that is kept; code points that are numbered at once.
CACHE, KEPT_CHARS, SLICE = 300_000, 64, 12_000_000
#: Letters that have one lower case each, and the signs of ASCII but the apostrophe, which may part words.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyzÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkIds:
    """The ids of texts, as unsigned little-endian 32-bit ids, by way of their chunks between spaces.

    The tokenizer drops white space and no token spans it, so a text's ids are those of its chunks in turn. In a chunk of
    letters and signs, the two are tokens apart and letter case makes no difference, so its ids are put together from
    those of the lower-cased letters and of the signs. What is not known yet is given to the tokenizer in one text and
    parted at the tokens that end a word. Everything else goes to the tokenizer as it is. A text's chunks are numbered
    by their distinct values, and ids are gathered by number.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")

    def _encode(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Of words that are one run of letters or of signs each."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        last = np.flatnonzero(self.ends[ids]) + 1
        if len(last) != len(words) or last[-1] != len(ids):  # a vocabulary without word ends
            return self._encode(words)
        raw, at = ids.tobytes(), [0, *(4 * last).tolist()]
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]

    def _ids(self, parts: list[str], simple: list[bool]) -> list[bytes]:
        """Of distinct parts; simple ones are one run of letters or of signs each."""
        own, old = self.known, self.before
        new = [(x, s) for x, s in zip(parts, simple, strict=True) if x not in own]
        if new:
            found = {x: old[x] for x, _ in new if x in old}
            plain, rest = [x for x, s in new if s and x not in found], [x for x, s in new if not s and x not in found]
            if plain:
                found.update(zip(plain, self._words(plain), strict=True))
            if rest:
                found.update(zip(rest, self._encode(rest), strict=True))
            long = {x: found.pop(x) for x in [x for x in found if len(x) >= KEPT_CHARS]}
            if len(own) + len(found) > CACHE // 2:  # what was used since the last turn is kept for one more
                self.before, kept = own, {"": b""}
                self.known = kept | found
                own = own | found | long
            else:
                own.update(found)
                own = own | long if long else own
        return [own[x] for x in parts]

    def of(self, texts: list[str]) -> Iterator[memoryview]:
        """The ids of each text."""
        at = 0
        while at < len(texts):
            first, size = at, 0
            while at < len(texts) and (size < SLICE or at == first):
                size += len(texts[at])
                at += 1
            cut = pc.split_pattern(pa.array([t.replace("\n", " ") for t in texts[first:at]], pa.large_string()), " ")
            coded = cut.flatten().dictionary_encode()
            chunks = coded.dictionary
            stem = pc.utf8_rtrim(chunks, SIGNS)
            simple = pc.match_substring_regex(stem, f"^[{LETTERS}]*$")
            heads = pc.if_else(simple, pc.utf8_lower(stem), chunks).dictionary_encode()
            tails = pc.if_else(simple, pc.utf8_ltrim(chunks, LETTERS), "").dictionary_encode()
            names = heads.dictionary
            ids = self._ids(names.to_pylist(), pc.match_substring_regex(names, f"^[{LETTERS}]+$").to_pylist())
            ids += self._ids(tails.dictionary.to_pylist(), [True] * len(tails.dictionary))
            parts = np.stack([heads.indices.to_numpy(), tails.indices.to_numpy().astype(np.int64) + len(names)], axis=1)
            code, sizes = parts[coded.indices.to_numpy()].ravel(), np.array([len(i) // 4 for i in ids], np.int64)
            starts, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(ids), "<u4")
            count = sizes[code]
            ends = np.concatenate([[0], np.cumsum(count)])
            gathered = flat[np.repeat(starts[code] - ends[:-1], count) + np.arange(ends[-1])]
            raw, bounds = memoryview(gathered.tobytes()), (4 * ends[2 * cut.offsets.to_numpy()]).tolist()
            for a, b in zip(bounds, bounds[1:], strict=False):
                yield raw[a:b]


_encoders: dict[str, ChunkIds] = {}


def encoder(path: str) -> ChunkIds:
    """One for each worker process, so that later tasks find what earlier ones learned."""
    if path not in _encoders:
        _encoders[path] = ChunkIds(path)
    return _encoders[path]


def _cut(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = encoder(path), end_id.to_bytes(4, "little")
        for batch in slices(batches):
            at, piece, start, length, crc = [], [], [], [], []
            for row, raw in enumerate(ids.of([t or "" for t in batch.column(1).to_pylist()])):
                tokens = memoryview(bytes(raw) + end)
                total = len(tokens) // 4
                for k, s in enumerate(range(0, total, capacity)):
                    n = min(capacity, total - s)
                    at.append(row), piece.append(k), start.append(s), length.append(n), crc.append(zlib.crc32(tokens[4 * s : 4 * (s + n)]))
            ints = [pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *ints], names=["_id", "piece", "start", "length", "crc"])

    return run


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(_id, piece, start, length, crc) of every piece."""
    base = picked(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    return shipped(base).mapInArrow(_cut(path or tokenizer_path(), capacity, end_id), f"_id {base.schema['_id'].dataType.simpleString()}, piece int, start long, length long, crc long")


class Lengths:
    """The unpacked pieces, by length: the longest of at most a given length in logarithmic time."""

    def __init__(self, lengths: list[int]):
        self.at: dict[int, list[int]] = {}
        for i, n in enumerate(lengths):
            self.at.setdefault(n, []).append(i)
        self.sizes = sorted(self.at)

    def longest(self, most: int) -> int | None:
        k = bisect_right(self.sizes, most) - 1
        return self.sizes[k] if k >= 0 else None

    def take(self, n: int) -> int:
        own = self.at[n]
        i = own.pop()
        if not own:
            del self.at[n]
            del self.sizes[bisect_left(self.sizes, n)]
        return i

    def give(self, n: int, i: int) -> None:
        if n not in self.at:
            self.at[n] = []
            self.sizes.insert(bisect_left(self.sizes, n), n)
        self.at[n].append(i)

    def best_two(self, most: int, over: int) -> tuple[int, int] | None:
        """The two lengths (which may be equal, if two pieces have it) of the largest sum over `over` and at most `most`."""
        low, high, best, found = 0, bisect_right(self.sizes, most) - 1, over, None
        while low <= high:
            a, b = self.sizes[low], self.sizes[high]
            if a + b > most or (low == high and len(self.at[a]) < 2):
                high -= 1
                continue
            if a + b > best:
                best, found = a + b, (a, b)
                if best == most:
                    break
            low += 1
        return found


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes into lengths."""
    left, bins = Lengths(lengths), []
    while left.sizes:
        free, own = capacity, []
        while (n := left.longest(free)) is not None:
            own.append(left.take(n))
            free -= n
        if free and len(own) > 1 and left.sizes:
            smallest = lengths[own[-1]]
            if two := left.best_two(free + smallest, smallest):
                gone = own.pop()
                own += [left.take(two[0]), left.take(two[1])]
                left.give(smallest, gone)
        bins.append(own)
    return bins


def _pack(capacity: int):
    def run(key: tuple, shard: pa.Table) -> pa.Table:
        order = shard.sort_by([("_id", "ascending"), ("piece", "ascending"), ("crc", "ascending")])
        lengths = order.column("length").to_pylist()
        bins = best_two_fit(lengths, capacity)
        base, sequence, offset = key[0].as_py() << 40, [0] * len(lengths), [0] * len(lengths)
        for k, own in enumerate(bins):
            place = 0
            for i in own:
                sequence[i], offset[i] = base + k, place
                place += lengths[i]
        return order.drop_columns(["shard"]).append_column("sequence", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of docs."""
    cut = written(pieces(docs, id_col, text_col, path, capacity, end_id), "pieces")
    shards = max(1, -(-cut.count() // SHARD))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    kind = cut.schema["_id"].dataType.simpleString()
    packed = dealt.groupBy("shard").applyInArrow(_pack(capacity), f"_id {kind}, piece int, start long, length long, crc long, sequence long, offset long")
    return packed.select(F.col("_id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), F.col("sequence").alias("sequence_id"), "offset")


def query(spark, sf_dir: str) -> DataFrame:
    from foliant.llm.common import table

    return pack(table(spark, sf_dir, "documents"))
