"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of a seed lexicon and of one learned from the sample of labelled rows, as written and after
obfuscation is undone; second-person words near lexicon words; capitals; punctuation; rates of obfuscated words. Neither
labels nor lang, source or doc_id are inputs of a score. The model is fitted on at most MAX_LABELS labelled rows outside
the held-out fold; the isotonic map is fitted on scores of trees that didn't see the row.

Defined results: a null text counts as empty, and an empty text has the score of zero features. Without labels, or with
labels of one kind, every score is the (shrunk) rate of label 1, 0.5 if there is none. Rows that repeat get equal scores;
a null id is scored and held out by null. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import boosting
from foliant.llm.common import picked, shipped, slices
from foliant.llm.labels import MAX_LABELS, remainder, sample

#: Words that insult, in the languages of the corpus. The learned lexicon adds what the labels show.
SEED = frozenset(
    """idiot idiots stupid moron morons loser losers trash garbage scum clown clowns pathetic worthless disgusting dumb fool fools
    imbecile jerk creep freak vermin filth filthy lowlife degenerate bastard bitch asshole shit bullshit crap fuck fucking fucker
    cunt whore slut retard retarded pig swine coward liar hateful ugly brainless braindead
    idiote stupide débile crétin imbécile connard connasse salaud salope ordure merde pourriture abruti
    dumm idiotin trottel depp arschloch scheiße scheisse schlampe abschaum widerlich erbärmlich wertlos dreckig
    estúpido estúpida idiota imbécil basura escoria asqueroso patético inútil tonto gilipollas mierda cabrón puta""".split()
)
SECOND = frozenset("you your yours yourself u ur youre tu toi ton ta tes vous votre vos du dich dir dein deine ihr euch te ti tú usted ustedes vosotros".split())
FEATURES = ["seed", "seed_log", "learned", "learned_log", "obfuscated", "near_second", "second", "capital_words", "upper", "exclaimed", "punctuation", "symbol", "stretched", "spelled_out", "distinct_hits", "digits_in_words"]
#: The learned lexicon holds word beginnings of STEM code points (marked *) and whole words, each in SUPPORT sampled rows
#: and SHARE of those of label 1, RATIO times as frequent in them as in the others. It is bounded by the sample: a row
#: adds its words, and each word of the lexicon takes up SHARE of the rows of label 1.
STEM, SUPPORT, SHARE, RATIO = range(3, 8), 5, 0.02, 8.0
#: Parts of the sample: each is scored by a lexicon and trees made from the others.
PARTS = 4
#: Letters of the shortest word that is looked for in a run of single letters.
SPELLED = 4
#: Words between a second-person word and a lexicon word that are near.
NEAR, CACHE = 5, 1 << 19
TREES = {"trees": 40, "depth": 3, "rate": 0.2, "least": 8}

_LEET = str.maketrans("013457@$!|€", "oieastasile")
_EDGES = "#$%&*.,;:!?\"'()[]{}<>|\\/^~=_-+…«»“”‘’¡¿"
_INNER = re.compile(r"[^\w]|_")
_RUN = re.compile(r"(.)\1{2,}")


def plain(word: str) -> str:
    """A word in lower case without the signs at its ends."""
    return word.strip(_EDGES).lower()


def undone(word: str) -> set[str]:
    """What an obfuscated word may stand for: signs for letters, signs between letters, stretched letters."""
    low = word.lower().strip("#%&*.,;:?\"'()[]{}<>\\/^~=_-+…«»“”‘’¡¿")
    out = set()
    for x in (low, low.rstrip("!")):
        for y in (x.translate(_LEET), x):
            y = _INNER.sub("", y)
            out |= {y, _RUN.sub(r"\1", y), _RUN.sub(r"\1\1", y)}
    out.discard("")
    return out


class _Codes(dict):
    """Bits of a word: 1 seed, 2 learned, 4 only after undoing, 8 second person, 16 all capitals, 32 stretched, 64 one letter, 128 digits between letters."""

    def __init__(self, learned: frozenset):
        super().__init__()
        self.learned = learned
        self.lengths = sorted({len(w) for w in SEED | learned if len(w) >= SPELLED and not w.endswith("*")})

    def spelled(self, run: str) -> bool:
        """Whether a word of the lexicon stands in a run of letters."""
        return any(run[i : i + n] in SEED or run[i : i + n] in self.learned for n in self.lengths for i in range(len(run) - n + 1))

    def knows(self, word: str) -> bool:
        return word in self.learned or any(f"{word[:k]}*" in self.learned for k in STEM if len(word) >= k)

    def __missing__(self, word: str) -> int:
        low = plain(word)
        code = (low in SEED) | 2 * self.knows(low) | 8 * (low in SECOND)
        if not code & 3 and (not low.isalpha() or _RUN.search(low)):
            tried = undone(word)
            hit = bool(tried & SEED) | 2 * any(map(self.knows, tried))
            code |= hit | 4 * bool(hit)
        letters = word.strip(_EDGES)
        code |= 16 * (len(letters) > 1 and letters.isupper()) | 32 * bool(_RUN.search(low)) | 64 * (len(letters) == 1 and letters.isalpha()) | 128 * bool(re.search(r"[^\W\d]\d+[^\W\d]", low))
        if len(self) >= CACHE:
            self.clear()
        self[word] = code
        return code


def features(text: str, codes: _Codes) -> list[float]:
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    code = np.fromiter(map(codes.__getitem__, words), np.int16, n)
    spelled = 0
    for start, end in _letter_runs(code):
        run = "".join(words[k].strip(_EDGES) for k in range(start, end)).lower()
        if codes.spelled(run):
            spelled += 1
            code[start] |= 1 | 2
    hits = np.flatnonzero(code & 3)
    second = np.flatnonzero(code & 8)
    near = 0
    if len(hits) and len(second):
        at = np.searchsorted(second, hits)
        gap = np.minimum(np.abs(second[np.minimum(at, len(second) - 1)] - hits), np.abs(second[np.maximum(at - 1, 0)] - hits))
        near = int((gap <= NEAR).sum())
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = len(raw)
    seed, learned = int((code & 1).astype(bool).sum()), int((code & 2).astype(bool).sum())
    share = lambda bit: float((code & bit).astype(bool).sum()) / n
    return [
        seed / n, float(np.log1p(seed)), learned / n, float(np.log1p(learned)), share(4), near / n, share(8), share(16), float(counts[65:91].sum()) / size,
        float(counts[33]) / size, float(counts[_PUNCTUATION].sum()) / size, float(counts[_SYMBOLS].sum()) / size, share(32), spelled / n, float(len({plain(words[k]) for k in hits})), share(128),
    ]


_PUNCTUATION, _SYMBOLS = np.array(list(b".,;:?\"'()-")), np.array(list(b"#$%&*+/<=>@[\\]^_`{|}~"))


def _letter_runs(code: np.ndarray) -> list[tuple[int, int]]:
    """Runs of four or more one-letter words."""
    single = np.concatenate([[0], (code & 64) > 0, [0]]).astype(np.int8)
    edge = np.diff(single)
    return [(s, e) for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True) if e - s >= 4]


def _computed(learned: frozenset):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(learned)
        for batch in slices(batches):
            rows = np.array([features(t.as_py(), codes) for t in batch.column(batch.num_columns - 1)]).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(rows[:, k]) for k in range(len(FEATURES)))], names=[*batch.schema.names[:-1], *FEATURES])

    return run


def lexicon(rows: DataFrame) -> frozenset:
    """Words far more frequent in rows of label 1, from (_label, _text)."""
    texts = rows.groupBy("_text").agg(F.max("_label").alias("_label"))  # copies count once
    words = F.array_distinct(F.split(F.lower("_text"), r"[^\p{L}\p{N}]+"))
    stems = F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(w, *[F.when(F.length(w) >= k, F.concat(F.substring(w, 1, k), F.lit("*"))) for k in STEM]))))
    tokens = texts.select("_label", F.explode(stems).alias("w")).where("length(w) > 2")
    seen = tokens.groupBy("w").agg(F.sum("_label").alias("hit"), F.count(F.lit(1)).alias("n")).where(F.col("hit") >= SUPPORT)
    total = texts.agg(F.sum("_label"), F.count(F.lit(1))).first()
    toxic, clean = max(1, total[0] or 0), max(1, (total[1] or 0) - (total[0] or 0))
    ratio = (F.col("hit") / toxic) / ((F.col("n") - F.col("hit") + 0.5) / clean)
    # a floor on the share of label 1 keeps out rare words that meet it by chance
    top = seen.where((ratio >= RATIO) & (F.col("hit") >= SHARE * toxic))
    return frozenset(r.w for r in top.select("w").collect())


def learn(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELS):
    """(learned lexicon, trees, isotonic knots), the same each time."""
    from foliant.llm.common import written

    # copies share a part, so that no score of a part has seen its texts
    part = F.pmod(F.xxhash64("_text"), F.lit(PARTS)).cast("int").alias("_part")
    own = written(sample(docs, labels, "toxic", 5, F.col("_fold") == 0, limit).select("_id", "_label", part, "_text"), "toxic-sample")
    words = lexicon(own)
    parts, y, x = _matrix(own, words)
    if len(set(y.tolist())) < 2:
        return words, None, float((y.sum() + 0.5) / (len(y) + 1))
    unseen = np.zeros(len(y))
    for k in range(PARTS):
        inside = parts != k
        if len(set(y[inside].tolist())) > 1 and not inside.all():
            _, _, clean = _matrix(own, lexicon(own.where(F.col("_part") != k)))
            unseen[~inside] = boosting.margin(boosting.boost(clean[inside], y[inside], **TREES), clean[~inside])
    return words, boosting.boost(x, y, **TREES), boosting.isotonic(unseen, y)


def _matrix(own: DataFrame, words: frozenset) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, label, features) of the sampled rows (_id, _label, _part, _text) under a lexicon, in an order that is the same each time."""
    kinds = f"_id {own.schema['_id'].dataType.simpleString()}, _label int, _part int, {', '.join(f'{f} double' for f in FEATURES)}"
    rows = sorted((tuple(r) for r in own.mapInArrow(_computed(words), kinds).collect()), key=lambda r: r[0])  # ids are told apart
    x = np.array([r[3:] for r in rows], float).reshape(len(rows), len(FEATURES))
    return np.array([r[2] for r in rows]), np.array([r[1] for r in rows], float), x


def _scored(trees, knots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([np.asarray(c) for c in batch.columns[1:]], axis=1) if batch.num_rows else np.zeros((0, len(FEATURES)))
            p = np.interp(boosting.margin(trees, x), *knots) if trees is not None else np.full(batch.num_rows, knots)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=["_id", "score"])

    return run


def classify(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of each row."""
    words, trees, knots = model
    base = picked(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    kind = base.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _scored(trees, knots)(_computed(words)(batches))

    scored = shipped(base).mapInArrow(run, f"_id {kind}, score double")
    return scored.select(F.col("_id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    from foliant.llm.common import table

    docs = table(spark, sf_dir, "documents")
    done = classify(docs, learn(docs, table(spark, sf_dir, "labels")))
    return done.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
