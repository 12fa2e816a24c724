"""Quality classifier: a sparse rule ensemble.

Boosted trees over statistics of a text give conjunctive rules (their paths); lasso logistic regression weighs them and
sets most to zero; what is left is compiled into Spark column expressions over the statistics. Neither labels nor lang,
source or doc_id are inputs of a score. The model is fitted on at most MAX_LABELS labelled rows outside the held-out fold.

Defined results: a null text counts as empty, and an empty text has the score of its statistics, all zero. Without
labels, or with labels of one kind, the score is the (shrunk) rate of label 1, 0.5 if there is none. Rows that repeat
get equal scores; a null id is scored and held out by null. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm import boosting
from foliant.llm.common import numbered, picked, shipped, slices
from foliant.llm.labels import MAX_LABELS, remainder, sample

STATISTICS = ["log_chars", "log_words", "word_length", "upper", "digit", "punctuation", "symbol", "space", "non_ascii", "distinct_words", "line_length", "repeated_lines", "repeated_words", "no_letter_words", "exclaimed", "sentence_ends"]
#: Their columns, under names that a caller's won't clash with.
COLUMNS = [f"_stat_{s}" for s in STATISTICS]
#: Strength of the lasso, which chooses among all distinct rules.
STRENGTH = 0.002

_BYTES = np.arange(256)
_CLASSES = {
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "punctuation": np.isin(_BYTES, list(b".,;:!?\"'()-")),
    "symbol": np.isin(_BYTES, list(b"#$%&*+/<=>@[\\]^_`{|}~")),
    "space": np.isin(_BYTES, list(b" \t\n\r")),
    "non_ascii": _BYTES >= 128,
}
_WEIGHTS = np.stack([m.astype(float) for m in _CLASSES.values()], axis=1)


def statistics(text: str) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, digit, punctuation, symbol, space, non_ascii = (counts @ _WEIGHTS / n).tolist()
    words, lines = raw.split(), raw.split(b"\n")
    n_words, distinct = len(words), set(words)
    pairs = sum(map(bytes.__eq__, words, words[1:]))
    plain = sum(not w.isdigit() and w.strip(b"#$%&*+/<=>@[\\]^_`{|}~.,;:!?\"'()-0123456789") == b"" for w in distinct)
    ends = counts[46] + counts[63] + counts[33]
    return [
        float(np.log1p(n)), float(np.log1p(n_words)), (n - int(counts[32]) - int(counts[10])) / max(1, n_words), upper, digit, punctuation, symbol, space, non_ascii,
        len(distinct) / max(1, n_words), float(np.log1p(n / len(lines))), 1 - len(set(lines)) / len(lines), pairs / max(1, n_words), plain / max(1, len(distinct)), float(counts[33]) / n, float(ends) / max(1, n_words),
    ]


def _computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = np.array([statistics(t.as_py()) for t in batch.column(batch.num_columns - 1)]).reshape(batch.num_rows, len(STATISTICS))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(rows[:, k]) for k in range(len(STATISTICS)))], names=[*batch.schema.names[:-1], *COLUMNS])


def with_statistics(df: DataFrame) -> DataFrame:
    """df, whose last column is the text, with statistics in its place."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1])
    return shipped(df).mapInArrow(_computed, f"{kept}, {', '.join(f'{c} double' for c in COLUMNS)}")


def fit(rows: list) -> tuple[float, list[tuple[tuple, float]]]:
    """(intercept, [(rule, weight)]) from rows of (label, *statistics)."""
    y = np.array([r[0] for r in rows], float)
    if len(set(y.tolist())) < 2:
        p = (y.sum() + 0.5) / (len(y) + 1)
        return float(np.log(p / (1 - p))), []
    x = np.array([r[1:] for r in rows], float)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    _, trees = boosting.boost(x, y, trees=30, depth=3, rate=0.3, least=max(3, min(20, len(y) // 50)), weight=np.minimum(weight, 10))
    found = list(dict.fromkeys(r for t in trees for r in boosting.paths(t)))
    hits = np.stack([boosting.rule_values(r, x) for r in found], axis=1).astype(float) if found else np.zeros((len(y), 0))
    spread = hits.std(axis=0)
    order = np.argsort(-np.abs((hits - hits.mean(axis=0)).T @ (y - y.mean())) / np.maximum(spread, 1e-9), kind="stable")
    order = [k for k in order if spread[k] > 0]
    base, w = boosting.lasso_logistic(hits[:, order], y, STRENGTH)
    return base, [(found[k], float(v)) for k, v in zip(order, w, strict=True) if v]


def score_column(model: tuple[float, list[tuple[tuple, float]]], features: list[Column]) -> Column:
    base, rules = model
    z = reduce(lambda a, b: a + b, [F.when(boosting.rule_column(r, features), F.lit(w)).otherwise(F.lit(0.0)) for r, w in rules], F.lit(base))
    return 1 / (1 + F.exp(-z))


def learn(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELS):
    """The model fitted on labels.quality outside the held-out fold; its rows are ordered, so that it is the same each time."""
    own = with_statistics(sample(docs, labels, "quality", 3, F.col("_fold") == 1, limit).select("_id", "_label", "_text"))
    return fit([tuple(r)[1:] for r in sorted(own.collect(), key=tuple)])


def classify(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of each row."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text")
    done = with_statistics(picked(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("_id"), text))
    scored = done.select("_id", score_column(model, [F.col(c) for c in COLUMNS]).alias("score"))
    return scored.select(F.col("_id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """The rows of docs that the model predicts as label 1, with the columns that docs has."""
    rows = numbered(docs)
    text = F.coalesce(F.col(f"c{docs.columns.index(text_col)}").cast("string"), F.lit("")).alias("_text")
    done = with_statistics(rows.select("*", text))
    return done.where(score_column(model, [F.col(c) for c in COLUMNS]) >= 0.5).select(*rows.columns).toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    from foliant.llm.common import table

    docs = table(spark, sf_dir, "documents")
    done = classify(docs, learn(docs, table(spark, sf_dir, "labels")))
    return done.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
