"""External models behind a guarded channel: a model is any function of texts; what it gives is accepted by native expressions.

A model that fails, or whose answer isn't accepted after the retries, leaves the row for review: nothing is lost and
nothing wrong gets through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from foliant.functions.likeness import alike
from foliant.functions.text import CJK, first_json_object, looks_math, tags_of, year_of
from foliant.operators.validate import latex_problems
from foliant.session import give_back, ship, written

#: Bounds of an acceptable correction: growth and likeness.
GROWTH, SLACK, LIKENESS = 3, 300, 0.55
#: Rows that go to the model together: a batch is answered in parts, so that few answers are held at once.
CALL_ROWS = 500


class TextModel(Protocol):
    """Texts in, one answer and its cost in tokens for each."""

    def __call__(self, texts: list[str]) -> list[tuple[str, int]]: ...


def stub(texts: list[str]) -> list[tuple[str, int]]:
    """A deterministic stand-in: a Chinese mark before the text; every seventh answer is empty."""
    return [("" if len(t) % 7 == 0 else f"译{t}", len(t) // 4 + 1) for t in texts]


def answers(rows: DataFrame, text: str, model: TextModel, name: str = "answer") -> DataFrame:
    """rows with the model's answer and its tokens; CALL_ROWS rows of a partition go to the model together."""
    ship(rows.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), CALL_ROWS):
                batch = whole.iloc[at : at + CALL_ROWS]
                got = model(batch[text].fillna("").tolist())
                yield batch.assign(**{name: [a for a, _ in got], "tokens": [t for _, t in got]})
        give_back()

    return rows.mapInPandas(run, f"{fields}, `{name}` string, tokens long")


def translation_accepted(source: Column, answer: Column) -> Column:
    """Not blank, and with a Chinese character if the source is long; as many lines."""
    lines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    return answer.rlike(r"\S") & ((F.length(source) <= 40) | answer.rlike(CJK)) & (lines(source) == lines(answer))


def translated(rows: DataFrame, text: str, model: TextModel, accepted: Callable[[Column, Column], Column] = translation_accepted, retries: int = 2) -> DataFrame:
    """rows with answer, tokens, tries and state: mt where accepted, needs_review after the last try.

    Each retry takes only the rows that failed. Each try is written before it is judged, so that no call is made twice:
    what a call cost stays spent, and a model may answer differently each time.
    """
    todo, done = rows.withColumn("_spent", F.lit(0).cast("long")), None
    for attempt in range(1, retries + 2):
        tried = written(answers(todo, text, model), "answers")
        sound = accepted(F.col(text), F.col("answer"))
        spent = tried.withColumn("_spent", F.col("_spent") + F.col("tokens")).withColumn("_ok", F.coalesce(sound, F.lit(False)))
        last = attempt == retries + 1
        state = F.when(F.col("_ok"), "mt").otherwise("needs_review")
        out = (spent if last else spent.where("_ok")).select(*rows.columns, F.when(F.col("_ok"), F.col("answer")).alias("answer"), F.col("_spent").alias("tokens"), F.lit(attempt).alias("tries"), state.alias("state"))
        done = out if done is None else done.unionByName(out)
        todo = spent.where("not _ok").select(*rows.columns, "_spent")
    return done


def change_refused(old: str | None, new: str | None) -> str:
    """Why a correction isn't acceptable; empty if it is."""
    a, b = (old or "").strip(), (new or "").strip()
    if not b:
        return "empty"
    if a == b:
        return "unchanged"
    if len(b) > GROWTH * len(a) + SLACK:
        return "grown"
    return "" if alike(a, b, LIKENESS) else "rewritten"


def _verdicts(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([change_refused(a, b) for a, b in zip(old, new, strict=True)])


def change_verdict(old: Column, new: Column) -> Column:
    """change_refused() over columns, in Arrow batches."""
    return F.pandas_udf(_verdicts, StringType())(old, new)


def latex_accepted(source: Column, answer: Column) -> Column:
    """A typeset text is accepted if nothing speaks against it; numbering may move to a neighbour, so it is compared by chunk."""
    return F.size(latex_problems(source, answer, numbers=False)) == 0


def latexized(blocks: DataFrame, model: TextModel, retries: int = 1) -> DataFrame:
    """blocks (…, type, en) that look like mathematics with en typeset where a try was accepted; state latexized or needs_review, and the tokens spent."""
    todo = blocks.where(looks_math(F.col("en"), F.col("type")))
    done = translated(todo, "en", model, latex_accepted, retries)
    took = F.col("state") == "mt"
    return done.select(*[c for c in blocks.columns if c != "en"], F.when(took, F.trim("answer")).otherwise(F.col("en")).alias("en"), F.when(took, "latexized").otherwise("needs_review").alias("state"), "tokens", "tries")


def metadata(heads: DataFrame, model: TextModel) -> DataFrame:
    """(paper_id, title, year, tags) from (paper_id, text): a model's JSON, whatever stands around it, each field checked; nulls where it fails."""
    got = answers(heads.select("paper_id", "text"), "text", model).select("paper_id", first_json_object(F.col("answer")).alias("j"))
    field = lambda name: F.get_json_object("j", f"$.{name}")
    return got.select("paper_id", F.nullif(F.trim(field("title")), F.lit("")).alias("title"), year_of(field("year")).alias("year"), tags_of(F.coalesce(field("tags"), F.lit(""))).alias("tags"))
