"""Generating questions with an injected generator, resumable, and reading its answers.

The generator is a callable from a list of requests to a list of answers (None: try again later). It runs inside Arrow batches; what is
done already is left out by an anti-join, so a lost or stopped run goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wikiloom.functions import text as X

Generator = Callable[[list[str]], list[str | None]]


def pending(pages: DataFrame, done: DataFrame) -> DataFrame:
    """i, j, passage of the paragraphs of pages (i, text) that are not done (i, j) and not broken off."""
    rows = pages.select("i", F.posexplode("text").alias("j", "passage")).where(F.col("passage").isNotNull() & ~F.col("passage").endswith(" ."))
    return rows.join(done.select("i", "j").distinct(), ["i", "j"], "left_anti")


def what_share(questions: DataFrame, column: str = "question") -> float:
    """The share of the questions so far that begin with what; one number."""
    return questions.agg(F.coalesce(F.avg((X.question_word(column) == "what").cast("int")), F.lit(0.0))).first()[0]


def generate(rows: DataFrame, generator: Generator, n_positive: int = 3, n_negative: int = 3, what: bool = True, size: int = 64) -> DataFrame:
    """i, j, passage, positive, negative: the answers of the generator, read; rows without an answer are left out for the next run."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                answers = generator(part.column(3).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(answers, pa.string())], names=["i", "j", "passage", "response"])

    asked = rows.select(F.col("i").cast("long").alias("i"), F.col("j").cast("int").alias("j"), "passage", X.prompt(n_positive, n_negative, "passage", what).alias("request"))
    got = asked.mapInArrow(run, "i long, j int, passage string, response string").where("response is not null")
    return got.select("i", "j", "passage", X.response("response", n_positive).alias("r")).select("i", "j", "passage", "r.positive", "r.negative")


def adaptive(rows: DataFrame, done: DataFrame, generator: Generator, limit: float = 0.25, **kw) -> DataFrame:
    """generate(), asking for no what-questions once more than `limit` of the questions done (i, j, positive) are of that kind."""
    said = done.select(F.explode("positive").alias("question"))
    return generate(rows, generator, what=what_share(said) <= limit, **kw)


def attach(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """pages (i, ...) with positive and negative lists that follow text; paragraphs without an answer have empty ones.

    A third positive question becomes a negative one.
    """
    none = F.array().cast("array<string>")
    three = F.size("positive") == 3
    a = answers.dropDuplicates(["i", "j"]).select(
        "i", "j", F.when(three, F.slice("positive", 1, 2)).otherwise(F.col("positive")).alias("positive"), F.when(three, F.concat("negative", F.slice("positive", 3, 1))).otherwise(F.col("negative")).alias("negative")
    )
    slots = pages.select("i", F.posexplode("text").alias("j", "_p"))
    rows = slots.join(a, ["i", "j"], "left").groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", F.coalesce("positive", none).alias("p"), F.coalesce("negative", none).alias("n")))).alias("q"))
    lists = rows.select("i", F.transform("q", lambda x: x["p"]).alias("positive"), F.transform("q", lambda x: x["n"]).alias("negative"))
    return pages.join(lists, "i", "left")


def own_words(question: Column, passage: Column) -> Column:
    """A list of the question if it asks and is not just a piece of the passage, else an empty list."""
    q = F.trim(question)
    asks = q.endswith("?") & ~F.contains(passage, F.regexp_replace(q, r"\?", ""))
    return F.when(asks, F.array(q)).otherwise(F.array().cast("array<string>"))
