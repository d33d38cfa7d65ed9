"""A caller's model over many prompts: tries again, a bounded rate, and answers that are kept."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed
from ledgerloom.shared import Table, stage

#: Prompts whose answers are kept at once: what a job that stops loses at most.
BLOCK = 10_000
KEY = "_prompt_key"


def tried(call: Callable[[str], str], prompt: str, tries: int, wait: float) -> tuple[str | None, str | None]:
    """The answer, or after so many tries the last error; a wait after each but the last, twice as long each time."""
    for n in range(tries):
        try:
            return call(prompt), None
        except Exception as e:  # a caller's function may fail in any way
            error = f"{type(e).__name__}: {e}"
            if n + 1 < tries:
                time.sleep(wait * 2**n)
    return None, error


def answers(prompts: DataFrame, prompt: str, call: Callable[[str], str], path: str, tries: int = fixed.MODEL_TRIES, wait: float = fixed.MODEL_WAIT, per_second: float | None = None, tasks: int = 8) -> DataFrame:
    """prompts with answer and error: each different prompt is asked once, and none that the table at path has an answer to.

    call runs in tasks, one prompt at a time. Prompts are dealt to so many tasks, which together
    begin at most per_second calls a second. What fails has an error in place of an answer, isn't
    kept, and is asked again by the next run. Answers are kept block by block, so a job that
    stops goes on from the last block. Null prompts have neither answer nor error. Columns answer
    and error of the prompts are replaced.
    """
    spark, table = prompts.sparkSession, Table(prompts.sparkSession, path)
    rows = prompts.drop("answer", "error").withColumn(KEY, F.sha2(F.col(prompt), 256))
    asked = rows.where(F.col(prompt).isNotNull()).groupBy(KEY).agg(F.first(prompt).alias("prompt"))
    held = table.read()
    new = stage(asked.join(held.select(KEY), KEY, "left_anti") if held is not None else asked, "prompts")
    gap = tasks / per_second if per_second else 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        free = 0.0
        for pdf in batches:
            out = []
            for key, text in zip(pdf[KEY], pdf["prompt"]):
                time.sleep(max(0.0, free - time.monotonic()))
                free = time.monotonic() + gap
                out.append((key, *tried(lambda p: _said(call, p), text, tries, max(wait, gap))))
            yield pd.DataFrame(out, columns=[KEY, "answer", "error"])

    failed = None
    blocks = -(-new.count() // BLOCK)
    for b in range(blocks):
        block = new.where(F.pmod(F.xxhash64(KEY), F.lit(blocks)) == b).repartition(tasks, KEY)
        got = stage(block.mapInPandas(run, f"{KEY} string, answer string, error string"), "answers")
        table.merge(got.where("error IS NULL").select(KEY, "answer"), [KEY], lambda both: both.groupBy(KEY).agg(F.min("answer").alias("answer")))
        bad = got.where("error IS NOT NULL").select(KEY, "error")
        failed = bad if failed is None else failed.union(bad)
    held = table.read()
    none = spark.createDataFrame([], f"{KEY} string, answer string, error string")
    held = none.select(KEY, "answer") if held is None else held
    failed = none.select(KEY, "error") if failed is None else failed
    return rows.join(held, KEY, "left").join(failed, KEY, "left").drop(KEY)


def _said(call: Callable[[str], str], prompt: str) -> str:
    """What call says, as a string: a model that says nothing has failed."""
    said = call(prompt)
    if said is None:
        raise ValueError("no answer")
    return str(said).strip()
