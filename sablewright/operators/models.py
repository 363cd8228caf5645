"""Calls of injected models as table operators: tries, waits and fallbacks, and what is made of the answers.

A model is any function from a prompt to an answer. Prompts are columns; the engine holds none.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sablewright.functions.text import clipped
from sablewright.operators.protocol import json_rows


def asked(prompts: DataFrame, key: str, prompt: str, model: Callable[[str], str | None], tries: int = 3, wait: float = 1.0, fallback: str | None = None) -> DataFrame:
    """(key, answer, error, n_tries): the model's answer to each prompt.

    An empty answer or an exception is tried again, after a wait that grows by itself each time; when the tries are used up
    the fallback stands, with the last error. A null prompt is not asked. Calls run where the rows are, a batch at a time; a
    task that is run again asks again, so a model with side effects must bear that.
    """
    kind = prompts.schema[key].dataType.simpleString()

    def ask(text: str | None) -> tuple[str | None, str | None, int]:
        if text is None:
            return fallback, "no_prompt", 0
        error = None
        for n in range(1, tries + 1):
            try:
                answer = (model(text) or "").strip()
                if answer:
                    return answer, None, n
                error = "empty_response"
            except Exception as e:  # noqa: BLE001  (whatever a model raises)
                error = f"{type(e).__name__}: {e}"
            if n < tries and wait:
                time.sleep(wait * n)
        return fallback, error, tries

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = [None if x is None or x != x else x for x in part["__prompt"]]
            rows = [ask(t) for t in texts]
            yield pd.DataFrame({"__key": part["__key"], "answer": [r[0] for r in rows], "error": [r[1] for r in rows], "n_tries": [r[2] for r in rows]})

    out = prompts.select(F.col(key).alias("__key"), F.col(prompt).alias("__prompt")).mapInPandas(run, f"__key {kind}, answer string, error string, n_tries long")
    return out.withColumnRenamed("__key", key)


def decided(answers: DataFrame, key: str = "mention_id") -> DataFrame:
    """Decisions from answers that are one JSON object each: (key, decision, entity_id); others give none."""
    rows = answers.withColumn("__r", json_rows(F.col("answer"), single=True)).where("__r.status = 'parsed_single_object'")
    one = rows.select(key, F.from_json(F.col("__r.rows")[0], "decision string, entity_id string").alias("d"))
    return one.select(key, "d.decision", "d.entity_id").where("decision in ('new', 'merge')")


def variants_of(questions: DataFrame, answers: DataFrame, rules: Callable[[str], list[str]], key: str = "question_id", text: str = "question") -> DataFrame:
    """(key, variants): each question first, then what the model's JSON list adds; the rules' variants where it gives none."""

    @F.pandas_udf("array<string>")
    def by_rule(s: pd.Series) -> pd.Series:
        return s.map(lambda q: rules(q or ""))

    listed = F.from_json(F.regexp_extract("answer", r"(?s)\[.*?\]", 0), "array<string>")
    j = questions.select(key, text).join(answers.select(key, listed.alias("__list")), key, "left")
    made = F.when(F.size("__list") > 0, F.concat(F.array(text), F.filter("__list", lambda v: v.isNotNull() & (v != F.col(text)))))
    return j.select(key, F.coalesce(made, by_rule(text)).alias("variants"))


def rewriting_prompt(question: Column, context: Column, labels: Column, most_context: int = 4000, most_labels: int = 8) -> Column:
    """The bounded context that a question is rewritten with; null if there is nothing to rewrite it by."""
    named = F.array_join(F.slice(F.coalesce(labels, F.array().cast("array<string>")), 1, most_labels), "; ")
    talk = clipped(context, most_context)
    return F.when((named != "") | (talk != ""), F.concat_ws("\n", F.nullif(named, F.lit("")), F.nullif(talk, F.lit("")), question))


def rewritten(question: Column, answer: Column, most: int = 500) -> Column:
    """The rewritten question: the answer if it is one line of bounded length, else the question as it was."""
    line = F.trim(F.coalesce(answer, F.lit("")))
    return F.when((line != "") & (F.length(line) <= most) & ~F.contains(line, F.lit("\n")), line).otherwise(question)
