"""Answers by rounds, for many questions at once: draft, look what the facts don't bear out, search for that again.

Questions are rows, and a round is the same few jobs however many there are: one search for all that is asked in
it, one stage of drafts, one of checks.  A question leaves with the round whose draft is borne out, or
with the last; what a round has found is written, so that no model is asked twice."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as texts
from quern.operators import asking
from quern.plans.answer import PROMPT
from quern.providers import DASHES, Providers, Request
from quern.sources.store import load_stage, remove, save_stage, scratch

#: Rounds at most; facts that a search adds.
ROUNDS, FACTS = 3, 5


def _vectors(queries: DataFrame, providers: Providers) -> DataFrame:
    model = providers.embedding

    @F.pandas_udf("array<double>")
    def embed(rows: pd.Series) -> pd.Series:
        return pd.Series([[float(x) for x in v] for v in model.embed(list(rows))], dtype=object)

    return queries.withColumn("vector", embed.asNondeterministic()("query"))


def _draft(question: str, facts: str) -> Request:
    return Request("answer", PROMPT.format(question=question, texts=facts or "none", images="none"))


def _check(draft: str | None, facts: str) -> Request | None:
    return None if not draft else Request("check", draft + DASHES + facts)


def answer_all(spark: SparkSession, questions: DataFrame, search: Callable[[DataFrame, int], DataFrame], nodes: DataFrame, providers: Providers | None = None, rounds: int = ROUNDS, facts: int = FACTS) -> DataFrame:
    """(question_id, answer, rounds, open): every question with its last draft, the round that made it, and the
    sentences of it that were not borne out, null if there are none.

    questions: (question_id, text).  search(queries (query_id, vector), k) gives (query_id, node_id, score), the
    search of a store or an index; nodes: (node_id, text).  Facts pile up over the rounds, in the order found:
    by round, sentence, rank; equal texts once.  A null question has no draft."""
    providers = providers or Providers()
    place = f"{scratch(spark)}/rounds-{uuid.uuid4().hex[:8]}"
    pace = getattr(providers, "pace", None)
    kind = questions.schema["question_id"].dataType.simpleString()

    def written(rows: DataFrame, name: str) -> DataFrame:
        save_stage(rows, f"{place}/{name}")
        return load_stage(spark, f"{place}/{name}")

    todo = questions.where("text is not null").select("question_id", F.col("text").alias("question"), F.array("text").alias("queries"), F.array().cast("array<struct<n:int,text:string>>").alias("known"))
    done = questions.where("text is null").select("question_id", F.lit(None).cast("string").alias("answer"), F.lit(0).alias("rounds"), F.lit(None).cast("array<string>").alias("open"))
    ends = [done]
    for n in range(1, rounds + 1):
        todo = written(todo, f"todo{n}")
        asked = todo.select("question_id", F.posexplode("queries").alias("place", "query"))
        asked = written(_vectors(asked, providers).withColumn("query_id", F.monotonically_increasing_id()), f"asked{n}")
        hits = search(asked.select("query_id", "vector"), facts).join(asked.select("query_id", "question_id", "place"), "query_id")
        hits = hits.join(nodes.select("node_id", F.col("text").alias("fact")).where("coalesce(fact, '') != ''"), "node_id")
        first = hits.groupBy("question_id", "fact").agg(F.min(F.struct("place", (-F.col("score")).alias("far"), "node_id")).alias("seen"))
        found = first.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("seen", "fact"))).alias("found"))
        both = todo.join(found, "question_id", "left")
        new = F.transform(F.coalesce("found", F.array().cast(found.schema["found"].dataType)), lambda x: F.struct(F.lit(n).alias("n"), x["fact"].alias("text")))
        old = F.transform("known", lambda x: x["text"])
        both = both.withColumn("known", F.concat("known", F.filter(new, lambda x: ~F.array_contains(old, x["text"]))))
        both = both.withColumn("facts", F.array_join(F.transform("known", lambda x: x["text"]), " "))
        drafts = both.withColumn("_d", asking.ask(providers.text, _draft, F.col("question"), F.col("facts"), pace=pace)).withColumn("draft", F.col("_d.answer")).drop("_d")
        drafts = written(drafts.select("question_id", "question", "known", "facts", "draft"), f"drafts{n}")
        checked = drafts.withColumn("_c", asking.ask(providers.text, _check, F.col("draft"), F.col("facts"), pace=pace)).withColumn("open", texts.query_lines(F.coalesce(F.col("_c.answer"), F.lit("")))).drop("_c")
        checked = written(checked, f"checked{n}")
        ended = (F.size("open") == 0) | F.lit(n == rounds)
        ends.append(checked.where(ended).select("question_id", F.col("draft").alias("answer"), F.lit(n).alias("rounds"), F.when(F.size("open") > 0, F.col("open")).alias("open")))
        todo = checked.where(~ended).select("question_id", "question", F.col("open").alias("queries"), "known")
        if n < rounds and todo.isEmpty():
            break
    out = ends[0]
    for e in ends[1:]:
        out = out.unionByName(e)
    result = written(out.select(F.col("question_id").cast(kind), "answer", "rounds", "open"), "answers")
    for n in range(1, rounds + 1):
        for name in ("todo", "asked", "drafts", "checked"):
            remove(spark, f"{place}/{name}{n}")
    return result
