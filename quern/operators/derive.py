"""Model-backed stages over nodes; each appends its derived nodes to those it gets.

Rows go to the provider in Arrow batches, several calls in flight (quern.operators.asking)."""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern import schema
from quern.functions import images as image_functions
from quern.functions import text
from quern.operators import asking, chunking
from quern.operators.nodes import with_flags
from quern.providers import ENTITY_KINDS, Providers, Request, Vision, retrying

#: Title endings of derived nodes.
ENDINGS = {"entities": "_entities", "summary": "_summary", "key_takeaways": "_takeaways", "image_description": "_image_description", "plot_insights": "_plot_insights", "image_entities": "_image_entities", "table_analysis": "_analysis"}


#: What the nodes that stages make need of those they are made from.
_KEPT = ("node_id", "page_id", "title", "context", "source_id", "ord")


def _of_text(stage: str):
    return lambda text, title, context: None if text is None else Request(stage, text, title or "", context or "")


def _of_image(stage: str):
    return lambda data, title, context: Request(stage, None, title or "", context or "", image_functions.thumbnail(data))


def _smaller(data: bytes) -> bytes | None:
    return image_functions.as_png(data, box=image_functions.SHOWN // 2) or data


def _answers(parents: DataFrame, p: Providers, kind: str, image_stage: bool, sound=None) -> DataFrame:
    """_KEPT of the parents with _answer, _tokens and _tries, counted on the way."""
    what = F.col("image_data" if image_stage else "text")
    asked = asking.ask(p.vision if image_stage else p.text, (_of_image if image_stage else _of_text)(kind), what, F.col("title"), F.col("context"), pace=getattr(p, "pace", None), smaller=_smaller, sound=sound)
    rows = asking.with_answers(parents.select(*_KEPT, "image_data" if image_stage else "text"), asked)
    counters = getattr(p, "counters", None)
    return counters.asked(rows, kind, image_stage) if counters else rows


def _derived(parents: DataFrame, p: Providers, kind: str, image_stage: bool = False) -> DataFrame:
    rows = _answers(parents, p, kind, image_stage).where(text.usable_answer(F.col("_answer"), image_stage))
    return schema.as_nodes(rows.select(
        schema.node_id(F.col("page_id"), F.lit(kind), F.col("node_id")).alias("node_id"), "page_id", F.lit("text").alias("kind"), F.lit(kind).alias("type"), F.concat("title", F.lit(ENDINGS[kind])).alias("title"),
        F.col("_answer").alias("text"), "context", F.col("node_id").alias("parent_id"), "source_id", F.lit(True).alias("needs_embedding"), "ord",
    ))


def _text_stage(nodes: DataFrame, p: Providers, kind: str, types: tuple[str, ...], only_new: bool) -> DataFrame:
    new = _derived(nodes.where(F.col("type").isin(*types)), p, kind)
    return new if only_new else nodes.unionByName(new)


def entities(nodes: DataFrame, p: Providers, only_new: bool = False) -> DataFrame:
    return _text_stage(nodes, p, "entities", ("section", "subsection"), only_new)


def summaries(nodes: DataFrame, p: Providers, only_new: bool = False) -> DataFrame:
    return _text_stage(nodes, p, "summary", ("section", "subsection"), only_new)


def key_takeaways(nodes: DataFrame, p: Providers, only_new: bool = False) -> DataFrame:
    return _text_stage(nodes, p, "key_takeaways", ("section", "subsection"), only_new)


def table_analysis(nodes: DataFrame, p: Providers, only_new: bool = False) -> DataFrame:
    return _text_stage(nodes, p, "table_analysis", ("table",), only_new)


def _image_stage(nodes: DataFrame, p: Providers, kind: str, types: tuple[str, ...], only_new: bool) -> DataFrame:
    new = _derived(nodes.where((F.col("kind") == "image") & F.col("type").isin(*types)), p, kind, True)
    return new if only_new else nodes.unionByName(new)


def image_descriptions(nodes: DataFrame, p: Providers, only_new: bool = False) -> DataFrame:
    return _image_stage(nodes, p, "image_description", ("image", "plot"), only_new)


def image_entities(nodes: DataFrame, p: Providers, only_new: bool = False) -> DataFrame:
    return _image_stage(nodes, p, "image_entities", ("image",), only_new)


def plot_insights(nodes: DataFrame, p: Providers, only_new: bool = False) -> DataFrame:
    return _image_stage(nodes, p, "plot_insights", ("plot",), only_new)


def classified(images: DataFrame, provider: Vision, pace: asking.Pace | None = None) -> DataFrame:
    """rows with `answer`; images under 50 pixels either way go, unreadable ones stay.  Rows with neither
    data nor a name are no images: they stay and are not asked about."""

    def request(data, name):
        return None if data is None and name is None else Request("classify", title=name or "", image=image_functions.for_classifier(data))

    kept = images.where(~F.coalesce(image_functions.too_small(F.col("image_data")), F.lit(False)))
    asked = asking.ask(provider, request, F.col("image_data"), F.col("image_name"), pace=pace, smaller=_smaller)
    held = kept.withColumn("_asked", asked)
    return held.withColumn("answer", F.when(F.col("_asked.tries") > 0, F.coalesce(F.when(F.col("_asked.answer") != "", F.col("_asked.answer")), F.lit("sensitive_image")))).drop("_asked")


def chunks(nodes: DataFrame, p: Providers, buffer: int = 1, percentile: float = 0.7, only_new: bool = False) -> DataFrame:
    """Chunk nodes of sections and subsections, and the embedding flag of all others."""
    source = nodes.where(F.col("type").isin("section", "subsection"))

    keys = ["page_id", "node_id", "title", "source_id", "ord"]
    rows = chunking.chunk_rows(source, keys, "text", p.embedding.embed, buffer, percentile).withColumnRenamed("chunk_no", "pos")
    new = schema.as_nodes(rows.select(
        schema.node_id(F.col("page_id"), F.lit("chunk"), F.concat_ws("#", "node_id", "pos")).alias("node_id"), "page_id", F.lit("text").alias("kind"), F.lit("chunk").alias("type"),
        F.concat("title", F.lit("_chunk_"), "pos").alias("title"), F.col("chunk").alias("text"), F.col("node_id").alias("parent_id"), "source_id", F.lit(True).alias("needs_embedding"), "pos", "ord",
    ))
    return new if only_new else with_flags(nodes).unionByName(new)


def embedded(nodes: DataFrame, p: Providers) -> DataFrame:
    """(node columns..., embedding): flagged text nodes get a vector; so do flagged images and plots
    where there is a model for images, else they have none."""

    pace = getattr(p, "pace", None) or asking.Pace()
    models = [(p.embedding, "embed")] + ([(p.images, "embed_images")] if p.images else [])

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        """Parts of `batch` rows (all, if the model does not say) are calls of their own, several at once."""
        with ThreadPoolExecutor(pace.in_flight) as pool:
            for columns in batches:
                out: list = [None] * len(columns[0])
                calls = []
                for own, (model, name) in zip(columns, models):
                    rows = [i for i, t in enumerate(own) if t is not None]
                    step = getattr(model, "batch", len(rows)) or 1
                    calls += [(getattr(model, name), own, rows[i : i + step]) for i in range(0, len(rows), step)]
                for (_, _, rows), made in zip(calls, pool.map(lambda c: retrying(lambda: c[0]([c[1].iloc[i] for i in c[2]])), calls)):
                    for i, v in zip(rows, made if made is not None else [None] * len(rows)):
                        out[i] = None if v is None else [float(x) for x in v]
                yield pd.Series(out, dtype=object)

    wanted = F.coalesce("needs_embedding", F.lit(False))
    text = F.when(wanted & (F.col("kind") == "text"), F.coalesce("text", F.lit("")))
    image = F.when(wanted & (F.col("kind") == "image") & F.lit(p.images is not None), F.col("image_data"))
    return nodes.withColumn("embedding", embed.asNondeterministic()(text, image))


#: How an answer to entity_rows is read: a list of entities for each kind.
_READ = ", ".join(f"{k} array<struct<name: string, context: string>>" for k in ENTITY_KINDS)


def _sound_entities(answer: str) -> bool:
    """Whether an answer is a JSON object with a list of named entities for each kind."""
    try:
        got = json.loads(answer)
        return all(isinstance(e["name"], str) and isinstance(e.get("context", ""), str) for k in ENTITY_KINDS for e in got[k])
    except (ValueError, KeyError, TypeError, AttributeError):
        return False


def entity_answers(nodes: DataFrame, p: Providers) -> DataFrame:
    """(node_id, page_id, answer, tries, sound, found): what sections and subsections hold, as a model's
    structured answer, read.  An answer of another form is asked for once more; if the second is no better
    it is kept as it came, with found null.  Write this before it is used twice: it is the only asking."""
    rows = _answers(nodes.where(F.col("type").isin("section", "subsection")), p, "entity_rows", False, _sound_entities)
    read = F.from_json("_answer", _READ, {"mode": "PERMISSIVE"})
    whole = F.forall(F.array(*[F.coalesce(F.col(f"found.{k}").isNotNull() & F.forall(f"found.{k}", lambda e: e["name"].isNotNull()), F.lit(False)) for k in ENTITY_KINDS]), lambda x: x)
    out = rows.select("node_id", "page_id", F.col("_answer").alias("answer"), F.col("_tries").alias("tries"), read.alias("found"))
    return out.withColumn("sound", F.coalesce(whole, F.lit(False)))


def mentions(answers: DataFrame) -> DataFrame:
    """(entity_id, kind, name, context, node_id, page_id): a row for each entity of each section, the edges
    from sections to entities.  An entity is a kind and a name, letter case aside, so pages meet in it; blank names are none."""

    def of_kind(kind):
        return lambda e: F.struct(F.lit(kind).alias("kind"), F.trim(e["name"]).alias("name"), e["context"].alias("context"))

    each = [F.transform(F.col(f"found.{k}"), of_kind(kind)) for k, kind in ENTITY_KINDS.items()]
    rows = answers.where("sound").select("node_id", "page_id", F.explode(F.flatten(F.array(*each))).alias("e")).select("e.*", "node_id", "page_id").where("name != ''")
    rows = rows.withColumn("entity_id", F.sha2(F.concat_ws("|", "kind", F.lower("name")), 256))
    once = rows.groupBy("entity_id", "node_id").agg(F.min(F.struct("kind", "name", "context", "page_id")).alias("e"))
    return once.select("entity_id", "e.kind", "e.name", "e.context", "node_id", "e.page_id")


def entity_table(found: DataFrame) -> DataFrame:
    """(entity_id, kind, name, sections, pages) out of mentions: each entity once, under its least spelling."""
    return found.groupBy("entity_id", "kind").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("sections"), F.count_distinct("page_id").alias("pages"))


def broken_answers(answers: DataFrame) -> DataFrame:
    """(node_id, page_id, answer, tries) of answers that could not be read."""
    return answers.where("not sound and answer is not null").select("node_id", "page_id", "answer", "tries")


def counts(nodes: DataFrame) -> DataFrame:
    """(images, plots): how many image nodes of either type there are."""
    image = F.col("kind") == "image"
    return nodes.agg(F.count_if(image & (F.col("type") == "image")).alias("images"), F.count_if(image & (F.col("type") == "plot")).alias("plots"))
