"""From a question to an answer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.config import Config
from quern.operators import retrieval
from quern.providers import Providers, Request, retrying
from quern.sources.store import GraphStore


def expanded(question: str, providers: Providers, generated: int = 4) -> list[str]:
    """The question, then its rewrites; equal ones once, blank ones never."""
    answer = retrying(lambda: providers.text.complete(Request("queries", question))) or ""
    lines = [x.strip() for x in answer.strip().split("\n")]
    return list(dict.fromkeys([question, *[x for x in lines if x][:generated]]))


def query_table(spark: SparkSession, queries: list[str], providers: Providers) -> DataFrame:
    vectors = providers.embedding.embed(queries)
    return spark.createDataFrame([(i, q, [float(x) for x in v]) for i, (q, v) in enumerate(zip(queries, vectors))], "query_id int, text string, vector array<double>")


def fusion_retrieve(vectors: DataFrame | GraphStore, edges: DataFrame, nodes: DataFrame, queries: DataFrame, top_k: int = 10, config: Config | None = None) -> DataFrame:
    """Parents of the fused hits, by rank; from vectors, or by the search of a store, which may have an index."""
    r = (config or Config()).retrieval
    search = GraphStore.text_first if isinstance(vectors, GraphStore) else retrieval.text_first
    fused = retrieval.fuse(retrieval.run_queries(vectors, queries, top_k, search), top_k, r.fusion_k, r.text_boost)
    order = Window.orderBy(F.desc(F.round("score", 12)), "_seen", "node_id")  # top_k rows
    return retrieval.parents(fused.withColumn("rank", F.row_number().over(order) - 1), edges, nodes)


#: What a model gets besides the question: texts of the graph, and urls of images.
PROMPT = """{question}

Facts from the knowledge graph, the most relevant first:
{texts}

Pictures that belong to them: {images}

Use only these facts. Name a picture by its url where it shows what you say. Without facts that bear on the question, answer that none were found."""


def prompts(question: str, texts: str, images: str) -> tuple[str, str]:
    return PROMPT.format(texts=texts or "none", images=images or "none", question=question), question


@dataclass
class Answerer:
    """Hooks for the models that write answers: `enhanced` gets the prompt with context, `standard`
    the bare question.  An agent may stand behind either."""

    enhanced: object
    standard: object


def process_question(graph: GraphStore, question: str, providers: Providers | None = None, config: Config | None = None, answerer: Answerer | None = None) -> tuple[str | None, str | None]:
    """(answer with context, answer without)."""
    providers, config = providers or Providers(), config or Config()
    queries = query_table(graph.spark, expanded(question, providers, config.retrieval.generated_queries), providers)
    found = fusion_retrieve(graph, graph.edges(), graph.nodes(), queries, config.retrieval.top_k, config)
    row = retrieval.context(found).first()
    with_context, bare = prompts(question, row["texts"], row["image_urls"])
    answerer = answerer or Answerer(providers.text, providers.text)
    return tuple(retrying(lambda m=m, p=p: m.complete(Request("answer", p))) for m, p in ((answerer.enhanced, with_context), (answerer.standard, bare)))
