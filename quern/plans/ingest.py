"""From pages to a stored graph: nodes, the ten transformation stages, storage."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.config import Config, timed
from quern.functions import markup
from quern.operators import derive, nodes
from quern.providers import Providers
from quern.sources import cache, store, wiki

#: Stages that derive nodes by a model, in order; each looks at types that none of them makes.
DERIVATIONS: tuple[Callable[..., DataFrame], ...] = (derive.entities, derive.summaries, derive.key_takeaways, derive.image_descriptions, derive.image_entities, derive.plot_insights, derive.table_analysis)


def with_section_links(pages: DataFrame) -> DataFrame:
    """pages whose links are known by section: as given, or else read from the html."""
    return pages.withColumn("section_links", F.coalesce("section_links", markup.section_links(F.when(F.col("section_links").isNull(), F.coalesce("html", F.lit(""))))))


def initial_nodes(pages: DataFrame, providers: Providers, with_links: bool = True) -> DataFrame:
    """All nodes of the pages, with their citations and wiki links unless these are not wanted."""
    pages = with_section_links(pages) if with_links else pages
    return nodes.page_nodes(pages, lambda rows: derive.classified(rows, providers.vision, providers.pace), with_links)


def transformed(rows: DataFrame, providers: Providers, derivations: Sequence[Callable[..., DataFrame]] = DERIVATIONS) -> DataFrame:
    """Nodes after all ten stages, with the time for an audit: derivations, chunking, cleaning,
    embedding.  Models see raw text; chunks and derived text are cleaned; vectors see clean text.

    As no derivation looks at another's nodes, each starts from the rows given, so the plan grows
    with the number of stages and not as a power of two."""
    everything = rows
    for stage in derivations:
        everything = everything.unionByName(stage(rows, providers, only_new=True))
    everything = nodes.with_flags(everything).unionByName(derive.chunks(rows, providers, only_new=True))
    return derive.embedded(nodes.cleaned(everything), providers).withColumn("last_transformed", F.current_timestamp())


@timed
def ingest(spark: SparkSession, corpus: DataFrame, topic: str, results: int = 2, providers: Providers | None = None, config: Config | None = None) -> store.GraphStore:
    """Search a topic, build and transform the nodes of its pages, store them.  Both stages are kept
    page by page (quern.sources.cache): a second run reads them, a changed page or model derives what depends on it."""
    providers, config = providers or Providers(), config or Config()
    titles = wiki.search(corpus, topic, results).select("title")
    pages = corpus.join(F.broadcast(titles), "title", "left_semi").select(*corpus.columns)  # `results` titles at most
    kept = lambda name: cache.PageCache(spark, f"{config.store.path}/{name}")

    def all_stages(new: DataFrame) -> DataFrame:
        first = kept("initial").nodes(new, lambda own: initial_nodes(own, providers), cache.models_print(providers, "initial"))
        return transformed(first, providers)

    done = kept("transformed").nodes(pages, all_stages, cache.models_print(providers, "transformed", config.chunk))
    graph = store.GraphStore(spark, config.store)
    rows = done.drop("last_transformed")
    graph.store(providers.counters.nodes(rows) if providers.counters else rows)
    if providers.counters:
        providers.counters.log()
    return graph
