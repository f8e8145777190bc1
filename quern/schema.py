"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_s, _l, _i, _b = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


LINK = _struct(text=_s, url=_s)
IMAGE = _struct(image_data=T.BinaryType(), image_name=_s, image_url=_s)
SECTION = _struct(title=_s, subsections=T.ArrayType(_s))

#: A source page: markup, rendered html, and what the wiki API gives besides.
PAGE_SCHEMA = _struct(page_id=_s, title=_s, content=_s, summary=_s, categories=T.ArrayType(_s), html=_s, images=T.ArrayType(IMAGE), section_links=T.ArrayType(_struct(section=_s, text=_s, url=_s)))

#: A node of the graph: one wide nullable row for every kind.
NODE_SCHEMA = _struct(
    node_id=_s, page_id=_s, kind=_s, type=_s, title=_s, source_page=_s, parent_section=_s, context=_s, summary=_s, categories=T.ArrayType(_s),
    text_raw=_s, text=_s, image_data=T.BinaryType(), image_url=_s, parent_id=_s, source_id=_s, prev_id=_s, next_id=_s, chain=_s, pos=_l, ord=_l, needs_embedding=_b,
)

EDGE_SCHEMA = _struct(src_id=_s, dst_id=_s, rel=_s)
VECTOR_SCHEMA = _struct(node_id=_s, collection=_s, modality=_s, embedding=T.ArrayType(T.FloatType()), norm=T.DoubleType())
HIT_SCHEMA = _struct(query_id=_i, node_id=_s, modality=_s, score=T.DoubleType())

#: Fixed values of the node taxonomy.
DERIVED = ("entities", "summary", "key_takeaways", "image_description", "plot_insights", "image_entities", "chunk")
IMAGE_MODALITY = ("image", "plot", "image_description", "plot_insights", "image_entities")
PARENT_TYPES = ("section", "subsection", "image", "plot")
#: Types whose text the cleaner leaves alone.
UNCLEANED = ("image", "plot", "citation", "archive-citation", "wiki-ref", "table", "page")


def node_id(page_id: Column, kind: Column, ordinal: Column) -> Column:
    """Deterministic, so a rerun gives the same graph."""
    return F.sha2(F.concat_ws("|", page_id, kind, ordinal.cast("string")), 256)


def as_nodes(df: DataFrame) -> DataFrame:
    """df with every column of NODE_SCHEMA in order; missing ones are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in NODE_SCHEMA])
