"""Pages to typed nodes, chains and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern import schema
from quern.functions import markup, text
from quern.operators import links as link_ops


def _headings() -> Column:
    """array<struct<h, b>>: a page's heading lines, each with the text up to the next."""
    split = F.split(F.coalesce("content", F.lit("")), text.HEADING_LINE)
    return F.arrays_zip(text.headings(F.col("content")).alias("h"), F.slice(split, 2, 1 << 30).alias("b"))


def _body(c: Column) -> Column:
    return text.strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"\A=+(?=\n|\z)", ""))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows (page_id, part, pos, top, title, body, ...), where headings are those of part `heading`, with
    section_no, sub_no, and of its section the title and body.  Headings without a title go, as do
    subsections before any section.  All windows lie within a page: one shuffle serves them all."""
    heading = F.col("part") == "heading"
    rows = rows.where(~heading | (F.col("title") != ""))
    order = Window.partitionBy("page_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section_no", F.when(heading, F.sum(F.col("top").cast("int")).over(order)).cast("int")).where(~heading | (F.col("section_no") > 0))
    within = Window.partitionBy("page_id", "part", "section_no").orderBy("pos")
    rows = rows.withColumn("sub_no", F.when(heading, F.row_number().over(within) - 1).cast("int"))
    first = within.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.when(heading, F.first("title").over(first))).withColumn("section_body", F.when(heading, F.first("body").over(first)))


def section_rows(pages: DataFrame) -> DataFrame:
    """(page_id, section_no, sub_no, level, title, body, section, section_body): headings in order; sub_no
    0 is the section itself.  body is the text up to the next heading.  Subsections before any section go."""
    rows = pages.select("page_id", F.posexplode(_headings()).alias("pos", "x"))
    rows = rows.select("page_id", F.lit("heading").alias("part"), "pos", text.is_section(F.col("x.h")).alias("top"), text.heading_title(F.col("x.h")).alias("title"), _body(F.col("x.b")).alias("body"))
    return _numbered(rows).select("page_id", "section_no", "sub_no", F.when(F.col("top"), 2).otherwise(3).alias("level"), "title", "body", "section", "section_body")


def section_titles(pages: DataFrame) -> DataFrame:
    """(page_id, sections array<struct<title, subsections>>), in order."""
    rows = section_rows(pages)
    one = rows.groupBy("page_id", "section_no").agg(F.max(F.when(F.col("sub_no") == 0, F.col("title"))).alias("title"), F.array_sort(F.collect_list(F.when(F.col("sub_no") > 0, F.struct("sub_no", "title")))).alias("s"))
    one = one.select("page_id", "section_no", F.struct("title", F.transform("s", lambda x: x["title"]).alias("subsections")).alias("x"))
    return one.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("section_no", "x"))), lambda y: y["x"]).alias("sections"))


def _id(kind: str, ordinal: Column) -> Column:
    return schema.node_id(F.col("page_id"), F.lit(kind), ordinal)


#: Parts of a page, in the order of their nodes; the order of a node is its part's place and its own.
PARTS = ("page", "intro", "heading", "image", "table", "citation", "wiki-ref")
_ELEMENT = "struct<part:string,pos:int,title:string,body:string,top:boolean,image_data:binary,image_url:string>"


def _element(part: str, pos: Column, **fields: Column) -> Column:
    named = {"part": F.lit(part), "pos": pos} | fields
    names = ("part", "pos", "title", "body", "top", "image_data", "image_url")
    return F.struct(*[named.get(n, F.lit(None)).alias(n) for n in names]).cast(_ELEMENT)


def _elements(part: str) -> Column:
    """What a page has of a part, as an array of _ELEMENT."""
    zero, none = F.lit(0), F.array().cast(f"array<{_ELEMENT}>")
    if part == "page":
        return F.array(_element(part, zero, title=text.sanitise_title(F.col("title")), body=F.col("content")))
    if part == "intro":
        intro = text.intro(F.col("content"))
        return F.when(intro != "", F.array(_element(part, zero, body=intro))).otherwise(none)
    if part == "heading":
        make = lambda x, i: _element(part, i, top=text.is_section(x["h"]), title=text.heading_title(x["h"]), body=_body(x["b"]))
        return F.transform(_headings(), make)
    if part == "image":
        make = lambda x, i: _element(part, i, title=x["image_name"], image_data=x["image_data"], image_url=x["image_url"])
        return F.coalesce(F.transform("images", make), none)
    return F.coalesce(F.transform(markup.wiki_tables(F.col("html")), lambda t, i: _element(part, i, body=t["csv"])), none)


def _place(part: str, pos: Column) -> Column:
    return F.lit(PARTS.index(part) << 40) + pos


def build(pages: DataFrame, parts: tuple[str, ...], classify=None) -> DataFrame:
    """Nodes of some parts of all pages.  Each page is read once and its parts come out of one array;
    classify(rows with image_data, image_name) adds `answer`, the classifier's word, and may drop images."""
    rows = pages.select(
        "page_id", F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("categories", F.array().cast("array<string>")).alias("categories"), text.sanitise_title(F.col("title")).alias("source_page"),
        F.explode(F.concat(*[_elements(p) for p in parts])).alias("x"),
    )
    rows = rows.select("page_id", "summary", "categories", "source_page", "x.*")
    if "image" in parts:
        rows = classify(rows.withColumn("image_name", F.when(F.col("part") == "image", F.col("title"))))
    else:
        rows = rows.withColumn("answer", F.lit(None).cast("string"))
    if "heading" in parts:
        rows = _numbered(rows.repartition("page_id")).where("part != 'heading' or (body != '' and section_body != '')")  # a section without text hides its subsections
    else:
        none = F.lit(None)
        rows = rows.withColumns({"section_no": none.cast("int"), "sub_no": none.cast("int"), "section": none.cast("string")})
    part, top, source = F.col("part"), F.col("sub_no") == 0, _id("page", F.lit(0))
    of = lambda **by: F.coalesce(*[F.when(part == p, v) for p, v in by.items()])
    section_id = lambda no, sub: _id("section", F.concat_ws(".", no, sub))
    return schema.as_nodes(rows.select(
        of(page=source, intro=_id("intro", F.lit(0)), heading=section_id("section_no", "sub_no"), image=_id("image", F.col("pos")), table=_id("table", F.col("pos"))).alias("node_id"), "page_id",
        of(page=F.lit("document"), image=F.lit("image"), intro=F.lit("text"), heading=F.lit("text"), table=F.lit("text")).alias("kind"),
        of(page=F.lit("page"), intro=F.lit("section"), heading=F.when(top, "section").otherwise("subsection"), image=text.image_type(F.col("answer")), table=F.lit("table")).alias("type"),
        of(page=F.col("title"), intro=F.concat("source_page", F.lit("_intro")), heading=text.sanitise_title(F.col("title")), image=text.sanitise_title(F.col("title")), table=F.concat("source_page", F.lit("_table_"), "pos")).alias("title"),
        F.when(~part.isin("page", "intro"), F.col("source_page")).alias("source_page"), F.when((part == "heading") & ~top, text.sanitise_title(F.col("section"))).alias("parent_section"),
        F.when(part != "page", F.col("summary")).alias("context"), F.when(part == "page", F.col("summary")).alias("summary"), F.when(part == "page", F.col("categories")).alias("categories"),
        F.col("body").alias("text"), "image_data", "image_url",
        F.when((part == "heading") & ~top, section_id("section_no", F.lit(0))).when(part != "page", source).alias("parent_id"), F.when(part != "page", source).alias("source_id"),
        of(intro=F.lit("intro"), heading=F.when(top, F.lit("sections")).otherwise(F.concat(F.lit("sub"), F.col("section_no"))), image=F.lit("images"), table=F.lit("tables")).alias("chain"),
        F.when(part == "heading", F.when(top, F.col("section_no")).otherwise(F.col("sub_no"))).when(part != "page", F.col("pos")).alias("pos"),
        F.coalesce(*[F.when(part == p, _place(p, F.col("pos"))) for p in parts]).alias("ord"),
    ))


def documents(pages: DataFrame) -> DataFrame:
    return build(pages, ("page",))


def intros(pages: DataFrame) -> DataFrame:
    """The text before the first heading, where there is any: a section without a source page."""
    return build(pages, ("intro",))


def sections(pages: DataFrame) -> DataFrame:
    """Sections and subsections with text.  A section without text hides its subsections; a
    subsection's parent is its section."""
    return build(pages, ("heading",))


def section_map(pages: DataFrame) -> DataFrame:
    """(page_id, section, parent_id): a heading's title to the node that links under it belong to.
    A subsection's title leads to its section; of equal titles the last counts."""
    rows = section_rows(pages).where("body != '' and section_body != ''")
    target = _id("section", F.concat(F.col("section_no").cast("string"), F.lit(".0")))
    return rows.groupBy("page_id", F.col("title").alias("section")).agg(F.max_by(target, F.struct("section_no", "sub_no")).alias("parent_id"))


def images(pages: DataFrame, classify) -> DataFrame:
    """Image nodes; classify(images DataFrame) adds `answer`, the classifier's word."""
    return build(pages, ("image",), classify)


def tables(pages: DataFrame) -> DataFrame:
    """A node for each wiki table, as CSV."""
    return build(pages, ("table",))


def _about(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", text.sanitise_title(F.col("title")).alias("source_page"), F.coalesce("summary", F.lit("")).alias("context"), _id("page", F.lit(0)).alias("source_id"))


def citations(pages: DataFrame, cited: DataFrame) -> DataFrame:
    """Citation nodes: for each section its links, then its archives; one chain over all sections.
    An archive has a suffix to its title and no context."""
    title = text.sanitise_title(text.unquoted(F.col("title")))

    def node(archive, k, title, url, kind):
        return F.struct(F.lit(archive).alias("archive"), k.alias("k"), title.alias("title"), url.alias("url"), F.lit(kind).alias("type"))

    def archived(url, k):
        return node(1, k, F.concat_ws("-", title, text.archive_suffix(k, F.size("archived"))), url, "archive-citation")

    actual = F.array(node(0, F.lit(0), title, F.col("link"), "citation"))
    each = F.when(F.col("archived").isNull(), actual).otherwise(F.concat(actual, F.transform("archived", archived)))  # one pass for both
    rows = cited.select("page_id", "section", "section_pos", "pos", F.explode(each).alias("x"))
    rows = rows.select("page_id", "section", F.struct("section_pos", "x.archive", "pos", "x.k").alias("o"), "x.title", "x.url", "x.type")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("o", "type", "url")) - 1)
    return _link_nodes(pages, rows, "citation")


def wiki_references(pages: DataFrame, wiki: DataFrame) -> DataFrame:
    rows = wiki.select("page_id", "section", F.struct("section_pos", "pos").alias("o"), text.sanitise_title(F.col("text")).alias("title"), "url", F.lit("wiki-ref").alias("type"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("o", "url")) - 1)
    return _link_nodes(pages, rows, "wiki-ref")


def _link_nodes(pages: DataFrame, rows: DataFrame, chain: str) -> DataFrame:
    rows = rows.join(section_map(pages), ["page_id", "section"], "left").join(_about(pages), "page_id")
    return schema.as_nodes(rows.select(
        _id(chain, F.col("n")).alias("node_id"), "page_id", F.lit("image").alias("kind"), "type", "title", "source_page", text.sanitise_title(F.col("section")).alias("parent_section"),
        F.when(F.col("type") != "archive-citation", F.col("context")).alias("context"), F.col("url").alias("text"), F.col("url").alias("image_url"), "parent_id", "source_id",
        F.lit(chain).alias("chain"), F.col("n").alias("pos"), _place(chain, F.col("n")).alias("ord"),
    ))


def linked(nodes: DataFrame) -> DataFrame:
    """prev_id and next_id along each chain of a page."""
    w = Window.partitionBy("page_id", "chain").orderBy("pos", "ord")
    on = F.col("chain").isNotNull()
    return nodes.withColumn("prev_id", F.when(on, F.lag("node_id").over(w))).withColumn("next_id", F.when(on, F.lead("node_id").over(w)))


def page_nodes(pages: DataFrame, classify, with_links: bool = False) -> DataFrame:
    """All nodes of all pages: document, intro, sections, images, tables, and with `with_links`
    citations and wiki links."""
    out = build(pages, PARTS[:5], classify)
    if with_links:
        rows = link_ops.page_links(pages)
        out = out.unionByName(citations(pages, link_ops.all_citations(rows))).unionByName(wiki_references(pages, link_ops.wiki_links(rows)))
    return linked(out)


def edges(nodes: DataFrame) -> DataFrame:
    """(src_id, dst_id, rel), from the related node to the node itself, where both exist."""
    pairs = F.array(*[F.struct(F.lit(rel).alias("rel"), F.col(c).alias("src_id")) for rel, c in (("PARENT", "parent_id"), ("SOURCE", "source_id"), ("PREVIOUS", "prev_id"), ("NEXT", "next_id"))])
    rows = nodes.select(F.col("node_id").alias("dst_id"), F.explode(pairs).alias("p")).select("p.src_id", "dst_id", "p.rel").where("src_id is not null")
    return rows.join(nodes.select(F.col("node_id").alias("src_id")).distinct(), "src_id", "left_semi").select("src_id", "dst_id", "rel")


def with_flags(nodes: DataFrame, include_table_analysis: bool = False) -> DataFrame:
    """needs_embedding by type: true for derived nodes, images and plots; sections keep what they have."""
    on = [*schema.DERIVED, "image", "plot", *(["table_analysis"] if include_table_analysis else [])]
    t = F.col("type")
    return nodes.withColumn("needs_embedding", F.when(t.isin("section", "subsection"), F.col("needs_embedding")).when(t.isin("image", "plot"), True).when(t.isin(*on), F.coalesce("needs_embedding", F.lit(False))).otherwise(False))


def cleaned(nodes: DataFrame) -> DataFrame:
    """Text without punctuation for the types that are cleaned; text_raw keeps the original."""
    nodes = nodes.withColumn("text_raw", F.coalesce("text_raw", "text"))
    return nodes.withColumn("text", F.when(~F.coalesce(F.col("type").isin(*schema.UNCLEANED), F.lit(False)), text.clean(F.col("text"))).otherwise(F.col("text")))


def graph_view(nodes: DataFrame) -> DataFrame:
    """What the graph keeps of a node: label, JSON metadata and relationships; no document text, no
    image bytes or image text."""
    d = lambda c: F.coalesce(F.col(c), F.lit(""))
    metadata = F.to_json(F.struct(d("title").alias("title"), d("type").alias("type"), d("source_page").alias("source_page"), d("parent_section").alias("parent_section"), d("context").alias("context"), F.coalesce("needs_embedding", F.lit(False)).alias("needs_embedding")))
    related = F.to_json(F.struct(F.col("parent_id").alias("PARENT"), F.col("source_id").alias("SOURCE"), F.col("prev_id").alias("PREVIOUS"), F.col("next_id").alias("NEXT")))
    return nodes.select(
        "node_id", F.when(F.col("kind") == "document", "Document").otherwise(text.capitalise(F.col("type"))).alias("label"), d("title").alias("title"), d("type").alias("type"), metadata.alias("metadata"), related.alias("relationships"),
        F.when(F.col("kind") == "text", F.col("text")).alias("text"), F.when(F.col("kind") == "image", F.coalesce("image_url", "text")).alias("image_url"),
    )


def from_graph(view: DataFrame) -> DataFrame:
    """Nodes of a graph view; what has neither text nor image_url gives no node."""
    kind = F.when(F.col("text").isNotNull(), "text").when(F.col("image_url").isNotNull(), "image")
    meta = F.from_json("metadata", "title string, type string, source_page string, parent_section string, context string, needs_embedding boolean")
    rel = F.from_json("relationships", "PARENT string, SOURCE string, PREVIOUS string, NEXT string")
    rows = view.withColumn("m", meta).withColumn("r", rel).withColumn("kind", kind).where("kind is not null")
    return schema.as_nodes(rows.select("node_id", "kind", "m.title", "m.type", "m.source_page", "m.parent_section", "m.context", "m.needs_embedding", "text", "image_url", F.col("r.PARENT").alias("parent_id"), F.col("r.SOURCE").alias("source_id"), F.col("r.PREVIOUS").alias("prev_id"), F.col("r.NEXT").alias("next_id")))
