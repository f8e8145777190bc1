"""The registered queries of the engine proper, each over whole tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import markup, text
from quern.operators import chunking, derive, links, nodes, retrieval
from quern.providers import RuleText
from quern.sources import wiki

#: What embeddings.label stands for.
LABEL_TYPES = ("chunk", "entities", "summary", "key_takeaways", "table_analysis", "page", "image_description", "plot_insights", "image_entities", "image")
#: The first five vectors are a question and its four rewrites; a plain search asks for every hundredth.
QUESTION, EVERY = 5, 100
K = 10


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_kept: dict = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make):
    """What several queries look into (a store, an index), made once in a session for each set of tables."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def _label_type(c):
    return F.element_at(F.array(*[F.lit(x) for x in LABEL_TYPES]), c + 1)


def _vectors(spark, sf_dir, question: bool) -> tuple[DataFrame, DataFrame]:
    """(vectors, queries) from embeddings: all rows, and the question or every hundredth."""
    t = _read(spark, sf_dir, "embeddings")
    v = t.select(F.col("vec_id").alias("node_id"), F.when(F.col("label") < 6, "text").otherwise("image").alias("modality"), "embedding")
    q = t.where(F.col("vec_id") < QUESTION if question else F.col("vec_id") % EVERY == 0).select(F.col("vec_id").cast("int").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.with_norm(v), q


def _hits(spark, sf_dir, question: bool = True) -> DataFrame:
    return retrieval.text_first(*_vectors(spark, sf_dir, question), K)


def knn_filtered_topk(spark, sf_dir) -> DataFrame:
    v, q = _vectors(spark, sf_dir, False)
    return retrieval.vector_search(v, q, K, "text").select("query_id", F.col("node_id").alias("vec_id"), F.round("score", 9).alias("score"))


def text_first_hits(spark, sf_dir) -> DataFrame:
    return _hits(spark, sf_dir, False).select("query_id", F.col("node_id").alias("vec_id"), "modality", F.round("score", 9).alias("score"))


def rrf_fusion(spark, sf_dir) -> DataFrame:
    return retrieval.fuse(_hits(spark, sf_dir), K).select(F.col("node_id").alias("vec_id"), "modality", F.round("score", 9).alias("score"))


def _turn_graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Conversations as a graph: turn 0 is the parent of all turns of its conversation."""
    t = _read(spark, sf_dir, "conversations")
    key = F.concat_ws("-", "conv_id", "turn")
    kind = F.element_at(F.array(F.lit("section"), F.lit("image"), F.lit("page")), (F.col("conv_id") % 3 + 1).cast("int"))
    n = t.select(key.alias("node_id"), F.when(F.col("turn") == 0, kind).otherwise("chunk").alias("type"), F.when((F.col("turn") == 0) & (kind == "image"), "image").otherwise("text").alias("kind"), "text", F.concat(F.lit("http://images/"), key, F.lit(".png")).alias("image_url"))
    e = t.select(F.concat(F.col("conv_id").cast("string"), F.lit("-0")).alias("src_id"), key.alias("dst_id"), F.lit("PARENT").alias("rel"))
    return n, e


def _parents(spark, sf_dir) -> DataFrame:
    """Parents of fused hits.  Vector 3 c + t stands for turn t of conversation c."""
    fused = retrieval.fuse(_hits(spark, sf_dir), K)
    order = Window.orderBy(F.desc(F.round("score", 12)), "_seen", "node_id")  # K rows
    key = F.concat_ws("-", F.floor(F.col("node_id") / 3), F.col("node_id") % 3)
    hits = fused.select(key.alias("node_id"), (F.row_number().over(order) - 1).alias("rank"))
    n, e = _turn_graph(spark, sf_dir)
    return retrieval.parents(hits, e, n)


def parent_lookup(spark, sf_dir) -> DataFrame:
    return _parents(spark, sf_dir).select("rank", "node_id", "type", "kind")


def context_concat(spark, sf_dir) -> DataFrame:
    return retrieval.context(_parents(spark, sf_dir))


def clean_text(spark, sf_dir) -> DataFrame:
    d = _read(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 5 == 0, "citation").otherwise("section").alias("type"))
    return nodes.cleaned(d.withColumn("text_raw", F.col("text"))).select("doc_id", "type", "text")


def sanitise_title(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", text.sanitise_title(F.col("text")).alias("title"))


def _marked(spark, sf_dir) -> DataFrame:
    """documents with headings put in: a section, a subsection or a deeper one before each line."""
    d = _read(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    content = F.array_join(F.transform(lines, lambda x, i: F.concat(F.when(i == 0, x).when(i % 4 == 1, F.concat(F.lit("== Part "), i, F.lit(" ==\n"), x)).when(i % 4 == 2, F.concat(F.lit("=== Detail "), i, F.lit(" ===\n"), x)).when(i % 4 == 3, F.concat(F.lit("==== Deep "), i, F.lit(" ====\n"), x)).otherwise(x))), "\n")
    return d.select(F.col("doc_id").alias("page_id"), content.alias("content"))


def intro_split(spark, sf_dir) -> DataFrame:
    return _marked(spark, sf_dir).select(F.col("page_id").alias("doc_id"), text.intro(F.col("content")).alias("intro"))


def section_titles(spark, sf_dir) -> DataFrame:
    s = nodes.section_titles(_marked(spark, sf_dir))
    return s.select(F.col("page_id").alias("doc_id"), F.posexplode("sections").alias("section_no", "s")).select("doc_id", "section_no", "s.title", F.array_join("s.subsections", "|").alias("subsections"))


def semantic_chunks(spark, sf_dir) -> DataFrame:
    return chunking.chunk_rows(_read(spark, sf_dir, "documents"), ["doc_id"], "text")


def prev_next_links(spark, sf_dir) -> DataFrame:
    t = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page_id"), F.lit("turns").alias("chain"), F.col("turn").alias("pos"), F.lit(0).alias("ord"), F.concat_ws("-", "conv_id", "turn").alias("node_id"))
    return nodes.linked(t).select("node_id", "prev_id", "next_id")


def edges_from_nodes(spark, sf_dir) -> DataFrame:
    t = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page_id"), F.lit("turns").alias("chain"), F.col("turn").alias("pos"), F.lit(0).alias("ord"), F.concat_ws("-", "conv_id", "turn").alias("node_id"))
    top = F.concat(F.col("page_id").cast("string"), F.lit("-0"))
    n = nodes.linked(t).withColumn("parent_id", F.when(F.col("pos") > 0, top)).withColumn("source_id", F.concat(F.lit("missing-"), F.col("page_id").cast("string")))
    return nodes.edges(n)


def page_links(spark, sf_dir) -> DataFrame:
    p = _read(spark, sf_dir, "pages").select(F.col("page_id"), F.transform(markup.anchors(F.col("html")), lambda a: F.struct(F.lit("Body").alias("section"), a["text"].alias("text"), a["url"].alias("url"))).alias("section_links"))
    w = links.wiki_links(links.page_links(p))
    return w.select("page_id", "section", "text", "url", F.col("pos").cast("long").alias("pos"))


def _reference_rows(spark, sf_dir) -> DataFrame:
    """Turns as the links of a reference list: turn 0 begins a reference in each conversation, five
    conversations make a page; an odd conversation's note number is cited."""
    t = _read(spark, sf_dir, "conversations").withColumn("page_id", F.col("conv_id").cast("long") - F.pmod("conv_id", F.lit(5)))
    pos = F.row_number().over(Window.partitionBy("page_id").orderBy("conv_id", "turn")).cast("long")
    start = F.col("turn") == 0
    return t.select(
        (F.col("page_id") / 5).cast("long").alias("page_id"), F.lit("References").alias("section"), F.lit(0).cast("long").alias("section_pos"), pos.alias("pos"), F.when(start, "^").otherwise(F.col("text")).alias("text"),
        F.when(start, F.concat(F.lit("#cite_ref-"), F.col("conv_id"))).otherwise(F.concat(F.lit("http://ref/"), F.col("conv_id"), F.lit("/"), F.col("turn"))).alias("url"),
    )


def citation_groups(spark, sf_dir) -> DataFrame:
    """References, each with a link to a type hint in it, which is none of theirs."""
    rows = _reference_rows(spark, sf_dir).withColumn("pos", F.col("pos") * 2)
    hints = rows.where("text = '^'").withColumn("pos", F.col("pos") + 1).withColumn("text", F.lit("hint")).withColumn("url", F.concat(F.lit("#cite_ref-type_hint-"), "pos"))
    r = links.reference_tuples(links.reference_links(rows.unionByName(hints)))
    return r.select("page_id", "ref_pos", "cite_ref", "ref_no", "title", "link", F.array_join("archived", "|").alias("archived"))


def citation_resolve(spark, sf_dir) -> DataFrame:
    rows = _reference_rows(spark, sf_dir)
    number = text.cite_number(F.col("url"))
    notes = rows.where("text = '^'").select("page_id", F.concat(F.lit("Part "), number.cast("long") % 2).alias("section"), F.lit(1).cast("long").alias("section_pos"), "pos", number.alias("ref_no")).where(F.col("ref_no").cast("long") % 2 == 1)
    c = links.section_citations(notes, links.reference_tuples(links.reference_links(rows)))
    return c.select("page_id", "section", "ref_no", "title", "link", F.array_join("archived", "|").alias("archived"))


def vector_routing(spark, sf_dir) -> DataFrame:
    t = _read(spark, sf_dir, "embeddings").withColumn("type", _label_type(F.col("label")))
    kind = F.when(F.col("type") == "page", "document").when(F.col("type") == "image", "image").otherwise("text")
    e = F.when(F.col("label") != 9, F.col("embedding"))
    from quern.sources.store import vectors_of

    v = vectors_of(t.select(F.col("vec_id").alias("node_id"), kind.alias("kind"), "type", e.alias("embedding")))
    return v.select(F.col("node_id").alias("vec_id"), "collection", "modality", F.round("norm", 6).alias("norm"))


def embedding_flags(spark, sf_dir) -> DataFrame:
    t = _read(spark, sf_dir, "embeddings").select("vec_id", _label_type(F.col("label")).alias("type"), F.when(F.col("vec_id") % 3 != 0, True).alias("needs_embedding"))
    return nodes.with_flags(t)


def type_normalise(spark, sf_dir) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    answer = F.when(F.col("event_id") % 7 == 0, "").when(F.col("event_id") % 5 == 0, F.concat(F.lit("Sensitive_Image "), "event_type")).otherwise(F.col("event_type"))
    return e.select("event_id", text.image_type(answer).alias("type"), text.capitalise(F.col("event_type")).alias("label"))


def token_cost(spark, sf_dir) -> DataFrame:
    d = _read(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("tokens"))
    return d.select("source", "docs", "tokens", F.round(text.token_cost(F.col("tokens").cast("double")), 6).alias("cost"))


def union_nodes(spark, sf_dir) -> DataFrame:
    d = _read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("node_id"), F.lit("section").alias("type"), F.col("doc_id").alias("ord"), F.length("text").cast("long").alias("size"))
    p = _read(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("node_id"), F.lit("page").alias("type"), (F.lit(1_000_000_000_000) + F.col("page_id")).alias("ord"), F.length("html").cast("long").alias("size"))
    return d.unionByName(p)


def search_topn(spark, sf_dir) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    return wiki.search(d, "The of licensed", 20, "doc_id", "text")


def node_to_graph(spark, sf_dir) -> DataFrame:
    """Conversation turns as nodes, to the graph's form and back."""
    t = _read(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("node_id"), F.when(F.col("turn") == 0, "document").when(F.col("turn") % 2 == 1, "text").otherwise("image").alias("kind"), F.when(F.col("turn") == 0, "page").when(F.col("turn") % 2 == 1, "section").otherwise("image").alias("type"), F.col("role").alias("title"), F.col("text"), F.concat(F.lit("u"), "turn").alias("image_url"), F.concat(F.col("conv_id").cast("string"), F.lit("-0")).alias("parent_id"))
    from quern import schema

    back = nodes.from_graph(nodes.graph_view(schema.as_nodes(t)))
    return back.select("node_id", "kind", "type", "title", "text", "image_url", "parent_id")


def generated_queries(spark, sf_dir) -> DataFrame:
    """Each conversation's turns as lines of generated queries: trimmed, blank ones dropped, equal ones
    once, in order."""
    t = _read(spark, sf_dir, "conversations").select("conv_id", F.posexplode(text.query_lines(F.col("text"))).alias("line", "query"), "turn")
    return t.groupBy("conv_id", "query").agg(F.min(F.struct("turn", "line")).alias("p")).select("conv_id", "query", "p.turn", "p.line")


def payload_ids(spark, sf_dir) -> DataFrame:
    """Node ids out of vector payloads: JSON in JSON."""
    t = _read(spark, sf_dir, "embeddings")
    payload = F.to_json(F.struct(F.to_json(F.struct(F.concat(F.lit("n"), "vec_id").alias("id_"))).alias("_node_content")))
    return t.select("vec_id", text.payload_node_id(payload).alias("node_id"))


def _pages(spark, sf_dir) -> DataFrame:
    """The pages table as wiki pages, with one table put in."""
    from quern import schema

    table = F.concat(F.lit('<table class="wikitable sortable"><tr><th>k</th><th>v, w</th></tr><tr><td>'), "page_id", F.lit("</td></tr></table>"))
    p = _read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("page_id"), F.col("url").alias("title"), F.regexp_replace(F.regexp_replace(F.regexp_replace("html", "(?s)<script.*?</script>", " "), "(?s)<style.*?</style>", " "), "<[^>]*>", " ").alias("content"), F.lit("").alias("summary"), F.concat("html", table).alias("html"))
    full = p.select(*[(F.col(f.name) if f.name in p.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.PAGE_SCHEMA])
    return full


def wiki_tables(spark, sf_dir) -> DataFrame:
    """A plain table, a ragged one with an empty row and empty cells, one with a table within, and one without cells."""
    ragged = F.concat(F.lit('<table class="wikitable"><tr><th>a</th><th>b</th><th>c</th></tr><tr><td>'), "page_id", F.lit('</td></tr><tr></tr><tr><td></td><td>"q"</td></tr></table>'))
    nested = F.concat(F.lit('<table class="wikitable"><tr><td>x<table><tr><td>'), "page_id", F.lit('</td></tr></table></td></tr></table><table class="wikitable"><tr></tr></table>'))
    t = nodes.tables(_pages(spark, sf_dir).withColumn("html", F.concat("html", ragged, nested)))
    return t.select("page_id", "pos", "title", F.col("text").alias("csv"))


def page_nodes(spark, sf_dir) -> DataFrame:
    n = nodes.page_nodes(_pages(spark, sf_dir), lambda rows: rows.withColumn("answer", F.lit("image")))
    return n.select("node_id", "page_id", "type", "title", "parent_id", "prev_id", "next_id")


def _section_nodes(spark, sf_dir) -> DataFrame:
    from quern import schema

    return schema.as_nodes(_read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("node_id"), F.col("doc_id").cast("string").alias("page_id"), F.lit("text").alias("kind"), F.lit("section").alias("type"), F.col("source").alias("title"), "text", F.col("doc_id").alias("ord")))


class _Rules:
    text = RuleText()


def extractive_summary(spark, sf_dir) -> DataFrame:
    out = derive.summaries(_section_nodes(spark, sf_dir), _Rules())
    return out.where("type = 'summary'").select("parent_id", "title", "text")


def entities_rule(spark, sf_dir) -> DataFrame:
    out = derive.entities(_section_nodes(spark, sf_dir), _Rules())
    return out.where("type = 'entities'").select("parent_id", "title", "text")


def key_takeaways(spark, sf_dir) -> DataFrame:
    out = derive.key_takeaways(_section_nodes(spark, sf_dir), _Rules())
    return out.where("type = 'key_takeaways'").select("parent_id", "title", "text")


def string_parts(spark, sf_dir) -> DataFrame:
    """The small expressions on urls."""
    c, n = F.col("url"), F.col("page_id")
    return _read(spark, sf_dir, "pages").select(
        "page_id", text.url_name(c).alias("name"), text.unquoted(F.concat(F.lit('""'), c, F.lit('"\n'))).alias("unquoted"), text.unbracketed(F.concat(F.lit("["), n, F.lit("]]"))).alias("number"),
        text.cite_number(F.concat(F.lit("cite_ref-"), n)).alias("ref_no"), text.archive_suffix(n, n % 3).alias("suffix"), text.sanitise_title(c).alias("title"),
    )


def base64_texts(spark, sf_dir) -> DataFrame:
    d = _read(spark, sf_dir, "documents").select("doc_id", "text", text.to_base64(F.col("text").cast("binary")).alias("coded"))
    return d.select("doc_id", "coded", (text.from_base64(F.col("coded")).cast("string") == F.col("text")).alias("same"))


def _marked_pages(spark, sf_dir) -> DataFrame:
    """documents with headings, as pages: titles, some without a summary or categories."""
    from quern import schema

    m = _marked(spark, sf_dir).join(_read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "source", "lang"), "page_id")
    m = m.select(F.col("page_id").cast("string").alias("page_id"), F.concat(F.lit("Page: "), "page_id").alias("title"), "content", F.when(F.col("page_id") % 2 == 0, F.col("source")).alias("summary"), F.when(F.col("page_id") % 3 == 0, F.array("lang", "source")).alias("categories"))
    return m.select(*[(F.col(f.name) if f.name in m.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.PAGE_SCHEMA])


def page_fetch(spark, sf_dir) -> DataFrame:
    f = wiki.fetch(_marked_pages(spark, sf_dir))
    return f.select("page_id", "title", "intro", F.array_join("categories", "|").alias("categories"), F.array_join("section_names", "|").alias("sections"), "html", F.size("images").alias("images"), F.length("content").alias("size"))


def page_lookup(spark, sf_dir) -> DataFrame:
    """A page by title, and no row for a title that is missing."""
    pages = _marked_pages(spark, sf_dir)
    return wiki.page(pages, "Page: 7").unionByName(wiki.page(pages, "Page: none")).select("page_id", "content")


def section_content(spark, sf_dir) -> DataFrame:
    return wiki.section_content(_marked_pages(spark, sf_dir), "Part 5")


def section_nodes(spark, sf_dir) -> DataFrame:
    n = nodes.linked(nodes.sections(_marked_pages(spark, sf_dir)))
    return n.select("page_id", "node_id", "type", "title", "parent_section", "context", "text", "parent_id", "source_id", "prev_id", "next_id")


def section_map(spark, sf_dir) -> DataFrame:
    return nodes.section_map(_marked_pages(spark, sf_dir))


def page_documents(spark, sf_dir) -> DataFrame:
    n = nodes.documents(_marked_pages(spark, sf_dir))
    return n.select("page_id", "node_id", "kind", "type", "title", "summary", F.array_join("categories", "|").alias("categories"))


def _link_rows(spark, sf_dir) -> DataFrame:
    """Reference lists as in _reference_rows, and notes that cite the odd ones, by section of the page."""
    refs = _reference_rows(spark, sf_dir)
    number = text.cite_number(F.col("url")).cast("long")
    notes = refs.where((F.col("text") == "^") & (number % 2 == 1))
    notes = notes.select("page_id", F.concat(F.lit("Part "), number % 3).alias("section"), (number % 3).alias("section_pos"), (F.col("pos") - 1_000_000).alias("pos"), F.concat(F.lit("["), number, F.lit("]")).alias("text"), F.concat(F.lit("/page#cite_note-"), number).alias("url"))
    return refs.withColumn("section_pos", F.lit(9).cast("long")).unionByName(notes)


def in_text_references(spark, sf_dir) -> DataFrame:
    return links.in_text_references(_link_rows(spark, sf_dir)).select("page_id", "section", "text", "url")


def cite_notes(spark, sf_dir) -> DataFrame:
    return links.cite_notes(_link_rows(spark, sf_dir)).select("page_id", "section", "ref_no")


def all_citations(spark, sf_dir) -> DataFrame:
    c = links.all_citations(_link_rows(spark, sf_dir))
    return c.select("page_id", "section", "ref_no", "title", "link", F.array_join("archived", "|").alias("archived"))


def citations_by_section(spark, sf_dir) -> DataFrame:
    c = links.citations_by_section(links.all_citations(_link_rows(spark, sf_dir)))
    joined = lambda c, f: F.array_join(F.transform(c, f), "|")
    return c.select("page_id", "section", joined("actual", lambda x: x["url"]).alias("urls"), joined("archived", lambda x: F.array_join(x["urls"], ",")).alias("archives"))


def citation_nodes(spark, sf_dir) -> DataFrame:
    """Citations under the sections that cite them; Part 1 is a subsection, and so leads to Part 0."""
    rows = _link_rows(spark, sf_dir)
    pages = _blank_pages(rows).withColumn("content", F.lit("before\n== Part 0 ==\nbody\n=== Part 1 ===\nmore\n== Part 2 ==\nlast"))
    n = nodes.citations(pages, links.all_citations(rows.withColumn("page_id", F.col("page_id").cast("string"))))
    return n.select("page_id", "type", "title", "text", "parent_section", "context", "pos", "parent_id", "source_id")


def wiki_ref_nodes(spark, sf_dir) -> DataFrame:
    """Links of the pages, as nodes."""
    p = page_links(spark, sf_dir).withColumn("page_id", F.col("page_id").cast("string")).withColumn("section_pos", F.lit(0).cast("long"))
    n = nodes.wiki_references(_blank_pages(p), p)
    return n.select("page_id", "node_id", "type", "title", "text", "parent_section", "pos")


def _blank_pages(rows: DataFrame) -> DataFrame:
    from quern import schema

    own = rows.select(F.col("page_id").cast("string").alias("page_id")).distinct().withColumn("title", F.concat(F.lit("P"), "page_id")).withColumn("summary", F.lit("about")).withColumn("content", F.lit(""))
    return own.select(*[(F.col(f.name) if f.name in own.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.PAGE_SCHEMA])


def image_counts(spark, sf_dir) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings").withColumn("type", F.when(F.col("label") == 9, "image").when(F.col("label") == 8, "plot").otherwise("chunk"))
    return derive.counts(e.withColumn("kind", F.when(F.col("label") >= 8, "image").otherwise("text")))


def usable_answers(spark, sf_dir) -> DataFrame:
    """Answers that make nodes: not missing, empty or failed, and for images no refusal."""
    t = _read(spark, sf_dir, "conversations")
    answer = F.when(F.col("turn") == 1, None).when(F.col("turn") == 2, "").when(F.col("turn") == 3, text.FAILED).when(F.col("turn") == 4, F.concat(F.lit("Error: Unable to see "), "text")).otherwise(F.col("text"))
    usable = lambda image: F.coalesce(text.usable_answer(F.col("answer"), image), F.lit(False))
    return t.withColumn("answer", answer).select("conv_id", "turn", usable(False).alias("of_text"), usable(True).alias("of_image"))


def embedded_nodes(spark, sf_dir) -> DataFrame:
    """Which nodes get a vector, and which: how often each letter is in the text."""
    from quern import schema
    from quern.providers import Providers

    t = _read(spark, sf_dir, "embeddings").withColumn("type", _label_type(F.col("label")))
    n = schema.as_nodes(t.select(F.col("vec_id").cast("string").alias("node_id"), F.when(F.col("type") == "image", "image").otherwise("text").alias("kind"), "type", F.concat(F.lit("text "), "vec_id", "type").alias("text"), F.when(F.col("vec_id") % 3 != 0, True).alias("needs_embedding")))
    done = derive.embedded(nodes.with_flags(n), Providers(_Letters()))
    return done.select("node_id", "type", F.col("embedding").isNotNull().alias("embedded"), F.array_join(F.col("embedding").cast("array<int>"), ",").alias("vector"))


class _Letters:
    """A stand-in that SQL can follow."""

    dim = 26

    def embed(self, texts):
        return chunking.letter_counts(texts)


def node_lookup(spark, sf_dir) -> DataFrame:
    """Nodes of a list of ids, some of which are missing or repeated."""
    n, _ = _turn_graph(spark, sf_dir)
    ids = _read(spark, sf_dir, "embeddings").select(F.concat_ws("-", F.floor(F.col("vec_id") / 4), F.col("vec_id") % 2).alias("node_id"))
    return retrieval.lookup(ids, n).select("node_id", "type", "kind")


def run_queries(spark, sf_dir) -> DataFrame:
    """Queries of equal text run once."""
    v, q = _vectors(spark, sf_dir, True)
    q = q.withColumn("text", F.concat(F.lit("q"), F.col("query_id") % 3))
    return retrieval.run_queries(v, q, K).select("query_id", F.col("node_id").alias("vec_id"), "modality", F.round("score", 9).alias("score"))


def fusion_retrieve(spark, sf_dir) -> DataFrame:
    """From queries to parents, by the plan that answers questions."""
    from quern.plans import answer

    v, q = _vectors(spark, sf_dir, True)
    v = v.withColumn("node_id", F.concat_ws("-", F.floor(F.col("node_id") / 3), F.col("node_id") % 3))
    n, e = _turn_graph(spark, sf_dir)
    return answer.fusion_retrieve(v, e, n, q.withColumn("text", F.col("query_id").cast("string")), K).select("node_id", "type", "kind")


def table_analysis(spark, sf_dir) -> DataFrame:
    out = derive.table_analysis(nodes.tables(_pages(spark, sf_dir)), _Rules(), only_new=True)
    return out.select("page_id", "title", "text", "type")


def image_gates(spark, sf_dir) -> DataFrame:
    """Which images are too small, from the headers of PNGs; null where there is none."""
    from quern.functions import images

    side = lambda c: F.unhex(F.lpad(F.hex(c), 8, "0"))
    head = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), side(F.col("page_id") % 97 + 1), side(F.col("page_id") % 89 + 1), F.unhex(F.lit("0802000000")))
    p = _read(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 7 > 0, head).otherwise(F.lit(b"no image")).alias("data"))
    return p.select("page_id", images.too_small("data").alias("too_small"))


def _image_pages(spark, sf_dir) -> DataFrame:
    """Pages with an image or two, some of them charts by their name."""
    from quern import schema

    kind = schema.PAGE_SCHEMA["images"].dataType
    one = lambda name: F.struct(F.lit(None).cast("binary").alias("image_data"), name.alias("image_name"), F.concat(F.lit("http://i/"), "page_id").alias("image_url"))
    first, second = F.concat(F.when(F.col("page_id") % 3 == 0, "sales_chart:").otherwise("photo "), "page_id"), F.concat(F.lit("map "), "page_id")
    p = _read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("page_id"), F.concat(F.lit("P "), "page_id").alias("title"), F.lit("about").alias("summary"), F.when(F.col("page_id") % 2 == 0, F.array(one(first))).otherwise(F.array(one(first), one(second))).cast(kind).alias("images"))
    return p.select(*[(F.col(f.name) if f.name in p.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.PAGE_SCHEMA])


def _image_nodes(spark, sf_dir) -> DataFrame:
    from quern.providers import NameVision

    return nodes.images(_image_pages(spark, sf_dir), lambda rows: derive.classified(rows, NameVision()))


def image_nodes(spark, sf_dir) -> DataFrame:
    n = nodes.linked(_image_nodes(spark, sf_dir))
    return n.select("page_id", "node_id", "kind", "type", "title", "source_page", "context", "image_url", "parent_id", "prev_id", "next_id")


def image_stages(spark, sf_dir) -> DataFrame:
    """What is derived from images and plots: descriptions, entities, insights."""
    from quern.providers import Providers

    n, p = _image_nodes(spark, sf_dir), Providers()
    out = derive.image_descriptions(n, p, True).unionByName(derive.image_entities(n, p, True)).unionByName(derive.plot_insights(n, p, True))
    return out.select("page_id", "type", "title", "text", "context", "parent_id", "source_id", "needs_embedding")


def latest_pages(spark, sf_dir) -> DataFrame:
    """Of the versions of a page that arrive together the last."""
    from quern.streaming.ingest import latest

    t = _read(spark, sf_dir, "conversations")
    rows = t.select(F.col("conv_id").alias("page_id"), F.col("text").alias("content"), F.col("role").alias("title"), F.lit("").alias("html"), F.timestamp_seconds(F.col("turn") * 60).alias("arrived"))
    return latest(rows).select("page_id", "content", "title")


def _stored(spark, sf_dir):
    return _once(spark, sf_dir, "graph", lambda: _store(spark, sf_dir))


def _store(spark, sf_dir):
    """Turns stored as nodes with vectors, conversations as pages; then the conversations divisible by 4
    again, with their first three turns only and no vectors."""
    from quern import schema
    from quern.config import StoreConfig
    from quern.sources import store

    graph = store.GraphStore(spark, StoreConfig(path=store.scratch(spark), text_dim=2, image_dim=2))
    t = _read(spark, sf_dir, "conversations")
    key, top = F.concat_ws("-", "conv_id", "turn"), F.concat(F.col("conv_id").cast("string"), F.lit("-0"))
    n = t.select(key.alias("node_id"), F.col("conv_id").cast("string").alias("page_id"), "turn", F.when(F.col("turn") % 3 == 2, "image").otherwise("text").alias("kind"), F.when(F.col("turn") % 3 == 2, "image").otherwise("chunk").alias("type"), F.when(F.col("turn") > 0, top).alias("parent_id"), F.array(F.col("turn"), F.col("conv_id")).cast("array<float>").alias("embedding"))
    tail = [(F.col(f.name) if f.name in n.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.NODE_SCHEMA]
    graph.store(n.select(*tail, "embedding"))
    graph.store(n.where("page_id % 4 = 0 and turn < 3").select(*tail))
    return graph


def stored_nodes(spark, sf_dir) -> DataFrame:
    return _stored(spark, sf_dir).nodes().select("node_id", "page_id", "kind", "parent_id")


def stored_edges(spark, sf_dir) -> DataFrame:
    return _stored(spark, sf_dir).edges()


def stored_vectors(spark, sf_dir) -> DataFrame:
    return _stored(spark, sf_dir).vectors().select("node_id", "collection", "modality", F.round("norm", 6).alias("norm"))


def stored_node(spark, sf_dir) -> DataFrame:
    """A node by its id, and a look at a collection."""
    graph = _stored(spark, sf_dir)
    return graph.node("5-1").select("node_id").unionByName(graph.sample("wiki_image", 10).select("node_id")).unionByName(graph.collections().select(F.col("collection").alias("node_id")))


def scrolled_vectors(spark, sf_dir) -> DataFrame:
    """The second and the third ten of a collection, by cursors."""
    graph = _stored(spark, sf_dir)
    _, at = graph.scroll("wiki_text", 10)
    second, at = graph.scroll("wiki_text", 10, at)
    third, _ = graph.scroll("wiki_text", 10, at)
    return second.unionByName(third).select("node_id", "modality")


def _vector_index(spark, sf_dir):
    """All embeddings, and every hundredth as a query."""
    from quern.sources.store import scratch
    from quern.sources.vector_index import VectorIndex

    v, q = _vectors(spark, sf_dir, False)
    return _once(spark, sf_dir, "vectors", lambda: VectorIndex(spark, scratch(spark)).build(v)), q


def indexed_knn(spark, sf_dir) -> DataFrame:
    """The kept index, all cells probed: the exact nearest texts and images."""
    index, q = _vector_index(spark, sf_dir)
    return index.search(q, {"text": K, "image": K // 2}, index.about()["cells"]).select("query_id", F.col("node_id").alias("vec_id"), "modality", F.round("score", 9).alias("score"))


def probed_recall(spark, sf_dir) -> DataFrame:
    """Whether as many cells as a calibration asks for find nine tenths of the nearest, and of how many queries."""
    index, q = _vector_index(spark, sf_dir)
    reached = index.calibrate(0.9, K) >= 0.9
    return q.agg(F.count(F.lit(1)).alias("queries")).withColumn("enough", F.lit(reached))


#: What the ranked search is asked: frequent and rare words.
WORDS = "The licensed copy of a notice, without warranty"


def _text_index(spark, sf_dir):
    from quern.sources.store import scratch
    from quern.sources.text_index import TextIndex

    return _once(spark, sf_dir, "texts", lambda: TextIndex(spark, scratch(spark)).build(_read(spark, sf_dir, "documents"), "doc_id", "text"))


def ranked_search(spark, sf_dir) -> DataFrame:
    return _text_index(spark, sf_dir).search(WORDS, 20).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def ranked_search_all(spark, sf_dir) -> DataFrame:
    """The best documents for each benchmark text."""
    q = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return _text_index(spark, sf_dir).search_all(q, 5).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def title_suggestions(spark, sf_dir) -> DataFrame:
    """The urls nearest to each url with a letter left out and another doubled."""
    from quern.sources.store import scratch
    from quern.sources.text_index import TitleIndex

    p, n = _read(spark, sf_dir, "pages"), F.length("url")
    index = TitleIndex(spark, scratch(spark)).build(p, "url")
    cut = F.concat(F.substring("url", F.lit(1), n - 3), F.substring("url", n - 1, F.lit(2)))
    asked = F.concat(F.substring(cut, 1, 12), F.substring(cut, F.lit(12), F.length(cut)))
    return index.near(p.select(F.col("page_id").alias("query_id"), asked.alias("text")), 3).select(F.col("query_id").alias("page_id"), "rank", F.col("title").alias("url"), "edits")


def entity_mentions(spark, sf_dir) -> DataFrame:
    """Which entities each document names, as rows out of structured answers."""
    from quern.providers import Providers

    answers = derive.entity_answers(_section_nodes(spark, sf_dir), Providers())
    return derive.mentions(answers).select("entity_id", "kind", "name", "context", F.col("node_id").alias("doc_id"))


def entity_table(spark, sf_dir) -> DataFrame:
    """Each entity once, with how many documents name it."""
    from quern.providers import Providers

    return derive.entity_table(derive.mentions(derive.entity_answers(_section_nodes(spark, sf_dir), Providers()))).select("entity_id", "kind", "name", "sections")


_QUERIES = (
    knn_filtered_topk, text_first_hits, rrf_fusion, parent_lookup, context_concat, clean_text, sanitise_title, intro_split, section_titles, semantic_chunks, prev_next_links, edges_from_nodes,
    page_links, citation_groups, citation_resolve, vector_routing, embedding_flags, type_normalise, token_cost, union_nodes, search_topn, node_to_graph, generated_queries, payload_ids,
    wiki_tables, page_nodes, extractive_summary, entities_rule, key_takeaways, string_parts, base64_texts, page_fetch, page_lookup, section_content, section_nodes, section_map, page_documents,
    in_text_references, cite_notes, all_citations, citations_by_section, citation_nodes, wiki_ref_nodes, image_counts, usable_answers, embedded_nodes, node_lookup, run_queries, fusion_retrieve,
    table_analysis, image_gates, image_nodes, image_stages, latest_pages, stored_nodes, stored_edges, stored_vectors, stored_node,
    entity_mentions, entity_table, scrolled_vectors, indexed_knn, probed_recall, ranked_search, ranked_search_all, title_suggestions,
)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    from quern import oracles

    return dict(oracles.SQL)
