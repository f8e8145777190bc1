"""Links and citations of pages, as rows.

A link row is (page_id, section, section_pos, pos, text, url): pos orders the links of a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import markup, text

#: Sections that hold the references themselves.
REFERENCE_SECTIONS = ("References", "Citations")


def page_links(pages: DataFrame) -> DataFrame:
    """Every link of each page (page_id, links array<struct<section,text,url>>) as a row."""
    one = pages.select("page_id", F.posexplode("section_links").alias("pos", "l"))
    rows = one.select("page_id", F.col("l.section").alias("section"), F.col("pos").cast("long").alias("pos"), F.coalesce("l.text", F.lit("")).alias("text"), F.coalesce("l.url", F.lit("")).alias("url"))
    first = Window.partitionBy("page_id", "section")
    return rows.withColumn("section_pos", F.min("pos").over(first))


def in_text_references(links: DataFrame) -> DataFrame:
    """Links to notes, by section."""
    return links.where(markup.is_cite_note(F.col("url")))


def wiki_links(links: DataFrame) -> DataFrame:
    """Links that are neither notes nor images, outside the reference sections; of equal links of a
    section the first stays."""
    rows = links.where(markup.is_wiki_link(F.col("url")) & ~F.coalesce(F.col("section").isin(*REFERENCE_SECTIONS), F.lit(False)))
    return rows.groupBy("page_id", "section", "section_pos", "text", "url").agg(F.min("pos").alias("pos"))


def cite_notes(links: DataFrame) -> DataFrame:
    """(page_id, section, section_pos, pos, ref_no): note numbers that sections cite."""
    rows = links.where(F.col("url").contains("cite_note") & ~F.coalesce(F.col("section").isin(*REFERENCE_SECTIONS), F.lit(False)))
    return rows.select("page_id", "section", "section_pos", "pos", text.unbracketed(F.col("text")).alias("ref_no"))


def reference_links(links: DataFrame) -> DataFrame:
    """Links of the section References; of Citations where a page has none there."""
    rows = links.where(F.col("section").isin(*REFERENCE_SECTIONS))
    own = Window.partitionBy("page_id")
    has = F.max((F.col("section") == "References").cast("int")).over(own)
    return rows.withColumn("_has", has).where((F.col("section") == "References") | (F.col("_has") == 0)).drop("_has")


def reference_tuples(links: DataFrame) -> DataFrame:
    """(page_id, ref_pos, cite_ref, ref_no, title, link, archived): one row for each reference.

    A link whose text is ^ begins a reference; those up to the next ^ belong to it: the first that
    has a text gives the title, the first of all the link, the rest are archives.  References
    without links go, as do links to type hints and links before the first ^."""
    rows = links.where(~F.col("url").contains("#cite_ref-type_hint"))
    order = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.col("text") == "^"
    rows = rows.withColumn("ref_pos", F.sum(F.when(mark, 1).otherwise(0)).over(order).cast("long")).where("ref_pos > 0")
    row = F.struct("pos", "text", "url")
    grouped = rows.groupBy("page_id", "ref_pos").agg(F.max(F.when(mark, F.col("url"))).alias("cite_ref"), F.array_sort(F.collect_list(F.when(~mark, row))).alias("l"))
    titled = F.filter("l", lambda x: x["text"] != "")
    out = grouped.where((F.size("l") > 0) & (F.coalesce(F.col("cite_ref"), F.lit("")) != ""))
    return out.select(
        "page_id", "ref_pos", "cite_ref", text.cite_number(F.col("cite_ref")).alias("ref_no"),
        F.coalesce(F.get(titled, 0)["text"], F.lit("")).alias("title"), F.get("l", 0)["url"].alias("link"),
        F.transform(F.slice("l", 2, 1 << 30), lambda x: x["url"]).alias("archived"),
    )


def section_citations(notes: DataFrame, refs: DataFrame) -> DataFrame:
    """(page_id, section, section_pos, pos, ref_no, title, link, archived): references where sections
    cite them, in order.  Of references of one number the last counts.  References that no section
    cites stand under Introduction (section_pos -1), unless a section of that name cites any."""
    last = refs.groupBy("page_id", "ref_no").agg(F.max_by(F.struct("title", "link", "archived"), "ref_pos").alias("r"), F.min("ref_pos").alias("ref_pos"))
    own = notes.where("section = 'Introduction'").select("page_id", F.lit(True).alias("_own")).distinct()
    cites = notes.select("page_id", "ref_no", "section", "section_pos", "pos", F.lit(True).alias("_cited"))
    rows = last.join(cites, ["page_id", "ref_no"], "left").join(own, "page_id", "left").where("_cited or _own is null")  # references are read once
    cited = F.col("_cited").isNotNull()
    return rows.select(
        "page_id", F.when(cited, F.col("section")).otherwise("Introduction").alias("section"), F.when(cited, F.col("section_pos")).otherwise(F.lit(-1).cast("long")).alias("section_pos"),
        F.when(cited, F.col("pos")).otherwise(F.col("ref_pos").cast("long")).alias("pos"), "ref_no", "r.*",
    )


def citations_by_section(cited: DataFrame) -> DataFrame:
    """(page_id, section, actual, archived): links of each section, collected in order."""
    row = F.array_sort(F.collect_list(F.struct("pos", "title", "link", "archived")))
    one = cited.groupBy("page_id", "section", "section_pos").agg(row.alias("l"))
    return one.select(
        "page_id", "section",
        F.transform("l", lambda x: F.struct(x["title"].alias("title"), x["link"].alias("url"))).alias("actual"),
        F.transform("l", lambda x: F.struct(x["title"].alias("title"), x["archived"].alias("urls"))).alias("archived"),
    )


def all_citations(links: DataFrame) -> DataFrame:
    return section_citations(cite_notes(links), reference_tuples(reference_links(links)))
