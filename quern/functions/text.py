"""String, JSON and binary expressions; all run inside generated code.

Patterns say \\z for the end of a text: $ would match before a last line end as well."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Heading patterns.  (?d): only \n ends a line.
HEADING_ANYWHERE = r"(?d)(==[^=].*?==)|(===.*?===)"
HEADING_LINE = r"(?d)(?m)(^==[^=].*?==)|(^===.*?===)"


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode spaces included."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def intro(content: Column) -> Column:
    """The text before the first heading, which need not begin a line."""
    return strip(F.coalesce(F.get(F.split(F.coalesce(content, F.lit("")), HEADING_ANYWHERE, 2), 0), F.lit("")))


def headings(content: Column) -> Column:
    """Heading lines as they stand, in order."""
    return F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(HEADING_LINE), F.lit(0))


def heading_title(heading: Column) -> Column:
    return strip(F.regexp_replace(heading, r"\A[= ]+|[= ]+\z", ""))


def is_section(heading: Column) -> Column:
    """Two equal signs; three or more make a subsection."""
    return heading.rlike("^==[^=]")


def sanitise_title(c: Column) -> Column:
    """Safe as a file name: each of <>:,"/\\|?* becomes a dash, runs of spaces and dashes one dash."""
    return F.regexp_replace(F.regexp_replace(c, r'[<>:,"/\\|?*]', "-"), r"(?U)[\s-]+", "-")


def clean(c: Column) -> Column:
    """Only ASCII letters, digits and spaces stay; line ends and accented letters go."""
    return F.regexp_replace(c, "[^0-9A-Za-z ]", "")


def url_name(url: Column) -> Column:
    """The last part of a url's path without its extension."""
    return F.regexp_replace(F.element_at(F.split(url, "/"), -1), r"\.[^.]*\z", "")


def unquoted(c: Column) -> Column:
    return F.regexp_replace(c, r'\A"+|"+\z', "")


def unbracketed(c: Column) -> Column:
    return F.regexp_replace(c, r"\A[\[\]]+|[\[\]]+\z", "")


def cite_number(anchor: Column) -> Column:
    """What follows the last dash of a citation anchor."""
    return F.element_at(F.split(anchor, "-"), -1)


def archive_suffix(pos: Column, count: Column) -> Column:
    return F.when(count > 1, F.concat(F.lit("archive-"), (pos + 1).cast("string"))).otherwise("archive")


def capitalise(c: Column) -> Column:
    """First letter upper, all others lower: a label from a type."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def image_type(answer: Column) -> Column:
    """A classifier's answer as a node type: exactly `plot`, or `image` for all that contain it."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    return F.when(low == "", "unknown").when(low.contains("image"), "image").otherwise(low)


def token_cost(tokens: Column, price: float = 0.00002) -> Column:
    return tokens * F.lit(price)


def query_lines(answer: Column) -> Column:
    """Generated queries, one a line; blank lines are dropped."""
    return F.filter(F.transform(F.split(strip(answer), "\n"), strip), lambda x: x != "")


def to_base64(c: Column) -> Column:
    """On one line, as data urls need it."""
    return F.replace(F.base64(c), F.lit("\r\n"), F.lit(""))


def from_base64(c: Column) -> Column:
    return F.unbase64(c)


def payload_node_id(payload: Column) -> Column:
    """The node id inside a vector point's payload: JSON within JSON."""
    return F.get_json_object(F.get_json_object(payload, "$._node_content"), "$.id_")


#: Fixed value: what stands for a response that can't be read.
FAILED = "Transformation failed or unclear"


def usable_answer(c: Column, image_stage: bool = False) -> Column:
    """Whether a model's answer makes a node: there, not empty, and not a refusal."""
    ok = c.isNotNull() & (c != "") & (c != FAILED)
    return ok & ~F.lower(c).contains("error: unable") if image_stage else ok
