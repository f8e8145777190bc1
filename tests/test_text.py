from hypothesis import HealthCheck, example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import text

MARKUP = st.lists(st.sampled_from(["== A ==", "=== b ===", "==== c ====", "x ==y== z", "word", "\n", "\n", "\r", " ", " ", "=", "é"]), max_size=14).map("".join)


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def scan_headings(value):
    """Heading lines, read character by character: two equal signs and not a third, or three, then up to
    the next such mark in the line."""
    out = []
    for line in value.split("\n"):
        for mark in ("==", "==="):
            if line.startswith(mark) and (mark == "===" or len(line) > 2 and line[2] != "="):
                end = line.find(mark, 3)
                if end >= 0:
                    out.append(line[: end + len(mark)])
                    break
    return out


def trimmed(value, drop):
    """Without the characters of drop at both ends."""
    a, z = 0, len(value)
    while a < z and value[a] in drop:
        a += 1
    while z > a and value[z - 1] in drop:
        z -= 1
    return value[a:z]


def dashed(value):
    out = ""
    for c in value:
        c = "-" if c in '<>:,"/\\|?*-' or c.isspace() else c
        if not (c == "-" and out.endswith("-")):
            out += c
    return out


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(MARKUP, min_size=20, max_size=40))
def test_markup_equals_a_plain_model(spark, values):
    assert column(spark, values, text.headings) == [scan_headings(v) for v in values]
    for v, got in zip(values, column(spark, values, text.intro)):
        assert got == trimmed(got, " \n\r\u2028\u2029") and (v.strip().startswith(got))
        if "==" not in v:
            assert got == v.strip()


@settings(max_examples=20, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.sampled_from("aZ9 \t\n\r\u0085\u2028 é<>:,\"/\\|?*-._[]"), max_size=12), min_size=20, max_size=40))
@example(values=['"a"\n', '\né "]]\n', "[a]\r\n", "]\u2028", '"\u0085', " \n", "== x ==\n"])
def test_cleaning_equals_a_plain_model(spark, values):
    assert column(spark, values, text.clean) == ["".join(c for c in v if c == " " or c.isascii() and c.isalnum()) for v in values]
    assert column(spark, values, text.sanitise_title) == [dashed(v) for v in values]
    assert column(spark, values, text.unquoted) == [trimmed(v, '"') for v in values]
    assert column(spark, values, text.unbracketed) == [trimmed(v, "[]") for v in values]
    assert column(spark, values, text.strip) == [v.strip() for v in values]
    assert column(spark, values, text.heading_title) == [trimmed(v, "= ").strip() for v in values]


def test_golden_cleaner(spark):
    assert column(spark, ["This! is a, test with: special characters."], text.clean) == ["This is a test with special characters"]


def test_small_expressions(spark):
    assert column(spark, ["https://x/y/Pic.big.PNG", "a/b.p\n", "a/b"], text.url_name) == ["Pic.big", "b", "b"]
    assert column(spark, ["cite_ref-12"], text.cite_number) == ["12"]
    assert column(spark, ["wiki-ref Xy"], text.capitalise) == ["Wiki-ref xy"]
    assert column(spark, [None, "", "Plot", "sensitive_image", "Other"], text.image_type) == ["unknown", "unknown", "plot", "image", "other"]
    assert column(spark, [" a\n\n b \n"], text.query_lines) == [["a", "b"]]
    assert column(spark, ["x", text.FAILED, "", None, "Error: unable to see"], lambda c: F.coalesce(text.usable_answer(c, True), F.lit(False))) == [True, False, False, False, False]
    df = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "p int, n int")
    assert [r[0] for r in df.select(text.archive_suffix(F.col("p"), F.col("n"))).collect()] == ["archive", "archive-1", "archive-2"]
