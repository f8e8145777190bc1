"""URL filter rules as a sort-merge range join.

A host becomes its labels in reverse, each followed by a dot (`www.example.com` is
`com.example.www.`).  A rule for a host and its subdomains is then one interval of keys,
[`com.example.`, `com.example/`), since "/" follows "." in byte order.  Intervals of prefixes are
nested or apart, so one pass over the sorted union of rule starts and urls needs only a stack: at
a url the stack holds exactly the rules whose interval covers its host; among those the longest
(host and path together) whose path begins the url's path decides.

Scale: keys are cut at quantiles of a bounded sample of (key, path); a rule goes to each range
that its interval meets, a url to the one range it lies in.  Cuts that fall on one and the same
key mark a hot key, whose urls are dealt over all ranges between the equal cuts, with the rules.
Nothing is broadcast but the cuts.  The sample is a share of the rows, so that some SAMPLE of them reach
the driver from all tasks together; it moves the cuts only, never the result.

Defined cases: a null url or one without "://" has empty host and path and fits only a rule with
an empty host; repeated rows stay; extra columns are carried by the general operator only if
asked for (`keep`); no rules: every url gets the default verdict.  Of rules of the same length
the one with the longer host wins, then "block" over "allow".
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import lean, row_count

TOP = "\U0010ffff"
SAMPLE = 8192


def url_host(url):
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url):
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host):
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


class Sweep:
    """The stack of active nested rules over a sorted stream of rule starts and keys."""

    def __init__(self):
        self.stack: list[tuple[str, str, dict[str, tuple[str, str]], list[int]]] = []

    def rule(self, key: str, host: str, path: str, verdict: str) -> None:
        self.leave(key)
        end = key[:-1] + "/" if key else TOP * 2
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, end, {}, []))
        paths, sizes = self.stack[-1][2:]
        if path not in paths or verdict == "block":
            paths[path] = (host + path, verdict)
        if len(path) not in sizes:
            sizes.append(len(path))
            sizes.sort(reverse=True)

    def leave(self, key: str) -> None:
        while self.stack and not key < self.stack[-1][1]:
            self.stack.pop()

    def judge(self, key: str, path: str) -> tuple[str, str] | None:
        self.leave(key)
        best = None
        for _, _, paths, sizes in reversed(self.stack):  # the longest host first: it wins ties
            for n in sizes:
                found = paths.get(path[:n]) if n <= len(path) else None
                if found:
                    if best is None or len(found[0]) > len(best[0]):
                        best = found
                    break
        return best


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", ranges: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, host, path, rule, verdict) for every row of pages; rules: (host, path, verdict)."""
    spark = pages.sparkSession
    n = ranges or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    urls = pages.select(F.col(id_col).alias("_id"), url_host(F.col(url_col)).alias("_host"), url_path(F.col(url_col)).alias("_path"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])
    urls = urls.withColumn("_key", host_key(F.col("_host")))
    chance = min(1.0, SAMPLE / max(1, row_count(urls)))  # some SAMPLE rows of all tasks together
    drawn = urls.select("_key", "_path").sample(chance, 7) if chance < 1 else urls.select("_key", "_path")
    rows = sorted((r[0], r[1]) for r in drawn.limit(4 * SAMPLE).collect())
    cuts = [rows[len(rows) * i // n] for i in range(1, n)] if rows else []

    @F.pandas_udf("int")
    def place(key, path, salt):
        lo = [bisect_left(cuts, k) for k in zip(key, path)]
        hi = [bisect_right(cuts, k) for k in zip(key, path)]
        lo, hi = np.array(lo, np.int64), np.array(hi, np.int64)
        import pandas as pd

        return pd.Series((lo + salt.to_numpy() % (hi - lo + 1)).astype(np.int32))

    urls = urls.withColumn("_range", place("_key", "_path", F.pmod(F.xxhash64("_id", "_host", "_path"), F.lit(1 << 30))))  # by content: a task that runs again deals its rows alike
    heads = rules.select(F.coalesce(F.lower("host"), F.lit("")).alias("_host"), F.coalesce("path", F.lit("")).alias("_path"), F.col("verdict").alias("_verdict")).where("_verdict is not null").distinct()
    heads = heads.withColumn("_key", host_key(F.col("_host")))

    @F.pandas_udf("array<int>")
    def meets(key):
        import pandas as pd

        first = [bisect_left(cuts, (k, "")) for k in key]
        last = [bisect_right(cuts, ((k[:-1] + "/") if k else TOP * 2, "")) for k in key]
        return pd.Series([list(range(a, b + 1)) for a, b in zip(first, last)])

    heads = heads.withColumn("_range", F.explode(meets("_key")))
    extra = [f"_k{i}" for i in range(len(keep))]
    both = heads.select("_range", "_key", F.lit(0).alias("_kind"), "_host", "_path", "_verdict", F.lit(None).cast(urls.schema["_id"].dataType).alias("_id"), *[F.lit(None).cast(urls.schema[c].dataType).alias(c) for c in extra]).unionByName(
        urls.select("_range", "_key", F.lit(1).alias("_kind"), "_host", "_path", F.lit(None).cast("string").alias("_verdict"), "_id", *extra)
    )
    both = both.repartitionById(n, "_range").sortWithinPartitions("_range", "_key", "_kind", "_path")

    def run(batches):
        at, sweep = None, Sweep()
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(6)]
            keep_rows, rule, verdict = [], [], []
            for i, (r, key, kind, host, path, v) in enumerate(zip(*cols)):
                if r != at:
                    at, sweep = r, Sweep()
                if kind == 0:
                    sweep.rule(key, host, path, v)
                    continue
                found = sweep.judge(key, path)
                keep_rows.append(i)
                rule.append(found[0] if found else None)
                verdict.append(found[1] if found else default)
            took = b.take(pa.array(keep_rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([took.column(6), took.column(3), took.column(4), pa.array(rule, pa.string()), pa.array(verdict, pa.string()), *[took.column(7 + i) for i in range(len(extra))]], names=[id_col, "host", "path", "rule", "verdict", *keep])

    types = {f.name: f.dataType.simpleString() for f in urls.schema}
    schema = f"`{id_col}` {types['_id']}, host string, path string, rule string, verdict string" + "".join(f", `{c}` {types[e]}" for c, e in zip(keep, extra))
    return both.mapInArrow(lean(run), schema)


#: The rules of the registered query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")
