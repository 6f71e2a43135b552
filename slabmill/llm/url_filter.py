"""URL filters: block and allow rules on host and path, found by a sort-merge range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slabmill.llm.common import ascii_lower, shuffle_partitions
from slabmill.session import stage

ALLOW, BLOCK = "allow", "block"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path; both empty for NULL or where there is no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return ascii_lower(part(1)), part(2)


def _reversed(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _rule_stacks(rules: DataFrame) -> DataFrame:
    """One row a rule key with the stack of rules that are open where it begins: its own and those around it, outermost first.

    Reversed hosts make a rule's urls an interval of keys, and two such intervals are nested or apart, so the rules around one are
    the rules whose keys are its prefixes. Two verdicts under one key: block.
    """
    host, path = F.substring_index("rule", "/", 1), F.expr("substr(rule, length(substring_index(rule, '/', 1)) + 1)")
    keyed = (
        rules.select(F.concat(ascii_lower(host), path).alias("rule"), "verdict")
        .select("rule", "verdict", F.concat(F.array_join(_reversed(host), "."), path).alias("key"))
        .groupBy("key", "rule")
        .agg(F.max("verdict").alias("verdict"))
    )
    ends = F.sequence(F.length(F.substring_index("key", "/", 1)) + 1, F.length("key"))
    inside = keyed.select("key", F.explode(ends).alias("end")).select("key", F.expr("left(key, end)").alias("outer"))
    around = keyed.select(F.col("key").alias("outer"), "rule", "verdict")
    entry = F.struct(F.length("outer").alias("length"), F.col("outer").alias("key"), "rule", "verdict")
    return inside.join(around, "outer").groupBy("key").agg(F.sort_array(F.collect_list(entry)).alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = ALLOW) -> DataFrame:
    """The verdict on every row's url: ``key``, host, path, rule and verdict; no other column is read.

    ``rules`` has ``rule`` (``host/path``: a host without scheme or port and a path that begins with ``/``) and ``verdict``. A rule fits its
    host and all subdomains where the path starts with the rule's. The longest fitting rule wins; of equally long ones that with
    the longer host, then block. Without one, ``rule`` is NULL and the verdict is ``default``. NULL urls have an empty host
    and path; NULL or repeated keys are judged row by row.

    A url stands for one key for each ancestor host that a rule could name: the reversed host and the path. Keys and rule
    starts are sorted together once, by ranges of (key, row), so one hot host is cut into many ranges. In each range a sweep in key
    order carries the stack of the last rule begun; what is open where a range begins comes from the ranges before it, one
    row a range. The rules that fit are the stack's prefixes of the key. All steps are DataFrame functions.
    """
    stacks = _rule_stacks(rules)
    # No rule is longer or has more labels: what lies beyond can't change a verdict, however long a url is.
    labels, length = stacks.agg(
        F.max(F.size(F.split(F.substring_index("key", "/", 1), r"\."))), F.max(F.length("key"))
    ).first() or (None, None)
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("id"), host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id())
    around = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size(F.split("host", r"\.")), F.lit(labels or 1))))
    probes = rows.withColumn("level", F.explode(around)).select(
        F.left(F.concat(F.array_join(F.slice(_reversed(F.col("host")), 1, F.col("level")), "."), F.col("path")), F.lit(length or 1)).alias("key"),
        F.lit(1).alias("kind"),
        "row",
        *(F.when(F.col("level") == 1, F.col(c)).alias(c) for c in ("id", "host", "path")),
    )
    both = stacks.withColumn("kind", F.lit(0)).withColumn("row", F.lit(-1).cast("long")).unionByName(probes, allowMissingColumns=True)
    ranges = both.repartitionByRange(shuffle_partitions(pages.sparkSession), "key", "kind", "row")
    swept = stage(ranges.withColumn("range", F.spark_partition_id()), "url-keys")

    begun = swept.groupBy("range").agg(F.max_by("stack", F.when(F.col("kind") == 0, F.col("key"))).alias("stack"))
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    open_at_start = begun.select("range", F.last("stack", ignorenulls=True).over(before).alias("open"))
    sweep = W.partitionBy("range").orderBy("key", "kind", "row").rowsBetween(W.unboundedPreceding, 0)
    stack = F.coalesce(F.last("stack", ignorenulls=True).over(sweep), F.col("open"))
    fitting = F.filter("stack", lambda r: F.startswith(F.col("key"), r["key"]))
    deepest = F.try_element_at(fitting, F.lit(-1))
    best = F.struct(
        F.length(deepest["rule"]).alias("length"), F.length(F.substring_index(deepest["rule"], "/", 1)).alias("host"), deepest["verdict"].alias("verdict"), deepest["rule"].alias("rule")
    )
    found = swept.join(F.broadcast(open_at_start), "range").withColumn("stack", stack).where("kind = 1").withColumn("best", F.when(deepest.isNotNull(), best))
    judged = found.groupBy("row").agg(F.max("best").alias("best"), *(F.first(c, ignorenulls=True).alias(c) for c in ("id", "host", "path")))
    return judged.select(
        F.col("id").alias(key), "host", "path", F.col("best")["rule"].alias("rule"), F.coalesce(F.col("best")["verdict"], F.lit(default)).alias("verdict")
    )
