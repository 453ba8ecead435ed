"""URL filters by hashed expressions.

Each URL becomes host-suffix and path-prefix expressions, of the label counts and path lengths that rules have; these meet
the rules by an equi-join on the first 4 bytes of their SHA-256, full digests confirm, and the longest fitting rule wins.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: (host, path, verdict) of the registered query.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Distinct (labels, path length) shapes of a rule table; every URL gives at most one expression a shape.
MAX_SHAPES = 4096


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A to Z lower-cased) after the first ``://``, and path up to ``?`` or ``#``; both empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return ascii_lower(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def compiled_rules(rules: DataFrame) -> DataFrame:
    """Rules as ``rule``, ``verdict``, digest and short prefix; of rules with equal text a block wins."""
    text = F.concat(F.col("host"), F.col("path"))
    return (
        rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull())
        .groupBy(text.alias("rule")).agg(F.max("verdict").alias("verdict"), F.first(F.size(F.split("host", r"\."))).alias("labels"), F.first(F.length("path")).alias("path_len"))
        .withColumn("digest", F.sha2("rule", 256)).withColumn("prefix", F.substring("digest", 1, 8))
    )


def filter_urls(pages: DataFrame, rules: DataFrame | Iterable[tuple[str, str, str]] = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every row's URL: id, ``host``, ``path``, ``rule`` (null if none fits) and ``verdict`` (``default`` if none fits).

    A null URL or one without ``://`` has empty host and path. Equal (host, path) pairs are judged once; repeated rows and
    null ids keep their rows; an empty table gives no rows.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    rules = compiled_rules(rules)
    shapes = [tuple(r) for r in rules.select("labels", "path_len").distinct().limit(MAX_SHAPES + 1).collect()]
    if len(shapes) > MAX_SHAPES:
        raise ValueError(f"more than {MAX_SHAPES} distinct rule shapes")
    host, path = host_and_path(F.coalesce(F.col(url_col).cast("string"), F.lit("")))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    fits = F.array(*(
        F.when((F.size(labels) >= k) & (F.length("path") >= n), F.concat(F.substring_index("host", ".", -k), F.substring("path", 1, n)))
        for k, n in shapes
    )) if shapes else F.array().cast("array<string>")
    expressions = (
        rows.select("host", "path").distinct().select("host", "path", F.explode(F.array_compact(fits)).alias("expression"))
        .select("host", "path", F.sha2("expression", 256).alias("full")).withColumn("prefix", F.substring("full", 1, 8))
    )
    found = (
        expressions.join(rules, "prefix").filter(F.col("full") == F.col("digest"))
        .groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "verdict", "rule")).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("said"))
    )
    return rows.join(found, ["host", "path"], "left").select(id_col, "host", "path", "rule", F.coalesce("said", F.lit(default)).alias("verdict"))
