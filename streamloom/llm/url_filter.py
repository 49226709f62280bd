"""URL filters: allow and block rules on hosts and path prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of a digest that the join compares; the rest is confirmed afterwards.
PREFIX_DIGITS = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case. Path: from there up to
    ``?``, ``#`` or the end. Both are empty for a null url or one without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _digest(host: Column, folder: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), folder), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Judge each row of ``pages`` by ``rules`` (``rule``: host and path in one string, ``verdict``).

    Adds ``host``, ``path``, ``rule`` and ``verdict``; columns of these names that ``pages`` has already are replaced.
    A rule fits its host and all subdomains if the url's path starts with the rule's path. The longest fitting rule
    wins; of equal rules with two verdicts, ``block``. Without one, ``rule`` is null and ``verdict`` the default.

    Each distinct (host, path) is expanded into its host suffixes times its path prefixes that end in ``/`` (and the
    empty one), no deeper than any rule. They meet the rules, keyed by host and path up to the last ``/``, on a short
    prefix of a digest; then the full digest and the whole path are compared. Repeated rows are kept, null and empty
    urls match nothing but get the default verdict, an empty rule table gives the default everywhere.
    """
    slash = F.locate("/", F.col("rule"))
    rules = (
        rules.where(F.col("rule").isNotNull())
        .select("rule", "verdict", F.when(slash > 0, F.substring_index("rule", "/", 1)).otherwise(F.col("rule")).alias("r_host"), F.when(slash > 0, F.col("rule").substr(slash, F.length("rule"))).otherwise("").alias("r_path"))
        .withColumn("r_host", F.translate("r_host", UPPER, LOWER))
        .withColumn("r_folder", F.regexp_extract("r_path", r"(?s)^.*/", 0))
        .withColumn("r_digest", _digest(F.col("r_host"), F.col("r_folder")))
        .withColumn("r_prefix", F.substring("r_digest", 1, PREFIX_DIGITS))
    )
    deep = rules.agg(F.max(F.size(F.split("r_host", r"\."))), F.max(F.size(F.split("r_folder", "/")))).first()
    labels, folders = int(deep[0] or 1), int(deep[1] or 1)

    host, path = host_and_path(F.col(url))
    judged = without(pages, "host", "path", "rule", "verdict") if url.lower() not in ("host", "path", "rule", "verdict") else pages
    judged = judged.withColumns({"__host": host, "__path": path})
    parts, steps = F.split("__host", r"\."), F.split("__path", "/")
    hosts = F.transform(F.sequence(F.greatest(F.size(parts) - (labels - 1), F.lit(1)), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    prefixes = F.transform(F.sequence(F.lit(1), F.least(F.size(steps), F.lit(folders))), lambda d: F.when(d == 1, "").otherwise(F.concat(F.array_join(F.slice(steps, 1, d - 1), "/"), F.lit("/"))))
    fitting = (
        judged.select("__host", "__path").distinct()
        .withColumn("suffix", F.explode(hosts))
        .withColumn("folder", F.explode(prefixes))
        .withColumn("digest", _digest(F.col("suffix"), F.col("folder")))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
        .join(small(rules), F.col("prefix") == F.col("r_prefix"))
        .where((F.col("digest") == F.col("r_digest")) & (F.col("suffix") == F.col("r_host")) & F.col("__path").startswith(F.col("r_path")))
        .groupBy(F.col("__host").alias("__h"), F.col("__path").alias("__p"))
        .agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("__best"))
    )
    out = judged.join(fitting, (F.col("__host") == F.col("__h")) & (F.col("__path") == F.col("__p")), "left")
    best = F.col("__best")
    return out.withColumns({"host": F.col("__host"), "path": F.col("__path"), "rule": best["rule"], "verdict": F.coalesce(best["verdict"], F.lit(default))}).drop("__host", "__path", "__h", "__p", "__best")
