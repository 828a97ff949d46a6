"""URL keys: registrable domain, domain with path, flat key, depth, crawl year."""

from __future__ import annotations

import glob
import os
import zipfile
from functools import lru_cache
from weakref import WeakKeyDictionary

import pyarrow as pa
import pyspark
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Hosts may hold "_", for which parse_url(…, 'HOST') gives NULL; hence patterns.
_SCHEME = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?"
_AUTHORITY = _SCHEME + r"(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)"
_PATH = _SCHEME + r"[^/?#]*([^?#]*)"
_IPV4 = r"^[0-9.]+$"

RULE, WILDCARD, EXCEPTION = 1, 2, 4
_SUFFIX_RESOURCE = "mozilla/public-suffix-list.txt"


def url_host(url: Column, underscore_as_slash: bool = False) -> Column:
    """Host in lower case, without user, port, path, query and final dots. Underscores become slashes first when asked."""
    host = F.regexp_extract(F.translate(url, "_", "/") if underscore_as_slash else url, _AUTHORITY, 1)
    return F.rtrim(F.lower(host), F.lit("."))


def url_path(url: Column, underscore_as_slash: bool = False) -> Column:
    return F.regexp_extract(F.translate(url, "_", "/") if underscore_as_slash else url, _PATH, 1)


def url_level(url: Column) -> Column:
    """Depth of the page: ``http://a.com`` is 0, ``http://a.com/`` is 1, ``/a/b`` is 2."""
    return F.size(F.split(url_path(url), "/")) - 1


def crawl_year(stamp: Column) -> Column:
    """First four characters of the record date; NULL when they are not a number."""
    return F.substring(stamp.cast("string"), 1, 4).try_cast("int")


def flat_key(url: Column) -> Column:
    bare = F.replace(F.replace(url, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
    return F.translate(bare, ":/?", "___")


@lru_cache(maxsize=1)
def _suffix_rules() -> tuple[tuple[str, int], ...]:
    """(suffix, kinds) of the public-suffix list inside Spark's own HTTP client jar."""
    homes = [h for h in (os.environ.get("SPARK_HOME"), os.path.dirname(pyspark.__file__)) if h]
    jars = [jar for home in homes for jar in sorted(glob.glob(os.path.join(home, "jars", "httpclient-*.jar")))]
    if not jars:
        raise FileNotFoundError(f"no httpclient jar with the public-suffix list below {homes}")
    with zipfile.ZipFile(jars[-1]) as jar:
        lines = jar.read(_SUFFIX_RESOURCE).decode("utf-8").splitlines()
    kinds: dict[str, int] = {}
    for rule in (line.split()[0] for line in lines if line.strip() and not line.startswith("//")):
        kind = EXCEPTION if rule.startswith("!") else WILDCARD if rule.startswith("*.") else RULE
        key = rule.lstrip("!").removeprefix("*.")
        kinds[key] = kinds.get(key, 0) | kind
    return tuple(kinds.items())


_SUFFIX_TABLES: WeakKeyDictionary[SparkSession, DataFrame] = WeakKeyDictionary()


def suffix_table(spark: SparkSession) -> DataFrame:
    """The public-suffix rules: a published list of about ten thousand rows, so safe to broadcast."""
    if spark not in _SUFFIX_TABLES:
        suffixes, kinds = zip(*_suffix_rules())
        rules = pa.table({"suffix": pa.array(suffixes), "kinds": pa.array(kinds, pa.int32())})
        _SUFFIX_TABLES[spark] = spark.createDataFrame(rules)
    return _SUFFIX_TABLES[spark]


@lru_cache(maxsize=1)
def _suffix_depth() -> int:
    return max(key.count(".") + 1 for key, _ in _suffix_rules())


def with_registrable_domain(df: DataFrame, url: str, out: str = "company",
                            underscore_as_slash: bool = True) -> DataFrame:
    """Add the registrable domain (public suffix plus one label) of a URL or key column.

    One left hash join per label depth against the broadcast rules: no shuffle, no explode, no
    Python worker. Exceptions beat other rules, else the longest rule wins, else the last label
    counts as the suffix. A host that is an address or itself a suffix is returned as it is.
    """
    rules = suffix_table(df.sparkSession)
    depths = range(1, _suffix_depth() + 1)
    kept = [F.col(f"`{c}`") for c in df.columns if c != out]
    found = df.select("*", url_host(F.col(url), underscore_as_slash).alias("_host")).select(
        *kept, "_host", F.split("_host", r"\.").alias("_labels")
    )
    for d in depths:
        side = rules.selectExpr(f"suffix AS _suffix{d}", f"kinds AS _kinds{d}")
        tail = f"CASE WHEN size(_labels) >= {d} THEN lower(array_join(slice(_labels, -{d}, {d}), '.')) END"
        found = found.join(F.broadcast(side), F.expr(f"{tail} = _suffix{d}"), "left")
    has = "(coalesce(_kinds{0}, 0) & {1}) > 0"
    exceptions = [f"CASE WHEN {has.format(d, EXCEPTION)} THEN {d - 1} END" for d in depths]
    lengths = [f"CASE WHEN {has.format(d, RULE)} THEN {d} END" for d in depths]
    lengths += [f"CASE WHEN {has.format(d, WILDCARD)} AND size(_labels) > {d} THEN {d + 1} END" for d in depths]
    keep = f"coalesce({', '.join(exceptions)}, greatest(1, {', '.join(lengths)})) + 1"
    found = found.select(*kept, "_host", "_labels", F.expr(keep).alias("_keep"))
    domain = f"""CASE WHEN _host RLIKE '{_IPV4}' OR _host LIKE '[%' OR size(_labels) < _keep THEN _host
                      ELSE array_join(slice(_labels, -_keep, _keep), '.') END"""
    return found.select(*kept, F.expr(domain).alias(out))


def with_domain_path_key(df: DataFrame, url: str, out: str = "company") -> DataFrame:
    """Add the registrable domain followed by the path with ``/`` written as ``_``."""
    key = F.translate(url_path(F.col(url), underscore_as_slash=True), "/", "_")
    return with_registrable_domain(df, url, "_domain").withColumn(out, F.concat("_domain", key)).drop("_domain")
