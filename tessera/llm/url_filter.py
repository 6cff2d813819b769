"""URL filters by a sort-merge range join, with DataFrame functions only.

A rule (host, path, verdict) fits its host and all subdomains, where the URL's path starts with
the rule's path. Two sweeps over sorted keys find the rules, each over intervals that nest or are disjoint:

1. Hosts. The canonical key of a host is its labels from the last to the first, each closed by a separator, so a rule's host
   and its subdomains are the interval of keys that begin with its key. Boundaries of these intervals and the
   different hosts of URLs are swept together, and every host is handed the stack of rule hosts that are open there.
2. Paths. A different (host, path) stands under each rule host of its stack that is its own; there a rule's path is
   the interval of paths that begin with it. Boundaries and paths are swept together, and every path is handed
   the stack of rules that are open there; the longest of all wins (host length plus path length, then the smaller name).

A sweep sorts its rows by key and deals them by ranges of keys, which hold about as many rows each, however many share a
host or a path (further columns split equal keys). Each boundary carries the stack as it stands after it: an opening puts
its rule on its parents' stack, a closing takes it off; both follow from the rules alone, as a parent is a rule with a
proper prefix. Inside a range a row takes the stack of the last boundary before it; a range begins with the stack that
stood at the end of the last range with a boundary, one row for each range.

Different hosts and (host, path) pairs are judged once and joined back to the rows, so repeated URLs cost
nothing in the sweeps; hosts and places that many rows share are dealt in pieces there. The work is linear in a URL's length.

Null url or one without "://": host and path empty, no rule, verdict allow. Of rules with the
same host and path, "block" goes before "allow". Rules with null host or path don't count.
Empty pages or rules give an empty result or no matches. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, salted_join

#: Fixed rules of the digest: host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: from there up to ? # or the end."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _host_key(host: Column) -> Column:
    """Bytes, which Spark compares unsigned. A separator inside a label is told apart from the one that closes it."""
    labels = F.split(F.replace(host, F.lit("\x01"), F.lit("\x01\x02")), r"\.", -1)
    return F.concat(F.array_join(F.reverse(labels), "\x01\x01"), F.lit("\x01\x01")).cast("binary")


def _is_under(host: Column, rule_host: Column) -> Column:
    return (host == rule_host) | host.endswith(F.concat(F.lit("."), rule_host))


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "host string, path string, verdict string")


def _boundaries(intervals: DataFrame, parents: DataFrame, by: list[str]) -> DataFrame:
    """by, key, rank (closes before opens before others), stack after it. intervals: by, key, rule;
    parents: by, key, parents (their rules, the outermost first)."""
    known = intervals.join(parents, [*by, "key"], "left")
    outer = F.coalesce("parents", F.array().cast(known.schema["parents"].dataType))
    opens = known.select(*by, "key", F.lit(1).alias("rank"), F.concat(outer, F.array("rule")).alias("stack"))
    closes = known.select(*by, F.concat("key", F.lit(bytearray(b"\xff"))).alias("key"), F.lit(0).alias("rank"), outer.alias("stack"))
    return opens.unionByName(closes)


def _swept(rows: DataFrame, marks: DataFrame, by: list[str]) -> DataFrame:
    """rows (by, key, and others), each with the stack of the last boundary before it among those with its `by`."""
    others = [c for c in rows.columns if c not in (*by, "key")]
    kind = marks.schema["stack"].dataType
    told = marks.select(*by, "key", "rank", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in others], "stack")
    asked = rows.select(*by, "key", F.lit(2).alias("rank"), *others, F.lit(None).cast(kind).alias("stack"))
    order = [*by, "key", "rank"]
    dealt = materialize(asked.unionByName(told).repartitionByRange(*order, *others).withColumn("range", F.spark_partition_id()), "sweep")
    # a boundary always tells its stack, be it empty; others take it from the last boundary before them
    state = F.when(F.col("rank") < 2, F.struct(*by, "stack"))
    ends = dealt.where("rank < 2").groupBy("range").agg(F.max_by(F.struct(*by, "stack"), F.struct(*order)).alias("end"))
    ranges = dealt.select("range").distinct().join(ends, "range", "left")  # a row for each range of keys
    before = F.last("end", ignorenulls=True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    carried = ranges.select("range", before.alias("carried"))
    inside = F.last(state, ignorenulls=True).over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    swept = dealt.withColumn("inside", inside).where("rank = 2").join(F.broadcast(carried), "range").withColumn("last", F.coalesce("inside", "carried"))
    own = F.lit(True)
    for c in by:
        own = own & F.col(f"last.{c}").eqNullSafe(F.col(c))
    return swept.select(*by, "key", *others, F.when(own, F.col("last.stack")).alias("stack"))


def _outer(intervals: DataFrame, shorter: DataFrame, by: list[str]) -> DataFrame:
    """by, key, parents: for each interval, the rules of those that hold it, the outermost first. shorter: by, key, above (a key that may hold it)."""
    found = shorter.join(intervals.select(*by, F.col("key").alias("above"), "rule"), [*by, "above"])
    listed = F.sort_array(F.collect_list(F.struct(F.length("above").alias("n"), "rule")))
    return found.groupBy(*by, "key").agg(F.transform(listed, lambda x: x["rule"]).alias("parents"))


def judge(pages: DataFrame, rules: DataFrame | None = None, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict: one row per page."""
    rules = default_rules(pages.sparkSession) if rules is None else rules
    name = F.concat("host", "path")
    rules = (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
        .select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
        .select("host", F.col("path").cast("binary").alias("key"), F.struct(F.length(name).alias("length"), name.alias("name"), "verdict").alias("rule"))
    )
    rules = materialize(rules, "url-rules")
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    places = materialize(urls.where((F.col("host") != "") | (F.col("path") != "")).groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")), "url-places")

    # 1: rule hosts over hosts
    hosts = rules.select(F.col("host").alias("rule")).distinct().select(_host_key(F.col("rule")).alias("key"), "rule")
    labels = F.split("rule", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(2), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    shorter = hosts.where(F.size(labels) > 1).select("key", F.explode(suffixes).alias("above")).select("key", _host_key(F.col("above")).alias("above"))
    marks = _boundaries(hosts, _outer(hosts, shorter, []), [])
    asked = places.select("host").distinct().select(_host_key(F.col("host")).alias("key"), "host")
    own = F.filter("stack", lambda rule_host: _is_under(F.col("host"), rule_host))
    under = _swept(asked, marks, []).where(F.size("stack") > 0).select("host", own.alias("rule_hosts"))

    # 2: rules of a host over paths
    lengths = rules.groupBy("host").agg(F.collect_set(F.length("key")).alias("lengths"))
    shorter = rules.join(lengths, "host").select("host", "key", F.explode(F.filter("lengths", lambda n: n < F.length("key"))).alias("n"))
    shorter = shorter.select("host", "key", F.substring("key", F.lit(1), F.col("n")).alias("above"))
    marks = _boundaries(rules, _outer(rules, shorter, ["host"]), ["host"]).withColumnRenamed("host", "rule_host")
    paths = places.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    listed = salted_join(places.select("host", "path"), under, "host", paths, F.xxhash64("path"))
    asked = listed.select(F.explode("rule_hosts").alias("rule_host"), F.col("path").cast("binary").alias("key"), "host", "path")
    found = _swept(asked, marks, ["rule_host"]).where(F.size("stack") > 0)
    # the top of the stack is the longest of its host; of several hosts the longest, then the smaller name
    top = F.element_at("stack", -1)
    best = found.groupBy("host", "path").agg(F.min(F.struct((-top["length"]).alias("shortness"), top["name"].alias("rule"), top["verdict"].alias("verdict"))).alias("best"))
    place = F.struct("host", "path").alias("place")
    joined = salted_join(urls.select("page_id", place), best.select(place, "best"), "place", places.select(place, "n"), F.xxhash64("page_id"))
    return joined.select(F.col("page_id").cast("long").alias("page_id"), "place.host", "place.path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
