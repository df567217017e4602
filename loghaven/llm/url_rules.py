"""URL filters: a sort-merge range join on reversed-host keys, in DataFrame functions only.

A rule is a host suffix and a path prefix. Written with the labels of its host in
reverse order (``net.example/`` + ``/en/``) it is the prefix of the keys it fits, and a
prefix is an interval ``[key, key + 0xFF)`` of byte strings, since no UTF-8 text holds
the byte FF. Intervals of prefixes are nested or disjoint, so a sweep over sorted keys
needs a stack of active rules. The stack is kept in the events: the start of an interval
puts its rule on top, its end uncovers the rule that encloses it (its longest proper
prefix among the rules, computed once over the rules). The rule on top at a page is then
the last event before it, one window function over the sorted union of events and keys.

A rule also fits subdomains while its path must fit, so a page sends one probe for each
suffix of its host; the best of its probes' rules wins: the longest, then the one with
the longer host, then the first by text; for equal rules with different verdicts, block.

Keys are split into ranges at bounds drawn from the rules (at most ``RANGES``); each
range is swept by as many tasks as its number of probes asks for, each of which gets the
events of that range and the rules active at its lower bound. A host or prefix that holds
most of the pages is therefore spread, and no task sees all rules or all pages.

Defined results: a null URL or one without ``://`` has an empty host and path and no
rule; a null rule host fits nothing; with no rule the default verdict holds; repeated
rows stay; empty tables give empty results or the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loghaven.llm.common import materialize, table

#: Ranges into which keys are split, at most.
RANGES = 64
#: Probes that one task sweeps.
SWEEP_ROWS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_AFTER = b"\xff"


def literal_rows(spark: SparkSession, rows: list[list[Column]], names: list[str], ddl: str) -> DataFrame:
    """A small frame of literals: no Python worker makes its rows."""
    kinds = [f"`{n}`: {kind.strip().split(' ', 1)[1]}" for n, kind in zip(names, ddl.split(","), strict=True)]
    whole = f"array<struct<{', '.join(kinds)}>>"
    found = F.array(*[F.struct(*[v.alias(n) for v, n in zip(row, names, strict=True)]) for row in rows]).cast(whole)
    return spark.range(1).select(F.explode(found).alias("r")).select("r.*")


def host_of(url: Column) -> Column:
    """The host by the rule of the operator: empty where there is none."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """The path: what follows the host, up to a query or fragment."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def reversed_labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def rule_keys(rules: DataFrame) -> DataFrame:
    """Distinct rules with key, parent and rank; of equal rules a block stays."""
    host = F.translate(F.col("host"), _UPPER, _LOWER)
    named = rules.where(F.col("host").isNotNull()).select(host.alias("host"), F.coalesce(F.col("path"), F.lit("")).alias("path"), "verdict")
    one = named.groupBy("host", "path").agg(F.max(F.when(F.col("verdict") == "block", "block").otherwise("allow")).alias("verdict"))
    return one.select(
        F.encode(F.concat(F.array_join(reversed_labels(F.col("host")), "."), F.lit("/"), "path"), "UTF-8").alias("key"),
        F.struct(
            F.length(F.concat("host", "path")).alias("size"),
            F.length("host").alias("host_size"),
            F.concat("host", "path").alias("rule"),
            F.col("verdict"),
        ).alias("top"),
    )


def sweep_events(keyed: DataFrame) -> DataFrame:
    """Starts and ends of the rules' intervals with the rule that is on top after each."""
    prefixes = keyed.select(F.col("key").alias("own"), F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length("key") - 1, F.lit(1))), lambda n: F.substring("key", 1, n))).alias("key"))
    parents = prefixes.where(F.col("key") != F.col("own")).join(keyed, "key").groupBy(F.col("own").alias("key")).agg(F.max_by("top", F.octet_length("key")).alias("parent"))
    both = keyed.join(parents, "key", "left")
    return both.select(F.explode(F.array(F.struct(F.col("key").alias("key"), F.col("top").alias("top")), F.struct(F.concat("key", F.lit(bytearray(_AFTER))).alias("key"), F.col("parent").alias("top")))).alias("e")).select("e.key", "e.top")


def _bounds(keyed: DataFrame) -> list[bytes]:
    """At most RANGES - 1 keys, in order, that split the rules about evenly."""
    drawn = sorted(bytes(r[0]) for r in keyed.select("key").orderBy(F.xxhash64("key"), "key").limit(64 * RANGES).collect())
    step = max(len(drawn) / RANGES, 64.0)
    return sorted({drawn[int(step * i)] for i in range(1, RANGES) if int(step * i) < len(drawn)})


def _range_of(key: Column, bounds: list[bytes]) -> Column:
    found = F.lit(0)
    for b in bounds:
        found = found + (key >= F.lit(bytearray(b))).cast("int")
    return found


def judge_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Per row: id, host, path, the rule that holds and its verdict."""
    spark = pages.sparkSession
    keyed = materialize(rule_keys(rules), "rules")
    events = materialize(sweep_events(keyed), "events")
    bounds = _bounds(keyed)

    url = F.coalesce(F.col(url_col), F.lit(""))
    parts = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    # equal hosts and paths are judged once; this also spreads a host that holds most pages
    asked = parts.select("host", "path").where(F.col("host") != "").distinct()
    labels = reversed_labels(F.col("host"))
    suffixes = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda n: F.encode(F.concat(F.array_join(F.slice("labels", 1, n), "."), F.lit("/"), F.col("path")), "UTF-8"))
    probes = asked.withColumn("labels", labels).select("host", "path", F.explode(suffixes).alias("key")).withColumn("range", _range_of(F.col("key"), bounds))
    probes = materialize(probes, "probes")
    sizes = {r["range"]: -(-r["count"] // SWEEP_ROWS) for r in probes.groupBy("range").count().collect()}
    spread = max(1, spark.sparkContext.defaultParallelism // max(1, len(sizes)))
    tasks = literal_rows(spark, [[F.lit(k), F.lit(max(n, spread))] for k, n in sizes.items()], ["range", "tasks"], "range int, tasks long")

    # each range gets its own events and, before them, the rule that is on top at its lower bound
    own = events.withColumn("range", _range_of(F.col("key"), bounds))
    last = {r["range"]: r["top"] for r in own.groupBy("range").agg(F.max_by(F.struct("top"), "key").alias("top")).select("range", "top.top").collect()}
    ranged = own.select("range", "key", F.lit(0).alias("kind"), "top")
    kind = own.schema["top"].dataType
    top = None
    for i, bound in enumerate(bounds, 1):
        top = last.get(i - 1, top)
        on_top = F.struct(*[F.lit(v).alias(f) for f, v in top.asDict().items()]) if top else F.lit(None)
        ranged = ranged.unionByName(spark.range(1).select(F.lit(i).alias("range"), F.lit(bytearray(bound)).alias("key"), F.lit(-1).alias("kind"), on_top.cast(kind).alias("top")))
    ranged = ranged.join(F.broadcast(tasks), "range").select("range", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("task"), "key", "kind", F.struct("top").alias("event"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"))
    dealt = probes.join(F.broadcast(tasks), "range").select("range", F.pmod(F.xxhash64("key"), F.col("tasks")).alias("task"), "key", F.lit(1).alias("kind"), F.lit(None).cast(ranged.schema["event"].dataType).alias("event"), "host", "path")
    sweep = W.partitionBy("range", "task").orderBy("key", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = ranged.unionByName(dealt).withColumn("on_top", F.last("event", ignorenulls=True).over(sweep)).where((F.col("kind") == 1) & F.col("on_top.top").isNotNull())
    top = F.col("on_top.top")
    best = swept.groupBy("host", "path").agg(F.max(F.struct(top["size"], top["host_size"], top["rule"], top["verdict"])).alias("best"))
    # written first: a join of plain shuffles can be split where one URL has very many rows
    judged = parts.join(materialize(best, "best"), ["host", "path"], "left")
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


#: The rules of the registered query (fixed values).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages."""
    rules = literal_rows(spark, [[F.lit(v) for v in rule] for rule in RULES], ["host", "path", "verdict"], "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


OP5_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages),
q AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM p),
r(rhost, rpath, rverdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT q.*, rhost || rpath AS rule, rverdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST, length(rhost) DESC) AS n
  FROM q LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM m WHERE n = 1
"""
