"""URL rules as a sort-merge range join over reversed-host keys, in DataFrame operations only.

A rule (host, path) fits its host and all subdomains where the url's path starts with the rule's. Its
key is the reversed host and the path, `com.example.` + `/en/`; the urls a rule fits are, for one host
suffix of theirs, the keys in an interval: those that start with the rule's key. Such intervals nest or
are apart. A url gets one key for each suffix of its host.

Rules and keys are sorted together and swept once. The sweep keeps the stack of rules that are open: at each
rule those that do not hold its key are closed and it is pushed, at each key those that do not hold it are
closed and the innermost one left fits.

The sweep is cut into ranges that start at every RANGE_RULES-th rule; the rules open at these boundaries are
looked up for the boundaries alone. A range with many keys is dealt over several cells of CELL_KEYS keys or
so, each of which has all rules of the range; both numbers only deal out work. No task holds more than a cell.

Defined cases: a null url, or one without `://`, has an empty host and path and no rule fits it; no rule
fits: the verdict is `default`; of fitting rules the longest (host and path) wins, then the longest
host; a rule given twice with both verdicts blocks; rows that repeat stay; urls of any length are judged
whole; no pages or no rules are no error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import stored

#: Rules of a range, and keys of a cell.
RANGE_RULES = 5_000
CELL_KEYS = 2_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    """`www.example.com` to `com.example.www.`, so that a domain's key starts the keys of its subdomains."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _suffix_keys(host: Column, path: Column) -> Column:
    """The keys of each suffix of the host: reversed labels, then the path."""
    labels = F.reverse(F.split(host, r"\."))
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.array_join(F.slice(labels, 1, i), "."), F.lit("."), path))


_RULE = "struct<key:string,host:string,path:string,verdict:string>"


def keyed_rules(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) to key and rule, one for each key."""
    keyed = rules.select(F.concat(reversed_host(F.col("host")), F.col("path")).alias("key"), "host", "path", "verdict")
    return keyed.groupBy("key").agg(F.max_by(F.struct("key", "host", "path", "verdict"), "verdict").cast(_RULE).alias("rule"))


def _holds(r: Column, key: Column) -> Column:
    return key.startswith(r["key"])


def sweep(events: Column, open_: Column) -> Column:
    """Sorted events (key, rule; a null rule asks for the key) to the answers (key, rule) of the asked keys that a rule holds; open_: the rules open before the first."""
    state = lambda stack, out: F.struct(stack.alias("stack"), out.alias("out"))

    def step(a: Column, e: Column) -> Column:
        still = F.filter(a["stack"], lambda r: _holds(r, e["key"]))
        asked, inner = e["rule"].isNull(), F.try_element_at(still, F.lit(-1))
        answer = F.array_append(a["out"], F.struct(e["key"].alias("key"), inner.alias("rule")))
        return state(F.when(asked, still).otherwise(F.array_append(still, e["rule"])), F.when(asked & (F.size(still) > 0), answer).otherwise(a["out"]))

    start = state(open_, F.array().cast(f"array<struct<key:string,rule:{_RULE}>>"))
    return F.aggregate(events, start, step, lambda a: a["out"])


def _at_or_before(bounds: list[str], key: Column) -> Column:
    if not bounds:
        return F.lit(0)
    known = F.array(*map(F.lit, bounds))

    def halve(a: Column, _: Column) -> Column:
        middle = F.floor((a["low"] + a["high"]) / 2).cast("int")
        right = F.get(known, middle) <= key
        open_ = a["low"] < a["high"]
        return F.struct(F.when(open_ & right, middle + 1).otherwise(a["low"]).alias("low"), F.when(open_ & ~right, middle).otherwise(a["high"]).alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(bounds).bit_length())), start, halve, lambda a: a["low"])


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url") -> DataFrame:
    """pages with host, path, rule (host + path of the rule, or null) and verdict; clashing columns of pages are replaced."""
    spark = pages.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = stored(keyed_rules(rules))
    # a range starts at every RANGE_RULES-th rule of a sorted partition, the partition's first included
    ordered = known.repartitionByRange(parts, "key").sortWithinPartitions("key").withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    bounds = sorted(r["key"] for r in ordered.where((F.col("place") % RANGE_RULES) == 0).select("key").collect())  # partitions + rules / RANGE_RULES
    name = "u"
    while name in pages.columns:
        name += "_"
    urls = pages.select(F.col(url_col).alias("u")).where("u is not null").groupBy("u").agg(F.count("*").alias("copies"))
    split = stored(urls.select("u", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path")).where("host <> ''"))
    keys = split.select(F.explode(_suffix_keys(F.col("host"), F.col("path"))).alias("key")).distinct()

    def ranged(df: DataFrame) -> DataFrame:
        """range: how many boundaries are at or before the key, by binary search."""
        return df.withColumn("range", _at_or_before(bounds, F.col("key")))

    placed = ranged(keys).where("range > 0")  # before the first rule no rule is open
    loads = F.broadcast(placed.groupBy("range").agg(F.ceil(F.count("*") / F.lit(CELL_KEYS)).cast("int").alias("cells")))  # as many rows as boundaries
    asked = placed.join(loads, "range").select("range", F.pmod(F.xxhash64("key"), F.col("cells")).cast("int").alias("cell"), "key", F.lit(None).cast(_RULE).alias("rule"))
    held = ranged(known).join(loads, "range").select("range", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), "key", "rule")
    # the rules open at a boundary are its key's prefixes that are keys; boundaries are few
    first = ranged(known.join(F.broadcast(spark.createDataFrame([(x,) for x in bounds], "key string")), "key").select("key"))
    prefixes = first.select("range", "key", F.explode(F.sequence(F.lit(1), F.length("key") - 1)).alias("n")).select("range", F.expr("left(key, n)").alias("key"))
    at_start = F.broadcast(known.join(prefixes, "key").groupBy("range").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.length("key").alias("size"), "rule"))), lambda x: x["rule"]).alias("open")))
    events = asked.unionAll(held).groupBy("range", "cell").agg(F.array_sort(F.collect_list(F.struct("key", F.col("rule").isNull().alias("asks"), "rule"))).alias("events"))
    swept = events.join(at_start, "range", "left").select(F.explode(sweep(F.col("events"), F.coalesce("open", F.array().cast(f"array<{_RULE}>")))).alias("a"))
    found = swept.select("a.key", "a.rule")
    each = split.select("u", F.explode(_suffix_keys(F.col("host"), F.col("path"))).alias("key"))
    best = each.join(found, "key").groupBy("u").agg(F.max_by("rule", F.struct(F.length("rule.host") + F.length("rule.path"), F.length("rule.host"))).alias("rule"))
    # stored, so that the join below is of two plain exchanges and a frequent url can be split over tasks
    named = stored(best.select(F.col("u").alias(name), F.concat("rule.host", "rule.path").alias("rule"), F.col("rule.verdict").alias("verdict")))
    clean = pages.select([c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")])
    joined = clean.where(F.col(url_col).isNotNull()).join(named, F.col(url_col) == F.col(name), "left").drop(name)
    blank = clean.where(F.col(url_col).isNull()).select("*", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    return joined.unionAll(blank).withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col)), "verdict": F.coalesce("verdict", F.lit(default))})
