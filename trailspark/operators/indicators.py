"""Indicators of compromise: rollup, STIX patterns and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailspark.functions import scalars as S
from trailspark.operators import extract, network

STIX = {"domain": "domain-name:value", "ipv4": "ipv4-addr:value", "url": "url:value", "md5": "file:hashes.MD5", "sha1": "file:hashes.'SHA-1'", "sha256": "file:hashes.'SHA-256'"}
SOURCE_EVENTS, SALTS = 20, 64


def sightings(events: DataFrame) -> DataFrame:
    """(kind, value, event_number, pos, timestamp_utc, agent): every match of the text patterns, and every
    contacted target once per event."""
    body = F.concat_ws("\n", *[S.text(c) for c in ("text", "details", "target", "working_directory")])
    keep = ["event_number", "timestamp_utc", "agent"]
    texts = events.select(*keep, F.posexplode(extract.indicator_matches(body)).alias("pos", "m")).select("*", "m.*").drop("m")
    hosts = network.settle_ipv6(events.select(*keep, F.posexplode(network.observables()).alias("pos", "m")).select("*", "m.*").drop("m"))
    hosts = hosts.groupBy(*keep, "kind", "value").agg((F.min("pos") + 1_000_000).alias("pos"))
    return texts.unionByName(hosts)


def rollup(found: DataFrame) -> DataFrame:
    """One row per (type, value without case): first display value, first and last time seen, count, agents and
    the first 20 source events."""
    at = F.struct("event_number", "pos")
    stamped = F.col("timestamp_utc") != ""
    out = found.groupBy(F.col("kind").alias("type"), F.lower("value").alias("_k")).agg(
        F.min_by("value", at).alias("value"), F.min_by("timestamp_utc", at).alias("first_seen"),
        F.coalesce(F.max_by(F.when(stamped, F.col("timestamp_utc")), F.when(stamped, at)), F.lit("")).alias("last_seen"),
        F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_set(F.when(F.col("agent") != "", F.col("agent")))).alias("agents"),
        F.slice(F.array_sort(F.collect_list("_n")), 1, SOURCE_EVENTS).alias("source_events"))
    return out.orderBy("type", "_k").drop("_k")


def extract_iocs(events: DataFrame) -> DataFrame:
    """The rollup over enriched, numbered events. Each of ``SALTS`` shares of an indicator's sightings keeps its first 20 event
    numbers, so a frequent indicator neither sorts in one task nor gathers its list."""
    found = sightings(events)
    w = Window.partitionBy("kind", F.lower("value"), F.pmod("event_number", F.lit(SALTS))).orderBy("event_number", "pos")
    return rollup(found.withColumn("_n", F.when(F.row_number().over(w) <= SOURCE_EVENTS, F.col("event_number"))))


def stix_pattern(kind: Column, value: Column) -> Column:
    """The pattern of the six kinds that have one, else null."""
    safe = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    head = F.try_element_at(F.create_map(*[F.lit(x) for kv in STIX.items() for x in kv]), kind)
    return F.concat(F.lit("["), head, F.lit(" = '"), safe, F.lit("']"))


def stix_objects(iocs: DataFrame, now: str) -> DataFrame:
    """Indicator objects, one per row that has a pattern; ids depend on type and value only."""
    df = iocs.withColumn("pattern", stix_pattern(F.col("type"), F.col("value"))).where("pattern is not null")
    lit = F.lit
    return df.select(
        lit("indicator").alias("type"), lit("2.1").alias("spec_version"), F.concat(lit("indicator--"), S.uuid5(F.concat("type", lit(":"), "value"))).alias("id"),
        lit(now).alias("created"), lit(now).alias("modified"), F.concat(lit("Agent artifact: "), "type").alias("name"),
        F.concat(lit("Extracted from local AI-agent forensic artifacts; observed "), F.col("count").cast("string"), lit(" time(s).")).alias("description"),
        F.array(lit("malicious-activity")).alias("indicator_types"), "pattern", lit("stix").alias("pattern_type"), lit(now).alias("valid_from"),
        F.array(lit("ai-agent"), lit("unvalidated")).alias("labels"))
