"""Pairing of signal logs with the position logs of the same drive, on the catalog alone.

The catalog has dataset_id, name, original_filename, tags, created_at, coord_kind and extra_signals. Position
logs are filed under their keys, and only the first two of each key are kept (two, so that a log is not paired
with itself); a key shared by a large part of the catalog therefore never multiplies into pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import base_name, normal_tags, recording_start, tag_base
from ..limits import START_TOLERANCE_SECONDS
from ..session import materialize
from .sampling import top_rows

NAME, TIMESTAMP, TAG, SELF = 0, 1, 2, 3


def list_gps(catalog: DataFrame) -> DataFrame:
    return catalog.filter(F.col("coord_kind") != "none")


def pairing_keys(catalog: DataFrame) -> DataFrame:
    """Catalog rows with base name, start second, signal tags, position-tag bases and the listing order."""
    name = F.coalesce("original_filename", "name")
    bases = F.array_distinct(F.filter(F.transform(normal_tags(F.col("tags")), tag_base), lambda t: t != ""))
    newest_first = -F.unix_micros(F.col("created_at").cast("timestamp"))
    return catalog.select(
        "dataset_id", base_name(name).alias("base"),
        F.unix_seconds(recording_start(name).cast("timestamp")).alias("start"),
        normal_tags(F.col("tags")).alias("sig_tags"), bases.alias("gps_tags"),
        F.struct(newest_first.alias("newest"), F.col("dataset_id").alias("id")).alias("place"),
        (F.col("coord_kind") != "none").alias("is_gps"), F.col("extra_signals"))


def gps_pairs(catalog: DataFrame) -> DataFrame:
    """(signal_id, gps_id, match) with match name, timestamp, tag or self, tried in this order.

    Within name and timestamp, a tag link (X beside X_GPS) comes first, then the smaller time difference, then
    the newest log. A tag alone pairs only when it leads to exactly one position log.
    """
    keyed = materialize(pairing_keys(catalog))  # the names are parsed once
    signals = keyed.filter(~F.col("is_gps") | F.col("extra_signals"))
    gps = keyed.filter("is_gps")

    # slot '' is every position log of a key, slot 't:x' those with tag base x
    slots = F.concat(F.array(F.lit("")), F.transform("gps_tags", lambda t: F.concat(F.lit("t:"), t)))
    filing = F.array(F.struct(F.lit(NAME).alias("kind"), F.col("base").alias("k")),
                     F.struct(F.lit(TIMESTAMP).alias("kind"), F.col("start").cast("string").alias("k")))
    filed = gps.select("place", F.explode(slots).alias("slot"), filing.alias("f")).select(
        "place", "slot", F.explode("f").alias("f")).select("place", "slot", "f.kind", "f.k").filter(F.col("k").isNotNull())
    shelf = top_rows(filed, ["kind", "k", "slot"], [F.col("place")], 2).select("kind", "k", "slot", "place")

    wanted_slots = F.concat(F.array(F.lit("")), F.transform("sig_tags", lambda t: F.concat(F.lit("t:"), t)))
    offsets = F.sequence(F.lit(-START_TOLERANCE_SECONDS), F.lit(START_TOLERANCE_SECONDS))
    seconds = F.when(F.col("start").isNotNull(), F.transform(offsets, lambda o: F.struct(
        F.lit(TIMESTAMP).alias("kind"), (F.col("start") + o).cast("string").alias("k"), F.abs(o).alias("gap"))))
    by_name = F.array(F.struct(F.lit(NAME).alias("kind"), F.col("base").alias("k"), F.lit(0).alias("gap")))
    entry = "array<struct<kind:int,k:string,gap:int>>"
    asked = F.concat(by_name.cast(entry), F.coalesce(seconds.cast(entry), F.array().cast(entry)))
    probes = signals.select("dataset_id", F.explode(wanted_slots).alias("slot"), asked.alias("a")).select(
        "dataset_id", "slot", F.explode("a").alias("a")).select("dataset_id", "slot", "a.kind", "a.k", "a.gap")
    near = probes.join(shelf, ["kind", "k", "slot"]).filter(F.col("place.id") != F.col("dataset_id")).select(
        "dataset_id", "kind", F.when(F.col("slot") == "", 1).otherwise(0).alias("tag_rank"), "gap", "place")

    tagged = gps.select("place", F.explode("gps_tags").alias("tag"))
    sizes = tagged.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    tag_shelf = top_rows(tagged, ["tag"], [F.col("place")], 2).select("tag", "place").join(sizes, "tag")
    linked = signals.select("dataset_id", F.explode("sig_tags").alias("tag")).join(tag_shelf, "tag")
    others = linked.groupBy("dataset_id").agg(  # at most two entries per tag of the signal
        F.max("n").alias("n"), F.collect_set(F.when(F.col("place.id") != F.col("dataset_id"), F.col("place"))).alias("p"))
    unique = others.filter((F.col("n") <= 2) & (F.size("p") == 1)).select(
        "dataset_id", F.lit(TAG).alias("kind"), F.lit(0).alias("tag_rank"), F.lit(0).alias("gap"),
        F.get("p", F.lit(0)).alias("place"))

    own = signals.filter(F.col("is_gps") & F.col("extra_signals")).select(
        "dataset_id", F.lit(SELF).alias("kind"), F.lit(0).alias("tag_rank"), F.lit(0).alias("gap"), "place")
    best = near.unionByName(unique).unionByName(own).groupBy("dataset_id").agg(
        F.min(F.struct("kind", "tag_rank", "gap", "place")).alias("b"))
    words = F.array(*[F.lit(w) for w in ("name", "timestamp", "tag", "self")])
    return best.select(F.col("dataset_id").alias("signal_id"), F.col("b.place.id").alias("gps_id"),
                       F.get(words, F.col("b.kind")).alias("match"))
