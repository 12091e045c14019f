"""CIGAR strings as arrays and their segments at skipped regions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ops(cigar: Column) -> Column:
    """array<struct<n, op>>; empty for ``*``, empty and malformed strings, null for null."""
    found = F.regexp_extract_all(cigar, F.lit(r"([0-9]+)([MIDNSHPX=])"), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.substring(x, F.lit(1), F.length(x) - 1).cast("int").alias("n"), F.right(x, F.lit(1)).alias("op")))


def span(cigar: Column, kinds: str) -> Column:
    """Total length of the operations in ``kinds``."""
    keep = F.array(*map(F.lit, kinds))
    return F.aggregate(F.filter(ops(cigar), lambda o: F.array_contains(keep, o["op"])), F.lit(0), lambda a, o: a + o["n"])


def read_span(cigar: Column) -> Column:
    return span(cigar, "MIS=X")


def ref_span(cigar: Column) -> Column:
    return span(cigar, "MDN=X")


def segments(cigar: Column, pos: Column, min_length: int = 0, exclude_clips: bool = False) -> Column:
    """Segments between N operations: array<struct<seg_no, strt, stop, read_from, read_to>>.

    strt..stop is the closed reference span (0-based), read_from..read_to the closed read span
    (1-based). With ``exclude_clips`` soft clips belong to no segment. Segments with fewer read
    bases than ``min_length`` are left out; numbers count all.
    """
    zero = F.struct(
        F.array().cast("array<struct<seg_no:int,strt:bigint,stop:bigint,read_from:int,read_to:int>>").alias("out"),
        pos.cast("bigint").alias("ref"), pos.cast("bigint").alias("begin"), F.lit(0).alias("read"), F.lit(1).alias("first"), F.lit(0).alias("last"), F.lit(0).alias("no"),
    )
    piece = lambda a: F.array(F.struct(a["no"].alias("seg_no"), a["begin"].alias("strt"), (a["ref"] - 1).alias("stop"), a["first"].alias("read_from"), a["last"].alias("read_to")))

    def step(a: Column, o: Column) -> Column:
        on_ref, on_read = o["op"].isin("M", "D", "=", "X"), o["op"].isin("M", "I", "S", "=", "X")
        skip, clip = o["op"] == "N", (o["op"] == "S") if exclude_clips else F.lit(False)
        read = a["read"] + F.when(on_read, o["n"]).otherwise(0)
        ref = a["ref"] + F.when(on_ref | skip, o["n"]).otherwise(0)
        lead = clip & (a["last"] < a["first"])
        return F.struct(
            F.when(skip, F.concat(a["out"], piece(a))).otherwise(a["out"]).alias("out"),
            ref.alias("ref"),
            F.when(skip, ref).otherwise(a["begin"]).alias("begin"),
            read.alias("read"),
            F.when(skip | lead, read + 1).otherwise(a["first"]).alias("first"),
            F.when(skip | clip, F.when(lead | skip, read).otherwise(a["last"])).otherwise(read).alias("last"),
            F.when(skip, a["no"] + 1).otherwise(a["no"]).alias("no"),
        )

    done = F.aggregate(ops(cigar), zero, step, lambda a: F.concat(a["out"], piece(a)))
    return F.filter(done, lambda s: (s["read_to"] - s["read_from"] + 1 >= F.lit(max(min_length, 1))) & s["strt"].isNotNull())
