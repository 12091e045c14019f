"""Rows that fail to parse: every column as nullable text, rules into an error array, split by emptiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ligaquery.session import small

COLUMNS = "seqid source feat_type feat_strt feat_end score strand phase attributes".split()
INT_MAX = 2147483647


def plain_int(text: Column) -> Column:
    """The number 1 .. 2147483647 written in plain digits 0-9, else null."""
    number = F.try_to_number(F.regexp_extract(text, r"^0*([0-9]{1,10})$", 1), F.lit("9999999999")).cast("bigint")
    return F.when(text.rlike(r"^0*[0-9]{1,10}$") & number.between(1, INT_MAX), number)


def gff_records(lines: DataFrame, line: str = "line") -> DataFrame:
    """``lines`` with the nine fields as text columns ``f_*`` and ``n_fields``; blank and ``#`` lines are left out.

    A null line is no record. One final carriage return belongs to the line end.
    """
    text = F.regexp_replace(F.col(line), r"\r$", "")
    fields = F.split(text, "\t", -1)
    kept = lines.where((F.trim(F.regexp_replace(F.col(line), r"\s", "")) != "") & ~F.startswith(F.col(line), F.lit("#")))
    return kept.withColumn("n_fields", F.size(fields)).withColumns({f"f_{c}": F.get(fields, F.lit(i)) for i, c in enumerate(COLUMNS)})


def check_gff(lines: DataFrame, contigs: DataFrame, line: str = "line") -> DataFrame:
    """``gff_records`` with the array ``errors`` of reasons, in order: columns, quoting, seqid, start, strand.

    Of a line without nine columns only ``columns`` is reported, since its fields have no names.
    ``contigs.refname`` is broadcast if its counted rows are few, else joined by a shuffle.
    """
    names = small(contigs.select(F.col("refname").alias("__known")).where("__known IS NOT NULL").distinct())
    rec = gff_records(lines, line).join(names, F.col("f_seqid") == F.col("__known"), "left")
    start, end = plain_int(F.col("f_feat_strt")), plain_int(F.col("f_feat_end"))
    quotes = F.length("f_attributes") - F.length(F.replace(F.col("f_attributes"), F.lit('"'), F.lit("")))
    rules = [
        ("quoting", quotes % 2 == 1),
        ("seqid", F.col("__known").isNull()),
        ("start", start.isNull() | (end.isNotNull() & (start > end))),
        ("strand", ~F.col("f_strand").isin("+", "-", ".", "?")),
    ]
    reasons = F.filter(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules)), lambda x: x.isNotNull())
    errors = F.when(F.col("n_fields") != len(COLUMNS), F.array(F.lit("columns"))).otherwise(reasons)
    return rec.withColumn("errors", errors).withColumns({"start": start, "stop": end}).drop("__known")


def rejected(checked: DataFrame, row_id: str) -> DataFrame:
    """(row_id, reason): rows with an error, under the first reason that holds."""
    return checked.where(F.size("errors") > 0).select(row_id, F.get("errors", F.lit(0)).alias("reason"))


def accepted(checked: DataFrame, row_id: str) -> DataFrame:
    """Rows without errors as typed features; an end, score or phase that does not parse is null."""
    c = F.col
    return checked.where(F.size("errors") == 0).select(
        row_id,
        c("f_seqid").alias("seqid"),
        c("f_source").alias("source"),
        c("f_feat_type").alias("feat_type"),
        c("start").cast("int").alias("feat_strt"),
        c("stop").cast("int").alias("feat_end"),
        c("f_score").try_cast("double").alias("score"),
        c("f_strand").alias("strand"),
        c("f_phase").try_cast("int").alias("phase"),
        c("f_attributes").alias("attributes"),
    )
