"""Sample discovery: <root>/<group>/<condition>/<files>, files chunked into samples by role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Roles of a sample's files, in file order.
ROLES = {
    ("preproc", "SE"): ["forward"],
    ("preproc", "PE"): ["forward", "reverse"],
    ("align", "SE"): ["forward"],
    ("align", "PE"): ["forward", "R1only", "R1unmerged", "R2only", "R2unmerged"],
    ("detect", "SE"): ["matched"],
    ("detect", "PE"): ["matched"],
    ("clustering", "SE"): ["multsplits", "single", "splits"],
    ("analysis", "SE"): ["multsplits", "single", "splits"],
}


def discover(spark: SparkSession, root: str, stage: str = "preproc", readtype: str = "SE") -> DataFrame:
    """(grp, condition, sample_no, role, path) of the groups ctrls and trtms under ``root``.

    Files sort by their lower-cased path within a condition; .DS_Store, and for detect .bed and
    .txt, are left out; a last sample that lacks files is dropped; empty files are no files. Only names are read.
    """
    roles = ROLES.get((stage, readtype)) or ROLES[(stage, "SE")]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    p = F.split("path", "/")
    files = files.select("path", F.element_at(p, -3).alias("grp"), F.element_at(p, -2).alias("condition"))
    files = files.where(F.col("grp").isin("ctrls", "trtms") & ~F.col("path").rlike(r"\.DS_Store$"))
    if stage == "detect":
        files = files.where(~F.col("path").rlike(r"\.(bed|txt)$"))
    at = F.row_number().over(Window.partitionBy("grp", "condition").orderBy(F.lower("path"))) - 1
    k = len(roles)
    out = files.withColumn("i", at).withColumn("sample_no", F.floor(F.col("i") / k).cast("int")).withColumn("role", F.element_at(F.array(*map(F.lit, roles)), (F.col("i") % k + 1).cast("int")))
    whole = F.count(F.lit(1)).over(Window.partitionBy("grp", "condition", "sample_no")) == k
    return out.withColumn("whole", whole).where("whole").select("grp", "condition", "sample_no", "role", "path")


#: The files a sample's stage writes: (role, role of the input it is named after, suffix, words the suffix replaces, extension).
OUTPUTS = {
    ("preproc", "SE"): [("forward", "forward", "_preproc", ["_R1", "fwd"], None)],
    ("preproc", "PE"): [
        ("forward", "forward", "_preproc", ["_R1", "fwd"], None),
        ("R1only", "forward", "_R1only", ["_R1", "fwd"], None),
        ("R2only", "reverse", "_R2only", ["_R2", "rev"], None),
        ("R1unmerged", "forward", "_R1unmerged", ["_R1", "fwd"], None),
        ("R2unmerged", "reverse", "_R2unmerged", ["_R2", "rev"], None),
    ],
    ("align", "SE"): [("matched", "forward", "_matched", [], ".bam")],
    ("align", "PE"): [
        ("matched", "forward", "_matched", [], ".bam"),
        ("matched_R1only", "R1only", "_matched", [], ".bam"),
        ("matched_R2only", "R2only", "_matched", [], ".bam"),
        ("matched_unmerged", "forward", "_unmerged_matched", ["_preproc"], ".bam"),
    ],
    ("detect", "SE"): [("single", "matched", "_single", ["_matched"], None), ("splits", "matched", "_splits", ["_matched"], None), ("multsplits", "matched", "_multsplits", ["_matched"], None)],
    ("analysis", "SE"): [("interactions", "splits", "_interactions", ["_splits"], ".txt")],
}


def with_suffix(name: Column, suffix: str, words: list[str]) -> Column:
    """A file name whose part from the last of ``words`` that it holds, else from its first dot, to the first dot gives way to ``suffix``."""
    dot = F.when(F.instr(name, ".") > 0, F.instr(name, ".")).otherwise(F.length(name) + 1)
    at = F.coalesce(*(F.nullif(F.instr(name, w), F.lit(0)) for w in reversed(words)), dot)
    return F.concat(F.substr(name, F.lit(1), at - 1), F.lit(suffix), F.substr(name, dot))


def outputs(found: DataFrame, out_root: str, stage: str = "preproc", readtype: str = "SE") -> DataFrame:
    """(grp, condition, sample_no, input, output) of ``discover``: structs of paths by role; outputs lie under ``out_root``/stage/grp/condition.

    Words and dots are looked for in file names only, not in folders. A missing role is null.
    """
    own = lambda table: table.get((stage, readtype)) or table.get((stage, "SE"), [])
    of = lambda role: F.max(F.when(F.col("role") == role, F.col("path")))
    roles = own(ROLES)
    rows = found.groupBy("grp", "condition", "sample_no").agg(F.struct(*(of(r).alias(r) for r in roles)).alias("input"))

    def path(role: str, after: str, suffix: str, words: list[str], ext: str | None) -> Column:
        name = F.element_at(F.split(F.col(f"input.{after}"), "/"), -1)
        name = F.regexp_replace(name, r"\.[^.]*$", ext) if ext else name
        return F.concat_ws("/", F.lit(out_root.rstrip("/")), F.lit(stage), "grp", "condition", with_suffix(name, suffix, words)).alias(role)

    made = [path(*x) for x in own(OUTPUTS) if x[1] in roles]
    return rows.withColumn("output", F.struct(*made)) if made else rows.withColumn("output", F.struct(F.lit(None).cast("string").alias("none")))


def manifest(rows: DataFrame, stage: str = "preproc") -> DataFrame:
    """``outputs`` as one JSON text ``doc``: stage, group, conditions in order, samples in order, input and output; one entry a sample."""
    sample = F.struct("sample_no", "input", "output")
    conditions = rows.groupBy("grp", "condition").agg(F.transform(F.sort_array(F.collect_list(sample)), lambda s: F.struct(s["input"].alias("input"), s["output"].alias("output"))).alias("samples"))
    of = lambda g: F.sort_array(F.collect_list(F.when(F.col("grp") == g, F.struct("condition", "samples")))).alias(g)
    return conditions.agg(of("ctrls"), of("trtms")).select(F.to_json(F.struct(F.struct("ctrls", "trtms").alias(stage))).alias("doc"))
