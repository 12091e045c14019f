"""Reads: trimming, quality filter, and merging of mates."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ligaquery.functions import seq as S
from ligaquery.params import Params


@dataclass(frozen=True)
class TrimParams:
    quality: int = 20
    min_length: int = 15
    adapters_3: dict[str, str] = field(default_factory=lambda: dict(S.ADAPTERS))
    adapters_5: dict[str, str] = field(default_factory=dict)
    mismatch_rate: float = 0.1
    window: int = 0  # 0: no window trimming
    min_overlap: int = 5
    mode: int = 2  # 0: 5' only, 1: 3' only, 2: both ends

    @classmethod
    def of(cls, p: Params, adapters_3: dict[str, str] | None = None, adapters_5: dict[str, str] | None = None) -> TrimParams:
        """The trimming that the workflow's parameters ask for."""
        ends = {"adapters_3": dict(S.ADAPTERS) if adapters_3 is None else adapters_3, "adapters_5": adapters_5 or {}}
        return cls(p.quality, p.minlen, **ends, mismatch_rate=p.mmrate, window=p.wsize if p.wtrim else 0, min_overlap=p.minovlps, mode=p.modetrm)


def trimmed(reads: DataFrame, p: TrimParams) -> DataFrame:
    """``reads`` (seq, qual) with adapters and bad 3' windows cut off; crossing bounds give an empty read."""
    begin = S.trim_5(F.col("seq"), p.adapters_5 if p.mode in (0, 2) else {}, p.mismatch_rate)
    end = S.trim_3(F.col("seq"), p.adapters_3 if p.mode in (1, 2) else {}, p.mismatch_rate)

    def cut(df: DataFrame, lo: Column, hi: Column) -> DataFrame:
        """The bounds are generated, so that they are computed once and not wherever they are used."""
        df = df.select("*", F.inline(F.array(F.struct(lo.alias("__lo"), hi.alias("__hi")))))
        part = lambda c: F.substring(c, F.col("__lo") + 1, F.greatest(F.col("__hi") - F.col("__lo"), F.lit(0)))
        return df.select(*(part(c).alias(c) if c in ("seq", "qual") else c for c in df.columns if not c.startswith("__")))

    out = cut(reads, begin, end)
    return cut(out, F.lit(0), S.window_trim(F.col("qual"), p.quality, p.window)) if p.window else out


def passes(p: TrimParams) -> Column:
    return (F.length("seq") >= p.min_length) & (S.mean_phred(F.col("qual")) >= p.quality)


def common_runs(a: list[str], b: list[str]) -> np.ndarray:
    """(begin in a, begin in b, length) of the longest common substring of each pair; the first longest wins.

    The rows of all pairs' tables are computed together. Pairs with an empty side give zeros.
    """
    out = np.zeros((len(a), 3), np.int32)
    if not len(a):
        return out
    wide = lambda seqs, fill: np.array([list(s.encode("utf-8", "replace").ljust(max(1, max(len(t.encode("utf-8", "replace")) for t in seqs)), fill)) for s in seqs], np.uint8)
    x, y = wide(a, b"\0"), wide(b, b"\1")
    row = np.zeros((len(a), y.shape[1] + 1), np.int32)
    for i in range(x.shape[1]):
        row[:, 1:] = np.where(y == x[:, i : i + 1], row[:, :-1] + 1, 0)
        j = row.argmax(axis=1)
        n = row[np.arange(len(a)), j]
        more = n > out[:, 2]
        out[more] = np.stack([i + 1 - n, j - n, n], axis=1)[more]
    return out


def overlap_of(a: Column, b: Column) -> Column:
    """Struct (at_a, at_b, n) of the longest common substring of two columns of sequences."""

    @F.pandas_udf("at_a INT, at_b INT, n INT")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        p, q, out = x.fillna("").tolist(), y.fillna("").tolist(), np.zeros((len(x), 3), np.int32)
        order = np.argsort([len(s) * len(t) for s, t in zip(p, q, strict=True)], kind="stable")
        for lo in range(0, len(order), 512):  # alike lengths together, so little is padded
            part = order[lo : lo + 512]
            out[part] = common_runs([p[i] for i in part], [q[i] for i in part])
        return pd.DataFrame(out, columns=["at_a", "at_b", "n"])

    return run(a, b)


def merged(mates: DataFrame, p: TrimParams) -> DataFrame:
    """Mates (read_id, seq_1, qual_1, seq_2, qual_2) with ``route`` and the merged ``seq``, ``qual``.

    Routes: merged (the mates overlap in at least min_overlap bases), R1only and R2only (only one
    mate passes the filter), unmerged (both pass, no overlap), dropped. An unmatched mate has nulls.
    """
    ok = lambda i: F.coalesce((F.length(f"seq_{i}") >= p.min_length) & (S.mean_phred(F.col(f"qual_{i}")) >= p.quality), F.lit(False))
    df = mates.withColumns({"ok1": ok(1), "ok2": ok(2), "rc": S.reverse_complement(F.col("seq_2")), "rq": F.reverse("qual_2")})
    df = df.withColumn("ov", F.when(F.col("ok1") & F.col("ok2"), overlap_of(F.col("seq_1"), F.col("rc"))))
    joins = F.coalesce(F.col("ov.n") >= max(1, p.min_overlap), F.lit(False))
    glue = lambda a, b: F.concat(F.substring(a, F.lit(1), F.col("ov.at_a") + F.col("ov.n")), F.substring(b, F.col("ov.at_b") + F.col("ov.n") + 1, F.length(b)))
    route = F.when(joins, "merged").when(F.col("ok1") & F.col("ok2"), "unmerged").when(F.col("ok1"), "R1only").when(F.col("ok2"), "R2only").otherwise("dropped")
    return df.withColumns({"route": route, "seq": F.when(joins, glue("seq_1", "rc")), "qual": F.when(joins, glue("qual_1", "rq"))}).drop("ok1", "ok2", "rc", "rq", "ov")
