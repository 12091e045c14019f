"""Sequence and quality expressions; all stay inside the JVM."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The two 3' adapters of a common public sequencing kit.
ADAPTERS = {"TruSeqRead1": "AGATCGGAAGAGCACACGTCTGAACTCCAGTCA", "TruSeqRead2": "AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGT"}

MOST_PATTERNS = 64


def clean(seq: Column) -> Column:
    """Upper case; every character but A, C, G, T becomes N."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGT", "TGCA")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def only_acgt(seq: Column) -> Column:
    return F.regexp_replace(seq, "[^ATGC]", "")


def printable(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x20-\x7E]", "")


def phred(qual: Column) -> Column:
    """Quality numbers of a phred+33 string; empty and null strings give an empty array and null."""
    return F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)


def mean_phred(qual: Column) -> Column:
    """Whole-number mean quality; 0 for an empty string."""
    total = F.aggregate(phred(qual), F.lit(0), lambda a, q: a + q)
    return F.when(F.length(qual) == 0, 0).otherwise(F.floor(F.try_divide(total, F.length(qual)))).cast("int")


def distinct_bases(seq: Column) -> Column:
    return F.array_distinct(F.filter(F.split(seq, ""), lambda c: c != ""))


def occurrences(seq: Column, pattern: str) -> Column:
    """All 0-based offsets, overlaps included, from right to left."""
    last = F.length(seq) - len(pattern)
    offs = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.reverse(F.filter(offs, lambda i: F.substring(seq, i + 1, F.lit(len(pattern))) == pattern))


def adapter_offset(seq: Column, adapter: str, mismatch_rate: float = 0.0) -> Column:
    """First 0-based offset where ``adapter`` lies whole with at most floor(length * rate) mismatches, else null.

    Without mismatches it is one substring search. With k mismatches allowed it is one pattern with
    k free places if these are few; else one of k + 1 equal pieces of the adapter must match
    exactly, so only offsets that such a piece gives are compared.
    """
    n, k = len(adapter), int(len(adapter) * mismatch_rate)
    if k == 0:
        at = F.instr(seq, adapter)
        return F.when(at > 0, at - 1)
    if comb(n, k) <= MOST_PATTERNS:
        loose = "|".join("".join("." if i in free else b for i, b in enumerate(adapter)) for free in combinations(range(n), k))
        at = F.regexp_instr(seq, F.lit(loose))
        return F.when(at > 0, at - 1)
    cuts = [i * n // (k + 1) for i in range(k + 2)]
    moved = lambda a: lambda o: o - a
    seeds = [F.transform(occurrences(seq, adapter[a:b]), moved(a)) for a, b in zip(cuts, cuts[1:], strict=False)]
    fits = F.filter(F.array_distinct(F.concat(*seeds)), lambda o: (o >= 0) & (o <= F.length(seq) - n))
    near = F.filter(fits, lambda o: sum((F.substring(seq, o + (i + 1), F.lit(1)) != b).cast("int") for i, b in enumerate(adapter)) <= k)
    return F.array_min(near)


def trim_3(seq: Column, adapters: dict[str, str], mismatch_rate: float = 0.0) -> Column:
    """End (exclusive) after the 3' adapters: of several that match, the last in (id, sequence) order decides."""
    end = F.length(seq)
    for _, a in sorted(adapters.items()):
        end = F.coalesce(adapter_offset(seq, a, mismatch_rate), end)
    return end


def trim_5(seq: Column, adapters: dict[str, str], mismatch_rate: float = 0.0) -> Column:
    """Begin after the 5' adapters; the last that matches decides."""
    begin = F.lit(0)
    for _, a in sorted(adapters.items()):
        begin = F.coalesce(adapter_offset(seq, a, mismatch_rate) + len(a), begin)
    return begin


def window_trim(qual: Column, quality: int, width: int) -> Column:
    """End after dropping 3' windows of ``width`` while their mean quality is below ``quality``."""
    n = F.length(qual)
    ends = F.transform(F.sequence(F.lit(0), F.floor(n / width).cast("int")), lambda k: n - k * width)
    total = lambda q, e: F.aggregate(F.slice(q, F.greatest(e - width, F.lit(0)) + 1, width), F.lit(0), lambda a, x: a + x)
    # the one-element array names the qualities, so that they are computed once
    stop = F.transform(F.array(phred(qual)), lambda q: F.get(F.filter(ends, lambda e: (e < width) | (total(q, e) >= quality * width)), F.lit(0)))
    return F.get(stop, F.lit(0))
