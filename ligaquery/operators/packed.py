"""Several values packed in one field: delimiter skeletons and positional extraction.

A text is cut into tokens: each delimiter is one token, each run of other characters is one. In the
skeleton ordinary runs are masked (``*``), blank runs are ``_``, and only the delimiters and the
wanted keys are left, so texts that differ in other words only share a skeleton. The splitting rules
are resolved once per distinct skeleton, down to the key, the position and the tokens of each wanted
value, and applied to the tokens by position; nothing else is extracted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ligaquery.session import cut, lookup

#: Characters that can end a value, bind a key to it, or quote it.
DELIMITERS = '";=,|/'
TOKEN = rf"[{DELIMITERS}]|[^{DELIMITERS}]+"
BLANKS = " \t\n\v\f\r"
RULES = "skeleton STRING, rules ARRAY<STRUCT<k: STRING, pos: INT, lo: INT, n: INT, q: BOOLEAN>>"
_RULE = pa.list_(pa.struct([("k", pa.string()), ("pos", pa.int32()), ("lo", pa.int32()), ("n", pa.int32()), ("q", pa.bool_())]))


def resolve(skeleton: str, keys: list[str]) -> list[tuple[str, int, int, int, bool]]:
    """(key, position, first token, number of tokens, quoted) of each value of ``keys``; tokens and positions count from 1.

    ``;  ,  |  /`` outside double quotes end a piece. A piece is ``key = value`` or, at the start
    or after ``;``, ``key "value"``; any other piece belongs to the key before it. A quote that is
    left open runs to the end of the text. A value of blanks only does not count.
    """
    tokens = re.findall(TOKEN, skeleton)
    kind = "".join(t if t in DELIMITERS else "_" if t == "_" else "a" for t in tokens)
    pieces, begin, quoted, after = [], 0, False, ";"
    for i, ch in enumerate(kind):
        if ch == '"':
            quoted = not quoted
        elif not quoted and ch in ";,|/":
            pieces.append((after, begin, i))
            begin, after = i + 1, ch
    pieces.append((after, begin, len(kind)))
    found, key, seen = [], None, dict.fromkeys(keys, 0)
    for after, lo, hi in pieces:
        while lo < hi and kind[lo] == "_":
            lo += 1
        if kind[lo : lo + 2] == "a=" and hi - lo >= 2:
            key, lo = tokens[lo].strip("_"), lo + 2
        elif kind[lo : lo + 2] == 'a"' and after == ";":
            key, lo = tokens[lo].strip("_"), lo + 1
        while lo < hi and kind[lo] == "_":
            lo += 1
        while hi > lo and kind[hi - 1] == "_":
            hi -= 1
        if key not in seen:
            continue
        whole = hi - lo >= 2 and kind[lo] == kind[hi - 1] == '"' and not kind[lo + 1 : hi - 1].replace('""', "").count('"')
        if whole:
            lo, hi = lo + 1, hi - 1
        if kind[lo:hi].strip("_"):
            seen[key] += 1
            found.append((key, seen[key], lo + 1, hi - lo, whole))
    return found


def _resolve_batches(keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rules = [[dict(zip("k pos lo n q".split(), r, strict=True)) for r in resolve(s, keys)] for s in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rules, _RULE)], ["skeleton", "rules"])

    return run


def skeleton(text: Column, keys: list[str]) -> Column:
    """``text`` with a ``*`` for each ordinary run of characters, ``_`` for blanks, and ``keys`` in lower case."""
    if not all(re.fullmatch("[a-z]|[a-z][a-z0-9_]*[a-z0-9]", k) for k in keys):
        raise ValueError("keys are written in lower-case letters, digits and inner underscores")
    other = f"[^{DELIMITERS}]"
    a_key = rf"(?!(?i:\s*(?:{'|'.join(keys)})\s*(?!{other})))" if keys else ""
    run = rf"(?<!{other}){a_key}{other}*[^{DELIMITERS}\s]{other}*"
    return F.lower(F.regexp_replace(F.regexp_replace(text, run, "*"), r"\s+", "_"))


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def percent_decoded(text: Column) -> Column:
    """``%41`` becomes ``A`` (UTF-8); a percent sign without two hex digits stays."""
    safe = F.regexp_replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.when(text.contains("%"), F.url_decode(safe)).otherwise(text)


def _value(tokens: Column, r: Column) -> Column:
    raw = F.when(r["n"] == 1, F.get(tokens, r["lo"] - 1)).otherwise(F.array_join(F.slice(tokens, r["lo"], r["n"]), ""))
    return percent_decoded(F.when(r["q"], F.replace(raw, F.lit('""'), F.lit('"'))).otherwise(trimmed(raw)))


def _ruled(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """``df`` with ``__packed_rules`` (null where there are none) and ``__packed_tokens``."""
    tag = "__packed_skeleton"
    marked = df.withColumn(tag, skeleton(F.col(text), keys))
    rules = cut(marked.select(F.col(tag).alias("skeleton")).where("skeleton IS NOT NULL").distinct().mapInArrow(_resolve_batches(keys), RULES))
    rules = rules.where("size(rules) > 0").select(F.col("skeleton").alias("__packed_key"), F.col("rules").alias("__packed_rules"))
    joined = lookup(marked, rules, F.col(tag) == F.col("__packed_key"), "left").drop(tag, "__packed_key")
    return joined.withColumn("__packed_tokens", F.when(F.col("__packed_rules").isNotNull(), F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0))))


def packed_values(df: DataFrame, text: str, keys: list[str], out: str = "vals") -> DataFrame:
    """``df`` with the array ``out`` of (attr_key, val_pos, val) for ``keys`` (lower case) in ``text``.

    Nulls, empty texts and texts without these keys give an empty array; repeated rows stay. The
    columns of ``df`` are kept whatever their names, except ``out`` itself.
    """
    cell = lambda r: F.struct(r["k"].alias("attr_key"), r["pos"].alias("val_pos"), _value(F.col("__packed_tokens"), r).alias("val"))
    vals = F.coalesce(F.transform("__packed_rules", cell), F.array().cast("array<struct<attr_key:string,val_pos:int,val:string>>"))
    return _ruled(df, text, keys).withColumn(out, vals).drop("__packed_rules", "__packed_tokens")


def split_packed(df: DataFrame, row_id: str, text: str, keys: list[str]) -> DataFrame:
    """One row per value: (row_id, attr_key, val_pos, val); positions run from 1 per row and key."""
    ruled = _ruled(df.select(F.col(row_id), F.col(text).alias("__packed_text")), "__packed_text", keys)
    each = ruled.select(row_id, "__packed_tokens", F.explode("__packed_rules").alias("__packed_rule"))
    return each.select(row_id, F.col("__packed_rule.k").alias("attr_key"), F.col("__packed_rule.pos").alias("val_pos"), _value(F.col("__packed_tokens"), F.col("__packed_rule")).alias("val"))
