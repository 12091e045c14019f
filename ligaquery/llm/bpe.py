"""Byte-level BPE of a whole corpus by a rank queue with a hierarchical bitmap.

The pre-tokens that a slice of documents brings anew are laid end to end as one linked list of
bytes. Every adjacent pair that some merge joins sits in the bucket of its rank; a bitmap of three
levels tells by find-first-set which bucket is next. A bucket is merged at once, left to right,
entries that an earlier merge made stale are skipped, and the new neighbours go to their buckets.
The work is near linear in the bytes, also for one pre-token of megabytes.

Texts are cut into chunks (white space and what follows) whose ids are remembered in the Python
worker, so that the corpus' common words are looked up only.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the published pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: the characters that \s stands for in that pattern.
BLANK = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
NONE = np.iinfo(np.int32).max
#: A slice of documents ends after so many characters; chunks are remembered up to so many.
SLICE_CHARS, REMEMBER = 8_000_000, 200_000


class RankQueue:
    """Ranks that have a bucket, as bits in three levels of 64-bit words."""

    def __init__(self, n: int) -> None:
        self.low, self.mid, self.top = [0] * (n // 64 + 1), [0] * (n // 4096 + 1), 0
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, at: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [at]
            self.low[rank >> 6] |= 1 << (rank & 63)
            self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
            self.top |= 1 << (rank >> 12)
        else:
            bucket.append(at)

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The lowest rank and its positions in order, or None."""
        if not self.top:
            return None
        i = (self.top & -self.top).bit_length() - 1
        j = i << 6 | (self.mid[i] & -self.mid[i]).bit_length() - 1
        rank = j << 6 | (self.low[j] & -self.low[j]).bit_length() - 1
        self.low[j] &= self.low[j] - 1
        if not self.low[j]:
            self.mid[i] &= self.mid[i] - 1
            if not self.mid[i]:
                self.top &= self.top - 1
        parts = self.buckets.pop(rank)
        return rank, parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


class Encoder:
    """The ids of pre-tokens and texts by the bytes of a rank file (base64 token and rank a line)."""

    def __init__(self, rank_file: bytes) -> None:
        import regex

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line.strip())}
        self.size = max(ranks.values()) + 1
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.pre = regex.compile(PATTERN).findall
        self.chunks = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+").findall
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], NONE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids (32-bit, little endian) of each pre-token."""
        lengths = np.array([len(w) for w in words], np.int64)
        n = int(lengths.sum())
        if not n:
            return [b""] * len(words)
        tok = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.cumsum(lengths)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        full = lengths > 0
        nxt[ends[full] - 1] = -1
        prv[(ends - lengths)[full]] = -1
        live = np.ones(n, bool)
        now = np.full(n, NONE, np.int32)  # the rank of the pair that begins here
        queue = RankQueue(self.size)

        def enter(at: np.ndarray) -> None:
            rank = self._rank(tok[at], tok[nxt[at]])
            now[at] = rank
            good = rank != NONE
            at, rank = at[good], rank[good]
            if len(at) == 1:
                queue.push(int(rank[0]), at)
            elif len(at):
                order = np.argsort(rank, kind="stable")
                at, rank = at[order], rank[order]
                first = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1])))
                for r, part in zip(rank[first].tolist(), np.split(at, first[1:]), strict=True):
                    queue.push(r, part)

        enter(np.flatnonzero(nxt >= 0))
        while (least := queue.pop()) is not None:
            rank, at = least
            at = at[now[at] == rank]  # the rest is stale
            if len(at) > 1:
                joined = np.concatenate(([False], nxt[at[:-1]] == at[1:]))  # pairs that share a symbol
                if joined.any():
                    i = np.arange(len(at))
                    run = i - np.maximum.accumulate(np.where(joined, 0, i))
                    at = at[run % 2 == 0]
            if not len(at):
                continue
            gone = nxt[at]
            after = nxt[gone]
            tok[at], nxt[at] = rank, after
            live[gone], now[gone] = False, NONE
            has = after >= 0
            prv[after[has]] = at[has]
            now[at[~has]] = NONE
            before = prv[at]
            enter(np.unique(np.concatenate((at[has], before[before >= 0]))))
        ids = tok[live].astype("<i4").tobytes()
        stops = (np.concatenate(([0], np.cumsum(live)))[np.concatenate(([0], ends))] * 4).tolist()
        return [ids[a:b] for a, b in zip(stops[:-1], stops[1:], strict=True)]

    def _learn(self, chunks: set[str]) -> None:
        if len(self.known) > REMEMBER:
            self.known.clear()
        if len(self.words) > REMEMBER:
            self.words.clear()
        split = {c: self.pre(c) for c in chunks}
        new = list({w for ws in split.values() for w in ws} - self.words.keys())
        self.words.update(zip(new, self.merge([w.encode() for w in new]), strict=True))
        of = self.words.__getitem__
        self.known.update((c, b"".join(map(of, ws))) for c, ws in split.items())

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids (32-bit, little endian) of each text."""
        cut = [self.chunks(t) for t in texts]
        new = set().union(*cut) - self.known.keys()
        if new:
            if len(self.known) > REMEMBER:
                new = set().union(*cut)
            self._learn(new)
        of = self.known.__getitem__
        return [b"".join(map(of, c)) for c in cut]


_encoders: dict[str, Encoder] = {}


def encoder(name: str, rank_file: Broadcast) -> Encoder:
    """One encoder a Python worker and vocabulary."""
    if name not in _encoders:
        _encoders[name] = Encoder(rank_file.value)
    return _encoders[name]


def _slices(texts: list[str]) -> Iterator[list[str]]:
    part, chars = [], 0
    for t in texts:
        part.append(t)
        chars += len(t)
        if chars >= SLICE_CHARS:
            yield part
            part, chars = [], 0
    if part:
        yield part


def _over(name: str, rank_file: Broadcast, finish: Callable[[list[bytes]], pa.Array]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, rank_file)
        for batch in batches:
            texts, done = ["" if t is None else t for t in batch.column(1).to_pylist()], 0
            for part in _slices(texts):
                out = finish(enc.encode(part))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(part)), out], ["row_id", "out"])
                done += len(part)

    return run


def _as_lists(ids: list[bytes]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def _as_counts(ids: list[bytes]) -> pa.Array:
    return pa.array([len(x) // 4 for x in ids], pa.int64())


def _map(df: DataFrame, row_id: str, text: str, ranks_path: str, finish, kind: str, name: str) -> DataFrame:
    rows = df.select(F.col(row_id).alias("row_id"), F.col(text).alias("text"))
    raw = Path(ranks_path).read_bytes()  # a fixed vocabulary of about 1 MB
    vocabulary = df.sparkSession.sparkContext.broadcast(raw)
    typ = rows.schema["row_id"].dataType.simpleString()
    return rows.mapInArrow(_over(hashlib.sha1(raw).hexdigest(), vocabulary, finish), f"row_id {typ}, out {kind}").select(F.col("row_id").alias(row_id), F.col("out").alias(name))


def token_ids(df: DataFrame, row_id: str, text: str, ranks_path: str) -> DataFrame:
    """(row_id, ids) of every row; ids is empty for empty and null texts, repeated rows stay."""
    return _map(df, row_id, text, ranks_path, _as_lists, "array<int>", "ids")


def token_counts(df: DataFrame, row_id: str, text: str, ranks_path: str) -> DataFrame:
    """(row_id, n_tokens) of every row; 0 for empty and null texts."""
    return _map(df, row_id, text, ranks_path, _as_counts, "bigint", "n_tokens")
