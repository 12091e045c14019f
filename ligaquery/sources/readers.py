"""Readers of sequencing formats as DataFrames."""

from __future__ import annotations

import glob
import gzip
import io
import struct
import zlib
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 64 << 20


def _storage(path: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path in it, what goes before such a path): local, or by the scheme of a URI (hdfs, s3, gs and so on)."""
    if "://" not in path:
        return fs.LocalFileSystem(), path, ""
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner, path[: len(path) - len(inner)] if path.endswith(inner) else f"{path.split('://')[0]}://"


def _files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, of the files below a folder, or, locally, of a pattern; hidden ones are left out."""
    system, inner, scheme = _storage(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.Directory:
        found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    else:
        found = [info] if info.type == fs.FileType.File else [system.get_file_info(f) for f in sorted(glob.glob(inner))]
    return sorted((scheme + i.path, i.size) for i in found if i.type == fs.FileType.File and not i.base_name.startswith((".", "_")))


def _open(path: str, packed: bool | None = None) -> io.BufferedReader | gzip.GzipFile:
    system, inner, _ = _storage(path)
    raw = io.BufferedReader(system.open_input_file(inner), 1 << 18)
    return gzip.GzipFile(fileobj=raw) if (path.endswith(".gz") if packed is None else packed) else raw


class _Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int | None) -> None:
        self.path, self.begin, self.end = path, begin, end


class FastqSource(DataSource):
    """``fastq``: (file, read_id, seq, qual); plain files are split by bytes, gzip files are not.

    Blank lines between records are skipped; where a record should be and none can be recognised, the read fails.
    """

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "file STRING, read_id STRING, seq STRING, qual STRING"

    def reader(self, schema) -> DataSourceReader:
        return _FastqReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))


def _is_record(lines: list[bytes]) -> bool:
    """A record begins with @, has + two lines on, and sequence and quality of one length."""
    return lines[0][:1] == b"@" and lines[2][:1] == b"+" and len(lines[1].strip()) == len(lines[3].strip())


class _FastqReader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self) -> list[_Range]:
        out = []
        for f, n in _files(self.path):
            if f.endswith(".gz"):
                out.append(_Range(f, 0, None))
            else:
                out += [_Range(f, a, min(n, a + self.split)) for a in range(0, n, self.split)]
        return out or [_Range("", 0, 0)]

    @staticmethod
    def _first(f, at: int, part: _Range) -> int:
        """Where the first record of a split begins, from the line start ``at``; the split's end if none does."""
        ahead: list[bytes] = []
        passed = 0
        while at < part.end:
            ahead += [f.readline() for _ in range(4 - len(ahead))]
            if not ahead[0]:
                break
            if _is_record(ahead):
                return at
            passed += bool(ahead[0].strip())
            if passed > 3:  # at most three lines belong to a record begun before
                raise ValueError(f"{part.path}: no FASTQ record can be recognised before byte {at}: {ahead[0][:60]!r}")
            at += len(ahead.pop(0))
        return part.end

    def read(self, part: _Range) -> Iterator[tuple]:
        if not part.path:
            return
        with _open(part.path) as f:
            at = part.begin
            if at:
                f.seek(at - 1)
                at = self._first(f, at + len(f.readline()) - 1, part)
                f.seek(at)
            while part.end is None or at < part.end:
                head = f.readline()
                if not head:
                    return
                if not head.strip():  # blank lines between records
                    at += len(head)
                    continue
                lines = [head, *(f.readline() for _ in range(3))]
                if not _is_record(lines):
                    raise ValueError(f"{part.path}: no FASTQ record at byte {at}: {head[:60]!r}")
                at += sum(map(len, lines))
                rid, seq, _, qual = (x.decode("ascii", "replace").strip() for x in lines)
                yield part.path, rid[1:], seq, qual


#: Operations and bases of the binary alignment format, in code order.
BAM_OPS, BAM_BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
BAM_SCHEMA = "file STRING, qname STRING, flag INT, rname STRING, pos BIGINT, mapq INT, cigar STRING, seq STRING, qual STRING, tags MAP<STRING,STRING>"
_NUM = {b"c": "<b", b"C": "<B", b"s": "<h", b"S": "<H", b"i": "<i", b"I": "<I", b"f": "<f"}


class BamSource(DataSource):
    """``bam``: files in blocks (BGZF) are split by bytes, each record read where its first block begins; plain gzip files are not."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return BAM_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _BamReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))


def _block_size(head: bytes) -> int:
    """Bytes of the block that begins with ``head``, 0 if none does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return 0
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        size = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"BC" and size == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return 0


class _Blocks:
    """The bytes inside the blocks of a file from the block at ``at`` on, and the block in which each stands."""

    def __init__(self, f, at: int) -> None:
        self.f, self.at, self.buf, self.pos = f, at, b"", 0
        self.starts: list[tuple[int, int]] = []

    def more(self) -> bool:
        self.f.seek(self.at)
        size = _block_size(head := self.f.read(64))
        if not size:
            return False
        block = (head + self.f.read(max(0, size - len(head))))[:size]
        if self.pos > 1 << 20:  # what has been read goes
            self.starts = [(max(0, p - self.pos), b) for p, b in self.starts[-1:]]
            self.buf, self.pos = self.buf[self.pos :], 0
        self.starts.append((len(self.buf), self.at))
        self.buf += zlib.decompress(block[12 + struct.unpack_from("<H", block, 10)[0] : -8], -15)
        self.at += size
        return True

    def fill(self, end: int) -> bool:
        while len(self.buf) < end and self.more():
            pass
        return len(self.buf) >= end

    def take(self, n: int) -> bytes:
        while len(self.buf) - self.pos < n and self.more():
            pass
        out = self.buf[self.pos : self.pos + n]
        self.pos += len(out)
        return out

    def block(self, pos: int) -> int:
        return next((b for p, b in reversed(self.starts) if p <= pos), self.at)


def _names(s) -> list[str]:
    """The names of the references in a BAM header."""
    num = lambda: struct.unpack("<i", s(4))[0]
    if s(4) != b"BAM\1":
        raise ValueError("no BAM file")
    s(num())
    names = []
    for _ in range(num()):
        names.append(s(num())[:-1].decode())
        s(4)
    return names


def _looks_like_records(s: _Blocks, at: int, n_refs: int, most: int = 5) -> bool:
    """Whether ``most`` records, or all up to the end of the file, follow each other from ``at`` on."""
    for k in range(most):
        if not s.fill(at + 36):
            return k > 0 and at == len(s.buf)
        size, ref, pos, l_name, _, _, n_ops, _, l_seq, ref2, pos2 = struct.unpack_from("<iiiBBHHHiii", s.buf, at)
        need = 32 + l_name + 4 * n_ops + (l_seq + 1) // 2 + l_seq
        if not (l_name > 0 and l_seq >= 0 and need <= size < 1 << 28 and -1 <= ref < n_refs and -1 <= ref2 < n_refs and pos >= -1 and pos2 >= -1):
            return False
        if not s.fill(at + 36 + l_name) or s.buf[at + 35 + l_name] or any(not 33 <= c <= 126 for c in s.buf[at + 36 : at + 35 + l_name]):
            return False
        at += 4 + size
    return True


class _BamReader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self) -> list[_Range]:
        return [_Range(f, a, min(n, a + self.split)) for f, n in _files(self.path) for a in range(0, n, self.split)] or [_Range("", 0, 0)]

    def read(self, part: _Range) -> Iterator[tuple]:
        if not part.path:
            return
        with _open(part.path, packed=False) as f:
            if not _block_size(f.read(64)):
                if not part.begin:
                    f.seek(0)
                    yield from self._stream(gzip.GzipFile(fileobj=f), part.path)
                return
            s = _Blocks(f, 0)
            names = _names(s.take)
            if part.begin:
                s = self._first(f, part, len(names))
            while s and (s.pos < len(s.buf) or s.more()) and s.block(s.pos) < part.end:
                head = s.take(4)
                if len(head) == 4:
                    yield (part.path, *_bam_record(s.take(struct.unpack("<i", head)[0]), names))

    @staticmethod
    def _first(f, part: _Range, n_refs: int) -> _Blocks | None:
        """The blocks from the first that begins in the split, at its first record; None if no record begins there."""
        f.seek(part.begin)
        ahead = f.read(min(part.end - part.begin, 1 << 16) + (1 << 16) + 64)
        at = ahead.find(b"\x1f\x8b\x08\x04")
        while at >= 0 and part.begin + at < part.end:
            size = _block_size(ahead[at : at + 64])
            f.seek(part.begin + at + size)
            after = f.read(64)
            if size and (not after or _block_size(after)):
                break
            at = ahead.find(b"\x1f\x8b\x08\x04", at + 1)
        if at < 0 or part.begin + at >= part.end:
            return None
        s, pos = _Blocks(f, part.begin + at), 0
        while s.fill(pos + 1) and s.block(pos) < part.end:
            if _looks_like_records(s, pos, n_refs):
                s.pos = pos
                return s
            pos += 1
        return None

    @staticmethod
    def _stream(f, path: str) -> Iterator[tuple]:
        names = _names(f.read)
        while len(head := f.read(4)) == 4:
            yield (path, *_bam_record(f.read(struct.unpack("<i", head)[0]), names))


def _bam_record(b: bytes, names: list[str]) -> tuple:
    ref, pos, l_name, mapq, _, n_ops, flag, l_seq = struct.unpack_from("<iiBBHHHi", b)
    at = 32
    qname = b[at : at + l_name - 1].decode()
    at += l_name
    ops = struct.unpack_from(f"<{n_ops}I", b, at)
    at += 4 * n_ops
    packed = b[at : at + (l_seq + 1) // 2]
    at += len(packed)
    seq = "".join(BAM_BASES[x >> 4] + BAM_BASES[x & 15] for x in packed)[:l_seq]
    qual = b[at : at + l_seq]
    at += l_seq
    tags = {}
    while at < len(b):
        key, kind = b[at : at + 2].decode(), b[at + 2 : at + 3]
        at += 3
        if kind in _NUM:
            tags[key] = str(struct.unpack_from(_NUM[kind], b, at)[0])
            at += struct.calcsize(_NUM[kind])
        elif kind == b"A":
            tags[key], at = chr(b[at]), at + 1
        elif kind in b"ZH":
            end = b.index(0, at)
            tags[key], at = b[at:end].decode(), end + 1
        else:  # an array
            sub, n = b[at : at + 1], struct.unpack_from("<i", b, at + 1)[0]
            size = struct.calcsize(_NUM[sub])
            tags[key] = ",".join(str(struct.unpack_from(_NUM[sub], b, at + 5 + i * size)[0]) for i in range(n))
            at += 5 + n * size
    cigar = "".join(f"{x >> 4}{BAM_OPS[x & 15]}" for x in ops) or "*"
    shown = "*" if not qual or qual[0] == 255 else "".join(chr(q + 33) for q in qual)
    return qname, flag, names[ref] if ref >= 0 else None, pos if pos >= 0 else None, mapq, cigar, seq or "*", shown, tags


def read_fastq(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    spark.dataSource.register(FastqSource)
    return spark.read.format("fastq").option("splitBytes", split_bytes).load(path)


def read_bam(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Positions are 0-based; a missing reference or position is null."""
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").option("splitBytes", split_bytes).load(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, seq); the id ends at the first blank, line ends inside a sequence are taken out."""
    rec = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''")
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    return rec.select(F.regexp_extract(head, r"^\s*(\S*)", 1).alias("id"), F.regexp_replace(F.substr("value", F.length(head) + 1), r"\s", "").alias("seq"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Records of SAM text with 0-based positions and a tag map (first value of a tag); header and short lines are left out."""
    c = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.startswith("value", F.lit("@"))).select(c.alias("c")).where(F.size("c") >= 11)
    known = lambda i: F.when(F.get("c", F.lit(i)) != "*", F.get("c", F.lit(i)))
    num = lambda i: F.get("c", F.lit(i)).try_cast("int")
    tag = F.transform(F.slice("c", 12, F.greatest(F.size("c") - 11, F.lit(0))), lambda t: F.struct(F.substring(t, F.lit(1), F.lit(2)).alias("k"), F.substring(t, F.lit(6), F.length(t)).alias("v")))
    first = F.aggregate(tag, F.create_map().cast("map<string,string>"), lambda m, t: F.when(F.map_contains_key(m, t["k"]), m).otherwise(F.map_concat(m, F.create_map(t["k"], t["v"]))))
    pos = F.when(num(3) > 0, num(3).cast("bigint") - 1)
    return rows.select(F.get("c", F.lit(0)).alias("qname"), num(1).alias("flag"), known(2).alias("rname"), pos.alias("pos"), num(4).alias("mapq"), F.get("c", F.lit(5)).alias("cigar"), F.get("c", F.lit(9)).alias("seq"), F.get("c", F.lit(10)).alias("qual"), first.alias("tags"))


def read_gff_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, line) of GFF3 text; ``operators.quarantine`` splits them into features and failures."""
    return spark.read.option("lineSep", "\n").text(path).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file_name"), F.col("value").alias("line"))


CLUSTER_COLUMNS = "clust_id STRING, fst_ref STRING, fst_strand STRING, fst_strt BIGINT, fst_end BIGINT, sec_ref STRING, sec_strand STRING, sec_strt BIGINT, sec_end BIGINT, no_splits BIGINT, fst_len BIGINT, sec_len BIGINT"


def read_clusters(spark: SparkSession, path: str, min_splits: int = 2) -> DataFrame:
    """Cluster tables; clusters with fewer splits are left out."""
    return spark.read.schema(CLUSTER_COLUMNS).csv(path, sep="\t", header=True).where(F.col("no_splits") >= min_splits)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """Run statistics as ``sinks.writers.write_stats`` writes them; ``.`` is 0."""
    rows = spark.read.csv(path, sep="\t", header=True)
    return rows.select("condition", F.col("replicate").cast("int").alias("replicate"), *(F.coalesce(F.col(c).try_cast("bigint"), F.lit(0)).alias(c) for c in rows.columns[2:]))
