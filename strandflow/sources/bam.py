"""BAM files: BGZF blocks read in parallel by byte ranges, and records encoded for tests and exchange.

A file is cut into byte ranges. Each task finds the first block that begins in its range, and in it the first record, by what a record
must look like (sizes that agree, a name that ends in a zero, a known reference) several times in a row; records belong to the range in which
their block begins. So no index is needed and no file is held whole.

Defined cases: a file without records gives none; a damaged block ends its range with an error; unmapped and secondary alignments are dropped by
`read_bam` (see gtf.aligned), not by the scan.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from strandflow.sources.genome import _opened
from strandflow.sources.gtf import aligned

#: Bytes of a range.
RANGE = 64 << 20
ROWS = "read_id string, flag int, chr string, pos long, cigar string"
OPS = "MIDNSHP=X"


def _block(f, at: int) -> tuple[bytes, int] | None:
    """(content, next place) of the block at a place; None at the end."""
    f.seek(at)
    head = f.read(18)
    if len(head) < 18:
        return None
    if head[:4] != b"\x1f\x8b\x08\x04" or head[12:14] != b"BC":
        raise ValueError(f"no block at {at}")
    size = struct.unpack("<H", head[16:18])[0] + 1
    raw = f.read(size - 18)
    return zlib.decompress(raw[:-8], -15), at + size


def _find(f, at: int, size: int) -> int | None:
    """The place of the first block that begins at or after `at`: its magic, and a block where it says that the next one is."""
    f.seek(at)
    data = f.read(min(size - at, 1 << 18))
    k = data.find(b"\x1f\x8b\x08\x04")
    while k >= 0:
        if data[k + 12 : k + 16] == b"BC\x02\x00":
            nxt = at + k + struct.unpack("<H", data[k + 16 : k + 18])[0] + 1
            f.seek(nxt)
            if nxt == size or f.read(4) == b"\x1f\x8b\x08\x04":
                return at + k
        k = data.find(b"\x1f\x8b\x08\x04", k + 1)
    return None


def header(path: str) -> tuple[list[tuple[str, int]], int, int]:
    """(names and lengths of the references, block and place in it of the first record)."""
    with _opened(path) as f:
        data, at, block = b"", 0, 0

        def need(n: int) -> None:
            nonlocal data, at, block
            while len(data) < n:
                got = _block(f, at)
                if got is None:
                    raise ValueError("the header is cut off")
                starts.append((at, len(data)))
                data += got[0]
                at = got[1]

        starts: list[tuple[int, int]] = []
        need(8)
        if data[:4] != b"BAM\1":
            raise ValueError("not a BAM file")
        p = 8 + struct.unpack("<i", data[4:8])[0]
        need(p + 4)
        n, p = struct.unpack("<i", data[p : p + 4])[0], p + 4
        refs = []
        for _ in range(n):
            need(p + 4)
            k = struct.unpack("<i", data[p : p + 4])[0]
            need(p + 8 + k)
            refs.append((data[p + 4 : p + 3 + k].decode(), struct.unpack("<i", data[p + 4 + k : p + 8 + k])[0]))
            p += 8 + k
        if p == len(data):
            return refs, at, 0
        block, first = max(s for s in starts if s[1] <= p)
        return refs, block, p - first


def _plausible(d: bytes, p: int, refs: int) -> int | None:
    """The size of the record at p, if it looks like one."""
    if p + 36 > len(d):
        return None
    size, ref, pos, name, _, _, ops, _, bases, nref, npos, _ = struct.unpack("<iiiBBHHHiiii", d[p : p + 36])
    least = 32 + name + 4 * ops + (bases + 1) // 2 + bases
    if not (-1 <= ref < refs and -1 <= nref < refs and pos >= -1 and npos >= -1 and name > 0 and bases >= 0 and least <= size < 1 << 28):
        return None
    end = p + 36 + name
    if end <= len(d) and (d[end - 1] != 0 or not d[p + 36 : end - 1].isascii() or 0 in d[p + 36 : end - 1]):
        return None
    return size


def _first_record(d: bytes, refs: int) -> int | None:
    """The place of the first record in the content of some blocks."""
    for p in range(len(d)):
        at, n = p, 0
        while n < 8 and at + 36 <= len(d):
            size = _plausible(d, at, refs)
            if size is None:
                break
            n += 1
            at += 4 + size
        else:
            if n:
                return p
    return None


def records(path: str, lo: int, hi: int, refs: list[tuple[str, int]], start: tuple[int, int]) -> Iterator[tuple]:
    """ROWS of the records that begin in blocks that begin in [lo, hi)."""
    names = [r[0] for r in refs]
    with _opened(path) as f:
        size = f.size()
        if lo <= start[0]:
            block, p = start
        else:
            block, p = _find(f, lo, size), None
        if block is None or block >= hi:
            return
        data, at, begins = b"", block, []

        def more() -> bool:
            nonlocal data, at
            got = _block(f, at)
            if got is None:
                return False
            begins.append((len(data), at))
            data += got[0]
            at = got[1]
            return True

        if p is None:
            for _ in range(4):
                more()
            p = _first_record(data, len(names))
            if p is None:
                return
        while True:
            while len(data) < p + 4 and more():
                pass
            if len(data) < p + 4:
                return
            if max(b for b in begins if b[0] <= p)[1] >= hi:
                return
            n = struct.unpack("<i", data[p : p + 4])[0]
            while len(data) < p + 4 + n and more():
                pass
            ref, pos, name, _, _, ops, flag = struct.unpack("<iiBBHHH", data[p + 4 : p + 20])
            q = p + 36
            cigar = "".join(f"{v >> 4}{OPS[v & 15]}" for v in struct.unpack(f"<{ops}I", data[q + name : q + name + 4 * ops])) or "*"
            yield data[q : q + name - 1].decode(), flag, names[ref] if ref >= 0 else "*", pos + 1, cigar
            p += 4 + n
            if p > 1 << 22:  # what was read goes
                keep = [b for b in begins if b[0] <= p][-1]
                data, begins = data[keep[0] :], [(b[0] - keep[0], b[1]) for b in begins if b[0] >= keep[0]]
                p -= keep[0]


def scan_bam(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """ROWS of all records, a task for each range of `size` bytes."""
    refs, block, place = header(path)
    with _opened(path) as f:
        whole = f.size()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in ROWS.split(", ")]
        for pdf in batches:
            for k in pdf["id"]:
                rows = []
                for r in records(path, k * size, min(whole, (k + 1) * size), refs, (block, place)):
                    rows.append(r)
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                yield pd.DataFrame(rows, columns=columns)

    n = max(1, -(-whole // size))
    return spark.range(n, numPartitions=n).mapInPandas(read, ROWS)


def read_bam(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """read_id, chr, strand, x of mapped, primary alignments."""
    return aligned(scan_bam(spark, path, size))


def encoded(rows: list[tuple], refs: list[tuple[str, int]], block: int = 60_000) -> bytes:
    """A BAM file of ROWS tuples, without bases."""
    import re

    number = {n: i for i, (n, _) in enumerate(refs)}
    out = bytearray(b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", len(refs)))
    for n, length in refs:
        out += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", length)
    for name, flag, chr_, pos, cigar in rows:
        ops = [int(n) << 4 | OPS.index(o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
        body = struct.pack("<iiBBHHHiiii", number.get(chr_, -1), pos - 1, len(name) + 1, 60, 4680, len(ops), flag, 0, -1, -1, 0)
        body += name.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops)
        out += struct.pack("<i", len(body)) + body
    packed = b""
    for i in range(0, len(out), block):
        part = bytes(out[i : i + block])
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        raw = c.compress(part) + c.flush()
        packed += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(raw) + 25) + raw + struct.pack("<II", zlib.crc32(part), len(part))
    return packed + bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def sample_name(path: str) -> str:
    """A file's name without folder and extension."""
    return os.path.splitext(os.path.basename(path.rstrip("/")))[0]


def sample_files(reads: str | list[str] | dict[str, str]) -> dict[str, str]:
    """Samples by name: one path, several, or named ones. Two files of one name are an error."""
    if isinstance(reads, dict):
        return dict(reads)
    paths = [reads] if isinstance(reads, str) else list(reads)
    out = {sample_name(p): p for p in paths}
    if len(out) < len(paths):
        raise ValueError("two samples have the same name")
    return out
