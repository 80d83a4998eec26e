"""MPEG audio columns: frame headers, tags, bitrate tables, checksums, exact durations and seek offsets.

`parse` reads a stream as found in the wild: it skips and reads ID3v2, APEv2 and ID3v1 tags, resynchronises on frame headers
(a header counts only if the frame it announces is followed by a header of the same kind, by a tag or by the end), reads a
Xing, Info or VBRI table of the first frame with the encoder's delay and padding, verifies the CRC-16 of protected Layer III frames,
and adds up the samples of all frames less delay and padding, so durations are exact, with the byte offset of every SEEK-th frame. Frames of
free format (no bitrate in the header) have the size at which the next header follows.

`store` puts any bytes losslessly into such a stream: each frame is MPEG-1 Layer III, mono, protected, with side information
that announces no audio bits, so all that follows the side information is ancillary data; it carries UNIT bytes of payload.
`load` parses the stream and gives the payload back. A stream starts with an ID3v2 tag that holds the length and an Info frame
with the number of frames and bytes and the table of contents.

Defined cases: null media gives null features, empty or unsynchronisable media gives no frames and no duration; junk between
frames is skipped and counted; a cut last frame is counted as damage; tags at the end count only outside of a last frame in step
that ends with the stream. Payloads of any length are handled in memory of a small
multiple of their own size, one row at a time; equal inputs give equal outputs.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm.common import table

UNIT = 576
SEEK = 64
#: The longest frame of free format: twice that of the highest bitrate.
MOST_FREE = 4 * 2880
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
KBPS = {
    (3, 3): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (3, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (3, 1): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 3): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}


@lru_cache(maxsize=65536)
def header(four: bytes) -> tuple | None:
    """(version, layer, protected, kbps, rate, mono, bytes of the frame, samples, bytes of side information); None: no frame header.
    In free format kbps is 0 and the frame's bytes are what padding adds.

    version: 3 MPEG-1, 2 MPEG-2, 0 MPEG-2.5. layer: 3 Layer I, 2 Layer II, 1 Layer III, as the bits have it."""
    (h,) = struct.unpack(">I", four)
    if h >> 21 != 0x7FF:
        return None
    version, layer, rate_at, kbps_at = h >> 19 & 3, h >> 17 & 3, h >> 10 & 3, h >> 12 & 15
    if version == 1 or layer == 0 or rate_at == 3 or kbps_at == 15 or h & 3 == 2:
        return None
    kbps = KBPS[(3, layer) if version == 3 else (2, 3 if layer == 3 else 2)][kbps_at]
    rate, pad, mono = RATES[version][rate_at], h >> 9 & 1, h >> 6 & 3 == 3
    if layer == 3:
        size, samples = (12000 * kbps // rate + pad) * 4, 384
    else:
        samples = 576 if layer == 1 and version != 3 else 1152
        size = samples * 125 * kbps // rate + pad
    side = 0 if layer != 1 else (17 if mono else 32) if version == 3 else (9 if mono else 17)
    return version, layer, not h >> 16 & 1, kbps, rate, mono, size, samples, side


def free_size(data: bytes, at: int, end: int, h: tuple) -> int:
    """The bytes, without padding, of a frame of free format: up to the next header of its kind, or to the end; 0 if there is none within
    MOST_FREE bytes."""
    nxt = at + 4
    while True:
        nxt = data.find(data[at : at + 1], nxt, min(end, at + MOST_FREE + 4))
        if nxt < 0:
            return end - at - h[6] if 4 < end - at <= MOST_FREE else 0
        n = header(data[nxt : nxt + 4]) if nxt + 4 <= end else None
        if n and n[:2] == h[:2] and n[3] == 0 and n[4] == h[4]:
            return nxt - at - h[6]
        nxt += 1


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


CRC = _crc_table()


@lru_cache(maxsize=65536)
def crc16(data: bytes) -> int:
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFFFF) ^ CRC[c >> 8 ^ b]
    return c


def syncsafe(data: bytes) -> int:
    return data[0] << 21 | data[1] << 14 | data[2] << 7 | data[3]


def id3_frames(tag: bytes) -> dict[str, str]:
    """The text frames of an ID3v2.3 or 2.4 tag; damage ends the reading."""
    out: dict[str, str] = {}
    at, v4 = 10, tag[3] == 4
    while at + 10 <= len(tag) and tag[at : at + 4].isalnum():
        size = syncsafe(tag[at + 4 : at + 8]) if v4 else int.from_bytes(tag[at + 4 : at + 8], "big")
        body = tag[at + 10 : at + 10 + size]
        if tag[at : at + 1] == b"T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace")
            name, _, value = text.partition("\0") if tag[at : at + 4] == b"TXXX" else (tag[at : at + 4].decode(), "", text)
            out.setdefault(name, value.rstrip("\0"))
        at += 10 + size
    return out


def rate_table(frame: bytes, h: tuple) -> dict | None:
    """The Xing, Info or VBRI table of a frame; None: it has none."""
    at = 4 + 2 * h[2] + h[8]
    for start in dict.fromkeys((at, 4 + h[8])):
        if frame[start : start + 4] in (b"Xing", b"Info") and len(frame) >= start + 8:
            flags, p = int.from_bytes(frame[start + 4 : start + 8], "big"), start + 8
            out: dict = {"kind": frame[start : start + 4].decode()}
            for bit, key in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[key] = int.from_bytes(frame[p : p + 4], "big")
                    p += 4
            if flags & 4:
                out["toc"] = list(frame[p : p + 100])
                p += 100
            p += 4 * bool(flags & 8)
            if frame[p : p + 4] in (b"LAME", b"Lavc", b"Lavf", b"L3.9") and len(frame) >= p + 24:
                both = int.from_bytes(frame[p + 21 : p + 24], "big")
                out |= {"encoder": frame[p : p + 9].decode("latin-1").strip("\0 "), "delay": both >> 12, "padding": both & 0xFFF}
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, n, scale, width, per = struct.unpack(">IIHHHH", frame[46:62])
        steps = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(min(n, (len(frame) - 62) // width if width else 0))]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "steps": steps, "frames_per_step": per}
    return None


def parse(data: bytes) -> dict:
    """What a stream holds; offsets has the place of every audio frame (the table's frame is no audio frame)."""
    at, end, tags, kinds, junk = 0, len(data), {}, [], 0
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        size = 10 + syncsafe(data[at + 6 : at + 10]) + 10 * bool(data[at + 5] & 0x10)
        tags = id3_frames(data[at : at + size]) | tags
        kinds.append(f"ID3v2.{data[at + 3]}")
        at += size
    front = len(kinds)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        kinds.append("ID3v1")
        end -= 128
    if end - at >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        kinds.append("APEv2")
        size = int.from_bytes(data[end - 20 : end - 16], "little")
        end = max(at, end - size - (32 if data[end - 9] & 0x80 else 0))
    offsets, table_, samples, rate, kbps, bad, checked, resyncs, last = [], None, 0, 0, 0, 0, 0, 0, None
    first, free = True, 0
    while at + 4 <= end:
        h = header(data[at : at + 4])
        if h and h[3] == 0:
            size = free if free and last is not None else free_size(data, at, end, h)
            h = (*h[:6], h[6] + size, *h[7:]) if size else None
            free = size
        if h and last is None:  # not yet in step: the next header must follow where this frame ends
            nxt = at + h[6]
            n = header(data[nxt : nxt + 4]) if nxt + 4 <= end else None
            if nxt > end or (nxt != end and not (n and n[:2] == h[:2] and n[4] == h[4])):
                h = None
        elif h and (h[:2] != last[:2] or h[4] != last[4]):
            h = None
        if h is None:
            if last is not None:
                resyncs += 1
                last = None
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            junk += nxt - at
            at = nxt
            continue
        if last is not None and end < at + h[6] == len(data):  # in step to the very end: what looks like a tag belongs to the frame
            del kinds[front:]
            end = len(data)
        if at + h[6] > end:
            junk += end - at  # a cut frame
            bad += 1
            at = end
            break
        last = h
        if h[2] and h[1] == 1:
            checked += 1
            good = crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h[8]]) == int.from_bytes(data[at + 4 : at + 6], "big")
            bad += not good
        if first and h[1] == 1:
            table_ = rate_table(data[at : at + h[6]], h)
        if not (first and table_):
            offsets.append(at)
            samples += h[7]
            kbps += h[3]
            rate = rate or h[4]
        first = False
        at += h[6]
    junk += max(0, end - at)
    n = len(offsets)
    samples = max(0, samples - sum((table_ or {}).get(k, 0) for k in ("delay", "padding")))
    return {
        "tags": tags, "tag_kinds": kinds, "table": table_, "offsets": offsets, "frames": n, "samples": samples, "rate": rate,
        "seconds": samples / rate if rate else 0.0, "mean_kbps": kbps / n if n else 0.0, "bad": bad, "checked": checked, "junk": junk, "resyncs": resyncs,
    }


#: MPEG-1 Layer III, protected, 192 kbit/s, 44.1 kHz, no padding, mono: 626 bytes, of which 23 are header, CRC and side information.
HEAD = bytes([0xFF, 0xFA, 0xB0, 0xC4])
SIZE, FIXED = 626, 23


def _start() -> bytes:
    side = bytes(17)
    return HEAD + crc16(HEAD[2:] + side).to_bytes(2, "big") + side


def store(payload: bytes, n_bytes: int) -> bytes:
    """payload, a multiple of UNIT bytes long, as a stream. n_bytes is noted in the tag."""
    n = len(payload) // UNIT
    frames = np.zeros((n + 1, SIZE), np.uint8)
    frames[:, :FIXED] = np.frombuffer(_start(), np.uint8)
    frames[1:, FIXED : FIXED + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    toc = bytes(min(255, i * 256 // 100) for i in range(100))
    info = b"Info" + struct.pack(">III", 7, n, (n + 1) * SIZE) + toc
    frames[0, FIXED : FIXED + len(info)] = np.frombuffer(info, np.uint8)
    body = b"\3n_bytes\0" + str(n_bytes).encode()
    tag = b"TXXX" + struct.pack(">I", len(body))[:4] + b"\0\0" + body
    size = len(tag)
    safe = bytes([size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127])
    return b"ID3\3\0\0" + safe + tag + frames.tobytes()


def load(media: bytes, found: dict | None = None) -> tuple[bytes, int]:
    """(payload, n_bytes) of a stream made by store."""
    found = found or parse(media)
    at = np.asarray(found["offsets"], np.int64)
    if len(at) and at[-1] - at[0] == (len(at) - 1) * SIZE:
        rows = np.frombuffer(media, np.uint8, len(at) * SIZE, at[0]).reshape(-1, SIZE)
        payload = rows[:, FIXED : FIXED + UNIT].tobytes()
    else:
        payload = b"".join(media[o + FIXED : o + FIXED + UNIT] for o in found["offsets"])
    return payload, int(found["tags"].get("n_bytes", 0))


def feature(found: dict) -> str:
    """One line with what was found; seek has the byte offset of every SEEK-th frame."""
    t = found["table"] or {}
    seek = ",".join(map(str, found["offsets"][::SEEK]))
    return (
        f"frames={found['frames']};samples={found['samples']};rate={found['rate']};ms={found['samples'] * 1000 // found['rate'] if found['rate'] else 0};"
        f"kbps={found['mean_kbps']:g};table={t.get('kind', '-')}:{t.get('frames', '-')}:{t.get('bytes', '-')};tags={'+'.join(found['tag_kinds']) or '-'};"
        f"crc={found['checked'] - found['bad']}/{found['checked']};junk={found['junk']};resync={found['resyncs']};seek={seek}"
    )


FEATURES = "frames long, samples long, rate int, seconds double, mean_kbps double, bad int, junk long, resyncs int, table string, tags map<string,string>, seek array<long>"


def _features(media: pd.Series) -> pd.DataFrame:
    rows = []
    for m in media:
        if m is None:
            rows.append([None] * 11)
            continue
        f = parse(bytes(m))
        rows.append([f["frames"], f["samples"], f["rate"], f["seconds"], f["mean_kbps"], f["bad"], f["junk"], f["resyncs"], (f["table"] or {}).get("kind"), f["tags"], f["offsets"][::SEEK]])
    return pd.DataFrame(rows, columns=[c.split()[0] for c in FEATURES.split(", ")])


def _to_audio(data: pd.Series) -> pd.Series:
    return data.map(lambda x: store(*padded(bytes(x) if x is not None else b"")))


def audio_features(media: Column | str) -> Column:
    """A column of MPEG streams as a struct of features (FEATURES); null fields where the media is null."""
    return F.pandas_udf(_features, FEATURES)(media)


def to_audio(data: Column | str) -> Column:
    """Any bytes (null: none), padded with 255 to a positive multiple of UNIT, as MPEG audio."""
    return F.pandas_udf(_to_audio, "binary")(data)


def padded(data: bytes) -> tuple[bytes, int]:
    return data + b"\xff" * (-len(data) % UNIT if data else UNIT), len(data)


DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def round_trip(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        media = store(*padded(t.encode() if t is not None else b""))
        found = parse(media)
        payload, n = load(media, found)
        rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(found)))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in DIGEST.split(", ")])


def media_digest(docs: DataFrame) -> DataFrame:
    """Each text of docs stored as MPEG audio, read back and described."""
    return docs.select("doc_id", F.pandas_udf(round_trip, DIGEST)("text").alias("m")).select("doc_id", "m.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(table(spark, sf_dir, "documents"))


SQL = None
