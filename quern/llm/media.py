"""Media columns: signature sniffing with structural validation, type correction and carving."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

# magic bytes -> (kind, distance from the file's start)
MAGIC = {
    b"\x89PNG\r\n\x1a\n": ("image/png", 0),
    b"\xff\xd8\xff": ("image/jpeg", 0),
    b"GIF87a": ("image/gif", 0),
    b"GIF89a": ("image/gif", 0),
    b"RIFF": ("riff", 0),
    b"BM": ("image/bmp", 0),
    b"%PDF-": ("application/pdf", 0),
    b"PK\x03\x04": ("application/zip", 0),
    b"\x1f\x8b\x08": ("application/gzip", 0),
    b"fLaC": ("audio/flac", 0),
    b"OggS": ("application/ogg", 0),
    b"ftyp": ("video/mp4", 4),
    b"II*\x00": ("image/tiff", 0),
    b"MM\x00*": ("image/tiff", 0),
}


_MARKER = re.compile(rb"\xff(?![\x00\xd0-\xd7])(?=.)", re.DOTALL)  # what ends entropy-coded data
_PDF = re.compile(rb"%PDF-|%%EOF| obj|startxref")
_ZIP_END = re.compile(rb"PK\x05\x06")


def _png(b: memoryview, at: int) -> int:
    p = at + 8
    first = True
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or first and (kind != b"IHDR" or n != 13):
            return 0
        if zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return 0
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return p - at
    return 0


def _jpeg(b: memoryview, at: int) -> int:
    p, scan = at + 2, False
    while p + 4 <= len(b):
        if b[p] != 0xFF:
            return 0
        m = b[p + 1]
        if m == 0xFF:
            p += 1
        elif m == 0xD9:
            return p + 2 - at if scan else 0
        elif m == 0x01 or 0xD0 <= m <= 0xD7:
            p += 2
        else:
            n = struct.unpack_from(">H", b, p + 2)[0]
            if n < 2 or m < 0xC0:
                return 0
            p += 2 + n
            if m == 0xDA:  # entropy-coded data up to the next real marker
                scan = True
                m = _MARKER.search(b, p)
                if not m:
                    return 0
                p = m.start()
    return p + 2 - at if scan and p + 2 <= len(b) and b[p] == 0xFF and b[p + 1] == 0xD9 else 0


def _gif(b: memoryview, at: int) -> int:
    if at + 13 > len(b):
        return 0
    f = b[at + 10]
    p = at + 13 + (3 << ((f & 7) + 1) if f & 0x80 else 0)
    images = 0
    while p < len(b):
        kind = b[p]
        if kind == 0x3B:
            return p + 1 - at if images else 0
        if kind == 0x2C:
            if p + 11 > len(b):
                return 0
            f = b[p + 9]
            p += 10 + (3 << ((f & 7) + 1) if f & 0x80 else 0) + 1
            images += 1
        elif kind == 0x21:
            p += 2
        else:
            return 0
        while p < len(b) and b[p]:
            p += b[p] + 1
        p += 1
    return 0


def _riff(b: memoryview, at: int) -> tuple[str, int]:
    none = ("", 0)
    if at + 12 > len(b):
        return none
    size, form = struct.unpack_from("<I4s", b, at + 4)
    kind = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}.get(form)
    end = at + 8 + size
    if not kind or end > len(b) or size < 4:
        return none
    p, ids, block = at + 12, set(), 1
    while p + 8 <= end:
        name, n = struct.unpack_from("<4sI", b, p)
        if p + 8 + n > end:
            return none
        if name == b"fmt " and n >= 16:
            tag, ch, rate, per_s, block, bits = struct.unpack_from("<HHIIHH", b, p + 8)
            if not ch or not block or tag == 1 and (block * 8 != ch * bits or per_s != rate * block):
                return none
        if name == b"data" and n % max(1, block):
            return none
        ids.add(name)
        p += 8 + n + (n & 1)
    need = {"audio/wav": {b"fmt ", b"data"}, "video/avi": {b"LIST"}}.get(kind, set())
    if p not in (end, end + 1) or not need <= ids or kind == "image/webp" and not ids & {b"VP8 ", b"VP8L", b"VP8X"}:
        return none
    return kind, end - at


def _bmp(b: memoryview, at: int) -> int:
    if at + 30 > len(b):
        return 0
    size, zero, start, head, w, h, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    ok = zero == 0 and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and head in (40, 52, 56, 64, 108, 124)
    if not ok or not 14 + head <= start <= size <= len(b) - at or w <= 0 or h == 0:
        return 0
    packed = struct.unpack_from("<I", b, at + 30)[0] if at + 34 <= len(b) else 0
    return size if packed or start + (w * bits + 31) // 32 * 4 * abs(h) <= size else 0


def _pdf(b: memoryview, at: int) -> int:
    """Up to the last end mark before the next PDF's head."""
    last, obj, start = 0, False, False
    for m in _PDF.finditer(b, at + 5):
        word = m.group()
        if word == b"%PDF-":
            break
        obj, start = obj or word == b" obj", start or word == b"startxref"
        if word == b"%%EOF" and obj and start:
            last = m.end()
    return last - at if last else 0


def _archives(b: memoryview) -> dict[int, int]:
    """Begin and length of every ZIP archive: an end record says where its directory is, which lies right before it."""
    out: dict[int, int] = {}
    for m in _ZIP_END.finditer(b):
        q = m.start()
        if q + 22 > len(b):
            break
        n, size, start, comment = struct.unpack_from("<HIIH", b, q + 10)
        at, directory = q - size - start, q - size
        if at >= 0 and q + 22 + comment <= len(b) and (not n or b[directory : directory + 4] == b"PK\x01\x02"):
            out.setdefault(at, q + 22 + comment - at)
    return out


def _gzip(b: memoryview, at: int) -> int:
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return 0
    d = zlib.decompressobj(31)
    try:
        p = at
        while p < len(b) and not d.eof:  # in pieces: the content is never held
            chunk = b[p : p + 65536]
            p += len(chunk)
            d.decompress(chunk, 1 << 20)
            while d.unconsumed_tail and not d.eof:
                d.decompress(d.unconsumed_tail, 1 << 20)
    except zlib.error:
        return 0
    return p - len(d.unused_data) - at if d.eof else 0


def _crc_table(poly: int, bits: int) -> list[int]:
    out = []
    for x in range(256):
        c = x << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ (poly if c >> (bits - 1) & 1 else 0)
        out.append(c & ((1 << bits) - 1))
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _flac_head(b: memoryview, p: int) -> int:
    """Length of the frame header at ``p`` if its code and its CRC-8 are right, else 0."""
    if p + 6 > len(b) or b[p] != 0xFF or b[p + 1] & 0xFE != 0xF8 or b[p + 3] & 1 or not b[p + 2] >> 4 or b[p + 2] & 15 == 15 or b[p + 3] >> 4 > 10 or b[p + 3] >> 1 & 7 in (3, 7):
        return 0
    lead = b[p + 4]
    more = 0 if lead < 0x80 else next((k for k in range(1, 7) if lead >> (6 - k) & 1 == 0), 7) if lead >= 0xC0 else 7
    n = 5 + more + {6: 1, 7: 2}.get(b[p + 2] >> 4, 0) + {12: 1, 13: 2, 14: 2}.get(b[p + 2] & 15, 0)
    if more == 7 or p + n >= len(b):
        return 0
    crc = 0
    for x in b[p : p + n]:
        crc = _CRC8[crc ^ x]
    return n + 1 if crc == b[p + n] else 0


def _flac(b: memoryview, at: int) -> int:
    """Metadata blocks, then frames: each begins with a header of right CRC-8 and ends where its CRC-16 is right and the next
    header, or no FLAC, follows. The stream's end is the end of its last whole frame."""
    p, first = at + 4, True
    while p + 4 <= len(b):
        kind, n = b[p], int.from_bytes(b[p + 1 : p + 4], "big")
        if first and (kind & 127 or n != 34) or p + 4 + n > len(b):
            return 0
        p, first = p + 4 + n, False
        if kind & 128:
            break
    else:
        return 0
    total = int.from_bytes(b[at + 8 + 13 : at + 8 + 18], "big") & ((1 << 36) - 1)
    most = int.from_bytes(b[at + 15 : at + 18], "big") or 1 << 24  # bytes of the largest frame, if the stream says it
    least = int.from_bytes(b[at + 12 : at + 15], "big")
    end, seen = 0, 0
    while head := _flac_head(b, p):
        block = _flac_block(b, p)
        size = _flac_frame(b, p, head, least, most, not total or seen + block >= total)
        if not size:
            break
        p, seen = p + size, seen + block
        end = p
        if total and seen >= total:
            break
    return end - at if end and (not total or seen >= total) else 0


def _flac_block(b: memoryview, p: int) -> int:
    code = b[p + 2] >> 4
    if code == 1:
        return 192
    if 2 <= code <= 5:
        return 576 << (code - 2)
    if code >= 8:
        return 256 << (code - 8)
    lead = b[p + 4]
    q = p + 5 + (0 if lead < 0x80 else next(k for k in range(1, 7) if lead >> (6 - k) & 1 == 0))
    return (b[q] if code == 6 else b[q] << 8 | b[q + 1]) + 1


def _flac_frame(b: memoryview, p: int, head: int, least: int, most: int, last: bool) -> int:
    """Bytes of the frame at ``p``: up to where the CRC-16 of all before it is right and a frame header follows. The last
    frame may also end with the data, or else where the CRC-16 is right first."""
    crc, first = 0, 0
    for x in b[p : p + head]:
        crc = (crc << 8 & 0xFF00) ^ _CRC16[crc >> 8 ^ x]
    for q in range(p + head, min(len(b), p + most) - 1):
        if crc == b[q] << 8 | b[q + 1] and q + 2 - p >= max(least, head + 3):
            if q + 2 == len(b) and last or _flac_head(b, q + 2):
                return q + 2 - p
            first = first or q + 2 - p
        crc = (crc << 8 & 0xFF00) ^ _CRC16[crc >> 8 ^ b[q]]
    return first if last else 0


def _ogg(b: memoryview, at: int, pages: set[int]) -> int:
    """Pages up to the last one that closes a stream. ``pages``: offsets of pages already walked, which begin no file."""
    p, closed = at, 0
    while at not in pages and p + 27 <= len(b) and b[p : p + 4] == b"OggS" and b[p + 4] == 0:
        n = b[p + 26]
        if p + 27 + n > len(b):
            break
        end = p + 27 + n + sum(b[p + 27 : p + 27 + n])
        if end > len(b):
            break
        closed = end - at if b[p + 5] & 4 else closed
        pages.add(end)
        p = end
    return closed


def _mp4(b: memoryview, at: int) -> int:
    p, kinds = at, set()
    while p + 8 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if n == 1 and p + 16 <= len(b):
            n = struct.unpack_from(">Q", b, p + 8)[0]
        if n < 8 or p + n > len(b) or not all(32 <= c < 127 for c in kind):
            break
        kinds.add(kind)
        p += n
    return p - at if b"ftyp" in kinds and kinds & {b"moov", b"mdat", b"moof"} else 0


def _tiff(b: memoryview, at: int) -> int:
    order = "<" if b[at] == 0x49 else ">"
    if at + 8 > len(b):
        return 0
    sizes = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
    ifd, end, seen = struct.unpack_from(order + "I", b, at + 4)[0], 8, set()
    while ifd and ifd not in seen:
        seen.add(ifd)
        if at + ifd + 2 > len(b):
            return 0
        n = struct.unpack_from(order + "H", b, at + ifd)[0]
        if not n or at + ifd + 6 + 12 * n > len(b):
            return 0
        where: dict[int, list[int]] = {}
        for i in range(n):
            tag, kind, count, value = struct.unpack_from(order + "HHII", b, at + ifd + 2 + 12 * i)
            if kind not in sizes:
                return 0
            size = sizes[kind] * count
            if size > 4:
                end = max(end, value + size)
                if at + value + size > len(b):
                    return 0
            if tag in (273, 279, 324, 325):
                if count == 1:
                    where[tag] = [value if kind == 4 else value >> (16 if order == ">" else 0) & 0xFFFF]
                else:
                    where[tag] = list(struct.unpack_from(f"{order}{count}{'I' if kind == 4 else 'H'}", b, at + value)) if size > 4 else []
        for o, s in ((273, 279), (324, 325)):
            end = max([end, *(x + y for x, y in zip(where.get(o, []), where.get(s, []), strict=False))])
        end = max(end, ifd + 6 + 12 * n)
        ifd = struct.unpack_from(order + "I", b, at + ifd + 2 + 12 * n)[0]
    return end if seen and at + end <= len(b) else 0


VALIDATE = {
    "image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "application/pdf": _pdf,
    "application/gzip": _gzip, "audio/flac": _flac, "video/mp4": _mp4, "image/tiff": _tiff,
}


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for magic, (kind, back) in MAGIC.items():
        a.add_word(magic.decode("latin-1"), (kind, len(magic) - 1 + back))
    a.make_automaton()
    return a


_FIND = None


@dataclass(frozen=True)
class Part:
    kind: str
    offset: int
    length: int


def sniff(data: bytes | None) -> list[Part]:
    """Every file whose magic bytes Aho-Corasick finds and whose structure its format's validator confirms.

    Files inside a confirmed file are reported too (a carrier's samples may hold another file); false magic bytes are
    not. Null and empty data give an empty list. The work is linear in the data, but for files within files.
    """
    global _FIND
    if not data:
        return []
    _FIND = _FIND or _automaton()
    view = memoryview(data)
    found: list[Part] = []
    archives, pages = None, set()
    for at, (kind, back) in _FIND.iter(data.decode("latin-1")):
        start = at - back
        if start < 0:
            continue
        if kind == "riff":
            kind, length = _riff(view, start)
        elif kind == "application/zip":  # every entry has the magic bytes: one pass finds all archives
            archives = _archives(view) if archives is None else archives
            length = archives.get(start, 0)
        else:
            try:
                length = _ogg(view, start, pages) if kind == "application/ogg" else VALIDATE[kind](view, start)
            except (struct.error, IndexError):
                length = 0
        if length:
            found.append(Part(kind, start, length))
    return sorted(set(found), key=lambda p: (p.offset, -p.length, p.kind))


def sniff_media(df: DataFrame, content: str = "content", declared: str | None = None, key: str = "id") -> DataFrame:
    """Per row: ``key``, ``declared``, ``detected`` type, ``corrected`` (declared and detected differ), ``valid_bytes``
    of the outer file and ``carved`` files: ``array<struct<kind, offset, length, bytes>>`` that lie inside or after it.

    ``detected`` is the confirmed file at offset 0, else ``application/octet-stream``. Null content: null type, no parts;
    empty content: octet-stream, no parts. Content is read whole, however long (one file in memory at a time). Of two
    files at one offset the longer, then the alphabetically first type, is the outer one. Repeated rows get equal values,
    other columns are not read, an empty table gives no rows.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            kinds, ok, size, parts = [], [], [], []
            for data, said in zip(b.column(1), b.column(2), strict=True):
                raw, said = data.as_py(), said.as_py()
                found = sniff(raw)
                outer = next((p for p in found if p.offset == 0), None)
                name = None if raw is None else outer.kind if outer else "application/octet-stream"
                kinds.append(name)
                ok.append(said is not None and name is not None and said != name)
                size.append(outer.length if outer else 0)
                parts.append([{"kind": p.kind, "offset": p.offset, "length": p.length, "bytes": raw[p.offset : p.offset + p.length]} for p in found if p is not outer])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(kinds, pa.string()), pa.array(ok, pa.bool_()), pa.array(size, pa.int64()), pa.array(parts, _PARTS)],
                names=["key", "declared", "detected", "corrected", "valid_bytes", "carved"],
            )

    from pyspark.sql import functions as F

    said = F.col(declared).cast("string") if declared else F.lit(None).cast("string")
    shape = f"key {kind}, declared string, detected string, corrected boolean, valid_bytes bigint, carved array<struct<kind:string,offset:bigint,length:bigint,bytes:binary>>"
    out = df.select(F.col(key).alias("k"), F.col(content).alias("c"), said.alias("d")).mapInArrow(run, shape)
    return out.withColumnRenamed("key", key)


_PARTS = pa.list_(pa.struct([("kind", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("bytes", pa.binary())]))


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    """The payload as unsigned 8-bit mono samples in a RIFF/WAVE file."""
    pad = b"\0" * (len(payload) & 1)
    head = struct.pack("<4sIHHIIHH4sI", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return struct.pack("<4sI4s", b"RIFF", 4 + len(head) + len(payload) + len(pad), b"WAVE") + head + payload + pad


def from_wav(media: bytes) -> bytes:
    """The samples of a confirmed RIFF/WAVE file."""
    view = memoryview(media)
    if not _riff(view, 0)[1]:
        raise ValueError("not a RIFF/WAVE file")
    p = 12
    while p + 8 <= len(media):
        name, n = struct.unpack_from("<4sI", media, p)
        if name == b"data":
            return media[p + 8 : p + 8 + n]
        p += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def text_payload(text: str | None, unit: int = 576) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * (-len(raw) % unit if raw else unit)


def text_media(df: DataFrame, key: str = "doc_id", text: str = "text", declared: str = "application/octet-stream") -> DataFrame:
    """Round trip of whole texts through 8-bit samples: the stored file and the features its sniffing gives.

    Columns: ``key``, ``n_bytes``, ``payload_bytes``, ``payload_sha256``, ``tail_crc32``, ``media_bytes``,
    ``media_sha256``, ``feature``. The payload (UTF-8, padded with bytes 255 to a positive multiple of 576; null is
    empty) is stored in a WAVE file of declared type ``declared``; the file is sniffed, its samples are read back, and
    payload columns are computed from what was read. ``feature`` says the confirmed type and length, whether it
    corrects the declared type, and what files are embedded in the samples. Rows are independent: ties and repeated
    rows get equal values, an empty table gives no rows.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for t in b.column(1):
                n, payload = text_payload(t.as_py())
                media = to_wav(payload)
                parts = sniff(media)
                outer = next(p for p in parts if p.offset == 0)
                back = from_wav(media)
                inner = ",".join(f"{p.kind}@{p.offset}+{p.length}" for p in parts if p is not outer)
                feature = f"{outer.kind};bytes={outer.length};corrected={str(outer.kind != declared).lower()};embedded=[{inner}]"
                values = (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature)
                for c, v in zip(cols, values, strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols, kinds)], names=["key", *_COLS])

    shape = f"key {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return df.select(key, text).mapInArrow(run, shape).withColumnRenamed("key", key)


_COLS = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
