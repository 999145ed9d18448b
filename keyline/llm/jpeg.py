"""Baseline JPEG media columns: marker parsing, Huffman decoding and DC thumbnails in numpy.

Decoding: the segments of a file are parsed one by one; the entropy-coded intervals
(between restart markers) of all files of a group are then decoded side by side, one
Huffman symbol of each per step, so the work per symbol is numpy's, not Python's. A
file without restart markers is one interval. DC coefficients of the luminance
component give a thumbnail of one sample per 8 x 8 block.

Encoding is for payload bytes: a block carries 64 of them as its quantised
coefficients (all quantisers are 1), value byte + 1, so no coefficient is zero and
no run or end-of-block symbol is needed. A COM segment records the lengths.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .memory import lean

BLOCK = 64
#: Blocks in a row of an encoded image, which is also its restart interval.
ROW_BLOCKS = 8
MOST_ROWS = 8191
#: Files are handled in groups of about so many bytes.
GROUP_BYTES = 3 << 20

#: Code lengths of the encoder: DC categories 0-9, AC sizes 1-9 without run.
DC_LENGTHS = {n: 4 for n in range(10)}
AC_LENGTHS = {7: 1, 6: 2, 8: 3, 5: 4, 1: 7, 2: 7, 3: 7, 4: 7, 9: 7}


def canonical_codes(lengths: dict[int, int]) -> tuple[bytes, bytes, dict[int, int]]:
    """Counts per length, symbols in code order, and the code of each symbol."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = bytes(sum(1 for s in order if lengths[s] == n) for n in range(1, 17))
    codes, code, before = {}, 0, 0
    for s in order:
        code <<= lengths[s] - before
        codes[s], before = code, lengths[s]
        code += 1
    return counts, bytes(order), codes


def _code_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Left-aligned 16-bit code and length for each AC byte and each DC difference; DHT."""
    tables, header = [], b""
    for kind, lengths, values in (
        (0x10, AC_LENGTHS, range(1, 257)),
        (0x00, DC_LENGTHS, range(-256, 257)),
    ):
        counts, order, codes = canonical_codes(lengths)
        header += b"\xff\xc4" + struct.pack(">HB", 19 + len(order), kind) + counts + order
        code, length = [], []
        for v in values:
            size = abs(v).bit_length()
            bits = v if v > 0 else v + (1 << size) - 1
            length.append(lengths[size] + size)
            code.append((codes[size] << size | bits) << (16 - length[-1]))
        tables += [np.array(code, ">u2"), np.array(length, np.int64)]
    return (*tables, header)


_AC_CODE, _AC_LEN, _DC_CODE, _DC_LEN, _DHT = _code_tables()


def _header(blocks: int, note: bytes) -> tuple[bytes, int, int]:
    """Everything up to the scan's data; blocks in a row; rows."""
    wide = max(min(blocks, ROW_BLOCKS), -(-blocks // MOST_ROWS))
    rows = -(-blocks // wide)
    head = b"\xff\xd8\xff\xfe" + struct.pack(">H", 2 + len(note)) + note
    head += b"\xff\xdb\x00\x43\x00" + b"\x01" * 64
    head += b"\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 8 * rows, 8 * wide) + b"\x01\x01\x11\x00"
    head += _DHT + b"\xff\xdd\x00\x04" + struct.pack(">H", wide)
    return head + b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00", wide, rows


def encode_payloads(data: np.ndarray, starts: np.ndarray, notes: list[bytes]) -> list[bytes]:
    """A JPEG file for each payload ``data[starts[i]:starts[i + 1]]`` (a multiple of 64 bytes)."""
    if len(starts) < 2:
        return []
    heads, wide, rows = zip(*[_header(int(n) // BLOCK, note) for n, note in zip(np.diff(starts), notes, strict=True)], strict=True)
    wide, rows = np.array(wide), np.array(rows)
    full = np.concatenate([[0], np.cumsum(wide * rows * BLOCK)])  # with the last row filled up
    if full[-1] == starts[-1]:
        flat = data
    else:
        flat = np.zeros(full[-1], np.uint8)
        flat[np.arange(len(data)) + np.repeat(full[:-1] - starts[:-1], np.diff(starts))] = data
    per = np.repeat(wide, rows)  # blocks of each interval
    edge = np.concatenate([[0], np.cumsum(per)])  # in blocks
    dc = flat[::BLOCK].astype(np.int64) + 1
    before = np.concatenate([[0], dc[:-1]])
    before[edge[:-1]] = 0
    code, length = _AC_CODE[flat], _AC_LEN[flat]
    code[::BLOCK], length[::BLOCK] = _DC_CODE[dc - before + 256], _DC_LEN[dc - before + 256]
    bits = np.add.reduceat(length, edge[:-1] * BLOCK)
    # one more "symbol" fills each interval's last byte with ones
    place = edge[1:] * BLOCK
    code = np.insert(code, place, 0xFFFF)
    length = np.insert(length, place, -bits % 8)
    spread = np.unpackbits(code.astype(">u2").view(np.uint8)).reshape(-1, 16).astype(bool)
    packed = np.packbits(spread[np.arange(16) < length[:, None]])
    ends = np.cumsum((bits + 7) // 8)
    # a zero after each 0xFF, and a restart marker after each interval but a file's last
    last = np.zeros(len(per), bool)
    last[np.cumsum(rows) - 1] = True
    grow = (packed == 0xFF).astype(np.int64)
    grow[ends[~last] - 1] += 2
    at = np.arange(len(packed)) + np.cumsum(grow) - grow
    out = np.zeros(len(packed) + int(grow.sum()), np.uint8)
    out[at] = packed
    nth = np.arange(len(per)) - np.repeat(np.cumsum(rows) - rows, rows)
    mark = at[ends[~last] - 1] + 1 + (packed[ends[~last] - 1] == 0xFF)
    out[mark], out[mark + 1] = 0xFF, 0xD0 + nth[~last] % 8
    stop = at[ends[last] - 1] + 1 + (packed[ends[last] - 1] == 0xFF)
    begin = np.concatenate([[0], stop[:-1]])
    return [h + out[a:b].tobytes() + b"\xff\xd9" for h, a, b in zip(heads, begin, stop, strict=True)]


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quant: int
    dc: int = 0
    ac: int = 0


@dataclass
class Image:
    """What the segments of one file say."""

    width: int = 0
    height: int = 0
    parts: list[Component] = field(default_factory=list)
    note: bytes = b""
    quants: dict[int, int] = field(default_factory=dict)  # DC step by table
    codes: dict[int, bytes] = field(default_factory=dict)  # DHT body by class and table
    restart: int = 0
    start: int = 0  # of the scan's data
    error: str = ""


def parse_segments(data: bytes) -> Image:
    """Read markers up to the scan; what is not baseline is reported in ``error``."""
    im, at = Image(), 2
    if data[:2] != b"\xff\xd8":
        im.error = "no start of image"
        return im
    try:
        while True:
            if data[at] != 0xFF:
                raise ValueError("marker expected")
            while data[at + 1] == 0xFF:
                at += 1
            kind = data[at + 1]
            (size,) = struct.unpack_from(">H", data, at + 2)
            body = data[at + 4 : at + 2 + size]
            if len(body) < size - 2:
                raise ValueError("truncated segment")
            at += 2 + size
            if kind == 0xDB:
                while body:
                    wide = body[0] >> 4
                    im.quants[body[0] & 15] = body[1] << 8 | body[2] if wide else body[1]
                    body = body[129 if wide else 65 :]
            elif kind == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    im.codes[body[0]] = body[1:n]
                    body = body[n:]
            elif kind == 0xC0:
                depth, im.height, im.width, n = struct.unpack_from(">BHHB", body)
                if depth != 8 or not im.width or not im.height:
                    raise ValueError("unsupported frame")
                im.parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC1 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not baseline")
            elif kind == 0xDD:
                (im.restart,) = struct.unpack(">H", body)
            elif kind == 0xFE:
                im.note = body
            elif kind == 0xDA:
                if body[0] != len(im.parts) or not im.parts:
                    raise ValueError("several scans")
                by = {c.ident: c for c in im.parts}
                for i in range(body[0]):
                    c = by[body[1 + 2 * i]]
                    c.dc, c.ac = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
                if any(c.dc not in im.codes or 16 + c.ac not in im.codes or c.quant not in im.quants for c in im.parts):
                    raise ValueError("missing table")
                im.start = at
                return im
    except (IndexError, KeyError, ValueError, struct.error) as e:
        im.error = str(e) or type(e).__name__
        return im


_lookups: dict[bytes, np.ndarray] = {}


def lookup_table(body: bytes) -> np.ndarray:
    """For each 16 bits ahead: code length << 8 | symbol; 0 if no code fits."""
    if body not in _lookups:
        if len(_lookups) > 64:
            _lookups.clear()
        table, code, k = np.zeros(1 << 16, np.int32), 0, 16
        for n in range(1, 17):
            for _ in range(body[n - 1]):
                table[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | body[k]
                code, k = code + 1, k + 1
            code <<= 1
        _lookups[body] = table
    return _lookups[body]


def _unstuffed(files: list[bytes], images: list[Image]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Scan data without stuffing, and for each file the starts of its intervals and its end."""
    scans, bounds, total = [], [], 0
    for f, im in zip(files, images, strict=True):
        raw = np.frombuffer(f, np.uint8)[im.start :]
        ff = np.flatnonzero(raw[:-1] == 0xFF)
        after = raw[ff + 1]
        stop = ff[(after != 0) & ((after < 0xD0) | (after > 0xD7))]
        end = int(stop[0]) if len(stop) else len(raw)
        ff, after = ff[ff < end], after[: np.searchsorted(ff, end)]
        keep = np.ones(end, bool)
        keep[ff[ff + 1 < end] + 1] = False
        marks = ff[after != 0]
        keep[marks] = False
        kept = raw[:end][keep]
        cuts = marks - np.searchsorted(np.flatnonzero(~keep), marks)
        bounds.append(total + np.concatenate([[0], cuts, [len(kept)]]))
        scans += [kept, np.zeros(8, np.uint8)]
        total += len(kept) + 8
    return np.concatenate(scans), bounds


def decode_group(files: list[bytes], images: list[Image]) -> list[list[np.ndarray]]:
    """Quantised coefficients (blocks x 64, zigzag order) per component of files that
    share their layout and Huffman tables; blocks in scan order."""
    first = images[0]
    mcu = [k for k, c in enumerate(first.parts) for _ in range(c.h * c.v if len(first.parts) > 1 else 1)]
    luts = np.concatenate([lookup_table(first.codes[t]) for c in first.parts for t in (c.dc, 16 + c.ac)])
    data, bounds = _unstuffed(files, images)
    lane_bit, lane_block, lane_count, base = [], [], [], [0]
    for im, bound in zip(images, bounds, strict=True):
        top_h = max(c.h for c in im.parts) if len(im.parts) > 1 else 1
        top_v = max(c.v for c in im.parts) if len(im.parts) > 1 else 1
        units = -(-im.width // (8 * top_h)) * -(-im.height // (8 * top_v))
        each = im.restart or units
        if -(-units // each) != len(bound) - 1:
            raise ValueError("intervals do not match the frame")
        n = np.arange(len(bound) - 1)
        lane_bit.append(bound[:-1] * 8)
        lane_block.append(base[-1] + n * each * len(mcu))
        lane_count.append(np.minimum(each, units - n * each) * len(mcu))
        base.append(base[-1] + units * len(mcu))
    bit = np.concatenate(lane_bit).astype(np.int64)
    block = np.concatenate(lane_block).astype(np.int64)
    left = np.concatenate(lane_count).astype(np.int64)
    out = np.zeros(base[-1] * BLOCK, np.int16)
    wide = data.astype(np.int64)
    ahead = np.zeros(len(wide), np.int64)
    n = len(wide) - 5
    ahead[:n] = wide[:n] << 32 | wide[1 : n + 1] << 24 | wide[2 : n + 2] << 16 | wide[3 : n + 3] << 8 | wide[4 : n + 4]
    order = np.array(mcu)
    k = np.zeros(len(bit), np.int64)
    slot = np.zeros(len(bit), np.int64)  # block within its MCU
    pred = np.zeros((len(bit), len(first.parts)), np.int64)
    lane = np.arange(len(bit))
    single = len(mcu) == 1
    while len(bit):
        part = 0 if single else order[slot]
        dc = k == 0
        window = (ahead[bit >> 3] << (bit & 7)) & 0xFFFFFFFFFF  # 33 bits at least are valid
        entry = luts[((2 * part + 1 - dc) << 16) + (window >> 24)]
        if not entry.all():
            raise ValueError("bad Huffman code")
        length, symbol = entry >> 8, entry & 255
        size = symbol & 15
        extra = ((window << length) & 0xFFFFFFFFFF) >> (40 - size)
        value = np.where(extra >> np.maximum(size - 1, 0) != 0, extra, extra - (1 << size) + 1)
        value[size == 0] = 0
        bit += length + size
        if bit[-1] > 8 * len(data) or (bit > 8 * (len(data) - 5)).any():
            raise ValueError("scan ends early")
        spot = k + np.where(dc, 0, symbol >> 4)
        if single:
            np.add(pred[:, 0], value, out=pred[:, 0], where=dc)
            value = np.where(dc, pred[:, 0], value)
        else:
            rows = np.arange(len(bit))
            pred[rows, part] += np.where(dc, value, 0)
            value = np.where(dc, pred[rows, part], value)
        ended = ~dc & (symbol == 0)
        store = dc | (size > 0)
        if (spot[store] >= BLOCK).any():
            raise ValueError("run over the end of a block")
        if store.all():
            out[block * BLOCK + spot] = value
        else:
            out[(block * BLOCK + spot)[store]] = value[store]
        k = np.where(ended, BLOCK, spot + 1)
        done = k >= BLOCK
        if done.any():
            k[done] = 0
            block += done
            left -= done
            if not single:
                slot = np.where(done, (slot + 1) % len(mcu), slot)
            if not left.all():
                keep = left > 0
                bit, block, left, k, slot, pred, lane = (a[keep] for a in (bit, block, left, k, slot, pred, lane))
    blocks = out.reshape(-1, BLOCK)
    result = []
    for a, b in zip(base[:-1], base[1:], strict=True):
        own = blocks[a:b].reshape(-1, len(mcu), BLOCK)
        result.append([own[:, order == p].reshape(-1, BLOCK) for p in range(len(first.parts))])
    return result


def luminance_thumbnail(im: Image, blocks: np.ndarray) -> np.ndarray:
    """One 8-bit sample per 8 x 8 block of the first component, from DC alone."""
    c = im.parts[0]
    dc = blocks[:, 0].astype(np.float64) * im.quants[c.quant] / 8 + 128
    dc = np.clip(np.rint(dc), 0, 255).astype(np.uint8)
    h, v = (c.h, c.v) if len(im.parts) > 1 else (1, 1)
    top_h = max(p.h for p in im.parts) if len(im.parts) > 1 else 1
    across = -(-im.width // (8 * top_h))
    grid = dc.reshape(-1, across, v, h).transpose(0, 2, 1, 3).reshape(-1, across * h)
    tall = -(-(-(-im.height * v // max(p.v for p in im.parts)) if len(im.parts) > 1 else im.height) // 8)
    long = -(-(-(-im.width * h // top_h) if len(im.parts) > 1 else im.width) // 8)
    return grid[:tall, :long]


def average_hash(thumb: np.ndarray) -> str:
    """64 bits: cells of an 8 x 8 grid over the thumbnail that are lighter than the mean."""
    sums = np.pad(thumb.astype(np.int64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    y0, x0 = (np.arange(8) * n // 8 for n in thumb.shape)
    y1, x1 = (np.maximum(np.arange(1, 9) * n // 8, s + 1) for n, s in zip(thumb.shape, (y0, x0), strict=True))
    total = sums[np.ix_(y1, x1)] - sums[np.ix_(y0, x1)] - sums[np.ix_(y1, x0)] + sums[np.ix_(y0, x0)]
    cell = total / ((y1 - y0)[:, None] * (x1 - x0))
    return np.packbits(cell > cell.mean()).tobytes().hex()


def read_media(files: list[bytes]) -> list[dict]:
    """For each file: width, height, thumb_hash, note, coefficients, or error."""
    images = [parse_segments(f) for f in files]
    alike: dict[tuple, list[int]] = {}
    for i, im in enumerate(images):
        if not im.error:
            key = (tuple((c.h, c.v, c.dc, c.ac) for c in im.parts), tuple(sorted(im.codes.items())))
            alike.setdefault(key, []).append(i)
    out: list[dict] = [{"error": im.error} for im in images]

    def take(which: list[int]) -> None:
        try:
            decoded = decode_group([files[i] for i in which], [images[i] for i in which])
        except (ValueError, IndexError) as e:
            if len(which) == 1:
                out[which[0]] = {"error": str(e)}
            else:  # one bad file must not cost the others their result
                for i in which:
                    take([i])
            return
        for i, parts in zip(which, decoded, strict=True):
            im = images[i]
            thumb = luminance_thumbnail(im, parts[0])
            out[i] = {
                "error": "", "width": im.width, "height": im.height, "note": im.note,
                "thumb": thumb, "thumb_hash": average_hash(thumb), "coefficients": parts,
            }

    for which in alike.values():
        take(which)
    return out


MEDIA_SCHEMA = "width int, height int, thumb_hash string, thumbnail binary, error string"


def media_features(df: DataFrame, *, key: str, media: str) -> DataFrame:
    """Per row of any JPEG column: key, width, height, thumb_hash, thumbnail, error.

    The thumbnail's samples are in row order, ceil(width / 8) in a row for a component
    without subsampling. Null, empty, non-baseline and damaged files: null features and
    the reason in ``error``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1).fill_null(b"")
            for a, b in words.groups(column, GROUP_BYTES):
                rows = read_media(column.slice(a, b - a).to_pylist())
                good = [r if not r["error"] else None for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        *[pa.array([g and g[n] for g in good], t) for n, t in (("width", pa.int32()), ("height", pa.int32()), ("thumb_hash", pa.string()))],
                        pa.array([g and g["thumb"].tobytes() for g in good], pa.binary()),
                        pa.array([r["error"] or None for r in rows], pa.string()),
                    ],
                    names=[key, "width", "height", "thumb_hash", "thumbnail", "error"],
                )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(media).alias("_media")).mapInArrow(lean(run), f"`{key}` {kind}, {MEDIA_SCHEMA}")


def pack_texts(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, media): each text's UTF-8 bytes, padded with zeros to a positive multiple of
    64, as a JPEG whose comment holds 'bytes,padded bytes'. Null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in words.groups(batch.column(1), GROUP_BYTES):
                data, where = words.utf8(batch.column(1).slice(a, b - a))
                sizes = np.diff(where)
                padded = np.maximum(-(-sizes // BLOCK), 1) * BLOCK
                starts = np.concatenate([[0], np.cumsum(padded)])
                flat = np.zeros(starts[-1], np.uint8)
                flat[np.arange(len(data)) + np.repeat(starts[:-1] - where[:-1], sizes)] = data
                notes = [b"%d,%d" % (n, p) for n, p in zip(sizes, padded, strict=True)]
                files = encode_payloads(flat, starts, notes)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(files, pa.binary())], names=[key, "media"])

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).alias(text)).mapInArrow(lean(run), f"{key} long, media binary")


def payload_of(row: dict) -> tuple[int, bytes]:
    """Unpadded length and payload of a decoded file of :func:`pack_texts`."""
    size, padded = map(int, row["note"].split(b","))
    return size, (row["coefficients"][0].reshape(-1)[:padded] - 1).astype(np.uint8).tobytes()


def unpack_digests(media: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Decode the files of :func:`pack_texts` and digest what they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            for a, b in words.groups(column, GROUP_BYTES):
                files = column.slice(a, b - a).to_pylist()
                table: list[tuple] = []
                for f, row in zip(files, read_media(files), strict=True):
                    if row["error"]:
                        raise ValueError(f"stored media can't be read: {row['error']}")
                    size, payload = payload_of(row)
                    table.append((
                        size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(f),
                        hashlib.sha256(f).hexdigest(), f"{row['width']}x{row['height']}:{row['thumb_hash']}",
                    ))
                columns = [pa.array(c) for c in zip(*table, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], names=[key, *DIGESTS])

    kinds = ["long", "long", "string", "long", "long", "string", "string"]
    schema = ", ".join(f"{n} {t}" for n, t in zip(DIGESTS, kinds, strict=True))
    return media.select(key, "media").mapInArrow(lean(run), f"{key} long, {schema}")


DIGESTS = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
