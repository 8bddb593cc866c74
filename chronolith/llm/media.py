"""Media columns: lossless baseline-JPEG storage of byte payloads and features read back from it.

A payload (a multiple of 64 bytes) becomes one grey 8-bit baseline JPEG: each 64 bytes are the
64 quantized coefficients of one 8x8 block in zigzag order, with a quantization table of ones.
Baseline JPEG is lossy in its samples but exact in its coefficients, so the coefficient is the
format's unit in which the payload is kept. Restart markers after every ``RESTART`` blocks cut the scan
into segments that can be decoded apart.

One Huffman decoder reads all scans, whatever their tables, sampling, restart intervals and number
of scans: canonical codes become a table over 16-bit windows that tells length and symbol of the next
code, and all segments of a batch of files step from symbol to symbol together in NumPy arrays. When only
a few segments are left, they go on one by one over the same tables. Either way the work is linear in
the scan's bytes.

Defined results: null text is empty; an empty text is one block of zero bytes; equal texts give
equal rows. In ``jpeg_columns`` bytes that are no baseline JPEG, and broken ones, give null columns and
an ``error``; ``parse`` and ``coefficients`` raise ``ValueError``.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.frames import keyed_text, map_batches
from chronolith.llm.kernels import text_bytes

BLOCK = 64
_WIDEST = 8191  # blocks in a row: 65535 // 8
_FIELD = 9  # bits of every symbol that the encoder writes: code length + extra bits
RESTART = 4  # blocks between restart markers


def _category(value: np.ndarray) -> np.ndarray:
    """JPEG size category: bits of the magnitude."""
    out = np.zeros(value.shape, dtype=np.int64)
    left = np.abs(value)
    while left.any():
        out += left > 0
        left >>= 1
    return out


def _fields(values: np.ndarray) -> np.ndarray:
    """The 9-bit field (code, then extra bits) of each coefficient value."""
    size = _category(values)
    code = (1 << (_FIELD - size)) - 2  # size 8: 0, size 7: 10, size 6: 110, ...
    extra = np.where(values < 0, values + (1 << size) - 1, values)
    return ((code << size) | extra).astype(np.uint16)


_BYTES = np.arange(256)
_AC_VALUE = np.where(_BYTES < 128, _BYTES - 128, _BYTES - 127)  # never 0, so no run lengths
_AC_FIELD = _fields(_AC_VALUE)
_DC_FIELD = _fields(np.arange(-255, 256))
_AC_CODES = [(9 - size, size) for size in range(8, 0, -1)]
_DC_CODES = [(9 - size, size) for size in range(8, -1, -1)]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _dht(kind: int, codes: list[tuple[int, int]]) -> bytes:
    counts = [sum(length == n for length, _ in codes) for n in range(1, 17)]
    return _segment(0xC4, bytes([kind]) + bytes(counts) + bytes(symbol for _, symbol in codes))


_TABLES = _segment(0xDB, bytes([0]) + bytes([1] * 64)) + _dht(0x00, _DC_CODES) + _dht(0x10, _AC_CODES)


def _header(blocks: int) -> bytes:
    wide = min(blocks, _WIDEST)
    high = -(-blocks // wide)
    return b"\xff\xd8" + _segment(0xFE, b"payload=%d" % (blocks * BLOCK)) + _TABLES + _segment(0xC0, struct.pack(">BHHB3B", 8, high * 8, wide * 8, 1, 1, 0x11, 0)) + _segment(0xDD, struct.pack(">H", RESTART)) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def _pack9(fields: np.ndarray) -> np.ndarray:
    """Eight 9-bit fields to nine bytes, big-endian."""
    f = fields.reshape(-1, 8).astype(np.uint32)
    out = np.empty((len(f), 9), dtype=np.uint8)
    for i in range(9):
        # byte i holds bits 8i .. 8i+7, from fields (8i)//9 and the next one
        first, skip = divmod(8 * i, 9)
        pair = f[:, first] << 9 | (f[:, first + 1] if first < 7 else 0)
        out[:, i] = (pair >> (10 - skip)) & 0xFF
    return out.reshape(-1)


_RST = [bytes([0xFF, 0xD0 + i]) for i in range(8)]


def encode_payloads(payload: np.ndarray, blocks: np.ndarray) -> list[bytes]:
    """One JPEG for each run of ``blocks[i]`` 64-byte blocks of the buffer."""
    coef = payload.reshape(-1, BLOCK)
    first = np.cumsum(blocks) - blocks
    dc = coef[:, 0].astype(np.int64) - 128
    diff = np.diff(dc, prepend=0)
    fresh = (np.arange(len(coef)) - np.repeat(first, blocks)) % RESTART == 0  # prediction starts anew
    diff[fresh] = dc[fresh]
    fields = _AC_FIELD[coef]
    fields[:, 0] = _DC_FIELD[diff + 255]
    scan = _pack9(fields.reshape(-1)).tobytes()
    out = []
    pad = _pack9(np.r_[_DC_FIELD[255], np.full(63, _AC_FIELD[0])].astype(np.uint16)).tobytes()
    step = 72 * RESTART
    for at, n in zip(first.tolist(), blocks.tolist(), strict=True):
        body = scan[at * 72 : (at + n) * 72] + pad * (-n % min(n, _WIDEST))
        parts = [_header(n)]
        for i in range(0, len(body), step):
            if i:
                parts.append(_RST[(i // step - 1) & 7])
            parts.append(body[i : i + step].replace(b"\xff", b"\xff\x00"))
        out.append(b"".join([*parts, b"\xff\xd9"]))
    return out


class Component(NamedTuple):
    ident: int
    h: int
    v: int
    quant: int


class Jpeg(NamedTuple):
    """Parsed markers of a baseline file: frame, tables, comments, and the scan that holds the first component."""

    width: int
    height: int
    components: list[Component]
    quant: dict[int, np.ndarray]
    huffman: dict[int, tuple[tuple[int, int], ...]]  # class << 4 | id -> (code length, symbol)
    scan: list[tuple[int, int, int]]  # component id, DC table, AC table
    restart: int
    data: bytes
    comment: bytes


def parse(media: bytes) -> Jpeg:
    """Read the markers up to the scan of the first component and cut out that scan's bytes (still stuffed)."""
    try:
        return _parse(media)
    except (struct.error, IndexError) as error:
        raise ValueError("the file is cut off or a marker is malformed") from error


_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def _parse(media: bytes) -> Jpeg:
    if media[:2] != b"\xff\xd8":
        raise ValueError("no JPEG: SOI is missing")
    at, quant, huffman, frame, restart, comment = 2, {}, {}, None, 0, b""
    while at + 4 <= len(media):
        if media[at] != 0xFF:
            raise ValueError(f"no marker at byte {at}")
        marker = media[at + 1]
        if marker == 0xFF:  # fill byte
            at += 1
            continue
        (size,) = struct.unpack_from(">H", media, at + 2)
        body = media[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], dtype=">u2" if wide else np.uint8).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                counts = body[1:17]
                symbols = body[17 : 17 + sum(counts)]
                lengths = [n + 1 for n, c in enumerate(counts) for _ in range(c)]
                if len(counts) < 16 or len(symbols) < len(lengths):
                    raise ValueError("a Huffman table is cut off")
                huffman[body[0]] = tuple(zip(lengths, symbols, strict=True))
                body = body[17 + sum(counts) :]
        elif marker == 0xC0:
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            frame = width, height, [Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * n, 3)]
            if bits != 8 or not (width and height and n) or not all(c.h and c.v for c in frame[2]):
                raise ValueError("no 8-bit frame of known size")
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError(f"not baseline: SOF marker {marker:#x}")
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif marker == 0xFE:
            comment = body
        elif marker == 0xDA:
            if frame is None:
                raise ValueError("a scan before its frame")
            scan = [(body[i], body[i + 1] >> 4, body[i + 1] & 15) for i in range(1, 1 + 2 * body[0], 2)]
            end = _MARKER.search(media, at)
            if end is None:
                raise ValueError("the scan has no end")
            if any(ident == frame[2][0].ident for ident, _, _ in scan):
                return Jpeg(*frame, quant, huffman, scan, restart, media[at : end.start()], comment)
            at = end.start()  # a scan of other components
    raise ValueError("no scan of the first component")


#: Fields of a table entry: bits taken, coefficients gone over, then flags, then the coefficient's value.
_STEP, _STORE, _LONG, _BAD, _END = 5, 1 << 12, 1 << 13, 1 << 14, 1 << 15


@lru_cache(maxsize=64)
def _windows(codes: tuple[tuple[int, int], ...], dc: bool) -> np.ndarray:
    """What every 16-bit window begins with: a code and its extra bits, as an entry of the fields above.

    Where code and extra bits are longer than the window (``_LONG``), the entry holds the code's length and, as
    value, how many extra bits follow.
    """
    out, code, last = np.full(1 << 16, _BAD | BLOCK << _STEP, dtype=np.int32), 0, 0
    for length, symbol in codes:
        code <<= length - last
        last = length
        if code >> length:
            raise ValueError("a Huffman table has too many codes")
        run, size = (0, symbol) if dc else divmod(symbol, 16)
        low, high = code << (16 - length), (code + 1) << (16 - length)
        code += 1
        if size > 15:  # no such DC category
            continue
        if not dc and not size:  # end of block, or a run of zeros
            out[low:high] = length | (16 << _STEP if run == 15 else BLOCK << _STEP | _END)
        elif length + size > 16:
            out[low:high] = length | (run + 1) << _STEP | _STORE | _LONG | size << 16
        else:
            raw = np.arange(low, high) >> (16 - length - size) & ((1 << size) - 1)
            value = np.where(raw >> max(size - 1, 0) > 0, raw, raw - (1 << size) + 1)
            out[low:high] = length + size | (run + 1) << _STEP | _STORE | value << 16
    return out


class _Grid(NamedTuple):
    """How the scan's blocks lie: units (MCUs), and for each block of a unit its component, tables and place."""

    units_x: int
    units_y: int
    wide: int
    high: int
    blocks: list[tuple[int, int, int, int, int]]  # component's number in the scan, DC table, AC table, row, column (-1: not luminance)


def _grid(jpeg: Jpeg) -> _Grid:
    luma = jpeg.components[0]
    most_h, most_v = max(c.h for c in jpeg.components), max(c.v for c in jpeg.components)
    if len(jpeg.scan) == 1:
        across, down = -(-jpeg.width * luma.h // most_h), -(-jpeg.height * luma.v // most_v)
        return _Grid(-(-across // 8), -(-down // 8), 1, 1, [(0, jpeg.scan[0][1], 0x10 | jpeg.scan[0][2], 0, 0)])
    known = {c.ident: c for c in jpeg.components}
    blocks = []
    for number, (ident, dc, ac) in enumerate(jpeg.scan):
        if ident not in known:
            raise ValueError("a scan of an unknown component")
        for v in range(known[ident].v):
            for h in range(known[ident].h):
                blocks.append((number, dc, 0x10 | ac, v, h) if ident == luma.ident else (number, dc, 0x10 | ac, -1, -1))
    return _Grid(-(-jpeg.width // (8 * most_h)), -(-jpeg.height // (8 * most_v)), luma.h, luma.v, blocks)


_RESTARTS = re.compile(rb"\xff[\xd0-\xd7]")
#: Segments up to which it is cheaper to go on one by one.
FEW = 12


def decode(files: list[Jpeg], full: bool = True) -> list[np.ndarray | ValueError]:
    """Quantized zigzag coefficients (blocks, 64) of each file's first component, row by row of its grid, or its error.

    Without ``full`` only the first column, the DC coefficients, is kept: (blocks, 1).
    """
    keep = BLOCK if full else 1
    numbers: dict[tuple, int] = {}
    out: list = []
    chunks, lanes = [], []  # lanes: file, first unit, units, byte at which the segment begins
    layouts, size, base = [], 0, 0
    for number, jpeg in enumerate(files):
        try:
            grid = _grid(jpeg)
            units = grid.units_x * grid.units_y
            parts = _RESTARTS.split(jpeg.data)
            per = jpeg.restart or units
            if len(parts) < -(-units // per) or 2 * units * len(grid.blocks) > 8 * len(jpeg.data):
                raise ValueError("the scan ends early")
            layout = [(c, *(numbers.setdefault((jpeg.huffman[t], t < 16), len(numbers)) for t in (dc, ac)), v, h) for c, dc, ac, v, h in grid.blocks]
        except KeyError:
            out.append(ValueError("a Huffman table is missing"))
            layouts.append(None)
            continue
        except ValueError as error:
            out.append(error)
            layouts.append(None)
            continue
        for i in range(-(-units // per)):
            chunk = parts[i].replace(b"\xff\x00", b"\xff")
            lanes.append((number, i * per, min(per, units - i * per), size, len(chunk)))
            chunks += (chunk, bytes(8))
            size += len(chunk) + 8
        layouts.append((grid, layout, base))
        out.append((base, base + units * grid.wide * grid.high))
        base = out[-1][1]
    values = np.zeros((base, keep), np.int32)
    try:
        tables = np.stack([_windows(*codes) for codes in numbers]) if numbers else np.zeros((0, 1 << 16), np.int32)
    except ValueError as error:  # rare: find out whose table it is
        return [decode([f], full)[0] for f in files] if len(files) > 1 else [error]
    failed = _walk(lanes, layouts, np.frombuffer(b"".join(chunks), np.uint8), tables, values)
    return [x if isinstance(x, ValueError) else ValueError("the scan is broken") if i in failed else values[x[0] : x[1]] for i, x in enumerate(out)]


def _walk(lanes: list, layouts: list, data: np.ndarray, tables: np.ndarray, values: np.ndarray) -> set[int]:
    """Decode all segments into ``values``; the files of broken ones."""
    if not lanes:
        return set()
    keep, store = values.shape[1], values.reshape(-1)
    data = np.r_[data, np.zeros(320, np.uint8)].astype(np.int32)  # no block goes further beyond its segment
    window = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    flat = tables.reshape(-1)
    file, first, units, start, size = (np.array(c, np.int64) for c in zip(*lanes, strict=True))
    widest = max(len(layouts[f][1]) for f in set(file.tolist()))
    deepest = 1 + max(b[0] for f in set(file.tolist()) for b in layouts[f][1])
    # for each block of a file's unit: component, and where its DC and its AC table begin
    shape = np.zeros((len(layouts), widest, 3), np.int64)
    count = np.ones(len(layouts), np.int64)
    for f, layout in enumerate(layouts):
        if layout is not None:
            count[f] = len(layout[1])
            shape[f, : count[f]] = [(b[0], b[1] << 16, b[2] << 16) for b in layout[1]]
    place = _places(lanes, layouts)  # rows of ``values`` of all blocks of all lanes, in order; -1: not kept
    total = units * count[file]
    row = np.cumsum(total) - total
    pos, end = start * 8, (start + size) * 8
    failed: set[int] = set()
    live, block, k = np.arange(len(lanes)), np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64)
    last, wrong = np.zeros((len(lanes), deepest), np.int64), np.zeros(len(lanes), bool)
    begin = np.arange(len(lanes))  # lanes that are at a block's beginning
    table, to = np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64)
    while len(live) > FEW:
        if len(begin):
            kind = shape[file[live[begin]], block[begin] % count[file[live[begin]]]]
            table[begin] = kind[:, 1]
            to[begin] = place[row[begin] + block[begin]]
        entry = flat[table + (window[pos >> 3] >> (8 - (pos & 7)) & 0xFFFF)]
        value = entry >> 16
        pos += entry & 31
        if (entry & _LONG).any():
            _longer(entry, value, pos, data)
        if len(begin):
            last[begin, kind[:, 0]] += value[begin]
            value[begin] = last[begin, kind[:, 0]]
            table[begin] = kind[:, 2]
        k += entry >> _STEP & 127
        over = k >= BLOCK
        done = over.any()
        if keep == BLOCK or len(begin):
            put = (entry & _STORE > 0) & (to >= 0)
            if done or keep < BLOCK:
                put &= k <= keep
            if put.all():
                store[to * keep + k - 1] = value
            else:
                store[(to * keep + k - 1)[put]] = value[put]
        begin = begin[:0]
        if done:
            # a block may end at its last coefficient or by an end-of-block code, and within its segment
            wrong |= over & ((entry & _BAD > 0) | ((k > BLOCK) & (entry & _END == 0)) | (pos > end))
            k[over] = 0
            block += over
            stay = ~wrong & (block < total)
            if not stay.all():
                failed.update(file[live[wrong]].tolist())
                live, pos, end, block, k, last, row, total, table, to, wrong, over = (x[stay] for x in (live, pos, end, block, k, last, row, total, table, to, wrong, over))
            begin = np.flatnonzero(over)
    for i, lane in enumerate(live.tolist()):
        f = int(file[lane])
        mine = place[row[i] : row[i] + total[i]].tolist()
        if f not in failed and not _walk_one(data, window, flat, values, mine, layouts[f][1], int(pos[i]), int(end[i]), int(block[i]), int(k[i]), last[i].tolist()):
            failed.add(f)
    return failed


def _longer(entry: np.ndarray, value: np.ndarray, pos: np.ndarray, data: np.ndarray) -> None:
    """Read the extra bits that a window has no room for, in place."""
    mine = np.flatnonzero(entry & _LONG)
    size, at = value[mine], pos[mine] >> 3
    bits = data[at] << 16 | data[at + 1] << 8 | data[at + 2]
    raw = bits >> (24 - (pos[mine] & 7) - size) & ((1 << size) - 1)
    value[mine] = np.where(raw >> (size - 1) > 0, raw, raw - (1 << size) + 1)
    pos[mine] += size


def _walk_one(data, window, flat, values, place: list[int], layout: list, pos: int, end: int, block: int, k: int, last: list[int]) -> bool:
    """The rest of one segment, code by code over the same windows and tables; False if it is broken."""
    keep = values.shape[1]
    while block < len(place):
        component, dc, ac = layout[block % len(layout)][:3]
        while k < BLOCK:
            entry = int(flat[(ac if k else dc) << 16 | int(window[pos >> 3]) >> (8 - (pos & 7)) & 0xFFFF])
            value = entry >> 16
            pos += entry & 31
            if entry & _LONG:
                size, at = value, pos >> 3
                raw = (int(data[at]) << 16 | int(data[at + 1]) << 8 | int(data[at + 2])) >> (24 - (pos & 7) - size) & ((1 << size) - 1)
                value = raw if raw >> (size - 1) else raw - (1 << size) + 1
                pos += size
            if not k:
                last[component] += value
                value = last[component]
            k += entry >> _STEP & 127
            if entry & _STORE and k <= keep and place[block] >= 0:
                values[place[block], k - 1] = value
            if entry & _BAD or k > BLOCK and not entry & _END or pos > end:
                return False
        block, k = block + 1, 0
    return True


def _places(lanes: list, layouts: list) -> np.ndarray:
    out = []
    for f, first, units, _, _ in lanes:
        grid, layout, base = layouts[f]
        if len(layout) == 1:
            out.append(np.arange(base + first, base + first + units))
            continue
        y, x = np.divmod(np.arange(first, first + units), grid.units_x)
        v, h = (np.array([b[i] for b in layout]) for i in (3, 4))
        rows = base + (y[:, None] * grid.high + v) * (grid.units_x * grid.wide) + x[:, None] * grid.wide + h
        out.append(np.where(v >= 0, rows, -1).reshape(-1))
    return np.concatenate(out)


def coefficients(jpeg: Jpeg, full: bool = True) -> np.ndarray:
    """One file's coefficients (see ``decode``); raises what is wrong with it."""
    (found,) = decode([jpeg], full)
    if isinstance(found, ValueError):
        raise found
    return found


def thumbnail(jpeg: Jpeg, coef: np.ndarray) -> np.ndarray:
    """DC-only luminance: one 8-bit sample for each block."""
    table = jpeg.quant.get(jpeg.components[0].quant)
    if table is None or not len(table):
        raise ValueError("the quantization table is missing")
    grid = _grid(jpeg)
    level = (coef[:, 0].astype(np.int64) * int(table[0])) // 8 + 128
    return np.clip(level, 0, 255).astype(np.uint8).reshape(-1, grid.units_x * grid.wide)


def payload_of(jpeg: Jpeg, coef: np.ndarray) -> bytes:
    """The payload that a stored file keeps in its coefficients."""
    data = np.where(coef < 0, coef + 128, coef + 127)
    data[:, 0] = coef[:, 0] + 128
    payload = data.astype(np.uint8).tobytes()
    return payload[: int(jpeg.comment[8:])] if jpeg.comment.startswith(b"payload=") else payload


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int"


def _padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, each followed by zeros up to a positive multiple of 64."""
    size = np.diff(offsets)
    blocks = np.maximum(1, -(-size // BLOCK))
    start = (np.cumsum(blocks) - blocks) * BLOCK
    payload = np.zeros(int(blocks.sum()) * BLOCK, dtype=np.uint8)
    payload[np.arange(len(data)) + np.repeat(start - offsets[:-1], size)] = data
    return payload, blocks, size


def _features(batch: pa.RecordBatch) -> dict:
    payload, blocks, size = _padded(*text_bytes(batch.column("text")))
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")
    out = {name: [] for name in names}
    stored = encode_payloads(payload, blocks)
    files = [parse(media) for media in stored]
    for media, jpeg, coef in zip(stored, files, decode(files), strict=True):
        back, thumb = payload_of(jpeg, coef), thumbnail(jpeg, coef)
        level = thumb.reshape(-1).astype(np.float64)
        cut = np.arange(64) * len(level) // 64
        bright = np.add.reduceat(level, cut) / np.maximum(np.diff(np.append(cut, len(level))), 1)
        average = int.from_bytes(np.packbits(bright >= bright.mean()).tobytes(), "big")
        feature = f"{jpeg.width}x{jpeg.height}:{hashlib.sha256(thumb.tobytes()).hexdigest()[:16]}:{average:016x}"
        row = (len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature, jpeg.width, jpeg.height)
        for name, value in zip(names, row, strict=True):
            out[name].append(value)
    return {"doc_id": batch.column("doc_id"), "n_bytes": size, **out}


def _encode(batch: pa.RecordBatch) -> dict:
    payload, blocks, size = _padded(*text_bytes(batch.column("text")))
    return {"doc_id": batch.column("doc_id"), "n_bytes": size, "media": encode_payloads(payload, blocks)}


def store_media(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text's payload as a JPEG file in a binary column."""
    return map_batches(keyed_text(documents), _encode, "doc_id long, n_bytes long, media binary")


def jpeg_columns(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(doc_id, width, height, thumb_sha256, thumbnail, error) of any baseline JPEG; nulls stay null, and broken files have
    null columns and an error."""

    def kernel(batch: pa.RecordBatch) -> dict:
        out = {"doc_id": batch.column(0), "width": [], "height": [], "thumb_sha256": [], "thumbnail": [], "error": []}
        files, errors = {}, {}
        for i, value in enumerate(batch.column(1).to_pylist()):
            try:
                if value is not None:
                    files[i] = parse(value)
            except ValueError as error:
                errors[i] = str(error)
        for i, coef in zip(list(files), decode(list(files.values()), full=False), strict=True):
            try:
                if isinstance(coef, ValueError):
                    raise coef
                files[i] = files[i], thumbnail(files[i], coef)
            except ValueError as error:
                errors[i] = str(error)
                del files[i]
        for i in range(batch.num_rows):
            jpeg, thumb = files.get(i, (None, None))
            row = (None,) * 4 if jpeg is None else (jpeg.width, jpeg.height, hashlib.sha256(thumb.tobytes()).hexdigest(), thumb.tobytes())
            for name, value in zip(("width", "height", "thumb_sha256", "thumbnail", "error"), (*row, errors.get(i)), strict=True):
                out[name].append(value)
        return out

    two = media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("text"))
    return map_batches(two, kernel, "doc_id long, width int, height int, thumb_sha256 string, thumbnail binary, error string")


def media_features(documents: DataFrame) -> DataFrame:
    """Store every text as a JPEG, read the stored bytes back and describe them, in one pass over the scan."""
    return map_batches(keyed_text(documents), _features, SCHEMA)
