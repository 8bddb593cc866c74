"""Secret scans with a recursive decoding worklist.

Every text is scanned for base patterns. The text is then the first item of a worklist: an item's
URL escapes, ``\\uXXXX`` escapes (both level by level, by one stack that reads nested ones in linear time; beyond
the first levels only the stretches that a level changes are layers, up to where no match can reach), base64 runs and zlib or gzip data are unwrapped into new layers,
each layer is scanned in turn and unwrapped further, until nothing new appears. Base64 may be wrapped:
its lines are decoded each alone and joined; and other letters may be glued to it by a separator of its
alphabet: a run is also read from behind its separators. Compressed data is looked for in decoded base64,
behind URL escapes and in the characters of any layer, and is unpacked in pieces of bounded size. Decoded bytes are
read as UTF-8, as UTF-16 where they hold zero bytes or a byte order mark, and as Latin-1 where they are not UTF-8. A layer that was
seen before in the same text (a cycle) is not entered again. Each character of a layer knows the
range of the text it came from, so a match in any layer becomes a span of the text: exact for
character escapes, the whole encoded run for base64 and compressed data.

Base patterns, leftmost and non-overlapping per kind, offsets in code points:

* assign: a keyword, an optional quote, ``:`` or ``=``, and a value of 6 or more characters;
* access: ``AKIA`` and upper-case letters or digits, 20 or more characters in all;
* hex: 24 or more lower-case hexadecimal digits.

Defined results: null text is empty and has no spans; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from array import array
from bisect import bisect_left
from itertools import chain
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from chronolith.llm.frames import keyed_text, map_batches

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_ONE_ESCAPE = re.compile(r"%[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}")
_OPENING = re.compile(r"%25|%5[Cc]|\\u0025|\\u005[Cc]")
#: Where escapes can nest: an escape consists of these characters, however it was itself escaped.
_NEST = re.compile(r"[%\\][%\\u0-9A-Fa-f]*")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Base64 over several lines: all full lines but the last are of one length, text may stand before and after them.
_WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)+={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")

Span = tuple[int, int, int]  # start, kind's place in KINDS, end


def scan(text: str) -> list[Span]:
    """Base spans of one layer."""
    found: list[Span] = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


class Layer(NamedTuple):
    """Decoded text and, for each character, the range of the original it came from (None: itself, a number: one range for all)."""

    text: str
    starts: array | int | None
    ends: array | int | None
    depth: int
    escaped: bool = True  # escapes are still to be unwrapped
    known: int | None = None  # no text, but a span of this kind over the range

    def origin(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        return (self.starts, self.ends) if isinstance(self.starts, int) else (self.starts[start], self.ends[end - 1])

    def spans(self) -> list[Span]:
        """Spans of the text that the layer came from."""
        if self.known is not None:
            return [(self.starts, self.known, self.ends)]
        return [(a, kind, b) for start, kind, end in scan(self.text) for a, b in (self.origin(start, end),)]


#: A character or what an escape stands for, as (value, start, end, height, parts): the value is a character, a byte of 128
#: and more (URL) or half of a pair (Unicode). Plain tuples, since deep nests have many.
Node = tuple[str | int, int, int, int, tuple]

_HEX_DIGITS = frozenset("0123456789abcdefABCDEF")
_OPENERS = frozenset("%\\")
_OF_ESCAPES = _HEX_DIGITS | _OPENERS | {"u"}
#: So many levels of a nest are layers of the whole text, and so is the last; those between are layers of stretches.
WHOLE = 8


def _meaning(digits: str, url: bool) -> str | int:
    code = int(digits, 16)
    return code if 0xD800 <= code < 0xE000 or url and code >= 0x80 else chr(code)


def _flat_nodes(text: str, start: int, end: int):
    """The same as ``_nodes`` where no escape is part of another."""
    last = start
    for m in _ONE_ESCAPE.finditer(text, start, end):
        for i in range(last, m.start()):
            yield text[i], i, i + 1, 0, ()
        url = m.group()[0] == "%"
        yield _meaning(m.group()[1 if url else 2 :], url), m.start(), m.end(), 1, ()
        last = m.end()
    for i in range(last, end):
        yield text[i], i, i + 1, 0, ()


def _nodes(text: str, start: int, end: int):
    """Escapes of a stretch with all that nests in them, by one stack: what an escape stands for may be part of the next."""
    escapes = len(_ONE_ESCAPE.findall(text, start, end))
    if escapes == text.count("%", start, end) + text.count("\\", start, end) and not _OPENING.search(text, start, end):
        yield from _flat_nodes(text, start, end)
        return
    stack: list[Node] = []
    opened = 0
    for i in range(start, end):
        value = text[i]
        stack.append((value, i, i + 1, 0, ()))
        opened += value in _OPENERS
        while value in _HEX_DIGITS:
            if len(stack) > 2 and stack[-3][0] == "%" and stack[-2][0] in _HEX_DIGITS:
                size, digits = 3, 2
            elif len(stack) > 5 and stack[-6][0] == "\\" and stack[-5][0] == "u" and all(n[0] in _HEX_DIGITS for n in stack[-4:]):
                size, digits = 6, 4
            else:
                break
            parts = tuple(stack[-size:])
            del stack[-size:]
            value = _meaning("".join([n[0] for n in parts[-digits:]]), size == 3)
            stack.append((value, parts[0][1], parts[-1][2], 1 + max([n[3] for n in parts]), parts))
            opened += (value in _OPENERS) - 1
        if not opened or value not in _OF_ESCAPES:  # nothing to the left can grow any more
            yield from stack
            stack.clear()
            opened = 0
    yield from stack


def _at_level(node: Node, level: int):
    work = [node]
    while work:
        value, start, end, height, parts = work.pop()
        if height <= level:
            yield value, start, end
        else:
            work.extend(reversed(parts))


def _first_character(held: list[tuple[int, int, int]]) -> tuple[str, int]:
    """The character that bytes or halves begin with, and how many of them it takes."""
    value = held[0][0]
    if value >= 0xD800:
        pair = value < 0xDC00 and len(held) > 1 and 0xDC00 <= held[1][0] < 0xE000
        return (chr(0x10000 + ((value - 0xD800) << 10) + held[1][0] - 0xDC00), 2) if pair else ("\ufffd", 1)
    size = 2 if value < 0xE0 else 3 if value < 0xF0 else 4
    raw = [v for v, _, _ in held[:size]]
    try:
        return (bytes(raw).decode(), size) if len(raw) == size and max(raw) < 0x100 else (chr(value), 1)
    except UnicodeDecodeError:
        return chr(value), 1


def _characters(items):
    """(character, start, end) of values: bytes are read as UTF-8, else as Latin-1, and halves of a pair joined."""
    held: list[tuple[int, int, int]] = []

    def first():
        char, size = _first_character(held)
        out = char, held[0][1], held[size - 1][2]
        del held[:size]
        return out

    for item in items:
        if isinstance(item[0], int):
            held.append(item)
            if len(held) == 4:
                yield first()
        else:
            while held:
                yield first()
            yield item
    while held:
        yield first()


def _unescaped(layer: Layer, level: int, first: int = 0, behind: int | None = None) -> tuple[Layer | None, int]:
    """The layer, or a stretch of it, with the innermost ``level`` levels of URL and Unicode escapes unwrapped, and how many levels there are."""
    behind = len(layer.text) if behind is None else behind
    text, starts, ends, last, most = [], array("q"), array("q"), first, 0
    whole = isinstance(layer.starts, int)

    def keep(a: int, b: int) -> None:
        text.append(layer.text[a:b])
        if not whole:
            starts.extend(range(a, b) if layer.starts is None else layer.starts[a:b])
            ends.extend(range(a + 1, b + 1) if layer.ends is None else layer.ends[a:b])

    def values(a: int, b: int):
        nonlocal most
        for node in _nodes(layer.text, a, b):
            most = max(most, node[3])
            yield from _at_level(node, level)

    for m in _NEST.finditer(layer.text, first, behind):
        if not _ONE_ESCAPE.search(layer.text, m.start(), m.end()):
            continue
        keep(last, m.start())
        for char, lo, hi in _characters(values(m.start(), m.end())):
            text.append(char)
            if not whole:
                a, b = layer.origin(lo, hi)
                starts.append(a)
                ends.append(b)
        last = m.end()
    if not most:
        return None, 0
    keep(last, behind)
    where = (layer.starts, layer.ends) if whole else (starts, ends)
    return Layer("".join(text), *where, layer.depth + level, False), most


#: Bytes of unpacked data that make one layer; the next one repeats the last ``_OVERLAP`` of them.
UNPACKED = 1 << 24
_OVERLAP = 1 << 12
_STREAM = re.compile(rb"\x78[\x01\x5e\x9c\xda]|\x1f\x8b\x08")


def _unpacked(raw: bytes):
    """(whether it begins the data, bytes) of each zlib or gzip stream in the bytes, in bounded pieces."""
    at = 0
    while m := _STREAM.search(raw, at):
        stream, last, at = zlib.decompressobj(wbits=47), b"", m.end()
        left, got = raw[m.start() :], False
        try:
            while left and not stream.eof:
                piece = last + stream.decompress(left, UNPACKED)
                left = stream.unconsumed_tail
                if len(piece) > len(last):
                    got = True
                    yield m.start() == 0, piece
                last = piece[-_OVERLAP:] if left else b""
        except zlib.error:
            pass
        if got and stream.eof:
            at = len(raw) - len(stream.unused_data)


def _readings(raw: bytes) -> list[str]:
    """The texts that bytes may stand for."""
    try:
        out = [raw.decode()]
    except UnicodeDecodeError:
        out = [raw.decode("latin-1")]
    if b"\0" in raw or raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        out += [raw[: len(raw) // 2 * 2].decode(name, "replace") for name in ("utf-16-le", "utf-16-be")]
    return [text for text in out if text]


def _wrapped_runs(text: str):
    """(start, end, joined lines) of base64 over several lines: each stretch of lines of one length with and
    without the lines next to it, and all lines of the block."""
    for m in _WRAPPED.finditer(text):
        lines = [(x.start(), x.end()) for x in _LINE.finditer(text, m.start(), m.end())]
        wanted, first = {(0, len(lines))}, 0
        while first < len(lines):
            last = first + 1
            while last < len(lines) and lines[last][1] - lines[last][0] == lines[first][1] - lines[first][0]:
                last += 1
            wanted |= {(a, b) for a in (first, max(first - 1, 0)) for b in (last, min(last + 1, len(lines))) if b - a > 1}
            first = last
        for a, b in sorted(wanted):
            yield lines[a][0], lines[b - 1][1], "".join(text[i:j] for i, j in lines[a:b])


def _digest(data: bytes | str) -> bytes:
    return hashlib.blake2b(data.encode("utf-8", "surrogatepass") if isinstance(data, str) else data, digest_size=16).digest()


def _texts(raw: bytes):
    """What bytes say: as they are, and behind any compression in them, each bytes once. One piece of each nested stream is held."""
    seen, work = {_digest(raw)}, [[raw, _unpacked(raw), False]]
    while work:
        now = work[-1]
        for begins, inner in now[1]:
            now[2] |= begins
            key = _digest(inner)
            if key not in seen:
                seen.add(key)
                work.append([inner, _unpacked(inner), False])
                break
        else:
            work.pop()
            if not now[2]:
                yield from _readings(now[0])


_SEPARATOR = re.compile(r"[/+_-]")


def _decoded_run(run: str):
    """Texts behind a base64 run: from its beginning, and from behind its separators (four alignments are all there are)."""
    body = run.rstrip("=")
    starts = {0: 0}
    for m in _SEPARATOR.finditer(body):
        if len(starts) == 4:
            break
        starts.setdefault(m.end() % 4, m.end())
    for start in starts.values():
        piece = body[start:].replace("-", "+").replace("_", "/")
        piece = piece[: len(piece) - (len(piece) % 4 == 1)]
        if len(piece) >= 16 or not start and piece:
            yield from _texts(base64.b64decode(piece + "=" * (-len(piece) % 4)))


#: URL-escaped compressed data: from a stream's first bytes on, escapes and characters that need none.
_ESCAPED = re.compile(r"(?:x%(?:01|5[Ee]|9[Cc]|[Dd][Aa])|%78%(?:01|5[Ee]|9[Cc]|[Dd][Aa])|%1[Ff]%8[Bb]%08)(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~/+-])*")
_ESCAPE = re.compile(rb"%([0-9A-Fa-f]{2})")
#: Compressed data whose bytes are characters, as other layers may leave it.
_CHARACTERS = re.compile("(?:x[\x01\x5e\x9c\xda]|\x1f\x8b\x08)[\x00-\xff]+")


def _streams(text: str):
    """(start, end, text behind it) of compressed data in a layer's own characters or URL escapes."""
    for m in _ESCAPED.finditer(text) if "%" in text else ():
        raw = _ESCAPE.sub(lambda x: bytes([int(x[1], 16)]), m.group().replace("+", " ").encode())
        for inner in _behind(raw):
            yield m.start(), m.end(), inner
    for m in _CHARACTERS.finditer(text):
        for inner in _behind(m.group().encode("latin-1")):
            yield m.start(), m.end(), inner


def _behind(raw: bytes):
    for _, inner in _unpacked(raw):
        yield from _texts(inner)


#: What no match of a base pattern, base64 or URL escapes crosses: a character of none of them, or a blank between words.
_BARRIER = re.compile(r"""[^A-Za-z0-9+/_.=~"':%\\\r\n\t\x20-]|(?<![\x20:=])\x20(?![\x20:=])""")
#: Where a stretch needs all patterns, and not only the runs of digits and of base64 that a change touches.
_LOUD = re.compile(r"password|passwd|secret|token|api_?key|AKIA|\n|(?:x|%78)%(?:01|5E|9C|DA)|%1F%8B", re.IGNORECASE)
#: Compressed data in characters reaches as far as these go, over any barrier.
_FAR = re.compile("x[\x01\x5e\x9c\xda]|\x1f\x8b\x08")
#: Bytes without any of these say nothing, and nothing does that they end with: no pattern, no layer below. Two zeros: UTF-16 has no two plain characters without.
_SAYING = re.compile(rb"(?s:\0.\0)|x(?:[\x01\x5e\x9c\xda]|\xc2\x9c|\xc3\x9a)|\x1f(?:\xc2)?\x8b\x08|%[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|[A-Za-z0-9+/_-]{16}|(?i:password|passwd|secret|token|api_?key)")
_DIGITS, _LETTERS = re.compile(r"[0-9a-f]*"), re.compile(r"[A-Za-z0-9+/_-]*")
_NEAR = 12  # characters around a change in which it can make one of the marks above


class _Silence:
    """Base64 runs of which no level has anything to tell, by where they end: what a run ends with says no more than it does."""

    def __init__(self):
        self.known: dict[tuple[int, int], int] = {}  # by end and alignment, the longest that says nothing
        self.asked: dict[tuple[int, int], int] = {}  # where that failed, the length to ask again from

    def of(self, run: str, end: int) -> bool:
        size = len(run)
        key = end, size % 4
        if size <= self.known.get(key, 0):
            return True
        if size > self.asked.get(key, size):
            return False
        parted = _SEPARATOR.search(run) is not None  # then it is read from behind separators too, in any alignment
        body = run.replace("-", "+").replace("_", "/")
        for start in range(4 if parted else 1):
            piece = body[start : size - ((size - start) % 4 == 1)]
            if _SAYING.search(base64.b64decode(piece + "=" * (-len(piece) % 4))):
                self.asked[key] = size // 2
                return False
        self.known.update({(end, i): size for i in range(4)} if parted else {key: size})
        return True


def _stretches(text: str) -> list[tuple[int, int]]:
    """Stretches that hold nests deeper than ``WHOLE``, between barriers which no level of a nest touches."""
    barriers, out = [m.start() for m in _BARRIER.finditer(text)], []
    for m in _NEST.finditer(text):
        if max((n[3] for n in _nodes(text, m.start(), m.end())), default=0) > WHOLE:
            before, behind = bisect_left(barriers, m.start() - 1), bisect_left(barriers, m.end() + 1)
            lo, hi = barriers[before - 1] + 1 if before else 0, barriers[behind] if behind < len(barriers) else len(text)
            if out and lo < out[-1][1]:
                lo, hi = out[-1][0], max(hi, out.pop()[1])
            out.append((lo, hi))
    return out


def _between(layer: Layer, most: int):
    """What the levels between ``WHOLE`` and the last add: layers of the stretches that they change."""
    if _FAR.search(_unescaped(layer, WHOLE)[0].text):
        yield from (_unescaped(layer, level)[0] for level in range(WHOLE + 1, most))
        return
    for lo, hi in _stretches(layer.text):
        yield from _stretch_levels(layer, lo, hi, most)


def _stretch_levels(layer: Layer, lo: int, hi: int, most: int):
    """One stretch, level by level. A level is made from the one before by the escapes of its height.

    What a level has new touches a character that it changed. Characters of a run are only taken away at its left end, by the
    escape before it, so where a run ends is known from the level before, and base64 that said nothing is not decoded again.
    """
    text, starts, at, now, changes, plain = layer.text, array("q"), lo, [], {}, True
    for m in _NEST.finditer(text, lo, hi):
        now.append(text[at : m.start()])
        starts.extend(range(at, m.start()))
        nodes, at = list(_nodes(text, m.start(), m.end())), m.end()
        for char, start, _ in _characters(x for n in nodes for x in _at_level(n, WHOLE)):
            now.append(char)
            starts.append(start)
        for nest in nodes:
            work = [nest]
            while work:
                value, start, end, height, parts = work.pop()
                if height > WHOLE:
                    changes.setdefault(height, []).append((start, end, value, nest[1]))
                    plain = plain and isinstance(value, str)
                    work.extend(parts)
    now = "".join(now) + text[at:hi]
    starts.extend(range(at, hi + 1))
    loud, far, ends, silence = _LOUD.search(now) is not None, False, {}, _Silence()

    def origin(first: int, last: int) -> tuple[int, int]:
        return layer.origin(starts[first], starts[last])

    def run(kind: re.Pattern, i: int, nest: int) -> tuple[int, int]:
        """The run of this kind at a changed character, else right behind it."""
        first = i if kind.match(now, i, i + 1).end() > i else i + 1
        while i == first > 0 and kind.match(now, i - 1, i).end() == i:
            i = first = i - 1
        if first == len(now):
            return first, first
        start, end = ends.get((kind, nest), (0, 0))
        last = kind.match(now, bisect_left(starts, end) if start <= starts[first] < end else first).end()
        ends[kind, nest] = starts[first], starts[last]
        return first, last

    for level in range(WHOLE + 1, max(changes)):
        changed = sorted(changes[level], reverse=True)
        depth = layer.depth + level
        if not plain:
            yield _unescaped(layer, level, lo, hi)[0] if not far else _unescaped(layer, level)[0]
        for start, end, value, _ in changed if plain else ():
            i, j = bisect_left(starts, start), bisect_left(starts, end)
            now = now[:i] + value + now[j:]
            del starts[i + 1 : j]
            near = now[max(0, i - _NEAR) : i + _NEAR]
            loud, far = loud or _LOUD.search(near) is not None, far or _FAR.search(near) is not None
        if not plain:
            continue
        if far:
            yield _unescaped(layer, level)[0]
        elif loud:
            whole = isinstance(layer.starts, int)
            places = (layer.starts, layer.ends) if whole else (starts[:-1], starts[1:])
            if not whole and layer.starts is not None:
                places = array("q", (layer.starts[x] for x in places[0])), array("q", (layer.ends[x - 1] for x in places[1]))
            yield Layer(now, *places, depth, False)
        else:
            for start, _, _, nest in changed:
                i = bisect_left(starts, start)
                first, last = run(_DIGITS, i, nest)
                if last - first >= 24:
                    yield Layer("", *origin(first, last), depth, False, 2)
                first, last = run(_LETTERS, i, nest)
                if last - first >= 16 and not silence.of(now[first:last], starts[last]):
                    behind = last + len(now[last : last + 2]) - len(now[last : last + 2].lstrip("="))
                    for inner in _decoded_run(now[first:behind]):
                        yield Layer(inner, *origin(first, behind), depth + 1)


def _unwrapped(layer: Layer):
    """The layers behind all levels of a layer's escapes."""
    level, most = 1, 1
    while level <= min(most, WHOLE):
        new, most = _unescaped(layer, level)
        if new is not None:
            yield new
        level += 1
    if most > WHOLE:
        yield from _between(layer, most)
        yield _unescaped(layer, most)[0]


def _below(layer: Layer):
    """The layers right below one, made when they are asked for."""
    text = layer.text
    if layer.escaped and ("%" in text or "\\u" in text):
        yield from _unwrapped(layer)
    runs = [(m.start(), m.end()) for m in _BASE64.finditer(text)]
    wrapped = _wrapped_runs(text) if runs and "\n" in text else ()
    for start, end, run in chain(((a, b, text[a:b]) for a, b in runs), wrapped):
        for inner in _decoded_run(run):
            yield Layer(inner, *layer.origin(start, end), layer.depth + 1)
    for start, end, inner in _streams(text):
        yield Layer(inner, *layer.origin(start, end), layer.depth + 1)


def layers(text: str):
    """The text and every layer below it, each once: the worklist runs to its fixpoint. It holds the layers that lie on
    one path from the text down, and digests of those seen."""
    origin, seen = _digest(text), set()
    work = [iter((Layer(text, None, None, 0),))]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if layer.known is not None:
            yield layer
            continue
        if layer.depth:
            key = (_digest(layer.text), *layer.origin(0, len(layer.text))) if layer.text else None
            if key is None or key[0] == origin or key in seen:
                continue
            seen.add(key)
        yield layer
        work.append(_below(layer))


def find_secrets(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of one text, sorted."""
    base: list[Span] = []
    every: set[Span] = set()
    for layer in layers(text):
        found = layer.spans()
        if layer.depth == 0:
            base = found
        every.update(found)
    return base, sorted(every)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _kernel(batch: pa.RecordBatch) -> dict:
    out = {name: [] for name in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_decoded")}
    for text in batch.column("text").to_pylist():
        base, every = find_secrets(text or "")
        for kind, name in enumerate(("n_assign", "n_access", "n_hex")):
            out[name].append(sum(k == kind for _, k, _ in base))
        out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
        out["spans"].append(_joined(every))
        out["n_decoded"].append(len(every) - len(base))
    return {"doc_id": batch.column("doc_id"), **out}


def secret_spans(documents: DataFrame) -> DataFrame:
    """One row per document: counts and digest of base spans, and all spans with decoded layers."""
    return map_batches(keyed_text(documents), _kernel, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_decoded long")


def secret_rows(documents: DataFrame) -> DataFrame:
    """One row per span: (doc_id, kind, start, end, depth), the operator's general form."""

    def kernel(batch: pa.RecordBatch) -> dict:
        out = {name: [] for name in ("doc_id", "kind", "start", "end", "depth")}
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            least: dict[Span, int] = {}
            for layer in layers(text or ""):
                for a, kind, b in layer.spans():
                    least[a, kind, b] = min(layer.depth, least.get((a, kind, b), layer.depth))
            for (a, kind, b), depth in sorted(least.items()):
                for name, value in (("doc_id", doc), ("kind", KINDS[kind]), ("start", a), ("end", b), ("depth", depth)):
                    out[name].append(value)
        return out

    return map_batches(keyed_text(documents), kernel, "doc_id long, kind string, start long, end long, depth int")
