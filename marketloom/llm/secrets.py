r"""Secret scans that look through encodings.

A text is scanned, then its layers are: a worklist holds every text still to be unwrapped. Percent escapes and Unicode escapes
are replaced in the layer as a whole, each character keeping the span it stands for; a base64 run becomes a layer of its
own that stands for the run, decompressed first where its bytes are gzip, zlib, bzip2, xz or Zstandard. Runs on adjacent lines are
also tried joined, and a run may begin after, or end before, a slash, a minus, an underscore or a line border inside it. Streams
are read through all their members; of a broken one what came before the break is kept. Deflate without a header is read where it
ends with the run and holds text. The escapes of a string in JSON (quotes, slashes, line ends) are taken as Unicode escapes are, one level a layer. Bytes that are no UTF-8 are read as
single characters, and null bytes are left out, so that UTF-16 can be read. Each new layer is
scanned and unwrapped in turn until none is new; a set of digests of the layers seen ends cycles. Spans are given in the original text.

Layers are taken one by one, deepest first, so memory is that of the text and one layer a depth. Compressed layers of more than
`max_layer_bytes` are read in pieces that overlap.

Defined cases: a null text is scanned as an empty one and has no secrets; a layer stays closed and counts in `n_closed` where more than
`max_unwrapped_bytes` were unwrapped from its text already, or if it is a stream larger than `max_layer_bytes` directly within another;
other columns pass through, those named as the added ones are replaced.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.common import Aside, table, tidy

KINDS = ["assign", "access", "hex"]
# What counts as a secret, and what as an encoded run.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"""(?:\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]{1,6}\}|\\U[0-9a-fA-F]{8}|\\x[0-9a-fA-F]{2}|\\["'\\/nrt])+""")
UNICODE_ONE = re.compile(r"""\\(?:u\{([0-9a-fA-F]{1,6})\}|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|x([0-9a-fA-F]{2})|(["'\\/nrt]))""")
#: What a backslash and one character stand for, where that isn't the character itself.
ESCAPED = {"n": 10, "r": 13, "t": 9}
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
BLOCK = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++={0,2}+(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++={0,2}+)++")
LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
LEAST = 16
#: What a scan or a further unwrapping could find in bytes.
SUSPECT = re.compile(rb"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{12}|[0-9a-f]{32}|%[0-9A-Fa-f]{2}|\\[uUx]|[A-Za-z0-9+/_-]{16}")
OPENERS = {b"\x1f\x8b": lambda: zlib.decompressobj(31), b"BZh": bz2.BZ2Decompressor, b"\xfd7zXZ\x00": lzma.LZMADecompressor}
ZSTD = b"\x28\xb5\x2f\xfd"


@dataclass(frozen=True)
class SecretRules:
    min_assigned: int = 8
    max_layer_bytes: int = 1 << 24
    max_unwrapped_bytes: int = 1 << 31


class TooLarge(Exception):
    pass


def find(text: str, rules: SecretRules):
    """(kind, start, end) of the secrets of a plain text."""
    for m in ASSIGN.finditer(text):
        if m.end(1) - m.start(1) >= rules.min_assigned:
            yield 0, m.start(), m.end()
    for kind, pattern in ((1, ACCESS), (2, HEX)):
        for m in pattern.finditer(text):
            yield kind, m.start(), m.end()


class Places:
    """The span of the original text that each character of a layer stands for, in runs of characters.

    Character i of a run that begins at `at` stands for `width` characters from start + stride * (i - at) on; stride is the width, or 0.
    """

    def __init__(self, start: int = 0, stride: int = 1, width: int = 1, empty: bool = False):
        self.at, self.start, self.stride, self.width = (array("q", [] if empty else [x]) for x in (0, start, stride, width))

    def add(self, at: int, start: int, stride: int, width: int) -> None:
        if self.at and self.stride[-1] == stride and self.width[-1] == width and self.start[-1] + stride * (at - self.at[-1]) == start:
            return
        for x, y in zip((self.at, self.start, self.stride, self.width), (at, start, stride, width)):
            x.append(y)

    def over(self, a: int, b: int) -> tuple[int, int]:
        """The span of characters a to b, b exclusive."""
        i, j = bisect_right(self.at, a) - 1, bisect_right(self.at, b - 1) - 1
        return self.start[i] + self.stride[i] * (a - self.at[i]), self.start[j] + self.stride[j] * (b - 1 - self.at[j]) + self.width[j]

    def copy(self, out: Places, a: int, b: int, at: int) -> None:
        """Adds my characters a to b to out, where they begin at `at`."""
        k = bisect_right(self.at, a) - 1
        while a < b:
            stop = min(b, self.at[k + 1]) if k + 1 < len(self.at) else b
            out.add(at, self.start[k] + self.stride[k] * (a - self.at[k]), self.stride[k], self.width[k])
            at, a, k = at + stop - a, stop, k + 1

    def scale(self, out: Places, a: int, n: int, step: int, at: int) -> None:
        """Adds n characters to out, at `at`, each of which stands for `step` of mine, from a on."""
        k = bisect_right(self.at, a) - 1
        if k + 1 < len(self.at) and self.at[k + 1] < a + n * step:
            for j in range(n):
                start, end = self.over(a + j * step, a + (j + 1) * step)
                out.add(at + j, start, 0, end - start)
        elif self.stride[k]:
            out.add(at, self.start[k] + self.stride[k] * (a - self.at[k]), self.stride[k] * step, self.width[k] * step)
        else:
            out.add(at, self.start[k], 0, self.width[k])


def _replaced(text: str, places: Places, pattern: re.Pattern, decode) -> tuple[str, Places]:
    """The text with each run decoded, and the places of its characters."""
    out, new, at, done = [], Places(empty=True), 0, 0
    for m in pattern.finditer(text):
        plain, widths = decode(m[0])
        out += [text[at : m.start()], plain]
        places.copy(new, at, m.start(), done)
        done, at = done + m.start() - at, m.start()
        for n, step in widths:
            places.scale(new, at, n, step, done)
            done, at = done + n, at + n * step
        at = m.end()
    places.copy(new, at, len(text), done)
    return "".join([*out, text[at:]]), new


def _percent(run: str) -> tuple[str, list]:
    """The run decoded, bytes that are no UTF-8 as single characters; and (how many characters, of how many of the run each)."""
    data = bytes.fromhex(run.replace("%", ""))
    if data.isascii():
        return data.decode(), [(len(data), 3)]
    out, widths, at, view = [], [], 0, memoryview(data)
    while at < len(data):
        end = _valid(view, at)
        good = data[at:end].decode()
        out.append(good)
        widths += [(len(list(g)), 3 * k) for k, g in groupby(len(c.encode()) for c in good)]
        if end < len(data):
            out.append(chr(data[end]))
            widths.append((1, 3))
        at = end + 1
    return "".join(out), widths


def _unicode(run: str) -> tuple[str, list]:
    """As _percent(); a surrogate without its other half, and a number beyond Unicode, is a replacement character."""
    codes = [(ESCAPED.get(m[5], ord(m[5])) if m[5] else int(m[m.lastindex], 16), len(m[0])) for m in UNICODE_ONE.finditer(run)]
    out, widths, i = [], [], 0
    while i < len(codes):
        code, width = codes[i]
        if 0xD800 <= code < 0xDC00 and i + 1 < len(codes) and 0xDC00 <= codes[i + 1][0] < 0xE000:
            code, width, i = 0x10000 + ((code - 0xD800) << 10) + codes[i + 1][0] - 0xDC00, width + codes[i + 1][1], i + 1
        out.append(chr(code) if code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else "\ufffd")
        widths.append(width)
        i += 1
    return "".join(out), [(len(list(g)), k) for k, g in groupby(widths)]


def _opener(data: bytes, at: int = 0):
    """What makes a decompressor of the stream that begins at `at`, if one does. A zlib header has method 8, a window of at most 32 KB, no dictionary, and 31 divides it."""
    head = data[at : at + 2]
    if len(head) == 2 and head[0] & 15 == 8 and head[0] < 0x80 and not head[1] & 32 and int.from_bytes(head, "big") % 31 == 0:
        return zlib.decompressobj
    return next((v for k, v in OPENERS.items() if data.startswith(k, at)), None)


def _deflated(data: bytes, at: int, most: int) -> bytes | None:
    """What a deflate stream without header holds, if one begins at `at` and ends, all but padding, with the data, and is nearly all printable."""
    opener, out, total, low = zlib.decompressobj(-15), [], 0, at
    try:
        while at < len(data) and not opener.eof:
            out.append(opener.decompress(data[at : at + 1024], most - total + 1))
            total, at = total + len(out[-1]), at + 1024
            if total > most or (total >= 1024 and len(out) == 1 and not _readable(out[0])):
                return None
            while opener.unconsumed_tail:
                out.append(opener.decompress(opener.unconsumed_tail, most - total + 1))
                total += len(out[-1])
                if total > most:
                    return None
    except zlib.error:
        return None
    plain = b"".join(out)
    return plain if opener.eof and at >= len(data) and len(opener.unused_data) <= 2 and len(plain) >= max(LEAST, len(data) - low >> 1) and _readable(plain) else None


def _readable(data: bytes) -> bool:
    text = _text(data)
    return sum(map(_printable, text)) >= 0.95 * len(text)


def _flow(data: bytes, said: dict):
    """What the members of a stream hold, piece by piece; said["whole"]: whether the last one begun was whole."""
    said["whole"] = True
    if data.startswith(ZSTD):
        with zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True) as f:
            try:
                while piece := f.read(1 << 16):
                    yield piece
            except zstandard.ZstdError:
                said["whole"] = False
        return
    at, some = 0, False
    while make := _opener(data, at):
        opener, said["whole"], member = make(), False, False
        try:
            while at < len(data) and not opener.eof:
                piece = opener.decompress(data[at : at + 1024])
                at += len(data[at : at + 1024])
                member = member or bool(piece)
                yield piece
        except (ValueError, EOFError, zlib.error, lzma.LZMAError, OSError):
            said["whole"] = some and not member  # nothing of what follows a whole member was a stream
            return
        if not opener.eof:
            return
        some, said["whole"], at = True, True, at - len(opener.unused_data)
        while data[at : at + 1] == b"\0":
            at += 1


def _members(data: bytes, most: int) -> tuple[bytes, bool]:
    """What the members of a stream hold one after the other, and whether the last one begun was whole."""
    out, total, said = [], 0, {}
    for piece in _flow(data, said):
        out.append(piece)
        total += len(piece)
        if total > most:
            raise TooLarge
    return b"".join(out), said["whole"]


def _pieces(data: bytes, most: int):
    """What a stream too large for one layer holds, in pieces that overlap. None where it holds a stream itself."""
    held, total, first, shared = [], 0, True, min(1 << 16, most // 2)
    for piece in _flow(data, {}):
        held.append(piece)
        total += len(piece)
        if total >= most:
            whole = b"".join(held)
            if first and (whole.startswith(ZSTD) or _opener(whole)):
                yield None
                return
            yield whole
            held, first = [whole[-shared:]], False
            total = shared
    yield b"".join(held)


def _opened(data: bytes, most: int) -> tuple[bytes, bool]:
    """data without the compressions around it, and whether all of them were whole."""
    whole, seen = True, set()
    while data.startswith(ZSTD) or _opener(data):
        seen.add(hashlib.sha256(data).digest())
        plain, good = _members(data, most)
        if hashlib.sha256(plain).digest() in seen:
            break
        data, whole = plain, whole and good
    return data, whole


def _text(data: bytes) -> str:
    """Bytes as a text: UTF-8, else a character a byte; without null bytes, as UTF-16 and UTF-32 have them."""
    data = data.replace(b"\0", b"")
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _printable_ascii(data: bytes) -> bool:
    return data.isascii() and all(map(_printable, data.decode()))


def _printable(c: str) -> bool:
    return c.isprintable() or c in "\r\n\t"


def _valid(data: memoryview, at: int) -> int:
    """Where the UTF-8 that begins at `at` ends."""
    size = 256
    while True:
        try:
            _, used = codecs.utf_8_decode(data[at : at + size], "strict", False)
        except UnicodeDecodeError as e:
            return at + e.start
        if at + size >= len(data):
            return at + used
        size *= 4


def _scores(text: str, low: int):
    """A function of positions in bytes: one for each printable character before, less nineteen for each other; None inside a character."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    ascii_ = np.array([_printable(chr(c)) for c in range(128)])
    good = ascii_[np.minimum(codes, 127)]
    other = np.flatnonzero(codes > 127)
    if len(other):
        kinds, which = np.unique(codes[other], return_inverse=True)
        good[other] = np.array([_printable(chr(c)) for c in kinds.tolist()])[which]
    score = np.concatenate([[0], np.cumsum(np.where(good, 1, -19), dtype=np.int32)])
    ends = None
    if len(other):
        ends = np.concatenate([[0], np.cumsum(1 + (codes > 0x7F).astype(np.int8) + (codes > 0x7FF) + (codes > 0xFFFF), dtype=np.int32)])

    def at(where: np.ndarray) -> list:
        k = where - low if ends is None else np.searchsorted(ends, where - low)
        fits = (k >= 0) & (k < len(score))
        fits[fits] &= True if ends is None else ends[k[fits]] == where[fits] - low
        return [int(score[i]) if f else None for i, f in zip(k.tolist(), fits.tolist())]

    return at


def _texts(data: bytes, starts: list[int], ends: list[int]):
    """(start, end) in bytes of the texts that are nearly all printable: from each start beyond the last text, up to the farthest end."""
    view, at, i = memoryview(data), 0, 0
    while i < len(starts):
        low = starts[i]
        if low < at:
            i += 1
            continue
        high = _valid(view, low)
        stop = bisect_left(starts, max(high, low + 1), i)
        fit = ends[bisect_left(ends, low + LEAST * 3 // 4) : bisect_right(ends, high)]
        if fit:
            # Twenty times the characters that are not printable may be as many as all characters; seen from the region's begin.
            score = _scores(data[low:high].decode(), low)
            at_end = score(np.array(fit))
            fit, best = [e for e, x in zip(fit, at_end) if x is not None], [x for x in at_end if x is not None]
            for k in range(len(best) - 2, -1, -1):
                best[k] = max(best[k], best[k + 1])
            for start, mine in zip(starts[i:stop], score(np.array(starts[i:stop]))):
                if start >= at and mine is not None:
                    k = bisect_right(best, -mine, key=lambda x: -x) - 1
                    if k >= 0 and fit[k] - start >= LEAST * 3 // 4:
                        yield start, fit[k]
                        at = fit[k]
        i = stop


def _base64(run: str, borders: list[int], most: int):
    """(start, end, text, whole) of what a run of base64 holds; start and end are 0, a border between lines or beside / - _, or the run's end."""
    core = run.rstrip("=")
    cuts = [m.start() for m in re.finditer("[/_-]", core)]
    starts, ends = sorted({0, *borders, *(c + 1 for c in cuts)}), sorted({*borders, *cuts, len(core)})
    core = core.replace("-", "+").replace("_", "/")
    for turn in range(4):
        mine = [x for x in starts if x % 4 == turn and len(core) - x >= LEAST]
        if not mine:
            continue
        body = core[mine[0] :]
        data = base64.b64decode((body[:-1] if len(body) % 4 == 1 else body) + "=" * (-len(body) % 4 % 3))
        place = {(x - mine[0]) // 4 * 3: x for x in mine}
        for low, x in place.items():
            if data.startswith(ZSTD, low) or _opener(data, low):
                try:
                    plain, whole = _opened(data[low:], most)
                except TooLarge:
                    for piece in _pieces(data[low:], most):
                        yield x, len(run), None if piece is None else _text(piece), True
                    place = {k: v for k, v in place.items() if k < low}
                    break
                text = _text(plain)
                if plain != data[low:] and text:
                    yield x, len(run), text, whole
                    # Else the bytes may only look like a stream, which those of a text may, too.
                    if whole or sum(map(_printable, text)) >= 0.95 * len(text) and not _printable_ascii(data[low : low + LEAST]):
                        place = {k: v for k, v in place.items() if k < low}
                        break
        for low, x in place.items():
            if not _printable_ascii(data[low : low + 8]) and (plain := _deflated(data, low, most)):
                yield x, len(run), _text(plain), True
                place = {k: v for k, v in place.items() if k < low}
                break
        until = {(e - mine[0]) * 3 // 4: e for e in ends if (e - turn) % 4 != 1 and e > mine[0]}
        rest = bytearray(data)
        for low, high in _texts(data, list(place), list(until)):
            end = until[high]
            rest[low:high] = b"\1" * (high - low)
            yield place[low], len(run) if end == len(core) else end, data[low:high].decode(), True
        # What is no text may still hold something: text in another code, or between bytes of other meaning.
        rest = rest.replace(b"\0", b"")
        if place and SUSPECT.search(rest):
            yield mine[0], len(run), rest.decode("latin-1"), True


def _blocks(layer: str):
    """Runs on adjacent lines that may be one wrapped run: spans of the lines. A shorter line, or one with = at its end, is the last."""
    for m in BLOCK.finditer(layer):
        block: list = []
        lines = [x.span() for x in LINE.finditer(layer, m.start(), m.end())]
        width = [b - a for a, b in lines]
        for i, line in enumerate(lines):
            block.append(line)
            shorter = len(block) > 1 and width[i] < width[i - 1]
            if shorter and len(block) == 2 and i + 1 < len(lines):  # the first line may be longer by what stands before the payload
                shorter = width[i + 1] != width[i] and layer[block[0][1] - width[i] - 1] not in "/-_"
            if shorter or layer[line[1] - 1] == "=" or i + 1 == len(lines):
                if len(block) > 1 and sum(b - a for a, b in block) >= LEAST:
                    yield block
                block = []


def _runs(layer: str, most: int):
    """(start, end, text) of the texts in base64, or None for a text that is too large. A broken stream counts if no wrapped block holds it whole."""
    held: list[tuple[int, int]] = []
    for lines in _blocks(layer):
        sums = [0]
        for a, b in lines:
            sums.append(sums[-1] + b - a)
        for low, high, text, whole in _base64("".join(layer[a:b] for a, b in lines), sums[1:-1], most):
            i, j = bisect_right(sums, low) - 1, bisect_left(sums, high) - 1
            if i < j:  # what one line holds is found below
                held.append((lines[i][0] + low - sums[i], lines[j][0] + high - sums[j]))
                yield *held[-1], text
    held.sort()
    for m in BASE64.finditer(layer):
        for low, high, text, whole in _base64(m[0], [], most):
            start, end = m.start() + low, m.start() + high
            k = bisect_right(held, (start, len(layer))) - 1
            if whole or k < 0 or end > held[k][1]:
                yield start, end, text


def _layers(layer: str, places: Places, path: str, rules: SecretRules):
    """The layers directly within a layer: text, places and path; None for one that stays closed."""
    for name, pattern, decode in (("url", PERCENT, _percent), ("unicode", UNICODE, _unicode)):
        if pattern.search(layer):
            yield *_replaced(layer, places, pattern, decode), f"{path}/{name}"
    for start, end, plain in _runs(layer, rules.max_layer_bytes):
        low, high = places.over(start, end)
        yield plain, Places(low, 0, high - low), f"{path}/base64"


def scan_text(text: str, rules: SecretRules) -> dict:
    """All secrets of one text and of the layers in it."""
    base = list(find(text, rules))
    found = {(kind, start, end): "" for kind, start, end in base}
    digest = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).digest()
    closed, left, seen, root = 0, rules.max_unwrapped_bytes, set(), None
    work = [_layers(text, Places(), "", rules)]
    while work:
        if not (got := next(work[-1], None)):
            work.pop()
            continue
        layer, places, path = got
        if layer is None or len(layer) > left:
            closed += 1
            continue
        if not layer:
            continue
        root = root or digest(text)
        mark = (digest(layer), *places.over(0, len(layer)))
        if mark in seen or mark[0] == root:
            continue
        seen.add(mark)
        left -= len(layer)
        for kind, start, end in find(layer, rules):
            found.setdefault((kind, *places.over(start, end)), path)
        work.append(_layers(layer, places, path, rules))
    base = set(base)
    spans = [{"kind": KINDS[k], "start": s, "end": e, "base": (k, s, e) in base, "layer": p} for (k, s, e), p in sorted(found.items(), key=lambda x: (x[0][1], x[0][0], x[0][2]))]
    return {"spans": spans, "n_closed": closed}


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("layer", pa.string())])
FOUND = "struct<spans:array<struct<kind:string,start:int,end:int,base:boolean,layer:string>>,n_closed:int>"


def scan(docs: DataFrame, rules: SecretRules = SecretRules()) -> DataFrame:
    """docs with `secrets` (kind, start, end, whether found without unwrapping, the layers unwrapped) and `n_closed`."""

    def found(texts: pa.Array) -> pa.Array:
        return pa.array([scan_text(t or "", rules) for t in texts.to_pylist()], pa.struct([("spans", pa.list_(SPAN)), ("n_closed", pa.int32())]))

    mine = Aside(docs, ["secrets", "n_closed"])
    df = mine.df.select(*mine.kept(), F.arrow_udf(tidy(found), FOUND)(mine.col("text")).alias("found"))
    return mine.back(df, F.col("found.spans").alias("secrets"), F.col("found.n_closed").alias("n_closed"))


def digest(df: DataFrame, column: str, kinds: list[str], *more: str) -> DataFrame:
    """Counts of base spans by kind, their digest, and all spans, of a column of spans; and further columns."""
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter(column, lambda x: x["base"])
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return df.select(
        "doc_id",
        *map(count, kinds),
        F.sha2(said(base), 256).alias("base_sha256"),
        said(F.col(column)).alias("spans"),
        *more,
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents").select("doc_id", "text")), "secrets", KINDS, "n_closed")
