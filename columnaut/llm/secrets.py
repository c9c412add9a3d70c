"""Secret scan with a recursive decoding worklist.

Each text is scanned for three kinds of secrets. Then a worklist unwraps what the text hides: percent escapes of URLs, Unicode escapes,
runs of base64, wrapped over lines or not, and compressed data inside them (gzip, zlib, bzip2, xz, zstd). A run is decoded at every alignment, so it doesn't
matter what stands before the data; of decoded bytes the printable ASCII stretches are layers (secrets and encodings are ASCII), whatever lies between
them, and compressed data is looked for at every byte. Every layer is scanned again and goes back on the
worklist until nothing new appears; layers seen before (by digest and place) end the chain, which also stops archives that contain
themselves. Every layer keeps, for each of its characters, the span of the original text that it came from, so a finding at any
depth is reported where its outermost encoding stands.

Kinds of findings: assign, access and hex in the text itself; decoded_assign, decoded_access and decoded_hex in deeper layers.
Spans count code points, the end is exclusive. The scan is done inside the row, without a shuffle.

Edge cases: null and empty texts have no findings; repeated rows get the same row each; an empty table gives an empty result; other columns
aren't read by `scan` and pass through `redact` untouched. Texts are scanned whole, and so is compressed
data: member after member, in overlapping windows, so that nothing is cut. An overlap holds the encoded run that the window ends in; one of more than `max_layer_bytes` is kept compressed, and
decoded as a stream when it ends, so that memory stays within some times the text's own size however far its data expands.
"""

from __future__ import annotations

import base64
import bisect
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, map_batches, slices, texts_of, two_columns

KINDS = ("assign", "access", "hex", "decoded_assign", "decoded_access", "decoded_hex")
MAX_LAYER_BYTES = 16 << 20
WINDOW_BYTES, OVERLAP_BYTES, PIECE_BYTES = 1 << 20, 64 << 10, 64 << 10

_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: A run that goes on over line ends (or \\n in a string literal); every further line holds nothing else.
_WRAPPED = re.compile(r"""(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:[ \t]*(?:\r?\n|\r|\\r\\n|\\n)[ \t]*[A-Za-z0-9+/_-]++(?=={0,2}[ \t]*(?:[\r\n\\"'`<>)\],;}]|\Z)))++={0,2}""")
_LETTERS = re.compile(r"(?:(?<=\\)[rn]|[^A-Za-z0-9+/_-])+")
#: No secret and no encoding of one is shorter.
_STRETCH = re.compile(rb"[\t\n\r\x20-\x7e]{16,}")
_PRINTABLE = bytes(b if 32 <= b < 127 or b in b"\t\n\r" else 0 for b in range(256))
_ZLIB = b"|".join(b"\\x%02x[%s]" % (a, b"".join(b"\\x%02x" % b for b in range(256) if (a << 8 | b) % 31 == 0 and not b & 32)) for a in range(0x08, 0x80, 16))
_MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd|" + _ZLIB, re.DOTALL)
#: Bytes that base64 and hexadecimal runs are made of.
_RUN = np.zeros(256, bool)
_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=")] = True
#: Bytes of wrapped and escaped runs.
_RUN_BYTES = bytes(b for b in range(128) if _RUN[b]) + b"\r\n\t%\\&#;{}"
#: Base64 letters in the standard alphabet, and all other bytes.
_STANDARD = bytes(range(256)).replace(b"-", b"+").replace(b"_", b"/")
_NO_LETTERS = bytes(b for b in range(256) if not _RUN[b] or b == 61)
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base kinds, leftmost and non-overlapping within a kind; kind is an index of KINDS."""
    found = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return found


def _long_run(text: str) -> bool:
    """Whether 13 characters or more of a base64 run can stand together: in a run of 16, four bytes that lie four apart do."""
    hit = _RUN[np.frombuffer(text.encode(), np.uint8)[::4]]
    return len(hit) >= 4 and bool((hit[:-3] & hit[1:-2] & hit[2:-1] & hit[3:]).any())


def suspicious(text: str) -> bool:
    """False only if neither find nor unwrap can give anything."""
    if "%" in text and _PERCENT.search(text) or ("\\" in text or "&#" in text) and _ESCAPE.search(text) or _long_run(text):
        return True
    low = text.lower()
    return any(k in low for k in _KEYWORDS)


class _Stream:
    """Bytes that come in chunks, held as far as they are needed; base is the place of the first byte held."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held, self.base, self.done = chunks, bytearray(), 0, False

    def grow(self) -> bool:
        chunk = next(self.chunks, None)
        self.done = chunk is None
        self.held += chunk or b""
        return not self.done

    def pieces(self, at: int, size: int) -> Iterator[bytes]:
        while True:
            piece = bytes(self.held[at - self.base : at - self.base + size])
            if piece:
                at += len(piece)
                yield piece
            elif self.done or not self.grow():
                return


class _Member:
    """One compressed member at a place of a stream. chunks() gives what can be read of it; then end is the place behind it, or None if it is damaged or cut off."""

    def __init__(self, stream: _Stream, at: int):
        self.stream, self.at, self.end = stream, at, None

    def chunks(self) -> Iterator[bytes]:
        head = bytes(self.stream.held[self.at - self.stream.base :][:6])
        size, at = PIECE_BYTES, self.at
        try:
            if head[:2] == b"\x1f\x8b":
                d = zlib.decompressobj(31)
            elif head[:3] == b"BZh":
                d = bz2.BZ2Decompressor()
            elif head == b"\xfd7zXZ\x00":
                d = lzma.LZMADecompressor()
            elif head[:4] == b"\x28\xb5\x2f\xfd":
                import zstandard

                d, size = zstandard.ZstdDecompressor().decompressobj(), 64  # gives all output at once, 128 KiB for 4 bytes at most
            else:
                d = zlib.decompressobj()
            for piece in self.stream.pieces(at, size):
                at += len(piece)
                while True:
                    out = d.decompress(piece) if size == 64 else d.decompress(piece, PIECE_BYTES)
                    if out:
                        yield out
                    if d.eof:
                        self.end = at - len(d.unused_data)
                        return
                    piece = getattr(d, "unconsumed_tail", b"")
                    if size == 64 or not (piece or len(out) == PIECE_BYTES and getattr(d, "needs_input", None) is not True):
                        break
        except Exception:  # damaged or foreign data: what came until there is scanned
            return


class _Spool:
    """An encoded run too long to be held as it is: compressed again, it takes about as much as what it was expanded from."""

    def __init__(self):
        self.packer, self.parts = zlib.compressobj(1), []

    def add(self, run: bytes) -> None:
        self.parts.append(self.packer.compress(run))

    def _letters(self) -> Iterator[bytes]:
        """Its base64 letters, without line ends."""
        unpacker, carry = zlib.decompressobj(), b""
        for part in self.parts:
            while part:
                piece = carry + unpacker.decompress(part, PIECE_BYTES)
                part = unpacker.unconsumed_tail
                carry = b"\\" if piece.endswith(b"\\") else b""
                piece = piece[: len(piece) - len(carry)].replace(b"\\n", b"").replace(b"\\r", b"")
                yield piece.translate(_STANDARD, _NO_LETTERS)

    def _decoded(self, skip: int) -> Iterator[bytes]:
        held = b""
        for piece in self._letters():
            held, skip = held + piece[skip:], max(0, skip - len(piece))
            n = len(held) // 4 * 4
            yield base64.b64decode(held[:n])
            held = held[n:]
        if len(held) > 1:
            yield base64.b64decode(held + b"=" * (-len(held) % 4))

    def contents(self, most: int, above: frozenset[bytes]) -> Iterator[bytes]:
        self.parts.append(self.packer.flush())
        for skip in range(4):
            for _, inner in _contents(self._decoded(skip), most, above):
                yield inner


def _contents(chunks: Iterator[bytes], most: int, above: frozenset[bytes] = frozenset()) -> Iterator[tuple[int | None, bytes]]:
    """Windows of a stream (place None) and of all that is compressed in it (place of the outermost member). above: heads of the members around, which stops
    archives that contain themselves."""
    stream, past, want, spool, upto = _Stream(chunks), 0, WINDOW_BYTES, None, 0
    while not stream.done:
        while len(stream.held) < want and stream.grow():
            pass
        window, base = bytes(stream.held), stream.base
        yield None, window
        for place in [base + m.start() for m in _MAGIC.finditer(window)]:
            head = hashlib.sha256(window[place - base : place - base + PIECE_BYTES]).digest()
            if place < past or head in above:
                continue
            member = _Member(stream, place)
            for _, inner in _contents(member.chunks(), most, above | {head}):
                yield place, inner
            past = member.end or past
        tail = len(window) - len(window.rstrip(_RUN_BYTES))
        if spool:
            more = window[upto - base :]
            own = len(more) - len(more.lstrip(_RUN_BYTES))
            spool.add(more[:own])
            if own < len(more) or stream.done:
                for inner in spool.contents(most, above):
                    yield base, inner
                spool = None
        elif tail > most and above:  # outside of members the run is at hand as a whole
            spool = _Spool()
            spool.add(window[len(window) - tail :])
            if stream.done:
                for inner in spool.contents(most, above):
                    yield base, inner
                spool = None
        upto = base + len(window)
        keep = tail if OVERLAP_BYTES < tail <= most else OVERLAP_BYTES
        drop = max(0, len(window) - keep)
        del stream.held[:drop]
        stream.base += drop
        want = 2 * len(stream.held) + WINDOW_BYTES


def _cover(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """The starts of spans in order, and how far any span reaches that starts there or before."""
    ordered = sorted(spans)
    return [s[0] for s in ordered], list(itertools.accumulate((s[1] for s in ordered), max))


Layer = tuple[str, np.ndarray, np.ndarray]  # text; start and end in the original text of each character


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with all matches replaced; None if nothing changed. Characters of a replacement stand for the span that decode gives them."""
    text, start, end = layer
    parts: list[str] = []
    starts: list[np.ndarray] = []
    ends: list[np.ndarray] = []
    at = 0
    for m in pattern.finditer(text):
        new = decode(m)
        if new is None:
            continue
        piece, a, b = new  # a, b: positions in this layer
        parts += [text[at : m.start()], piece]
        starts += [start[at : m.start()], start[a]]
        ends += [end[at : m.start()], end[np.asarray(b, np.int64) - 1] if len(b) else end[:0]]
        at = m.end()
    if not parts:
        return None
    return "".join([*parts, text[at:]]), np.concatenate([*starts, start[at:]]), np.concatenate([*ends, end[at:]])


def _percent(m: re.Match) -> tuple[str, np.ndarray, np.ndarray] | None:
    blob = bytes.fromhex(m.group().replace("%", ""))
    text = blob.decode(errors="replace")
    widths = [len(c.encode()) if c != "�" else 1 for c in text]
    at = m.start() + 3 * np.concatenate([[0], np.cumsum(widths)]).astype(np.int64)
    at = np.minimum(at, m.end())
    return text, np.minimum(at[:-1], m.end() - 1), np.maximum(at[1:], 1)


def _escape(m: re.Match) -> tuple[str, np.ndarray, np.ndarray] | None:
    digits = next(x for x in m.groups() if x is not None)
    code = int(digits, 10 if m.group(6) is not None else 16)
    if code > 0x10FFFF or 0xD800 <= code < 0xE000:
        return None
    return chr(code), np.array([m.start()]), np.array([m.end()])


def unwrap(layer: Layer, most: int) -> Iterator[Layer]:
    """The layers directly inside one."""
    text, start, end = layer
    for pattern, decode, sign in ((_PERCENT, _percent, "%"), (_ESCAPE, _escape, None)):
        if sign is None or sign in text:
            new = _replaced(layer, pattern, decode)
            if new:
                yield new
    for letters, places, last in _runs(text):
        for skip in range(4):
            body = letters[skip:]
            if len(body) < 12:
                break
            if len(body) % 4 == 1:
                body = body[:-1]
            blob = base64.b64decode(body + "=" * (-len(body) % 4))
            if _STRETCH.search(blob):
                at = np.arange(len(blob) + 1)
                a = places[skip + at[:-1] * 4 // 3]
                b = places[np.minimum(skip + (at[1:] * 4 + 2) // 3, len(letters)) - 1]
                yield _ascii(blob), start[a], end[b]
            for place, inner in _contents(iter([blob]), most):
                if place is None:
                    continue
                first = start[places[skip + place * 4 // 3]]
                if _STRETCH.search(inner):
                    yield _ascii(inner), np.broadcast_to(first, len(inner)), np.broadcast_to(end[last - 1], len(inner))


def _runs(text: str) -> Iterator[tuple[str, np.ndarray, int]]:
    """Base64 runs: their letters, the places of these in the text, and the end of the run. Wrapped runs come line by line, too."""
    for m in _BASE64.finditer(text):
        letters = m.group().rstrip("=")
        yield _standard(letters), np.arange(m.start(), m.start() + len(letters)), m.end()
    for m in _WRAPPED.finditer(text):
        gaps = [(m.start(), m.start()), *(g.span() for g in _LETTERS.finditer(text, m.start(), m.end())), (m.end(), m.end())]
        parts = [(x[1], y[0]) for x, y in zip(gaps, gaps[1:]) if x[1] < y[0]]
        yield _standard("".join(text[a:b] for a, b in parts)), np.concatenate([np.arange(a, b) for a, b in parts]), m.end()


def _ascii(blob: bytes) -> str:
    """Bytes as text of the same length; what isn't printable ASCII becomes NUL, which no pattern crosses."""
    return blob.translate(_PRINTABLE).decode("ascii")


def _standard(letters: str) -> str:
    return letters.replace("-", "+").replace("_", "/")


def scan_text(text: str, most: int = MAX_LAYER_BYTES) -> list[tuple[int, int, int]]:
    """All findings as (start, end, kind), by start, then kind, then end."""
    if not suspicious(text):
        return []
    base = find(text)
    found = set(base)
    opens, upto = _cover(base)
    places = np.arange(len(text), dtype=np.int64)
    seen = {hashlib.sha256(text.encode(errors="surrogatepass")).digest()}
    work = [unwrap((text, places, places + 1), most)]  # one layer of each depth is held at a time
    while work:
        inner = next(work[-1], None)
        if inner is None:
            work.pop()
            continue
        key = hashlib.sha256(inner[0].encode(errors="surrogatepass") + inner[1][:1].tobytes()).digest()
        if key in seen or not suspicious(inner[0]):
            continue
        seen.add(key)
        work.append(unwrap(inner, most))
        for a, b, kind in find(inner[0]):
            s, e = int(inner[1][a:b].min()), int(inner[2][a:b].max())
            k = bisect.bisect_right(opens, s)
            if not k or upto[k - 1] < e:  # what stands in the open was found already
                found.add((s, e, kind + 3))
    # a secret over a line end is found in its own line as well, so far as that goes
    for kind in (3, 4, 5):
        wide = sorted((a, -b) for a, b, k in found if k == kind and (text.find("\n", a, b) >= 0 or text.find("\\n", a, b) >= 0))
        if wide:
            upto = list(itertools.accumulate((-b for _, b in wide), max))
            longest: dict[int, int] = {}
            for a, b in wide:
                longest.setdefault(a, -b)

            def inside(f: tuple[int, int, int]) -> bool:
                if kind < 5:
                    return longest.get(f[0], -1) > f[1]
                k = bisect.bisect_left(wide, (f[0], -f[1]))  # those before begin no later, and end later if they begin there too
                return k > 0 and upto[k - 1] >= f[1]

            found = {f for f in found if f[2] != kind or not inside(f)}
    return sorted(found, key=lambda f: (f[0], f[2], f[1]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_layer_bytes: int = MAX_LAYER_BYTES) -> DataFrame:
    """One row per row of docs: its id and findings, an array of (kind, start, end)."""
    source = two_columns(docs, id_col, text_col)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in scan_text(t, max_layer_bytes)] for part in slices(batch, "text") for t in texts_of(part, "text")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, kind)], names=[id_col, "findings"])

    return map_batches(source, run, f"`{id_col}` {dict(source.dtypes)['id']}, findings array<struct<kind:string,start:bigint,end:bigint>>")


def redact_text(text: str, mark: str = "[SECRET]", most: int = MAX_LAYER_BYTES) -> str:
    """The text with every found span replaced; overlapping spans are replaced as one."""
    out, at = [], 0
    spans = scan_text(text, most)
    i = 0
    while i < len(spans):
        a, b = spans[i][:2]
        while i + 1 < len(spans) and spans[i + 1][0] <= b:
            i += 1
            b = max(b, spans[i][1])
        out += [text[at:a], mark]
        at, i = b, i + 1
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """docs with the secrets in its texts replaced by a mark; length_col, where docs has it, is set to the new length if the text changed."""
    columns = docs.columns
    at = columns.index(text_col)
    length_at = columns.index(length_col) if length_col in columns else None

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, batch.schema.names[at]):
            old = part.column(at).to_pylist()
            new = [t and redact_text(t, mark) for t in old]
            arrays = list(part.columns)
            arrays[at] = pa.array(new, arrays[at].type)
            if length_at is not None:
                lengths = arrays[length_at].to_pylist()
                arrays[length_at] = pa.array([n if a == b else len(b) for n, a, b in zip(lengths, old, new)], arrays[length_at].type)
            yield pa.RecordBatch.from_arrays(arrays, schema=part.schema)

    return map_batches(docs, run, docs.schema)


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    count = lambda k: f"cast(size(filter(findings, f -> f.kind = '{k}')) as bigint) as n_{k}"
    joined = lambda x: f"array_join(transform({x}, f -> concat(f.kind, ':', f.start, ':', f.end)), ',')"
    return found.selectExpr("doc_id", *map(count, KINDS[:3]), f"sha2({joined(f'''filter(findings, f -> f.kind in {KINDS[:3]})''')}, 256) as base_sha256", f"{joined('findings')} as spans")


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3_secret_scans that SQL can express: what stands in the open."""
    return op3_secret_scans(spark, sf_dir).drop("spans")


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_SQL_ASSIGN = "((" + "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+))"""


def _matches_sql(kind: int, pattern: str, keep: str) -> str:
    """(doc_id, k, s, e): matches in order, each found with the text that stands before it, whose lengths sum up to its place."""
    whole = f"regexp_extract_all(t, '(?s)(.*?){pattern}', "
    return f"""m{kind} AS (SELECT doc_id, generate_subscripts(m, 1) AS i, unnest(p) AS p, unnest(m) AS m, unnest(v) AS v FROM (SELECT doc_id, {whole}1) AS p, {whole}2) AS m, {whole}{4 if kind == 0 else 2}) AS v FROM d)),
    s{kind} AS (SELECT doc_id, {kind} AS k, v, m, sum(length(p) + length(m)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS e FROM m{kind}),
    f{kind} AS (SELECT doc_id, k, e - length(m) AS s, e FROM s{kind} WHERE {keep})"""


BASE_ORACLE = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {_matches_sql(0, _SQL_ASSIGN, "length(v) >= 12")}, {_matches_sql(1, "(AKIA[A-Z0-9]+)", "length(m) >= 18")}, {_matches_sql(2, "([0-9a-f]+)", "length(m) >= 16")},
    f AS (SELECT * FROM f0 UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f2),
    g AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
        string_agg(['assign', 'access', 'hex'][k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k) AS j FROM f GROUP BY 1)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(j, '')) AS base_sha256 FROM d LEFT JOIN g USING (doc_id)"""

QUERIES = {"op3_secret_scans": op3_secret_scans, "base_secrets": base_secrets}
ORACLES = {"base_secrets": BASE_ORACLE}
