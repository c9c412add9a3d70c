"""WARC archives compressed with Zstandard: a writer, and a reader that loads the dictionary from the leading skippable frame.

An archive (.warc.zst) starts with a skippable frame that holds the dictionary (if there is one), followed by one frame for each record. The reader loads the dictionary, decodes one
frame per record and validates what it reads: the magic numbers, the version line, the mandatory header fields, Content-Length against the bytes at hand, the two
line ends after a record, and the digests. It takes archives of others as well: all types of records, records without digests, digests by other algorithms, HTTP
messages without a length or in chunks. A record that fails is reported with its place and reason, and reading goes on with the next frame; nothing is dropped silently. Records are read as streams:
without payloads, memory doesn't depend on their size.

Pages with equal payloads of at least `min_bytes` bytes are written once: the one with the largest id is the response, the others are revisit records that
keep the HTTP headers (with the full length) and refer to it. Which is which is decided on rows of id and digest; payloads are shuffled only if more than `broadcast_rows` digests
repeat, and then by their rows' places, which nothing can make hot. Writers name files by task and attempt and rename them when complete, so a lost executor
or a second attempt leaves no half-written archive under a final name.

Edge cases: a null payload is the empty one; a null url is written as urn:unknown and comes back null; rows without an id or with repeated ids are written like any other
(among equal payloads rows with the largest id are all responses), each with a record id of its own. Ids are integers. Archives of too few records to train a dictionary on have none. An empty table gives no
archive and an empty result. Payloads above 2 GB can be checked but not returned in a row. Other columns aren't read.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import struct
import urllib.parse
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, materialize, shared_path, slices, small_enough

ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
DICTIONARY_MAGIC = struct.pack("<I", 0x184D2A5D)
MIN_BYTES = 1000
#: A dictionary is trained per archive on the records of its first batch, on so many bytes at most.
TRAIN_BYTES, DICTIONARY_BYTES = 4 << 20, 64 << 10
LEVEL = 3
#: Up to so many digests that repeat are sent to all writers; beyond, rows are joined with what was decided by a shuffle.
BROADCAST_ROWS = 500_000
_MOST_ARROW = (1 << 31) - 1


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def _record(own_id: str, page_id: int | None, url: str | None, payload: bytes, digest: str, date: str, refers: tuple[str, int] | None) -> bytes:
    """One record: a response, or a revisit that refers to (record id, page id)."""
    sha1 = base64.b32encode(bytes.fromhex(digest)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    uri = "urn:unknown" if url is None else urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~") or "urn:empty"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {own_id}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}"]
    if refers:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers[0]}", f"X-Refers-To-Page-ID: {refers[1]}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None and (uri != url or uri == "urn:unknown"):
        head.append(f"X-Page-URL: {urllib.parse.quote(url, safe='')}")
    head += [f"WARC-Payload-Digest: sha1:{sha1}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_ALGORITHMS = ("sha1", "sha256", "sha512", "md5")


class _Digest:
    """A digest as a header gives it (algorithm:value, in base 32 or hexadecimal), to be held against bytes that come in chunks. Unknown algorithms fit anything."""

    def __init__(self, given: str | None):
        name, _, value = (given or "").partition(":")
        name = name.strip().lower().replace("-", "")
        self.hash = hashlib.new(name) if name in _ALGORITHMS else None
        self.value = value.strip()

    def update(self, data: bytes) -> None:
        if self.hash:
            self.hash.update(data)

    def fits(self) -> bool:
        if not self.hash:
            return True
        raw = self.hash.digest()
        return self.value.lower() == raw.hex() or self.value.upper().rstrip("=") == base64.b32encode(raw).decode().rstrip("=")


def _fields(head: bytes, what: str) -> tuple[str, dict[str, str]]:
    """First line and fields (names in small letters) of a header; folded lines are joined."""
    try:
        text = head.decode()
    except UnicodeDecodeError:
        text = head.decode("latin-1")
    first, *lines = re.sub(r"\r?\n[ \t]+", " ", text).split("\n")
    fields: dict[str, str] = {}
    for line in lines:
        line = line.rstrip("\r")
        name, colon, value = line.partition(":")
        if line and (not colon or not name or name != name.strip()):
            raise ValueError(f"{what} header line {line[:40]!r}")
        if line:
            fields.setdefault(name.lower(), value.strip())
    return first.rstrip("\r"), fields


class _Pull:
    """Bytes from chunks, by need."""

    def __init__(self, chunks: Iterable[bytes]):
        self.chunks, self.held = iter(chunks), b""

    def upto(self, mark: bytes, most: int = 1 << 24) -> bytes | None:
        """What comes before a mark, which is passed over; None if there is none (within `most` bytes, as headers have)."""
        at = self.held.find(mark)
        while at < 0:
            more = next(self.chunks, None)
            if more is None or len(self.held) > most:
                return None
            before = len(self.held)
            self.held += more
            at = self.held.find(mark, max(0, before - len(mark) + 1))
        out, self.held = self.held[:at], self.held[at + len(mark) :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes in chunks; fewer if there aren't so many."""
        while n:
            if not self.held:
                self.held = next(self.chunks, b"")
                if not self.held:
                    return
            piece, self.held = self.held[:n], self.held[n:]
            n -= len(piece)
            yield piece

    def rest(self) -> Iterator[bytes]:
        held, self.held = self.held, b""
        yield held
        for piece in self.chunks:  # not "yield from", which would close them with a reader that stops early
            yield piece


def _unchunked(body: _Pull) -> Iterator[bytes]:
    """The contents of a body in chunked transfer encoding."""
    while True:
        line = body.upto(b"\r\n", 1 << 12)
        if line is None:
            return
        size = int(line.split(b";")[0].strip() or b"0", 16)
        if not size:
            return
        yield from body.take(size)
        body.upto(b"\r\n", 2)


def read_record(raw: bytes | Iterable[bytes], payloads: bool = True) -> dict:
    """Fields of one record, given whole or in chunks, validated; ValueError says what is wrong. payload is null unless asked for, for revisits, and above 2 GB."""
    pull = _Pull([raw] if isinstance(raw, bytes) else raw)
    head = pull.upto(b"\r\n\r\n")
    if head is None:
        raise ValueError("no end of headers")
    version, fields = _fields(head, "")
    if not re.fullmatch(r"WARC/\d+\.\d+", version):
        raise ValueError(f"version line {version[:20]!r}")
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys()
    if missing:
        raise ValueError(f"missing {', '.join(sorted(missing))}")
    if not re.fullmatch(r"\d{4}(-\d\d(-\d\d(T\d\d:\d\d(:\d\d(\.\d{1,9})?)?Z)?)?)?|\d{14}", fields["warc-date"]):
        raise ValueError(f"date {fields['warc-date'][:30]!r}")
    if not fields["content-length"].isdigit():
        raise ValueError("Content-Length is no number")
    length, kind = int(fields["content-length"]), fields["warc-type"].lower()
    of_block, of_payload, of_body = _Digest(fields.get("warc-block-digest")), _Digest(fields.get("warc-payload-digest")), _Digest(fields.get("warc-payload-digest"))
    seen = 0

    def block() -> Iterator[bytes]:
        nonlocal seen
        for piece in pull.take(length):
            seen += len(piece)
            of_block.update(piece)
            yield piece

    body, http = _Pull(block()), None
    if kind in ("response", "revisit", "request") and fields.get("content-type", "application/http").lower().startswith("application/http") and length:
        top = body.upto(b"\r\n\r\n")
        if top is None or kind != "request" and not top.startswith(b"HTTP/"):
            raise ValueError("no HTTP headers")
        _, http = _fields(top, "HTTP")
    if kind == "revisit" and not {"warc-refers-to", "warc-refers-to-target-uri", "warc-payload-digest"} & fields.keys():
        raise ValueError("a revisit that refers to nothing")
    size, sha1, parts = 0, hashlib.sha1(), []
    chunked = http is not None and "chunked" in http.get("transfer-encoding", "").lower()

    def plain() -> Iterator[bytes]:
        for piece in body.rest():
            of_body.update(piece)  # some archives digest a chunked body as it stands
            yield piece

    try:
        for piece in _unchunked(_Pull(plain())) if chunked else plain():
            size += len(piece)
            sha1.update(piece)
            of_payload.update(piece)
            if payloads and size <= _MOST_ARROW:
                parts.append(piece)
        for _ in plain():
            pass
    except ValueError:
        raise ValueError("damaged chunks") from None
    if seen != length or b"".join(pull.rest()) != b"\r\n\r\n":
        raise ValueError("Content-Length doesn't match")
    if not of_block.fits():
        raise ValueError("block digest doesn't match")
    number = lambda x: int(x) if x is not None and re.fullmatch(r"-?\d{1,19}", x) else None
    declared = number((http or {}).get("content-length"))
    known = None
    if kind == "revisit":
        value = fields.get("warc-payload-digest", "").partition(":")[2]
        try:
            known = (bytes.fromhex(value) if len(value) == 40 else base64.b32decode(value + "=" * (-len(value) % 8))).hex() if fields.get("warc-payload-digest", "").lower().startswith("sha1:") else None
        except ValueError:
            raise ValueError("damaged payload digest") from None
    else:
        if not of_payload.fits() and not of_body.fits():
            raise ValueError("payload digest doesn't match")
        if declared is not None and declared != size and not chunked and kind == "response" and "warc-truncated" not in fields:
            raise ValueError("payload doesn't match its length")
    uri = fields.get("warc-target-uri")
    return {
        "record_id": fields["warc-record-id"].strip("<>"),
        "page_id": number(fields.get("x-page-id")),
        "url": urllib.parse.unquote(fields["x-page-url"]) if "x-page-url" in fields else None if uri in (None, "urn:unknown") else uri.strip("<>"),
        "date": fields["warc-date"],
        "record_type": kind,
        "payload_bytes": declared if kind == "revisit" else size,
        "payload_digest": known if kind == "revisit" else sha1.hexdigest(),
        "refers_to": number(fields.get("x-refers-to-page-id")),
        "refers_to_record": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
        "payload": b"".join(parts) if payloads and kind != "revisit" and size <= _MOST_ARROW else None,
    }


class ArchiveWriter:
    """Writes records into a stream, each as a frame of its own, after the dictionary in a skippable frame."""

    def __init__(self, sink, samples: list[bytes]):
        import zstandard

        self.sink = sink
        try:
            dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes() if samples else b""
        except zstandard.ZstdError:  # too little or too uniform a sample; frames then stand alone
            dictionary = b""
        if dictionary:
            packed = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary)
            sink.write(DICTIONARY_MAGIC + struct.pack("<I", len(packed)) + packed)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True, write_content_size=True)

    def write(self, record: bytes) -> None:
        self.sink.write(self.compressor.compress(record))


class Frames:
    """The frames of an archive. Iterating gives (place, chunks): the offset of a frame and its contents as they are decoded. After each one, `wrong` says what was wrong with it
    (None: nothing); chunks that weren't asked for are passed over. After a damaged frame, reading goes on at the next magic number."""

    def __init__(self, stream, chunk: int = 1 << 20):
        self.stream, self.chunk, self.buffer, self.at, self.wrong = stream, chunk, b"", 0, None

    def _fill(self, n: int) -> bool:
        while len(self.buffer) < n:
            more = self.stream.read(max(self.chunk, n - len(self.buffer)))
            if not more:
                return False
            self.buffer += more
        return True

    def _drop(self, n: int) -> None:
        """Pass over n bytes, which needn't be at hand."""
        while n:
            if not self.buffer and not self._fill(1):
                return
            k = min(n, len(self.buffer))
            self.buffer, self.at, n = self.buffer[k:], self.at + k, n - k

    def _chunks(self) -> Iterator[bytes]:
        import zstandard

        decoder = zstandard.ZstdDecompressor(dict_data=self.shared).decompressobj()
        step = 512
        while not decoder.eof:
            if not self._fill(1):
                raise ValueError("the frame is cut off")
            part = self.buffer[:step]
            out = decoder.decompress(part)
            step = max(64, step // 4) if len(out) > 1 << 20 else min(65536, 2 * step)  # all output of a step comes at once
            used = len(part) - len(decoder.unused_data)
            self.kept += part[:used] if len(self.kept) < self.chunk else b""
            self._drop(used)
            if out:
                yield out

    def __iter__(self) -> Iterator[tuple[int, Iterator[bytes]]]:
        import zstandard

        self.shared = None
        if self._fill(8) and self.buffer[:4] == DICTIONARY_MAGIC:
            size = struct.unpack("<I", self.buffer[4:8])[0]
            if not self._fill(8 + size):
                self.wrong = "the dictionary is cut off"
                yield 0, iter(())
                return
            packed = self.buffer[8 : 8 + size]
            try:
                raw = zstandard.ZstdDecompressor().decompressobj().decompress(packed) if packed[:4] == ZSTD_MAGIC else packed
                self.shared = zstandard.ZstdCompressionDict(raw) if raw else None
            except zstandard.ZstdError as e:
                self.wrong = f"the dictionary: {e}"
                yield 0, iter(())
            self._drop(8 + size)
        while self._fill(1):
            self._fill(8)
            if len(self.buffer) >= 8 and 0x184D2A50 <= struct.unpack("<I", self.buffer[:4])[0] <= 0x184D2A5F:  # other skippable frames
                self._drop(8 + struct.unpack("<I", self.buffer[4:8])[0])
                continue
            place, self.wrong, self.kept = self.at, None, b""
            if self.buffer[:4] != ZSTD_MAGIC:
                self.wrong = "no frame starts here"
                yield place, iter(())
            else:
                chunks = self._chunks()

                def guarded() -> Iterator[bytes]:
                    try:
                        yield from chunks
                    except (zstandard.ZstdError, ValueError) as e:
                        self.wrong = str(e)

                own = guarded()
                yield place, own
                for _ in own:
                    pass
                if self.wrong is None:
                    continue
            # what a damaged frame was read over is looked through again, as far as it is remembered
            self.buffer, self.at = self.kept + self.buffer, self.at - len(self.kept)
            skip = max(0, place + 1 - self.at)
            while (found := self.buffer.find(ZSTD_MAGIC, skip)) < 0:
                skip = max(skip, len(self.buffer) - 3)
                if not self._fill(len(self.buffer) + 1):
                    found = len(self.buffer)
                    break
            self._drop(found)


def read_archive(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(place, record, what is wrong) of every frame: place is the offset of the frame, record its bytes if it could be decoded."""
    frames = Frames(stream, chunk)
    for place, chunks in frames:
        raw = b"".join(chunks)
        yield place, None if frames.wrong else raw, frames.wrong


def decided(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """id, url, payload, digest, place, and of the page that a revisit refers to its id and place (null: a response). Equal payloads are counted per digest, combined before the shuffle. Rows must be in
    the same places each time the table is read, as files have them."""
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{payload_col}`"), F.lit("")).alias("payload"), F.monotonically_increasing_id().alias("place"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    light = rows.where(F.octet_length("payload") >= min_bytes).select("id", "digest", "place")
    newest = F.max(F.struct("id", (-F.col("place")).alias("p"))).alias("newest")
    equal = light.groupBy("digest").agg(newest, F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("_digest"), F.col("newest.id").alias("newest"), (-F.col("newest.p")).alias("at"))
    equal = materialize(equal, "warc-equal")
    refers = [F.expr("if(not id <=> newest, newest, null)").alias("refers_to"), F.expr("if(not id <=> newest, at, null)").alias("refers_at")]
    columns = ["id", "url", "payload", "digest", "place"]
    if small_enough(equal, broadcast_rows):
        joined = rows.join(F.broadcast(equal), (F.col("digest") == F.col("_digest")) & (F.octet_length("payload") >= min_bytes), "left")
        return joined.select(*columns, *refers)
    revisits = light.join(equal, F.col("digest") == F.col("_digest")).select("place", *refers).where("refers_at is not null")
    revisits = materialize(revisits, "warc-revisits").select(F.col("place").alias("_place"), "refers_to", "refers_at")
    small = rows.where(F.octet_length("payload") < min_bytes).select(*columns, F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("long").alias("refers_at"))
    large = rows.where(F.octet_length("payload") >= min_bytes).join(revisits.hint("merge"), F.col("place") == F.col("_place"), "left")
    return small.unionByName(large.select(*columns, "refers_to", "refers_at"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_BYTES, date: str | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Write all pages into archives in `folder` (a URI that every executor can reach); returns what was written: path, records, bytes. date: of the records (now, unless given)."""
    date = date or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{uuid.uuid4().hex}.warc.zst" if context else f"part-{uuid.uuid4().hex}.warc.zst"
        system, root = fs.FileSystem.from_uri(folder)
        records, writer, sink = 0, None, None
        for batch in batches:
            for part in slices(batch, "payload"):
                raw = []
                for i, url, payload, digest, place, refers_to, refers_at in zip(*(part.column(c).to_pylist() for c in ("id", "url", "payload", "digest", "place", "refers_to", "refers_at"))):
                    refers = None if refers_at is None else (record_id(folder, refers_at), refers_to)
                    raw.append(_record(record_id(folder, place), i, url, payload.encode(), digest, date, refers))
                if writer is None and raw:
                    system.create_dir(root, recursive=True)
                    sink = system.open_output_stream(f"{root}/_{name}")
                    held, samples = 0, []
                    for r in raw:
                        if held + len(r) > TRAIN_BYTES:
                            break
                        held += len(r)
                        samples.append(r)
                    writer = ArchiveWriter(sink, samples)
                for r in raw:
                    writer.write(r)
                records += len(raw)
        if sink is not None:
            size = sink.tell()
            sink.close()
            system.move(f"{root}/_{name}", f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/{name}"]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

    bound_batches(pages.sparkSession)
    rows = decided(pages, id_col, url_col, payload_col, min_bytes, broadcast_rows)
    # the list of the attempts that counted: files of attempts that were lost aren't in it
    return materialize(rows.mapInArrow(write, "path string, records bigint, bytes bigint"), "warc-manifest")


READ_SCHEMA = (
    "path string, place bigint, record_id string, page_id bigint, url string, date string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, refers_to_record string, payload binary, wrong string"
)


def read_archives(paths: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of the archives whose URIs are in the column path; rows with `wrong` set tell what couldn't be read. page_id and refers_to are set for archives of ours,
    record_id and refers_to_record for all."""
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    of_type = {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    types = [of_type[x.split()[1]] for x in READ_SCHEMA.split(", ")]

    def table(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, place = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with system.open_input_stream(place) as stream:
                    frames = Frames(stream)
                    for at, chunks in frames:
                        row = dict.fromkeys(names) | {"path": path, "place": at}
                        try:
                            found = read_record(chunks, payloads) if frames.wrong is None else {}
                            row |= found if frames.wrong is None else {}
                        except (ValueError, KeyError) as e:
                            row["wrong"] = str(e) or "damaged record"
                        row["wrong"] = frames.wrong or row["wrong"]
                        size = len(row["payload"] or b"") + 400
                        if rows and held + size > 4 << 20:
                            yield table(rows)
                            rows, held = [], 0
                        rows.append(row)
                        held += size
                yield table(rows)

    n = max(1, min(paths.count(), 20_000))
    return paths.select("path").repartition(n).mapInArrow(read, READ_SCHEMA)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), shared_path(spark, "warc"))
    return read_archives(written, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "wrong")


ORACLE = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
    e AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS newest FROM d)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> newest THEN newest END AS refers_to, NULL::VARCHAR AS wrong FROM e"""

QUERIES = {"op9_warc": op9_warc}
ORACLES = {"op9_warc": ORACLE}
