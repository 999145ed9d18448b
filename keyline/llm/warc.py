"""WARC records and the resolution of not-modified revisits.

A revisit record says that a capture equals an earlier one; with the server's
not-modified profile (status 304) it has no body, only validators and a few headers.
Each revisit is joined as of its time with the latest earlier full response of the
same canonical URL. If the validators agree, the response's body stands for it and the
headers that a 304 may update replace the response's.

The as-of join runs over slots of the records sorted by URL and time, cut where the
partitions of that order are; so a URL with a third of all records is spread over many
slots, whatever its times. Every slot gets the latest response before it from the table
of the slots' last responses, which is small.

WARC files are read as text that ends with the mark of the next record, gzip files as
rows of their bytes, so a task holds one record and not a file. What is damaged in them is
told from what could not be read, and is an error, a row of a report, or left out.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator
from datetime import UTC, datetime
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .memory import lean
from .storage import Scratch

#: Headers that a not-modified response may update (fixed values).
UPDATED_HEADERS = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")

RECORD_SCHEMA = "record_id string, warc_type string, url string, ts long, status int, headers map<string,string>, payload binary"


def canonical_url(url: Column) -> Column:
    """Lower-case scheme-less URL without 'www.' or 'm.', default port, fragment, index page,
    trailing slash and tracking parameters; the other parameters sorted. Null stays null."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(bare, r"^(?i:[a-z][a-z0-9+.-]*:)?//", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^(?:www|m)\.", ""), r":(?:80|443)$", "")
    path = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, r"/(?i:index\.html?)$", "/"), r"/+$", "")
    query = F.when(rest.contains("?"), F.regexp_replace(rest, r"^[^?]*\?", "")).otherwise(F.lit(""))
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(?i:utm_[a-z]+|ref|fbclid|gclid|sessionid)="))
    kept = F.array_join(F.array_sort(kept), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def _pairs(headers: Column) -> Column:
    """Header names in lower case; of repeated names the last counts."""
    lower = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    lower = F.reverse(F.filter(lower, lambda e: e["key"].isNotNull()))
    names = F.transform(lower, lambda e: e["key"])
    once = F.filter(lower, lambda e, i: F.array_position(names, e["key"]) == i + 1)
    return F.coalesce(F.map_from_entries(once), F.create_map().cast("map<string,string>"))


def resolve_revisits(records: DataFrame, *, slots: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Resolve the revisits of ``records`` (record_id, warc_type, url, ts, status, headers).

    One row per revisit: record_id, canonical, ts, response_id, response_ts, outcome,
    headers, and with a column ``payload`` also that. outcome: 'resolved'; 'mismatch' if
    an ETag of both, or without one in common a Last-Modified of both, differ;
    'unverified' if they share no validator; 'missing' without an earlier response.
    headers and payload: those of the response, with the headers that the revisit may
    update, when resolved or unverified; else the revisit's own.

    Earlier means a smaller ``ts``, or the same with a smaller record_id. Full responses
    have type 'response' and a status from 200 to 299 (null counts as 200). Null
    headers are empty; of names that differ in case alone the last counts; a null URL or
    time matches nothing. Other columns are ignored. Repeated rows each give a row. ETags
    compare weakly (W/ is ignored). ``slots``: partitions of the sorted records.
    """
    spark = records.sparkSession
    scratch = scratch or Scratch(spark, "warc")
    full = (F.col("warc_type") == "response") & F.coalesce(F.col("status"), F.lit(200)).between(200, 299)
    body = [F.col("payload")] if "payload" in records.columns else []
    base = records.select(
        F.monotonically_increasing_id().alias("row"),
        "record_id", canonical_url(F.col("url")).alias("canonical"), F.col("ts").cast("long").alias("ts"),
        F.when(full, F.lit(0)).when(F.col("warc_type") == "revisit", F.lit(1)).alias("kind"),
        _pairs(F.col("headers")).alias("own"), *body,
    ).filter("kind is not null")
    base = scratch.save(base, "records", compression="zstd")
    light = base.drop("payload")
    order = ["canonical", "ts", "record_id", "kind", "row"]
    placed = light.filter("canonical is not null and ts is not null")
    placed = placed.repartitionByRange(*([slots] if slots else []), *order).withColumn("slot", F.spark_partition_id())
    placed = scratch.save(placed, "placed")
    seen = F.when(F.col("kind") == 0, F.struct("ts", "record_id", "own", "row"))
    # the last response of each slot, and from it the last one before each slot in use
    finals = placed.groupBy("canonical", "slot").agg(
        F.max_by(seen, F.when(F.col("kind") == 0, F.struct("ts", "record_id", "row"))).alias("final")
    )
    by_slot = Window.partitionBy("canonical").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = finals.select("canonical", "slot", F.last("final", ignorenulls=True).over(by_slot).alias("before"))
    carried = scratch.save(carried, "carried")
    within = Window.partitionBy("canonical", "slot").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    revisits = placed.withColumn("near", F.last(seen, ignorenulls=True).over(within)).filter("kind = 1")
    far = carried.select(F.col("canonical").alias("_c"), F.col("slot").alias("_s"), "before")
    joined = revisits.join(far, (F.col("canonical") == F.col("_c")) & (F.col("slot") == F.col("_s")), "left")
    joined = joined.select("row", "record_id", "canonical", "ts", "own", F.coalesce("near", "before").alias("response"))
    lost = light.filter("kind = 1 and (canonical is null or ts is null)").select(
        "row", "record_id", "canonical", "ts", "own", F.lit(None).cast(joined.schema["response"].dataType).alias("response")
    )
    out = joined.unionByName(lost)

    theirs = F.col("response.own")
    tag = lambda m: F.regexp_replace(F.element_at(m, "etag"), "^W/", "")
    since = lambda m: F.element_at(m, "last-modified")
    both = lambda f: f(F.col("own")).isNotNull() & f(theirs).isNotNull()
    outcome = (
        F.when(F.col("response").isNull(), "missing")
        .when(both(tag), F.when(tag(F.col("own")) == tag(theirs), "resolved").otherwise("mismatch"))
        .when(both(since), F.when(since(F.col("own")) == since(theirs), "resolved").otherwise("mismatch"))
        .otherwise("unverified")
    )
    allowed = F.map_filter("own", lambda k, v: k.isin(*UPDATED_HEADERS))
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.map_contains_key(allowed, k)), allowed)
    out = out.withColumn("outcome", outcome)
    from_response = F.col("outcome").isin("resolved", "unverified")
    out = out.select(
        "record_id", "canonical", "ts",
        F.col("response.record_id").alias("response_id"), F.col("response.ts").alias("response_ts"), "outcome",
        F.when(from_response, merged).otherwise(F.col("own")).alias("headers"),
        F.when(from_response, F.col("response.row")).otherwise(F.col("row")).alias("body"),
    )
    if not body:
        return out.drop("body")
    # one response may stand for very many revisits: written, both sides can be split where it is hot
    out = scratch.save(out, "resolved")
    bodies = base.select("row", "payload")
    return out.join(bodies, out["body"] == bodies["row"]).drop("body", "row")


#: What begins a file, and in it a record behind an earlier one; the rest of the version follows.
BEGIN = "WARC/1."
MARK = "\n" + BEGIN
#: What cuts gzip files into rows: frequent in what is stored, every 64 kB in what is compressed.
CUT = "\r\n"
#: Gzip data goes to zlib in steps of so many bytes, which bounds what comes out of each.
STEP = 64 << 10


def parse_record(data: bytes) -> tuple | int | str:
    """A record behind its ``MARK``, as RECORD_SCHEMA; the bytes that are still missing; or
    what is wrong with it."""
    end = data.find(b"\r\n\r\n")
    if end < 0 and data.endswith(b"\r\n\r"):  # the next mark took the line's end
        end = len(data) - 3
    if not re.match(rb"\d\r\n", data) or end < 0:
        return "no version or no end of the head"
    fields = _fields(data[:end])
    if not fields.get("content-length", "").isascii() or not fields.get("content-length", "").isdigit():
        return "no valid length"
    size = int(fields["content-length"])
    if size >= 1 << 31:
        return "longer than a row can be"
    body = data[end + 4 : end + 4 + size]
    if len(body) < size:
        return size - len(body)
    if data[end + 4 + size :].strip(b"\r\n"):
        return "bytes behind the payload"
    ts = _seconds(fields.get("warc-date"))
    if ts is None and "warc-date" in fields:
        return "no valid date"
    status, headers, payload = None, None, body
    if fields.get("content-type", "").replace(" ", "").lower().startswith("application/http;msgtype=response"):
        head, _, payload = body.partition(b"\r\n\r\n")
        first = re.match(rb"HTTP/\S+ (\d{3})", head)
        if not first and (body or fields.get("warc-type") != "revisit"):
            return "no valid status line"
        status, headers = int(first[1]) if first else None, _fields(head)
    return fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri"), ts, status, headers, payload


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, sep, v in (x.partition(":") for x in lines) if sep}


def _seconds(date: str | None) -> int | None:
    """Of a W3C date, which may be a year or a month alone; without a zone it is UTC."""
    if date is None:
        return None
    if re.fullmatch(r"\d{4}(-\d\d)?", date):
        date += "-01" if len(date) == 7 else "-01-01"
    try:
        when = datetime.fromisoformat(date)
    except ValueError:
        return None
    return int((when if when.tzinfo else when.replace(tzinfo=UTC)).timestamp())


def _gunzip(rows: Iterator[bytes], faults: list[str]) -> Iterator[bytes]:
    """What a gzip file holds, up to its end or to what is wrong with it."""
    member, cut = None, b""
    try:
        for row in rows:
            raw, cut = cut + row, CUT.encode()
            for i in range(0, len(raw), STEP):
                data = raw[i : i + STEP]
                while data:
                    if member is None or member.eof:
                        data = data.lstrip(b"\0") if member else data  # zeros may fill a block
                        if not data:
                            break
                        member = zlib.decompressobj(31)
                    yield member.decompress(data)
                    data = member.unused_data
    except zlib.error as e:
        faults.append(f"gzip: {e}")
        return
    if member and not member.eof:
        try:  # the reader drops a cut that ends a file
            last = member.decompress(CUT.encode())
        except zlib.error:
            last = b""
        if member.eof:
            yield last
        else:
            faults.append("the gzip file breaks off")


def _pieces(stream: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of a file between its marks."""
    mark, held, tail = MARK.encode(), [], b""
    for data in stream:
        *whole, rest = (tail + data).split(mark)
        for piece in whole:
            yield b"".join([*held, piece])
            held = []
        near = max(len(rest) - len(mark) + 1, 0)  # a mark may begin there
        held.append(rest[:near])
        tail = rest[near:]
    yield b"".join([*held, tail])


def _records(pieces: Iterator[bytes]) -> Iterator[tuple | str]:
    """The records of a file, and what is wrong where one is damaged."""
    again: deque[bytes] = deque()
    mark = MARK.encode()

    def take() -> bytes | None:
        return again.popleft() if again else next(pieces, None)

    while (piece := take()) is not None:
        parts, record = [piece], parse_record(piece)
        while isinstance(record, int):  # goes on with a payload that holds the mark
            while record > 0 and (piece := take()) is not None:
                parts.append(piece)
                record -= len(mark) + len(piece)
            record = "cut off" if record > 0 else parse_record(mark.join(parts))
        if isinstance(record, str):  # what was taken for its payload may be records
            again.extendleft(reversed(parts[1:]))
        yield record


def _file(rows: Iterator[bytes], start: int, gzip: bool) -> Iterator[tuple | str]:
    """:func:`_records` of the rows of a file, or of a split that begins at ``start``."""
    faults: list[str] = []
    pieces = _pieces(_gunzip(rows, faults)) if gzip else rows
    if not start:
        first = next(pieces, b"")
        if first.startswith(BEGIN.encode()):
            pieces = chain([first[len(BEGIN) :]], pieces)
        elif first:
            yield "no record at the beginning"
    yield from _records(pieces)
    yield from faults


def read_warc(spark: SparkSession, path: str, *, damaged: str = "skip") -> DataFrame:
    """Records of the WARC files at ``path`` (plain or .gz), streamed: a task holds a record.

    A record is damaged if it is cut off, has no valid length, a date or an HTTP status
    line that can't be read, or other bytes behind its payload; a file, if something else
    comes first, or if its gzip data is broken, where reading it ends. ``damaged`` says
    what comes of that. 'fail': an error that names the file. 'report': two more columns,
    ``file`` and ``damage``, and a row without a record for each damage. 'skip': it is left
    out, unseen, so only for crawls known to be damaged. Each time reading goes on with
    the next mark of a record. A file that can't be read for other reasons is an error.

    A payload that holds the mark of a record is put together again. In a plain file that
    fails across the border of two splits: the record is damaged, and records in the rest
    of its payload count as such.
    """
    if damaged not in ("fail", "report", "skip"):
        raise ValueError(f"damaged: {damaged}")
    names = ["record_id", "warc_type", "url", "ts", "status", "headers", "payload", "file", "damage"]
    types = [
        pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string(), pa.string(),
    ]
    schema = RECORD_SCHEMA
    if damaged == "report":
        schema += ", file string, damage string"
    else:
        names, types = names[:7], types[:7]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes]]:
        for batch in batches:
            where = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            for at, value in zip(where, batch.column(0), strict=True):
                yield at, value.as_py() or b""

    def run(batches: Iterator[pa.RecordBatch], gzip: bool) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True))[: len(names)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for (file, start), of in groupby(rows(batches), key=lambda r: r[0]):
            for record in _file((data for _, data in of), start, gzip):
                if isinstance(record, str):
                    if damaged == "fail":
                        raise ValueError(f"damaged WARC file {file}: {record}")
                    if damaged == "skip":
                        continue
                    held.append((*[None] * 7, file, record))
                else:
                    held.append((*record[:5], None if record[5] is None else list(record[5].items()), record[6], file, None))
                    size += len(record[6])
                if size > 8 << 20 or len(held) >= 10_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def scan(names: str, cut: str, gzip: bool) -> DataFrame:
        # Spark can't tell a broken file from one that it could not read, so gzip data comes as it is
        text = spark.read.option("pathGlobFilter", names).option("lineSep", cut)
        text = text.option("ignoreCorruptFiles", "false").option("ignoreMissingFiles", "false")
        text = text.option("io.compression.codecs", "org.apache.hadoop.io.compress.PassthroughCodec")
        for place in ("", "org.apache.hadoop.shaded."):  # the option's name in Spark's build of the client
            text = text.option(place + "io.compress.passthrough.extension", ".gz")
        text = text.text(path).select(F.col("value").cast("binary"), F.col("_metadata.file_path"), F.col("_metadata.file_block_start"))
        return text.mapInArrow(lean(lambda batches: run(batches, gzip)), schema)

    return scan("*.gz", CUT, True).union(scan("{*[!z],*[!g]z,*[!.]gz,z,gz}", MARK, False))


def write_warc(records: DataFrame, path: str) -> None:
    """Write records (warc_type, record_id, url, ts, status, headers, payload as text) as
    gzip WARC files, one per task, in DataFrame functions. Null texts are empty."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("ts") / 86400).cast("int")).cast("string")
    clock = [F.lpad((F.floor(F.pmod("ts", F.lit(86400)) / n) % m).cast("string"), 2, "0") for n, m in ((3600, 24), (60, 60), (1, 60))]
    date = F.concat(day, F.lit("T"), F.concat_ws(":", *clock), F.lit("Z"))
    lines = F.transform(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>"))), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    status = F.coalesce(F.col("status"), F.lit(200)).cast("string")
    http = F.concat(F.lit("HTTP/1.1 "), status, F.lit(" -\r\n"), F.array_join(lines, "\r\n"), F.lit("\r\n\r\n"), F.coalesce("payload", F.lit("")))
    fields = [
        F.concat(F.lit(f"{name}: "), value)
        for name, value in (
            ("WARC-Type", F.col("warc_type")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Target-URI", F.col("url")),
            ("WARC-Date", date), ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", F.octet_length("http").cast("string")),
        )
    ]
    rows = records.withColumn("http", http)
    whole = F.concat(F.lit("WARC/1.1\r\n"), F.concat_ws("\r\n", *fields), F.lit("\r\n\r\n"), F.col("http"))
    rows.select(whole.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)
