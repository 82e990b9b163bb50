"""WARC archives of web pages: a writer, a reader, and a merged index of captures."""

from __future__ import annotations

import hashlib
import re
import zlib
from base64 import b32encode
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.llm.common import arrow_rows, scratch, stored

#: Records of an archive file, and bytes of their payloads, at most; bound what a reader holds at once.
FILE_RECORDS, FILE_BYTES = 10_000, 256 << 20
#: Captures of a range, about, whose runs a task merges.
RANGE_ROWS = 200_000
#: Slices of a digest that occurs more than once, so that a hot payload is spread.
SALTS = 32
DATE = "1970-01-01T00:00:00Z"
CRLF = "\r\n"
#: The digits of base 32 by conv() and by RFC 4648.
CONV_DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
INDEX = "urlkey string, captured string, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, file string, record_offset long, record_length long"


def sha1_base32(text: Column) -> Column:
    """Bare upper-case base-32 SHA-1 of a text's UTF-8 bytes: five hex digits make four of base 32."""
    digest = F.sha1(text.cast("binary"))
    fours = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*fours), CONV_DIGITS, BASE32)


def _utc(at: Column) -> Column:
    """A timestamp as the format's date, to the second, with the session's zone taken as UTC."""
    return F.date_format(at.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def classify(pages: DataFrame, min_bytes: int = 0, captured: Column | None = None) -> DataFrame:
    """Payload, time, digest, record type and the page that a revisit refers to.

    Of equal payloads of at least ``min_bytes`` bytes the largest ``page_id`` is the
    response; a null id is always a response. The largest ids are partial
    aggregates; only digests that occur twice are joined, each in ``SALTS`` slices.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    captured = F.coalesce(_utc(captured), F.lit(DATE)) if captured is not None else F.lit(DATE)
    base = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("url"), payload.alias("payload"), captured.alias("captured"))
    base = base.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": sha1_base32(F.col("payload")), "salt": F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")})
    shared = base.filter(F.col("page_id").isNotNull() & (F.col("payload_bytes") >= min_bytes)).groupBy("payload_digest").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).filter("n > 1").select("payload_digest", "newest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    both = base.join(shared, ["payload_digest", "salt"], "left")
    revisit = F.coalesce(F.col("newest") > F.col("page_id"), F.lit(False))
    return both.select("page_id", "url", "payload", "captured", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("newest")).alias("refers_to"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", page_id.cast("string"), digest).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def records(classified: DataFrame) -> DataFrame:
    """One WARC/1.1 record per row as text, without the two line ends that close it."""
    safe_url = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    is_response = F.col("record_type") == "response"
    status = "HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "
    http = F.concat(F.lit(status), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    block = F.when(is_response, F.concat(http, "payload")).otherwise(http)
    sha = F.concat(F.lit("sha1:"), "payload_digest")
    head = F.concat(
        F.lit("WARC/1.1" + CRLF),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("payload_digest"))),
        _line("WARC-Date", F.col("captured")),
        _line("WARC-Target-URI", safe_url),
        _line("WARC-Payload-Digest", sha),
        _line("WARC-Profile", F.when(~is_response, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _line("WARC-Refers-To", F.when(~is_response, _record_id(F.col("refers_to"), F.col("payload_digest")))),
        _line("X-Page-Id", F.col("page_id").cast("string")),
        _line("X-Refers-To-Page-Id", F.col("refers_to").cast("string")),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
    )
    return classified.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str, *, min_bytes: int = 0, captured: Column | None = None, file_records: int = FILE_RECORDS, file_bytes: int = FILE_BYTES, codec: str = "gzip") -> None:
    """Archives of whole records by Spark's committed text writer, on any file system.

    A record ends with two line ends, which is the writer's separator. Control
    characters and blanks in an address are written as %20. A file has so few records
    that payloads as large as the largest would fill ``file_bytes``. ``captured`` is
    the time of a capture; without it, or where it is null, it is 1970.
    """
    largest = pages.agg(F.max(F.octet_length(F.col("html").cast("string")))).first()[0] or 0
    file_records = max(1, min(file_records, file_bytes // max(1, largest)))
    out = records(classify(pages, min_bytes, captured)).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", file_records)
    out.option("compression", codec).text(path)


def url_key(url: str | None) -> str:
    """Sort-friendly form of an address: reversed host, port, path and query; no scheme, 'www.', fragment or case."""
    if not url:
        return ""
    rest = re.sub(r"^[a-z][a-z0-9+.-]*://", "", url.strip().lower()).split("#", 1)[0]
    host, slash, tail = re.match(r"([^/?]*)(/?)(.*)", rest, re.S).groups()
    host, _, port = host.rpartition("@")[2].partition(":")
    labels = re.sub(r"^www\d*\.", "", host).split(".")
    return ",".join(reversed(labels)) + (f":{port}" if port not in ("", "80", "443") else "") + ")/" + tail.lstrip("/").rstrip("/")


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(headers, block, offset, length) of every record; lengths, not separators, delimit them."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8").split(CRLF)
        if not first.startswith("WARC/1."):
            raise ValueError(f"no record at {at}")
        headers = dict(line.split(": ", 1) for line in lines)
        body = end + 4
        stop = body + int(headers["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} has no end")
        yield headers, data[body:stop], at, stop + 4 - at
        at = stop + 4


def _number(headers: dict[str, str], name: str) -> int | None:
    return int(headers[name]) if name in headers else None


def _capture(headers: dict[str, str], block: bytes, file: str, at: int, length: int) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(re.search(rb"\nContent-Length: (\d+)", http)[1])
    if headers["WARC-Type"] == "response":
        if (len(payload), b32encode(hashlib.sha1(payload).digest()).decode()) != (size, digest):
            raise ValueError(f"{file} at {at}: the payload doesn't match its digest")
    url = headers.get("WARC-Target-URI")
    return (url_key(url), headers["WARC-Date"], _number(headers, "X-Page-Id"), url, headers["WARC-Type"], _number(headers, "X-Refers-To-Page-Id"), digest, size, file, at, length)


def sort_key(row: tuple) -> tuple:
    """URL key, time, page (null first), then the place of the record."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[8], row[9]


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """Index rows of all archives under ``path``; each file is one locally sorted run."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [c.split()[0] for c in INDEX.split(", ")]
        kinds = [pa.int64() if c.endswith(" long") else pa.string() for c in INDEX.split(", ")]
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py()
                data = zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data
                rows = sorted((_capture(*r[:2], file, *r[2:]) for r in parse_archive(data)), key=sort_key)
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 10_000], strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(run, INDEX)


class LoserTree:
    """k-way merge of sorted runs: inner nodes keep the loser of their match, the winner goes up."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.k, self.at = runs, len(runs), [0] * len(runs)
        self.losers = [-1] * self.k
        self.keys = [sort_key(r[0]) if r else None for r in runs]
        winners = [-1] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        self.winner = winners[1] if self.k > 1 else 0

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.keys[self.winner] is not None:
            w = self.winner
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self.keys[w] = sort_key(self.runs[w][self.at[w]]) if self.at[w] < len(self.runs[w]) else None
            node = (w + self.k) // 2
            while node:
                if self._beats(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


def merge_runs(runs: DataFrame) -> DataFrame:
    """The captures of all runs in global order of URL key and time.

    Rows are dealt by ranges of the whole sort key, which ends with the record's
    place, so that one address with very many captures spans several ranges. There is
    a range for each ``RANGE_ROWS`` captures, so that a task's memory doesn't grow with
    the table. Within a range each file's rows are one run of the loser tree.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        by_file: dict[str, list[tuple]] = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by_file.setdefault(row[8], []).append(row)
        for rows in by_file.values():
            rows.sort(key=sort_key)  # linear where the run arrives in order
        held: list[tuple] = []
        for row in LoserTree([by_file[f] for f in sorted(by_file)]):
            held.append(row)
            if len(held) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    n = max(1, -(-runs.count() // RANGE_ROWS))
    return runs.repartitionByRange(n, "urlkey", "captured", "page_id", "file", "record_offset").mapInArrow(run, INDEX)


def archive_and_index(pages: DataFrame, *, min_bytes: int = 0, captured: Column | None = None, path: str | None = None) -> DataFrame:
    """Write archives of ``pages``, read them back, and return the merged capture index.

    Null html is an empty payload; a null url is left out of the record and has the
    empty key; repeated rows are records of their own (all rows of the largest id are
    responses); an empty table gives an empty index; other columns are not read.
    """
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write_archives(pages, path, min_bytes=min_bytes, captured=captured)
    with arrow_rows(spark, 1):  # one file a batch: a worker holds one archive at a time
        runs = stored(capture_runs(spark, path), "capture-runs")
    return merge_runs(runs)
