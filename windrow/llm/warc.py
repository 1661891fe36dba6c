"""WARC archives with an external index merge.

Pages are written as WARC files by Spark's text writer: a row is a record, the line separator is the blank lines that end
a WARC record, so every Hadoop file system will do and lost tasks are written again. Of equal payloads the one with the
largest page_id is stored, the others are revisit records that refer to it.

Reading back, each archive is streamed record by record and yields a run of captures sorted by URL key and timestamp. The
runs are merged externally: the key space is cut into ranges, each range's task gets its slice of every run, sorted by
Spark (which spills), and merges the k slices through a loser tree of cursors, so the result is ordered within and
across partitions: whole capture histories in global order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby
from urllib.parse import parse_qsl, urlencode, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.common import if_small, materialised, partitions, scratch, small_batches, stored, table

#: Fixed values of the WARC format.
VERSION, CRLF, RECORD_END = "WARC/1.0", "\r\n", "\r\n\r\n"
#: Payloads below this many bytes are always stored.
LEAST_REVISIT = 1000
RECORDS_PER_FILE = 2048
#: Captures that one merging task holds.
CAPTURES_PER_RANGE = 200_000

CAPTURE = "urlkey string, timestamp string, page_id bigint, run string, offset bigint, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, url string"


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """pages plus payload, payload_bytes, payload_digest, record_type and refers_to.

    Null html is an empty payload. Digests are grouped without the payloads; only digests that occur twice are joined
    back, by broadcast when they are few. An empty table gives no rows. Repeated rows of the winning page_id are all responses; rows with a null
    page_id are revisits if another row has their payload, else responses.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("bigint").alias("payload_bytes"), F.sha1(payload.cast("binary")).alias("payload_digest"))
    winners = materialised(
        rows.where(F.col("payload_bytes") >= least)
        .groupBy(F.col("payload_digest").alias("same_digest"))
        .agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies"))
        .where("copies > 1 AND keeper IS NOT NULL")
        .drop("copies")
    )
    again = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    joined = rows.join(if_small(winners, F.octet_length("same_digest")), (F.col("payload_digest") == F.col("same_digest")) & (F.col("payload_bytes") >= least), "left")
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("keeper")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, captured_at: str | None = None) -> None:
    """One WARC record a row below `path`, in gzipped files of a bounded number of records.

    captured_at names a timestamp column; without one, captures are a second apart in the order of page_id, from the
    epoch on. Line breaks inside URLs are percent-encoded. Null urls and page_ids leave their header out. Null html is an
    empty payload; long ones are written whole. Repeated rows are records of their own; an empty table gives no records.
    """
    seconds = F.col(captured_at).cast("timestamp") if captured_at else F.timestamp_seconds(F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(2_000_000_000)))
    stamped = pages.select("page_id", F.struct("url", F.date_format(seconds, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at")).alias("url"), "html")
    rows = with_revisits(stamped)
    url = F.replace(F.replace(F.col("url.url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = lambda name, value: F.coalesce(F.concat(F.lit(f"{CRLF}{name}: "), value), F.lit(""))
    stored = F.col("record_type") == "response"
    body = F.when(stored, F.col("payload")).otherwise("")
    record = F.concat(
        F.lit(f"{VERSION}{CRLF}WARC-Type: "),
        F.col("record_type"),
        header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        header("WARC-Date", F.col("url.at")),
        header("WARC-Target-URI", url),
        header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        header("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        F.lit(f"{CRLF}Content-Type: text/html; charset=utf-8"),
        header("Content-Length", F.octet_length(body).cast("string")),
        F.lit(RECORD_END),
        body,
    )
    rows.select(record.alias("value")).write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def url_key(url: str | None) -> str:
    """The sort key of a URL: host labels reversed, then path and sorted query, without scheme, www, fragment or case."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip().lower())
        host = parts.hostname or ""
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return url.lower()
    host = host.removeprefix("www.")
    query = urlencode(sorted(parse_qsl(parts.query, keep_blank_values=True)))
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{'?' + query if query else ''}"


class Stream:
    """Bytes that arrive in chunks, taken piece by piece; what is held is one piece and one chunk."""

    def __init__(self, chunks: Iterable[bytes]):
        self.chunks, self.ready, self.offset = iter(chunks), bytearray(), 0

    def more(self) -> bool:
        for chunk in self.chunks:
            self.ready += chunk
            return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (i := self.ready.find(mark, start)) < 0:
            start = max(0, len(self.ready) - len(mark))
            if not self.more():
                return None
        return self.take(i + len(mark))[: -len(mark)]

    def take(self, n: int) -> bytes:
        while len(self.ready) < n and self.more():
            pass
        out = bytes(self.ready[:n])
        del self.ready[:n]
        self.offset += len(out)
        return out


def records(chunks: Iterable[bytes]) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset in the archive, headers, body) of every record of an archive's bytes."""
    stream = Stream(chunks)
    while True:
        offset = stream.offset
        head = stream.until(RECORD_END.encode())
        if head is None:
            if stream.ready:
                raise ValueError(f"no whole record at {offset}")
            return
        if not head and not stream.ready and not stream.more():
            return  # a last part without blank lines of its own has got some
        lines = head.decode().split(CRLF)
        headers = dict(line.split(": ", 1) for line in lines[1:])
        body = stream.take(int(headers["Content-Length"]))
        if lines[0] != VERSION or stream.take(len(RECORD_END)) != RECORD_END.encode():
            raise ValueError(f"no whole record at {offset}")
        yield offset, headers, body


def page_of(value: str | None) -> int | None:
    return int(value.removeprefix("<urn:page:").removesuffix(">")) if value else None


def archive_parts(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(archive, bytes): what stands between two blank lines, and these, in the archive's order."""
    for batch in it:
        for name, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield name, part.as_py() + RECORD_END.encode()


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """The archives' captures: each file's are a run, sorted by URL key, timestamp and page_id.

    A gzipped file is read by one task from its beginning to its end, blank line by blank line, so a task holds one
    record and the captures of one file, whatever the file's size. No archives give no captures.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, parts in groupby(archive_parts(it), key=lambda x: x[0]):
            rows = []
            for offset, h, body in records(part for _, part in parts):
                kind = h["WARC-Type"]
                if kind == "response":
                    size, digest = len(body), hashlib.sha1(body).hexdigest()
                    if f"sha1:{digest}" != h["WARC-Payload-Digest"]:
                        raise ValueError(f"{name}: digest differs at {offset}")
                else:
                    size, digest = int(h["WARC-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:")
                url = h.get("WARC-Target-URI")
                rows.append((url_key(url), h.get("WARC-Date"), page_of(h.get("WARC-Record-ID")), name.rsplit("/", 1)[-1], offset, kind, digest, size, page_of(h.get("WARC-Refers-To")), url))
            rows.sort(key=order)
            yield captures(rows)

    parts = spark.read.option("lineSep", RECORD_END).option("pathGlobFilter", "*.gz").text(path)
    return parts.select(F.col("_metadata.file_path").alias("name"), F.col("value").cast("binary").alias("value")).mapInArrow(run, CAPTURE)


def order(row: tuple) -> tuple:
    return row[0], row[1] or "", -1 if row[2] is None else row[2], row[3], row[4]


def captures(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64() if x.endswith("bigint") else pa.string() for x in CAPTURE.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], [x.split(" ")[0] for x in CAPTURE.split(", ")])


def loser_tree(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """k sorted runs as one: inner nodes hold the losers of their match, so each row costs log2 k comparisons.

    One row of each run is held.
    """
    k = len(runs)
    if not k:
        return
    done = (1,)
    rows = [next(r, None) for r in runs]
    keys = [done if r is None else (0, *order(r)) for r in rows]
    losers, winner = [-1] * k, 0
    entered = [0] * (2 * k)
    for i in range(k):
        entered[k + i] = i
    for node in range(k - 1, 0, -1):  # the first round
        a, b = entered[2 * node], entered[2 * node + 1]
        entered[node], losers[node] = (a, b) if keys[a] <= keys[b] else (b, a)
    winner = entered[1] if k > 1 else 0
    while keys[winner] != done:
        yield rows[winner]
        row = rows[winner] = next(runs[winner], None)
        keys[winner] = done if row is None else (0, *order(row))
        node = (k + winner) // 2
        while node:
            if keys[losers[node]] < keys[winner]:
                losers[node], winner = winner, losers[node]
            node //= 2


def slices(it: Iterator[pa.RecordBatch]) -> list[list[pa.RecordBatch]]:
    """Rows that come run by run, as the pieces of each run, still in Arrow."""
    out: list[list[pa.RecordBatch]] = []
    last = None
    for batch in it:
        names = batch.column(batch.schema.get_field_index("run"))
        start = 0
        for end in range(1, batch.num_rows + 1):
            if end < batch.num_rows and names[end] == names[start]:
                continue
            if names[start].as_py() != last:
                out.append([])
                last = names[start].as_py()
            out[-1].append(batch.slice(start, end - start))
            start = end
    return out


def cursor(pieces: list[pa.RecordBatch], at_once: int = 64) -> Iterator[tuple]:
    """A slice's rows, a few at a time."""
    for piece in pieces:
        for start in range(0, piece.num_rows, at_once):
            yield from zip(*(c.to_pylist() for c in piece.slice(start, at_once).columns), strict=True)


def merge_index(runs: DataFrame) -> DataFrame:
    """The runs' captures in global order (partition by partition): capture histories by URL key and timestamp.

    Ranges are cut by key, timestamp and page_id, so a hot URL is split too; their number follows the number of captures,
    which bounds what a task holds. Null timestamps and page_ids come first. Repeated captures stay, one after the other.
    No captures give an empty index.
    """
    spark = runs.sparkSession
    with small_batches(spark, 256):
        held = stored(runs, "captures")
    n = max(partitions(spark), -(-held.count() // CAPTURES_PER_RANGE))

    def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: list[tuple] = []
        for row in loser_tree([cursor(pieces) for pieces in slices(it)]):
            merged.append(row)
            if len(merged) >= 10_000:
                yield captures(merged)
                merged = []
        yield captures(merged)

    ranges = held.repartitionByRange(n, "urlkey", "timestamp", "page_id")
    return ranges.sortWithinPartitions("run", "urlkey", F.coalesce("timestamp", F.lit("")), F.coalesce("page_id", F.lit(-1)), "offset").mapInArrow(merge, CAPTURE)


def op7_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written and read back through the merged index."""
    path = scratch(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return merge_index(capture_runs(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
     w AS (SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN w.keeper <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN w.keeper <> p.page_id THEN w.keeper END AS refers_to
FROM p LEFT JOIN w ON p.payload_digest = w.payload_digest AND p.payload_bytes >= 1000
"""
