"""WARC archives of pages, and their external index: locally sorted capture runs, merged by a loser tree into capture histories.

Writing: one record a page, made of column functions. Of records with equal payloads (by SHA-256) of at least `min_bytes` bytes the one
with the largest id holds the payload (`response`), the others refer to it (`revisit`). Equal payloads are found with partial
aggregation over ids and hashes; a page is joined with its group only where a group has several. Records go through Spark's text
writer, whose line separator is the end of a record, so archives are plain gzipped WARC files in the shared folder.

Reading: every archive is parsed by its content lengths, as a stream; payload digests are computed again, and a record that disagrees with
its header, or an archive that is cut off, is an error. The captures of an archive, sorted by URL key and time, are a run. Ranges of
(URL key, time, id, place) come from Spark's sampling range partitioner, so that one URL with a third of all captures is several ranges.
A task merges the runs of its range by a loser tree: one comparison a level for each capture. Ranges in order are the whole index.

Defined results: a null payload is empty. Rows that repeat the id and payload of a response are responses too; rows without an id
count as smaller than all others, and refer to nothing where no row of their group has one. A null URL is written as an empty one, has
the empty key and comes first; white space in URLs is percent-encoded. Long payloads are records like others: one at a time is held in
memory. An empty table gives empty archives and an empty index. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skylattice import runtime

#: Records of an archive, and captures of a range of the index, about.
PER_FILE = 10_000
PER_RANGE = 200_000
#: Bytes that are unpacked at once.
STEP = 1 << 20
#: base32, and the profile of records that repeat a payload.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
ORDER = ("url_key", "captured", "page_id", "record_offset")
CAPTURES = "archive string, record_offset long, url_key string, captured string, url string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long"
FIELDS = pa.schema(
    [("archive", pa.string()), ("record_offset", pa.int64()), ("url_key", pa.string()), ("captured", pa.string()), ("url", pa.string()), ("page_id", pa.int64())]
    + [("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]
)


# Writing


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 in base32: eight parts of 20 bits, four letters each."""
    digits = F.sha1(payload)
    parts = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(digits, i * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    letter = lambda v, by: F.substring(F.lit(BASE32), F.shiftright(v, by).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return F.array_join(F.transform(parts, lambda v: F.concat(*[letter(v, by) for by in (15, 10, 5, 0)])), "")


def written_url(url: Column) -> Column:
    """A URL without white space, which would end or change a header."""
    out = F.coalesce(url, F.lit(""))
    for c in (" ", "\t", "\n", "\r"):
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return out


def captured_at(at: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def named(page_id: Column, digest: Column) -> Column:
    return F.concat(F.lit("<urn:capture:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), digest, F.lit(">"))


def repeats(rows: DataFrame, min_bytes: int) -> DataFrame:
    """same (a hash of the payload) and last (id, time and URL of the response) of payloads that several rows hold."""
    large = rows.where(F.octet_length("payload") >= min_bytes).groupBy("same")
    return large.agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "captured", "url")).alias("last")).where("n > 1").drop("n")


def records(rows: DataFrame, last: DataFrame) -> DataFrame:
    """`value`: the record of each row as text, without the separator that ends it."""
    marked = rows.join(last, "same", "left").withColumn("digest", base32_sha1(F.col("payload")))
    again = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last.page_id"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(END))
    length = F.octet_length(http) + F.when(again, F.lit(0)).otherwise(F.octet_length("payload"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    refers = F.concat(
        line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", named(F.col("last.page_id"), F.col("digest"))),
        line("WARC-Refers-To-Target-URI", F.col("last.url")), line("WARC-Refers-To-Date", F.col("last.captured")),
    )
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(again, "revisit").otherwise("response")), line("WARC-Record-ID", named(F.col("page_id"), F.col("digest"))),
        line("WARC-Date", F.col("captured")), line("WARC-Target-URI", F.col("url")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(again, refers).otherwise(F.lit("")), line("Content-Type", F.lit("application/http;msgtype=response")), line("Content-Length", length.cast("string")), F.lit("\r\n"), http,
    )
    body = F.when(again, F.lit("").cast("binary")).otherwise(F.col("payload"))
    return marked.select(F.concat(head.cast("binary"), body).cast("string").alias("value"))


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", at: Column | None = None, min_bytes: int = 0, per_file: int = PER_FILE
) -> None:
    """WARC files with a record a page. at: when a page was captured (its time; the epoch unless said)."""
    time = captured_at(F.timestamp_seconds(F.lit(0)) if at is None else at)
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), written_url(F.col(f"`{url_col}`")).alias("url"), time.alias("captured"), payload.alias("payload"))
    rows = rows.withColumn("same", F.unhex(F.sha2("payload", 256)))
    last = runtime.written(repeats(rows, min_bytes), "repeats")
    records(rows, last).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


# Reading


class Unpacked:
    """The bytes of an archive, gzipped (of one or more members) or plain, as a stream."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.gz = data, 0, data[:2] == b"\x1f\x8b"
        self.unpack, self.rest = zlib.decompressobj(31) if self.gz else None, b""
        self.held, self.place = bytearray(), 0

    def more(self) -> bool:
        """Unpack some more; False at the end."""
        if self.gz and self.unpack.eof:
            self.rest = self.unpack.unused_data.lstrip(b"\0")
            if not self.rest and self.at >= len(self.data):
                return False
            self.unpack = zlib.decompressobj(31)
        if not self.rest:
            self.rest, self.at = self.data[self.at : self.at + STEP], self.at + STEP
            if not self.rest:
                if self.gz and not self.unpack.eof:
                    raise ValueError("the archive is cut off")
                return False
        if self.gz:
            self.held += self.unpack.decompress(self.rest, STEP)
            self.rest = self.unpack.unconsumed_tail
        else:
            self.held, self.rest = self.held + self.rest, b""
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes before a mark, which is left out; None at the end."""
        searched = 0
        while (found := self.held.find(mark, searched)) < 0:
            searched = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                if self.held:
                    raise ValueError("the archive is cut off")
                return None
        return self.take(found + len(mark))[:found]

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise ValueError("the archive is cut off")
        out = bytes(self.held[:n])
        del self.held[:n]
        self.place += n
        return out


def parsed(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Place, header (names in small letters) and block of each record of an archive."""
    stream = Unpacked(data)
    while True:
        place = stream.place
        head = stream.until(END.encode())
        if head is None:
            return
        version, *lines = head.decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record begins at {place}")
        header = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
        block = stream.take(int(header["content-length"]))
        if stream.take(len(END)) != END.encode():
            raise ValueError(f"the record at {place} is longer than it says")
        yield place, header, block


def id_in(name: str | None) -> int | None:
    """The id in a record's name, if it has one."""
    parts = (name or "").strip("<>").split(":")
    return int(parts[2]) if parts[:2] == ["urn", "capture"] and parts[2] else None


def key_of(url: str) -> str:
    """A URL with its host turned round, small letters there, without scheme, user, port and fragment: `com,example)/path?query`."""
    scheme, mark, rest = url.partition("://")
    if not mark or not scheme or not scheme.replace("+", "").replace(".", "").replace("-", "").isalnum():
        return url
    rest = rest.partition("#")[0]
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host = rest[:cut].rpartition("@")[2].partition(":")[0].lower()
    return ",".join(reversed(host.split("."))) + ")" + (rest[cut:] or "/")


def capture(archive: str, place: int, header: dict[str, str], block: bytes) -> tuple[dict[str, object], bytes | None]:
    """The row of a record and its payload (None where it refers to another's)."""
    http, _, body = block.partition(END.encode())
    said, kind, url = header.get("warc-payload-digest", "").removeprefix("sha1:"), header["warc-type"], header.get("warc-target-uri", "")
    if kind == "revisit":
        sizes = [line.partition(b":")[2] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
        size, digest = (int(sizes[0]) if sizes else None), said
    else:
        size, digest = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
        if said not in ("", digest):
            raise ValueError(f"the payload of the record at {place} of {archive} is not what its digest says")
    row = {
        "archive": archive, "record_offset": place, "url_key": key_of(url), "captured": header.get("warc-date"), "url": url or None, "page_id": id_in(header.get("warc-record-id")),
        "record_type": kind, "payload_bytes": size, "payload_digest": digest, "refers_to": id_in(header.get("warc-refers-to")),
    }
    return row, None if kind == "revisit" else body


def archives(spark: SparkSession, path: str) -> DataFrame:
    """Name and bytes of each archive of a folder."""
    return runtime.prepare(spark).read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")


def place_of(row: dict[str, object]) -> tuple:
    """What captures are ordered by; missing ids come first, as in Spark's order."""
    return row["url_key"], row["captured"] or "", row["page_id"] is not None, row["page_id"] or 0, row["record_offset"]


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives; those of one archive stand together, in order: a run."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column(0)[i].as_py()
                found = sorted((capture(name, *r)[0] for r in parsed(batch.column(1)[i].as_py())), key=place_of)
                yield pa.RecordBatch.from_pylist(found, FIELDS)

    return archives(spark, path).mapInArrow(read, CAPTURES)


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type and payload (null for a revisit) of every record, as it is read."""
    fields = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for record in parsed(batch.column(1)[i].as_py()):
                    row, payload = capture(batch.column(0)[i].as_py(), *record)
                    yield pa.RecordBatch.from_pylist([{**{c: row[c] for c in fields.names[:3]}, "payload": payload}], fields)

    return archives(spark, path).mapInArrow(read, "page_id long, url string, record_type string, payload binary")


# The index


def merged(sorted_runs: list[list[tuple]]) -> Iterator[tuple[int, int]]:
    """Run and place in it of every item, in order, by a tree of losers. Items that are equal come in order of their runs."""
    k = len(sorted_runs)
    at = [0] * k

    def beats(a: int, b: int) -> bool:
        """True if run a's next item comes before run b's; a run that is used up comes last."""
        if at[a] >= len(sorted_runs[a]) or at[b] >= len(sorted_runs[b]):
            return at[b] >= len(sorted_runs[b]) and (at[a] < len(sorted_runs[a]) or a < b)
        x, y = sorted_runs[a][at[a]], sorted_runs[b][at[b]]
        return x < y or (x == y and a < b)

    # the runs are the leaves k .. 2 k - 1; each inner node holds who lost there, and who won goes up
    loser, winner = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        winner[node], loser[node] = (a, b) if beats(a, b) else (b, a)
    top = winner[1] if k > 1 else 0
    while k and at[top] < len(sorted_runs[top]):
        yield top, at[top]
        at[top] += 1
        node = (top + k) // 2
        while node:
            if beats(loser[node], top):
                top, loser[node] = loser[node], top
            node //= 2


def in_order(found: DataFrame, per_range: int = PER_RANGE) -> DataFrame:
    """The runs' captures, with range_no and place: in order of range and place they are the whole index in order.

    A task holds the captures of one range: about per_range narrow rows, or less where there are more shuffle partitions.
    """
    ranges = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-found.count() // per_range))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), FIELDS)
        keys = [place_of(r) for r in rows.select(list(ORDER)).to_pylist()]
        names = rows.column("archive").to_pylist()
        starts = [i for i in range(len(names)) if not i or names[i] != names[i - 1]]
        order = [starts[run] + i for run, i in merged([keys[a:b] for a, b in zip(starts, [*starts[1:], len(names)])])]
        done = rows.take(pa.array(order, pa.int64())).append_column("place", pa.array(range(len(order)), pa.int64()))
        yield from done.combine_chunks().to_batches(runtime.ARROW_ROWS)

    dealt = found.repartitionByRange(ranges, *ORDER).sortWithinPartitions("archive", *ORDER)
    return dealt.mapInArrow(merge, f"{CAPTURES}, place long").withColumn("range_no", F.spark_partition_id())


def histories(found: DataFrame, per_range: int = PER_RANGE) -> DataFrame:
    """The captures of all runs with capture_no, their place in the whole index from 0: by URL key, then time, then id."""
    index = runtime.written(in_order(found, per_range), "index")
    sizes = index.groupBy("range_no").agg(F.count(F.lit(1)).alias("n"))
    # one row a range: small enough for one window
    before = sizes.select("range_no", (F.sum("n").over(W.partitionBy().orderBy("range_no")) - F.col("n")).alias("before"))
    return index.join(before, "range_no").withColumn("capture_no", F.col("before") + F.col("place")).drop("range_no", "place", "before")
