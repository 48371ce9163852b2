"""WARC archives: a writer on Spark's text sink and a Python data source that reads them.

The writer forms each record as one string and lets the text sink write it, so the
archive lands wherever Spark can write, with Spark's commit protocol: a lost or
repeated task leaves no half-written file.  Equal payloads are stored once.

The reader (format ``warc``) plans whole files into partitions, parses the headers of
a record first, and tests the pushed-down predicates on them; the block of a record
that fails, or whose payload is not wanted, is skipped without being read or decoded.
Filter pushdown for Python data sources needs ``spark.sql.python.filterPushdown.enabled``.
"""

from __future__ import annotations

import gzip
import operator
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as DS
from pyspark.sql import functions as F

from tidewatch.session import materialize

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
SCHEMA = (
    "record_id string, record_type string, target_uri string, content_length long, payload_digest string, "
    "payload_length long, refers_to string, headers map<string,string>, payload binary"
)
# Fixed values of the format: header names of the columns, record and profile names.
HEADER_OF = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "content_length": "content-length",
    "payload_digest": "warc-payload-digest",
    "payload_length": "warc-payload-length",  # an extension field, for revisits have no payload
    "refers_to": "warc-refers-to",
}
_VERSION = "WARC/1.1"
_SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EOL = "\r\n"
_BATCH_BYTES = 8 << 20


def mark_revisits(pages: DataFrame, key: str, payload: str, least: int) -> DataFrame:
    """Adds digest (SHA-1, hex), size (bytes) and refers_to (the key it revisits, or null).

    Only payloads that occur more than once are gathered: they become a small table of
    known size, so the join moves no payload while that table can be broadcast and is
    a shuffled, skew-split one beyond.
    """
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    sized = pages.withColumns({"digest": F.sha1(body), "size": F.octet_length(body).cast("long")})
    repeated = (
        sized.where(F.col("size") >= least).groupBy("digest", "size")
        .agg(F.max(key).alias("first_key"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    kept = materialize(repeated, "payloads")
    marked = sized.join(kept, ["digest", "size"], "left")
    revisits = F.col("first_key").isNotNull() & ~F.col(key).eqNullSafe(F.col("first_key"))
    return marked.withColumn("refers_to", F.when(revisits, F.col("first_key"))).drop("first_key")


def write(
    pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 1000,
    date: str = "1970-01-01T00:00:00Z", per_file: int = 50_000,
) -> None:
    """One record per row.  Of rows with equal payloads of at least ``least`` bytes the
    one with the largest key is a response and the others are revisits of it; every
    other row is a response.

    A null payload is empty.  A null key counts as smaller than any other; rows that
    repeat the largest key are all responses.  A null url gives no target; blanks and
    control characters in one become %20.  An empty table gives an empty archive.
    """
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(payload).alias("body"))
    marked = mark_revisits(rows, "key", "body", least)
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    target = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    revisit = F.col("refers_to").isNotNull()
    line = lambda head, value: F.concat(F.lit(f"{head}: "), value, F.lit(_EOL))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}Content-Length: "),
        F.col("size").cast("string"), F.lit(_EOL * 2),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.coalesce("body", F.lit(""))))
    record = F.concat(
        F.lit(_VERSION + _EOL),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(F.col("key"))),
        line("WARC-Date", F.lit(date)),
        F.when(target.isNotNull(), line("WARC-Target-URI", target)).otherwise(""),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(_SAME_PAYLOAD)), line("WARC-Refers-To", name(F.col("refers_to")))))
        .otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Payload-Length", F.col("size").cast("string")),
        F.lit(f"Content-Type: application/http; msgtype=response{_EOL}"),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit(_EOL), F.col("block"),
    )
    (
        marked.withColumn("block", block).select(record.alias("value"))
        .write.option("lineSep", _EOL * 2).option("maxRecordsPerFile", per_file).text(path)
    )


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of every file under ``path``; see ``SCHEMA``."""
    spark.dataSource.register(WarcSource)
    spark.conf.set(PUSHDOWN, "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


class WarcSource(DS.DataSource):
    """Options: path (a folder or file that pyarrow.fs can open), payload (true, or false
    to leave every payload null), partitionBytes (files planned into one task)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(
            self.options["path"], self.options.get("payload", "true").lower() == "true",
            int(self.options.get("partitionBytes", 128 << 20)),
        )


@dataclass
class Files(DS.InputPartition):
    paths: tuple[str, ...]


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """A path that names a scheme is opened in that store, any other on the local disk."""
    scheme, found, rest = path.partition(":")
    if found and scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class WarcReader(DS.DataSourceReader):
    _tests = {
        DS.GreaterThan: operator.gt, DS.GreaterThanOrEqual: operator.ge, DS.LessThan: operator.lt,
        DS.LessThanOrEqual: operator.le, DS.EqualTo: operator.eq, DS.In: lambda value, wanted: value in wanted,
        DS.StringStartsWith: str.startswith, DS.StringEndsWith: str.endswith, DS.StringContains: operator.contains,
    }

    def __init__(self, path: str, payload: bool, partition_bytes: int):
        self.path, self.payload, self.partition_bytes = path, payload, partition_bytes
        self.pushed: list[DS.Filter] = []

    def pushFilters(self, filters: list[DS.Filter]) -> Iterable[DS.Filter]:
        """Predicates on header columns are decided here, the others by Spark."""
        for found in filters:
            known = type(found) in self._tests or isinstance(found, DS.IsNotNull)
            if known and found.attribute[0] in HEADER_OF and len(found.attribute) == 1:
                self.pushed.append(found)
            else:
                yield found

    def wanted(self, row: dict) -> bool:
        for found in self.pushed:
            value = row[found.attribute[0]]
            if value is None:
                return False
            if not isinstance(found, DS.IsNotNull) and not self._tests[type(found)](value, found.value):
                return False
        return True

    def partitions(self) -> list[Files]:
        """Whole files, small ones together, as many bytes to a task as the option says."""
        store, place = opened(self.path)
        info = store.get_file_info(place)
        files = [info] if info.is_file else store.get_file_info(pafs.FileSelector(place, recursive=True))
        prefix = self.path[: self.path.index(":") + 1] + "//" if "://" in self.path and not self.path.startswith("file") else ""
        planned: list[list[str]] = []
        room = 0
        for file in sorted((f for f in files if f.is_file and f.base_name[0] not in "._"), key=lambda f: f.path):
            if not planned or file.size > room:
                planned.append([])
                room = self.partition_bytes
            planned[-1].append(prefix + file.path)
            room -= file.size
        return [Files(tuple(paths)) for paths in planned]

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for path in partition.paths if partition else ():
            store, place = opened(path)
            with store.open_input_file(place) as raw:
                for row in self.records(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw):
                    rows.append(row)
                    held += 500 + len(row["payload"] or b"")
                    if held >= _BATCH_BYTES:
                        yield self.batch(rows)
                        rows, held = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    def records(self, file) -> Iterator[dict]:
        """Headers of every record, and the payload of those that pass."""
        source = Lines(file)
        while (first := source.line()) is not None:
            if not first.strip():
                continue
            if not first.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {first[:60]!r}")
            headers = source.headers()
            row = {column: headers.get(head) for column, head in HEADER_OF.items()}
            length = int(headers["content-length"])
            row["content_length"] = length
            stated = row["payload_length"]
            row["payload_length"] = int(stated) if stated else None
            row |= {"headers": headers, "payload": None}
            if not self.wanted(row):
                source.skip(length)
                continue
            if self.payload and row["record_type"] != "revisit":
                block = source.take(length)
                if headers.get("content-type", "").startswith("application/http"):
                    block = block.partition(b"\r\n\r\n")[2]
                row["payload"] = block
            else:
                source.skip(length)
            yield row


_ARROW = pa.schema([
    *((c, pa.int64() if c.endswith("length") else pa.string()) for c in HEADER_OF),
    ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
])


class Lines:
    """Header lines from a buffer; blocks by exact length, skipped by seeking if possible."""

    _step = 64 << 10

    def __init__(self, file):
        self.file, self.buffer, self.at = file, b"", 0

    def line(self) -> bytes | None:
        while (end := self.buffer.find(b"\n", self.at)) < 0:
            more = self.file.read(self._step)
            if not more:
                rest, self.buffer, self.at = self.buffer[self.at:], b"", 0
                return rest or None
            self.buffer, self.at = self.buffer[self.at:] + more, 0
        found, self.at = self.buffer[self.at:end + 1], end + 1
        return found

    def headers(self) -> dict[str, str]:
        found: dict[str, str] = {}
        while line := (self.line() or b"").strip():
            head, _, value = line.decode("utf-8", "replace").partition(":")
            found[head.strip().lower()] = value.strip()
        return found

    def take(self, length: int) -> bytes:
        have = self.buffer[self.at:self.at + length]
        self.at += len(have)
        more = self.file.read(length - len(have)) if len(have) < length else b""
        if len(have) + len(more) < length:
            raise ValueError("the archive ends inside a record")
        return have + more

    def skip(self, length: int) -> None:
        rest = length - (len(self.buffer) - self.at)
        if rest <= 0:
            self.at += length
        else:
            self.buffer, self.at = b"", 0
            self.file.seek(rest, 1)


def restored(records: DataFrame) -> DataFrame:
    """Digest columns of a read archive: responses by their payload, revisits by their headers."""
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(.*)>$', 1) AS BIGINT)")
    stated = F.regexp_replace("payload_digest", "^sha1:", "")
    revisit = F.col("record_type") == "revisit"
    return records.where(F.col("record_type").isin("response", "revisit")).select(
        number("record_id").alias("page_id"),
        F.when(revisit, F.col("payload_length")).otherwise(F.octet_length("payload")).cast("long").alias("payload_bytes"),
        F.when(revisit, stated).otherwise(F.sha1("payload")).alias("payload_digest"),
        "record_type",
        F.when(revisit, number("refers_to")).alias("refers_to"),
    )


