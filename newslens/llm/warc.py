"""WARC archives of pages and a merged index of their captures.

Every task sorts its captures by URL key and time and writes them as archives, one gzip member a record: a
locally sorted run each. Reading the archives back gives the runs' index entries with file, and offset and
length of the member, so a record can be fetched by itself. The entries are dealt to ranges of (URL key,
time), and in every range a loser tree merges the runs, so the ranges one after another are the capture
history of all URLs in order.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newslens.llm.stored import stored

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
REVISIT_BYTES = 100
FIRST_DAY = "2024-01-01 00:00:00"

ARCHIVE_BYTES = 128 << 20  # an archive ends with the record that passes this
RANGE_ROWS = 250_000  # index entries that a task merges
_LAST_ZERO = 1 << 24  # a gzip member of less content ends in a zero byte, the highest of the content's size
_GZIP = 31  # zlib's window bits for gzip

CAPTURE = (
    "url_key string, captured string, page_id bigint, url string, record_type string, refers_to bigint, "
    "payload_bytes bigint, payload_digest string, file string, offset bigint, length bigint"
)


def url_key(url: Column) -> Column:
    """Sort key: host labels from the top domain down, then ``)``, path and query; no scheme, ``www.``, fragment."""
    plain = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(www\d*\.)?|#[\s\S]*$", "")
    host = F.regexp_extract(plain, r"^([^/?:]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.substr(plain, F.length(host) + 1))


def captures(pages: DataFrame, time: Column | None = None) -> DataFrame:
    """Pages as captures, each judged response or revisit: the rows :func:`write_archives` takes.

    Of equal payloads of at least 100 bytes, the one with the smallest ``page_id`` is a response and the others
    revisit it; smaller payloads are all responses. Rows equal in id and payload are all responses, null ids
    revisit any other, null payloads are empty. Without ``time``, captures are a second apart in the order of
    their ids. Only digests are counted by payload, on the map side first.
    """
    moment = F.to_timestamp(F.lit(FIRST_DAY)) + F.make_dt_interval(secs=F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1_000_000_000)))
    rows = pages.select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("payload"),
        F.date_format(moment if time is None else time, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"),
    ).withColumns({
        "url_key": url_key(F.col("url")),
        "payload_bytes": F.octet_length("payload").cast("long"),
        "payload_digest": F.sha2("payload", 256),
    })
    known = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "captured", "url"))
    firsts = rows.filter(F.col("payload_bytes") >= REVISIT_BYTES).groupBy(F.col("payload_digest").alias("of")).agg(
        F.min(known).alias("first"), F.count("*").alias("times")
    ).filter("times > 1")
    # Small payloads look up a key of their own, so that they spread.
    large = F.col("payload_bytes") >= REVISIT_BYTES
    asked = rows.withColumn("asks", F.when(large, F.col("payload_digest")).otherwise(
        F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    ))
    joined = asked.join(firsts, asked["asks"] == firsts["of"], "left")
    revisit = F.col("of").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return joined.select(
        "page_id", "url", "url_key", "captured", "payload_bytes", "payload_digest",
        F.when(revisit, F.col("first.page_id")).alias("refers_to"),
        F.when(revisit, F.col("first.url")).alias("refers_to_url"),
        F.when(revisit, F.col("first.captured")).alias("refers_to_date"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def record(kind: Column) -> Column:
    """The text of a capture's record."""
    def line(name: str, value) -> Column:
        value = value if isinstance(value, Column) else F.lit(value)
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    answer = kind == "response"
    def safe(url: str) -> Column:
        return F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A")

    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(END),
    )
    block = F.when(answer, F.concat(http, F.col("payload"))).otherwise("")
    return F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", _urn(F.col("page_id"))),
        line("WARC-Date", F.col("captured")),
        line("WARC-Target-URI", safe("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        line("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        line("WARC-Profile", F.when(~answer, F.lit(PROFILE))),
        line("WARC-Refers-To", F.when(~answer, _urn(F.col("refers_to")))),
        line("WARC-Refers-To-Target-URI", safe("refers_to_url")),
        line("WARC-Refers-To-Date", F.col("refers_to_date")),
        line("Content-Type", F.when(answer, "application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"), block, F.lit(END),
    )


def packed(text: bytes) -> bytes:
    """A record as one gzip member, without the zero byte that ends it.

    A record of 16 MB and more does not end in one; its last line end is a member of its own, which does.
    """
    def member(content: bytes) -> bytes:
        press = zlib.compressobj(6, zlib.DEFLATED, _GZIP)
        return press.compress(content) + press.flush()

    cut = len(text) if len(text) < _LAST_ZERO else len(text) - 2
    return (member(text[:cut]) + (member(text[cut:]) if cut < len(text) else b""))[:-1]


def write_archives(found: DataFrame, folder: str, records: int = 500, size: int = ARCHIVE_BYTES) -> None:
    """Captures as archives, sorted by URL key, time and id, a gzip member each.

    An archive ends with its last record of ``records`` or the one that passes ``size`` compressed bytes. Members
    end in a zero byte, which is the line separator of Spark's text files; so the archives are committed like
    any other output, on whatever storage the session knows.
    """
    ordered = found.sortWithinPartitions("url_key", "captured", "page_id")

    def run(batches):
        archive = place = held = full = 0
        for batch in batches:
            members, archives = [], []
            for text in batch.column(0):
                members.append(packed(text.as_py().encode("utf-8", "surrogatepass")))
                archives.append(archive)
                held, full = held + 1, full + len(members[-1])
                if held >= records or full >= size:
                    archive, held, full = archive + 1, 0, 0
            places = range(place, place + len(members))
            place += len(members)
            yield pa.RecordBatch.from_arrays(
                [pa.array(archives, pa.int32()), pa.array(places, pa.int64()), pa.array(members, pa.binary())], names=["archive", "place", "member"]
            )

    members = ordered.select(record(F.col("record_type")).alias("text")).mapInArrow(run, "archive int, place bigint, member binary")
    members.sortWithinPartitions("archive", "place").select("archive", F.col("member").cast("string").alias("value")).write.option(
        "lineSep", "\0"
    ).partitionBy("archive").text(folder)


_HEAD = re.compile(rb"^([A-Za-z-]+): (.*)$", re.M)


def _members(content: memoryview) -> Iterator[tuple[int, bytes]]:
    """End and content of every gzip member."""
    at = 0
    while at < len(content):
        plain, parts, step = zlib.decompressobj(_GZIP), [], 4096
        while not plain.eof:
            piece = content[at:at + step]
            if not len(piece):
                raise ValueError("the archive breaks off within a record")
            parts.append(plain.decompress(piece))
            at += len(piece) - len(plain.unused_data)
            step = min(step * 2, 1 << 20)
        yield at, b"".join(parts)


def parse(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, header and block of every record of an archive, or of any stretch of whole records."""
    start, text = 0, b""
    for end, part in _members(memoryview(content)):
        text += part
        split = text.index(b"\r\n\r\n")
        head = {k.decode(): v.rstrip(b"\r").decode("utf-8", "replace") for k, v in _HEAD.findall(text[:split])}
        size = int(head["Content-Length"])
        if len(text) == split + 4 + size + len(END):
            yield start, end - start, head, text[split + 4:split + 4 + size]
            start, text = end, b""
    if text:
        raise ValueError("the archive breaks off within a record")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One index entry per record, file by file; offset and length are of its bytes in the file, digests are taken anew.

    A response whose payload does not have the digest of its header raises an error.
    """
    names = [f.split(" ")[0] for f in CAPTURE.split(", ")]

    def page(urn: str | None) -> int | None:
        text = (urn or "none").removeprefix("<urn:page:").removesuffix(">")
        return None if text == "none" else int(text)

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = []
                for offset, length, head, block in parse(content.as_buffer()):
                    digest, size = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["WARC-Payload-Length"])
                    if head["WARC-Type"] == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4:]
                        if (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, size):
                            raise ValueError(f"damaged record at {offset} of {path}")
                    rows.append((
                        None, head["WARC-Date"], page(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), head["WARC-Type"],
                        page(head.get("WARC-Refers-To")), size, digest, path.as_py(), offset, length,
                    ))
                types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(run, CAPTURE).withColumn("url_key", url_key(F.col("url")))


class LoserTree:
    """Merge of sorted runs: inner nodes remember the loser of a match, the root the overall winner."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.n = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * self.n
        for i in range(self.n):
            self._play(i)

    def _before(self, a: int, b: int) -> bool:
        """Whether run a goes first; a run that is used up goes last, equal heads go by run."""
        x, y = self.heads[a], self.heads[b]
        return y is None and (x is not None or a < b) or x is not None and y is not None and (x, a) < (y, b)

    def _play(self, winner: int) -> None:
        node = (winner + self.n) // 2
        while node:
            if self.losers[node] < 0:  # the first to come waits for its match
                self.losers[node] = winner
                return
            if self._before(self.losers[node], winner):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.n and self.heads[winner := self.losers[0]] is not None:
            yield self.heads[winner]
            self.heads[winner] = next(self.runs[winner], None)
            self._play(winner)


def merged(entries: DataFrame) -> DataFrame:
    """The capture history: entries in the order of URL key, time and id, over all partitions one after another.

    ``entries`` come in runs, one per file and sorted within it. Ranges also split a URL with very many
    captures; null ids come first. A range's entries, without payloads, are what a task holds: about ``RANGE_ROWS``,
    since the number of ranges follows the number of entries.
    """
    runs = stored(entries, "runs")
    ranges = max(runs.sparkSession.sparkContext.defaultParallelism, -(-runs.count() // RANGE_ROWS))
    ranged = runs.repartitionByRange(ranges, "url_key", "captured", "page_id", "file", "offset").sortWithinPartitions("file", "offset")

    names = runs.columns

    def run(batches):
        table = pa.Table.from_batches(list(batches), schema=schema)
        if not table.num_rows:
            return
        rows = table.num_rows
        keys = list(zip(
            *(table[c].to_pylist() for c in ("url_key", "captured")),
            [-(1 << 63) if i is None else i for i in table["page_id"].to_pylist()], range(rows), strict=True,
        ))
        files = table["file"].to_pylist()
        starts = [0, *(i for i in range(1, rows) if files[i] != files[i - 1]), rows]
        tree = LoserTree([iter(keys[a:b]) for a, b in zip(starts, starts[1:], strict=False)])
        yield from table.take(pa.array([k[3] for k in tree], pa.int64())).combine_chunks().to_batches(max_chunksize=10_000)

    types = dict(f.rsplit(" ", 1) for f in CAPTURE.split(", "))
    schema = pa.schema([(c, pa.string() if types[c] == "string" else pa.int64()) for c in names])
    return ranged.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in names))


def archive(
    pages: DataFrame, folder: str, time: Column | None = None, records: int = 500, size: int = ARCHIVE_BYTES
) -> DataFrame:
    """Write pages as archives below ``folder``, read them back and merge their index.

    One row per page in the order of URL key, time and id, with the columns of ``CAPTURE``; empty input
    gives no rows, and columns beside ``page_id, url, html`` are not read. Payloads of any length are archived whole.
    """
    write_archives(captures(pages, time), folder, records, size)
    return merged(read_archives(pages.sparkSession, folder))
