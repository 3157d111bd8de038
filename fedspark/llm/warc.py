"""WARC archives written and read by Spark, and their capture index merged from sorted runs."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, rows_at_once, spread, table, temporary_folder, written

#: Payloads from this size on are stored once.
LEAST_BYTES = 1000
#: Payload bytes of one archive file, about; and captures of one range of the merged index.
FILE_BYTES, RANGE_CAPTURES = 32 << 20, 50_000
#: Bytes that one step of reading takes from a file.
CHUNK = 1 << 14
#: An empty member of a gzip file. Its last byte is 0, as the last byte of every member of a record under 16 MB.
EMPTY = zlib.compress(b"", 9, 31)
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The first capture's time where a table has none: 2024-01-01.
EPOCH = 1_704_067_200

CAPTURE = "run string, nth long, url_key string, captured long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, offset long, length long"
_COLUMNS = [x.split()[0] for x in CAPTURE.split(", ")]
_SCHEMA = pa.schema([(x.split()[0], {"string": pa.string(), "long": pa.int64()}[x.split()[1]]) for x in CAPTURE.split(", ")])
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)", re.S)


def url_key(url: str | None) -> str:
    """The host's labels from the last to the first, without www., port and user, then path and query; no fragment."""
    if url is None:
        return ""
    m = _URL.match(url)
    if not m:
        return url.partition("#")[0]
    host = re.sub(r":[0-9]*$", "", m[1].rpartition("@")[2].lower()).removeprefix("www.")
    rest = m[2] if m[2].startswith("/") else "/" + m[2]
    return ",".join(reversed(host.split("."))) + ")" + rest


def _id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page(record_id: str) -> int | None:
    name = record_id[len("<urn:x-page:") : -1]
    return None if name == "none" else int(name)


def record(page_id: int | None, url: str | None, captured: int, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A record as one member of a gzip file: the HTTP response, or a revisit with the response's header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_id(page_id)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Date: {datetime.fromtimestamp(captured, UTC):%Y-%m-%dT%H:%M:%SZ}")
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if revisit:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_id(refers_to)}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return zlib.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", 6, 31)


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each member of a gzip file that isn't empty."""
    at, view = 0, memoryview(data)
    while at < len(data):
        unpack, parts, fed = zlib.decompressobj(31), [], at
        while not unpack.eof:
            if fed >= len(data):
                raise ValueError("the last record is cut off")
            parts.append(unpack.decompress(view[fed : fed + CHUNK]))
            fed += CHUNK
        end = min(fed, len(data)) - len(unpack.unused_data)
        if content := b"".join(parts):
            yield at, end - at, content
        at = end


def parse(content: bytes) -> dict:
    """A record's fields, and its payload's size and digest: those of the payload itself, or for a revisit those it states."""
    head, _, rest = content.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"record {fields['WARC-Record-ID']} doesn't end where it should")
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    size = int(re.search(rb"\r\nContent-Length: ([0-9]+)", http)[1])
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != stated):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} isn't what was archived")
    url = fields.get("WARC-Target-URI")
    return {
        "url_key": url_key(url), "captured": int(datetime.strptime(fields["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC).timestamp()), "page_id": _page(fields["WARC-Record-ID"]), "url": url,
        "payload_bytes": size, "payload_digest": stated, "record_type": fields["WARC-Type"], "refers_to": _page(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
    }


def with_twins(captures: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Adds digest, revisit and refers_to: of captures (page_id, url, captured, payload) with equal payloads of `least`
    bytes, those with the largest page_id are responses and others revisit them; null ids are the smallest.

    Payloads are told apart by SHA-1 and size. Only digests are grouped; the table of those that occur more than once
    joins back as its size allows, and payloads move only where it is too large to be broadcast.
    """
    digest, size = F.sha1("payload"), F.octet_length("payload")
    narrow = captures.select("page_id", digest.alias("_digest"), size.alias("_size")).filter(F.col("_size") >= least)
    twins = narrow.groupBy("_digest", "_size").agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1 and _first is not null").drop("_n")
    twins = written(twins, "twins")
    rows = captures.withColumn("digest", digest).join(twins, (F.col("digest") == F.col("_digest")) & (size == F.col("_size")), "left")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return rows.select("page_id", "url", "captured", "payload", "digest", F.when(revisit, F.col("_first")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(captures: DataFrame, folder: str, per_file: int) -> None:
    """Captures with their twins as .warc files below folder, `per_file` records each at most, every record a gzip member.

    Spark's own writer of lines commits the files, so tasks may be repeated and the folder may be in any store: a line is a
    member without its last byte, and the line's end is that byte, 0. (A member that ends with another byte is followed by an
    empty one.)
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "captured", "payload", "digest", "refers_to", "revisit")]
            made = [record(*(c[row].as_py() for c in columns)) for row in range(len(batch))]
            yield pa.RecordBatch.from_arrays([pa.array([(m if m[-1] == 0 else m + EMPTY)[:-1] for m in made], pa.binary())], names=["line"])

    lines = captures.mapInArrow(run, "line binary")
    lines.select(F.col("line").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", per_file).text(folder)


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the archives below folder, checked against its digest: a run for each file, in the order of URL key,
    time and page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                name = path.as_py().rpartition("/")[2]
                rows = [parse(found) | {"offset": at, "length": n, "run": name} for at, n, found in members(content.as_py())]
                rows.sort(key=lambda r: (r["url_key"], r["captured"], r["page_id"] is not None, r["page_id"] or 0))
                for nth, r in enumerate(rows):
                    r["nth"] = nth
                yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    with rows_at_once(spark, 1):  # a file is one row
        return written(files.select("path", "content").mapInArrow(run, CAPTURE), "runs")


class LoserTree:
    """Merges k sorted lists: inner nodes hold the losers of their matches, so each next item costs one match a level."""

    def __init__(self, runs: list[list]):
        self.runs, self.k = runs, len(runs)
        self.at = [0] * self.k
        self.tree = [-1] * self.k  # tree[0] is the winner
        for run in range(self.k):
            self._play(run)

    def _beats(self, a: int, b: int) -> bool:
        """Whether run a's next item stands before run b's; a run at its end loses, and equal items go by run."""
        if self.at[a] >= len(self.runs[a]):
            return False
        if self.at[b] >= len(self.runs[b]):
            return True
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return x < y or (x == y and a < b)

    def _play(self, run: int) -> None:
        winner, node = run, (run + self.k) // 2
        while node > 0:
            if self.tree[node] == -1:  # while it is built: the first to arrive waits
                self.tree[node] = winner
                return
            if self._beats(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while self.k and self.at[run := self.tree[0]] < len(self.runs[run]):
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            self._play(run)


def merge_runs(runs: DataFrame, per_range: int = RANGE_CAPTURES) -> DataFrame:
    """All captures in one order, by URL key, time and page: `place` counts them from 0, `capture` those of a URL key.

    Ranges of that order go to a task each, whose piece of every run is still sorted; a loser tree merges the pieces. A
    hot URL's history falls into several ranges, and its count goes on from one to the next. The driver sees a row a range.
    """
    spark = runs.sparkSession
    order = ["url_key", "captured", "page_id", "run", "nth"]
    ranges = spread(spark, runs.count(), per_range)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches), _SCHEMA)
        if not len(held):
            return
        keys = [held.column(c).to_pylist() for c in order]
        own: dict[str, list[int]] = {}
        for row, (name, nth) in enumerate(zip(keys[3], keys[4])):
            own.setdefault(name, []).append(row)
        pieces = []
        for name in sorted(own):
            if any(keys[4][a] > keys[4][b] for a, b in zip(own[name], own[name][1:])):  # parts of a run came in another order
                own[name].sort(key=keys[4].__getitem__)
            pieces.append([(keys[0][r], keys[1][r], keys[2][r] is not None, keys[2][r] or 0, name, keys[4][r], r) for r in own[name]])
        places = [item[-1] for item in LoserTree(pieces)]
        merged = held.take(pa.array(places))
        names = merged.column("url_key").combine_chunks()
        new = np.concatenate(([True], np.asarray(names[1:].to_pylist(), object) != np.asarray(names[:-1].to_pylist(), object))) if len(names) > 1 else np.ones(1, bool)
        nth = np.arange(len(places), dtype=np.int64)
        capture = nth - np.maximum.accumulate(np.where(new, nth, 0))
        number = pa.array(np.full(len(places), TaskContext.get().partitionId(), np.int32))
        out = pa.Table.from_arrays([number, pa.array(nth), pa.array(capture), *merged.columns], names=["range", "place", "capture", *_COLUMNS])
        yield from out.to_batches(max_chunksize=10_000)

    dealt = runs.repartitionByRange(ranges, *order).mapInArrow(run, f"range int, place long, capture long, {CAPTURE}")
    merged = written(dealt, "merged")
    seen = merged.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.min("url_key").alias("first"), F.max("url_key").alias("last"), F.max_by("capture", "place").alias("more")).orderBy("range").collect()
    at, last, open_, starts = 0, None, 0, []
    for r in seen:
        carry = open_ if r["first"] == last else 0
        starts.append((r["range"], at, r["first"], carry))
        at, last, open_ = at + r["n"], r["last"], r["more"] + 1 + (carry if r["first"] == r["last"] else 0)
    begin = spark.createDataFrame(starts, "range int, _at long, _first string, _carry long")
    rows = merged.join(begin, "range")  # a row for each range
    return rows.select((F.col("place") + F.col("_at")).alias("place"), (F.col("capture") + F.when(F.col("url_key") == F.col("_first"), F.col("_carry")).otherwise(0)).alias("capture"), *_COLUMNS)


def archive(captures: DataFrame, folder: str, least: int = LEAST_BYTES, file_bytes: int = FILE_BYTES, per_range: int = RANGE_CAPTURES) -> DataFrame:
    """Captures (page_id, url, captured, payload) written as archives below folder, read back and indexed in one order.

    A null payload is empty and a null time the epoch of EPOCH. A null url has an empty key, and no field in its record; a
    url's control characters are percent-encoded. Rows with equal page_ids and payloads are responses each, if they have the largest
    id. An empty table gives an empty index. A page is held whole in a task, and a file's records are indexed together.
    """
    rows = captures.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("captured").cast("long"), F.lit(EPOCH)).alias("captured"), F.coalesce("payload", F.lit(b"")).alias("payload"))
    mean = rows.agg(F.avg(F.octet_length("payload"))).first()[0]
    with rows_at_once(rows.sparkSession, 256):
        write_archives(with_twins(rows, least), folder, max(1, int(file_bytes // max(mean or 0, 256))))
    runs = read_runs(rows.sparkSession, folder)
    merged = merge_runs(runs, per_range)
    forget(runs)
    return merged


def page_captures(pages: DataFrame) -> DataFrame:
    """Pages as captures; the table has no times, so a page's is its id in seconds from EPOCH on."""
    seconds = F.lit(EPOCH) + F.coalesce(F.pmod(F.col("page_id"), F.lit(1_000_000_000)), F.lit(0))
    return pages.select("page_id", "url", seconds.alias("captured"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each page as its record in the archives says, with its place in the merged index; edge cases are those of
    archive()."""
    found = archive(page_captures(table(spark, sf_dir, "pages")), temporary_folder(spark, "warc"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture", "place")


OP11_SQL = f"""with p as materialized (select page_id, encode(coalesce(html, '')) as b, coalesce(url, '') as url from pages),
d as materialized (select page_id, octet_length(b) as payload_bytes, lower(sha1(b)) as payload_digest, url, max(page_id) over (partition by lower(sha1(b)), octet_length(b)) as first from p),
h as (select *, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*@)?([^/?#]*)', 2)), ':[0-9]*$', ''), '^www\\.', '') as host,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) as rest, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://') as full_url from d),
k as (select *, case when full_url then array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || case when rest like '/%' then rest else '/' || rest end else split_part(url, '#', 1) end as url_key from h)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= {LEAST_BYTES} and first <> page_id then 'revisit' else 'response' end as record_type,
case when payload_bytes >= {LEAST_BYTES} and first <> page_id then first end as refers_to, url_key,
row_number() over (partition by url_key order by page_id) - 1 as capture, row_number() over (order by url_key, page_id) - 1 as place from k"""
