"""WARC archives with a two-level capture index.

Pages are range-partitioned and sorted by their reversed-host URL key
(``com,example,www)/path``), and each partition writes an archive of gzip
members together with its index in the same order:

* level two: blocks of index lines (key, id, place of the record), compressed;
* level one: a sparse directory, the first key of each block.

A lookup binary-searches the archives' first keys, then one directory, then one
block, and reads just the record's range.  Reading all back is a lookup of all keys:
sorted keys are searched in the directories by ranges, and what they ask of a block is
then one range of the index and one of the archive.

Records whose payload an earlier page has are revisits.  Which they are is
decided on digests alone; markers travel with the pages through one and the same
range exchange, so page contents are shuffled once.  Files are written through
Arrow's file systems below a shared folder, under names no other attempt has;
the directory lists those of successful tasks only.
"""

from __future__ import annotations

import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortweave.llm._store import filesystem, fresh_dir, partitions, read_range, stored

MIN_REVISIT = 100
BLOCK_LINES = 512
BLOCK_BYTES = 4 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACES = str.maketrans("\t\r\n", "   ")


def url_key(url: Column) -> Column:
    """The reversed-host key of a URL; what has no host sorts first, with an empty one."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    prefix = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)(?::[0-9]*)?"
    host = F.lower(F.regexp_extract(text, prefix, 1))
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(text, prefix, ""))
    return F.translate(key, "\t\r\n", "   ")  # keys that this makes equal are looked up together


def escaped(page_id: str | None) -> str:
    """An id as it stands in records and index lines: what could end a field is per cent encoded; null is empty, the empty id ``%``."""
    return "" if page_id is None else quote(page_id, safe=" !\"#$&'()*+,-./:;=?@[]^_`{|}~", errors="surrogatepass") or "%"


def unescaped(field: str) -> str | None:
    """The id that :func:`escaped` wrote."""
    return None if not field else "" if field == "%" else unquote(field, errors="surrogatepass")


def record(page_id: str | None, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One gzip member: a response record, or a revisit record that keeps the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{escaped(page_id)}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url.translate(_SPACES)}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{escaped(refers_to)}>"]
    block = head + payload if refers_to is None else head
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + packer.flush()


@dataclass
class Capture:
    """A record read back; ``payload`` is None for a revisit."""

    page_id: str | None
    url: str
    record_type: str
    refers_to: str | None
    payload_bytes: int
    payload_digest: str
    payload: bytes | None


def parse(member: bytes) -> Capture:
    """A record from its gzip member; raises if the payload does not have the digest stated."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    page = unescaped(fields["WARC-Record-ID"][10:-1])
    kind = fields["WARC-Type"]
    if kind == "response":
        got = hashlib.sha256(payload).hexdigest()
        if got != digest or len(payload) != size:
            raise ValueError(f"record of page {page}: payload is not what its header says")
        return Capture(page, fields["WARC-Target-URI"], kind, None, size, got, payload)
    return Capture(page, fields["WARC-Target-URI"], kind, unescaped(fields["WARC-Refers-To"][10:-1]), size, digest, None)


def _page_rows(df: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), html.cast("binary").alias("payload"), url_key(F.col(url_col)).alias("key"))


def write_archives(df: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all rows below ``root``; the directory: ``part, first_key, at, size, lines, from, to`` of each block.

    Of records with equal payloads of ``MIN_REVISIT`` bytes or more, those of the
    smallest id are responses and the others revisit it.  Null pages are empty
    payloads; null urls sort first; a null id is never the smallest; repeated rows
    are repeated records; an empty table gives an empty directory.
    """
    spark = df.sparkSession
    pages = _page_rows(df, id_col, url_col, html_col)
    keys = pages.filter(F.length("payload") >= MIN_REVISIT).select("id", "key", F.sha2("payload", 256).alias("digest"))
    keys = stored(keys, "digests")
    first = keys.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null")
    marks = keys.join(first.select(F.col("digest").alias("d"), "first"), F.col("digest") == F.col("d")).filter(~F.col("id").eqNullSafe(F.col("first")))
    marks = marks.select("key", "id", F.lit(0).alias("rank"), F.lit("").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", F.col("first").cast("string").alias("refers"))
    none = F.lit(None).cast("string")
    rows = pages.select("key", "id", F.lit(1).alias("rank"), "url", "payload", none.alias("digest"), none.alias("refers")).unionByName(marks)
    rows = rows.repartitionByRange(partitions(spark), "key", "id").sortWithinPartitions("key", "id", "rank")
    rows = rows.select("key", F.col("id").cast("string").alias("id"), "rank", "url", "payload", "digest", "refers")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = filesystem(root)
        part = f"part-{uuid.uuid4().hex}"
        archive = index = None
        at = start = index_at = 0
        lines: list[str] = []
        directory: list[tuple] = []
        now, known = None, {}

        def close_block() -> None:
            nonlocal lines, start, index_at
            if lines:
                packed = zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass"), 6)
                index.write(packed)
                directory.append((part, lines[0].split("\t", 1)[0], index_at, len(packed), len(lines), start, at))
                index_at += len(packed)
                lines, start = [], at

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key, page, rank, url, payload, digest, refers = row
                if (key, page) != now:
                    now, known = (key, page), {}
                if not rank:
                    known[digest] = refers
                    continue
                if archive is None:
                    for folder in ("archive", "index", "directory"):
                        files.create_dir(f"{base}/{folder}", recursive=True)
                    archive, index = files.open_output_stream(f"{base}/archive/{part}.warc.gz", compression=None), files.open_output_stream(f"{base}/index/{part}.idx", compression=None)
                digest = hashlib.sha256(payload).hexdigest()  # noqa: PLW2901
                member = record(page, url, payload, digest, known.get(digest) if len(payload) >= MIN_REVISIT else None)
                archive.write(member)
                lines.append(f"{key}\t{escaped(page)}\t{at}\t{len(member)}")
                at += len(member)
                if len(lines) >= BLOCK_LINES or at - start >= BLOCK_BYTES:
                    close_block()
        if archive is not None:
            close_block()
            archive.close()
            index.close()
            with files.open_output_stream(f"{base}/directory/{part}.dir") as f:
                f.write("\n".join("\t".join(map(str, d[1:])) for d in directory).encode("utf-8", "surrogatepass"))
        if directory:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*directory, strict=True)], ["part", "first_key", "at", "size", "lines", "from", "to"])

    directory = stored(rows.mapInArrow(write, "part string, first_key string, at long, size long, lines long, `from` long, `to` long"), "directory")
    firsts = directory.groupBy("part").agg(F.min("first_key").alias("key")).orderBy("key", "part").coalesce(1)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = filesystem(root)
        lines = [f"{key}\t{part}" for b in batches for part, key in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        if lines:  # one line an archive
            with files.open_output_stream(f"{base}/parts") as f:  # every attempt writes the same
                f.write("\n".join(lines).encode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([pa.array([len(lines)], pa.int64())], ["n"])

    firsts.mapInArrow(top, "n long").collect()
    return directory


def _block(files, base: str, part: str, at: int, size: int) -> list[list[str]]:  # noqa: ANN001
    packed = read_range(files, f"{base}/index/{part}.idx", at, size)
    return [x.rsplit("\t", 3) for x in zlib.decompress(packed).decode("utf-8", "surrogatepass").split("\n")]


class CaptureIndex:
    """The archives' index below ``root``: first keys of all archives (one line each), directories when needed."""

    def __init__(self, root: str) -> None:
        self.files, self.base = filesystem(root)
        self.parts: list[list[str]] = []
        if self.files.get_file_info(f"{self.base}/parts").type.name == "File":
            with self.files.open_input_file(f"{self.base}/parts") as f:
                self.parts = [x.rsplit("\t", 1) for x in f.read().decode("utf-8", "surrogatepass").split("\n") if x]
        self.firsts = [x[0] for x in self.parts]
        self.open: dict[str, tuple[list[str], list[list[str]]]] = {}

    def _directory(self, part: str) -> tuple[list[str], list[list[str]]]:
        if part not in self.open:
            if len(self.open) >= 4:  # sorted keys come to a directory once
                self.open.pop(next(iter(self.open)))
            with self.files.open_input_file(f"{self.base}/directory/{part}.dir") as f:
                rows = [x.rsplit("\t", 5) for x in f.read().decode("utf-8", "surrogatepass").split("\n")]
            self.open[part] = [r[0] for r in rows], rows
        return self.open[part]

    def blocks(self, key: str) -> Iterator[tuple[str, int, int, int, int]]:
        """``part, at, size, from, to`` of the index blocks that can hold a key, by two binary searches."""
        k = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while k < len(self.parts) and self.firsts[k] <= key:
            firsts, rows = self._directory(self.parts[k][1])
            for r in rows[max(0, bisect.bisect_left(firsts, key) - 1) : bisect.bisect_right(firsts, key)]:
                yield self.parts[k][1], int(r[1]), int(r[2]), int(r[4]), int(r[5])
            k += 1

    def within(self, part: str, at: int, size: int, keys: list[str]) -> list[tuple[int, int]]:
        """Places and sizes of the block's records of these keys, by binary search."""
        lines = _block(self.files, self.base, part, at, size)
        names = [x[0] for x in lines]
        out = []
        for key in keys:
            out += [(int(x[2]), int(x[3])) for x in lines[bisect.bisect_left(names, key) : bisect.bisect_right(names, key)]]
        return out

    def lookup(self, key: str) -> list[Capture]:
        """All captures of a key (see :func:`url_key`), in order."""
        out: list[Capture] = []
        for part, at, size, _, _ in self.blocks(key):
            for start, length in self.within(part, at, size, [key]):
                out.append(parse(read_range(self.files, f"{self.base}/archive/{part}.warc.gz", start, length)))
        return out


def read_archives(keys: DataFrame, root: str, id_type: str = "long") -> DataFrame:
    """Every record of the URL keys in ``key`` (repeated ones count once), read through the index: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    A key that many records share is many blocks, and each block is read by itself.
    """
    n = partitions(keys.sparkSession)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    place = ["part", "at", "size", "from", "to"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CaptureIndex(root)
        for b in batches:
            found = [(*where, key) for key in b.column(0).to_pylist() for where in index.blocks(key)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], [*place, "key"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CaptureIndex(root)
        for b in batches:
            for d in b.to_pylist():
                asked = index.within(d["part"], d["at"], d["size"], d["keys"])
                if not asked:
                    continue
                raw = read_range(index.files, f"{index.base}/archive/{d['part']}.warc.gz", d["from"], d["to"] - d["from"])
                got = [parse(raw[at - d["from"] : at - d["from"] + size]) for at, size in asked]
                cols = [[c.page_id for c in got], [c.payload_bytes for c in got], [c.payload_digest for c in got], [c.record_type for c in got], [c.refers_to for c in got]]
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    sorted_keys = keys.select("key").distinct().repartitionByRange(n, "key").sortWithinPartitions("key")
    where = sorted_keys.mapInArrow(search, "part string, at long, size long, `from` long, `to` long, key string")
    asked = where.groupBy(*place).agg(F.collect_set("key").alias("keys"))  # at most BLOCK_LINES keys a block
    out = asked.mapInArrow(read, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return out.select(F.col("page_id").cast(id_type), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type))


def round_trip(spark: SparkSession, df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", root: str | None = None) -> DataFrame:
    """Write archives of ``df`` below ``root`` (default: the shared folder) and look all its keys up; raises if a record is not found again."""
    root = root or fresh_dir(spark, "warc")
    kind = df.select(F.col(id_col)).schema[0].dataType.simpleString()
    directory = write_archives(df, root, id_col, url_col, html_col)
    got = stored(read_archives(df.select(url_key(F.col(url_col)).alias("key")), root, kind), "captures")
    wrote, read = directory.agg(F.sum("lines")).first()[0] or 0, got.count()
    if wrote != read:
        raise RuntimeError(f"{wrote} records were written and {read} found through the index")
    return got
