"""WARC archives: a deterministic sharded writer and a reader.

Records are range-partitioned and sorted by id, with bounds that depend on the ids alone. A task
writes its range in files that roll at a compressed size, one gzip member for each record, under a
temporary name of its own attempt; what it wrote is a manifest row. Only files of the manifest get
their final names, and the index file is written last: its presence is the commit. A task that runs
twice leaves a file that no manifest names, and it goes with the temporary folder.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import batches_of, ship

ship(__name__)

#: Roll a file beyond this many compressed bytes.
ROLL_BYTES = 256_000_000
#: Ids that the bounds of the ranges are taken from: at most about this many, chosen by their hash.
BOUND_IDS = 50_000
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "part int, file int, temp string, records bigint, bytes bigint, sha256 string"
RECORD = (
    "page_id bigint, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string,"
    " target_uri string, payload binary"
)


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int) -> str:
    return f"<urn:page:{page_id}>"


def safe_uri(url: str | None) -> str:
    """The url with blanks and control characters percent-encoded, so that it stays one header line."""
    return re.sub(r"[\x00-\x20\x7f\x85  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "")


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record with its headers and digests made anew; a revisit holds no payload."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {safe_uri(url)}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[-1:-1] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple:
    """The row of ``RECORD`` in one record; ValueError where a length or digest does not fit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    h = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(h["Content-Length"])]
    if first != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or digest(block) != h["WARC-Block-Digest"][5:]:
        raise ValueError(f"damaged record {h.get('WARC-Record-ID')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size, kind, full = int(re.search(rb"Content-Length: (\d+)", http)[1]), h["WARC-Type"], h["WARC-Payload-Digest"][5:]
    if kind == "response" and (len(payload) != size or digest(payload) != full):
        raise ValueError(f"damaged payload {h['WARC-Record-ID']}")
    number = lambda x: int(x.removeprefix("<urn:page:").removesuffix(">"))
    return (
        number(h["WARC-Record-ID"]), kind, number(h["WARC-Refers-To"]) if kind == "revisit" else None,
        size, full, h["WARC-Target-URI"], payload if kind == "response" else None,
    )


def storage(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and plain path of a folder that driver and executors share."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def range_bounds(ids: DataFrame, parts: int) -> list[int]:
    """Upper bounds of ``parts`` ranges of equal size: quantiles of distinct ids picked by their hash."""
    ids = ids.distinct()
    keep = max(1, ids.count() // BOUND_IDS)
    picked = ids.where(F.pmod(F.xxhash64("_id"), F.lit(keep)) == 0)
    found = np.sort(np.array([r["_id"] for r in picked.collect()], np.int64))
    return [] if not len(found) else np.unique(found[(np.arange(1, parts) * len(found)) // parts]).tolist()


def first_copies(rows: DataFrame, least: int) -> DataFrame:
    """``_id``, ``h`` (SHA-256) and ``_ref`` of each page that repeats the payload of one with a larger id.

    Counts and the largest id are summed up before the exchange; the payloads stay where they are.
    Only repeated payloads are joined, and pages of one payload are dealt to ``SALTS`` keys.
    """
    keyed = rows.select(
        "_id", F.struct(F.sha2("_html", 256).alias("h"), F.octet_length("_html").alias("n")).alias("k"),
        F.pmod(F.xxhash64("_id"), F.lit(SALTS)).alias("s"),
    ).where(F.col("k")["n"] >= least)
    heads = keyed.groupBy("k").agg(F.max("_id").alias("_ref"), F.count("*").alias("c")).where("c > 1")
    salts = F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))
    dealt = heads.select("k", "_ref", F.explode(salts).alias("s"))
    return keyed.join(dealt, ["k", "s"]).where("_id <> _ref").select("_id", "k.h", "_ref").distinct()


SALTS = 16


def archive_index(root: str) -> bool:
    """Whether an archive was completed in the folder; its index is written last."""
    fs, plain = storage(root)
    found = fs.get_file_info(pafs.FileSelector(plain, allow_not_found=True))
    return any(f.base_name.startswith("index-") and fs.get_file_info(f"{f.path}/_SUCCESS").type == pafs.FileType.File for f in found)


def write_warc(
    pages: DataFrame,
    path: str,
    parts: int,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = 0,
    roll_bytes: int = ROLL_BYTES,
) -> DataFrame:
    """Write one record per row below ``path`` and return the manifest, one row per file.

    Among payloads of at least ``least_bytes`` bytes that are equal, that of the largest id is the
    response and the others revisit it; repeated rows of that id are responses each. Rows of one id
    with different payloads are records of their own. Null html is an
    empty payload, a null url an empty one, null ids are an error (a record needs an id). An empty
    table writes an index without files; other columns take no part.

    Names of files follow from ids and sizes alone, so equal input gives equal files. A folder that
    has an index is complete and never written to again: that is an error. Files of a run that failed before its
    index are replaced.
    """
    spark = pages.sparkSession
    root, run = path.rstrip("/"), uuid.uuid4().hex
    if archive_index(root):
        raise ValueError(f"{root} has an archive already; its files have the names that this one's would get")
    rows = pages.select(
        F.coalesce(F.col(id_col), F.raise_error(F.lit("a record needs an id"))).cast("bigint").alias("_id"),
        F.col(url_col).alias("_url"), F.coalesce(html_col, F.lit("")).alias("_html"),
    )
    bounds = range_bounds(rows.select("_id"), parts)
    none = F.lit(None).cast("string")
    refs = first_copies(rows, least_bytes)
    both = refs.select("_id", none.alias("_url"), F.col("h").alias("_html"), "_ref").unionAll(
        rows.select("_id", "_url", "_html", F.lit(None).cast("bigint"))
    )
    placed = both.withColumn("_part", _part_of(bounds)(F.col("_id")))
    # one exchange of the payloads; a page's reference travels as a row of its own and sorts before it
    sorted_rows = placed.repartitionById(len(bounds) + 1, "_part").sortWithinPartitions(
        "_id", F.col("_ref").isNull(), "_url", "_html"
    )
    temp = f"{root}/_temporary-{run}"
    done = sorted_rows.select("_id", "_url", "_html", "_ref", "_part").mapInArrow(_writer(temp, roll_bytes), MANIFEST)
    done.write.mode("overwrite").parquet(f"{root}/_manifest-{run}")
    manifest = spark.read.parquet(f"{root}/_manifest-{run}").withColumn(
        "name", F.format_string("part-%05d-%05d.warc.gz", "part", "file")
    )
    # a rename each, by the tasks; a rename that was done before is left as it is
    manifest.select("temp", "name").mapInArrow(_committer(temp, root), "name string").write.format("noop").mode("overwrite").save()
    fs, plain = storage(root)
    manifest.select("name", "records", "bytes", "sha256").write.mode("overwrite").parquet(f"{root}/index-{run}")
    gone = storage(temp)[1]
    if fs.get_file_info(gone).type == pafs.FileType.Directory:
        fs.delete_dir(gone)
    return spark.read.parquet(f"{root}/index-{run}").withColumn("path", F.concat(F.lit(root + "/"), F.col("name")))


def _part_of(bounds: list[int]):
    @F.pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.asarray(bounds, np.int64), ids.to_numpy(), side="right").astype("int32"))

    return part


def _writer(temp: str, roll_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = storage(temp)
        fs.create_dir(folder, recursive=True)
        attempt = f"{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}"
        out, made, of, refs = None, 0, None, {}

        def closed() -> pa.RecordBatch:
            out["to"].close()
            row = (out["part"], made, out["name"], out["records"], out["bytes"], out["hash"].hexdigest())
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()))],
                [f.split()[0] for f in MANIFEST.split(", ")],
            )

        for whole in batches:
            for batch in batches_of(whole, 200):
                for page, url, html, to, part in zip(*(c.to_pylist() for c in batch.columns)):
                    if page != of:
                        of, refs = page, {}
                    if to is not None:
                        refs[html] = to
                        continue
                    payload = html.encode("utf-8", "surrogatepass")
                    ref = refs.get(hashlib.sha256(payload).hexdigest()) if refs else None
                    data = record(page, url, payload, ref)
                    packed = gzip.compress(data, LEVEL, mtime=0)
                    if out and out["bytes"] + len(packed) > roll_bytes:
                        yield closed()
                        out, made = None, made + 1
                    if out is None:
                        name = f"{attempt}-{made}"
                        out = {"part": part, "name": name, "records": 0, "bytes": 0, "hash": hashlib.sha256(),
                               "to": fs.open_output_stream(f"{folder}/{name}", compression=None)}
                    out["to"].write(packed)
                    out["hash"].update(packed)
                    out["records"] += 1
                    out["bytes"] += len(packed)
        if out:
            yield closed()

    return run


def _committer(temp: str, root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = storage(temp)
        final = storage(root)[1]
        for batch in batches:
            for name, to in zip(*(c.to_pylist() for c in batch.columns)):
                if fs.get_file_info(f"{folder}/{name}").type == pafs.FileType.File:
                    fs.move(f"{folder}/{name}", f"{final}/{to}")
                elif fs.get_file_info(f"{final}/{to}").type != pafs.FileType.File:
                    raise FileNotFoundError(f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column(1)], ["name"])

    return run


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    data = b""
    while True:
        unzip, parts = zlib.decompressobj(31), []
        while not unzip.eof:
            data = data or stream.read(chunk)
            if not data:
                if parts:
                    raise ValueError("an archive ends inside a record")
                return
            parts.append(unzip.decompress(data))
            data = unzip.unused_data
        yield b"".join(parts)


def read_warc(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The records of all files in ``path`` of the manifest, as rows of ``RECORD``, checked by digest.

    A file is read as a stream, a record at a time; a task has one file or a few, dealt by the hash of their paths.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        names = [f.split()[0] for f in RECORD.split(", ")]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, plain = storage(path)
                with fs.open_input_stream(plain, compression=None) as stream:
                    held: list[tuple] = []
                    size = 0
                    for data in members(stream):
                        held.append(parse_record(data))
                        size += len(data)
                        if size > 8_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

    files = manifest.select("path").repartition(max(1, manifest.count()), "path")
    return files.mapInArrow(run, RECORD)
