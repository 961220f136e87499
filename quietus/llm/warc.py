"""Deterministic sharded WARC writer, and reader.

Records are dealt to shards by ranges of their key, cut where the payload bytes before a key reach the next multiple of ``shard_bytes``; a key that is heavier than that is cut again by
its payloads' digests. So the shards depend on the table only, not on its partitioning or the cluster. Each shard is a task, written in key order, one gzip member a record, and rolls to a
new file once its compressed size reaches ``roll_bytes``. Headers and digests are made anew from the payload. Files are written under temporary names of their attempt; tasks
publish those that the manifest of successful tasks lists, and the manifest itself comes last, so a lost executor or a repeated task leaves nothing half-written.

Of records with equal payloads of at least ``revisit_bytes`` bytes, the one with the largest key is a response, the others are revisits that refer to it.

Edge cases: a null payload is empty; a null url is written as ``urn:key:<key>``; records with equal key and payload are all responses or revisits alike, with record ids of their own; a null
key is smaller than any other and is written as such; an empty table gives an empty manifest and no rows; other columns are left aside.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quietus.session import cut, scratch

#: All records bear one date, since the table has none: the archive depends on the table only.
DATE = "2000-01-01T00:00:00Z"
#: Payload bytes of a shard, where none are stated: a 4096th of the table's, within these.
LEAST_SHARD, MOST_SHARD, SHARDS = 64 << 20, 1 << 30, 4096
NULL_KEY = -(1 << 63)
#: Compressed bytes that the reader hands to the decompressor at once.
SLICE = 1 << 14


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: int | None, payload_digest: str, copy: int = 0) -> str:
    """Id of the record of a key and payload; ``copy`` tells equal rows apart. A revisit can name the record it refers to without seeing it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key} {payload_digest} {copy}')}>"


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, copy: int = 0) -> bytes:
    """One WARC/1.1 record: a response is an HTTP message that carries the payload; a revisit has the digest of its payload, the HTTP head and no payload."""
    uri = (url or f"urn:key:{'' if key is None else key}").replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20")
    sum_ = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(key, sum_, copy)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{sum_}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"X-Record-Key: {'' if key is None else key}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, sum_)}", f"X-Refers-To-Key: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member with no time and no name."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive of gzip members, from bytes or a stream's ``read``; the archive is gone through once, in slices."""
    if isinstance(source, bytes | bytearray | memoryview):
        from io import BytesIO

        source = BytesIO(source).read
    held = b""
    while True:
        held = held or source(SLICE)
        if not held:
            return
        pack, out = zlib.decompressobj(31), []
        while not pack.eof:
            if not held and not (held := source(SLICE)):
                raise ValueError("an archive ends within a record")
            out.append(pack.decompress(held))
            held = pack.unused_data  # less than a slice
        head, _, rest = b"".join(out).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("a member holds no WARC record")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        yield fields, rest[: int(fields["Content-Length"])]


def payload_of(block: bytes) -> bytes:
    """What follows the head of an HTTP message."""
    return block.partition(b"\r\n\r\n")[2]


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with the scheme that Spark reads it by, so that tasks and Spark mean the same file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def store(folder: str):
    """(file system, path) of a folder's URI; any that pyarrow opens."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


class Shards:
    """Ranges of keys that hold about ``shard_bytes`` each: the first key of each shard, and the keys that are cut within."""

    def __init__(self, rows: DataFrame, shard_bytes: int):
        """``rows``: k (key, null as NULL_KEY), n_bytes. Only totals of partitions, a key for each shard and the keys heavier than a shard come to the driver."""
        self.size = shard_bytes
        sizes = rows.groupBy("k").agg(F.sum("n_bytes").alias("n"))
        parts = cut(sizes.repartitionByRange("k").withColumn("part", F.spark_partition_id()))
        totals = {r["part"]: r["n"] for r in parts.groupBy("part").agg(F.sum("n").alias("n")).collect()}
        before, start = 0, []
        for part in sorted(totals):
            start.append((part, before))
            before += totals[part]
        offsets = F.broadcast(rows.sparkSession.createDataFrame(start, "part int, start long"))  # a row for each partition
        running = F.sum("n").over(Window.partitionBy("part").orderBy("k")) - F.col("n")
        placed = cut(parts.withColumn("own", running).join(offsets, "part").select("k", "n", (F.col("start") + F.col("own")).alias("before")))
        heavy = placed.where(F.col("n") > shard_bytes).orderBy("k").collect()
        first = placed.groupBy(F.floor(F.col("before") / shard_bytes).alias("shard")).agg(F.min("k").alias("k")).orderBy("k").collect()
        self.first, self.shard = (np.array([r[c] for r in first], np.int64) for c in ("k", "shard"))
        self.heavy, self.weight, self.before = (np.array([r[c] for r in heavy], np.int64) for c in ("k", "n", "before"))
        self.count = int(max([*self.shard, *((self.before + self.weight) // shard_bytes), -1])) + 1

    def of(self, keys: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Shard of each key; ``share``, in [0, 1), is the place of its payload's digest among a heavy key's."""
        shard = self.shard[np.searchsorted(self.first, keys, "right") - 1]
        if len(self.heavy):
            at = np.minimum(np.searchsorted(self.heavy, keys), len(self.heavy) - 1)
            within = (self.before[at] + (share * self.weight[at]).astype(np.int64)) // self.size
            shard = np.where(self.heavy[at] == keys, within, shard)
        return shard.astype(np.int32)


def revisits(pages: DataFrame, revisit_bytes: int) -> DataFrame:
    """(key, payload_digest, refers_to) of the records that revisit another; from digests, so no payload moves."""
    # Two independent digests and the length tell payloads apart.
    same = ["payload_digest", "other_digest", "n_bytes"]
    rows = pages.select("key", F.sha1("payload").alias("payload_digest"), F.xxhash64("payload").alias("other_digest"), F.octet_length("payload").alias("n_bytes"))
    last = rows.where(F.col("n_bytes") >= revisit_bytes).groupBy(*same).agg(F.max("key").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    return rows.join(last, same).where(~F.col("key").eqNullSafe(F.col("refers_to"))).select("key", "payload_digest", "refers_to").distinct()


def write(pages: DataFrame, folder: str, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html", roll_bytes: int = 1 << 30, shard_bytes: int | None = None, revisit_bytes: int = 0) -> list[dict]:
    """Write an archive below ``folder`` (a folder that all executors share) and return its manifest, which is also written there as manifest.json."""
    spark = pages.sparkSession
    folder = qualified(spark, folder)
    key = F.coalesce(F.col("key"), F.lit(NULL_KEY))
    rows = pages.select(F.col(key_col).cast("long").alias("key"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    sizes = rows.select(key.alias("k"), F.octet_length("payload").alias("n_bytes"))
    whole = sizes.agg(F.sum("n_bytes").alias("n"), F.count("*").alias("rows")).first()
    files, path = store(folder)
    files.create_dir(f"{path}/_temporary", recursive=True)
    listed = []
    if whole["rows"]:
        shards = Shards(sizes, shard_bytes or max(LEAST_SHARD, min(MOST_SHARD, whole["n"] // SHARDS)))
        shipped = spark.sparkContext.broadcast(shards)  # some 16 bytes a shard

        @F.pandas_udf("int")
        def shard_of(k: pd.Series, share: pd.Series) -> pd.Series:
            return pd.Series(shipped.value.of(k.to_numpy(np.int64), share.to_numpy(np.float64)))

        shard = shard_of(key, F.conv(F.substring("payload_digest", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))).alias("shard")
        # A revisit's reference is a row of its own that sorts just before its record: payloads are shuffled once, whatever the number of revisits.
        marks = revisits(rows, revisit_bytes).select("key", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "payload_digest", "refers_to", F.lit(False).alias("page"))
        rows = rows.select("key", "url", "payload", F.sha1("payload").alias("payload_digest"), F.lit(None).cast("long").alias("refers_to"), F.lit(True).alias("page")).unionByName(marks)
        order = [F.asc_nulls_first("key"), "payload_digest", "page", "url"]
        # The one run of the writer: the driver gets a row for each file.
        listed = rows.select(shard, "*").repartitionById(shards.count, "shard").sortWithinPartitions(*order).mapInPandas(_writer(folder, roll_bytes), "shard int, roll int, temporary string, records long, bytes long, first_key long, last_key long, sha1 string").collect()
    manifest, moves = [], []
    for row in sorted(listed, key=lambda r: (r["shard"], r["roll"])):
        name = f"shard-{row['shard']:06d}-{row['roll']:05d}.warc.gz"
        moves.append((row["temporary"], name))
        manifest.append({"file": name} | {k: row[k] for k in ("records", "bytes", "first_key", "last_key", "sha1")})
    if moves:
        spark.createDataFrame(moves, "temporary string, name string").repartition(min(len(moves), 64)).mapInPandas(_publisher(folder), "name string").count()
    with files.open_output_stream(f"{path}/_manifest.tmp", compression=None) as out:
        out.write(json.dumps(manifest, indent=1).encode())
    files.move(f"{path}/_manifest.tmp", f"{path}/manifest.json")
    files.delete_dir(f"{path}/_temporary")  # with what attempts that failed have left
    return manifest


def _publisher(folder: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileType

        files, path = store(folder)
        for pdf in frames:
            for temporary, name in zip(pdf["temporary"], pdf["name"], strict=True):
                # A repeated task finds what the lost one has moved.
                if files.get_file_info(f"{path}/{temporary}").type != FileType.NotFound:
                    files.move(f"{path}/{temporary}", f"{path}/{name}")
                elif files.get_file_info(f"{path}/{name}").type == FileType.NotFound:
                    raise ValueError(f"{temporary} is gone")
            yield pdf[["name"]]

    return run


def _writer(folder: str, roll_bytes: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, path = store(folder)
        out, done, now, mark, same, copy = None, [], {}, None, None, 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                out = None
                now["sha1"] = now.pop("sum").hexdigest()
                done.append(dict(now))

        for pdf in frames:
            for shard, key, url, payload, sha1, refers, page in zip(*(pdf[c] for c in ("shard", "key", "url", "payload", "payload_digest", "refers_to", "page")), strict=True):
                key = None if pd.isna(key) else int(key)
                if not page:
                    mark = key, sha1, int(refers)
                    continue
                refers = mark[2] if mark and mark[:2] == (key, sha1) else None
                copy = copy + 1 if same == (key, sha1) else 0
                same = key, sha1
                if out is None:
                    roll = now["roll"] + 1 if now else 0
                    now = {"shard": int(shard), "roll": roll, "temporary": f"_temporary/{uuid.uuid4().hex}", "records": 0, "bytes": 0, "first_key": key, "sum": hashlib.sha1()}
                    out = files.open_output_stream(f"{path}/{now['temporary']}", compression=None)
                data = member(record(key, url if isinstance(url, str) else None, bytes(payload), refers, copy))
                out.write(data)
                now["sum"].update(data)
                now |= {"records": now["records"] + 1, "bytes": now["bytes"] + len(data), "last_key": key}
                if now["bytes"] >= roll_bytes:
                    close()
        close()
        if done:
            yield pd.DataFrame(done).astype({"first_key": "Int64", "last_key": "Int64"})

    return run


def read(spark: SparkSession, folder: str, manifest: list[dict]) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of the records of a published archive; a task reads a file as a stream. A revisit's payload is empty.

    A record whose block, or a response whose payload, does not have the digest its header states raises.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    if not manifest:
        return spark.createDataFrame([], schema)
    folder = qualified(spark, folder)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, path = store(folder)
        for pdf in frames:
            for name in pdf["file"]:
                rows, held = [], 0
                with files.open_input_stream(f"{path}/{name}", compression=None, buffer_size=1 << 20) as stream:
                    for head, block in records(stream.read):
                        payload = payload_of(block)
                        stated = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if head["WARC-Block-Digest"] != f"sha1:{digest(block)}" or (head["WARC-Type"] == "response" and stated != digest(payload)):
                            raise ValueError(f"{head['WARC-Record-ID']} does not match its digest")
                        number = lambda field: int(head[field]) if head.get(field) else None  # noqa: B023, E731
                        rows.append((number("X-Record-Key"), head["WARC-Target-URI"], int(head["X-Payload-Length"]), stated, head["WARC-Type"], number("X-Refers-To-Key"), payload))
                        held += len(payload)
                        if held > 16 << 20 or len(rows) >= 20_000:
                            yield _frame(rows)
                            rows, held = [], 0
                yield _frame(rows)

    listed = [(k, m["file"]) for k, m in enumerate(manifest)]
    return spark.createDataFrame(listed, "k int, file string").repartitionById(len(listed), "k").select("file").mapInPandas(run, schema)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
    return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to an archive in the shared folder and read it back: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    folder = scratch(pages.sparkSession, "warc")
    manifest = write(pages, folder, **options)
    found = read(pages.sparkSession, folder, manifest)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
