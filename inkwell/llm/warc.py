"""WARC archives of pages, and their index by an external merge of sorted capture runs.

1. Pages with equal payloads of at least `least_bytes` share one response record, that of the largest id; the others
   become revisit records that refer to it. The groups are summed by digest before any page moves.
2. Each task writes the records of its pages, gzip members of their own, into one archive, and an index entry for
   each. When `run_entries` entries are there they are sorted by URL key and timestamp and written as a run.
3. Runs are merged k ways by a loser tree. Split keys from a few sampled keys of every run cut the key space into
   ranges that are merged independently, each reading only its slice of every run; more than `FAN_IN` runs are first
   merged in groups. The segments, in range order, are the globally ordered capture histories.
4. Reading goes by the index: entry by entry, each record is fetched from its archive by offset and length.

Rows: a null html is an empty payload, a null url the key '-'. A null id never wins a group; its page revisits the
winner if there is one and is a response otherwise. Rows of one id and payload are all responses if the id wins. An
empty table gives no archives and no rows. Files carry the name of the attempt that wrote them; only those of
finished tasks are named in the manifest, so lost executors leave nothing that is read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import common

FAN_IN = 256
_SPARSE = 128
_SAMPLES = 32
_EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Sort-friendly form: reversed host, then path and query; without scheme, `www.`, default port and fragment."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return quote(url, safe="!#$%&'()*+,/:;=?@[]~|{}")
    host = re.sub(r"^www\d*\.", "", host)
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")"
    key += (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return quote(key, safe="!#$%&'()*+,/:;=?@[]~|{}")


class LoserTree:
    """Merges sorted iterators; `pop` gives the least item in about log2(k) comparisons."""

    def __init__(self, sources: list[Iterator]):
        self.sources, self.k = sources, max(1, len(sources))
        self.heads = [next(s, None) for s in sources] or [None]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other == -1:
                self.losers[node] = winner
                return
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        while (item := self.heads[self.losers[0]]) is not None:
            winner = self.losers[0]
            yield item
            self.heads[winner] = next(self.sources[winner], None)
            self._play(winner)


def _header(fields: list[tuple[str, object]]) -> bytes:
    return "".join(f"{k}: {re.sub(r'[\x00-\x1f\x7f]', lambda m: quote(m[0]), str(v))}\r\n" for k, v in fields).encode("utf-8", "replace")


def _record(row: dict, when: datetime) -> bytes:
    payload, kind = row["payload"], "response" if row["refers_to"] is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\n" + _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))]) + b"\r\n"
    block = http + (payload if kind == "response" else b"")
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
        ("WARC-Target-URI", row["url"] or ""),
        ("WARC-Date", when.strftime("%Y-%m-%dT%H:%M:%SZ")),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["digest"])).decode()),
        ("X-Page-ID", "" if row["page_id"] is None else row["page_id"]),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", _REVISIT), ("X-Refers-To-Page-ID", row["refers_to"])]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + _header(fields) + b"\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _write_run(folder: str, name: str, lines: Iterator[str]) -> dict:
    """Sorted lines, and a sparse index of (line, offset) beside them."""
    fs, path = common.open_fs(folder)
    sparse, n, at, last = [], 0, 0, None
    with fs.open_output_stream(f"{path}/{name}") as f:
        for line in lines:
            if n % _SPARSE == 0:
                sparse.append((line, at))
            raw = line.encode("utf-8", "surrogatepass") + b"\n"
            f.write(raw)
            n, at, last = n + 1, at + len(raw), line
    with fs.open_output_stream(f"{path}/{name}.sparse") as f:
        f.write(json.dumps(sparse).encode())
    step = max(1, len(sparse) // _SAMPLES)
    return {"run": name, "n": n, "samples": [k for k, _ in sparse[::step]][: 2 * _SAMPLES], "last": last}


def _slice(folder: str, name: str, low: str | None, high: str | None) -> Iterator[str]:
    """Lines of a run in [low, high)."""
    fs, path = common.open_fs(folder)
    with fs.open_input_file(f"{path}/{name}.sparse") as f:
        sparse = json.loads(f.read())
    start = 0
    if low is not None:
        start = max((at for k, at in sparse if k < low), default=0)
    with fs.open_input_file(f"{path}/{name}") as f:
        f.seek(start)
        rest = b""
        while chunk := f.read(1 << 18):
            *lines, rest = (rest + chunk).split(b"\n")
            for raw in lines:
                line = raw.decode("utf-8", "surrogatepass")
                if high is not None and line >= high:
                    return
                if low is None or line >= low:
                    yield line


_RUNS = "run string, n long, samples array<string>, last string"


def _run_batch(runs: list[dict]) -> pa.RecordBatch:
    strings = pa.list_(pa.string())
    return pa.record_batch(
        [
            pa.array([r["run"] for r in runs], pa.string()),
            pa.array([r["n"] for r in runs], pa.int64()),
            pa.array([r["samples"] for r in runs], strings),
            pa.array([r["last"] for r in runs], pa.string()),
        ],
        ["run", "n", "samples", "last"],
    )


def _archiver(folder: str, run_entries: int):
    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, at, entries, runs = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", None, 0, [], []

        def close_run() -> None:
            runs.append(_write_run(folder, f"run-{name}-{len(runs)}", iter(sorted(entries))))
            entries.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    fs, path = common.open_fs(folder)
                    out = fs.open_output_stream(f"{path}/{name}.warc.gz", compression=None)
                when = _EPOCH + timedelta(seconds=(row["page_id"] or 0) % (1 << 31))
                raw = _gzip(_record(row, when))
                out.write(raw)
                entries.append(f"{url_key(row['url'])} {when:%Y%m%d%H%M%S} {name}.warc.gz {at} {len(raw)}")
                at += len(raw)
                if len(entries) >= run_entries:
                    close_run()
        if out is not None:
            out.close()
        if entries:
            close_run()
        if runs:
            yield _run_batch(runs)

    return archive


def _merger(folder: str):
    """A row (runs, low, high) becomes one merged run of that range."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tree = LoserTree([_slice(folder, r, row["low"], row["high"]) for r in row["runs"]])
                yield _run_batch([_write_run(folder, f"merged-{uuid.uuid4().hex}", iter(tree))])

    return merge


def _merge_runs(spark: SparkSession, folder: str, runs: list, range_entries: int) -> list[str]:
    """Names of the index segments, in key order."""
    schema = "runs array<string>, low string, high string"
    while len(runs) > FAN_IN:
        groups = [(g, None, None) for g in ([r.run for r in runs[i : i + FAN_IN]] for i in range(0, len(runs), FAN_IN))]
        runs = spark.createDataFrame(groups, schema).repartition(len(groups)).mapInArrow(_merger(folder), _RUNS).collect()
    if not runs:
        return []
    samples = sorted(k for r in runs for k in r.samples)
    n = max(1, min(len(samples), -(-sum(r.n for r in runs) // range_entries)))
    cuts = sorted({samples[len(samples) * i // n] for i in range(1, n)})
    bounds = list(zip([None, *cuts], [*cuts, None]))
    ranges = [([r.run for r in runs], low, high) for low, high in bounds]
    merged = spark.createDataFrame(ranges, schema).repartition(len(ranges)).mapInArrow(_merger(folder), _RUNS).collect()
    return [r.run for r in sorted((r for r in merged if r.n), key=lambda r: r.samples[0])]


def write_archives(
    pages: DataFrame,
    *,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    least_bytes: int = 1000,
    run_entries: int = 100_000,
    range_entries: int = 4096,
) -> tuple[str, list[str]]:
    """Writes the archives and their index: the folder and the index segments in order."""
    spark = pages.sparkSession
    common.small_batches(spark, 256)
    folder = common.shared_dir(spark, "warc")
    common.make_dir(folder)
    payload = F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= least_bytes)
    groups = large.groupBy("digest").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).where("n > 1 AND winner IS NOT NULL")
    lost = F.col("page_id").isNull() | (F.col("page_id") < F.col("winner"))
    typed = rows.join(groups.drop("n"), "digest", "left").withColumn("refers_to", F.when(lost, F.col("winner"))).drop("winner")
    runs = typed.mapInArrow(_archiver(folder, run_entries), _RUNS).collect()
    return folder, _merge_runs(spark, folder, runs, range_entries)


def parse_record(raw: bytes) -> dict:
    """A gzip member with one record."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["WARC-Type"]
    if kind == "response":
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    else:
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        digest = base64.b32decode(fields["WARC-Payload-Digest"].partition(":")[2]).hex()
    number = lambda x: int(x) if x else None
    return {
        "page_id": number(fields["X-Page-ID"].strip()),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": number(fields.get("X-Refers-To-Page-ID", "").strip()),
        "url": fields["WARC-Target-URI"],
        "payload": payload if kind == "response" else None,
    }


def _reader(folder: str, with_payload: bool):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "url_key", "captured", "segment", "place", "payload"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = common.open_fs(folder)

        def rows(segment: int, entries: list[tuple]) -> pa.RecordBatch:
            found, name, f = [], None, None
            for place, key, when, file, at, size in sorted(entries, key=lambda e: (e[3], e[4])):
                if file != name:
                    if f:
                        f.close()
                    f, name = fs.open_input_file(f"{path}/{file}"), file
                f.seek(at)
                row = parse_record(f.read(size)) | {"url_key": key, "captured": when, "segment": segment, "place": place}
                found.append(row if with_payload else row | {"payload": None})
            if f:
                f.close()
            return pa.record_batch([pa.array([r[k] for r in found], t) for k, t in zip(names, types)], names)

        for batch in batches:
            for row in batch.to_pylist():
                entries: list[tuple] = []
                for place, line in enumerate(_slice(folder, row["run"], None, None)):
                    key, when, file, at, size = line.split(" ")
                    entries.append((place, key, when, file, int(at), int(size)))
                    if len(entries) >= 512:
                        yield rows(row["segment"], entries)
                        entries = []
                if entries:
                    yield rows(row["segment"], entries)

    return read


def read_archives(spark: SparkSession, folder: str, segments: list[str], *, with_payload: bool = False) -> DataFrame:
    """A row for each record; (segment, place) is its place in the capture histories."""
    rows = spark.createDataFrame(list(enumerate(segments)), "segment long, run string").repartition(max(1, len(segments)))
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, url_key string, captured string, segment long, place long, payload binary"
    return rows.mapInArrow(_reader(folder, with_payload), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: `pages` archived and read back by the merged index; see the module."""
    folder, segments = write_archives(common.table(spark, sf_dir, "pages"))
    return read_archives(spark, folder, segments).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha1(b) AS h FROM p),
g AS (SELECT h, max(page_id) AS winner FROM d WHERE n >= 1000 GROUP BY h)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
  CASE WHEN page_id IS NULL AND winner IS NOT NULL OR page_id < winner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS NULL AND winner IS NOT NULL OR page_id < winner THEN winner END AS refers_to
FROM d LEFT JOIN g USING (h)
"""
