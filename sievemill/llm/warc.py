"""WARC archives: writing, normalising monolithic gzip files, and reading back by offset.

`write_archives` makes one monolithic gzip stream per archive, as many crawlers do. `normalise` inflates each such
stream once, from front to back in bounded pieces, and rewrites every record as a gzip member of its own next to a
sidecar index (one JSON line a record: offset, length, id, type). `read_records` reads members by these offsets.
File access goes through pyarrow's file systems, so the folder may be on any store that they reach. A task names its
files afresh on each attempt and the manifest of the attempt that succeeded is written as a table, so a lost executor
leaves at worst files that no manifest mentions.

Payloads of at least `min_revisit_bytes` that are equal are stored once: the row with the largest page_id is the
response and the others are revisit records that refer to it. Defined cases: null html is an empty payload; a null
url leaves the target header out; ids may be of any type that casts to text and back; rows equal in page_id and payload are written once each.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, new_path, pandas_map, text_of

CRLF = b"\r\n"
END = CRLF + CRLF
PIECE = 1 << 20


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record_id(page_id) -> str:
    """Ids of any type; null has a name of its own."""
    return "<urn:page>" if page_id is None else f"<urn:page:{quote(str(page_id), safe='')}>"


def id_of(record: str | None) -> str | None:
    found = re.fullmatch(r"<urn:page:(.*)>", record or "")
    return unquote(found[1]) if found else None


def build_record(page_id, url, payload: bytes, digest: str, owner) -> bytes:
    """One WARC record; a revisit keeps the HTTP head, with the length of the payload that it leaves out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + END
    block = http + (payload if owner is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if owner is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if owner is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(owner)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + END + block + END


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records from a stream of inflated pieces; holds one record and one piece at most."""
    held = bytearray()
    for piece in pieces:
        held += piece
        while (at := held.find(END)) >= 0:
            size = at + 4 + int(parse_head(bytes(held[:at]))["content-length"]) + 4
            if len(held) < size:
                break
            yield bytes(held[:size])
            del held[:size]
    if held.strip():
        raise ValueError("the archive ends inside a record")


def inflate(stream) -> Iterator[bytes]:
    """The whole stream once, whether it is one gzip member or many."""
    z = zlib.decompressobj(31)
    while raw := stream.read(PIECE):
        while raw:
            yield z.decompress(raw, PIECE * 4)
            raw = z.unconsumed_tail
            if z.eof:
                raw = z.unused_data
                z = zlib.decompressobj(31)
    yield z.flush()


def label_records(pages: DataFrame, min_revisit_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload, payload_digest and owner (the response's page_id for revisits, else null)."""
    payload = text_of("html").cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("payload_digest"))
    sized = pages.select("page_id", F.sha1(payload).alias("payload_digest"), F.octet_length(payload).alias("n")).filter(F.col("n") >= min_revisit_bytes)
    owners = sized.groupBy("payload_digest").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies")
    return rows.join(owners, "payload_digest", "left").withColumn("owner", F.when(~F.col("owner").eqNullSafe(F.col("page_id")), F.col("owner")))


def _write(folder: str, roll_bytes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = open_fs(folder)
        out, made = None, []
        for pdf in batches:
            for page_id, url, payload, digest, owner in zip(*(pdf[c] for c in ("page_id", "url", "payload", "payload_digest", "owner"))):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, z, size, n = store.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
                raw = build_record(page_id, url, bytes(payload), digest, owner)
                out.write(z.compress(raw))
                size, n = size + len(raw), n + 1
                if size >= roll_bytes:
                    out.write(z.flush()), out.close()
                    made, out = [*made, (name, n)], None
        if out is not None:
            out.write(z.flush()), out.close()
            made.append((name, n))
        yield pd.DataFrame(made, columns=["name", "records"]).astype({"records": "int64"})

    return run


def write_archives(labelled: DataFrame, folder: str, roll_bytes: int = 64 << 20) -> DataFrame:
    """Monolithic archives of about roll_bytes; returns the manifest (name, records)."""
    store, base = open_fs(folder)
    store.create_dir(base, recursive=True)
    rows = labelled.select(F.col("page_id").cast("string"), "url", "payload", "payload_digest", F.col("owner").cast("string"))
    return materialise(rows.transform(pandas_map, _write(folder, roll_bytes), "name string, records long"), "warc-manifest")


def _normalise(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = open_fs(folder)
        for pdf in batches:
            made = []
            for name in pdf["name"]:
                own = f"{name.removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}.records.warc.gz"
                at, n = 0, 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as src, store.open_output_stream(f"{base}/{own}", compression=None) as out, store.open_output_stream(f"{base}/{own}.idx") as index:
                    for raw in split_records(inflate(src)):
                        z = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = z.compress(raw) + z.flush()
                        head = parse_head(raw[: raw.find(END)])
                        index.write(json.dumps({"offset": at, "length": len(member), "id": head["warc-record-id"], "type": head["warc-type"]}).encode() + b"\n")
                        out.write(member)
                        at, n = at + len(member), n + 1
                made.append((own, n))
            yield pd.DataFrame(made, columns=["name", "records"]).astype({"records": "int64"})

    return run


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """Each record as its own gzip member, with a sidecar index NAME.idx; returns the new manifest. An archive is
    one task's work, and archives are dealt out evenly."""
    tasks = max(1, manifest.count())
    return materialise(manifest.repartition(min(tasks, 4000)).transform(pandas_map, _normalise(folder), "name string, records long"), "warc-normalised")


def _read(folder: str, with_payload: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = open_fs(folder)
        for pdf in batches:
            for name in pdf["name"]:
                rows, held = [], 0
                with store.open_input_stream(f"{base}/{name}.idx") as f:
                    index = [json.loads(x) for x in f.read().splitlines()]
                with store.open_input_file(f"{base}/{name}") as f:
                    for x in index:
                        raw = zlib.decompress(f.read_at(x["length"], x["offset"]), 31)
                        at = raw.find(END)
                        head, block = parse_head(raw[:at]), raw[at + 4 : -4]
                        cut = block.find(END)
                        http, payload = parse_head(block[:cut]), block[cut + 4 :]
                        named = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                        if head["warc-type"] == "response":
                            if hashlib.sha1(payload).hexdigest() != named:
                                raise ValueError(f"{name} at {x['offset']}: payload and digest differ")
                            size = len(payload)
                        else:
                            size = int(http["content-length"])
                        ids = [id_of(head.get(k)) for k in ("warc-record-id", "warc-refers-to")]
                        rows.append((*ids, size, named, head["warc-type"], head.get("warc-target-uri"), *[payload][:with_payload]))
                        held += len(payload) * with_payload + 200
                        if held >= READ_BYTES:
                            yield pd.DataFrame(rows, columns=COLUMNS[: len(rows[0])])
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=COLUMNS[: len(rows[0])])

    return run


COLUMNS = ["page_id", "refers_to", "payload_bytes", "payload_digest", "record_type", "target_uri", "payload"]
KINDS = ["string", "string", "long", "string", "string", "string", "binary"]
#: Bytes of records that a reader gathers before it hands them on.
READ_BYTES = 4 << 20


def read_records(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Records by offset, ids as text; the payload of a revisit is empty, its size and digest are those of the full
    payload. Payloads are checked against their digests whether they are handed on or not."""
    tasks = max(1, manifest.count())
    schema = ", ".join(f"{c} {k}" for c, k in list(zip(COLUMNS, KINDS))[: 6 + with_payload])
    return manifest.repartition(min(tasks, 4000)).transform(pandas_map, _read(folder, with_payload), schema)


def archive_pages(pages: DataFrame, min_revisit_bytes: int = 1000, roll_bytes: int = 64 << 20, with_payload: bool = True) -> DataFrame:
    """Write, normalise and read back."""
    folder = new_path(pages.sparkSession, "warc")
    raw = write_archives(label_records(pages, min_revisit_bytes), folder, roll_bytes)
    found, kind = read_records(normalise(raw, folder), folder, with_payload), pages.schema["page_id"].dataType
    return found.withColumns({c: F.col(c).cast(kind) for c in COLUMNS[:2]})
