"""Token-ID / binary output: length-delimited records with masked checksums and an offset index.

File format (all integers little-endian).  A data file ``<stem>.rec`` is a sequence of frames::

    u64 length | u32 masked crc of those 8 bytes | payload | u32 masked crc of the payload

where ``masked(c) = ((c >> 15) | (c << 17)) + 0xA282EAD8 mod 2**32`` over the CRC-32 ``c``, so
that a checksum of data which itself holds checksums stays sound.  A payload is
``i64 doc_id | u8 bytes per id (2 or 4) | ids``.  The index ``<stem>.idx`` holds, for each
record, ``i64 doc_id, u64 byte offset of the frame, u64 ids before it in the file``; a reader
that shuffles needs the index and single reads only.

:func:`write` lays documents out in ascending ``doc_id`` order over files named in a manifest.
A task writes under a name of its own attempt and only its successful attempt enters the
manifest, so repeated and lost tasks leave nothing that a reader sees.

Edge cases: a null text is empty and still gets a record with its end id; a null ``doc_id`` sorts
first and is read back as null; repeated rows are repeated records; an empty table gives an empty
manifest; extra columns are ignored.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

_NULL_ID = -(2**63)
_ENTRY = "<qQQ"
_INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("ids_before", "<u8")])


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = len(payload).to_bytes(8, "little")
    return b"".join((head, masked(head).to_bytes(4, "little"), payload, masked(payload).to_bytes(4, "little")))


def payload(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """``ids``: unsigned 32-bit; stored with ``width`` bytes each."""
    packed = ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
    return (_NULL_ID if doc_id is None else doc_id).to_bytes(8, "little", signed=True) + bytes((width,)) + packed


def parse(data: bytes) -> tuple[int | None, bytes]:
    doc_id, width = int.from_bytes(data[:8], "little", signed=True), data[8]
    ids = data[9:] if width == 4 else np.frombuffer(data, "<u2", offset=9).astype("<u4").tobytes()
    return None if doc_id == _NULL_ID else doc_id, ids


def _open(path: str, mode: str):
    """A stream in any store that pyarrow reaches by URI; local paths directly."""
    if path.startswith("file:") or "://" not in path:
        local = path.removeprefix("file://").removeprefix("file:")
        os.makedirs(os.path.dirname(local), exist_ok=True)
        return open(local, mode)
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    return store.open_output_stream(at) if mode == "wb" else store.open_input_file(at)


def _take(f, offset: int | None = None) -> bytes | None:
    """The payload of the frame at ``offset`` (or the next one); None at the end of the file."""
    if offset is not None:
        f.seek(offset)
    head = f.read(12)
    if not head:
        return None
    if len(head) < 12 or masked(head[:8]) != int.from_bytes(head[8:], "little"):
        raise ValueError("damaged record length")
    n = int.from_bytes(head[:8], "little")
    body = f.read(n + 4)
    if len(body) < n + 4 or masked(body[:n]) != int.from_bytes(body[n:], "little"):
        raise ValueError("damaged record")
    return body[:n]


def read_file(path: str) -> Iterator[tuple[int | None, bytes]]:
    with _open(path, "rb") as f:
        while (data := _take(f)) is not None:
            yield parse(data)


def read_shuffled(path: str, seed: int) -> Iterator[tuple[int | None, bytes]]:
    """The records of one file in a random order, by its index and single reads."""
    with _open(f"{path.removesuffix('.rec')}.idx", "rb") as f:
        index = np.frombuffer(f.read(), _INDEX)  # 24 bytes a record of one file
    with _open(path, "rb") as f:
        for i in np.random.default_rng(seed).permutation(len(index)):
            yield parse(_take(f, int(index["offset"][i])))


def write(docs: DataFrame, tokenizer_path: str, out_dir: str, end_id: int = 1) -> DataFrame:
    """Encode and write all documents; the manifest ``(part, path, n_docs, n_ids, first_id)``, already written."""

    def run(batches):
        from pyspark import TaskContext

        enc = encoder(tokenizer_path)
        width = 2 if max(enc.vocab_size - 1, end_id) < 1 << 16 else 4
        end = np.array([end_id], "<u4").tobytes()
        ctx = TaskContext.get()
        stem = f"{out_dir}/part-{ctx.partitionId():06d}-{uuid.uuid4().hex}"
        data, index, at, n, docs_out, first = None, None, 0, 0, 0, None
        for b in batches:
            ids, docs_in = b["doc_id"].to_pylist(), b["text"].to_pylist()
            if data is None:
                data, index, first = _open(f"{stem}.rec", "wb"), _open(f"{stem}.idx", "wb"), ids[0]
            for doc_id, raw in zip(ids, enc.encode(docs_in)):
                raw += end
                record = frame(payload(doc_id, raw, width))
                data.write(record)
                index.write(struct.pack(_ENTRY, _NULL_ID if doc_id is None else doc_id, at, n))
                at, n, docs_out = at + len(record), n + len(raw) // 4, docs_out + 1
        if data is not None:
            data.close()
            index.close()
            yield {"part": [ctx.partitionId()], "path": [f"{stem}.rec"], "n_docs": [docs_out], "n_ids": [n], "first_id": [first]}

    spark = common.tune(docs.sparkSession)
    # The hash lets rows of one id, or without one, fall into several parts.
    rows = common.texts(docs).withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange(common.partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    return common.stage(common.in_arrow(ordered, run, "part int, path string, n_docs bigint, n_ids bigint, first_id bigint"), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, ids)`` of every record of the manifest's files; ids as unsigned 32-bit bytes.

    The manifest has one row per file; the ids before each file are summed on the driver.
    """
    files = sorted(manifest.collect(), key=lambda r: r.part)
    base, rows = 0, []
    for r in files:
        rows.append((r.path, base))
        base += r.n_ids
    spark = common.tune(manifest.sparkSession)

    def run(batches):
        for b in batches:
            for path, start in zip(b["path"].to_pylist(), b["base"].to_pylist()):
                out, size = {"doc_id": [], "start": [], "ids": []}, 0
                for doc_id, ids in read_file(path):
                    out["doc_id"].append(doc_id)
                    out["start"].append(start)
                    out["ids"].append(ids)
                    start, size = start + len(ids) // 4, size + len(ids)
                    if size > common.BATCH_BYTES:
                        yield out
                        out, size = {"doc_id": [], "start": [], "ids": []}, 0
                yield out

    schema = "doc_id bigint, start bigint, ids binary"
    if not rows:
        return spark.createDataFrame([], schema)
    todo = spark.createDataFrame(rows, "path string, base bigint").repartition(min(len(rows), common.partitions(spark)), "path")
    return common.in_arrow(todo, run, schema)


def digests(records: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of records as :func:`read` gives them."""
    return records.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
