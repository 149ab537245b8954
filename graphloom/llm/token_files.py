"""Operator 1: token ids in length-delimited binary record files, with a separate offset index.

Frame: 8-byte length, masked checksum of these 8 bytes, payload, masked checksum of the payload; all
little-endian. Payload: version (1 byte), bytes an id (1), flags (2; bit 0: no doc_id), doc_id (8), ids.
The checksum is CRC-32, masked as rotate-right by 15 plus a constant, so that checksums stored inside
payloads don't look like their own. The index (Parquet) has file, offset and length of every record, so
that records can be read in any order without scanning a file.

Null text: empty, so only the end id. Null doc_id: sorts first, is kept as null. Repeated rows are
repeated records. An empty table gives no record and an empty result.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, open_fs, scratch, texts_of, trim, width

HEAD = struct.Struct("<BBHq")
#: Added after the rotation (a fixed value of the well-known masked-checksum scheme).
MASK = 0xA282EAD8


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    n = struct.pack("<Q", len(payload))
    return b"".join((n, struct.pack("<I", masked(n)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes) -> bytes:
    """The payload of one frame; ValueError if it's damaged."""
    if len(data) < 16:
        raise ValueError("record is cut off")
    n = data[:8]
    if struct.unpack_from("<I", data, 8)[0] != masked(n):
        raise ValueError("length checksum differs")
    size = struct.unpack("<Q", n)[0]
    payload = data[12 : 12 + size]
    if len(data) != size + 16 or struct.unpack_from("<I", data, 12 + size)[0] != masked(payload):
        raise ValueError("payload checksum differs")
    return payload


def pack(doc_id: int | None, ids: bytes, width_: int) -> bytes:
    return HEAD.pack(1, width_, doc_id is None, doc_id or 0) + ids


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    _, wide, flags, doc_id = HEAD.unpack_from(payload)
    return (None if flags & 1 else doc_id), np.frombuffer(payload, f"<u{wide}", offset=HEAD.size)


INDEX = "shard int, row long, doc_id long, offset long, length long, n_tokens long, local_start long"


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, partitions: int | None = None) -> DataFrame:
    """Write docs (doc_id, text) in ascending doc_id order to path/shard-*.rec; returns the offset index.

    One file a task, written under the attempt's own name and renamed when whole: a task that runs again
    on another executor replaces the file with the same bytes.
    """
    files = f"{path}/records"

    def write(batches):
        from pyspark import TaskContext

        from graphloom.llm.encoder import encoder, slices

        ctx = TaskContext.get()
        shard, out, offset, row, start = ctx.partitionId(), None, 0, 0, 0
        enc = encoder(tokenizer)
        wide = enc.dtype.itemsize
        end = np.array([end_id], enc.dtype).tobytes()
        fs, at = open_fs(files)
        name, tmp = f"{at}/shard-{shard:06d}.rec", f"{at}/.shard-{shard:06d}.{ctx.taskAttemptId()}"
        for batch in batches:
            ids_col, text_col = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cols: list[list] = [[] for _ in range(4)]
            for a, b in slices(text_col):
                for doc_id, ids in zip(ids_col[a:b], enc.encode(text_col[a:b])):
                    if out is None:
                        fs.create_dir(at, recursive=True)
                        out = fs.open_output_stream(tmp)
                    rec = frame(pack(doc_id, ids + end, wide))
                    out.write(rec)
                    n = len(ids) // wide + 1
                    for c, v in zip(cols, (offset, len(rec), n, start)):
                        c.append(v)
                    offset += len(rec)
                    start += n
            k = len(ids_col)
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * k, pa.int32()), pa.array(range(row, row + k), pa.int64()), pa.array(ids_col, pa.int64()), *(pa.array(c, pa.int64()) for c in cols)],
                ["shard", "row", "doc_id", "offset", "length", "n_tokens", "local_start"],
            )
            row += k
            trim()
        if out is not None:
            out.close()
            fs.move(tmp, name)

    n = partitions or width(docs.sparkSession)
    rows = texts_of(docs).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(rows.mapInArrow(write, INDEX), "index", f"{path}/index")


def read_token_files(index: DataFrame, path: str) -> DataFrame:
    """doc_id, start (ids before it in the whole data set), n_tokens, ids (binary, 4 bytes each), ids_crc32.

    Each record is fetched by its index entry and both its checksums are verified. The totals of the
    files, one row a file, are all that reaches the driver.
    """
    files = f"{path}/records"
    total, starts = 0, []
    for r in sorted(index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect(), key=lambda r: r["shard"]):
        starts.append((r["shard"], total))
        total += r["n"]
    base = index.sparkSession.createDataFrame(starts, "shard int, base long")
    rows = index.join(F.broadcast(base), "shard").select("shard", "offset", "length", (F.col("base") + F.col("local_start")).alias("start"))

    def read(batches):
        fs, at = open_fs(files)
        opened: tuple = (None, None)
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for shard, offset, length, start in zip(*(c.to_pylist() for c in batch.columns)):
                if opened[0] != shard:
                    if opened[1] is not None:
                        opened[1].close()
                    opened = (shard, fs.open_input_file(f"{at}/shard-{shard:06d}.rec"))
                opened[1].seek(offset)
                doc_id, ids = unpack(unframe(opened[1].read(length)))
                raw = ids.astype("<u4").tobytes()
                for c, v in zip(out, (doc_id, start, len(ids), zlib.crc32(raw), raw)):
                    c.append(v)
                if sum(map(len, out[4][-1:])) > 1 << 22 or len(out[4]) >= 512:
                    yield _read_batch(out)
                    out = [[] for _ in range(5)]
            yield _read_batch(out)
        if opened[1] is not None:
            opened[1].close()

    return rows.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def _read_batch(out: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (*[pa.int64()] * 4, pa.binary()))], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def token_records(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Write, then read back: doc_id, start, n_tokens, ids_crc32 of every document."""
    path = path or scratch(docs.sparkSession, "token-files")
    index = write_token_files(docs, tokenizer, path, end_id)
    return read_token_files(index, path).select("doc_id", "start", "n_tokens", "ids_crc32")
