"""Token-id files: independently coded, checksummed blocks and an index.

A file is: magic; groups of coded blocks; footer; trailer (footer's place and size, magic). A
newline stands after each part. The footer has, as little-endian arrays, each block's place,
coded bytes, ids and CRC-32, and each document's id and number of ids. Documents follow each
other in ascending doc_id, and a block may hold the end of one and the start of another.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm import rangecoder as R
from tabulon.llm import textops as T
from tabulon.llm import tokens
from tabulon.llm.blobs import Ranges, list_blobs, write_blobs
from tabulon.llm.shared import new_dir, running, schema_with, vocabulary

MAGIC = b"TIDX0002"
END = 0
#: Bytes of text that a file is meant to hold.
FILE_BYTES = 24 << 20
_CHUNK = 4 << 20


class Writer:
    """Makes the parts of one file."""

    def __init__(self):
        self.at, self.blocks, self.docs, self.sizes, self.held, self.n = 0, [], [], [], [], 0

    def _part(self, x: bytes) -> bytes:
        self.at += len(x) + 1
        return x

    def begin(self) -> bytes:
        return self._part(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray):
        """Take a document's ids; yields a part when enough blocks are full."""
        if len(ids) and int(ids.max()) > 0xFFFF:
            raise ValueError("ids of 65536 and more have no place in this format")
        self.docs.append(-(2**63) if doc_id is None else doc_id)
        self.sizes.append(len(ids))
        self.held.append(ids.astype(np.uint16))
        self.n += len(ids)
        if self.n >= R.BLOCK * R.LANES:
            yield self._code(False)

    def _code(self, last: bool) -> bytes:
        ids = np.concatenate(self.held)
        full = len(ids) if last else len(ids) // R.BLOCK * R.BLOCK
        self.held, self.n = [ids[full:]], len(ids) - full
        cut = [ids[i : i + R.BLOCK] for i in range(0, full, R.BLOCK)]
        out, at = [], self.at
        groups = -(-len(cut) // R.LANES)
        step = -(-len(cut) // groups)
        for i in range(0, len(cut), step):
            for block, x in zip(cut[i : i + step], R.encode_blocks(cut[i : i + step]), strict=True):
                self.blocks.append((at, len(x), len(block), zlib.crc32(block.astype("<u2").tobytes())))
                out.append(x)
                at += len(x)
        return self._part(b"".join(out))

    def end(self):
        if self.n:
            yield self._code(True)
        blocks = np.array(self.blocks, "<i8").reshape(-1, 4)
        footer = struct.pack("<qq", len(blocks), len(self.docs)) + blocks.tobytes() + np.array(self.docs, "<i8").tobytes() + np.array(self.sizes, "<i8").tobytes()
        footer = struct.pack("<I", zlib.crc32(footer)) + footer
        at = self.at
        yield self._part(footer)
        yield self._part(struct.pack("<qq", at, len(footer)) + MAGIC)


def read_index(file: Ranges) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks [n, 4], document ids and their numbers of ids."""
    at, size, magic = struct.unpack("<qq8s", file.read(file.size - 25, 24))
    if magic != MAGIC:
        raise ValueError("not a token-id file")
    raw = file.read(at, size)
    if zlib.crc32(raw[4:]) != struct.unpack("<I", raw[:4])[0]:
        raise ValueError("the index is damaged")
    n, d = struct.unpack("<qq", raw[4:20])
    x = np.frombuffer(raw[20:], "<i8")
    return x[: 4 * n].reshape(n, 4), x[4 * n : 4 * n + d], x[4 * n + d :]


def read_documents(file: Ranges):
    """(doc_id, ids) of each document in order; the blocks' checksums are verified."""
    blocks, docs, sizes = read_index(file)
    rest, nth = np.zeros(0, np.uint16), 0
    groups = max(1, -(-len(blocks) // R.LANES))
    step = max(1, -(-len(blocks) // groups))
    for i in range(0, len(blocks), step):
        group = blocks[i : i + step]
        lo, hi = int(group[0, 0]), int(group[-1, 0] + group[-1, 1])
        raw = file.read(lo, hi - lo)
        coded = [raw[a - lo : a - lo + n] for a, n in group[:, :2].tolist()]
        ids = R.decode_blocks(coded, group[:, 2])
        for k, x in enumerate(ids):
            if zlib.crc32(x.astype("<u2").tobytes()) != group[k, 3]:
                raise ValueError(f"block {i + k} is damaged")
        flow, at = np.concatenate([rest, *ids]), 0
        while nth < len(docs) and at + sizes[nth] <= len(flow):
            yield int(docs[nth]), flow[at : at + sizes[nth]]
            at += int(sizes[nth])
            nth += 1
        rest = flow[at:]
    if nth != len(docs):
        raise ValueError("documents are missing")


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end: int = END, file_bytes: int = FILE_BYTES) -> None:
    """Write the ids of all texts, each with ``end`` after them, in ascending doc_id.

    Null texts are empty; a null doc_id comes first and reads back as the least long;
    rows with one doc_id are each written. An id of 65536 or more raises ValueError.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = d.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    d = d.repartitionByRange(max(1, -(-total // file_bytes)), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        enc, out = tokens.encoder(tokens.ByteIds, vocabulary), Writer()
        blob = lambda x: pa.RecordBatch.from_arrays([pa.array([x], pa.binary())], names=["blob"])
        tail, begun = struct.pack("<I", end), False
        for batch in batches:
            if batch.num_rows and not begun:
                begun = True
                yield blob(out.begin())
            buf, off = T.texts(batch.column(1))
            raw, keys = buf.tobytes(), batch.column(0).to_pylist()
            for lo, hi in T.chunks(off, _CHUNK):
                o = off[lo : hi + 1].tolist()
                for d, ids in enumerate(enc.encode([raw[a:b] for a, b in zip(o[:-1], o[1:], strict=True)])):
                    for part in out.add(keys[lo + d], np.frombuffer(ids + tail, "<u4")):
                        yield blob(part)
        if begun:
            for part in out.end():
                yield blob(part)

    write_blobs(d.mapInArrow(run, "blob binary"), path)


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in the files under path.

    Indexes are read first: their sums place each file among all ids, one row a file.
    """
    files = list_blobs(spark, path)
    n = max(1, files.count())
    files = files.repartitionByRange(n, "part")

    def sums(batches):
        for batch in batches:
            out = []
            for address in batch.column(0).to_pylist():
                file = Ranges(address)
                out.append(int(read_index(file)[2].sum()))
                file.close()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=["path", "length", "part", "n"])

    sized = files.mapInArrow(sums, schema_with(files, ("n", "long")))
    placed = running(sized, ["part"], {"first": F.col("n")}).select("path", "first", "part").repartitionByRange(n, "part")

    def run(batches):
        for batch in batches:
            for address, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file, rows, at = Ranges(address), [], first
                for doc_id, ids in read_documents(file):
                    rows.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                    if len(rows) == 20_000:
                        yield _rows(rows)
                        rows = []
                file.close()
                if rows:
                    yield _rows(rows)

    def _rows(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    found = placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return found.withColumn("doc_id", F.when(F.col("doc_id") > -(2**63), F.col("doc_id")))


def round_trip(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """Write docs as token-id files in the shared folder and read them back. An empty table
    gives no file and no rows; columns other than doc_id and text aren't read."""
    spark = docs.sparkSession
    path = new_dir(spark, "tokens")
    write_tokens(docs, path, vocabulary_path or vocabulary("byte_bpe_50k.json"))
    return read_tokens(spark, path)
