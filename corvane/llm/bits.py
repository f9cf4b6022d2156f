"""Token ids in fixed-width bit-packed files.

A shard file, all numbers little-endian:

    magic "CVPK0001" | blocks, each bit-packed on its own | tables | trailer

The tables are the blocks' byte offsets (uint64, one more than blocks), the
documents' ids (int64), whether each id is null (uint8) and where each
document's tokens end (uint64, counted in ids).  The trailer (64 bytes) has the
tables' offset, the counts of blocks, documents and ids, the ids in a block, the
bits of an id, the vocabulary size, and the magic again.  Any id is found by its
number: block = number // ids in a block, then its bits in that block.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents, materialise, scratch, small_batches
from .words import crc32, encoder, tokenizer_path

MAGIC = b"CVPK0001"
TRAILER = struct.Struct("<6QQ8s")


def width(vocabulary: int) -> int:
    """The fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in order, each in ``bits`` bits, low bit first; the last byte is filled with zeros."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (flat.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(1, dtype=np.uint64).astype(np.uint32)


class ShardWriter:
    """Takes documents one by one; holds one block of ids and the tables."""

    def __init__(self, out, vocabulary: int, block: int = 1 << 16):
        self.out, self.vocabulary, self.block, self.bits = out, vocabulary, block, width(vocabulary)
        self.out.write(MAGIC)
        self.offsets, self.pending, self.held, self.n_ids = [len(MAGIC)], [], 0, 0
        self.doc_ids: list[int | None] = []
        self.ends: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >= self.vocabulary:
            raise ValueError(f"id {ids.max()} is not in a vocabulary of {self.vocabulary}")
        self.doc_ids.append(doc_id)
        self.n_ids += len(ids)
        self.ends.append(self.n_ids)
        self.pending.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            self._flush()

    def _flush(self, all_of_it: bool = False) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.empty(0, np.uint32)
        whole = len(ids) if all_of_it else len(ids) - len(ids) % self.block
        for at in range(0, whole, self.block):
            data = pack(ids[at : min(at + self.block, whole)], self.bits)
            self.out.write(data)
            self.offsets.append(self.offsets[-1] + len(data))
        self.pending, self.held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(all_of_it=True)
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        self.out.write(np.array([d or 0 for d in self.doc_ids], "<i8").tobytes())
        self.out.write(np.array([d is None for d in self.doc_ids], "u1").tobytes())
        self.out.write(np.array(self.ends, "<u8").tobytes())
        self.out.write(TRAILER.pack(self.offsets[-1], len(self.offsets) - 1, len(self.doc_ids), self.n_ids, self.block, self.bits, self.vocabulary, MAGIC))


class ShardReader:
    """Random access to a shard; reads only the blocks that hold what is asked for."""

    def __init__(self, file):
        self.file = file
        file.seek(0, 2)
        size = file.tell()
        self.tables, self.n_blocks, self.n_docs, self.n_ids, self.block, self.bits, self.vocabulary, magic = TRAILER.unpack(self._at(size - TRAILER.size, TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a packed token file")
        at, got = self.tables, []
        for kind, n in (("<u8", self.n_blocks + 1), ("<i8", self.n_docs), ("u1", self.n_docs), ("<u8", self.n_docs)):
            wide = np.dtype(kind).itemsize * n
            got.append(np.frombuffer(self._at(at, wide), kind))
            at += wide
        self.offsets, self.doc_ids, self.null_ids, self.ends = got
        self._kept = (-1, np.empty(0, np.uint32))

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def _block(self, b: int) -> np.ndarray:
        if self._kept[0] != b:
            data = self._at(int(self.offsets[b]), int(self.offsets[b + 1] - self.offsets[b]))
            self._kept = (b, unpack(data, min(self.block, self.n_ids - b * self.block), self.bits))
        return self._kept[1]

    def ids(self, start: int, end: int) -> np.ndarray:
        parts = []
        for b in range(start // self.block, -(-end // self.block) if end > start else start // self.block):
            low = b * self.block
            parts.append(self._block(b)[max(0, start - low) : end - low])
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_packed(docs: DataFrame, folder: str, tokenizer: str, vocabulary: int, block: int = 1 << 16) -> DataFrame:
    """Encode ``docs`` into shard files under ``folder``; returns the manifest.

    Shards hold ranges of doc_id and are sorted by it.  A task that runs again
    writes another file; the manifest, which Spark commits, names the file of
    the attempt that counted.  Columns: path, first_id, n_docs, n_ids, start (ids
    in all shards before).  Null doc_ids come first.
    """
    spark = docs.sparkSession
    small_batches(spark)
    filesystem, root = _filesystem(folder)
    filesystem.create_dir(root, recursive=True)

    def shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, root = _filesystem(folder)
        encode = encoder(tokenizer).encode
        out = writer = name = None
        for batch in batches:
            for doc_id, null, text in zip(batch["doc_id"], batch["no_id"], batch["text"], strict=True):
                if writer is None:
                    name = f"{root}/shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.bits"
                    out = filesystem.open_output_stream(name)
                    writer = ShardWriter(out, vocabulary, block)
                writer.add(None if null else int(doc_id), encode(text))
        if writer is not None:
            writer.close()
            out.close()
            yield pd.DataFrame({"name": [name.rpartition("/")[2]], "first_id": [writer.doc_ids[0] or 0], "first_null": [writer.doc_ids[0] is None], "n_docs": [len(writer.doc_ids)], "n_ids": [writer.n_ids]})

    dealt = docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("no_id").desc(), F.col("doc_id")]
    manifest = materialise(
        dealt.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(shard, "name string, first_id long, first_null boolean, n_docs long, n_ids long"),
        "manifest",
    )
    # One row per shard file.
    before = Window.orderBy(F.col("first_null").desc(), "first_id").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.select(F.concat(F.lit(folder + "/"), "name").alias("path"), "first_id", "n_docs", "n_ids", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))


def read_packed(manifest: DataFrame) -> DataFrame:
    """The documents of the shards: doc_id, start, n_tokens, ids_crc32, all from the files."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start in zip(batch["path"], batch["start"], strict=True):
                filesystem, name = _filesystem(path)
                with filesystem.open_input_file(name) as file:
                    shard = ShardReader(file)
                    ends = shard.ends.astype(np.int64)
                    starts = np.concatenate([[0], ends[:-1]])
                    yield pd.DataFrame({
                        "doc_id": pd.Series(shard.doc_ids).astype("Int64").mask(shard.null_ids == 1),
                        "start": starts + start, "n_tokens": ends - starts, "ids_crc32": [crc32(shard.document(k)) for k in range(shard.n_docs)],
                    })

    # A task a file: a count of our own, which adaptive execution leaves alone though the rows are small.
    files = manifest.select("path", "start").repartition(max(1, manifest.count()))
    return files.mapInPandas(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def packed_tokens(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Encode, write, read back: doc_id, start, n_tokens, ids_crc32 for each row of ``docs``.

    Null texts count as empty and give END_ID alone.  Rows that repeat a doc_id
    stand next to each other, in any order.  No rows in, no files and no rows out.
    """
    from tokenizers import Tokenizer

    tokenizer = tokenizer or tokenizer_path()
    vocabulary = Tokenizer.from_file(tokenizer).get_vocab_size()
    folder = scratch(docs.sparkSession, "packed")
    return read_packed(write_packed(docs, folder, tokenizer, vocabulary))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_tokens(documents(spark, sf_dir))
