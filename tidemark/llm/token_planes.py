"""Token-id files with bit-plane shuffling.

Ids are cut into blocks of a fixed number of ids. A block's ids (unsigned 32-bit) are transposed into byte planes, or bit planes, so that
equal high bytes lie together; each plane is compressed with zstandard. A file holds its blocks one after another, then a chunk index (for each block: place,
sizes of its planes, number of ids; for each document: id, first id, number of ids), then the index's place. Any document can be read by the index alone.

Spark orders the documents by range partitions of the id, each task writes one file under a name of its own attempt, and a manifest of one row per file,
by the names of the attempts that Spark counted, is kept as a table. An attempt that fails deletes its file; one that Spark kills leaves a file that no manifest names. Tasks hold one batch of texts and one block at a time. Files go to the shared folder by its URI.

Cases: null or empty text has only the end id; null ids come first; rows that repeat an id stay beside each other; an empty table gives no file and an empty result;
only the id and the text are read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.chunks import by_bytes
from tidemark.llm.common import named, shared_dir, staged, worker_bytes
from tidemark.llm.word_codes import word_codes

MAGIC, BLOCK, LEVEL, BATCH_BYTES = b"TPLANES1", 1 << 16, 3, 4 << 20


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """The byte planes (low byte first), or the bit planes, of unsigned 32-bit ids."""
    by_byte = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [p.tobytes() for p in np.ascontiguousarray(by_byte.T)]
    return [np.packbits(p, bitorder="little").tobytes() for p in np.unpackbits(by_byte, axis=1, bitorder="little").T]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], 1).reshape(-1).view("<u4")
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], 1)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


class Writer:
    """Writes one file; `add` takes ids of documents, `close` the rest and the index."""

    def __init__(self, out, bits: bool = False, block: int = BLOCK, level: int = LEVEL):
        import zstandard

        self.out, self.bits, self.block = out, bits, block
        self.zip = zstandard.ZstdCompressor(level=level)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.chunks: list[tuple[int, ...]] = []
        self.docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        out.write(MAGIC)
        self.place = len(MAGIC)

    def add(self, doc_ids: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.docs.append((doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"), doc_ids.is_valid().to_numpy(zero_copy_only=False), sizes.astype("<u4")))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= self.block:
            ids = np.concatenate(self.held)
            whole = len(ids) // self.block * self.block
            for at in range(0, whole, self.block):
                self._write(ids[at : at + self.block])
            self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def _write(self, ids: np.ndarray) -> None:
        planes = [self.zip.compress(p) for p in to_planes(ids, self.bits)]
        self.chunks.append((self.place, len(ids), *map(len, planes)))
        for p in planes:
            self.out.write(p)
            self.place += len(p)

    def close(self) -> None:
        if self.n_held:
            self._write(np.concatenate(self.held))
        n_docs = sum(len(x[0]) for x in self.docs)
        columns = [b"".join(x[i].tobytes() for x in self.docs) for i in range(3)]
        index = struct.pack("<QQQ", len(self.chunks), n_docs, len(self.chunks[0]) if self.chunks else 2) + np.array(self.chunks, "<u8").tobytes() + b"".join(columns)
        packed = self.zip.compress(index)
        self.out.write(packed)
        self.out.write(struct.pack("<Q", self.place) + MAGIC)
        self.n_docs = n_docs


class Reader:
    """Reads one file: `docs` gives each document's id and ids, holding one block and the document at a time."""

    def __init__(self, file):
        import zstandard

        self.file, self.unzip = file, zstandard.ZstdDecompressor()
        size = file.size()
        tail = file.read_at(8 + len(MAGIC), size - 8 - len(MAGIC))
        if tail[8:] != MAGIC or file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("not a token file, or cut short")
        (place,) = struct.unpack("<Q", tail[:8])
        index = self.unzip.decompress(file.read_at(size - 8 - len(MAGIC) - place, place))
        n_chunks, n_docs, width = struct.unpack("<QQQ", index[:24])
        at = 24 + n_chunks * width * 8
        self.chunks = np.frombuffer(index[24:at], "<u8").reshape(n_chunks, width).astype(np.int64)
        self.ids = np.frombuffer(index[at : at + 8 * n_docs], "<i8")
        self.valid = np.frombuffer(index[at + 8 * n_docs : at + 9 * n_docs], bool)
        self.sizes = np.frombuffer(index[at + 9 * n_docs :], "<u4").astype(np.int64)
        self.firsts = np.cumsum(self.chunks[:, 1]) - self.chunks[:, 1]

    def block(self, k: int) -> np.ndarray:
        place, n, *sizes = self.chunks[k].tolist()
        planes = []
        for size in sizes:
            planes.append(self.unzip.decompress(self.file.read_at(size, place)))
            place += size
        return from_planes(planes, n)

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document of the file, from its own blocks only."""
        start, n = int(self.sizes[:i].sum()), int(self.sizes[i])
        return self._range(start, n, {})

    def _range(self, start: int, n: int, held: dict[int, np.ndarray]) -> np.ndarray:
        first = int(np.searchsorted(self.firsts, start, side="right")) - 1
        parts, k = [], max(first, 0)
        while n:
            if k not in held:
                held.clear()
                held[k] = self.block(k)
            part = held[k][start - self.firsts[k] :][:n]
            parts.append(part)
            start, n, k = start + len(part), n - len(part), k + 1
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def docs(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        held: dict[int, np.ndarray] = {}
        start = 0
        for doc_id, valid, n in zip(self.ids.tolist(), self.valid.tolist(), self.sizes.tolist(), strict=True):
            yield (doc_id if valid else None), start, self._range(start, n, held)
            start += n


def write_ids(docs: DataFrame, tokenizer: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text", bits: bool = False) -> DataFrame:
    """Writes the files under the URI `folder` and returns the manifest: part, file, n_docs, n_ids, n_bytes, start (ids in the files before)."""
    with open(tokenizer, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    most = worker_bytes(docs.sparkSession)
    schema = pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        fs, top = pafs.FileSystem.from_uri(folder)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.planes"
        writer = out = None
        try:
            for some in by_bytes(batches, "text", BATCH_BYTES):
                if writer is None:
                    fs.create_dir(top, recursive=True)
                    out = fs.open_output_stream(f"{top}/{name}")
                    writer, codes = Writer(out, bits), word_codes(model.value, most)
                for batch in some.combine_chunks().to_batches():
                    ids, sizes = codes.ids(batch.column("text"))
                    writer.add(batch.column("doc_id"), np.insert(ids, np.cumsum(sizes), end_id), sizes + 1)
            if writer is None:
                return
            writer.close()
            out.close()
        except BaseException:
            if out is not None:
                out.close()
                fs.delete_file(f"{top}/{name}")
            raise
        yield pa.record_batch([[part], [name], [writer.n_docs], [writer.n_ids], [fs.get_file_info(f"{top}/{name}").size]], schema=schema)

    rows = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    made = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first()).mapInArrow(write, "part int, file string, n_docs long, n_ids long, n_bytes long")
    made = staged(made, "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return made.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_ids(spark: SparkSession, manifest: DataFrame, folder: str, keep: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; with `keep`, ids (array<int>) too."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int32()))] if keep else [])])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                rows = []
                with fs.open_input_file(f"{top}/{file}") as f:
                    for doc_id, start, ids in Reader(f).docs():
                        rows.append((doc_id, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *([ids.astype(np.int32)] if keep else [])))
                        if len(rows) >= (256 if keep else 8192):
                            yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = manifest.select("file", "start").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file")
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if keep else ""))


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/token-planes-{uuid.uuid4().hex}"
