"""Token ids in Arrow stream files of fixed-size-list batches.

A file holds consecutive documents in id order, cut into rows of equal length:
column ``ids`` is fixed_size_list<uint16 or uint32>[L], column ``mask``
fixed_size_list<uint8>[L / 8] has a bit for each token (1: of a document, 0:
padding at the file's end). Both are contiguous buffers of a memory-mapped
file, so any row is a view without a copy. A second stream file has each
document's id, start and length in its file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, new_folder, prepare_workers, sliced, text_or_empty, tokenizer_path
from .encoding import encoder

#: Tokens of a row, rows of a record batch, and tokens after which a file is closed at the next document's end.
ROW, ROWS, FILE_TOKENS = 2048, 512, 16_000_000


class SequenceWriter:
    """Writes ``name`` and ``name``'s index atomically: under a name of its own first, then moved."""

    def __init__(self, folder: str, name: str, width: str, row: int = ROW, rows: int = ROWS):
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.name, self.row, self.rows, self.width = name, row, rows, np.dtype(width)
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.width), row)), ("mask", pa.list_(pa.uint8(), row // 8))])
        self.own = f"{self.root}/.{name}-{uuid.uuid4().hex}"
        self.sink = self.fs.open_output_stream(self.own)
        self.out = pa.ipc.new_stream(self.sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.held = self.tokens = 0
        self.docs: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.tokens, len(ids)))
        self.waiting.append(ids.astype(self.width))
        self.tokens += len(ids)
        self.held += len(ids)
        if self.held >= self.row * self.rows:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.waiting) if self.waiting else np.zeros(0, self.width)
        size = self.row * self.rows
        full = len(flat) if last else len(flat) // size * size
        for s in range(0, full, size):
            part = flat[s : min(s + size, full)]
            n = len(part)
            rows = -(-n // self.row)
            mask = np.packbits(np.arange(rows * self.row) < n, bitorder="little")
            padded = np.zeros(rows * self.row, self.width)
            padded[:n] = part
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), k) for x, k in ((padded, self.row), (mask, self.row // 8))]
            self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.waiting = [flat[full:]]
        self.held = len(flat) - full

    def close(self, id_type: pa.DataType) -> tuple[str, int, int]:
        self._flush(True)
        self.out.close()
        self.sink.close()
        index = pa.table({"doc_id": pa.array([d[0] for d in self.docs], id_type), "start": pa.array([d[1] for d in self.docs], pa.int64()), "n_tokens": pa.array([d[2] for d in self.docs], pa.int64())})
        with self.fs.open_output_stream(f"{self.own}.index") as sink, pa.ipc.new_stream(sink, index.schema) as out:
            out.write_table(index, max_chunksize=65_536)
        self.fs.move(f"{self.own}.index", f"{self.root}/{self.name}.index")
        self.fs.move(self.own, f"{self.root}/{self.name}")
        return self.name, len(self.docs), self.tokens


class SequenceReader:
    """Random access to a file: ``sequence(i)`` and ``mask(i)`` are views; ``index`` is the documents' table."""

    def __init__(self, folder: str, name: str):
        fs, root = pafs.FileSystem.from_uri(folder)
        open_ = (lambda p: pa.memory_map(p)) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file
        self.batches = list(pa.ipc.open_stream(open_(f"{root}/{name}")))
        self.index = pa.ipc.open_stream(open_(f"{root}/{name}.index")).read_all()
        self.row = self.batches[0].schema.field("ids").type.list_size if self.batches else ROW
        self.starts = np.cumsum([0, *(b.num_rows for b in self.batches)])

    def __len__(self) -> int:
        return int(self.starts[-1])

    def _view(self, i: int, column: str, width: int) -> np.ndarray:
        k = int(np.searchsorted(self.starts, i, "right")) - 1
        j = i - int(self.starts[k])
        return self.batches[k].column(column).values.to_numpy(zero_copy_only=True)[j * width : (j + 1) * width]

    def sequence(self, i: int) -> np.ndarray:
        return self._view(i, "ids", self.row)

    def mask(self, i: int) -> np.ndarray:
        """Packed bits, the first token in the lowest bit."""
        return self._view(i, "mask", self.row // 8)

    def tokens(self) -> Iterator[np.ndarray]:
        """All rows in order, a batch at a time, as views."""
        for b in self.batches:
            yield b.column("ids").values.to_numpy(zero_copy_only=True)

    def documents(self) -> Iterator[tuple]:
        """(doc_id, start in this file, ids) in order."""
        source, have, base = self.tokens(), np.zeros(0, np.uint16), 0
        for ids, starts, counts in zip(*(self.index.column(c).chunks for c in ("doc_id", "start", "n_tokens"))):
            for doc, s, n in zip(ids.to_pylist(), starts.to_pylist(), counts.to_pylist()):
                while base + len(have) < s + n:
                    more = next(source)
                    have, base = np.concatenate([have[s - base :], more]) if s - base < len(have) else more[max(0, s - base - len(have)) :], max(base, s)
                yield doc, s, have[s - base : s - base + n]


def write_token_files(docs: DataFrame, folder: str | None = None, vocabulary: str | None = None, end_id: int | None = 2, id_col: str = "doc_id", text: str = "text", row: int = ROW, file_tokens: int = FILE_TOKENS) -> tuple[str, DataFrame]:
    """Encode every text, end it with ``end_id``, and write the files; returns the folder and the list of files with ``base``, the tokens before each.

    Documents stand in ascending id order, those of one id by their text; null
    ids come first. Null text: as empty, so only the end id. No rows: no files.
    A lost task's files are written again under the same names with the same
    content. Memory: the documents of an Arrow batch and a record batch.
    """
    spark = docs.sparkSession
    path = vocabulary or tokenizer_path("byte_bpe_50k.json")
    folder = folder or new_folder(spark, "tokens")
    prepare_workers(spark)
    picked = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text).alias("text"))
    placed = picked.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part, out, made, kind = encoder(path), TaskContext.get().partitionId(), None, [], None
        width = "<u2" if max(codec.tokenizer.get_vocab_size(with_added_tokens=True), (end_id or 0) + 1) <= 1 << 16 else "<u4"
        end = np.array([] if end_id is None else [end_id], "<u4").tobytes()
        for batch in sliced(batches):
            kind = batch.schema.field(0).type
            for doc, blob in zip(batch.column(0).to_pylist(), codec.encode_many(batch.column(1).to_pylist())):
                out = out or SequenceWriter(folder, f"{part:07d}-{len(made):05d}", width, row)
                out.add(doc, np.frombuffer(blob + end, "<u4"))
                if out.tokens >= file_tokens:
                    made.append(out.close(kind))
                    out = None
        if out:
            made.append(out.close(kind))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made)], ["file", "n_docs", "n_tokens"])

    files = durable(placed.mapInArrow(work, "file string, n_docs long, n_tokens long"), "token-files")
    # one row for each file of 16 million tokens, so one task can sum them up
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return folder, files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_documents(folder: str, files: DataFrame, id_type: str = "bigint", digests: bool = False) -> DataFrame:
    """Per document from the files: doc_id, start (ids of all documents before it), n_tokens, and ids (binary: unsigned 32-bit) or with ``digests`` ids_crc32."""
    schema = f"doc_id {id_type}, start long, n_tokens long, " + ("ids_crc32 long" if digests else "ids binary")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = SequenceReader(folder, name)
                kind, rows = reader.index.schema.field("doc_id").type, []

                def packed() -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), *(pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.int64() if digests else pa.binary())))], [c.split(" ")[0] for c in schema.split(", ")])

                for doc, start, ids in reader.documents():
                    ids = ids.astype("<u4").tobytes()
                    rows.append((doc, base + start, len(ids) // 4, zlib.crc32(ids) if digests else ids))
                    if len(rows) == 1024:
                        yield packed()
                        rows = []
                if rows:
                    yield packed()

    n = max(1, files.count())
    return files.select("file", "base").repartition(min(n, 10_000)).mapInArrow(work, schema)


def token_documents(docs: DataFrame, digests: bool = False, **options) -> DataFrame:
    """Write the files and read every document back from them."""
    folder, files = write_token_files(docs, **options)
    kind = docs.schema[options.get("id_col", "doc_id")].dataType.simpleString()
    return read_documents(folder, files, kind, digests)
