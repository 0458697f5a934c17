"""Token ids in Arrow file format: fixed-size-list batches for random access.

Documents are dealt out by id range, encoded in id order and laid end to end in
sequences of equal length; only the last sequence of a file is padded, and the
padding's mask bits are off. Record batches hold equal numbers of sequences, so
sequence i is row i mod SEQUENCES of batch i div SEQUENCES, read from a memory map
without a copy. Beside each token file lies an index file with the start and length
of every document.

Every attempt of a task writes files of its own, and only the attempt that Spark
counts reports their names, so a lost executor leaves no half-written file in use.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate, islice
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_path

SEQUENCE = 2048
SEQUENCES = 128
#: Encoded chunks a worker remembers; then it forgets the older half. Bounds memory only.
MEMORY_CHUNKS = 1_000_000
MEMORY_CHARS = 48

#: Bytes of text for a file; more text takes more files.
RANGE_BYTES = 256 << 20

#: A word of basic and Western European letters with at most one mark after it.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)")
_ACCENTED = [c for c in map(chr, range(0xDF, 0x100)) if c.isalpha()]
# The settings under which white space is dropped and nothing joins across it,
# a run of letters is one piece, and so is a run of other marks.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def drops_white_space(path: str) -> bool:
    """Do a tokenizer's own settings say that texts may be taken apart at spaces and line breaks?

    Added tokens must hold no white space and take none with them, so that none reaches over a break.
    """
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    split = found["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]}
    apart = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"].split() != [t["content"]]) for t in found["added_tokens"])
    return split and apart and found["normalizer"] == _NORMALIZER and not found["truncation"] and not found["padding"] and not found["post_processor"]


def _located(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI, Hadoop's names of S3 included."""
    return pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


class ChunkIds:
    """Ids of texts as little-endian bytes, from calls of the library.

    Where the tokenizer's settings prove that white space is dropped and nothing joins
    across it, texts are encoded by white-space-delimited chunks that are remembered, and
    plain words go straight to the library's model: by those settings normalisation only
    lower-cases them, and a word and the mark after it are pieces of their own. The probes
    guard against a library that reads the settings otherwise. Any other tokenizer
    encodes whole texts.
    """

    #: By file: tasks of one worker share what it has learned.
    made: ClassVar[dict[str, ChunkIds]] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(True) <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.known: dict[str, bytes] = {"": b""}
        self.apart = drops_white_space(path)
        if not self.apart:
            return
        pre = self.tokenizer.pre_tokenizer
        self.bytes_of = str.maketrans({c: "".join(x for x, _ in pre.pre_tokenize_str(c)) for c in _ACCENTED} if pre else {})
        self.marks = dict(zip(".,;:!?", self._whole(list(".,;:!?")), strict=True)) | {"": b""}
        probes = ["Ab", "THEN", "xqzj", "Wonderful", "a", "unbelievablyLongWordThatSplits", "".join(_ACCENTED), "ÉtÉ", "Größe", "niño"]
        self.plain = all(self._whole([p + m])[0] == self._model(p) + self.marks[m] for p in probes for m in self.marks)

    @classmethod
    def of(cls, path: str) -> ChunkIds:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def _whole(self, chunks: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _model(self, word: str) -> bytes:
        word = word.lower()
        return array(self.code, [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.bytes_of))]).tobytes()

    def _encoded(self, chunks: list[str]) -> dict[str, bytes]:
        out, other = {}, []
        for chunk in chunks:
            found = _PLAIN.fullmatch(chunk) if self.plain else None
            if found:
                out[chunk] = self._model(found[1]) + self.marks[found[2]]
            else:
                other.append(chunk)
        return out | dict(zip(other, self._whole(other), strict=True))

    def __call__(self, text: str) -> bytes:
        if not self.apart:
            return self._whole([text])[0]
        chunks = text.replace("\n", " ").split(" ")
        got = list(map(self.known.get, chunks))
        missing = [k for k, y in enumerate(got) if y is None]
        if missing:
            fresh = self._encoded(list({chunks[k] for k in missing}))
            for k in missing:
                got[k] = fresh[chunks[k]]
            if len(self.known) + len(fresh) > MEMORY_CHUNKS:
                self.known = {"": b"", **dict(islice(self.known.items(), len(self.known) // 2, None))}
            self.known.update((k, v) for k, v in fresh.items() if len(k) <= MEMORY_CHARS)
        return b"".join(got)


class SequenceWriter:
    """Lays token ids end to end into fixed-size lists of an Arrow file."""

    def __init__(self, sink, dtype: np.dtype, sequence: int = SEQUENCE, sequences: int = SEQUENCES):
        self.dtype, self.sequence, self.room = dtype, sequence, sequence * sequences
        self.kind = pa.from_numpy_dtype(dtype.newbyteorder("="))
        self.schema = pa.schema([("ids", pa.list_(self.kind, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.file = pa.ipc.new_file(sink, self.schema)
        self.held: list[bytes] = []
        self.size = 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.size += len(ids) // self.dtype.itemsize
        if self.size >= self.room:
            data = np.frombuffer(b"".join(self.held), self.dtype)
            whole = len(data) // self.room * self.room
            for at in range(0, whole, self.room):
                self._write(data[at : at + self.room], self.room)
            self.held, self.size = [data[whole:].tobytes()], len(data) - whole

    def _write(self, data: np.ndarray, filled: int) -> None:
        mask = np.arange(len(data)) < filled
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (data.astype(self.dtype.newbyteorder("=")), mask)]
        self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        data = np.frombuffer(b"".join(self.held), self.dtype)
        if len(data):
            self._write(np.pad(data, (0, -len(data) % self.sequence)), len(data))
        self.file.close()


class SequenceFile:
    """Zero-copy random access to the sequences and masks of a token file."""

    def __init__(self, path: str, sequences: int = SEQUENCES):
        fs, at = _located(path)
        source = pa.memory_map(at) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(at)
        self.file, self.sequences = pa.ipc.open_file(source), sequences

    def __len__(self) -> int:
        n = self.file.num_record_batches
        return (n - 1) * self.sequences + self.file.get_batch(n - 1).num_rows if n else 0

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask (a bit for each id) of sequence i, both views of the file."""
        batch = self.file.get_batch(i // self.sequences)
        ids, mask = (batch.column(c)[i % self.sequences].values for c in (0, 1))
        return ids.to_numpy(zero_copy_only=True), mask

    def values(self) -> Iterator[np.ndarray]:
        """All ids, a record batch at a time, padding included."""
        for k in range(self.file.num_record_batches):
            yield self.file.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True)


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int | None = 1, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int, int]]:
    """Write the documents in ascending id order; return (file, documents, ids) in that order.

    A null text counts as empty; ``end_id`` is appended to every document. Null ids
    come first, and rows with equal ids lie side by side. Extra columns are ignored.
    The list has one entry for each non-empty range: there are as many as shuffle
    partitions, or as RANGE_BYTES go into the texts. No ids or documents reach the driver.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    rows = rows.repartitionByRange(ranges, "id").sortWithinPartitions("id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        encode = ChunkIds.of(tokenizer_path)
        end = b"" if end_id is None else np.array([end_id], encode.dtype).tobytes()
        name = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.arrow"
        fs, at = _located(name)
        fs.create_dir(os.path.dirname(at), recursive=True)
        n_docs = total = 0
        with fs.open_output_stream(at) as sink, fs.open_output_stream(f"{at}.index") as index_sink:
            out = SequenceWriter(sink, encode.dtype)
            schema = pa.schema([("id", first.schema.field(0).type), ("start", pa.int64()), ("n_tokens", pa.int64())])
            with pa.ipc.new_file(index_sink, schema) as index:
                batch: pa.RecordBatch | None = first
                while batch is not None:
                    sizes = []
                    for text in batch.column(1):
                        out.add(ids := encode(text.as_py()) + end)
                        sizes.append(len(ids) // encode.dtype.itemsize)
                    starts = np.cumsum([total, *sizes], dtype=np.int64)
                    index.write_batch(pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts[:-1]), pa.array(sizes, pa.int64())], schema=schema))
                    n_docs, total = n_docs + len(sizes), int(starts[-1])
                    batch = next(batches, None)
            out.close()
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "file": [name], "n_docs": [n_docs], "n_ids": [total]})

    found = rows.mapInArrow(write, "part long, file string, n_docs long, n_ids long").collect()
    return [(r["file"], r["n_docs"], r["n_ids"]) for r in sorted(found)]


def read_token_files(docs: DataFrame, files: list[tuple[str, int, int]], id_col: str = "doc_id") -> DataFrame:
    """Rows id, start, n_tokens, ids_crc32 of every document, read from its token file.

    start counts the ids of all documents before it; the checksum is over the ids as
    little-endian unsigned 32-bit integers.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    before = accumulate((n for _, _, n in files), initial=0)
    listed = spark.createDataFrame([(f, b) for (f, _, _), b in zip(files, before, strict=False)], "file string, before long").repartition(max(1, len(files)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, at = _located(name)
                stream = SequenceFile(name).values()
                here = np.empty(0, np.uint32)
                with fs.open_input_file(f"{at}.index") as source:
                    index = pa.ipc.open_file(source)
                    for k in range(index.num_record_batches):
                        part = index.get_batch(k)
                        sums = []
                        for n in part.column(2).to_pylist():
                            crc = 0
                            while n:
                                if not len(here):
                                    here = next(stream).astype("<u4")
                                crc = zlib.crc32(here[:n], crc)
                                n, here = n - min(n, len(here)), here[n:]
                            sums.append(crc)
                        starts = pa.array(part.column(1).to_numpy() + base)
                        yield pa.RecordBatch.from_arrays([part.column(0), starts, part.column(2), pa.array(sums, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    return listed.mapInArrow(read, f"id {id_type}, start long, n_tokens long, ids_crc32 long")
