"""Token ids of a corpus as Arrow files of equal-length sequences.

Every range of ascending document ids becomes one Arrow file.  A record batch has
two fixed-size-list columns, ``ids`` and ``mask``; the ids of all documents of the
range follow each other without gaps, and only the last sequence of a file is
padded (mask false).  The lists have one length, so any position of any sequence
is found by arithmetic in the mapped file, without a copy.

A task writes to a name of its own and returns it with the places of its documents;
the manifest made of those rows is the commit.  A task that is lost or runs twice
leaves a file no manifest names, never a wrong one.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs, ipc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultatlas.llm.tokens import ids_crc32, worker_encoder
from faultatlas.plans.layout import checkpoint_folder, cut

MANIFEST = "doc_id long, file string, part int, place long, part_start long, n_tokens long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def sequence_schema(length: int, dtype: str) -> pa.Schema:
    ids = pa.uint16() if dtype == "<u2" else pa.uint32()
    return pa.schema([("ids", pa.list_(ids, length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Cuts a stream of ids into sequences and writes them in batches."""

    def __init__(self, sink, length: int, dtype: str, rows: int):
        self.length, self.dtype, self.block = length, dtype, length * rows
        self.schema = sequence_schema(length, dtype)
        self.file = ipc.new_file(sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.held = self.written = 0

    def add(self, ids: np.ndarray) -> int:
        """Append ids; returns their first position in the file."""
        start = self.written + self.held
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            stream = np.concatenate(self.waiting)
            whole = len(stream) // self.block * self.block
            for at in range(0, whole, self.block):
                self._batch(stream[at : at + self.block], self.block)
            self.waiting, self.held = [stream[whole:]], len(stream) - whole
        return start

    def _batch(self, block: np.ndarray, real: int) -> None:
        ids = pa.FixedSizeListArray.from_arrays(pa.array(block, self.schema[0].type.value_type), self.length)
        mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(block)) < real), self.length)
        self.file.write_batch(pa.record_batch([ids, mask], schema=self.schema))
        self.written += real

    def close(self) -> None:
        """Pad the last sequence and end the file."""
        if self.held:
            rest = np.concatenate(self.waiting)
            padded = np.zeros(-(-len(rest) // self.length) * self.length, self.dtype)
            padded[: len(rest)] = rest
            self._batch(padded, len(rest))
        self.file.close()


class SequenceReader:
    """Ids at any place of a file; only the batches asked for are touched."""

    def __init__(self, uri: str):
        system, path = fs.FileSystem.from_uri(uri)
        local = isinstance(system, fs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else system.open_input_file(path)
        self.file = ipc.open_file(self.source)
        self.length = self.file.schema[0].type.list_size
        first = self.file.get_batch(0) if self.file.num_record_batches else None
        self.block = len(first) * self.length if first is not None else 0

    def batch(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (no copy) and mask of a batch, each as one flat array."""
        ids, mask = self.file.get_batch(k).columns
        return ids.flatten().to_numpy(), mask.flatten().to_numpy(zero_copy_only=False)

    def ids(self, place: int, n: int) -> np.ndarray:
        """``n`` (one or more) ids from position ``place`` of the file's stream."""
        found = []
        while n > 0:
            k, at = divmod(place, self.block)
            here = self.file.get_batch(k).column(0).flatten().to_numpy()[at : at + n]
            found.append(here)
            place, n = place + len(here), n - len(here)
        return found[0] if len(found) == 1 else np.concatenate(found)


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_path: str, length: int = 2048, rows: int = 256,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Encode whole texts, write the files below ``folder``, return the manifest.

    Rows are range-partitioned by document id (ties by the text), each range is
    written in order by one task.  A null or empty text is the end id alone; null
    ids come first; repeated rows are written each; other columns are not read.
    An empty table gives no file and no row.  ``length`` and ``rows`` are the
    sequence length and the sequences of a batch.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = encoder = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                encoder = worker_encoder(tokenizer_path)
                uri = f"{folder}/{uuid.uuid4().hex}.arrow"
                system, path = fs.FileSystem.from_uri(uri)
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                sink = system.open_output_stream(path)
                writer = SequenceWriter(sink, length, encoder.dtype, rows)
            places, sizes = [], []
            for body in batch["text"]:
                ids = encoder.ids(body.as_py())
                places.append(writer.add(ids))
                sizes.append(len(ids))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([uri] * len(sizes)), batch["part"], pa.array(places, pa.int64()), pa.array(sizes, pa.int64())],
                ["doc_id", "file", "part", "place", "n_tokens"],
            )
        if writer is not None:
            writer.close()
            sink.close()

    ordered = (
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text", F.spark_partition_id().alias("part"))
    )
    placed = cut(ordered.mapInArrow(write, "doc_id long, file string, part int, place long, n_tokens long"))
    sizes = placed.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row per file takes part in the running sum.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("part_start"))
    return placed.join(starts, "part").select(*(f.split()[0] for f in MANIFEST.split(", ")))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Read every document back from the files: place in the corpus, length, checksum."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = reader = None
        for batch in batches:
            sums = []
            places = (batch[c].to_pylist() for c in ("file", "place", "n_tokens"))
            for file, place, n in zip(*places, strict=True):
                if file != name:
                    name, reader = file, SequenceReader(file)
                sums.append(ids_crc32(reader.ids(place, n)))
            start = pc.add(batch["part_start"], batch["place"])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], start, batch["n_tokens"], pa.array(sums, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    rows = manifest.repartition(F.col("file")).sortWithinPartitions("file", "place")
    return rows.mapInArrow(read, READ)


def token_file_folder(spark: SparkSession) -> str:
    """A new folder of token files below the folder all executors share, as a URI."""
    shared = re.sub("^(file:)?/+", "file:///", checkpoint_folder(spark).rstrip("/"))
    return f"{shared}/token_files/{uuid.uuid4().hex}"
