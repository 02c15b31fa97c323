"""Token-id files: flat unsigned integers plus 64-bit document offsets, to be mapped into memory.

A table of texts becomes, in ascending ``doc_id`` order, one pair of files per partition:

* ``part-NNNNNN.bin``: the ids of its documents in a row, little-endian, 16 bits each where the vocabulary allows, else 32;
* ``part-NNNNNN.idx``: little-endian 64-bit; n document ids, then n + 1 offsets in ids from the start of the part.

The manifest (a table: part, file, n_docs, n_tokens, bytes an id, base) holds where each part begins among all ids. Bases are
prefix sums over the parts, so no task needs the ids of another. A task writes under a name of its own attempt and the manifest
names only the files of attempts that Spark has committed, so a re-run task can't leave a half-written part behind.

Null texts are empty (the end id only), null ids sort first and come back null; repeated ids keep all their rows, in the order of
a hash of the text; an empty table gives an empty manifest. A text of any length is encoded whole, in one task. Other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.llm.common import NO_ID, plain, shuffle_width, stage
from gridlens.llm.tokens import batches, encoder
from gridlens.session import scratch

MANIFEST = "part int, file string, n_docs long, n_tokens long, width int"


def _file_system(uri: str):
    """The Arrow file system of a folder that all machines reach, and the path in it."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    uri = uri.replace("s3a://", "s3://", 1)
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def write(docs: DataFrame, vocabulary: str, end: int = 2, folder: str | None = None, parts: int | None = None) -> DataFrame:
    """Encode and write all texts of ``docs``; returns the manifest with each part's base."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "token-files")
    rows = plain(docs).withColumn("_h", F.xxhash64("text"))
    rows = rows.repartitionByRange(parts or shuffle_width(spark), "doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(vocabulary, end), TaskContext.get().partitionId()
        width = 2 if encode.largest_id < 1 << 16 else 4
        files, at = _file_system(folder)
        files.create_dir(at, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex[:8]}"
        ids, ends, total = [], [np.zeros(1, "<i8")], 0
        stream = None
        for frame in frames:
            texts = frame.column(1).to_pylist()
            ids.append(np.array([NO_ID if x is None else x for x in frame.column(0).to_pylist()], "<i8"))
            stream = stream or files.open_output_stream(f"{at}/{name}.bin")
            for a, b in batches(texts):
                coded = encode.encode(texts[a:b])
                flat = np.frombuffer(b"".join(coded), "<u4")
                stream.write(flat.astype("<u2").tobytes() if width == 2 else flat.tobytes())
                ends.append(total + np.cumsum([len(c) // 4 for c in coded], dtype="<i8"))
                total += len(flat)
        if stream is None:
            return
        stream.close()
        with files.open_output_stream(f"{at}/{name}.idx") as out:
            out.write(np.concatenate(ids).tobytes() + np.concatenate(ends).tobytes())
        yield pa.RecordBatch.from_pylist([{
            "part": part, "file": f"{folder}/{name}", "n_docs": int(sum(map(len, ids))), "n_tokens": total, "width": width,
        }], schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32())]))

    return with_bases(spark, stage(rows.mapInArrow(run, MANIFEST), "token-manifest"))


def with_bases(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Prefix sums over the parts; a row per written partition, a few numbers each."""
    parts = sorted(manifest.collect(), key=lambda r: r.part)
    bases = np.concatenate([[0], np.cumsum([r.n_tokens for r in parts], dtype=np.int64)]).tolist()
    return spark.createDataFrame([(*r, b) for r, b in zip(parts, bases)], MANIFEST + ", base long")


def read(manifest: DataFrame, parts: int | None = None) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    spark = manifest.sparkSession

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                yield from documents(row.file, row.n_docs, row.width, row.base)

    dealt = manifest.repartition(parts or shuffle_width(spark), "part")
    return dealt.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def documents(file: str, n_docs: int, width: int, base: int, at_once: int = 4096) -> Iterator[pd.DataFrame]:
    """Read one pair of files, mapped into memory where the file system is local, else by ranges."""
    from pyarrow import fs

    files, path = _file_system(file)
    opened = pa.memory_map if isinstance(files, fs.LocalFileSystem) else files.open_input_file
    with opened(f"{path}.idx") as index, opened(f"{path}.bin") as flat:
        heads = np.frombuffer(index.read(), "<i8")
        ids, ends = heads[:n_docs], heads[n_docs:]
        for a in range(0, n_docs, at_once):
            b = min(a + at_once, n_docs)
            flat.seek(int(ends[a]) * width)
            tokens = np.frombuffer(flat.read(int(ends[b] - ends[a]) * width), f"<u{width}").astype("<u4")
            cuts = ends[a:b + 1] - ends[a]
            yield pd.DataFrame({
                "doc_id": pd.array([None if x == NO_ID else x for x in ids[a:b].tolist()], "Int64"),
                "start": base + ends[a:b], "n_tokens": np.diff(cuts),
                "ids_crc32": np.array([zlib.crc32(tokens[x:y]) for x, y in zip(cuts, cuts[1:])], np.int64),
            })
