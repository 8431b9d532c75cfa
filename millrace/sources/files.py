"""File sources and sinks. Outputs go under the folder that ``spark.checkpoint.dir`` names, which all executors share."""

from __future__ import annotations

import gzip
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.ranking import grouped_rank
from millrace.session import ensure_checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


_SCRATCH: list[str] = []


def drop_scratch(spark: SparkSession) -> None:
    """Remove what this driver has written to ``scratch`` paths, once no frame reads it any more."""
    while _SCRATCH:
        at = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write_columns(frame: DataFrame, path: str, by: list[str] | None = None, order: list[str] | None = None) -> str:
    """Parquet with zstd; with ``by``, one folder a value, each value's rows brought together first and sorted by ``order``.
    The path must be new, or its old files go first: ``replace`` is for tables that are read meanwhile."""
    if by:
        frame = frame.repartition(*by).sortWithinPartitions(*by, *(order or []))
    writer = frame.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return path


class Replaced:
    """A table that is replaced as a whole: every version is written to a folder of its own, and the name of the newest
    stands in one small file, exchanged by a rename. A reader sees the old version or the new one, never a part; old
    versions stay until ``drop_old``, so who reads one still can."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def replace(self, frame: DataFrame) -> None:
        version = f"version-{uuid.uuid4().hex}"
        write_columns(frame, f"{self.path}/{version}")
        numbers = self._pointers()
        aside = self._path(f"{self.path}/.{version}")
        out = self._files.create(aside, True)
        out.write(bytearray(version.encode()))
        out.close()
        # a new pointer's number is higher than any; of two writers one fails to rename and tries the next
        number = max(numbers, default=0) + 1
        while not self._files.rename(aside, self._path(f"{self.path}/current-{number:012d}")):
            number += 1

    def _pointers(self) -> list[int]:
        if not self._files.exists(self._path(self.path)):
            return []
        names = [f.getPath().getName() for f in self._files.listStatus(self._path(self.path))]
        return sorted(int(n[8:]) for n in names if n.startswith("current-"))

    def current(self) -> str:
        """The folder of the newest version."""
        numbers = self._pointers()
        if not numbers:
            raise FileNotFoundError(self.path)
        stream = self._files.open(self._path(f"{self.path}/current-{numbers[-1]:012d}"))
        try:
            return f"{self.path}/{bytes(stream.readAllBytes()).decode()}"
        finally:
            stream.close()

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.current())

    def drop_old(self) -> None:
        """Remove all versions but the newest, and their pointers."""
        newest, numbers = self.current().rsplit("/", 1)[-1], self._pointers()
        for number in numbers[:-1]:
            self._files.delete(self._path(f"{self.path}/current-{number:012d}"), False)
        for f in self._files.listStatus(self._path(self.path)):
            if f.getPath().getName().startswith("version-") and f.getPath().getName() != newest:
                self._files.delete(f.getPath(), True)


def listing(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """(path, length) of the files below a folder whose name fits the pattern, in path order; no file is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length").orderBy("path")


def footers(spark: SparkSession, folder: str, column: str) -> DataFrame:
    """(path, rows, text_bytes) of Parquet files from their footers: bytes are the column's uncompressed size less the
    four bytes a value its lengths take. Any file system that Arrow knows by its address (local, HDFS, S3, GCS)."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        for frame in batches:
            rows = []
            for path in frame["path"]:
                store, place = store_of(path)
                meta = pq.read_metadata(place, filesystem=store)
                names = [meta.schema.column(i).path for i in range(meta.num_columns)]
                at = names.index(column) if column in names else None
                size = sum(meta.row_group(g).column(at).total_uncompressed_size for g in range(meta.num_row_groups)) if at is not None else 0
                rows.append((path, meta.num_rows, max(0, size - 4 * meta.num_rows)))
            yield pd.DataFrame(rows, columns=["path", "rows", "text_bytes"])

    return listing(spark, folder).select("path").mapInPandas(read, "path string, rows long, text_bytes long")


def append_records(frame: DataFrame, path: str) -> None:
    """JSON lines, one record a row. Doubles that JSON cannot hold are refused."""
    doubles = [f.name for f in frame.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    for name in doubles:
        finite = F.col(name).isNull() | (~F.isnan(name) & (F.abs(name) != float("inf")))
        frame = frame.withColumn(name, F.when(finite, F.col(name)).otherwise(F.raise_error(F.lit(f"{name} is not finite")).cast("double")))
    frame.write.mode("append").json(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


@F.pandas_udf(T.StringType())
def blob_text(blobs: pd.Series, charsets: pd.Series) -> pd.Series:
    """The text of a gzip blob in its charset (UTF-8 where that is null); null where it is no gzip, the charset is unknown or
    the bytes are not of it."""
    def one(data, charset):
        try:
            return gzip.decompress(data).decode(charset or "utf-8")
        except (OSError, EOFError, UnicodeDecodeError, LookupError, TypeError, ValueError, zlib.error):
            return None
    return pd.Series([one(b, c) if b is not None else None for b, c in zip(blobs, charsets)], dtype="object")


@F.pandas_udf(T.BinaryType())
def text_blob(texts: pd.Series, charsets: pd.Series) -> pd.Series:
    """A text as a gzip blob in a charset (UTF-8 where null); characters that it lacks become question marks."""
    return pd.Series([gzip.compress(t.encode(c or "utf-8", "replace"), 1) if t is not None else None for t, c in zip(texts, charsets)], dtype="object")


#: Documents of one token file.
FILE_DOCUMENTS = 4096


def store_of(uri: str):
    """(file system, path in it) of an address, as Arrow knows it."""
    import pyarrow.fs as pafs

    place = uri.removeprefix("file:")
    return (pafs.LocalFileSystem(), "/" + place.lstrip("/")) if place != uri or "://" not in uri else pafs.FileSystem.from_uri(uri)


def write_token_files(frame: DataFrame, path: str, order: list[str], tokens: str) -> DataFrame:
    """Token arrays as flat files, ``FILE_DOCUMENTS`` documents each in the order of ``order``: ``k.bin`` holds the tokens one
    after another, ``k.idx`` the 64-bit places where documents begin and the last one ends; ``counts`` lists (file, documents,
    tokens, width) as JSON lines. Returns the counts. Tokens take two bytes each, four in a file that has one beyond.

    A file is written under a name of its own and then renamed, so a task that runs twice leaves one whole file. A null
    array is a document without tokens.
    """
    ranked = grouped_rank(frame.select(*order, F.coalesce(tokens, F.array().cast("array<int>")).alias("_t")), [], order, rank="_k")
    placed = ranked.select(F.floor((F.col("_k") - 1) / FILE_DOCUMENTS).alias("file"), "_k", "_t")

    def write(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_k")
        lengths = part["_t"].map(len).to_numpy()
        flat = np.concatenate([np.asarray(t, dtype=np.int64) for t in part["_t"]]) if lengths.sum() else np.zeros(0, np.int64)
        width = 2 if not len(flat) or flat.max() < 2**16 else 4
        name = int(part["file"].iloc[0])
        store, folder = store_of(path)
        store.create_dir(folder, recursive=True)
        for suffix, data in (("bin", flat.astype(f"<u{width}").tobytes()), ("idx", np.concatenate([[0], np.cumsum(lengths)]).astype("<i8").tobytes())):
            aside = f"{folder}/.{name}.{suffix}.{uuid.uuid4().hex}"
            with store.open_output_stream(aside) as out:
                out.write(data)
            store.move(aside, f"{folder}/{name}.{suffix}")
        return pd.DataFrame({"file": [name], "documents": [len(part)], "tokens": [int(lengths.sum())], "width": [width]})

    schema = "file long, documents long, tokens long, width int"
    placed.groupBy("file").applyInPandas(write, schema).write.mode("overwrite").json(f"{path}/counts")
    return frame.sparkSession.read.schema(schema).json(f"{path}/counts")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(document, tokens) of ``write_token_files``; documents are numbered from 0 over all files. A file at a time is read."""
    counts = spark.read.schema("file long, documents long, tokens long, width int").json(f"{path}/counts")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, width in zip(batch["file"], batch["width"]):
                store, folder = store_of(path)
                with store.open_input_stream(f"{folder}/{name}.bin") as data, store.open_input_stream(f"{folder}/{name}.idx") as places:
                    flat, at = np.frombuffer(data.read(), dtype=f"<u{width}"), np.frombuffer(places.read(), dtype="<i8")
                yield pd.DataFrame({"document": name * FILE_DOCUMENTS + np.arange(len(at) - 1), "tokens": [flat[a:b].astype(np.int32) for a, b in zip(at, at[1:])]})

    return counts.select("file", "width").repartition(F.col("file")).mapInPandas(read, "document long, tokens array<int>")


def tokenizer_lines(vocabulary: DataFrame) -> DataFrame:
    """The text form of a vocabulary: base64 and rank, one token a line (column ``value``)."""
    return vocabulary.select(F.concat_ws(" ", "token_b64", F.col("token_rank").cast("string")).alias("value"))


def read_tokenizer(lines: DataFrame) -> DataFrame:
    parts = F.split("value", " ")
    return lines.where("value <> ''").select(F.element_at(parts, 2).cast("int").alias("token_rank"), F.element_at(parts, 1).alias("token_b64"))


class KeyValue:
    """A keyed store in append-only column files: a later put of a key wins."""

    def __init__(self, path: str):
        self.path = path

    def put(self, rows: DataFrame, batch: int) -> None:
        """rows of (key, value); ``batch`` numbers puts in order."""
        rows.select("key", "value").withColumn("batch", F.lit(batch)).write.mode("append").option("compression", "zstd").parquet(self.path)

    def get(self, keys: DataFrame) -> DataFrame:
        """(key, value) of the keys; null for those never put."""
        stored = keys.sparkSession.read.schema("key string, value string, batch int").parquet(self.path)
        latest = stored.groupBy("key").agg(F.max_by("value", F.struct("batch", "value")).alias("value"))
        return keys.select("key").join(latest, "key", "left")
