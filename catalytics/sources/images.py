"""Product images: files scanned with ``binaryFile``, a manifest of the newest version of each product, uploads.

Images lie as files ``part-<asin>.<version>-<call>.txt`` in the shares of one folder of a shared file system.  An upload never overwrites a file: it adds a version, and the manifest says which version
is served.  A listing meets as many folders as there are shares, however many images there are.  Files under
``image=<asin>.<version>/``, as Spark's own writer lays them out, are read too.  The scan reads path and length
of every file and hashes the content in the task that reads it; contents are not shuffled.  On a stream only
files that are new are read: tasks list the folders, keyed state knows the paths met before, and neither paths nor
contents come to the driver.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from itertools import batched

import pyarrow as pa
from pyarrow import fs as PF
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalytics.streaming.orders import _run, _sink

# The accepted extensions and their content types.
CONTENT_TYPES = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".webp": "image/webp"}
SHARES = 64                    # tasks that write images, and folders they write to; tasks that list folders on a stream
LISTED = 10_000                # rows of a listing handed on at once
PIECE = 1 << 20                # bytes of a file read at once on a stream
BAD_EXTENSION = "Only jpg/png/webp allowed"
IMAGE_SCHEMA = T.StructType([T.StructField("asin", T.LongType()), T.StructField("version", T.LongType()), T.StructField("length", T.LongType()),
                             T.StructField("sha256", T.StringType())])


def extension(name: str):
    """Lower-case extension with its dot; empty where the file name has none."""
    return F.lower(F.regexp_extract(name, r"[^./\\](\.[^./\\]*)$", 1))


def upload_requests(uploads: DataFrame) -> DataFrame:
    """The stored file name and content type of each upload (id, owner_email, ts, filename), or the reason against it.

    The name is made of the owner's name before the @, the listing id and the extension.
    """
    ext = extension("filename")
    types = F.create_map(*[F.lit(x) for kv in CONTENT_TYPES.items() for x in kv])
    fine = ext.isin(*CONTENT_TYPES)
    name = F.concat(F.lit("up_"), F.substring_index(F.trim("owner_email"), "@", 1), F.lit("_"), F.col("id").cast("string"), ext)
    return uploads.withColumns({"image_filename": F.when(fine, name), "content_type": F.when(fine, types[ext]),
                                "reject_reason": F.when(fine.isNull() | ~fine, BAD_EXTENSION)})


def split_uploads(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) uploads."""
    r = upload_requests(uploads)
    return r.where(F.col("reject_reason").isNull()).drop("reject_reason"), r.where(F.col("reject_reason").isNotNull())


def _arrow_folder(spark: SparkSession, folder: str) -> str | None:
    """The folder as a URI that Arrow opens too; None where only Spark knows the file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    if uri.getScheme() == "file":
        return f"file://{uri.getRawPath()}"
    try:
        PF.FileSystem.from_uri(uri.toString())
    except (pa.ArrowException, OSError, ValueError):
        return None
    return uri.toString()


def _write_files(uri: str, call: str):
    """Write rows (image, value), sorted by image, as one file per image: aside first, then under its name, which a repeated task gives again."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = PF.FileSystem.from_uri(uri)
        share = f"{root}/share={TaskContext.get().partitionId()}"
        image, out, written = None, None, 0
        aside = f"{share}/_{uuid.uuid4().hex}"

        def close() -> int:
            if out is None:
                return 0
            out.close()
            store.move(aside, f"{share}/part-{image}-{call}.txt")
            return 1

        for part in parts:
            for name, value in zip(part.column("image").to_pylist(), part.column("value").to_pylist()):
                if name != image or out is None:
                    if out is None:
                        store.create_dir(share)
                    written += close()
                    image, out = name, store.open_output_stream(aside, compression=None)
                out.write((value or "").encode() + b"\n")
        written += close()
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], ["files"])
    return run


def write_images(images: DataFrame, folder: str) -> None:
    """Store rows (asin, version, body) as one file each; a task writes one file after the other.

    The number of tasks is given, so that Spark does not join small partitions into one task, whose time goes by files.
    """
    spark = images.sparkSession
    name = F.concat_ws(".", F.col("asin").cast("string"), F.col("version").cast("string"))
    dealt = images.select(name.alias("image"), F.col("body").cast("string").alias("value")).repartition(SHARES, "image").sortWithinPartitions("image", "value")
    uri = _arrow_folder(spark, folder)
    if uri is None:
        dealt.write.mode("append").partitionBy("image").text(folder)
        return
    store, root = PF.FileSystem.from_uri(uri)
    store.create_dir(root)                                # an empty set of images is an empty folder
    dealt.mapInArrow(_write_files(uri, uuid.uuid4().hex), "files long").agg(F.sum("files")).collect()


def _images(raw: DataFrame, sha256) -> DataFrame:
    part = lambda k: F.regexp_extract("path", r"/(?:image=|part-)(\d+)\.(\d+)[/-]", k).try_cast("bigint")
    return raw.select(part(1).alias("asin"), part(2).alias("version"), "length", sha256.alias("sha256"))


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """asin, version, length, sha256 of every stored image file."""
    return _images(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folder),
                   F.sha2("content", 256))


def manifest(images: DataFrame) -> DataFrame:
    """The newest version of each product's image: asin, version, length, sha256, versions (how many are stored)."""
    newest = F.max(F.struct("version", "length", "sha256")).alias("n")
    return images.groupBy("asin").agg(newest, F.count("*").alias("versions")).select("asin", "n.version", "n.length", "n.sha256", "versions")


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over: unfinished files and their folders."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _entries(store: PF.FileSystem, folder: str) -> Iterator[tuple[str, bool]]:
    """(path, whether it is a folder) of the image files and folders in a folder; as in Spark's scans, empty files are none."""
    for e in store.get_file_info(PF.FileSelector(folder)):
        inner = e.type == PF.FileType.Directory
        if not _hidden(e.base_name) and (inner or (e.type == PF.FileType.File and e.size and e.base_name.startswith("part-"))):
            yield e.path, inner


def _path_batches(entries: Iterable[tuple[str, bool]]) -> Iterator[pa.RecordBatch]:
    for some in batched(entries, LISTED):
        paths, inner = zip(*some)
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(inner, pa.bool_())], ["path", "is_folder"])


def _list_root(uri: str):
    """For each row: what lies directly in the image folder."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = PF.FileSystem.from_uri(uri)
        yield from _path_batches(e for part in parts for _ in range(part.num_rows) for e in _entries(store, root))
    return run


def _list_folders(uri: str):
    """Rows (path, is_folder): folders become the files in them, at any depth."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = PF.FileSystem.from_uri(uri)

        def files() -> Iterator[tuple[str, bool]]:
            for part in parts:
                todo = list(zip(part.column("path").to_pylist(), part.column("is_folder").to_pylist()))
                while todo:
                    path, inner = todo.pop()
                    if inner:
                        todo.extend(_entries(store, path))
                    else:
                        yield path, inner
        yield from _path_batches(files())
    return run


def _hash_files(uri: str):
    """Rows (path): path, length and sha256 of each file, which is read in pieces and never held whole."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = PF.FileSystem.from_uri(uri)
        for part in parts:
            lengths, digests = [], []
            for path in part.column("path").to_pylist():
                digest, length = hashlib.sha256(), 0
                with store.open_input_stream(path, compression=None) as file:
                    while piece := file.read(PIECE):
                        digest.update(piece)
                        length += len(piece)
                lengths.append(length)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("path"), pa.array(lengths, pa.int64()), pa.array(digests, pa.string())], ["path", "length", "sha256"])
    return run


def _new_files(spark: SparkSession, uri: str) -> DataFrame:
    """path, length, sha256 of the files that no earlier batch has met: each batch lists the folders and reads what its keyed state does not know.

    The one row of a batch is its clock; a run with ``availableNow`` makes one batch.  A batch that finds no new file gives no rows.
    """
    store, root = PF.FileSystem.from_uri(uri)
    if store.get_file_info(root).type != PF.FileType.Directory:
        raise FileNotFoundError(f"no image folder {uri}")
    clock = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load().select("value")
    found = clock.mapInArrow(_list_root(uri), "path string, is_folder boolean").repartition(SHARES, "path").mapInArrow(
        _list_folders(uri), "path string, is_folder boolean")
    return found.select("path").dropDuplicates(["path"]).mapInArrow(_hash_files(uri), "path string, length long, sha256 string")


def start_manifest(spark: SparkSession, folder: str, sink_dir: str, checkpoint: str, available_now: bool = True):
    """The manifest as a stream over the image folder: keyed state per product; each batch gives out the products it touched.

    Spark's own file stream takes every path through the driver and lists new files one by one; it is used only where
    Arrow does not know the file system.
    """
    uri = _arrow_folder(spark, folder)
    if uri is None:
        raw = spark.readStream.format("binaryFile").schema(_BINARY).option(
            "recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folder)
        images = _images(raw, F.sha2("content", 256))
    else:
        images = _images(_new_files(spark, uri), F.col("sha256"))
    return _run(manifest(images), sink_dir, checkpoint, available_now, "1 minute", "update")


_BINARY = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
                        T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def read_manifest(spark: SparkSession, sink_dir: str) -> DataFrame:
    """The latest row of each product: the one with the newest version and the most versions seen."""
    schema = T.StructType([*IMAGE_SCHEMA.fields, T.StructField("versions", T.LongType())])
    rows = _sink(spark, sink_dir, schema)
    last = F.max(F.struct("version", "versions", "length", "sha256")).alias("n")
    return rows.groupBy("asin").agg(last).select("asin", "n.version", "n.length", "n.sha256", "n.versions")


def missing_images(catalog: DataFrame, images: DataFrame) -> DataFrame:
    """J7 over stored files: products without an image."""
    return catalog.join(images.select("asin").distinct(), "asin", "left_anti")
