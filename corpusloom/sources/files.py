"""Files as tables: documents, images, listings and blobs, all through Spark's file sources."""

from __future__ import annotations

import os
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import object_key

#: Extensions of documents and of images: fixed values.
DOCUMENTS, IMAGES = ("md", "markdown"), ("png", "jpg", "jpeg", "gif", "webp")


def local_path(url: str) -> str:
    """The path of a file: URL or a bare path. There is no network here, so other schemes are refused."""
    u = urlparse(url.strip())
    if u.scheme == "file":
        if not u.path:
            raise ValueError("a file URL needs a path")
        return u.path
    if u.scheme == "" and url.strip():
        return url.strip()
    raise ValueError(f"unsupported scheme {u.scheme!r}")


def downloaded_name(uuid: Column, name: Column) -> Column:
    return F.concat(uuid, F.lit("_"), name)


def _extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def list_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """path, kind (document or image), length of the files below a folder that have a known extension. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    ext = _extension(F.col("path"))
    kind = F.when(ext.isin(*DOCUMENTS), "document").when(ext.isin(*IMAGES), "image")
    return files.select("path", kind.alias("kind"), "length").filter(F.col("kind").isNotNull())


def first_document(artifacts: DataFrame) -> DataFrame:
    """The document that a walk meets first: folder by folder, in the order of their parts. None is an error of the caller's to raise."""
    return artifacts.filter("kind = 'document'").orderBy(F.split("path", "/")).limit(1)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """path, text of the markdown files below a folder, trimmed; blank ones are left out."""
    raw = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,markdown,MD,MARKDOWN,Md,Markdown}").text(folder)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("text")).filter(F.col("text") != "")


def resolve_images(refs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """refs (path of the document, image as written) with image_path: the file itself if absolute and there, else relative to the
    document's folder, else ''."""
    files = artifacts.filter("kind = 'image'").select(F.regexp_replace("path", r"^file:/+", "/").alias("file"))
    folder = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), r"/[^/]*$", "")
    wanted = F.when(F.col("image").startswith("/"), F.col("image")).otherwise(F.concat(folder, F.lit("/"), F.regexp_replace("image", r"^(\./)+", "")))
    j = refs.withColumn("wanted", wanted)
    return j.join(files, j.wanted == files.file, "left").select(*refs.columns, F.coalesce("file", F.lit("")).alias("image_path"))


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """path, height, width, channels, data of the images that decode; others are dropped, as Spark's image source does."""
    i = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(folder)
    return i.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").toDF("path", "height", "width", "channels", "data")


def write_objects(files: DataFrame, bucket: str) -> DataFrame:
    """Stores (folder, url, content) below a bucket, a folder that all executors share, and gives key and length. Each task writes its own rows;
    a file is written beside and moved, so that a repeated task leaves the same."""
    os.makedirs(bucket, exist_ok=True)
    rows = files.select(object_key(F.col("folder"), F.col("url")).alias("key"), "content").filter(F.col("content").isNotNull())

    def store(batches):
        import uuid

        import pyarrow as pa

        for batch in batches:
            keys, sizes = batch.column(0).to_pylist(), []
            for key, content in zip(keys, batch.column(1)):
                data = content.as_py()
                at = os.path.join(bucket, key)
                os.makedirs(os.path.dirname(at), exist_ok=True)
                with open(f"{at}.{uuid.uuid4().hex}", "wb") as f:
                    f.write(data)
                os.replace(f.name, at)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sizes, pa.int64())], ["key", "length"])

    return rows.mapInArrow(store, "key string, length long")


def object_stat(spark: SparkSession, bucket: str) -> DataFrame:
    """key, length, modified_at of the objects of a bucket that hold anything; Spark passes over empty files."""
    o = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(bucket)
    at = F.regexp_replace("path", r"^file:/+", "/")
    return o.select(F.substring(at, len(os.path.abspath(bucket)) + 2, 4096).alias("key"), "length", F.col("modificationTime").alias("modified_at"))


def download(url: str, uuid: str, folder: str) -> str:
    """Copies a local file (file: URL or path) to <folder>/<uuid>_<name>, by way of a file beside it, and gives the path."""
    import shutil

    source = local_path(url)
    os.makedirs(folder, exist_ok=True)
    at = os.path.join(folder, f"{uuid}_{os.path.basename(source) or 'downloaded_file'}")
    shutil.copyfile(source, f"{at}.part")
    os.replace(f"{at}.part", at)
    return at


def read_objects(spark: SparkSession, bucket: str, keys: DataFrame | None = None) -> DataFrame:
    """key, content of a bucket's objects; with keys (column key) only of those."""
    o = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(bucket)
    at = F.regexp_replace("path", r"^file:/+", "/")
    rows = o.select(F.substring(at, len(os.path.abspath(bucket)) + 2, 4096).alias("key"), "content")
    return rows if keys is None else rows.join(keys.select("key").distinct(), "key", "left_semi")


def delete_object(bucket: str, key: str) -> bool:
    """Whether there was such an object; it is gone then. A key never leads out of its bucket."""
    root = os.path.abspath(bucket)
    at = os.path.abspath(os.path.join(root, key))
    if not at.startswith(root + os.sep):
        raise ValueError(f"{key!r} is no key")
    if not os.path.isfile(at):
        return False
    os.remove(at)
    return True


def upload_artifacts(spark: SparkSession, artifacts: DataFrame, folder: str, bucket: str) -> DataFrame:
    """One row, n_stored: the artifacts (path) that exist, stored below the folder's name in a bucket."""
    wanted = artifacts.select(F.regexp_replace(F.trim("path"), r"^file:/+", "/").alias("at")).filter("at <> ''").distinct()
    root = os.path.abspath(folder)
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_replace("path", r"^file:/+", "/").alias("at"), "content")
    files = there.join(wanted, "at", "left_semi").select(F.lit(root).alias("folder"), F.concat(F.lit("file://"), "at").alias("url"), "content")
    return write_objects(files, bucket).agg(F.count("*").alias("n_stored"))
