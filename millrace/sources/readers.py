"""Sources: files by type, databases, streams read as a bounded batch, and the media and lake formats that need a package."""

from __future__ import annotations

import ipaddress
import re
import socket
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.exprs import html_text
from millrace.operators.guards import Rejected, check_sql
from millrace.session import shared_dir

#: File types by their endings.
TYPES = {".csv": "csv", ".json": "json", ".jsonl": "jsonl", ".parquet": "parquet", ".html": "text", ".htm": "text", ".md": "text", ".txt": "text"}

#: The columns of the unified multimodal table.
_S, _B, _I, _D = T.StringType(), T.BinaryType(), T.IntegerType(), T.DoubleType()
UNIFIED = T.StructType(
    [T.StructField(n, k) for n, k in (
        ("id", _S), ("modality", _S), ("source", _S), ("created_at", T.TimestampType()), ("filename", _S), ("text_content", _S), ("image_data", _B), ("image_thumbnail", _B), ("image_preview", _B), ("image_width", _I), ("image_height", _I),
        ("exif_make", _S), ("exif_model", _S), ("exif_gps_lat", _D), ("exif_gps_lon", _D), ("exif_capture_time", _S), ("video_data", _B), ("keyframe_count", _I), ("video_duration_ms", T.LongType()), ("text_embedding", T.ArrayType(T.FloatType())),
    )]
)
GROUPS = {
    "text": ["text_content", "text_embedding"], "image": ["image_data", "image_thumbnail", "image_preview", "image_width", "image_height", "exif_make", "exif_model", "exif_gps_lat", "exif_gps_lon", "exif_capture_time"],
    "video": ["video_data", "keyframe_count", "video_duration_ms"],
}
COMMON = ["id", "modality", "source", "created_at", "filename"]


def file_type(path: str) -> str:
    m = re.search(r"\.[a-z0-9]+$", path.lower().rstrip("/"))
    if not m or m[0] not in TYPES:
        raise Rejected(f"unsupported file type: {path}")
    return TYPES[m[0]]


def read_files(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """One read per file type for all paths of it; columns that some files lack are null."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    by: dict[str, list[str]] = {}
    for p in paths:
        by.setdefault(file_type(p), []).append(p)
    parts = []
    for kind, own in by.items():
        reader = spark.read.schema(schema) if schema is not None else spark.read
        if kind == "csv":
            parts.append(reader.csv(own, header=True, inferSchema=schema is None))
        elif kind == "text":
            parts.append(read_documents(spark, own))
        elif kind == "parquet":
            parts.append(reader.parquet(*own))
        else:
            # a .json path that is a folder was written line by line; a file may be one array over many lines
            parts.append(reader.option("multiLine", kind == "json" and not _is_folder(spark, own[0])).json(own))
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return df.select(*columns) if columns else df


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def known_files(paths: Sequence[str]) -> list[str]:
    """Those of a type that can be read; a batch skips the others."""
    return [p for p in paths if re.search(r"\.[a-z0-9]+$", p.lower()) and re.search(r"\.[a-z0-9]+$", p.lower())[0] in TYPES]


def discover(spark: SparkSession, root: str, endings: Sequence[str] | None = None) -> DataFrame:
    """``path``, ``length``, ``modified`` of all files below a folder (of any file system), sorted."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    if endings:
        found = found.where(F.lower("path").rlike("(" + "|".join(re.escape(e) for e in endings) + ")$"))
    return found.orderBy("path")


def read_documents(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``document_id``, ``filename``, ``doc_type``, ``text``: text, Markdown and HTML files as text, HTML without its markup."""
    raw = spark.read.text(paths if isinstance(paths, list) else [paths] if isinstance(paths, str) else list(paths), wholetext=True).withColumn("path", F.input_file_name())
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    text = F.when(kind.isin("html", "htm"), html_text(F.col("value"))).otherwise(F.col("value"))
    return raw.select(F.substr(F.sha2("value", 256), F.lit(1), F.lit(16)).alias("document_id"), name.alias("filename"), kind.alias("doc_type"), text.alias("text"))


def read_parsed(spark: SparkSession, path: str, parse: Callable[[bytes, str], Sequence[str]], endings: Sequence[str] = (".pdf", ".docx", ".pptx", ".xlsx"), max_pages: int = 0) -> DataFrame:
    """``document_id``, ``filename``, ``doc_type``, ``page_number``, ``text``, ``error``: documents that need a parser, a row per page.

    ``parse`` is an injected function of a file's bytes and type that gives the texts of its pages; where it fails, the file has one row with the error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.lower("path").rlike("(" + "|".join(re.escape(e) for e in endings) + ")$"))
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    named = files.select(F.substr(F.sha2("content", 256), F.lit(1), F.lit(16)).alias("document_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), kind.alias("doc_type"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for ident, name, kind, content in batch.itertuples(index=False):
                try:
                    pages = list(parse(bytes(content), kind))
                    rows += [(ident, name, kind, k, text, None) for k, text in enumerate(pages[: max_pages or None], 1)]
                except Exception as e:  # the row says what was wrong
                    rows.append((ident, name, kind, None, None, str(e)[:500]))
            frame = pd.DataFrame(rows, columns=["document_id", "filename", "doc_type", "page_number", "text", "error"])
            yield frame.astype({"page_number": "Int32"})

    return named.mapInPandas(run, "document_id string, filename string, doc_type string, page_number int, text string, error string")


def read_bytes(spark: SparkSession, data: bytes, filename: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A table from the bytes of a file, by its name's ending; they are staged in the shared folder."""
    file_type(filename)
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/millrace/staged-{uuid.uuid4().hex}/{filename.rsplit('/', 1)[-1]}")
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return read_files(spark, target.toString(), columns)


def read_hub(spark: SparkSession, name: str) -> DataFrame:
    """A dataset of a public hub, by Spark's data source for it where that package is installed."""
    return _packaged(spark.read.format("huggingface"), "huggingface", name)


def pages_of(documents: DataFrame, max_pages: int = 0, text: str = "text") -> DataFrame:
    """A row per page (from 1): pages end at form feeds; 0 means all pages."""
    cut = documents.select("*", F.posexplode(F.split(text, "\f")).alias("p", "page_text")).withColumn("page_number", F.col("p") + 1).drop("p", text).withColumnRenamed("page_text", text)
    return cut.where(F.col("page_number") <= max_pages) if max_pages else cut


def check_public(url: str, schemes: Sequence[str] = ("http", "https")) -> str:
    """A URL whose host is no private or local address."""
    parsed = urlparse(url)
    if parsed.scheme not in schemes or not parsed.hostname:
        raise Rejected(f"not a URL to read: {url}")
    host = parsed.hostname
    try:
        addresses = [ipaddress.ip_address(host)]
    except ValueError:
        if host == "localhost" or host.endswith((".local", ".internal")):
            raise Rejected(f"a local host: {host}") from None
        try:
            addresses = [ipaddress.ip_address(x[4][0]) for x in socket.getaddrinfo(host, None)]
        except OSError:
            addresses = []
    if any(not a.is_global for a in addresses):
        raise Rejected(f"a private address: {host}")
    return url


def read_sql(spark: SparkSession, url: str, query: str, partition_column: str | None = None, partitions: int = 1, bounds: tuple[int, int] | None = None, private: bool = False) -> DataFrame:
    """A read-only query of a database; ranges of a column are read side by side."""
    check_sql(query, ctes=True)
    if not private:
        m = re.match(r"jdbc:\w+:(//[^;?]+)", url)
        if m:
            check_public("http:" + m[1], ("http",))
    reader = spark.read.format("jdbc").option("url", url)
    if partition_column:
        low, high = bounds or (0, 1_000_000)
        options = {"dbtable": f"({query}) q", "partitionColumn": partition_column, "numPartitions": partitions, "lowerBound": low, "upperBound": high}
        return reader.options(**options).load()
    return reader.option("query", query).load()


def read_kafka(spark: SparkSession, servers: str, topic: str, schema: str | None = None, start: str = "earliest", end: str = "latest") -> DataFrame:
    """A topic from one offset to another, as a bounded batch; values as JSON of a schema become columns."""
    raw = _packaged(spark.read.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", start).option("endingOffsets", end), "kafka")
    return decode_json(raw.withColumn("value", F.col("value").cast("string")), "value", schema) if schema else raw


def decode_json(df: DataFrame, column: str, schema: str, keep: Sequence[str] = ()) -> DataFrame:
    """A JSON column's fields as columns."""
    return df.select(*keep, F.from_json(column, schema).alias("__v")).select(*keep, "__v.*")


def read_iceberg(spark: SparkSession, table: str) -> DataFrame:
    return _packaged(spark.read.format("iceberg"), "iceberg", table)


def read_delta(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    reader = spark.read.format("delta")
    return _packaged(reader.option("versionAsOf", version) if version is not None else reader, "delta", path)


def _packaged(reader, name: str, *where: str) -> DataFrame:  # noqa: ANN001
    try:
        return reader.load(*where)
    except Exception as e:
        if "Failed to find" in str(e) or "DATA_SOURCE_NOT_FOUND" in str(e) or "ClassNotFound" in str(e):
            raise Rejected(f"the {name} package isn't on this cluster's class path") from None
        raise


def read_http(spark: SparkSession, urls: Sequence[str], fetch: Callable[[str], bytes] | None = None, retries: int = 3, tasks: int = 4) -> DataFrame:
    """``url``, ``content``, ``error``: fetched by the tasks, each with its retries."""
    for u in urls:
        check_public(u)

    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from urllib.request import urlopen

        load = fetch or (lambda u: urlopen(u, timeout=30).read())
        for batch in batches:
            rows = []
            for u in batch["url"]:
                body, error = None, None
                for _ in range(retries):
                    try:
                        body, error = load(u), None
                        break
                    except Exception as e:  # the row says what was wrong
                        error = str(e)[:500]
                rows.append((u, body, error))
            yield pd.DataFrame(rows, columns=["url", "content", "error"])

    return spark.createDataFrame([(u,) for u in urls], "url string").repartition(tasks).mapInPandas(get, "url string, content binary, error string")


def federated(spark: SparkSession, registry: dict[str, dict], name: str) -> DataFrame:
    """A table by ``catalog.schema.table``: from a registry of formats and places, or else from Spark's catalogs."""
    if name not in registry:
        return spark.table(name)
    entry = registry[name]
    if entry["format"] == "iceberg":
        return read_iceberg(spark, entry["location"])
    return read_files(spark, entry["location"]) if entry["format"] == "csv" else spark.read.format(entry["format"]).load(entry["location"])


# --- the unified table -----------------------------------------------------------------------------------------------------


def unified(df: DataFrame, modality: str, random_ids: bool = False) -> DataFrame:
    """Rows in the unified columns: an id of their content (or a random one), the modality, nulls elsewhere."""
    kinds = {f.name: f.dataType for f in UNIFIED}
    content = [F.col(c).cast("string") for c in df.columns if c in kinds and not isinstance(kinds[c], T.ArrayType)]
    ident = F.expr("uuid()") if random_ids else F.substr(F.sha2(F.concat_ws("\u0001", F.lit(modality), *content), 256), F.lit(1), F.lit(32))
    made = {"id": F.col("id") if "id" in df.columns else ident, "modality": F.lit(modality), "created_at": F.col("created_at") if "created_at" in df.columns else F.current_timestamp()}
    return df.select(*[(made[c] if c in made else F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def mixed(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def modality_view(df: DataFrame, modality: str) -> DataFrame:
    """One modality's rows and columns."""
    return df.where(F.col("modality") == modality).select(*COMMON, *GROUPS[modality])


#: What a decoder may say of an image and of a video.
IMAGE, VIDEO = ("image_thumbnail", "image_preview", "image_width", "image_height", "exif_make", "exif_model", "exif_gps_lat", "exif_gps_lon", "exif_capture_time"), ("keyframe_count", "video_duration_ms")


def _read_media(spark: SparkSession, path: str, modality: str, held: str, said: Sequence[str], look: Callable[[], Callable[[bytes], dict]]) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kinds = {f.name: f.dataType.simpleString() for f in UNIFIED}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode = look()
        for batch in batches:
            seen = []
            for content in batch[held]:
                try:
                    seen.append(decode(bytes(content)))
                except Exception:  # a damaged file keeps its bytes
                    seen.append({})
            yield pd.DataFrame({"filename": batch["filename"], held: batch[held], **{k: pd.Series([s.get(k) for s in seen], dtype=object) for k in said}})

    named = files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("content").alias(held))
    return unified(named.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in ("filename", held, *said))), modality)


def read_images(spark: SparkSession, path: str, decode: Callable[[bytes], dict] | None = None) -> DataFrame:
    """Image files in the unified columns; sizes, smaller pictures and EXIF by an injected decoder, or by Pillow where it is installed."""
    return _read_media(spark, path, "image", "image_data", IMAGE, (lambda: decode) if decode else _pillow)


def read_videos(spark: SparkSession, path: str, decode: Callable[[bytes], dict]) -> DataFrame:
    """Video files in the unified columns; the number of key frames and the duration by an injected decoder."""
    return _read_media(spark, path, "video", "video_data", VIDEO, lambda: decode)


def _pillow() -> Callable[[bytes], dict]:
    try:
        import io

        from PIL import Image
    except ImportError:
        raise Rejected("reading images needs a decoder or Pillow") from None

    def look(content: bytes) -> dict:
        image = Image.open(io.BytesIO(content))
        exif = image.getexif()
        found = {"image_width": image.width, "image_height": image.height, "exif_make": exif.get(271), "exif_model": exif.get(272), "exif_capture_time": exif.get(306)}
        for name, side in (("image_thumbnail", 256), ("image_preview", 1024)):
            small, out = image.convert("RGB"), io.BytesIO()
            small.thumbnail((side, side))
            small.save(out, "JPEG")
            found[name] = out.getvalue()
        place = exif.get_ifd(0x8825)
        for name, ref, at in (("exif_gps_lat", 1, 2), ("exif_gps_lon", 3, 4)):
            if place.get(at):
                found[name] = gps_decimal(*map(float, place[at]), place.get(ref, "N"))
        return found

    return look


def gps_decimal(degrees: float, minutes: float, seconds: float, ref: str) -> float:
    value = degrees + minutes / 60 + seconds / 3600
    return -value if ref.upper() in ("S", "W") else value
