"""Storing a version: chunked values and control tables in a staging folder, a manifest, then one rename."""

from __future__ import annotations

import json
import posixpath
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACK_BYTES = 4096  #: texts larger than this (as JSON) are packed into a payload table
DISTINCT_LIMIT = 65_536  #: distinct values up to which a column is dictionary-encoded
SAMPLE = 200_000  #: values that an encoding is chosen by


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def write_values(chunks: DataFrame, path: str, spec: str = "spec_type", key: str = "signal_id", codec: str = "zstd", dictionary: bool | None = None) -> None:
    """Chunks by spec and in storage order, so that a scan of one spec reads its folder only and a signal's chunks lie
    together. Ranges split a signal of any size over files."""
    w = chunks.repartitionByRange(spec, key, "chunk_idx").sortWithinPartitions(spec, key, "chunk_idx").write.partitionBy(spec).option("compression", codec)
    if dictionary is not None:
        w = w.option("parquet.enable.dictionary", str(dictionary).lower())
    w.parquet(path)


def locate(spark: SparkSession, path: str, key: str = "signal_id") -> DataFrame:
    """``key, chunk_idx, n_values, file``: where every chunk of a value store lies. Values aren't read."""
    rows = spark.read.parquet(path)
    return rows.select(key, "chunk_idx", F.size("values").alias("n_values"), F.col("_metadata.file_path").alias("file"))


def read_located(spark: SparkSession, locators: DataFrame, path: str, key: str = "signal_id") -> DataFrame:
    """The chunks that a version's locators name, from the store that holds them: a version that changes no values has
    locators only and rewrites none."""
    rows = spark.read.parquet(path).select(key, "chunk_idx", "values", F.col("_metadata.file_path").alias("file"))
    return rows.join(locators.select(key, "chunk_idx", "file"), [key, "chunk_idx", "file"])


def write_dataset(tables: dict[str, DataFrame], chunks: DataFrame, path: str, card: dict) -> None:
    """A whole version: control tables in one rename, and its values beside them; a failure leaves neither."""
    spark = chunks.sparkSession
    values = f"{path.rstrip('/')}-values-{uuid.uuid4().hex}"
    try:
        write_values(chunks, values)
        write_version(tables, path, {**card, "values": values})
    except BaseException:
        fs, p = _fs(spark, values)
        fs.delete(p, True)
        raise


def flatten_nd(values: Column, shape: list[int]) -> tuple[Column, Column]:
    """An array of ``shape`` in row order as it is stored: its cells, and whether it has as many as the shape says."""
    flat = values
    for _ in shape[1:]:
        flat = F.flatten(flat)
    n = 1
    for x in shape:
        n *= x
    return flat, F.size(flat) == n


def unflatten_nd(flat: Column, shape: list[int]) -> Column:
    """The nested array of ``shape`` from its cells in row order."""
    out = flat
    for x in reversed(shape[1:]):
        out = _rows_of(out, x)
    return out


def _rows_of(flat: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), (F.size(flat) / n).cast("int") - 1), lambda i: F.slice(flat, i * n + 1, F.lit(n)))


def write_parts(rows: DataFrame, path: str, most: int) -> None:
    """Files of at most ``most`` rows each."""
    rows.write.option("maxRecordsPerFile", most).parquet(path)


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file made by the driver."""
    fs, p = _fs(spark, path)
    out = fs.create(p)
    out.write(bytearray(content))
    out.close()


def _encodings(batches):
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSystem

    for b in batches:
        file, column, encoding = [], [], []
        for path in b.column("path").to_pylist():
            where, at = FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
            with where.open_input_file(at) as f:
                meta = pq.read_metadata(f)  # the footer only
            for g in range(meta.num_row_groups):
                for c in range(meta.num_columns):
                    x = meta.row_group(g).column(c)
                    file.append(path.rpartition("/")[2]), column.append(x.path_in_schema), encoding.append(sorted(x.encodings))
        yield pa.RecordBatch.from_arrays([pa.array(file, pa.string()), pa.array(column, pa.string()), pa.array(encoding, pa.list_(pa.string()))], names=["file", "column", "encodings"])


def applied_encodings(spark: SparkSession, path: str) -> DataFrame:
    """``file, column, encodings`` of every column chunk, read from the files' footers where the files are."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path")
    return files.mapInArrow(_encodings, "file string, column string, encodings array<string>")


def encoding_for(values: DataFrame, column: str = "value", step: str = "step") -> DataFrame:
    """One row, ``n, n_sampled, n_distinct, encoding``: ``dictionary`` up to 65,536 distinct bit patterns in a strided sample of
    ``SAMPLE`` values at most, else ``byte_stream_split`` for floating values and ``plain`` for others.

    The sample is the feature: every k-th step of each series, with the smallest k that keeps the sample small enough.
    """
    per = values.agg(F.count(F.lit(1)).alias("n"))
    stride = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(SAMPLE))).cast("long")
    sample = values.crossJoin(F.broadcast(per)).where(F.pmod(F.col(step), stride) == 0)  # one row
    pattern = F.col(column).cast("string")  # tells both zeros apart; all NaN are one
    wide = "byte_stream_split" if values.schema[column].dataType.typeName() in ("float", "double") else "plain"
    counts = sample.agg(F.count(F.lit(1)).alias("n_sampled"), F.countDistinct(pattern).alias("n_distinct"))
    return per.crossJoin(counts).withColumn("encoding", F.when(F.col("n_distinct") <= DISTINCT_LIMIT, "dictionary").otherwise(wide))  # one row each


def pack_texts(rows: DataFrame, key: str, text: str, limit: int = PACK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Rows with short texts inline and null for packed ones, and the payload ``key, text`` of those whose JSON form is
    larger than ``limit`` bytes."""
    big = F.coalesce(F.octet_length(F.to_json(F.struct(F.col(text).alias("t")))) - 8 > limit, F.lit(False))
    return rows.withColumn(text, F.when(~big, F.col(text))), rows.where(big).select(key, text)


def unpack_texts(rows: DataFrame, payload: DataFrame, key: str, text: str) -> DataFrame:
    p = payload.select(key, F.col(text).alias("_packed"))
    return rows.join(p, key, "left").withColumn(text, F.coalesce("_packed", text)).drop("_packed")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``file, size, sha256`` of every parquet file below ``path``, hashed where the files are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.regexp_replace("path", r"^.*?" + path.replace("file://", "").rstrip("/") + "/", "").alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def verify(spark: SparkSession, path: str, kept: DataFrame) -> DataFrame:
    """``file, change`` for files that are missing, new or altered against a kept manifest."""
    from chronoloom.operators.edit import difference

    return difference(kept, manifest(spark, path), "file", "sha256")


def write_version(tables: dict[str, DataFrame], path: str, card: dict, replace: bool = False) -> None:
    """Write all tables to a staging folder beside ``path`` with card and counts, then rename it into place.

    An existing version is refused unless ``replace``, and then put back if publishing fails. Nothing of a failed write
    is left behind.
    """
    spark = next(iter(tables.values())).sparkSession
    fs, target = _fs(spark, path)
    if fs.exists(target) and not replace:
        raise FileExistsError(path)
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    staging = posixpath.join(posixpath.dirname(path.rstrip("/")), f".staging-{uuid.uuid4().hex}")
    try:
        counts = {}
        for name, df in tables.items():
            df.write.parquet(f"{staging}/{name}")
            counts[name] = spark.read.parquet(f"{staging}/{name}").count()
        body = json.dumps({**card, "counts": counts}, sort_keys=True)
        out = fs.create(Path(f"{staging}/card.json"))
        out.write(bytearray(body.encode()))
        out.close()
        aside = None
        if fs.exists(target):
            aside = Path(f"{staging}-old")
            fs.rename(target, aside)
        if not fs.rename(Path(staging), target):
            if aside is not None:
                fs.rename(aside, target)
            raise OSError(f"could not publish {path}")
        if aside is not None:
            fs.delete(aside, True)
    finally:
        fs.delete(Path(staging), True)


def open_version(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    """The tables of a version, lazily, and its card."""
    card = json.loads(spark.read.text(f"{path}/card.json", wholetext=True).head()[0])
    return {name: spark.read.parquet(f"{path}/{name}") for name in card["counts"]}, card


def copy_version(spark: SparkSession, source: str, target: str) -> bool:
    """Copy a version; a complete copy is left alone (False)."""
    if exists(spark, target):
        return False
    tables, card = open_version(spark, source)
    card.pop("counts")
    write_version(tables, target, card)
    return True


def copy_release(spark: SparkSession, source: str, root: str) -> list[str]:
    """Copy a version and every version that its card names as ``base``, the oldest first, to ``root/org/name/version``; what is
    complete there is left alone. Gives the paths that were written."""
    chain, at = [], source.rstrip("/")
    while at and at not in chain:
        chain.append(at)
        at = json.loads(spark.read.text(f"{at}/card.json", wholetext=True).head()[0]).get("base")
    targets = [f"{root}/{'/'.join(p.split('/')[-3:])}" for p in chain]
    return [t for p, t in reversed(list(zip(chain, targets))) if copy_version(spark, p, t)]
