"""Dataset files and the dataset registry.

A dataset is one file or one directory of files of a single type (``json`` and
``jsonl`` count as one), at any depth; hidden and ``_`` files are ignored, the rest is read
in sorted order.  Listing goes through the Hadoop FileSystem of the session, so the
same code reads local folders, HDFS or object stores.  Row order, which several
operators depend on, is recorded at ingest as ``ordinal``.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.joins import broadcast_if_small
from ..operators.align import DEFAULT_COLUMNS, ROLES, add_system, align_columns, system_prompts
from .tables import spread

# File extension -> reader (parquet added to the reference's four).
READER_OF = {"csv": "csv", "json": "json", "jsonl": "json", "txt": "text", "parquet": "parquet"}


def file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Visible files under ``path`` at any depth (sorted), or ``[path]`` for a file; [] if absent."""
    fs, root = file_system(spark, path)
    if not fs.exists(root):
        return []
    if fs.isFile(root):
        return [str(root.toString())]
    out, folders = [], [root]
    while folders:
        for st in fs.listStatus(folders.pop()):
            if st.getPath().getName().startswith((".", "_")):
                continue
            if st.isFile():
                out.append(str(st.getPath().toString()))
            else:
                folders.append(st.getPath())
    return sorted(out)


def file_type(path: str) -> str:
    ext = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if ext not in READER_OF:
        raise ValueError(f"Unknown file type: {path}")
    return READER_OF[ext]


def read_files(spark: SparkSession, files: list[str], schema=None) -> DataFrame:
    """The files of one dataset (types must agree); adds ``ordinal`` in file/line order.

    JSON files may each hold lines, one array or one object over several lines; a malformed
    record is an error, never a row of nulls.
    """
    if not files:
        raise ValueError("no dataset file at the given path")
    types = {file_type(f) for f in files}
    if len(types) != 1:
        raise ValueError("dataset files of different types in one folder")
    kind = types.pop()
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if kind == "csv":
        parts = [reader.options(header=True, multiLine=True, escape='"', mode="FAILFAST").csv(files)]
    elif kind == "json":
        with ThreadPoolExecutor(16) as pool:  # only the first line of each .json file is looked at
            whole = list(pool.map(lambda f: f.lower().endswith(".json") and _spans_lines(spark, f), files))
        forms = {multi: [f for f, w in zip(files, whole) if w == multi] for multi in (False, True)}
        parts = [reader.options(multiLine=multi, mode="FAILFAST").json(group) for multi, group in forms.items() if group]
    elif kind == "text":
        parts = [reader.text(files).withColumnRenamed("value", "text")]
    else:
        parts = [reader.parquet(*files)]
    # numbered in read order first; then a single-file (unsplittable) input is spread over the cores
    return spread(ingest_ordinal(*parts))


def ingest_ordinal(*parts: DataFrame, name: str = "ordinal") -> DataFrame:
    """Dense row number in (file, block, read position) order, without sorting the rows.

    ``parts`` are scans of disjoint files (one per reader form); columns are matched by name.

    Rows of one file split are read by one task, consecutively, so inside a split
    ``monotonically_increasing_id`` is contiguous.  Per-split counts and first ids form
    a table with one row per split (bounded by the file listing); its running offsets
    are broadcast and ``ordinal = offset + id - first id``.  The scan's split-to-task
    assignment is fixed by the file listing, so a retried task reproduces its ids.
    """
    placed = [p.select(*p.columns, F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"))
              for p in parts]
    d = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), placed)
    cols = [c for c in d.columns if c not in ("_f", "_b")]
    d = d.withColumn("_m", F.monotonically_increasing_id())
    splits = d.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_m0"))
    w = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = splits.select("_f", "_b", "_m0", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    # one row per split: bounded by the file listing, still size-checked before broadcasting
    out = d.join(broadcast_if_small(offs, bytes_per_row=160), ["_f", "_b"])
    return out.select(*cols, (F.col("_off") + F.col("_m") - F.col("_m0")).cast("bigint").alias(name))


def read_dataset(spark: SparkSession, dataset_dir: str, file_name: str, schema=None) -> DataFrame:
    return read_files(spark, list_files(spark, f"{dataset_dir.rstrip('/')}/{file_name}"), schema)


@dataclass
class DatasetEntry:
    """One registry entry."""

    name: str
    file_name: str
    columns: dict = field(default_factory=lambda: dict(DEFAULT_COLUMNS))
    system_prompt: str | None = None
    file_sha1: str | None = None


def _spans_lines(spark: SparkSession, path: str, limit: int = 1 << 20) -> bool:
    """Whether a JSON file is one value over the whole file (an array, or an object over several lines).

    Looks at the first line that is not blank: JSON lines begin with a complete object.  An object
    longer than ``limit`` bytes without a line break is taken as a line.
    """
    fs, p = file_system(spark, path)
    stream = fs.open(p)
    try:
        reader = spark.sparkContext._jvm.java.io.BufferedReader(spark.sparkContext._jvm.java.io.InputStreamReader(stream, "UTF-8"))
        line = reader.readLine()
        while line is not None and not line.strip():
            line = reader.readLine()
    finally:
        stream.close()
    if line is None or len(line) > limit:
        return bool(line) and line.lstrip().startswith("[")
    try:
        return not isinstance(json.loads(line), dict)
    except ValueError:
        return True


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = file_system(spark, path)
    stream = fs.open(p)
    try:
        jvm = spark.sparkContext._jvm
        data = jvm.org.apache.commons.io.IOUtils.toByteArray(stream)
    finally:
        stream.close()
    return bytes(data).decode("utf-8")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = file_system(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def parse_registry(info: dict, dataset: str, system_prompt: str | None = None) -> list[DatasetEntry]:
    """Names split on ',' and stripped; unknown names are an error; P3 prompts per dataset."""
    names = [n.strip() for n in dataset.split(",")]
    prompts = system_prompts(system_prompt, len(names))
    out = []
    for i, name in enumerate(names):
        if name not in info:
            raise ValueError(f"dataset {name!r} is not in the registry")
        entry = info[name]
        if "hf_hub_url" in entry or "script_url" in entry:
            raise NotImplementedError("hub and script datasets need the network; only files are read")
        attr = DatasetEntry(name, entry["file_name"], file_sha1=entry.get("file_sha1"))
        if "columns" in entry:
            attr.columns = {r: entry["columns"].get(r) for r in ROLES}
        attr.system_prompt = prompts[i]
        out.append(attr)
    return out


def load_datasets(spark: SparkSession, dataset_dir: str, dataset: str, system_prompt: str | None = None,
                  max_samples: int | None = None, schemas: dict | None = None) -> list[DataFrame]:
    """Registry -> read -> first ``max_samples`` rows (L1) -> align (P1) -> system column.

    ``schemas`` gives a dataset's schema by its name; files of the others are read once more to infer theirs.
    """
    unknown = set(schemas or {}) - {n.strip() for n in dataset.split(",")}
    if unknown:
        raise ValueError(f"schemas for datasets that are not read: {sorted(unknown)}")
    info = json.loads(read_text(spark, f"{dataset_dir.rstrip('/')}/dataset_info.json"))
    out = []
    for attr in parse_registry(info, dataset, system_prompt):
        df = read_dataset(spark, dataset_dir, attr.file_name, (schemas or {}).get(attr.name))
        if max_samples is not None:
            df = df.where(F.col("ordinal") < max_samples)
        df = add_system(align_columns(df, attr.columns), attr.system_prompt)
        out.append(df.withColumn("dataset", F.lit(attr.name)))
    return out
