"""Trace files in and out: texts, lines, inventories, manifests, listings, knowledge, exports.

A table of lines is ``(file_name, line_no, line)``, numbered from 1. ``file_name`` names one file: lines of files that are read here
carry the whole path, since nodes give their files the same names.
"""

from __future__ import annotations

import json

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calltrace.functions.columns import capture, split_lines
from calltrace.sources.versioned import VersionedTable


def read_traces(spark: SparkSession, paths: str | list[str], newest: int | None = None) -> DataFrame:
    """``(path, file_name, content, size_bytes, modified)`` per file, folders read recursively, newest first if ``newest`` caps them.

    ``.gz`` is decompressed and ``.gzo`` read as it is; ``.index`` files are left out; a corrupt file is skipped, and
    :func:`skipped_files` lists it.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("ignoreCorruptFiles", True)
    files = reader.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("content"),
        F.col("_metadata.file_size").alias("size_bytes"), F.col("_metadata.file_modification_time").alias("modified"),
    ).where(~F.lower("file_name").endswith(".index"))
    return files if newest is None else files.orderBy(F.desc("modified"), "path").limit(newest)


def skipped_files(spark: SparkSession, paths: str | list[str], files: DataFrame) -> DataFrame:
    """``(path, size_bytes, reason)`` of the files under ``paths`` that ``files`` has no row of; their contents are not read. Files of no
    bytes hold nothing to read and are in neither table."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("size_bytes"))
    low = F.lower("path")
    reason = F.when(low.endswith(".index"), "index file").otherwise("unreadable file")
    return found.join(files.select("path"), "path", "left_anti").select("path", "size_bytes", reason.alias("reason"))


def trace_lines(files: DataFrame, text: str = "content", name: str | None = None) -> DataFrame:
    """The lines of whole texts, by ``name`` or else by ``path`` where there is one."""
    name = name or ("path" if "path" in files.columns else "file_name")
    return files.select(F.col(name).alias("file_name"), F.posexplode(split_lines(F.col(text))).alias("pos", "line")).select("file_name", (F.col("pos") + 1).alias("line_no"), "line")


def read_trace_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The lines of large plain files, read in splits: ``line_no`` comes from each split's offset and its lines' counts."""
    rows = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file_name"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")
    )
    counts = rows.groupBy("file_name", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    starts = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("file_name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(starts, ["file_name", "block"]).select("file_name", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"), "line")


def extraction_method(path: Column) -> Column:
    name = F.lower(path)
    return F.when(name.endswith(".gz"), "gzip").when(name.endswith(".gzo") | name.endswith(".txt"), "plain").when(name.endswith(".index"), "rejected").otherwise("plain")


def manifests(files: DataFrame, raw: DataFrame | None = None, node: str | None = None) -> DataFrame:
    """One row per artifact: sizes and SHA-256 of the extracted text and, given ``raw`` (the ``binaryFile`` table), of the bytes."""
    text = F.encode("content", "UTF-8")
    out = files.select(
        F.sha2(F.col("path").cast("binary"), 256).alias("request_id"), "path", "file_name", F.lit(node).alias("node"), "modified", F.col("size_bytes").alias("raw_size"),
        F.octet_length("content").cast("long").alias("extracted_size"), F.sha2(text, 256).alias("extracted_sha256"), extraction_method(F.col("path")).alias("extraction_method"),
    )
    if raw is not None:
        out = out.join(raw.select("path", F.sha2("content", 256).alias("raw_sha256")), "path", "left")
    return out


def listed_manifests(rows: DataFrame, collected: str = "collection_timestamp", kind: str = "kind") -> DataFrame:
    """Manifests newest first, without those that describe an analysis."""
    order = [F.desc_nulls_last(c) for c in (collected, "modified") if c in rows.columns][:1]
    own = rows.where(F.coalesce(F.col(kind), F.lit("")) != "analysis") if kind in rows.columns else rows
    return own.orderBy(*order, "request_id")


def manifest_of(rows: DataFrame, request_id: str) -> DataFrame:
    """The manifest of one request."""
    return rows.where(F.col("request_id") == request_id)


def manifest_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), (F.sum("extracted_size") / 1048576).alias("total_mb"), F.max("modified").alias("latest"))


def without(rows: DataFrame, deleted: DataFrame, key: str = "request_id") -> DataFrame:
    """The table without the rows of a delete list; to be written in place of the old one."""
    return rows.join(deleted.select(key).distinct(), key, "left_anti")


def selected_files(files: DataFrame, chosen: DataFrame, key: str = "path") -> tuple[DataFrame, DataFrame]:
    """Files of the chosen manifests, and the chosen ones that have no file."""
    want = chosen.select(key).distinct()
    return files.join(want, key, "left_semi"), want.join(files.select(key), key, "left_anti")


LISTING = r"^\s*(\d{1,2} [A-Za-z]{3},\d{4} \d{2}:\d{2}:\d{2})\s+([\d,]+)\s+(\S+)\s*$"


def parse_listing(lines: DataFrame, line: str = "line", base: str = "") -> DataFrame:
    """``(filename, path, size_bytes, modified, trace_type)`` from listing output; headers and totals are dropped."""
    text = F.col(line)
    name = F.regexp_extract(text, LISTING, 3)
    low = F.lower(name)
    kind = F.when(low.rlike(r"\.(txt|gz|gzo)$") & low.startswith("sdl"), "SDL_TRACE").when(low.endswith(".index"), "SDL_INDEX").otherwise("SDL")
    return lines.where(text.rlike(LISTING)).select(
        name.alias("filename"), F.concat(F.lit(base), name).alias("path"), F.regexp_replace(F.regexp_extract(text, LISTING, 2), ",", "").cast("long").alias("size_bytes"),
        F.try_to_timestamp(capture(text, LISTING, 1), F.lit("d MMM,yyyy HH:mm:ss")).alias("modified"), kind.alias("trace_type"),
    )


def unsafe_name(name: Column) -> Column:
    """Empty, absolute or climbing file names."""
    return F.coalesce((F.btrim(name) == "") | name.startswith("/") | name.startswith("\\") | name.rlike("^[A-Za-z]:") | name.rlike(r"(^|[/\\])\.\.([/\\]|$)"), F.lit(True))


#: Sections of a knowledge file, their categories and id prefixes. Fixed values.
KNOWLEDGE = {"signals": ("signal", "signal_"), "processes": ("process", "proc_"), "identifiers": ("identifier", "ident_"), "failures": ("failure", "fail_"), "flows": ("callflow", "flow_")}


def knowledge_items(spark: SparkSession, sections: list[dict]) -> DataFrame:
    """Uniform items of parsed knowledge files (dicts of sections, each a list of entries); unknown sections are ignored."""
    rows, order = [], 0
    for document in sections:
        for section, (category, prefix) in KNOWLEDGE.items():
            for entry in document.get(section) or []:
                title = str(entry.get("name") or entry.get("title") or entry.get("code") or "")
                key = prefix + "".join(c if c.isalnum() else "_" for c in str(entry.get("id") or title))
                details = json.dumps({k: v for k, v in entry.items() if k not in ("name", "title", "description", "tags", "confidence", "source")}, sort_keys=True, default=str)
                rows.append((key, category, title, str(entry.get("description") or ""), details, str(entry.get("confidence") or "verified"), str(entry.get("source") or ""), [str(t) for t in entry.get("tags") or []], order))
                order += 1
    return spark.createDataFrame(rows, "id string, category string, title string, description string, details string, confidence string, source_reference string, tags array<string>, item_order int")


def read_knowledge(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Items of knowledge files, YAML or JSON by their names; parsed on the driver one file after the other, in the order of paths, whatever their sizes.

    A file that can't be parsed, or that holds no mapping, gives no items.
    """
    files = read_traces(spark, paths).where(F.lower("file_name").rlike(r"\.(ya?ml|json)$"))
    documents = []
    for row in files.orderBy("path").select("file_name", "content").toLocalIterator():
        parsed = _parsed(row.file_name, row.content)
        if isinstance(parsed, dict):
            documents.append(parsed)
    return knowledge_items(spark, documents)


def _parsed(name: str, text: str):
    if name.lower().endswith(".json"):
        try:
            return json.loads(text)
        except ValueError:
            return None
    try:
        import yaml
    except ImportError as e:
        raise ImportError("PyYAML is needed to read knowledge files in YAML; JSON needs nothing") from e
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError:
        return None


def evidence_export(files: DataFrame, rows: DataFrame, generated: str) -> DataFrame:
    """``(path, value)``: a header of the manifest's fields and the whole text, one row per file."""
    head = F.format_string(
        "File: %s\nNode: %s\nSize: %d bytes\nSHA-256: %s\nGenerated: %s\n%s\n", "file_name", F.coalesce("node", F.lit("-")), "extracted_size", "extracted_sha256", F.lit(generated), F.lit("=" * 60)
    )
    return rows.join(files.select("path", "content"), "path").select("path", F.concat(head, "content").alias("value"))


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as the next version of a :class:`VersionedTable` in a folder of its name. A table may be made from the one that it replaces, and
    a writer that is lost at any step leaves the old version."""
    for name, df in tables.items():
        VersionedTable(df.sparkSession, f"{folder}/{name}").replace(df)


def read_table(spark: SparkSession, folder: str, name: str, schema: str, strict: bool = False) -> DataFrame:
    """A written table, or plain Parquet files in a folder of its name; an empty table where there is none. Unless ``strict``, all columns are read
    once to tell whether they can be, and a table with a corrupt footer or page is an empty one."""
    stored = VersionedTable(spark, f"{folder}/{name}")
    try:
        out = stored.read(schema) if stored.exists() else spark.read.schema(schema).parquet(stored.folder) if stored.has_files() else spark.createDataFrame([], schema)
        if not strict:
            out.agg(F.max(F.xxhash64(*out.columns))).collect()
        return out
    except (PySparkException, Py4JError):
        if strict:
            raise
        return spark.createDataFrame([], schema)


def to_json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))
