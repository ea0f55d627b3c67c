"""One reader per format. Text formats give text columns; Parquet and tables keep their types.

A source that is one file can number its rows; samples then carry the row's place in the file.
"""

from __future__ import annotations

import json
import sys
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.parsers import expat

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.typed import as_text, nested_kind
from ..operators.samples import ROW
from .lines import delimited, lines_after, unique_names
from .options import ReadOptions, SourceError, applicable, detect, sniff, spans
from .workbook import read_sheet


@dataclass
class Source:
    frame: DataFrame
    typed: bool
    path: str
    format: str
    size: int | None = None

    def describe(self) -> dict:
        return {"path": self.path, "format": self.format} | ({"bytes": self.size} if self.size is not None else {})


def _bytes(spark: SparkSession, path: str) -> bytes:
    """A whole small file (a workbook, a JSON envelope) through Spark's own file access."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def _size(spark: SparkSession, path: str) -> int | None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise SourceError(f"`{path}` does not exist")
    return fs.getContentSummary(p).getLength()


def spooled(override: str | None) -> tuple[str, str | None]:
    """Standard input in a temporary file of the driver, for local runs; the name carries the format."""
    if not override:
        raise SourceError("standard input has no name; say which format it has")
    if override in ("parquet", "excel"):
        raise SourceError(f"{override} cannot be read from standard input")
    raw = sys.stdin.buffer.read()
    ends = {"gzip": ".gz", "zstd": ".zst", None: ""}[sniff(raw)]
    with tempfile.NamedTemporaryFile(suffix=f".{override}{ends}", delete=False) as f:
        f.write(raw)
    return "file://" + f.name, override


def open_source(spark: SparkSession, path: str, options: ReadOptions | None = None) -> Source:
    """Open a file (or ``-``) by its format; an empty file is an error, not an empty table."""
    options, shown = options or ReadOptions(), path
    if path == "-":
        if not spark.sparkContext.master.startswith("local"):
            raise SourceError("standard input is read by sessions on one machine only")
        path, _ = spooled(options.format)
    kind, compression = detect(path, options.format)
    options = applicable(kind, options)
    size = _size(spark, path)
    if size == 0:
        raise SourceError(f"`{shown}` is empty")
    if compression and kind in ("parquet", "excel"):
        raise SourceError(f"{kind} files are not read through {compression}")
    readers = {"csv": _csv, "tsv": _csv, "parquet": _parquet, "ndjson": _ndjson, "json": _json, "excel": _excel, "xml": _xml, "fixed_width": _fixed}
    return Source(readers[kind](spark, path, options), kind == "parquet", shown, kind, size)


def table_source(spark: SparkSession, name: str) -> Source:
    """A table of the session's catalogue, with its own types."""
    return Source(spark.table(name), True, name, "table")


def jdbc_source(spark: SparkSession, url: str, table: str, split_by: str | None = None, parts: int = 64, **options: str) -> Source:
    """A table (or a query in brackets with a name) of a database, with its own types.

    ``split_by``: a numeric or date column by whose range the rows are read in ``parts`` connections; the range is
    asked from the database first. Without it one task reads all rows. Filters and columns go to the database.
    """
    read = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if split_by:
        low, high = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load().agg(F.min(F.col(split_by)), F.max(F.col(split_by))).first()
        if low is not None:
            read = read.options(partitionColumn=split_by, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return Source(read.load(), True, table, "table")


def _csv(spark: SparkSession, path: str, o: ReadOptions) -> DataFrame:
    return delimited(spark, path, o.separator(), o.quote, o.has_header, o.skip_rows, None, o.multi_line)


def _parquet(spark: SparkSession, path: str, o: ReadOptions) -> DataFrame:
    frame = spark.read.parquet(path)
    if len(frame.inputFiles()) != 1:
        return frame
    return frame.select("*", (F.col("_metadata.row_index") + 1).alias(ROW))


def _texts(frame: DataFrame) -> DataFrame:
    """Scalars as text; lists and records stay, so that a contract that declares them is refused."""
    return frame.select(*((F.col(f"`{f.name}`") if nested_kind(f.dataType) else as_text(F.col(f"`{f.name}`"), f.dataType)).alias(f.name) for f in frame.schema.fields))


def _ndjson(spark: SparkSession, path: str, o: ReadOptions) -> DataFrame:
    return _texts(spark.read.option("primitivesAsString", True).json(path))


def _json(spark: SparkSession, path: str, o: ReadOptions) -> DataFrame:
    reader = spark.read.option("multiLine", True).option("primitivesAsString", True)
    if o.json_path is None:
        return _texts(reader.json(path))
    # an envelope is one document: it is walked on the driver, and its records dealt out again
    try:
        node = json.loads(_bytes(spark, path))
    except ValueError as e:
        raise SourceError(f"`{path}` is not a JSON document: {e}") from None
    for step in [s for s in o.json_path.lstrip("$").split(".") if s]:
        if not isinstance(node, dict) or step not in node:
            keys = ", ".join(node) if isinstance(node, dict) else "none"
            raise SourceError(f"no `{step}` on the way to `{o.json_path}`; keys there: {keys}")
        node = node[step]
    records = [node] if isinstance(node, dict) else node
    if not isinstance(records, list) or not all(isinstance(r, dict) for r in records):
        raise SourceError(f"`{o.json_path}` does not lead to records")
    lines = spark.sparkContext.parallelize([json.dumps(r, ensure_ascii=False) for r in records])
    return _texts(spark.read.option("primitivesAsString", True).json(lines))


def _excel(spark: SparkSession, path: str, o: ReadOptions) -> DataFrame:
    rows = [r for r in read_sheet(_bytes(spark, path), o.sheet)[o.skip_rows :] if any(c not in (None, "") for c in r)]
    if not rows:
        raise SourceError("the sheet has no rows")
    width = max(map(len, rows))
    head = (rows[0] if o.has_header else []) + [None] * width
    names = unique_names(head[:width])
    body = [tuple((r + [None] * width)[:width]) for r in rows[int(o.has_header) :]]
    return spark.createDataFrame(body, T.StructType([T.StructField(n, T.StringType()) for n in names]))


def _fixed(spark: SparkSession, path: str, o: ReadOptions) -> DataFrame:
    drop = o.skip_rows + int(o.has_header)
    lines = lines_after(spark, path, drop)
    value = F.regexp_replace("value", r"\r\z", "")
    cell = lambda start, n: F.nullif(F.regexp_replace(F.substring(value, start, n), r"(?U)^\s+|\s+\z", ""), F.lit(""))
    return lines.where(F.trim(value) != "").select(*(cell(start, n).alias(name) for name, start, n in spans(o.fixed_width)))


# XML


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].rpartition(":")[2]


class _Found(Exception):
    """The record element's name."""


def _chunks(spark: SparkSession, path: str, size: int = 1 << 20) -> Iterator[bytes]:
    """A file's bytes from its beginning, unpacked, as far as the caller asks for them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    stream = fs.open(p)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(p)
    stream = codec.createInputStream(stream) if codec else stream
    try:
        while chunk := bytes(stream.readNBytes(size)):
            yield chunk
    finally:
        stream.close()


def _record_tag(spark: SparkSession, path: str, wanted: str | None) -> str:
    """The exact name of the record element: Spark matches it by case, the option does not. The file is read as far
    as the first such element, wherever that is, and none of it is held."""
    path_wanted = [p.lower() for p in wanted.strip("/").split("/")] if wanted else None
    stack: list[str] = []

    def start(name: str, _: dict) -> None:
        stack.append(_local(name).lower())
        if stack[-len(path_wanted) :] == path_wanted if path_wanted else len(stack) == 2:
            raise _Found(name)

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler = start, lambda name: stack.pop()
    chunks = _chunks(spark, path)
    try:
        for chunk in chunks:
            parser.Parse(chunk, False)
        parser.Parse(b"", True)
    except _Found as e:
        return e.args[0]
    except expat.ExpatError as e:
        raise SourceError(f"`{path}` is not well-formed XML: {e}") from None
    finally:
        chunks.close()
    raise SourceError(f"no element `{wanted}` in `{path}`" if wanted else f"`{path}` has no records")


def _flat(c: Column, kind: T.DataType, name: str) -> list[tuple[str, Column]]:
    """Columns of one XML value: attributes and children by dotted names, the first of repeats."""
    if isinstance(kind, T.ArrayType):
        return _flat(F.get(c, F.lit(0)), kind.elementType, name)
    if not isinstance(kind, T.StructType):
        return [(name, F.nullif(c.cast("string"), F.lit("")))]
    out: list[tuple[str, Column]] = []
    for f in kind.fields:
        inner = f.name.rpartition(":")[2]
        if inner == "_VALUE":
            out += _flat(c[f.name], f.dataType, name)
        elif inner.startswith("_"):
            if f.name.startswith(("_xmlns", "_xsi:")) or inner in ("_nil", "_schemaLocation"):
                continue
            out.append((f"{name}.{inner[1:]}" if name else inner[1:], F.nullif(c[f.name].cast("string"), F.lit(""))))
        elif f.name.startswith("_") and ":" in f.name:
            continue
        else:
            out += _flat(c[f.name], f.dataType, f"{name}.{inner}" if name else inner)
    return out


def _xml(spark: SparkSession, path: str, o: ReadOptions) -> DataFrame:
    tag = _local(_record_tag(spark, path, o.xml_record))  # namespaces are ignored, in the record's name too
    frame = spark.read.format("xml").option("rowTag", tag).option("inferSchema", False).option("ignoreNamespace", True).option("attributePrefix", "_").option("valueTag", "_VALUE").load(path)
    columns: dict[str, Column] = {}
    for f in frame.schema.fields:
        for name, c in _flat(F.col(f"`{f.name}`"), T.StructType([T.StructField("x", f.dataType)]).fields[0].dataType, "" if f.name == "_VALUE" else f.name.rpartition(":")[2].removeprefix("_")):
            if name:
                columns.setdefault(name, c)
    if not columns:
        raise SourceError(f"the records `{tag}` have neither attributes nor children")
    return frame.select(*(c.alias(n) for n, c in columns.items()))
