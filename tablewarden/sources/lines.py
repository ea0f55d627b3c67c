"""Lines of one text file with their number, and delimited lines as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.samples import after_first


def first_lines(spark: SparkSession, path: str, n: int) -> list[str]:
    """The first lines of a file; only its first split is read."""
    return [r.value for r in spark.read.text(path).limit(n).collect()]


def lines_after(spark: SparkSession, path: str, n: int) -> DataFrame:
    """``value``: all lines but the first. A compressed or short file is one split; longer ones are counted over
    their splits, which a single file has in order."""
    lines = spark.read.text(path)
    return after_first(lines, n) if n else lines


def breaks_lines(spark: SparkSession, path: str, quote: str) -> bool:
    """Whether a quoted cell may hold a line break: some line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).limit(1).isEmpty()


def unique_names(raw: list[str | None]) -> list[str]:
    """Blank names become ``column_N``; a name that was used before gets ``_2``, ``_3``, ..."""
    out: list[str] = []
    for i, name in enumerate(raw, 1):
        name = (name or "").strip() or f"column_{i}"
        base, k = name, 2
        while name in out:
            name, k = f"{base}_{k}", k + 1
        out.append(name)
    return out


def delimited(spark: SparkSession, path: str, sep: str, quote: str, header: bool, skip: int, encoding: str | None, multi_line: bool | None = None) -> DataFrame:
    """A delimited file as text columns: a bare empty cell is null, a quoted empty cell is empty text.

    ``multi_line``: whether quoted cells hold line breaks. Such a file cannot be split, so this is found out by a
    scan of the lines (a line with an odd number of quotes) unless it is told. Rows to skip stand before the
    header and end at line breaks.
    """
    options = {"sep": sep, "quote": quote, "escape": quote, "emptyValue": "", "nullValue": "\u0000", "mode": "PERMISSIVE", "enforceSchema": "true", "maxColumns": "100000", "maxCharsPerColumn": "-1"}
    if encoding:
        options["encoding"] = encoding
    if multi_line is None:
        multi_line = breaks_lines(spark, path, quote)
    read = spark.read.options(**options)
    parse = lambda line: spark.read.options(**options).csv(spark.sparkContext.parallelize([line]))  # noqa: E731  one line, on the driver
    head = first_lines(spark, path, skip + 1)
    if len(head) <= skip:
        return spark.createDataFrame([], "column_1 string").limit(0)
    if multi_line and not skip:  # the header itself may break its line
        cells = list(read.option("multiLine", True).csv(path).first())
    else:
        cells = parse(head[skip]).first()
    names = unique_names([c if header else None for c in cells])
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    if not skip:
        frame = read.option("header", str(header).lower()).option("multiLine", multi_line).schema(schema).csv(path)
    elif multi_line:
        # blank lines are no records; the lines to skip are records of their own
        drop = sum(bool(line.strip()) for line in head[:skip]) + int(header)
        frame = after_first(read.option("multiLine", True).schema(schema).csv(path), drop)
    else:
        lines = lines_after(spark, path, skip + int(header)).where("value <> ''").select("value")
        parsed = F.from_csv("value", schema, {k: v for k, v in options.items() if k not in ("enforceSchema", "mode")})
        frame = lines.select(parsed.alias("r")).select("r.*")
    return _empty_as_null(frame)


def _empty_as_null(frame: DataFrame) -> DataFrame:
    """The stand-in for a null (a NUL character, which text files do not hold) never reaches the caller."""
    return frame.select(*(F.nullif(F.col(f"`{c.replace('`', '``')}`"), F.lit("\u0000")).alias(c) for c in frame.columns))
