"""What to read and how: format detection, option layering and applicability."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from ..contract.model import Field, InputSettings


class SourceError(ValueError):
    """An input that cannot be read as asked."""


# Extensions and magic numbers: fixed values of the formats.
EXTENSIONS = {
    "csv": "csv", "tsv": "tsv", "parquet": "parquet", "ndjson": "ndjson", "jsonl": "ndjson", "json": "json",
    "xlsx": "excel", "xlsm": "excel", "xlsb": "excel", "xls": "excel", "ods": "excel", "xml": "xml", "fwf": "fixed_width",
}
COMPRESSIONS = {"gz": "gzip", "gzip": "gzip", "zst": "zstd", "zstd": "zstd"}
MAGIC = {b"\x1f\x8b": "gzip", b"\x28\xb5\x2f\xfd": "zstd"}


@dataclass(frozen=True)
class ReadOptions:
    format: str | None = None
    delimiter: str | None = None
    quote: str = '"'
    has_header: bool = True
    skip_rows: int = 0
    lossy_utf8: bool = False
    json_path: str | None = None
    sheet: str | int | None = None
    xml_record: str | None = None
    fixed_width: tuple[Field, ...] | None = None
    #: Whether quoted cells hold line breaks; found out if not told.
    multi_line: bool | None = None

    @staticmethod
    def layered(settings: InputSettings, **flags) -> ReadOptions:
        """The contract's reading instructions, overridden by whatever the caller gives."""
        given = {f.name: v for f in fields(InputSettings) if (v := getattr(settings, f.name)) is not None}
        given |= {k: v for k, v in flags.items() if v is not None}
        return ReadOptions(**given)

    def separator(self) -> str:
        text = (self.delimiter or ",").replace("\\t", "\t")
        if len(text) != 1:
            raise SourceError("the delimiter must be one character")
        return text


def detect(path: str, override: str | None = None) -> tuple[str, str | None]:
    """Format and compression by the file's name; an override replaces the format, never the compression."""
    parts = path.rstrip("/").rsplit("/", 1)[-1].lower().split(".")
    compression = COMPRESSIONS.get(parts[-1]) if len(parts) > 1 else None
    inner = parts[-2] if compression and len(parts) > 2 else parts[-1] if not compression and len(parts) > 1 else ""
    found = override or EXTENSIONS.get(inner)
    if not found:
        raise SourceError(f"cannot tell the format of `{path}`; name it (one of {', '.join(sorted(set(EXTENSIONS.values())))})")
    return found, compression


def sniff(head: bytes) -> str | None:
    return next((c for m, c in MAGIC.items() if head.startswith(m)), None)


def applicable(kind: str, options: ReadOptions) -> ReadOptions:
    """Refuse options that another format would need."""
    if options.json_path is not None and kind != "json":
        raise SourceError(f"json_path applies to JSON documents, not to {kind}")
    if kind == "fixed_width" and not options.fixed_width:
        raise SourceError("a fixed-width file needs a layout of fields")
    if kind == "tsv":
        return replace(options, delimiter="\t")
    return options


def spans(layout: tuple[Field, ...]) -> list[tuple[str, int, int]]:
    """Name, first place (from 1) and length in characters of every field."""
    out, at = [], 1
    for f in layout:
        start = f.start if f.start is not None else at
        end = f.end if f.end is not None else start + (f.width or 0) - 1
        if start < 1 or end < start:
            raise SourceError(f"the field `{f.name}` has no place in the line")
        out.append((f.name, start, end - start + 1))
        at = end + 1
    return out
