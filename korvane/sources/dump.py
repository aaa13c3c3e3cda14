"""Database dumps in COPY's text form, as a data source that Spark reads in byte ranges.

A row is a line, since line ends inside values are escaped: a range begins after the first line end in it and ends with
the line that its last byte is in. Values come out as texts, arrays as arrays of texts, and `declared` gives them
their types. A plain dump holds the rows of several tables, each between a COPY line and a line `\\.`; `blocks` finds them in
one pass. Files may be a folder's: each is cut by itself.

Defined cases: \\N is null, and so is an unquoted NULL in an array; empty texts stay empty; an empty file has no rows; a line with
more or fewer columns than the table raises; invalid UTF-8 raises."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, BooleanType, FloatType, StringType, StructType, TimestampType

from korvane.sources.catalog import declared
from korvane.sources.stored import opened

SPLIT = 32 << 20
CHUNK = 1 << 20

# The escapes of COPY's text form, and its lines.
ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}
NULL = "\\N"
END = b"\\."
COPY = re.compile(r"COPY (?:\S+\.)?\"?([^\s\"]+)\"? \(([^)]*)\) FROM stdin;")

ESCAPED = re.compile(r"\\(?:([0-7]{1,3})|x([0-9a-fA-F]{1,2})|(.))", re.DOTALL)
ELEMENT = re.compile(r'"((?:[^"\\]|\\.)*)"|([^,{}"]+)', re.DOTALL)


def unescaped(value: str) -> str | None:
    """What a column of a line stands for."""
    if value == NULL:
        return None
    if "\\" not in value:
        return value
    if not re.search(r"\\[0-7x]", value):
        return ESCAPED.sub(lambda m: ESCAPES.get(m[3], m[3]), value)
    # numbers are bytes, and several may make up a character
    as_bytes = lambda m: bytes([int(m[1], 8) & 255]) if m[1] else bytes([int(m[2], 16)]) if m[2] else ESCAPES.get(m[3], m[3]).encode()
    out, at = [], 0
    for m in ESCAPED.finditer(value):
        out += [value[at : m.start()].encode(), as_bytes(m)]
        at = m.end()
    return b"".join([*out, value[at:].encode()]).decode()


def elements(value: str | None) -> list[str | None] | None:
    """The elements of an array such as {a,"b, c",NULL}."""
    if value is None:
        return None
    return [re.sub(r"(?s)\\(.)", r"\1", m[1]) if m[1] is not None else None if m[2].upper() == "NULL" else m[2] for m in ELEMENT.finditer(value[1:-1])]


def lines(files: fs.FileSystem, path: str, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of the lines that begin in [begin, end), a chunk in memory at a time."""
    with files.open_input_file(path) as f:
        at, rest = begin, b""
        if begin:  # the line that the byte before is in belongs to the range before
            f.seek(begin - 1)
            at -= 1
        skip = begin > 0
        while True:
            got = f.read(CHUNK)
            rest += got
            *whole, last = rest.split(b"\n")
            if not got and last:
                whole, last = [*whole, last], b""
            for line in whole:
                if skip:
                    skip = False
                elif at >= end:
                    return
                else:
                    yield at, line
                at += len(line) + 1
            rest = last
            if not got or (at >= end and not skip):
                return


class Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        super().__init__((path, begin, end))


class CopyReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.kinds = schema
        self.path = options["path"]
        self.marks = options.get("marks", "false") == "true"
        self.split = int(options.get("split", SPLIT))
        self.begin, self.end = int(options.get("begin", 0)), int(options.get("end", 1 << 62))

    def partitions(self) -> list[Range]:
        files, root = opened(self.path)
        info = files.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else [f for f in files.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File and f.base_name[0] not in "._"]
        out = [Range(f.path, a, min(a + self.split, self.end, f.size)) for f in sorted(found, key=lambda f: f.path) for a in range(self.begin, min(f.size, self.end), self.split)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        path, begin, end = partition.value
        if not path:
            return
        files = opened(self.path)[0]
        arrays = [isinstance(f.dataType, ArrayType) for f in self.kinds.fields]
        names = self.kinds.names
        kinds = [pa.list_(pa.string()) if a else pa.string() for a in arrays]
        if self.marks:
            kinds[0] = pa.int64()
        rows: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for at, line in lines(files, path, begin, end):
            if self.marks:
                if line.startswith(b"COPY ") and line.endswith(b" FROM stdin;") or line == END:
                    rows.append((at, line.decode()))
                continue
            if line == END:
                break
            values = [unescaped(v) for v in line.decode().split("\t")]
            if len(values) != len(names):
                raise ValueError(f"{path}, byte {at}: {len(values)} columns, not {len(names)}")
            rows.append(tuple(elements(v) if a else v for v, a in zip(values, arrays, strict=True)))
            size += len(line)
            if size >= CHUNK:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()


class CopyText(DataSource):
    """format("copy_text"): options path, split (bytes of a range), begin and end (bytes of the table's rows)."""

    @classmethod
    def name(cls) -> str:
        return "copy_text"

    def reader(self, schema: StructType) -> CopyReader:
        return CopyReader(schema, dict(self.options))


def as_texts(names: list[str], schema: StructType) -> StructType:
    """What the source gives: texts, and arrays of texts where the schema has them. Vectors are texts."""
    out = StructType()
    for c in names:
        kind = schema[c].dataType if c in schema.names else StringType()
        out.add(c, ArrayType(StringType()) if isinstance(kind, ArrayType) and not isinstance(kind.elementType, FloatType) else StringType())
    return out


def read_copy(spark: SparkSession, path: str, schema: StructType, columns: list[str] | None = None, **options: str | int) -> DataFrame:
    """Rows of one table, its columns in the order of `columns`, with the schema's types. Columns that the rows lack are null."""
    spark.dataSource.register(CopyText)
    names = columns or schema.names
    rows = spark.read.format("copy_text").schema(as_texts(names, schema)).options(path=path, **options).load()
    flags = [f.name for f in schema.fields if isinstance(f.dataType, BooleanType) and f.name in names]
    rows = rows.withColumns({c: F.col(c) == "t" for c in flags} | {f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in names})
    return declared(rows, schema)


def blocks(spark: SparkSession, path: str, **options: str | int) -> dict[str, tuple[list[str], int, int]]:
    """Columns, first byte and end of each table's rows in a plain dump. Only the lines that look like marks leave the tasks."""
    spark.dataSource.register(CopyText)
    marks = spark.read.format("copy_text").schema("at long, line string").options(path=path, marks="true", **options).load()
    out: dict[str, tuple[list[str], int, int]] = {}
    table = None
    for r in marks.sort("at").toLocalIterator():
        if table is None and (m := COPY.fullmatch(r["line"])):
            table = (m[1], [c.strip().strip('"') for c in m[2].split(",")], r["at"] + len(r["line"].encode()) + 1)
        elif table is not None and r["line"] == END.decode():
            out[table[0]] = (table[1], table[2], r["at"])
            table = None
    return out


def read_dump(spark: SparkSession, path: str, table: str, schema: StructType, **options: str | int) -> DataFrame:
    """A table of a plain dump."""
    columns, begin, end = blocks(spark, path, **options)[table]
    return read_copy(spark, path, schema, columns, begin=begin, end=end, **options)


def copy_line(df: DataFrame) -> Column:
    """A row as a line of COPY's text form."""

    def escaped(c: Column) -> Column:
        c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
        for letter, char in ESCAPES.items():
            c = F.replace(c, F.lit(char), F.lit("\\" + letter))
        return c

    def text(name: str, kind) -> Column:
        c = F.col(name)
        if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType):
            c = F.concat(F.lit("["), F.array_join(c.cast("array<string>"), ","), F.lit("]"))
        elif isinstance(kind, ArrayType):
            quoted = lambda x: F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
            c = F.concat(F.lit("{"), F.array_join(F.transform(c, lambda x: F.coalesce(quoted(x), F.lit("NULL"))), ","), F.lit("}"))
        elif isinstance(kind, BooleanType):
            c = F.when(c, "t").when(~c, "f")
        elif isinstance(kind, TimestampType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSSXXX")
        return F.coalesce(escaped(c.cast("string")), F.lit(NULL))

    return F.concat_ws("\t", *(text(f.name, f.dataType) for f in df.schema.fields))


def write_copy(df: DataFrame, path: str) -> None:
    """df as files of COPY's text form, one for each partition."""
    df.select(copy_line(df).alias("value")).write.text(path)

