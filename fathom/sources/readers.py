"""Sources: delimited text, JSON lines and arrays, and spreadsheets, as DataFrames of strings or typed columns."""

from __future__ import annotations

import re
import zipfile
from io import BytesIO
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.config import QueryError


def header_names(names: list[str | None], strict: bool = False) -> list[str]:
    """Trimmed names; blank ones become columnN and repeated ones get _2, _3. Strict: both are errors."""
    out: list[str] = []
    for i, raw in enumerate(names):
        name = (raw or "").strip()
        if strict and (not name or name in out):
            raise QueryError(f"header {i + 1} is {'blank' if not name else 'repeated: ' + name}")
        name = name or f"column{i + 1}"
        k, one = 2, name
        while one in out:
            one, k = f"{name}_{k}", k + 1
        out.append(one)
    return out


def read_delimited(spark: SparkSession, path: str, sep: str = ",", header: bool = True, strict: bool = False) -> DataFrame:
    """All columns as strings. Only the first row is looked at for names; the rest is read in parallel."""
    raw = spark.read.option("sep", sep).option("multiLine", True).option("escape", '"').option("header", False)
    if not header:
        return raw.csv(path)
    first = raw.csv(path).limit(1).collect()
    if not first:
        return spark.createDataFrame([], "column1 string").limit(0)
    names = header_names(list(first[0]), strict)
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    return spark.read.option("sep", sep).option("multiLine", True).option("escape", '"').option("header", True).option("enforceSchema", True).schema(schema).csv(path)


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_delimited(spark, path, ",", **options)


def read_tsv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_delimited(spark, path, "\t", **options)


def read_json_lines(spark: SparkSession, path: str, skip_bad: bool = False, schema: str | None = None) -> DataFrame:
    """A malformed line stops the read, or is left out."""
    r = spark.read.option("mode", "DROPMALFORMED" if skip_bad else "FAILFAST")
    return (r.schema(schema) if schema else r).json(path)


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """Files that hold one array of objects; an element that isn't an object is an error."""
    whole = spark.read.option("wholetext", True).text(path).select(F.parse_json("value").alias("v"))
    each = whole.select(F.explode(F.col("v").cast("array<variant>")).alias("v")).select(F.to_json("v").alias("j"))
    bad = F.assert_true(F.col("j").startswith("{"), F.concat(F.lit("not an object: "), F.col("j")))
    lines = each.select(F.coalesce(bad.cast("string"), F.col("j")).alias("j"))
    return spark.read.option("mode", "FAILFAST").json(lines.rdd.map(lambda r: r.j)) if not lines.isEmpty() else spark.createDataFrame([], "value string")


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheet_rows(data: bytes, sheet: str | int = 0) -> list[list[str | None]]:
    """The cells of one sheet of an .xlsx file, as text; numbers as written, booleans as true or false."""
    z = zipfile.ZipFile(BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
    sheets = [(s.get("name"), s.get(_REL)) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet")]
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    found = [r for i, (n, r) in enumerate(sheets) if sheet in (i, n)]
    if not found:
        raise QueryError(f"no sheet {sheet!r}")
    out: list[list[str | None]] = []
    for row in ElementTree.fromstring(z.read("xl/" + rels[found[0]].removeprefix("/xl/"))).iter(f"{_NS}row"):
        cells: list[str | None] = []
        for c in row.iter(f"{_NS}c"):
            at = 0
            for ch in re.match("[A-Z]+", c.get("r", "A"))[0]:
                at = at * 26 + ord(ch) - 64
            cells += [None] * (at - 1 - len(cells))
            v, kind = c.find(f"{_NS}v"), c.get("t")
            text = "".join(t.text or "" for t in c.iter(f"{_NS}t")) if kind == "inlineStr" else None if v is None else v.text
            cells.append(shared[int(text)] if kind == "s" and text else ("true" if text == "1" else "false") if kind == "b" else text)
        out.append(cells)
    return out


def read_excel(spark: SparkSession, path: str, sheet: str | int = 0, header: bool = True, strict: bool = False) -> DataFrame:
    """Sheets as strings. Each file is parsed by one task; the names come from the first file."""
    files = spark.read.format("binaryFile").load(path)
    head = files.orderBy("path").limit(1).select("content").first()
    rows = sheet_rows(bytes(head.content), sheet)
    width = max((len(r) for r in rows), default=1)
    names = header_names(rows[0] + [None] * (width - len(rows[0])), strict) if header and rows else [f"column{i + 1}" for i in range(width)]

    def parse(batches):
        import pandas as pd

        for b in batches:
            for data in b["content"]:
                got = [(r + [None] * len(names))[: len(names)] for r in sheet_rows(bytes(data), sheet)[1 if header else 0 :]]
                yield pd.DataFrame(got, columns=names, dtype=object)

    return files.select("content").mapInPandas(parse, ", ".join(f"`{n}` string" for n in names))


def read_sheet(spark: SparkSession, path: str, **options) -> DataFrame:
    """By extension, .gz aside: .csv, .tsv or .tab, .xlsx, .json or .jsonl."""
    name = path.lower().removesuffix(".gz").rstrip("/")
    for ends, reader in (((".csv",), read_csv), ((".tsv", ".tab"), read_tsv), ((".xlsx",), read_excel), ((".jsonl", ".ndjson"), read_json_lines), ((".json",), read_json_array)):
        if name.endswith(ends):
            return reader(spark, path, **options)
    raise QueryError(f"can't tell the kind of {path}")


def as_list(c: Column, sep: str = ";") -> Column:
    """A delimited cell as trimmed values without blanks; null stays null."""
    return F.filter(F.transform(F.split(c, re.escape(sep)), lambda x: F.trim(x)), lambda x: x != "")


def as_bool(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t.isin("true", "t", "yes", "y", "1"), True).when(t.isin("false", "f", "no", "n", "0"), False)


def typed(c: Column, kind: str, default=None) -> Column:
    """A cell as string, bool, int, long, float, double, date or list; unreadable ones give the default."""
    if kind == "list":
        return as_list(c)
    got = as_bool(c) if kind == "bool" else F.try_to_timestamp(c) if kind == "date" else c if kind == "string" else F.trim(c).try_cast(kind)
    return got if default is None else F.coalesce(got, F.lit(default))
