"""Sinks: delimited text, JSON lines and spreadsheets, with one text form for each type of cell."""

from __future__ import annotations

import zipfile
from io import BytesIO
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.config import QueryError


def cell(c: Column, t: T.DataType, sep: str = ";") -> Column:
    """Text of a value: three decimals for floats, exact other numbers, ISO dates, lists joined, links as their href."""
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return F.format_string("%.3f", c.cast("double")) if c is not None else c
    if isinstance(t, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if isinstance(t, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(t, T.ArrayType):
        return F.array_join(F.transform(c, lambda x: cell(x, t.elementType, sep)), sep)
    if isinstance(t, T.StructType):
        return c["href"] if "href" in t.names else F.to_json(c)
    return F.to_json(c) if isinstance(t, T.MapType) else c.cast("string")


def as_text(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(F.col(f"`{f.name}`").isNotNull(), cell(F.col(f"`{f.name}`"), f.dataType)).alias(f.name) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str, sep: str = ",", overwrite: bool = False, header: bool = True) -> None:
    as_text(df).write.mode("overwrite" if overwrite else "errorifexists").option("header", header).option("sep", sep).option("escape", '"').csv(path)


def write_tsv(df: DataFrame, path: str, **options) -> None:
    write_csv(df, path, "\t", **options)


def write_json_lines(df: DataFrame, path: str, overwrite: bool = False, compression: str = "none") -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").option("compression", compression).json(path)


def workbook(names: list[str], rows: list[list], sheet: str = "Sheet1") -> bytes:
    """An .xlsx file with one sheet: numbers and booleans typed, the rest as text."""

    def one(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c><v>{v}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    def ref(i: int) -> str:
        out = ""
        while i >= 0:
            out, i = chr(65 + i % 26) + out, i // 26 - 1
        return out

    ns = "http://schemas.openxmlformats.org"
    lines = [f'<row r="{r}">' + "".join(one(v).replace("<c", f'<c r="{ref(i)}{r}"', 1) for i, v in enumerate(row)) + "</row>" for r, row in enumerate([names, *rows], 1)]
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{ns}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{ns}/package/2006/relationships"><Relationship Id="r1" Type="{ns}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{ns}/spreadsheetml/2006/main" xmlns:r="{ns}/officeDocument/2006/relationships"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{ns}/package/2006/relationships"><Relationship Id="r1" Type="{ns}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{ns}/spreadsheetml/2006/main"><sheetData>{"".join(lines)}</sheetData></worksheet>',
    }
    out = BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


MAX_SHEET_ROWS = 1_048_575


def write_excel(df: DataFrame, path: str, sheet: str = "Sheet1") -> None:
    """One file written by the driver; a table with more rows than a sheet can hold is an error."""
    rows = df.limit(MAX_SHEET_ROWS + 1).collect()
    if len(rows) > MAX_SHEET_ROWS:
        raise QueryError(f"a sheet holds {MAX_SHEET_ROWS} rows")
    plain = [[v if isinstance(v, (bool, int, float, type(None))) else ";".join(map(str, v)) if isinstance(v, list) else v.isoformat() if hasattr(v, "isoformat") else v for v in r] for r in rows]
    with open(path, "wb") as f:
        f.write(workbook(df.columns, plain, sheet))


def write_sheet(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """By extension: .csv, .tsv, .jsonl or .xlsx."""
    name = path.lower()
    if name.endswith(".xlsx"):
        return write_excel(df, path)
    for end, writer in ((".csv", write_csv), (".tsv", write_tsv), (".jsonl", write_json_lines)):
        if name.endswith(end):
            return writer(df, path, overwrite=overwrite)
    raise QueryError(f"can't tell the kind of {path}")
