"""Single files written by all tasks: rows become text where they lie, parts are joined as bytes and put in place by one rename.

Rows of a table stand in the order of its partitions: that of its keys after ``orderBy``. Parts are written by Spark's own
committer, so a task that is repeated or aborted leaves nothing; they lie beside the target and go in any case. Joining
copies bytes from stream to stream inside the driver's JVM, a buffer at a time: no row comes to the driver.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lumenweft import fixed
from lumenweft.functions import text as T
from lumenweft.session import delete, hadoop_path

#: Rows of a sheet beside its header: the most that the formats take.
MOST_ROWS = 1_048_575
BUFFER = 1 << 16


def _parts(df: DataFrame, value: Column, between: str, folder: str) -> tuple[list, int]:
    """Writes ``value`` of each row, ``between`` after each, as text parts; their files in order, and the number of rows."""
    seen = Observation()
    df.select(value.alias("value")).observe(seen, F.count(F.lit(1)).alias("n")).write.option("lineSep", between).text(folder)
    fs, path = hadoop_path(df.sparkSession, folder)
    found = [s for s in fs.listStatus(path) if s.getPath().getName().startswith("part-")]
    return sorted(found, key=lambda s: int(re.match(r"part-(\d+)", s.getPath().getName())[1])), seen.get["n"]


def _copy(spark: SparkSession, parts: list, out, dropped: int = 0) -> None:
    """Appends files to an open stream, all but the last ``dropped`` bytes of them."""
    copy = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.copyLarge
    lengths = [s.getLen() for s in parts]
    for k in range(len(lengths) - 1, -1, -1):
        less = min(dropped, lengths[k])
        lengths[k], dropped = lengths[k] - less, dropped - less
    for part, n in zip(parts, lengths, strict=True):
        fs, path = hadoop_path(spark, part.getPath().toString())
        stream = fs.open(path)
        try:
            copy(stream, out, 0, n)
        finally:
            stream.close()


def _assembled(spark: SparkSession, path: str, write: Callable[[str, object], None]) -> None:
    """Lets ``write`` fill a file (given a folder for its parts, and a stream) and puts it in place; nothing stays if it fails."""
    own = uuid.uuid4().hex
    folder, temporary = f"{path}.parts-{own}", f"{path}.{own}.tmp"
    fs, target = hadoop_path(spark, path)
    _, new = hadoop_path(spark, temporary)
    try:
        out = fs.create(new, True)
        try:
            write(folder, out)
        finally:
            out.close()
        fs.delete(target, False)
        if not fs.rename(new, target):
            raise OSError(f"{path} could not be put in place.")
    except BaseException:
        delete(spark, temporary)
        raise
    finally:
        delete(spark, folder)


def _put(out, text: str) -> None:
    out.write(bytearray(text.encode()))


def json_text(c: Column) -> Column:
    """A text as JSON writes it, quotes included; null is an empty text."""
    object_ = F.to_json(F.struct(T.blank(c).alias("v")))
    return F.substring(object_, F.lit(6), F.length(object_) - 6)


def write_json_array(df: DataFrame, path: str) -> None:
    """One JSON array of objects, all values texts (null is empty), indented by two, other scripts as they are."""
    spark = df.sparkSession
    names = spark.range(1).select(*(json_text(F.lit(c)).alias(f"c{k}") for k, c in enumerate(df.columns))).first()
    fields = [F.concat(F.lit(f"    {name}: "), json_text(F.col(f"`{c}`"))) for name, c in zip(names, df.columns, strict=True)]
    row = F.concat(F.lit("  {\n"), F.concat_ws(",\n", *fields), F.lit("\n  }"))

    def write(folder: str, out) -> None:
        parts, n = _parts(df, row, ",\n", folder)
        _put(out, "[\n" if n else "[")
        _copy(spark, parts, out, dropped=2)
        _put(out, "\n]" if n else "]")

    _assembled(spark, path, write)


def write_enveloped(df: DataFrame, path: str, key: str, before: str = "") -> None:
    """An object with the rows as an array under ``key``, after the members ``before`` (JSON, as they are)."""
    spark = df.sparkSession
    row = F.to_json(F.struct(*(T.blank(F.col(f"`{c}`")).alias(c) for c in df.columns)))

    def write(folder: str, out) -> None:
        parts, _ = _parts(df, row, ",\n", folder)
        name = spark.range(1).select(json_text(F.lit(key))).first()[0]
        _put(out, "{" + before + (", " if before else "") + name + ": [\n")
        _copy(spark, parts, out, dropped=2)
        _put(out, "\n]}")

    _assembled(spark, path, write)


def write_delimited_file(df: DataFrame, path: str, comma: str = ",") -> None:
    """CSV or TSV with a header and a byte order mark; every value quoted, null is empty."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    row = F.concat_ws(comma, *(quoted(T.blank(F.col(f"`{c}`"))) for c in df.columns))

    def write(folder: str, out) -> None:
        parts, _ = _parts(df, row, "\r\n", folder)
        _put(out, "﻿" + comma.join('"' + c.replace('"', '""') + '"' for c in df.columns) + "\r\n")
        _copy(df.sparkSession, parts, out)

    _assembled(df.sparkSession, path, write)


def _rows(n: int, name: str) -> int:
    if n > MOST_ROWS:
        raise ValueError(f"{name!r} has {n} rows; a sheet takes {MOST_ROWS}.")
    return n


def _escape(text: str, apostrophe: str = "'") -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", apostrophe)


def write_spreadsheet_xml(sheets: dict[str, DataFrame], path: str, apostrophe: str = "&apos;") -> None:
    """SpreadsheetML 2003, a sheet for each table, all cells texts; an empty table has an empty header."""
    spark = next(iter(sheets.values())).sparkSession

    def write(folder: str, out) -> None:
        _put(out, f'<?xml version="1.0"?>\n<?mso-application progid="Excel.Sheet"?>\n<Workbook xmlns="{fixed.SPREADSHEET}" xmlns:ss="{fixed.SPREADSHEET}">\n')
        for k, (name, df) in enumerate(sheets.items()):
            cells = [F.concat(F.lit('<Cell><Data ss:Type="String">'), T.escape_markup(F.col(f"`{c}`"), apostrophe), F.lit("</Data></Cell>")) for c in df.columns]
            parts, n = _parts(df, F.concat(F.lit("<Row>"), *cells, F.lit("</Row>")), "\n", f"{folder}/{k}")
            header = "".join(f'<Cell><Data ss:Type="String">{_escape(c, apostrophe)}</Data></Cell>' for c in df.columns) if _rows(n, name) else ""
            _put(out, f'<Worksheet ss:Name="{_escape(name, apostrophe)}"><Table>\n<Row>{header}</Row>\n')
            _copy(spark, parts, out)
            _put(out, "</Table></Worksheet>\n")
        _put(out, "</Workbook>")

    _assembled(spark, path, write)


def write_xlsx(sheets: dict[str, DataFrame], path: str) -> None:
    """An Office Open XML workbook with inline texts, a sheet for each table; deflated as it is joined."""
    spark = next(iter(sheets.values())).sparkSession
    jvm = spark.sparkContext._jvm
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    numbers = range(1, len(sheets) + 1)
    cell = ('<c t="inlineStr"><is><t xml:space="preserve">', "</t></is></c>")
    overrides = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in numbers)
    links = f'<Relationships xmlns="{fixed.OFFICE}/package/2006/relationships">'
    listed = "".join(f'<sheet name="{_escape(name)}" sheetId="{k}" r:id="rId{k}"/>' for k, name in zip(numbers, sheets, strict=True))
    texts = {
        "[Content_Types].xml": f'{head}<Types xmlns="{fixed.OFFICE}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{overrides}</Types>',
        "_rels/.rels": f'{head}{links}<Relationship Id="rId1" Type="{fixed.OFFICE}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/_rels/workbook.xml.rels": head + links + "".join(f'<Relationship Id="rId{k}" Type="{fixed.OFFICE}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in numbers) + "</Relationships>",
        "xl/workbook.xml": f'{head}<workbook xmlns="{fixed.OFFICE}/spreadsheetml/2006/main" xmlns:r="{fixed.OFFICE}/officeDocument/2006/relationships"><sheets>{listed}</sheets></workbook>',
    }

    def write(folder: str, out) -> None:
        archive = jvm.java.util.zip.ZipOutputStream(out)
        for name, text in texts.items():
            archive.putNextEntry(jvm.java.util.zip.ZipEntry(name))
            _put(archive, text)
            archive.closeEntry()
        for k, (name, df) in zip(numbers, sheets.items(), strict=True):
            cells = [F.concat(F.lit(cell[0]), _markup(F.col(f"`{c}`")), F.lit(cell[1])) for c in df.columns]
            parts, n = _parts(df, F.concat(F.lit("<row>"), *cells, F.lit("</row>")), "\n", f"{folder}/{k}")
            _rows(n, name)
            archive.putNextEntry(jvm.java.util.zip.ZipEntry(f"xl/worksheets/sheet{k}.xml"))
            header = "".join(cell[0] + _escape(c) + cell[1] for c in df.columns)
            _put(archive, f'{head}<worksheet xmlns="{fixed.OFFICE}/spreadsheetml/2006/main"><sheetData><row>{header}</row>\n')
            _copy(spark, parts, archive)
            _put(archive, "</sheetData></worksheet>")
            archive.closeEntry()
        archive.finish()

    _assembled(spark, path, write)


#: Signs that XML 1.0 has no way to write.
NO_XML = r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]"


def _markup(c: Column) -> Column:
    return T.escape_markup(F.regexp_replace(T.blank(c), NO_XML, ""), "'")


def read_sheet_rows(spark: SparkSession, path: str) -> DataFrame:
    """(cells) of every row, headers too, of a SpreadsheetML file: read by ranges, a row a record, in no stated order."""
    rows = spark.read.format("xml").options(rowTag="Row", ignoreSurroundingSpaces=False, mode="FAILFAST").schema("Cell array<struct<Data:string>>").load(path)
    return rows.select(F.coalesce(F.transform("Cell", lambda c: F.coalesce(c.Data, F.lit(""))), F.array().cast("array<string>")).alias("cells"))


def read_xlsx_rows(spark: SparkSession, path: str, sheet: int = 1, scratch_path: str | None = None) -> DataFrame:
    """(cells) of every row, the header too, of a workbook's sheet with inline texts. The sheet is unpacked beside the file (or
    at ``scratch_path``), from stream to stream, and then read by ranges."""
    jvm = spark.sparkContext._jvm
    fs, source = hadoop_path(spark, path)
    target = scratch_path or f"{path}.sheet-{uuid.uuid4().hex}.xml"
    _, unpacked = hadoop_path(spark, target)
    archive = jvm.java.util.zip.ZipInputStream(fs.open(source))
    try:
        entry = archive.getNextEntry()
        while entry is not None and entry.getName() != f"xl/worksheets/sheet{sheet}.xml":
            entry = archive.getNextEntry()
        if entry is None:
            raise ValueError(f"There is no sheet {sheet} in {path}.")
        out = fs.create(unpacked, True)
        try:
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(archive, out, BUFFER, False)
        finally:
            out.close()
    finally:
        archive.close()
    rows = spark.read.format("xml").options(rowTag="row", ignoreSurroundingSpaces=False, mode="FAILFAST").schema("c array<struct<is:struct<t:string>>>").load(target)
    return rows.select(F.coalesce(F.transform("c", lambda c: F.coalesce(c["is"]["t"], F.lit(""))), F.array().cast("array<string>")).alias("cells"))
