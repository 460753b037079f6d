"""JSON-lines, CSV and XML text."""

from __future__ import annotations

import re
from xml.etree.ElementTree import ParseError, XMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.leaves import json_text
from .decode import line_records


def jsonl_source(spark: SparkSession, path: str) -> DataFrame:
    return line_records(spark.read.text(path))


def jsonl_stream(spark: SparkSession, path: str, newest_first: bool = True, max_files: int = 100) -> DataFrame:
    """Follow a folder of line files, those already there included; ``newest_first`` takes the latest files first."""
    lines = (spark.readStream.format("text").option("latestFirst", str(newest_first).lower())
             .option("maxFilesPerTrigger", max_files).load(path))
    return line_records(lines)


def csv_source(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', multiLine=True)


# every match starts with its separator, so empty cells count; possessive loops never go back
_QUOTED = '"(?:[^"]++|"")*+"'
_LINES = re.compile(f'\n((?:{_QUOTED}|[^"\n]++)*+)')
_CELLS = re.compile(f",({_QUOTED}|[^,]*+)")


def _csv_rows(text: str) -> list[list[str]]:
    """Cells of the lines that hold any; text without a quote is simply split."""
    text = text.strip(" ")
    quoted = '"' in text
    lines = _LINES.findall("\n" + text) if quoted else text.split("\n")
    lines = [x[:-1] if x.endswith("\r") else x for x in lines]
    if not quoted:
        return [x.split(",") for x in lines if x]
    cells = ([c[1:-1].replace('""', '"') if c.startswith('"') else c for c in _CELLS.findall("," + x)] for x in lines if x)
    return list(cells)


def csv_to_records(text: Column) -> Column:
    """CSV text with a header line as array<map<string,string>>; missing cells are null.

    Of columns with the same name the last one counts. Null and empty texts have no records.
    """

    @F.arrow_udf("array<map<string,string>>")
    def records(texts: pa.Array) -> pa.Array:
        keys, values, ends, sizes = [], [], [0], [0]
        headers: dict[tuple, tuple[list[str], list[int]]] = {}  # texts of one kind share their header
        for t in texts.to_pylist():
            rows = _csv_rows(t) if t else []
            if rows:
                names = tuple(rows[0])
                if names not in headers:
                    headers.clear()
                    places = {n: i for i, n in enumerate(names)}
                    headers[names] = list(places), list(places.values())
                known, places = headers[names]
                for row in rows[1:]:
                    n = len(row)
                    keys += known
                    values += [row[i] if i < n else None for i in places]
                    ends.append(len(keys))
            sizes.append(len(ends) - 1)
        maps = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string()))
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), maps)

    return records(text)


def csv_line(df: DataFrame, field_order: list[str] | None = None) -> Column:
    names = field_order or sorted(df.columns)
    cols = [F.col(f"`{n}`") if n in df.columns else F.lit(None).cast("string") for n in names]
    return F.to_csv(F.struct(*[c.alias(n) for c, n in zip(cols, names)]), {
        "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "",
        "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})


def records_to_csv(df: DataFrame, field_order: list[str] | None = None, name: str = "csv") -> DataFrame:
    """Header plus one line as the CSV text of each record."""
    header = ",".join(field_order or sorted(df.columns))
    return df.withColumn(name, F.concat(F.lit(header + "\r\n"), csv_line(df, field_order), F.lit("\r\n")))


def write_csv(df: DataFrame, path: str, field_order: list[str] | None = None) -> None:
    names = field_order or sorted(df.columns)
    df.select(*[F.col(f"`{n}`") for n in names]).write.csv(path, header=True, escape='"', emptyValue="")


def xml_to_records(text: Column, schema: T.StructType) -> Column:
    """Parse XML into ``schema`` (fields of the root element) plus ``_raw_xml`` for malformed text."""
    wanted = T.StructType(schema.fields + [T.StructField("_raw_xml", T.StringType())])
    return F.from_xml(text, wanted, {
        "attributePrefix": "@", "valueTag": "_text", "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": "_raw_xml", "ignoreNamespace": "true"})


class _XmlTree:
    """Elements as nested dicts while they are parsed, by a stack of open elements."""

    def __init__(self) -> None:
        self.open: list[list] = [["", {}, [], False]]  # name, fields, texts before the first child, whether one came

    def start(self, tag: str, attributes: dict) -> None:
        self.open[-1][3] = True
        self.open.append([tag.rsplit("}", 1)[-1], {"@" + k: v for k, v in attributes.items()}, [], False])

    def data(self, text: str) -> None:
        if not self.open[-1][3]:
            self.open[-1][2].append(text)

    def end(self, tag: str) -> None:
        name, fields, texts, _ = self.open.pop()
        text = "".join(texts).strip()
        if text and fields:  # a leaf is a plain string
            fields["_text"] = text
        value, holder = fields or text, self.open[-1][1]
        if name not in holder:
            holder[name] = value
        elif isinstance(holder[name], list):
            holder[name].append(value)
        else:
            holder[name] = [holder[name], value]

    def close(self) -> dict:
        return self.open[0][1]


def _xml_json(text: str) -> str:
    parser = XMLParser(target=_XmlTree())
    try:
        parser.feed(text)
        found = parser.close()
    except ParseError:
        found = {"_raw_xml": text}
    return json_text(found)


def xml_to_variant(text: Column) -> Column:
    """XML of any root and shape as a variant ``{root: fields}``, without a schema.

    Attributes become ``@name``, text ``_text`` beside other fields, repeated children an array; names
    lose their namespace and all values are strings. Malformed text, and what is nested deeper than
    a variant can be, becomes ``{"_raw_xml": text}``; null stays null.
    """

    @F.arrow_udf("string")
    def documents(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _xml_json(t) for t in texts.to_pylist()], pa.string())

    return F.when(text.isNotNull(), F.coalesce(F.try_parse_json(documents(text)), F.to_variant_object(F.struct(text.alias("_raw_xml")))))


def xml_root(text: Column) -> Column:
    """Tag of the root element without its namespace prefix."""
    return F.regexp_extract(text, r"(?s)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*)*<(?:[^\s/>:]+:)?([^\s/>]+)", 1)
