"""OOXML office files as tables: package entries, sheets, cells, merges, text blocks and slides.

Spark lists, opens and partitions the files (binaryFile); a small generator reads the parts of one file at a time. What
joins parts with each other, such as cells with shared strings, is a join of the tables. A file that is no readable
package gives no rows but one in problems().
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from itertools import islice
from typing import IO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireframe.functions import a1, numbers
from quireframe.operators import lookup

#: Limits on what a package may unpack to: bytes of a part, and how many times its packed size.
MOST_PART_BYTES, MOST_RATIO = 1 << 30, 1000


def read_files(spark: SparkSession, path: str, pattern: str = "*.{xlsx,docx,pptx}") -> DataFrame:
    """(file_id, content): the office files below a folder, in any store that Spark reads. Spark passes over empty files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("file_id"), "content")


#: Rows of a file that are held while it is read for the first time, and rows of a batch.
HELD, BATCH = 50_000, 5000


def _rows(files: DataFrame, read: Callable[[zipfile.ZipFile], Iterator[tuple]], schema: str) -> DataFrame:
    """A table of what ``read`` gives for each package, file_id before it. A file that cannot be read to its end gives no rows.

    So a file is read to its end before its first row is given on. Its rows are held for that only up to HELD; one that
    has more is read a second time, batch by batch.
    """
    names = ["file_id", *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file_id, content in zip(batch["file_id"], batch["content"], strict=True):
                if content is None:  # not a filter of the table: Spark would make computed contents once for it and once more
                    continue
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as package:
                        found = read(package)
                        rows = list(islice(found, HELD))
                        large = sum(1 for _ in found) > 0
                except (zipfile.BadZipFile, zlib.error, ElementTree.ParseError, KeyError, OSError, ValueError, TypeError):
                    continue  # problems() has it
                with zipfile.ZipFile(io.BytesIO(content)) as package:
                    again = read(package) if large else iter(rows)
                    while some := list(islice(again, BATCH)):
                        yield pd.DataFrame([(file_id, *row) for row in some], columns=names, dtype=object)

    return files.mapInPandas(run, f"file_id string, {schema}")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attribute(node: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if _local(k) == name), None)


def _relation(node: ElementTree.Element) -> str:
    """The relationship's id, which has a namespace, where an element may have a plain id too."""
    return next((v for k, v in node.attrib.items() if k.endswith("}id")), "")


def _has(package: zipfile.ZipFile, part: str | None) -> bool:
    """Is a part there? By the package's index: its list of names would be made and gone through each time."""
    return part in package.NameToInfo


def _stream(package: zipfile.ZipFile, part: str) -> IO[bytes]:
    """A part as a stream that unpacks while it is read."""
    info = package.getinfo(part)
    if info.file_size > MOST_PART_BYTES or info.file_size > MOST_RATIO * max(1, info.compress_size):
        raise ValueError(f"{part} unpacks to {info.file_size} bytes")
    return package.open(part)


def _tree(package: zipfile.ZipFile, part: str) -> ElementTree.Element:
    with _stream(package, part) as source:
        return ElementTree.parse(source).getroot()


def _below(node: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (x for x in node.iter() if _local(x.tag) == name)


def _relations(package: zipfile.ZipFile, part: str) -> Iterator[tuple[str, str, str, str]]:
    """(part, id, target, type) of a part's relationships, targets as paths in the package; absolute urls as they are."""
    folder, name = posixpath.split(part)
    own = f"{folder}/_rels/{name}.rels".lstrip("/")
    if _has(package, own):
        for r in _below(_tree(package, own), "Relationship"):
            target = r.get("Target", "")
            if r.get("TargetMode") != "External" and "://" not in target:
                target = posixpath.normpath(target if target.startswith("/") else posixpath.join(folder, target)).lstrip("/")
            yield part, r.get("Id", ""), target, (r.get("Type") or "").rpartition("/")[2]


def entries(files: DataFrame) -> DataFrame:
    """The directory of each package."""
    return _rows(files, lambda z: ((i.filename, i.compress_size, i.file_size) for i in z.infolist()), "part string, packed long, size long")


def relationships(files: DataFrame) -> DataFrame:
    def read(z: zipfile.ZipFile) -> Iterator[tuple]:
        for part in z.namelist():
            if not part.endswith(".rels"):
                yield from _relations(z, part)

    return _rows(files, read, "part string, rel_id string, target string, type string")


def problems(files: DataFrame) -> DataFrame:
    """(file_id, code, message) of the files that cannot be read to their end, and of those that name a part twice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file_id, content in zip(batch["file_id"], batch["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                        names = z.namelist()
                        if len(set(names)) < len(names):
                            rows.append((file_id, "duplicate", "a part is there twice"))
                        for part in names:
                            if part.endswith((".xml", ".rels")):
                                _tree(z, part)
                except Exception as error:  # whatever a broken file brings about is its problem
                    rows.append((file_id, type(error).__name__, str(error)))
            yield pd.DataFrame(rows, columns=["file_id", "code", "message"])

    return files.mapInPandas(run, "file_id string, code string, message string")


def _sheet_parts(z: zipfile.ZipFile) -> Iterator[tuple[str, str, str, str, int]]:
    targets = {r[1]: r[2] for r in _relations(z, "xl/workbook.xml")}
    for i, s in enumerate(_below(_tree(z, "xl/workbook.xml"), "sheet"), 1):
        part = targets.get(_relation(s), f"xl/worksheets/sheet{i}.xml")
        yield s.get("sheetId") or str(i), s.get("name") or "", part, s.get("state") or "visible", i


def sheets(files: DataFrame) -> DataFrame:
    """(file_id, sheet_id, name, part, state, ord), hidden sheets too."""
    return _rows(files, lambda z: _sheet_parts(z) if "xl/workbook.xml" in z.namelist() else iter(()), "sheet_id string, name string, part string, state string, ord int")


def shared_strings(files: DataFrame) -> DataFrame:
    """(file_id, index, value): the workbook's strings, phonetic hints left out."""

    def read(z: zipfile.ZipFile) -> Iterator[tuple]:
        if "xl/sharedStrings.xml" in z.namelist():
            for i, si in enumerate(_below(_tree(z, "xl/sharedStrings.xml"), "si")):
                yield i, "".join(t.text or "" for c in si if _local(c.tag) != "rPh" for t in _below(c, "t"))

    return _rows(files, read, "index int, value string")


def _sheet_items(z: zipfile.ZipFile, wanted: set[str]) -> Iterator[tuple[str, str, ElementTree.Element]]:
    """(sheet_id, kind, element) of elements of all sheets, one at a time; each leaves the tree after use."""
    if "xl/workbook.xml" not in z.namelist():
        return
    for sheet_id, _, part, *_ in _sheet_parts(z):
        if _has(z, part):
            with _stream(z, part) as source:
                path: list[ElementTree.Element] = []
                for event, node in ElementTree.iterparse(source, ("start", "end")):
                    if event == "start":
                        path.append(node)
                        continue
                    path.pop()
                    if _local(node.tag) in wanted:
                        yield sheet_id, _local(node.tag), node
                    if _local(node.tag) in wanted or len(path) == 1:
                        path[-1].remove(node)  # else the tree would grow by an empty element for each


def peek(files: DataFrame) -> DataFrame:
    """(file_id, sheet_id, name, state, dimension, rows, columns): the range that each sheet says it has, null where it says none.

    A sheet is unpacked only up to its data, however large it is.
    """

    def read(z: zipfile.ZipFile) -> Iterator[tuple]:
        for sheet_id, name, part, state, _ in _sheet_parts(z) if "xl/workbook.xml" in z.namelist() else ():
            found = None
            if _has(z, part):
                with _stream(z, part) as source:
                    for _, node in ElementTree.iterparse(source, ("start",)):
                        if _local(node.tag) == "dimension":
                            found = node.get("ref")
                        if _local(node.tag) in ("dimension", "sheetData"):
                            break
            yield sheet_id, name, state, found

    found = _rows(files, read, "sheet_id string, name string, state string, dimension string")
    r = a1.parse_range(F.when(F.col("dimension").contains(":"), F.col("dimension")).otherwise(F.concat_ws(":", "dimension", "dimension")))
    return found.withColumns({"rows": r["end_row"] - r["start_row"] + 1, "columns": r["end_column"] - r["start_column"] + 1})


def number_formats(files: DataFrame) -> DataFrame:
    """(file_id, style_id, format_id, code): the number format of each cell style; built-in ones by their fixed codes."""

    def read(z: zipfile.ZipFile) -> Iterator[tuple]:
        if "xl/styles.xml" not in z.namelist():
            return
        root = _tree(z, "xl/styles.xml")
        own = {int(n.get("numFmtId")): n.get("formatCode") for n in _below(root, "numFmt")}
        for i, xf in enumerate(x for group in _below(root, "cellXfs") for x in group if _local(x.tag) == "xf"):
            n = int(xf.get("numFmtId") or 0)
            yield i, n, own.get(n) or numbers.BUILTIN_FORMATS.get(n, "General")

    return _rows(files, read, "style_id int, format_id int, code string")


def displayed(cells: DataFrame, formats: DataFrame, codes: tuple[str, ...] = tuple(numbers.BUILTIN_FORMATS.values())) -> DataFrame:
    """cells() with code and shown: numbers by the format of their style, if it is one of ``codes``, else in general form.

    A workbook has few styles, so its formats are joined by file and style.
    """
    found = cells.join(formats.select("file_id", "style_id", "code"), ["file_id", "style_id"], "left").withColumn("code", F.coalesce("code", F.lit("General")))
    number = F.when(F.col("code").isin(*codes), numbers.display_by(F.col("num_value"), F.col("code"), list(dict.fromkeys(codes)))).otherwise(numbers.general(F.col("num_value")))
    return found.withColumn("shown", F.when(F.col("type") == "n", number).otherwise(F.col("value")))


def _raw_cells(z: zipfile.ZipFile) -> Iterator[tuple]:
    for sheet_id, _, row in _sheet_items(z, {"row"}):
        column = 0
        for c in row:
            ref = c.get("r")
            m = re.fullmatch(r"([A-Z]+)([0-9]+)", ref or "")
            column = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(m[1]))) if m else column + 1
            at = {_local(x.tag): x for x in c}
            kind = c.get("t") or "n"
            value = "".join(t.text or "" for t in _below(at["is"], "t")) if "is" in at else at["v"].text if "v" in at else None
            number = int(row.get("r")) if row.get("r") else int(m[2]) if m else None
            yield sheet_id, number, column, kind, value, int(c.get("s") or 0), at["f"].text if "f" in at else None


def cells(files: DataFrame) -> DataFrame:
    """(file_id, sheet_id, row_index, column_index, ref, type, raw_value, value, num_value, style_id, formula).

    value is what shows: the shared string of an index, TRUE or FALSE, else the raw value. A cell without a reference
    is at the right of the one before.
    """
    raw = _rows(files, _raw_cells, "sheet_id string, row_index int, column_index int, type string, raw_value string, style_id int, formula string")
    index = F.when(F.col("type") == "s", F.col("raw_value").try_cast("int"))
    # Spark takes what is read from packages for as small as their table, so strings would be broadcast
    found = lookup.resolve(raw.withColumn("string_index", index), shared_strings(files).hint("merge"), ["file_id"], "string_index")
    value = F.when(F.col("type") == "s", F.col("value")).when(F.col("type") == "b", F.when(F.col("raw_value") == "1", "TRUE").otherwise("FALSE")).otherwise(F.coalesce("raw_value", F.lit("")))
    return found.select(
        "file_id", "sheet_id", "row_index", "column_index", a1.cell_ref(F.col("row_index"), F.col("column_index")).alias("ref"), "type", "raw_value", value.alias("value"),
        F.when(F.col("type") == "n", F.col("raw_value").try_cast("double")).alias("num_value"), "style_id", "formula",
    )


def merges(files: DataFrame) -> DataFrame:
    """(file_id, sheet_id, ref, start_row, start_column, end_row, end_column)."""
    found = _rows(files, lambda z: ((s, n.get("ref")) for s, _, n in _sheet_items(z, {"mergeCell"})), "sheet_id string, ref string")
    r = a1.parse_range(F.col("ref"))
    return found.select("file_id", "sheet_id", "ref", *[r[c].alias(c) for c in ("start_row", "start_column", "end_row", "end_column")])


def axis_metrics(files: DataFrame) -> DataFrame:
    """(file_id, sheet_id, axis, first, last, size, hidden): row heights in points and column widths in characters."""

    def read(z: zipfile.ZipFile) -> Iterator[tuple]:
        yes = lambda v: v in ("1", "true")
        number = lambda v: float(v) if v else None
        for sheet_id, kind, n in _sheet_items(z, {"row", "col"}):
            if kind == "col":
                yield sheet_id, "column", int(n.get("min")), int(n.get("max")), number(n.get("width")), yes(n.get("hidden"))
            elif n.get("ht") or n.get("hidden"):
                yield sheet_id, "row", int(n.get("r")), int(n.get("r")), number(n.get("ht")), yes(n.get("hidden"))

    return _rows(files, read, "sheet_id string, axis string, first int, last int, size double, hidden boolean")


def _paragraph_text(p: ElementTree.Element) -> str:
    """Text of a paragraph as it stands after its tracked changes: deleted and moved-away runs are left out."""
    out = []

    def walk(node: ElementTree.Element) -> None:
        for x in node:
            name = _local(x.tag)
            if name in ("del", "moveFrom", "pPr", "rPr", "instrText"):
                continue
            if name == "t":
                out.append(x.text or "")
            elif name in ("tab", "br", "cr"):
                out.append("\t" if name == "tab" else "\n")
            else:
                walk(x)

    walk(p)
    return "".join(out)


def _first(node: ElementTree.Element, name: str) -> ElementTree.Element | None:
    return next(_below(node, name), None)


def _children(z: zipfile.ZipFile, part: str, parent: str) -> Iterator[ElementTree.Element]:
    """The children of a part's first element of a name, one at a time; each leaves the tree after use."""
    with _stream(z, part) as source:
        path: list[ElementTree.Element] = []
        at = None
        for event, node in ElementTree.iterparse(source, ("start", "end")):
            if event == "start":
                path.append(node)
                if at is None and _local(node.tag) == parent:
                    at = len(path)
                continue
            path.pop()
            if at is not None and len(path) == at:
                yield node
                path[-1].remove(node)
            elif at is not None and len(path) < at:
                return


def regions(files: DataFrame) -> DataFrame:
    """(file_id, section, kind, type, text): headers and footers of each section (from 0) of text documents.

    type is default, first or even; a section without one of its own has that of the section before.
    """

    def read(z: zipfile.ZipFile) -> Iterator[tuple]:
        if "word/document.xml" not in z.namelist():
            return
        targets = {r[1]: r[2] for r in _relations(z, "word/document.xml")}
        now: dict[tuple[str, str], str] = {}
        section = 0
        for child in _children(z, "word/document.xml", "body"):
            end = child if _local(child.tag) == "sectPr" else _first(child, "sectPr") if _local(child.tag) == "p" else None
            if end is None:
                continue
            for x in end:
                kind = _local(x.tag).removesuffix("Reference")
                part = targets.get(_relation(x))
                if kind in ("header", "footer") and _has(z, part):
                    now[kind, _attribute(x, "type") or "default"] = "\n".join(_paragraph_text(p) for p in _below(_tree(z, part), "p"))
            for (kind, type_), text in sorted(now.items()):
                yield section, kind, type_, text
            section += 1

    return _rows(files, read, "section int, kind string, type string, text string")


def blocks(files: DataFrame) -> DataFrame:
    """(file_id, ord, type, text, style_id, outline_level, num_id, num_level, page_break): the body of each text document.

    A table is a block for each row, its cells' texts joined by bars. page_break: a break stands in the block or its
    paragraph asks for one.
    """

    def read(z: zipfile.ZipFile) -> Iterator[tuple]:
        if "word/document.xml" not in z.namelist():
            return
        value = lambda p, name: None if (n := _first(p, name)) is None else _attribute(n, "val")
        number = lambda v: None if v is None else int(v)
        at = 0
        for child in _children(z, "word/document.xml", "body"):
            if _local(child.tag) == "p":
                broken = any(_attribute(b, "type") == "page" for b in _below(child, "br")) or _first(child, "lastRenderedPageBreak") is not None or _first(child, "pageBreakBefore") is not None
                yield at, "paragraph", _paragraph_text(child).strip("\n"), value(child, "pStyle"), number(value(child, "outlineLvl")), value(child, "numId"), number(value(child, "ilvl")), broken
                at += 1
            elif _local(child.tag) == "tbl":
                for row in (r for r in child if _local(r.tag) == "tr"):
                    texts = ["\n".join(_paragraph_text(p) for p in _below(c, "p")) for c in row if _local(c.tag) == "tc"]
                    yield at, "table_row", "|".join(texts), None, None, None, None, _first(row, "lastRenderedPageBreak") is not None
                    at += 1

    return _rows(files, read, "ord int, type string, text string, style_id string, outline_level int, num_id string, num_level int, page_break boolean")


def styles(files: DataFrame) -> DataFrame:
    """(file_id, style_id, based_on, outline_level, name) of text documents; see lookup.inherit()."""

    def read(z: zipfile.ZipFile) -> Iterator[tuple]:
        if "word/styles.xml" in z.namelist():
            for s in _below(_tree(z, "word/styles.xml"), "style"):
                get = lambda name, s=s: None if (n := _first(s, name)) is None else _attribute(n, "val")
                level = get("outlineLvl")
                yield _attribute(s, "styleId"), get("basedOn"), None if level is None else int(level), get("name")

    return _rows(files, read, "style_id string, based_on string, outline_level int, name string")


def slide_elements(files: DataFrame) -> DataFrame:
    """(file_id, slide_index, hidden, ord, type, name, placeholder, text, row_count) of each deck, in the deck's order.

    Groups are flattened; speaker notes are elements of type 'notes'.
    """
    kinds = {"sp": "shape", "pic": "image", "cxnSp": "shape", "graphicFrame": "frame"}

    def text_of(node: ElementTree.Element) -> str:
        return "\n".join("".join(t.text or "" for t in _below(p, "t")) for p in _below(node, "p"))

    def elements(tree: ElementTree.Element) -> Iterator[tuple]:
        for x in tree:
            name = _local(x.tag)
            if name == "grpSp":
                yield from elements(x)
            elif name in kinds:
                kind = kinds[name]
                if kind == "frame":
                    kind = "table" if _first(x, "tbl") is not None else "chart" if _first(x, "chart") is not None else "unsupported"
                elif kind == "shape" and _first(x, "txBody") is not None and text_of(x).strip():
                    kind = "text"
                label, holder = _first(x, "cNvPr"), _first(x, "ph")
                yield kind, None if label is None else label.get("name"), None if holder is None else holder.get("type") or "body", text_of(x), sum(1 for _ in _below(x, "tr"))

    def read(z: zipfile.ZipFile) -> Iterator[tuple]:
        if "ppt/presentation.xml" not in z.namelist():
            return
        targets = {r[1]: r[2] for r in _relations(z, "ppt/presentation.xml")}
        parts = [targets.get(_relation(s)) for s in _below(_tree(z, "ppt/presentation.xml"), "sldId")]
        for i, part in enumerate(parts, 1):
            if not _has(z, part):
                continue
            slide = _tree(z, part)
            hidden, at = slide.get("show") in ("0", "false"), 0
            for row in elements(_first(slide, "spTree")):
                yield i, hidden, at, *row
                at += 1
            for _, _, target, kind in _relations(z, part):
                if kind == "notesSlide" and _has(z, target):
                    body = [x for x in elements(_first(_tree(z, target), "spTree")) if x[2] == "body"]
                    yield i, hidden, at, "notes", None, "body", "\n".join(x[3] for x in body), 0
                    at += 1

    return _rows(files, read, "slide_index int, hidden boolean, ord int, type string, name string, placeholder string, text string, row_count int")


def chart_points(files: DataFrame) -> DataFrame:
    """(file_id, part, type, series, series_name, idx, category, value, x) of the cached points of all charts.

    Indexes are kept; a point that is no number has a null value.
    """

    def points(node: ElementTree.Element | None) -> dict[int, str]:
        return {} if node is None else {int(p.get("idx")): (v.text or "") for p in _below(node, "pt") for v in _below(p, "v")}

    def number(text: str | None) -> float | None:
        try:
            return float(text) if text else None
        except ValueError:
            return None

    def read(z: zipfile.ZipFile) -> Iterator[tuple]:
        for part in z.namelist():
            if re.search(r"charts/chart[0-9]*\.xml$", part):
                area = _first(_tree(z, part), "plotArea")
                plots = [p for p in area if _local(p.tag).endswith("Chart")] if area is not None else []
                series = [(_local(p.tag).removesuffix("Chart"), s) for p in plots for s in p if _local(s.tag) == "ser"]
                for i, (kind, s) in enumerate(series):
                    get = lambda name, s=s: next((c for c in s if _local(c.tag) == name), None)
                    name = points(get("tx")).get(0) or f"Series {i + 1}"
                    categories, values, xs = points(get("cat")), points(get("val") if get("val") is not None else get("yVal")), points(get("xVal"))
                    for k in sorted(values):
                        yield part, kind, i, name, k, categories.get(k), number(values[k]), number(xs.get(k))

    return _rows(files, read, "part string, type string, series int, series_name string, idx int, category string, value double, x double")
