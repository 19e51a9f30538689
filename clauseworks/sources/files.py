"""Binary files as rows: documents by a chain of readers, workbooks by sheet, and a sink that names its files.

Files are listed and read by Spark's binaryFile source, so they may lie in any store, are packed into
partitions by size, and what a path or length rules out is never read.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree.ElementTree import iterparse
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from clauseworks.runtime import materialize, small_batches

Reader = tuple[str, str, Callable[[bytes], str | None]]

#: Bytes of the largest file that a task takes; larger ones give an error row.
LARGEST = 1 << 30
#: Rows of a workbook that leave a task at a time.
ROWS_AT_ONCE = 5000
#: Files that a job lists at once, and the tasks that read them.
FILES_AT_ONCE, TASKS_AT_ONCE = 50_000, 64

_STREAM = re.compile(rb"<<([^<>]*)>>\s*stream\r?\n")
_LENGTH = re.compile(rb"/Length\s+(\d+)(?!\d|\s+\d+\s+R)")
_END, _FOUND_END = re.compile(rb"\s*endstream"), re.compile(rb"\r?\nendstream")
_SHOWN = re.compile(rb"<([0-9A-Fa-f\s]*)>\s*Tj|\(((?:\\.|[^\\()])*)\)\s*Tj|(T\*|Td|TD|')")


def _page(content: bytes) -> str:
    """The text that a page's content shows, a line for each move to the next."""
    out = [""]
    for hexed, literal, move in _SHOWN.findall(content):
        if move:
            out.append("")
        elif literal:
            out[-1] += re.sub(rb"\\(.)", rb"\1", literal).decode("latin-1")
        else:
            raw = bytes.fromhex(hexed.decode())
            out[-1] += raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")
    return "\n".join(out).strip("\n")


def _bodies(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(head, body) of the streams. A body has the length that its head gives, since its last bytes may look like a line break; where none fits, it ends at the next end."""
    at = 0
    while m := _STREAM.search(content, at):
        given = _LENGTH.search(m[1])
        stop = m.end() + int(given[1]) if given else -1
        if stop < 0 or not _END.match(content, stop):
            end = _FOUND_END.search(content, m.end())
            if not end:
                return
            stop = end.start()
        yield m[1], content[m.end() : stop]
        at = stop


def _streams(content: bytes, packed: bool) -> list[bytes]:
    found = [(b"/FlateDecode" in head, body) for head, body in _bodies(content) if b"/Image" not in head]
    return [zlib.decompress(body) if is_packed else body for is_packed, body in found if is_packed == packed]


def packed_pages(content: bytes) -> str | None:
    """S3: the text of a document's compressed pages; empty pages are left out, the others joined by line breaks."""
    return "\n".join(x for x in map(_page, _streams(content, True)) if x) or None


def plain_pages(content: bytes) -> str | None:
    """The text of its pages that aren't compressed, each followed by a line break."""
    return "".join(_page(x) + "\n" for x in _streams(content, False)) or None


#: The chain of readers that need no more than Python; recognition of images is for the caller to add.
READERS: list[Reader] = [("packed pages", "high", packed_pages), ("plain pages", "medium", plain_pages)]


def made_document(pages: list[str], packed: bool, image: bytes = b"") -> bytes:
    """A small document of the kind that the readers read: a content stream for each page, and an image."""
    out = [b"%PDF-1.4"]
    for i, text in enumerate(pages):
        shown = b"\n".join(b"<FEFF" + line.encode("utf-16-be").hex().upper().encode() + b"> Tj T*" for line in text.split("\n"))
        body = zlib.compress(shown) if packed else shown
        out.append(b"%d 0 obj\n<< /Length %d%s >>\nstream\n" % (i + 1, len(body), b" /Filter /FlateDecode" if packed else b"") + body + b"\nendstream\nendobj")
    if image:
        out.append(b"%d 0 obj\n<< /Subtype /Image /Length %d >>\nstream\n" % (len(pages) + 1, len(image)) + image + b"\nendstream\nendobj")
    return b"\n".join([*out, b"%%EOF"])


def image_bytes(content: bytes) -> bytes | None:
    """The first image of a document, as a recogniser is given it."""
    return next((body for head, body in _bodies(content) if b"/Image" in head), None)


def _files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (read.option("pathGlobFilter", glob) if glob else read).load(path)


def _dealt(rows: DataFrame, tasks: int | None) -> DataFrame:
    return rows.coalesce(tasks) if tasks else rows


def folders_for(n_files: int) -> int:
    """How many folders so many files are dealt to, so that the driver can list one at a time."""
    return max(1, -(-n_files // FILES_AT_ONCE))


def by_folder(read: Callable[[str], DataFrame], spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows that read() gives for each folder in path, one after the other and each written, so that the driver never holds the list of all files."""
    store, base = fs.FileSystem.from_uri(path)
    places = sorted(x.base_name for x in store.get_file_info(fs.FileSelector(base, allow_not_found=True)) if x.type == fs.FileType.Directory)
    out = None
    for place in places:
        part = materialize(read(f"{path}/{place}"), name)
        out = part if out is None else out.unionByName(part)
    return read(path) if out is None else out


def read_documents(spark: SparkSession, path: str, readers: list[Reader], least: int = 100, largest: int = LARGEST, tasks: int | None = None) -> DataFrame:
    """(path, raw_text, method, success, confidence, error) for every file under path.

    Documents (.pdf, whatever the case) are given to the readers in turn; the first whose text has more than
    `least` characters without its outer blanks is taken. A reader that raises counts as silent; if all
    are, the row says so. Other files are unsupported and larger ones than `largest` too large; neither
    is read. A file is one row, and its partition is decided by size; Spark makes a partition of a few small files, of which
    there are `tasks` at most.
    """
    is_document = F.lower("path").endswith(".pdf")
    names = ["path", "raw_text", "method", "success", "confidence", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw, row = content.as_py(), (name, None, None, False, None, "no text found")
                for method, confidence, reader in readers:
                    try:
                        text = reader(raw)
                    except Exception:  # noqa: BLE001  readers are foreign code; the next one has its turn
                        text = None
                    if text and len(text.strip()) > least:
                        row = (name, text, method, True, confidence, None)
                        break
                kinds = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)

    schema = "path string, raw_text string, method string, success boolean, confidence string, error string"
    documents = _files(spark, path, "*.[pP][dD][fF]")
    read = _dealt(documents.where(F.col("length") <= largest).select("path", "content"), tasks).mapInArrow(run, schema)
    others = _dealt(_files(spark, path).select("path", "length").where(~is_document | (F.col("length") > largest)), tasks)
    error = F.when(is_document, "too large").otherwise("unsupported")
    nothing = F.lit(None).cast("string")
    return read.unionByName(others.select("path", nothing.alias("raw_text"), nothing.alias("method"), F.lit(False).alias("success"), nothing.alias("confidence"), error.alias("error")))


# --- workbooks -------------------------------------------------------------------------

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_CONTROL = re.compile("[\x00-\x08\x0b-\x1f]|_x(?=[0-9A-F]{4}_)")
_ESCAPED = re.compile("_x([0-9A-F]{4})_")


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _texts(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, e in iterparse(f):
            if e.tag == f"{_MAIN}si":
                out.append(_plain("".join(t.text or "" for t in e.iter(f"{_MAIN}t"))))
                e.clear()
    return out


def _plain(text: str) -> str:
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), text)


def sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, member) of the sheets in their order."""
    with book.open("xl/_rels/workbook.xml.rels") as f:
        targets = {e.get("Id"): e.get("Target") for _, e in iterparse(f) if e.tag.endswith("}Relationship")}
    with book.open("xl/workbook.xml") as f:
        found = [(e.get("name"), targets[e.get(_LINK)]) for _, e in iterparse(f) if e.tag == f"{_MAIN}sheet"]
    return [(name, t.lstrip("/") if t.startswith("/") else f"xl/{t}") for name, t in found]


def _value(cell, texts: list[str]) -> str | None:
    kind, v = cell.get("t"), cell.find(f"{_MAIN}v")
    if kind == "inlineStr":
        return _plain("".join(t.text or "" for t in cell.iter(f"{_MAIN}t")))
    if v is None or v.text is None or kind == "e":
        return None
    if kind == "s":
        return texts[int(v.text)]
    if kind == "b":
        return "True" if v.text == "1" else "False"
    if kind == "str":
        return _plain(v.text)
    return str(int(float(v.text))) if re.fullmatch(r"-?\d+(\.0*)?", v.text) else v.text


def sheet_rows(book: zipfile.ZipFile, member: str, texts: list[str]) -> Iterator[tuple[int, list[str | None]]]:
    """(row_no from 0, cells) of the rows that a sheet has, one at a time; rows without cells aren't stored."""
    at = 0
    with book.open(member) as f:
        for _, e in iterparse(f):
            if e.tag != f"{_MAIN}row":
                continue
            at = int(e.get("r", at + 1))
            cells: list[str | None] = []
            for c in e.findall(f"{_MAIN}c"):
                i = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (i + 1 - len(cells))
                cells[i] = _value(c, texts)
            yield at - 1, cells
            e.clear()


def read_workbooks(spark: SparkSession, path: str, sheet: str | None = None, every: bool = False, largest: int = LARGEST, tasks: int | None = None) -> DataFrame:
    """(path, sheet, row_no, cells, error) of the workbooks (.xlsx) under path: of the sheet named, else of the first, or of every one.

    Cells are strings as a reader of text would take them (whole numbers without a point, True and
    False, null for errors and for cells without a value; dates are their serial numbers). Rows leave one
    part at a time, so a sheet of any length takes little memory. A file that can't be read, that
    lacks the sheet or is too large gives one row with an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["path", "sheet", "row_no", "cells", "error"])

        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held: list[tuple] = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py())) as book:
                        there = sheets(book)
                        chosen = there if every else [s for s in there if s[0] == sheet] if sheet else there[:1]
                        if not chosen:
                            raise ValueError("no such sheet")
                        texts = _texts(book)
                        for title, member in chosen:
                            for row_no, cells in sheet_rows(book, member, texts):
                                held.append((name, title, row_no, cells, None))
                                if len(held) >= ROWS_AT_ONCE:
                                    yield batch(held)
                                    held = []
                except Exception as e:  # noqa: BLE001  a broken file is a row, not the end of the job
                    held.append((name, None, None, None, f"{type(e).__name__}: {e}"))
                if held:
                    yield batch(held)

    schema = "path string, sheet string, row_no long, cells array<string>, error string"
    books = _files(spark, path, "*.[xX][lL][sS][xX]")
    read = _dealt(books.where(F.col("length") <= largest).select("path", "content"), tasks).mapInArrow(run, schema)
    large = _dealt(books.select("path", "length").where(F.col("length") > largest), tasks)
    null = F.lit(None)
    return read.unionByName(large.select("path", null.cast("string").alias("sheet"), null.cast("long").alias("row_no"), null.cast("array<string>").alias("cells"), F.lit("too large").alias("error")))


def made_workbook(pages: list[tuple[str, list[list[object]]]]) -> bytes:
    """A workbook of sheets (name, rows of cells: texts, numbers, booleans or nothing); texts are shared, empty rows aren't stored."""
    texts: dict[str, int] = {}
    out = io.BytesIO()
    safe = lambda t: escape(_CONTROL.sub(lambda m: "_x005F_x" if m[0] == "_x" else f"_x{ord(m[0]):04X}_", t))

    def cell(r: int, c: int, x: object) -> str:
        name = ""
        n = c + 1
        while n:
            n, k = divmod(n - 1, 26)
            name = chr(65 + k) + name
        if isinstance(x, bool):
            return f'<c r="{name}{r}" t="b"><v>{int(x)}</v></c>'
        if isinstance(x, int | float):
            return f'<c r="{name}{r}"><v>{x}</v></c>'
        return f'<c r="{name}{r}" t="s"><v>{texts.setdefault(str(x), len(texts))}</v></c>'

    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for i, (_, rows) in enumerate(pages, 1):
            body = "".join(f'<row r="{r}">' + "".join(cell(r, c, x) for c, x in enumerate(row) if x is not None) + "</row>" for r, row in enumerate(rows, 1) if any(x is not None for x in row))
            book.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>{body}</sheetData></worksheet>')
        names = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, (n, _) in enumerate(pages, 1))
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_LINK[1:-3]}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{_LINK[1:-3]}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(pages) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{_MAIN[1:-1]}">' + "".join(f'<si><t xml:space="preserve">{safe(t)}</t></si>' for t in texts) + "</sst>")
    return out.getvalue()


def sheet_records(cells: DataFrame, *by: str) -> DataFrame:
    """(by, row_no, values) of sheets (by, row_no, cells): values maps the names in the header row to a row's cells.

    The header is the first of the first ten rows that names a column, else the first row; what stands
    above it is left out, and so are cells under no name. Of columns of one name the first counts.
    """
    from clauseworks.sources.tables import header_row

    headers = header_row(cells, *by)
    names = cells.join(headers, list(by)).where("row_no = header").select(*by, "header", F.col("cells").alias("names"))
    rows = cells.join(names, list(by)).where("row_no > header")
    given = F.filter(F.arrays_zip("names", "cells"), lambda x: x["names"].isNotNull() & (x["names"] != ""))
    first = F.filter(given, lambda x, i: F.array_position(F.transform(given, lambda y: y["names"]), x["names"]) == i + 1)
    return rows.select(*by, "row_no", F.map_from_entries(F.transform(first, lambda x: F.struct(x["names"], x["cells"]))).alias("values"))


def named_column(values: str, target: str) -> F.Column:
    """The value of a column by its name, else by the first of its synonyms that the header has."""
    from clauseworks.sources.tables import SYNONYMS

    names = F.map_keys(values)
    chosen = F.coalesce(*(F.when(F.array_contains(names, n), F.lit(n)) for n in [target, *SYNONYMS[target]]))
    return F.element_at(values, chosen)


# --- a sink that names its files -----------------------------------------------------------


class NamedFiles(DataSource):
    """format("namedFiles"): writes rows (name, content) as files of these names under path; a name may begin with folders.

    Each file is written under a name of its own and then moved, so a task that is run again replaces
    whole files by equal ones.
    """

    @classmethod
    def name(cls) -> str:
        return "namedFiles"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _NamedWriter(self.options["path"])


class _NamedWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, base = fs.FileSystem.from_uri(self.path)
        store.create_dir(base, recursive=True)
        there = {""}
        for b in iterator:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                inner = name.rpartition("/")[0]
                if inner not in there:
                    store.create_dir(f"{base}/{inner}", recursive=True)
                    there.add(inner)
                own = f"{base}/_{uuid.uuid4().hex}"
                with store.open_output_stream(own, compression=None) as f:
                    f.write(content.as_py())
                store.move(own, f"{base}/{name}")
        return WriterCommitMessage()


def write_named(rows: DataFrame, path: str) -> None:
    """Write rows (name, content) as files."""
    small_batches(rows.sparkSession)
    rows.sparkSession.dataSource.register(NamedFiles)
    rows.select("name", F.col("content").cast("binary")).write.format("namedFiles").mode("append").save(path)
