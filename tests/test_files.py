"""Documents by a chain of readers, workbooks, named files, and snapshot tables."""

import io
import random
import zipfile

import pytest

from clauseworks.sources import files, snapshots, tables


def test_chain_takes_the_first_reader_with_enough_text(spark, tmp_path):
    long = "line one of the text é日\n" * 10
    made = {
        "a.pdf": files.made_document([long, "", "second"], True),
        "sub/b.PDF": files.made_document([long], False),
        "c.pdf": files.made_document(["x" * 100], True, b"IMG" + long.encode()),
        "d.pdf": files.made_document(["x" * 100], True),
        "e.pdf": b"not a document",
        "f.txt": b"text",
        "g.pdf": files.made_document(["y" * 101], True) + b" " * 5000,
        "h.pdf": b"%PDF\n<< /Filter /FlateDecode >>\nstream\nbroken\nendstream",
    }
    for name, content in made.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(content)
    recognise = lambda content: files.image_bytes(content)[3:].decode()  # noqa: E731  raises where there is no image
    got = {r.path.split("/in/")[1]: (r.raw_text, r.method, r.success, r.confidence, r.error) for r in files.read_documents(spark, f"file://{tmp_path}/in", [*files.READERS, ("recognition", "low", recognise)], largest=4000).collect()}
    assert got == {
        "a.pdf": (long.strip("\n") + "\nsecond", "packed pages", True, "high", None),
        "sub/b.PDF": (long.strip("\n") + "\n", "plain pages", True, "medium", None),
        "c.pdf": (long, "recognition", True, "low", None),
        "d.pdf": (None, None, False, None, "no text found"),
        "e.pdf": (None, None, False, None, "no text found"),
        "f.txt": (None, None, False, None, "unsupported"),
        "g.pdf": (None, None, False, None, "too large"),
        "h.pdf": (None, None, False, None, "no text found"),
    }


def test_unsupported_files_are_not_read(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes(b"t")
    plan = files.read_documents(spark, f"file://{tmp_path}", files.READERS)._jdf.queryExecution().toString()
    scans = [x for x in plan.splitlines() if "FileScan binaryFile" in x]
    assert len(scans) == 2 and sum("content" in x.split("Batched")[0] for x in scans) == 1


def test_no_job_lists_all_files(spark, sf, monkeypatch):
    """Files are dealt to folders that are read one after the other; all of them are read, each once."""
    from clauseworks.plans import jobs

    monkeypatch.setattr(files, "FILES_AT_ONCE", 70)
    listed, read = [], {"read_documents": files.read_documents, "read_workbooks": files.read_workbooks}

    def noted(name):
        def call(spark, place, *args, **more):
            listed.append(spark.read.format("binaryFile").load(place).count())
            return read[name](spark, place, *args, **more)

        return call

    for name in read:
        monkeypatch.setattr(files, name, noted(name))
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for query in (jobs.file_router, jobs.workbooks):
        listed.clear()
        out = query(spark, sf)
        assert out.select("doc_id").distinct().count() == n
        assert len(listed) == files.folders_for(n) > 1 and max(listed) <= 70 and sum(listed) == n


def test_workbooks_round_trip(spark, tmp_path):
    rows = [[None], ["Title", None, "x"], [], ["Requirement", "Standard", "", "Clause", "Requirement"], ["tab\there & <b> _x0041_ \x0b", "EN 1", "no name", 7, "second"], [None, True, 2.5, 7.0, None], ["last", "é日", None, "7.1(a)", None]]
    book = files.made_workbook([("Notes", [["a"]]), ("Main & co", rows), ("Empty", [])])
    (tmp_path / "one.xlsx").write_bytes(book)
    (tmp_path / "broken.XLSX").write_bytes(b"PK no")
    inline = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(book)) as old, zipfile.ZipFile(inline, "w") as new:
        for n in old.namelist():
            if n != "xl/sharedStrings.xml":
                new.writestr(n, old.read(n) if "sheet1" not in n else b'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c t="inlineStr"><is><t>in</t><t>line</t></is></c><c t="e"><v>#REF!</v></c><c t="str"><v>f</v></c></row></sheetData></worksheet>')
    (tmp_path / "inline.xlsx").write_bytes(inline.getvalue())
    where = f"file://{tmp_path}"
    name = lambda r: r.path.rsplit("/", 1)[1]
    first = sorted((name(r), r.sheet, r.row_no, r.cells, bool(r.error)) for r in files.read_workbooks(spark, where).collect())
    assert first == [("broken.XLSX", None, None, None, True), ("inline.xlsx", "Notes", 0, ["inline", None, "f"], False), ("one.xlsx", "Notes", 0, ["a"], False)]
    cells = files.read_workbooks(spark, f"{where}/one.xlsx", "Main & co")
    got = {r.row_no: r.cells for r in cells.collect()}
    assert got == {1: ["Title", None, "x"], 3: ["Requirement", "Standard", "", "Clause", "Requirement"], 4: ["tab\there & <b> _x0041_ \x0b", "EN 1", "no name", "7", "second"], 5: [None, "True", "2.5", "7"], 6: ["last", "é日", None, "7.1(a)"]}
    assert {(r.sheet, r.row_no) for r in files.read_workbooks(spark, f"{where}/one.xlsx", every=True).collect()} == {("Notes", 0)} | {("Main & co", i) for i in got}
    assert "no such sheet" in files.read_workbooks(spark, f"{where}/one.xlsx", "Other").first().error
    assert files.read_workbooks(spark, f"{where}/one.xlsx", largest=10).first().error == "too large"
    records = files.sheet_records(cells, "path", "sheet")
    named = records.select("row_no", *(files.named_column("values", t).alias(k) for k, t in zip("rsc", tables.SYNONYMS, strict=True))).orderBy("row_no").collect()
    assert [tuple(r) for r in named] == [(4, got[4][0], "EN 1", "7"), (5, None, "True", "7"), (6, "last", "é日", "7.1(a)")]


def table(spark, path):
    return snapshots.SnapshotTable(spark, f"file://{path}/table", "id string, n long")


def content(t, version=None):
    return {r.id: r.n for r in t.read(version).collect()}


def test_versions_upserts_deletions_and_undo(spark, tmp_path):
    t = table(spark, tmp_path)
    rows = lambda **kw: spark.createDataFrame(list(kw.items()), "id string, n long")
    assert content(t) == {} and not t.restore()
    states = [{}]
    rng = random.Random(1)
    for step in range(12):
        now = dict(states[-1])
        if step % 4 == 3:
            key = rng.choice(sorted(now))
            t.delete(rows(**{key: 0}).select("id"))
            del now[key]
        else:
            new = {rng.choice("abcdef"): step, rng.choice("abcdef"): step}
            t.upsert(rows(**new))
            now |= new
        states.append(now)
        assert content(t) == now and t.version() == step + 1
    assert content(t, 3) == states[3]
    for back in range(1, 6):
        assert t.restore() and content(t) == states[-1 - back]
    assert not t.restore() and content(t) == states[-6]
    assert t.vacuum() > 0 and content(t) == states[-6]


def test_writers_that_are_late_try_again(spark, tmp_path, monkeypatch):
    one, two = table(spark, tmp_path), table(spark, tmp_path)
    one.upsert(spark.createDataFrame([("a", 1)], "id string, n long"))
    real = one.publish
    beaten = []

    def late(after, state):
        if not beaten:
            beaten.append(two.upsert(spark.createDataFrame([("b", 2)], "id string, n long")))
        return real(after, state)

    monkeypatch.setattr(one, "publish", late)
    assert one.upsert(spark.createDataFrame([("c", 3)], "id string, n long")) == 3
    assert content(one) == {"a": 1, "b": 2, "c": 3}
    monkeypatch.setattr(one, "publish", lambda after, state: False)
    with pytest.raises(snapshots.Conflict):
        one.upsert(spark.createDataFrame([("d", 4)], "id string, n long"))
    assert content(two) == {"a": 1, "b": 2, "c": 3}


def test_a_change_that_fails_leaves_the_old_state(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(spark.createDataFrame([("a", 1)], "id string, n long"))
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        t.upsert(spark.range(10).selectExpr("cast(id as string) as id", "id div (id - 5) as n"))
    assert content(t) == {"a": 1} and t.version() == 1


def test_packed_pages_may_end_in_what_looks_like_a_line_break():
    texts = ["".join(random.Random(i).choices("abcdefgh é日", k=60)).strip() for i in range(3000)]
    made = {t: files.made_document([t, ""], True) for t in texts}
    assert sum(b"\r\nendstream" in x for x in made.values()) > 3
    assert all(files.packed_pages(x) == t for t, x in made.items())
    indirect = b"<< /Length 5 0 R >>\nstream\n(long enough) Tj\nendstream <</Length 3>> stream\n(wrong length) Tj\r\nendstream"
    assert files.plain_pages(indirect) == "long enough\nwrong length\n"
