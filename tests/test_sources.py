"""File layouts, written to a fresh folder per test."""

import zipfile
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyweave import schemas
from tallyweave.operators import enrich
from tallyweave.sources import delimited, documents, feeds, listing, orders


def put(folder, name, data, encoding="utf-8"):
    folder.mkdir(exist_ok=True)
    path = folder / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode(encoding))
    return str(path)


def dicts(df, *order):
    return [r.asDict() for r in df.orderBy(*order).collect()]


def test_list_inputs(spark, tmp_path):
    put(tmp_path, "b.csv", "x\n1")
    put(tmp_path, "a.csv", "x\n1")
    put(tmp_path, "~$a.csv", "junk")
    put(tmp_path, "c.xls", "junk")
    rows = listing.list_inputs(spark, str(tmp_path), "*.xls", "*.csv").collect()
    assert {(r.path.rsplit("/", 1)[-1], r.length) for r in rows} == {("c.xls", 4), ("a.csv", 3), ("b.csv", 3)}
    assert listing.list_inputs(spark, str(tmp_path / "none"), "*.csv").collect() == []
    assert listing.list_inputs(spark, str(tmp_path), "*.txt").collect() == []
    assert listing.Files.under(spark, str(tmp_path), "*.txt", required=False) is None
    with pytest.raises(FileNotFoundError):
        listing.Files.under(spark, str(tmp_path), "*.txt")


@pytest.mark.parametrize("header, delimiter", [
    ("a,b,c", ","), ("a;b;c", ";"), ("a\tb", "\t"), ('"x,y,z";b', ";"), ("single", ","),
])
def test_sniff(header, delimiter):
    assert delimited.sniff_delimiter(header) == delimiter


def test_scan_delimited_stacks_layouts(spark, tmp_path):
    put(tmp_path, "a.csv", '﻿Record Type,Amount,Metadata\nCB,"1,5","{""orderId"": ""7""}"\nNOC,2,\n')
    put(tmp_path, "b.csv", "Record Type;Amount;Extra\nCB;3;e\n")
    put(tmp_path, "c.csv", "Amount;Record Type;Extra\n4;NOC;f\n")
    put(tmp_path, "~$d.csv", "Record Type,Amount\nbad,bad\n")
    got = dicts(delimited.scan_delimited(spark, str(tmp_path), source_file="f"), "Amount")
    assert got == [
        {"Record Type": "CB", "Amount": "1,5", "Metadata": '{"orderId": "7"}', "Extra": None, "f": "a.csv"},
        {"Record Type": "NOC", "Amount": "2", "Metadata": None, "Extra": None, "f": "a.csv"},
        {"Record Type": "CB", "Amount": "3", "Metadata": None, "Extra": "e", "f": "b.csv"},
        {"Record Type": "NOC", "Amount": "4", "Metadata": None, "Extra": "f", "f": "c.csv"},
    ]


def test_scan_semicolon(spark, tmp_path):
    put(tmp_path, "bom.csv", b"\xef\xbb\xbf" + "PEDIDO;CIDADE;UF\n1-a;São José;SC\n2-b;x;y;z\n3-c;short\n".encode())
    put(tmp_path, "old.csv", "PEDIDO;CIDADE;UF\n4-d;Iça;RS\n5-e;\"a;b\";PR\n", "latin-1")
    put(tmp_path, "other.csv", "NUMERO;X\n9;9\n")
    got = dicts(delimited.scan_semicolon(spark, str(tmp_path), must_have="PEDIDO"), "PEDIDO")
    assert got == [
        {"PEDIDO": "1-a", "CIDADE": "São José", "UF": "SC"},
        {"PEDIDO": "3-c", "CIDADE": "short", "UF": None},
        {"PEDIDO": "4-d", "CIDADE": "Iça", "UF": "RS"},
        {"PEDIDO": "5-e", "CIDADE": "a;b", "UF": "PR"},
    ]


HTML = """<html><body><p>x</p><table border=1><tr><th>PEDIDO</th><th> STATUS DO
CHARGEBACK</th><th>UF</th></tr>
<tr><td>10-a</td><td>Fraude &amp; cia <b>ok</b></td><td>SC</td></tr>
<tr><td>11-b<td><table><tr><td>inner</td></tr></table></td><td></td></tr></table>
<table><tr><td>second</td></tr></table></body></html>"""


def test_scan_html_tables(spark, tmp_path):
    paths = [put(tmp_path, "r.xls", HTML),
             put(tmp_path, "s.xls", HTML.replace("UF", "CIDADE").replace("SC", "Itajaí"), "latin-1"),
             put(tmp_path, "t.xls", "PEDIDO;UF\n1;2")]
    got = dicts(documents.scan_html_tables(spark, paths, source_file="f"), "f", "PEDIDO")
    assert got == [
        {"PEDIDO": "10-a", "STATUS DO CHARGEBACK": "Fraude & cia ok", "UF": "SC", "CIDADE": None, "f": "r.xls"},
        {"PEDIDO": "11-b", "STATUS DO CHARGEBACK": "inner", "UF": None, "CIDADE": None, "f": "r.xls"},
        {"PEDIDO": "10-a", "STATUS DO CHARGEBACK": "Fraude & cia ok", "UF": None, "CIDADE": "Itajaí", "f": "s.xls"},
        {"PEDIDO": "11-b", "STATUS DO CHARGEBACK": "inner", "UF": None, "CIDADE": None, "f": "s.xls"},
    ]


def workbook(path, rows):
    """A minimal package: shared strings for text, plain values for numbers."""
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    shared, body = [], []
    for i, row in enumerate(rows, 1):
        cells = []
        for j, value in enumerate(row):
            ref = f"{chr(65 + j)}{i}"
            if isinstance(value, str):
                shared.append(value)
                cells.append(f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>')
            elif value is not None:
                cells.append(f'<c r="{ref}"><v>{value}</v></c>')
        body.append(f'<row r="{i}">{"".join(cells)}</row>')
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}">' + "".join(
            f"<si><r><t>{s[:2]}</t></r><r><t>{s[2:]}</t></r></si>" for s in shared) + "</sst>")
        book.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{ns}"><sheetData/></worksheet>')
        book.writestr("xl/worksheets/sheet1.xml",
                      f'<worksheet xmlns="{ns}"><sheetData>{"".join(body)}</sheetData></worksheet>')


def test_scan_workbooks(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", [["Denominação", "Data entrada", "Valor"], ["CHARGEBACK NSU", 45000, 12.5], ["x", None, 3]])
    bad = put(tmp_path, "b.xlsx", b"not a package")
    got = dicts(documents.scan_workbooks(spark, [str(tmp_path / "a.xlsx"), bad]), "Valor")
    assert got == [
        {"Denominação": "CHARGEBACK NSU", "Data entrada": "45000", "Valor": "12.5"},
        {"Denominação": "x", "Data entrada": None, "Valor": "3"},
    ]


REF = "ABCD1234EFGH5678"


def test_load_disputes(spark, tmp_path):
    put(tmp_path, "jan.csv", "Record Type,Psp Reference,Dispute Amount,Record Date,Metadata\n"
        'Chargeback,R1,10.50,2025-01-02,"{""orderId"":""7""}"\nSettled,R2,1,2025-01-03,\n')
    put(tmp_path, "feb.csv", "Record Type;Psp Reference;Dispute Amount;Record Date\n"
        "NotificationOfChargeback;R1;n/d;03/02/2025\nNotificationOfChargeback;R3;2;2025-02-04 10:00:00\n")
    got = dicts(feeds.load_disputes(spark, str(tmp_path)).drop("dispute_id", "metadata"), "record_date")
    assert got == [
        {"record_type": "Chargeback", "psp_reference": "R1", "dispute_amount": Decimal("10.50"),
         "record_date": datetime(2025, 1, 2), "source_file": "jan.csv", "vtex_order_id": "7"},
        {"record_type": "NotificationOfChargeback", "psp_reference": "R1", "dispute_amount": None,
         "record_date": datetime(2025, 2, 3), "source_file": "feb.csv", "vtex_order_id": None},
        {"record_type": "NotificationOfChargeback", "psp_reference": "R3", "dispute_amount": Decimal("2.00"),
         "record_date": datetime(2025, 2, 4, 10), "source_file": "feb.csv", "vtex_order_id": None},
    ]


def test_load_ledger(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", [["Denominação do objeto", "Denominação", "Data de lançamento", "Montante"],
                                   ["o", f"Chargeback NSU: {REF}-55", 45000, 7], ["o", "Pagamento", 45001, 8]])
    got = dicts(feeds.load_ledger(spark, str(tmp_path)), "ordinal")
    assert len(got) == 1
    assert {k: got[0][k] for k in ("psp_reference_sap", "nsu", "tipo", "data_lancamento_sap", "valor_sap")} == {
        "psp_reference_sap": REF, "nsu": "55", "tipo": "CHARGEBACK", "data_lancamento_sap": datetime(2023, 3, 15), "valor_sap": "7"}


def test_load_antifraud_keeps_the_last_report(spark, tmp_path):
    put(tmp_path, "b.xls", HTML)
    put(tmp_path, "c.xls", "PEDIDO;UF\n10-z;PR\n12-q;RS\n")
    put(tmp_path, "a.csv", "PEDIDO;UF\n11-k;AC\n12-r;AM\n")
    got = {r["vtex_order_id"]: (r["cs_pedido"], r["cs_uf"], r["source_file_cs"])
           for r in feeds.load_antifraud(spark, str(tmp_path)).collect()}
    assert got == {"10": ("10-z", "PR", "c.xls"), "11": ("11-k", "AC", "a.csv"), "12": ("12-r", "AM", "a.csv")}
    assert feeds.load_antifraud(spark, str(tmp_path / "none")) is None


def test_text_under_the_name_of_a_page_is_not_opened_whole(spark, tmp_path, monkeypatch):
    opened, scan = [], feeds.scan_html_tables

    def noted(spark, files, **names):
        opened.append(files)
        return scan(spark, files, **names)

    monkeypatch.setattr(feeds, "scan_html_tables", noted)
    put(tmp_path / "mixed", "a.xls", HTML.replace("<table", "<TABLE"))
    put(tmp_path / "mixed", "b.xls", "PEDIDO;UF\n10-z;a<b\n12-q;table\n")
    put(tmp_path / "mixed", "c.xls", b"PEDIDO;UF\n13-z;S\xe3o\n")
    put(tmp_path / "pages", "a.xls", HTML)
    put(tmp_path / "pages", "b.xls", HTML.replace("10-a", "14-a"), "latin-1")
    put(tmp_path / "pages", "empty.xls", "")
    put(tmp_path / "text", "a.xls", "PEDIDO;UF\n15-z;PR\n")
    got = {f: sorted(r["vtex_order_id"] for r in feeds.load_antifraud(spark, str(tmp_path / f)).collect())
           for f in ("mixed", "pages", "text")}
    assert got == {"mixed": ["10", "11", "12", "13"], "pages": ["10", "11", "14"], "text": ["15"]}
    mixed, pages, text = opened
    assert [p.rsplit("/", 1)[-1] for p in mixed.source] == ["a.xls"]
    assert pages == listing.Files.matching(str(tmp_path / "pages"), "*.xls") and text is None


def test_scan_order_export_and_collapse(spark, tmp_path):
    put(tmp_path, "o.csv", "﻿Order;Sequence;Creation Date;Total Value;UF;Other\n"
        "1-01;7;2026-04-20T10:00:00Z;10.5;;x\n1-01;8;2026-04-21T10:00:00Z;11;SC;y\n2-01;n/a;soon;z;PR;z\n")
    rows = orders.scan_order_export(spark, str(tmp_path))
    got = dicts(enrich.collapse_orders(rows, ["position"]), "order_id")
    assert got == [
        {"order_id": "1-01", "sequence": 7, "creation_date": datetime(2026, 4, 20, 10), "total_value": 10.5, "uf": "SC"},
        {"order_id": "2-01", "sequence": None, "creation_date": None, "total_value": None, "uf": "PR"},
    ]


def test_scan_cache(spark, tmp_path):
    assert orders.scan_cache(spark, str(tmp_path / "none")).schema == schemas.CACHE
    row = {f: None for f in schemas.CACHE.fieldNames()} | {"order_id": "1", "status": "not_found"}
    spark.createDataFrame([tuple(row.values())], schemas.CACHE).write.parquet(str(tmp_path / "c"))
    assert orders.scan_cache(spark, str(tmp_path / "c")).first().asDict() == row


def test_half_readable_workbook_adds_nothing(spark, tmp_path):
    rows = [["Denominação", "Valor"], *[[f"CHARGEBACK {i}", i] for i in range(100)]]
    workbook(tmp_path / "good.xlsx", rows)
    workbook(tmp_path / "bad.xlsx", rows)
    with zipfile.ZipFile(tmp_path / "bad.xlsx") as book:
        parts = {n: book.read(n) for n in book.namelist()}
    parts["xl/worksheets/sheet1.xml"] = parts["xl/worksheets/sheet1.xml"].replace(
        b'<c r="A50" t="s"><v>', b'<c r="A50" t="s"><v>9999')
    with zipfile.ZipFile(tmp_path / "bad.xlsx", "w") as book:
        for name, data in parts.items():
            book.writestr(name, data)
    paths = [str(tmp_path / n) for n in ("good.xlsx", "bad.xlsx")]
    assert documents.scan_workbooks(spark, paths).count() == 100
    skipped = documents.problems(documents.read_cells(spark, paths, documents.workbook_rows)).collect()
    assert [(r["path"].rsplit("/", 1)[-1], r["problem"][:10]) for r in skipped] == [("bad.xlsx", "IndexError")]


def test_ledger_headers_are_found_in_each_file(spark, tmp_path):
    other = "WXYZ1234EFGH5678"
    workbook(tmp_path / "a.xlsx", [["Denominação", "Data de lançamento", "Valor", "Extra"],
                                   [f"Chargeback NSU: {REF}-1", "31/01/2025", 1.5, "e"], ["x", None, 2, None]])
    workbook(tmp_path / "b.xlsx", [["Montante", "Denominação da conta", "Lançamento"],
                                   [2.5, f"CHARGEBACK NSU: {other}-2", 45000.25]])
    workbook(tmp_path / "c.xlsx", [["Something", "Else"], ["CHARGEBACK", 1]])
    got = dicts(feeds.load_ledger(spark, str(tmp_path)), "source_file")
    assert [(r["psp_reference_sap"], r["valor_sap"], r["valor_sap_numero"], r["data_lancamento_sap"], r["Extra"])
            for r in got] == [
        (REF, "1.5", Decimal("1.50"), datetime(2025, 1, 31), "e"),
        (other, "2.5", Decimal("2.50"), datetime(2023, 3, 15, 6), None),
    ]


def test_cells_shown_as_dates(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", [["Denominação", "Data entrada", "Valor"], ["CHARGEBACK", 45000.5, 45000]])
    with zipfile.ZipFile(tmp_path / "a.xlsx") as book:
        parts = {n: book.read(n) for n in book.namelist()}
    parts["xl/worksheets/sheet1.xml"] = parts["xl/worksheets/sheet1.xml"].replace(b'<c r="B2">', b'<c r="B2" s="1">')
    parts["xl/styles.xml"] = (
        b'<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
        b'<numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/></numFmts>'
        b'<cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>')
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as book:
        for name, data in parts.items():
            book.writestr(name, data)
    got = documents.scan_workbooks(spark, [str(tmp_path / "a.xlsx")]).first()
    assert (got["Data entrada"], got["Valor"]) == ("2023-03-15 12:00:00", "45000")


def test_antifraud_prefix_reaches_the_join(spark, tmp_path):
    put(tmp_path, "r.csv", "PEDIDO;STATUS DO CHARGEBACK\n7-1;ok\n")
    assert "clearsale_status_do_chargeback" in feeds.load_antifraud(spark, str(tmp_path), "clearsale_").columns


def test_quoted_line_breaks_keep_their_record(spark, tmp_path):
    put(tmp_path, "a.csv", "Record Type,Psp Reference,Dispute Amount,Dispute Reason,Record Date\n"
        'Chargeback,R1,1,"Fraud\nsecond line",2025-01-02\nChargeback,R2,1,plain,2025-01-03\n')
    put(tmp_path, "b.csv", "Record Type,Psp Reference,Dispute Amount,Dispute Reason,Record Date\nChargeback,R3,1,x,2025-01-04\n")
    got = {r["psp_reference"]: (r["dispute_reason"], r["record_date"]) for r in
           feeds.load_disputes(spark, str(tmp_path)).collect()}
    assert got == {"R1": ("Fraud\nsecond line", datetime(2025, 1, 2)), "R2": ("plain", datetime(2025, 1, 3)),
                   "R3": ("x", datetime(2025, 1, 4))}


def _jobs(spark, action):
    """Jobs that an action starts."""
    name = f"jobs {id(action)}"
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = action()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


HEAD = "Record Type,Psp Reference,Dispute Amount,Record Date,Payment Date,Dispute Reason"


def test_conventions_are_literals_of_their_files(spark, tmp_path):
    """Slashes count by file and column, whatever stands in other columns or between quotes."""
    put(tmp_path, "a.csv", f'{HEAD}\nChargeback,R1,1,02/03/2025,2025-04-05,"a/b, c/d"\nChargeback,R2,1,2025-01-02,2025-04-05,\n')
    put(tmp_path, "b.csv", f'{HEAD}\nChargeback,R3,1,2025-02-03,"04/05/2025",x/y\n')
    put(tmp_path, "c.csv", HEAD.replace(",", ";") + "\nChargeback;R4;1;2025-02-03;2025-04-05;n/a\n")
    put(tmp_path, "d.csv", f"{HEAD}\nChargeback,R5,1,03-04-2025,31.01.2025,5\" x 6\" / 2\n")
    rows, jobs = _jobs(spark, lambda: feeds.load_disputes(spark, str(tmp_path)))
    assert jobs <= 6  # three, and three for d.csv, whose quotes need a parser
    got = {r.psp_reference: (str(r.record_date)[:10], str(r.payment_date)[:10]) for r in rows.collect()}
    assert got == {"R1": ("2025-03-02", "2025-04-05"), "R2": ("2025-01-02", "2025-04-05"),
                   "R3": ("2025-02-03", "2025-05-04"), "R4": ("2025-02-03", "2025-04-05"),
                   "R5": ("2025-03-04", "2025-01-31")}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_alike_files_are_read_by_folder(spark, tmp_path):
    for i in range(30):
        put(tmp_path, f"f{i:02}.csv", f"{HEAD}\nChargeback,R{i},1,2025-01-02,2025-01-03,x\n")
    put(tmp_path, "~$f.csv", "junk")
    layouts, jobs = _jobs(spark, lambda: delimited.read_layouts(spark, listing.Files.matching(str(tmp_path), "f*.csv")))
    assert jobs <= 3
    assert list(layouts.values()) == [listing.Files(str(tmp_path), "f*.csv")]
    assert feeds.load_disputes(spark, str(tmp_path)).count() == 30


def test_slashes_within_quoted_line_breaks(spark, tmp_path):
    """A date behind a value with a line break is found by parsing the file."""
    put(tmp_path, "a.csv", f'{HEAD.replace("Dispute Reason", "Extra")},Dispute Reason\nChargeback,R1,1,"x\ny",01/02/2025,e,r\n'
        'Chargeback,R2,1,2025-01-02,2025-01-03,"two\nlines",r\n')
    put(tmp_path, "b.csv", f"{HEAD}\nChargeback,R3,1,2025-01-02,2025-01-03,r\n")
    got = {r.psp_reference: str(r.payment_date)[:10] for r in feeds.load_disputes(spark, str(tmp_path)).collect()}
    assert got == {"R1": "2025-02-01", "R2": "2025-01-03", "R3": "2025-01-03"}


def test_report_pages_stay_in_their_tasks(spark, tmp_path):
    """A page on one line is no header, whatever separators it holds."""
    put(tmp_path, "a.xls", "<html>&nbsp;PEDIDO;x;" + HTML.replace("\n", " "))
    put(tmp_path, "b.csv", "PEDIDO;UF\n20-k;AC\n")
    found = delimited.read_layouts(spark, listing.Files.matching(str(tmp_path), "*.xls", "*.csv"), ";", True, must_have="UF")
    assert [layout.header for layout in found] == ["PEDIDO;UF"]
    got = {r["vtex_order_id"]: r["source_file_cs"] for r in feeds.load_antifraud(spark, str(tmp_path)).collect()}
    assert got["20"] == "b.csv" and got["10"] == "a.xls"


def test_absent_and_empty_folders(spark, tmp_path):
    (tmp_path / "none").mkdir()
    for folder in ("none", "absent"):
        with pytest.raises(FileNotFoundError):
            feeds.load_disputes(spark, str(tmp_path / folder))
        with pytest.raises(FileNotFoundError):
            feeds.load_ledger(spark, str(tmp_path / folder))
        assert feeds.load_antifraud(spark, str(tmp_path / folder)) is None


def test_workbook_rows_are_streamed(tmp_path):
    """A long sheet is checked to its end first and then handed on batch by batch."""
    import tracemalloc

    import pandas as pd

    path = tmp_path / "long.xlsx"
    rows = 60_000
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book, book.open("xl/worksheets/sheet1.xml", "w") as sheet:
        sheet.write(f'<worksheet xmlns="{ns}"><sheetData>'.encode())
        for i in range(rows):
            sheet.write(f'<row r="{i + 1}"><c r="A{i + 1}" t="inlineStr"><is><t>CHARGEBACK {i}</t></is></c>'
                        f'<c r="B{i + 1}"><v>{i}</v></c></row>'.encode())
        sheet.write(b"</sheetData></worksheet>")
    batch = pd.DataFrame([(str(path), path.read_bytes())], columns=["path", "content"])
    tracemalloc.start()
    sizes, last = [], None
    for part in documents._cells_of(documents.workbook_rows)(iter([batch])):
        sizes.append(len(part))
        last = part.iloc[-1]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes == [documents.BATCH_ROWS] * 6 and last["row_no"] == rows - 1
    assert last["header"] == ["CHARGEBACK 0", "0"] and last["cells"] == [f"CHARGEBACK {rows - 1}", str(rows - 1)]
    assert peak < 30e6  # all rows take over 60 MB


def test_a_file_within_a_batch_is_read_once(monkeypatch):
    """Longer ones are read to their end first; one that cannot be gives its reason alone."""
    import pandas as pd
    monkeypatch.setattr(documents, "BATCH_ROWS", 3)
    read = []

    def reader(content):
        read.append(content)
        for i in range(int(content)):
            if i == 6:
                raise documents.Unreadable("six")
            yield [f"c{i}"]

    def cells(n):
        read.clear()
        batch = pd.DataFrame([("f", str(n).encode())], columns=["path", "content"])
        parts = list(documents._cells_of(reader)(iter([batch])))
        return len(read), [tuple(r) for p in parts for r in p[["row_no", "header", "cells", "problem"]].itertuples(index=False)]

    for n, times in ((0, 1), (1, 1), (4, 1), (5, 2)):
        assert cells(n) == (times, [(i, ["c0"], [f"c{i}"], None) for i in range(n)])
    assert cells(8) == (1, [(0, None, None, "six")])


def test_slashes_are_noted_from_the_marks_of_a_line(spark):
    lines = {"a,1/2/3,b": (",", {1}), 'a,"x,/y,",/': (",", {1, 2}), '"a,b",c/': (",", {1}), "a;b/c;;/": (";", {1, 3}),
             "a/b,c": ("|", {0}), "plain,line": (",", set()), ",".join(["x"] * 62 + ["/", "/"]): (",", {62})}
    rows = spark.createDataFrame([(v, d) for v, (d, _) in lines.items()], "v string, d string")
    marked = rows.select("v", "d", delimited._marks(F.col("v")).alias("m"))
    notes = [F.when(F.col("d") == d, delimited._slashes(F.col("m"), d)) for d in delimited.DELIMITERS]
    for r in marked.select("v", "m", F.coalesce(*notes).alias("bits")).collect():
        assert {i for i in range(64) if r.bits >> i & 1} == lines[r.v][1]
        assert r.m is None or not set(r.m) - set("/,;")
