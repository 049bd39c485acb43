"""Sources on small files: XML exports, spreadsheets, dictionaries, CSV uploads, the batch stream."""

import zipfile

import pytest
from pyspark.sql import functions as F

from nomenclia.sources import catalog_xml, csv_lines, supplier_xlsx
from nomenclia.streaming import batches

XML = """<?xml version="1.0" encoding="UTF-8"?>
<export xmlns="urn:catalogue:export">{}</export>"""
POSITION = """<position><data><code>{code}</code><name>  Стул   ученический </name><status>{status}</status><version>2</version><isTemplate>false</isTemplate>
<OKPD2><code>31.01</code><name>Мебель</name></OKPD2><applicationDateStart>2020-01-02T03:04:05+03:00</applicationDateStart>
<rubricators><rubricatorInfo><name>А</name></rubricatorInfo><rubricatorInfo><name>Б</name></rubricatorInfo></rubricators>
<OKEIs><OKEI><code>796</code><name>Штука</name></OKEI></OKEIs>
<characteristics>
<characteristic><code>c1</code><name>Тип каркаса</name><actual>true</actual><isRequired>true</isRequired><type>1</type><kind>1</kind><choiceType>1</choiceType>
<values><value><qualityDescription>Деревянный</qualityDescription></value><value><qualityDescription>Металлический</qualityDescription></value></values></characteristic>
<characteristic><code>c2</code><name>Высота</name><actual>true</actual><isRequired>false</isRequired><type>2</type><kind>2</kind><choiceType>1</choiceType>
<values><value><OKEI><code>003</code><name>Миллиметр</name></OKEI><rangeSet><valueRange><min>300</min><max>400,5</max><minMathNotation>greaterOrEqual</minMathNotation><maxMathNotation>less</maxMathNotation></valueRange>
<valueRange><min>9</min><max>1</max></valueRange></rangeSet><valueSet><concreteValue>5.50</concreteValue><concreteValue>x</concreteValue></valueSet></value></values></characteristic>
<characteristic><code>c3</code><name>Старое</name><actual>false</actual></characteristic>
</characteristics></data></position>"""


def test_catalog_xml(spark, tmp_path):
    (tmp_path / "nsiKTRUNew_all_1_actual.xml").write_text(XML.format(POSITION.format(code="A-1", status="ACTIVE") + POSITION.format(code="A-2", status="CANCELLED")), encoding="utf-8")
    (tmp_path / "nsiKTRUNew_all_2_actual.xml").write_text(XML.format(POSITION.format(code="A-1", status="ACTIVE")), encoding="utf-8")
    (tmp_path / "nsiKTRUNew_all_3_not-actual.xml").write_text(XML.format(POSITION.format(code="A-9", status="ACTIVE")), encoding="utf-8")
    tables = catalog_xml.ingest(spark, str(tmp_path), str(tmp_path / "tables"))
    p = tables["positions"].collect()
    assert [(r.code, r.name, r.okpd2_name, r.rubricators, r.version) for r in p] == [("A-1", "Стул ученический", "Мебель", "А; Б", 2)]
    assert str(p[0].start) == "2020-01-02 03:04:05"
    assert sorted(r.name for r in tables["characteristics"].collect()) == ["Высота", "Тип каркаса"]
    values = {r.label: r for r in tables["values"].collect()}
    assert set(values) == {"Деревянный", "Металлический", "≥ 300 и < 400.5 Миллиметр", "≥ 9 и ≤ 1 Миллиметр", "5.5 Миллиметр"}
    backwards = values["≥ 9 и ≤ 1 Миллиметр"]
    assert backwards.reversed and backwards.lower is None and backwards.upper is None
    assert (values["≥ 300 и < 400.5 Миллиметр"].lower_inc, values["≥ 300 и < 400.5 Миллиметр"].upper_inc) == (True, False)
    assert sorted(r.key for r in tables["okei"].collect()) == ["003", "796"]
    assert catalog_xml.current(spark, str(tmp_path / "tables"))["options"].count() == 5


def xlsx(path, rows):
    cells = lambda n, row: "".join(f'<c r="{chr(65 + k)}{n}" t="inlineStr"><is><t>{v}</t></is></c>' for k, v in enumerate(row) if v is not None)
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>' + "".join(f'<row r="{n}">{cells(n, r)}</row>' for n, r in enumerate(rows, 1)) + "</sheetData></worksheet>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="s" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)


def test_supplier(spark, tmp_path):
    xlsx(tmp_path / "a.xlsx", [["шум"], ["Конечная категория ПП", "Название характеристики", "Тип характеристики", "Единица измерения"], ["Стулья", "Длина", "Число", "мм."], ["Стулья", "ДЛИНА", "Число", "мм"], ["Стулья", "Вес", "Число", "ведро"], [None, "Без категории", "Число", None]])
    (tmp_path / "map.txt").write_text("# единицы\nмм (миллиметр; мм.)\nкг\n", encoding="utf-8")
    (tmp_path / "bad.txt").write_text("ведро\n", encoding="utf-8")
    rows = supplier_xlsx.read_supplier(spark, str(tmp_path))
    units = supplier_xlsx.units_map(spark, str(tmp_path / "map.txt")), supplier_xlsx.forbidden_units(spark, str(tmp_path / "bad.txt"))
    got = sorted((r.category, r.name, r.unit) for r in supplier_xlsx.deduplicated(supplier_xlsx.unify(rows, *units)).collect())
    assert got == [("Стулья", "Вес", None), ("Стулья", "Длина", "мм")]
    ids = []
    for _ in range(2):
        table = supplier_xlsx.ingest_supplier(spark, str(tmp_path), str(tmp_path / "map.txt"), str(tmp_path / "bad.txt"), str(tmp_path / "supplier"))
        assert sorted((r.category, r.name, r.unit) for r in table.collect()) == got
        ids.append(sorted(r.id for r in table.collect()))
    assert ids[0] == ids[1] and len(set(ids[0])) == 2
    assert [r.name for r in supplier_xlsx.strict_rows(rows, *units).collect()] == ["Длина", "ДЛИНА"]


def test_csv():
    assert csv_lines.descriptions_of('Описание\n"Стул ученический, деревянный"\nМолоток масса 0,5 кг, сталь\n\nБрюки\n'.encode()) == ["Стул ученический, деревянный", "Молоток масса 0,5 кг, сталь", "Брюки"]
    assert len(csv_lines.descriptions_of("Стол письменный;\nКресло офисное;\n".encode("cp1251"))) == 2
    with pytest.raises(ValueError):
        csv_lines.descriptions_of(b"  \n")


def test_batches_resume(spark, tmp_path):
    uploads, target = tmp_path / "in", str(tmp_path / "out")
    uploads.mkdir()
    (uploads / "a.csv").write_text("Описание\nСтул ученический\n12345\n", encoding="utf-8")
    (uploads / "empty.csv").write_text(" \n", encoding="utf-8")
    analyze = lambda df: df.select("id", F.lit("resolved").alias("status"), F.upper("text").alias("code"), F.array(F.lit("x")).alias("remaining"))
    for _ in range(2):  # the second run finds nothing new
        batches.run_batches(spark, str(uploads), target, analyze).awaitTermination()
    items = [(r.row_number, r.status, r.code) for r in batches.batch_items(spark, target).collect()]
    assert items == [(1, "done", "СТУЛ УЧЕНИЧЕСКИЙ"), (2, "error", None)]
    states = {r.path.rsplit("/", 1)[1]: (r.status, r.processed, r.percent) for r in batches.batch_status(spark, target).collect()}
    assert states == {"a.csv": ("done", 2, 100.0), "empty.csv": ("error", 0, None)}
    assert batches.unfinished(spark, target).isEmpty()


def test_batches_isolate_a_failing_row(spark, tmp_path):
    uploads, target = tmp_path / "in", str(tmp_path / "out")
    uploads.mkdir()
    (uploads / "a.csv").write_text("Описание\nСтул ученический\nМолоток сломанный\nСтол письменный\n", encoding="utf-8")
    checked = F.when(F.contains("text", F.lit("слом")), F.raise_error(F.lit("broken")).cast("string")).otherwise(F.upper("text"))
    analyze = lambda df: df.select("id", F.lit("resolved").alias("status"), checked.alias("code"), F.array(F.lit("x")).alias("remaining"))
    batches.run_batches(spark, str(uploads), target, analyze).awaitTermination()
    assert [(r.row_number, r.status, r.code, r.error) for r in batches.batch_items(spark, target).collect()] == [(1, "done", "СТУЛ УЧЕНИЧЕСКИЙ", None), (2, "error", None, "the analysis failed"), (3, "done", "СТОЛ ПИСЬМЕННЫЙ", None)]
    assert [r.status for r in batches.batch_status(spark, target).collect()] == ["done"]
    assert {r.status for r in spark.read.parquet(f"{target}/states").collect()} == {"pending", "processing", "done"}
    assert {r.status for r in spark.read.parquet(f"{target}/items").collect()} == {"pending", "processing", "done", "error"}


def test_states_of_a_run_that_stops(spark, tmp_path):
    """What a stopped run leaves is processing; a snapshot and the log after it are one state; a row is found in either."""
    uploads, target = tmp_path / "in", str(tmp_path / "out")
    uploads.mkdir()
    ok = lambda df: df.select("id", F.lit("resolved").alias("status"), F.upper("text").alias("code"), F.array(F.lit("x")).alias("remaining"))

    def broken(df):
        raise RuntimeError("stopped")

    def run(analyze):
        batches.run_batches(spark, str(uploads), target, analyze).awaitTermination()

    rows = lambda: [(r.path.rsplit("/", 1)[1], r.row_number, r.status) for r in batches.batch_items(spark, target).collect()]
    assert rows() == [] and batches.compact(spark, target) == {"items": 0, "states": 0}
    (uploads / "a.csv").write_text("Описание\nСтул\nСтол\n", encoding="utf-8")
    run(ok)
    assert batches.compact(spark, target) == {"items": 2, "states": 1}
    first = rows()
    assert first == [("a.csv", 1, "done"), ("a.csv", 2, "done")]
    (uploads / "b'1.csv").write_text("Описание\nШкаф\nПолка\n", encoding="utf-8")
    with pytest.raises(Exception, match="stopped"):
        run(broken)
    assert rows() == first + [("b'1.csv", 1, "processing"), ("b'1.csv", 2, "processing")]
    assert batches.pending_items(spark, target).count() == 2 and batches.unfinished(spark, target).count() == 1
    assert batches.compact(spark, target) == {"items": 4, "states": 2}
    run(ok)  # the batch is run again
    assert rows() == first + [("b'1.csv", 1, "done"), ("b'1.csv", 2, "done")] and batches.unfinished(spark, target).isEmpty()
    path = next(r.path for r in batches.batch_status(spark, target).collect() if "b'1" in r.path)
    for _ in range(2):
        found = batches.item(spark, target, path, 2).collect()
        assert [(r.description, r.status, r.code) for r in found] == [("Полка", "done", "ПОЛКА")]
        assert batches.compact(spark, target) == {"items": 4, "states": 2}
    assert batches.item(spark, target, path, 9).isEmpty()


def test_legacy(spark, tmp_path):
    from nomenclia.sources import legacy

    prefixed = XML.format(POSITION.format(code="A-1", status="ACTIVE")).replace("<position>", "<ns:position>").replace("</position>", "</ns:position>")
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        z.writestr("inner/a.xml", prefixed)
        z.writestr("readme.txt", "x")
    (tmp_path / "b.xml").write_text(XML.format(POSITION.format(code="B-1", status="ACTIVE") + POSITION.format(code="B-2", status="OLD")), encoding="utf-8")
    for raw, code in ((legacy.positions_of(legacy.zipped_xml(spark, str(tmp_path))), "A-1"), (legacy.read_xml(spark, str(tmp_path)), "B-1")):
        rows = legacy.json_catalog(raw).collect()
        assert [r.ktru_code for r in rows] == [code]
        value = rows[0].characteristics[1]["values"][0]
        assert (value.id, value.is_range, value.range.max_value, value.is_quality) == ("c2-v0", True, 400.5, False)
    legacy.write_json(legacy.json_catalog(legacy.read_xml(spark, str(tmp_path))), str(tmp_path / "json"))
    names = spark.createDataFrame([("Стул ученический",), ("Стол",)], "name string")
    target = spark.createDataFrame([("стул",)], "target string")
    assert legacy.name_filter(names, target).count() == 0 and legacy.name_filter(names, target, "contains").count() == 1
    xlsx(tmp_path / "t.xlsx", [["x"], ["Категория", "Название", "Единица измерения (ОКЕИ)"], ["Стулья", "Длина", "мм"], ["Категория", "Название"]])
    got = legacy.read_sheets(spark, str(tmp_path), {"category": "категория", "name": "название", "unit": "единица измерения"}).collect()
    assert sorted((r.category, r.name, r.unit) for r in got) == [("Категория", "Название", None), ("Стулья", "Длина", "мм")]


def test_sheets_in_order(spark, tmp_path):
    """Two sheets, shared and rich strings, cells without a reference, a number, and a second header row."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="b" sheetId="1" r:id="rB"/><sheet name="a" sheetId="2" r:id="rA"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rA" Target="/xl/worksheets/s1.xml"/><Relationship Id="rB" Target="worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst {ns}><si><t>Конечная категория ПП</t></si><si><r><t>Название </t></r><r><t xml:space="preserve">характеристики</t></r></si><si><t>Стулья</t></si></sst>')
        z.writestr("xl/worksheets/s2.xml", f'<worksheet {ns}><sheetData><row><c t="s"><v>0</v></c><c t="s"><v>1</v></c></row><row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2"><v>12</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet {ns}><sheetData><row><c r="AA1" t="s"><v>2</v></c><c r="B1" t="inlineStr"><is><t>Вес</t></is></c></row><row><c r="AA2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row><row><c r="AA3" t="s"><v>2</v></c><c r="C3" t="inlineStr"><is><t> Цвет </t></is></c></row></sheetData></worksheet>')
    got = supplier_xlsx.read_supplier(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.category, r.name) for r in got] == [("Стулья", "12"), ("Стулья", "Цвет")]
