import io
import zipfile
import zlib

from pyspark.sql import functions as F

from cairnflow.sources import backup, ingest


def archive(files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, t in files.items():
            z.writestr(n, t)
    return b.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
O = 'xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'  # noqa: E741
FILES = {
    "a.docx": archive({"word/document.xml": f"<w:d {W}><w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>world</w:t></w:r></w:p><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:d>"}),
    "b.pptx": archive({f"ppt/slides/slide{k}.xml": f"<a:s {A}><a:p><a:r><a:t>Slide {k}</a:t></a:r></a:p></a:s>" for k in (1, 2, 10)}),
    "c.odt": archive({"content.xml": f"<o {O}><text:h>Head</text:h><text:p>Body <text:span>x</text:span></text:p></o>"}),
    "d.rtf": "{BSrtf1{BSfonttbl{BSf0 Arial;}}CafBS'e9 BSb boldBSb0BSpar next {BS*BSgenerator x}BSu8364? end}".replace("BS", chr(92)).encode(),
    "e.pdf": b"%PDF-1.4\n1 0 obj<</Length 9>>\nstream\n" + zlib.compress(b"BT (Hello \\(pdf\\)) Tj 0 -12 Td [(Se) -20 (cond)] TJ ET") + b"\nendstream\nendobj",
    "f.txt": b"plain text",
    "broken.docx": b"no archive",
    "empty.txt": b"",
    ".env": b"x=1",
    "g.png": b"\x89PNG",
}


def test_ingest(spark, tmp_path):
    for n, b in FILES.items():
        (tmp_path / n).write_bytes(b)
    files = ingest.read_files(spark, str(tmp_path))
    rows = ingest.extract(files).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.chunk):
        got.setdefault(r.path.rsplit("/", 1)[-1], []).append((r.page, r.text, r.error is not None))
    assert got == {
        "a.docx": [(0, "Hello world\nTwo", False)], "b.pptx": [(1, "Slide 1", False), (2, "Slide 2", False), (10, "Slide 10", False)],
        "c.odt": [(0, "Head\nBody x", False)], "d.rtf": [(0, "Café bold\nnext € end", False)], "e.pdf": [(1, "Hello (pdf)\nSecond", False)],
        "f.txt": [(0, "plain text", False)], "broken.docx": [(0, None, True)],
    }
    obs = ingest.observation_rows(ingest.extract(files)).collect()
    assert {r.path.rsplit("/", 1)[-1]: r.content for r in obs}["b.pptx"] == "Slide 1\nSlide 2\nSlide 10" and all(r.chunk == 0 for r in obs)
    known = files.filter(F.col("path").contains("f.txt"))
    assert ingest.read_files(spark, str(tmp_path), known).count() == files.count() - 1


def test_packing_is_the_same_in_both_forms(spark):
    paragraphs = ["a" * 900, "b" * 900, "c" * 900, "d" * 3000, "e"]
    df = spark.createDataFrame([(paragraphs,)], "p array<string>")
    assert df.select(ingest.group_paragraphs(F.col("p"))).first()[0] == ingest.pack(paragraphs)


def test_backup(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    assert {tuple(r) for r in backup.export_json({"t": df}, str(tmp_path)).collect()} == {("t", 2)}
    now = spark.createDataFrame([("a", 9)], "id string, v int")
    assert {tuple(r) for r in backup.import_json(spark, str(tmp_path), "t", now, ["id"]).collect()} == {("a", 9), ("b", 2)}
    assert backup.import_json(spark, str(tmp_path), "t", now, ["id"], "replace").count() == 2
    assert backup.versions_to_drop(["3", "1", "2"], 2) == ["1"]


def test_token_shards(spark, tmp_path):
    ids = [k * 37 % 65_536 for k in range(1000)]
    df = spark.createDataFrame(list(enumerate(ids)), "position long, token int")
    backup.write_token_shards(df, f"{tmp_path}/s", 300)
    got = backup.read_token_shards(spark, f"{tmp_path}/s").orderBy("shard").collect()
    assert [len(r.ids) for r in got] == [300, 300, 300, 100] and [x for r in got for x in r.ids] == ids
