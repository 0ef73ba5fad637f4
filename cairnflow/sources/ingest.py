"""Directory ingest: files to text, text to chunks, chunks to observation rows."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cairnflow.functions import exprs as X, word_lists as W

#: Characters that paragraphs are packed to, words below which a chunk is dropped.
CHUNK_TARGET, MIN_WORDS = 2000, 50


def read_files(spark: SparkSession, path: str, known: DataFrame | None = None, exclude: tuple[str, ...] = tuple(W.IGNORED_PATHS)) -> DataFrame:
    """``path, length, content`` of the files of a folder that are worth reading.

    Excluded and sensitive paths, empty files, binary files without an extractor and known
    paths are dropped by path before any content is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    p = F.col("path")
    ext = F.lower(F.element_at(F.split(p, r"\."), -1))
    keep = ~X.excluded_path(p, list(exclude)) & ~X.sensitive_file(p) & (F.col("length") > 0)
    keep &= ext.isin(list(EXTRACTORS)) | ~X.binary_file(p)
    files = files.filter(keep).select("path", "length", "content")
    return files if known is None else files.join(known.select("path"), "path", "left_anti")


def _xml_texts(data: bytes, paragraph: str, run: str) -> list[str]:
    out = []
    for node in ElementTree.fromstring(data).iter():
        if node.tag.rsplit("}", 1)[-1] == paragraph:
            text = "".join(t.text or "" for t in node.iter() if t.tag.rsplit("}", 1)[-1] == run) if run else "".join(node.itertext())
            if text.strip():
                out.append(text.strip())
    return out


def pack(paragraphs: list[str], target: int = CHUNK_TARGET) -> list[str]:
    """Greedy packing of paragraphs, joined by line breaks, up to about ``target`` characters."""
    out, size = [], 0
    for p in paragraphs:
        if out and size + len(p) + 1 <= target:
            out[-1] += "\n" + p
            size += len(p) + 1
        else:
            out.append(p)
            size = len(p)
    return out


def docx(data: bytes) -> list[tuple[int, str]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [(0, c) for c in pack(_xml_texts(z.read("word/document.xml"), "p", "t"))]


def pptx(data: bytes) -> list[tuple[int, str]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        texts = [(k, "\n".join(_xml_texts(z.read(n), "p", "t"))) for k, n in slides]
    return [(k, t) for k, t in texts if t]


def odt(data: bytes) -> list[tuple[int, str]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        xml = z.read("content.xml")
    texts = [
        "".join(n.itertext()).strip()
        for n in ElementTree.fromstring(xml).iter()
        if n.tag.rsplit("}", 1)[-1] in ("p", "h")
    ]
    return [(0, c) for c in pack([t for t in texts if t])]


_RTF = re.compile(r"\\'([0-9a-fA-F]{2})|\\u(-?\d+) ?\??|\\([a-zA-Z]+)(-?\d+)? ?|\\([^a-zA-Z])|([{}])|[\r\n]+|([^\\{}\r\n]+)")
_RTF_SILENT = frozenset("fonttbl colortbl stylesheet info pict header footer generator object themedata listtable".split())


def rtf(data: bytes) -> list[tuple[int, str]]:
    out: list[str] = []
    silent, stack = False, []
    for m in _RTF.finditer(data.decode("latin-1")):
        code, uni, word, _, symbol, brace, plain = m.groups()
        if brace == "{":
            stack.append(silent)
        elif brace == "}":
            silent = stack.pop() if stack else False
        elif word in _RTF_SILENT or symbol == "*":
            silent = True
        elif silent:
            continue
        elif code:
            out.append(bytes.fromhex(code).decode("cp1252", "replace"))
        elif uni:
            out.append(chr(int(uni) % 65536))
        elif word in ("par", "line", "page"):
            out.append("\n")
        elif word == "tab":
            out.append("\t")
        elif symbol:
            out.append({"~": " "}.get(symbol, symbol if symbol in "\\{}" else ""))
        elif plain:
            out.append(plain)
    return [(0, c) for c in pack([p.strip() for p in "".join(out).split("\n") if p.strip()])]


_PDF_STRING = re.compile(rb"\(((?:\\.|[^\\()])*)\)|<([0-9A-Fa-f\s]+)>")
_PDF_SHOW = re.compile(rb"\[((?:\\.|[^\]])*)\]\s*TJ|(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]+>)\s*(?:Tj|'|\")|(T\*|Td|TD|ET)")
_PDF_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_text(stream: bytes) -> str:
    def string(m) -> str:
        if m[2]:
            raw = bytes.fromhex(re.sub(rb"\s", b"", m[2]).decode().ljust(2, "0"))
        else:
            raw = re.sub(rb"\\([0-7]{1,3}|.)", lambda e: bytes([int(e[1], 8) % 256]) if e[1][:1].isdigit() else _PDF_ESCAPES.get(e[1], e[1]), m[1])
        return raw.decode("utf-16-be" if raw[:2] == b"\xfe\xff" else "cp1252", "replace")

    out = []
    for m in _PDF_SHOW.finditer(stream):
        if m[3]:
            out.append("\n")
        else:
            out += [string(s) for s in _PDF_STRING.finditer(m[1] if m[1] is not None else m[2])]
    return re.sub(r"\n{2,}", "\n", "".join(out)).strip()


def pdf(data: bytes) -> list[tuple[int, str]]:
    """Text of the content streams (plain or deflated) with simple encodings, one page per stream."""
    pages = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S):
        body = m[1]
        try:
            body = zlib.decompress(body)
        except zlib.error:
            pass
        if text := _pdf_text(body):
            pages.append((len(pages) + 1, text))
    return pages


def plain(data: bytes) -> list[tuple[int, str]]:
    text = data.decode("utf-8", "replace")
    return [(0, text)] if text.strip() else []


EXTRACTORS = {"docx": docx, "pptx": pptx, "odt": odt, "rtf": rtf, "pdf": pdf}


def extract(files: DataFrame, most: int | None = None) -> DataFrame:
    """``path, chunk, page, text, error, cut``: the chunks of every file, numbered from 1.

    A file that cannot be read gives one row with its error and no text; the others go on.  With ``most`` a chunk keeps so
    many characters and ``cut`` says how many it lost; without, every text is whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf_ in batches:
            rows = []
            for path, data in zip(pdf_["path"], pdf_["content"]):
                f = EXTRACTORS.get(path.rsplit(".", 1)[-1].lower(), plain)
                try:
                    rows += [(path, k, page, text[:most], None, max(0, len(text) - len(text[:most]))) for k, (page, text) in enumerate(f(bytes(data)), 1)]
                except Exception as e:  # noqa: BLE001 - any broken file
                    rows.append((path, 0, 0, None, f"{type(e).__name__}: {e}"[:200], 0))
            yield pd.DataFrame(rows, columns=["path", "chunk", "page", "text", "error", "cut"])

    return files.select("path", "content").mapInPandas(run, "path string, chunk int, page int, text string, error string, cut int")


def observation_rows(chunks: DataFrame, most: int | None = None) -> DataFrame:
    """``path, chunk, page, content``: chunk 0 with the whole text (its first ``most`` characters), then the chunks of enough words."""
    good = chunks.filter("text IS NOT NULL")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "text"))), lambda x: x["text"])
    whole = good.groupBy("path").agg((F.array_join(parts, "\n") if most is None else F.left(F.array_join(parts, "\n"), F.lit(most))).alias("content"), F.count(F.lit(1)).alias("n"))
    head = whole.select("path", F.lit(0).alias("chunk"), F.lit(0).alias("page"), "content")
    many = whole.filter("n > 1").select("path")
    rest = good.join(many, "path", "left_semi").filter(X.word_count(F.col("text")) >= MIN_WORDS)
    return head.unionByName(rest.select("path", "chunk", "page", F.col("text").alias("content")))


def group_paragraphs(c: Column, target: int = CHUNK_TARGET) -> Column:
    """Paragraph array to packed chunks, in the JVM."""
    start = F.array().cast("array<string>")

    def step(acc, p):
        last = F.try_element_at(acc, F.lit(-1))
        fits = F.coalesce(F.length(last) + F.length(p) + 1 <= target, F.lit(False))
        n = F.size(acc)
        return F.when(
            fits, F.array_append(F.slice(acc, 1, F.greatest(n - 1, F.lit(0))), F.concat(last, F.lit("\n"), p))
        ).otherwise(F.array_append(acc, p))

    return F.aggregate(c, start, step)


def history_line(c: Column) -> Column:
    """A shell history line without its time prefix."""
    return F.regexp_replace(c, r"^: \d+:\d+;", "")
