"""File sources: the catalogue of types, extraction, and what is native about text, markup and OCR boxes."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import words
from corvane.sources.pdf import read_pdf

# File types by folder.
FOLDERS = {
    "pdf": "pdf",
    "word": "docx doc",
    "excel": "xlsx xls csv tsv",
    "powerpoint": "pptx ppt",
    "text": "txt md rst rtf html htm xml json yaml yml log ini cfg",
    "code": "py js ts jsx tsx java kt cpp c h hpp go rs rb php swift cs vb sql sh bash ps1 toml r scala",
    "image": "png jpg jpeg bmp tiff tif webp",
    "ebook": "epub",
    "audio": "mp3 wav m4a flac ogg wma aac",
    "video": "mp4 avi mkv mov wmv flv webm m4v",
}
# Fixed values end.
ENCODINGS = ("utf-8", "utf-16", "cp1252", "iso-8859-1", "ascii")
MOST_BYTES = 100 * 1024 * 1024


def catalogue(spark: SparkSession) -> DataFrame:
    """(extension, folder, category) of all supported types."""
    rows = [(e, folder, folder if folder in ("audio", "video") else "document") for folder, types in FOLDERS.items() for e in types.split()]
    return spark.createDataFrame(rows, "extension string, folder string, category string")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def _lookup(ext: Column, default: str, value: Callable[[str], str]) -> Column:
    pairs = [x for folder, types in FOLDERS.items() for e in types.split() for x in (F.lit(e), F.lit(value(folder)))]
    return F.coalesce(F.create_map(*pairs)[F.lower(F.ltrim(ext, F.lit(".")))], F.lit(default))


def folder(ext: Column) -> Column:
    return _lookup(ext, "other", lambda f: f)


def category(ext: Column) -> Column:
    """audio, video, document or unknown."""
    return _lookup(ext, "unknown", lambda f: f if f in ("audio", "video") else "document")


def extraction_type(ext: Column) -> Column:
    """indirect for audio, video and images, whose text a model reads; direct for the rest."""
    return F.when(folder(ext).isin("audio", "video", "image"), "indirect").otherwise("direct")


def scan_folder(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length, content, extension, folder, category, file_hash)."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    df = (r.option("pathGlobFilter", glob) if glob else r).load(path)
    ext = extension(F.col("path"))
    return df.withColumns({"extension": ext, "folder": folder(ext), "category": category(ext), "file_hash": F.md5("content")})


def validated(files_: DataFrame, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a reason): known extension, size within the limit. The limit is a filter on the file's length, which is read before its content."""
    reason = F.when(F.col("category") == "unknown", "unsupported type").when(F.col("length") > most_bytes, "too large")
    return files_.filter(reason.isNull()), files_.withColumn("reason", reason).filter("reason is not null")


def strip_markup(html: Column) -> Column:
    """Text of a page: without scripts, styles and tags, white space as one space."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"[ \t\n\r\f]+", " "))


def decode_bytes(raw: bytes) -> tuple[str, str]:
    """(text, encoding): the first encoding that reads the bytes, else UTF-8 with replacements. UTF-16 needs its mark."""
    for e in ENCODINGS:
        if e == "utf-16" and raw[:2] not in (b"\xff\xfe", b"\xfe\xff"):
            continue
        try:
            return raw.decode(e), e
        except UnicodeError:
            pass
    return raw.decode("utf-8", "replace"), "utf-8"


def _xml_text(node, tag: str) -> str:
    return "".join(x.text or "" for x in node.iter() if x.tag.endswith("}" + tag))


def read_docx(raw: bytes) -> list[str]:
    """Paragraphs, headings marked by #, then tables."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))
    out, tables = [], []
    for p in body.iter():
        if p.tag.endswith("}tbl"):
            tables.append("\n".join(" | ".join(_xml_text(c, "t").strip() for c in r if c.tag.endswith("}tc")) for r in p.iter() if r.tag.endswith("}tr")))
    inside = {id(p) for t in body.iter() if t.tag.endswith("}tbl") for p in t.iter()}
    for p in body.iter():
        if p.tag.endswith("}p") and id(p) not in inside and _xml_text(p, "t").strip():
            style = next((v for s in p.iter() if s.tag.endswith("}pStyle") for k, v in s.attrib.items() if k.endswith("}val")), "")
            level = re.fullmatch(r"(?i)heading\s*(\d)", style)
            out.append(("#" * int(level[1]) + " " if level else "") + _xml_text(p, "t").strip())
    return out + [f"[Table {i}]\n{t}" for i, t in enumerate(tables, 1)]


def read_pptx(raw: bytes) -> list[str]:
    """One text for each slide, with its notes."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    number = lambda n: int(re.search(r"(\d+)\.xml$", n)[1])
    out = []
    for n in sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number):
        root = ElementTree.fromstring(z.read(n))
        lines = [_xml_text(p, "t").strip() for p in root.iter() if p.tag.endswith("}p")]
        notes = f"ppt/notesSlides/notesSlide{number(n)}.xml"
        if notes in z.namelist():
            said = " ".join(_xml_text(p, "t").strip() for p in ElementTree.fromstring(z.read(notes)).iter() if p.tag.endswith("}p")).strip()
            lines += [f"[Speaker Notes] {said}"] if said else []
        out.append("\n".join(x for x in lines if x))
    return out


def sheet_text(rows: list[list[str]], most_rows: int | None = None) -> str:
    """Header, a rule of 50 dashes, then the rows, cells joined by " | "; empty rows go. With ``most_rows``, a last line says how many more there are."""
    kept = [r for r in rows if any(c.strip() for c in r)]
    shown = kept if most_rows is None else kept[: most_rows + 1]
    more = [f"[{len(kept) - len(shown)} more rows]"] if len(shown) < len(kept) else []
    return "\n".join([" | ".join(shown[0]), "-" * 50, *(" | ".join(r) for r in shown[1:]), *more]) if shown else ""


def _column(reference: str, default: int) -> int:
    """Number of a cell's column, from 0: of B7 it is 1."""
    letters = re.match(r"[A-Z]+", reference)
    out = 0
    for c in letters[0] if letters else "":
        out = out * 26 + ord(c) - 64
    return out - 1 if letters else default


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, file) of the sheets in the workbook's order; sheets that it does not list follow by number."""
    files_ = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml$", n)[1]))
    if not {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= set(z.namelist()):
        return [("", n) for n in files_]
    target = {r.attrib["Id"]: "xl/" + r.attrib["Target"].removeprefix("/xl/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")) if "Id" in r.attrib}
    listed = [(s.attrib.get("name", ""), target.get(next((v for k, v in s.attrib.items() if k.endswith("}id")), ""), "")) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if s.tag.endswith("}sheet")]
    listed = [(name, n) for name, n in listed if n in files_]
    return listed + [("", n) for n in files_ if n not in {n for _, n in listed}]


def read_xlsx(raw: bytes) -> list[str]:
    """One text for each sheet, in the workbook's order; cells stand in the columns that their references name."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    shared = [_xml_text(s, "t") for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    out = []
    for _, n in _sheets(z):
        rows = []
        for r in (x for x in ElementTree.fromstring(z.read(n)).iter() if x.tag.endswith("}row")):
            cells: list[str] = []
            for c in (x for x in r if x.tag.endswith("}c")):
                v = _xml_text(c, "v") or _xml_text(c, "t")
                at = _column(c.attrib.get("r", ""), len(cells))
                cells += [""] * (at + 1 - len(cells))
                cells[at] = shared[int(v)] if c.attrib.get("t") == "s" and v else v
            rows.append(cells)
        out.append(sheet_text(rows))
    return out


def read_text(raw: bytes) -> list[str]:
    return [decode_bytes(raw)[0]]


def read_table(sep: str) -> Callable[[bytes], list[str]]:
    return lambda raw: [sheet_text(list(csv.reader(io.StringIO(decode_bytes(raw)[0]), delimiter=sep)))]


#: Extractors by extension: bytes to parts. Users add their own; images and speech need a model (:func:`register_model_extractor`) and have none here.
EXTRACTORS: dict[str, Callable[[bytes], list[str]]] = {e: read_text for f in ("text", "code") for e in FOLDERS[f].split()} | {"csv": read_table(","), "tsv": read_table("\t"), "docx": read_docx, "pptx": read_pptx, "xlsx": read_xlsx, "pdf": read_pdf}


def register_extractor(ext: str, f: Callable[[bytes], list[str]]) -> None:
    EXTRACTORS[ext.lower().lstrip(".")] = f


def register_model_extractor(model, kind: str) -> None:
    """Make a provider the extractor of all image types (``recognise(bytes)`` to boxes with text and confidence) or of all audio and video types (``transcribe(bytes)`` to segments with start, end and text)."""

    def boxes(raw: bytes) -> list[str]:
        return ["\n".join(b["text"] for b in model.recognise(raw) if b.get("confidence", 1.0) >= 0.5)]

    def speech(raw: bytes) -> list[str]:
        stamp = lambda s: f"{int(s) // 60:02d}:{int(s) % 60:02d}"
        return ["\n".join(f"[{stamp(s['start'])} - {stamp(s['end'])}] {s['text']}" for s in model.transcribe(raw)["segments"])]

    for f in {"image": ("image",), "speech": ("audio", "video")}[kind]:
        for ext in FOLDERS[f].split():
            EXTRACTORS[ext] = boxes if kind == "image" else speech


def extract(files_: DataFrame) -> DataFrame:
    """(path, extension, file_hash, extraction_type, parts, content, success, error, lines, words, chars): a failed file is a row, not a failed job."""
    extractors = dict(EXTRACTORS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts, errors = [], []
            for e, raw in zip(pdf["extension"], pdf["content"]):
                try:
                    parts.append(extractors[e](raw))
                    errors.append(None)
                except KeyError:
                    parts.append([])
                    errors.append(f"no extractor for {e}")
                except Exception as x:  # noqa: BLE001  whatever a broken file raises belongs in its row
                    parts.append([])
                    errors.append(f"{type(x).__name__}: {x}")
            yield pd.DataFrame({"path": pdf["path"], "extension": pdf["extension"], "file_hash": pdf["file_hash"], "parts": parts, "error": errors})

    out = files_.select("path", "extension", "file_hash", "content").mapInPandas(run, "path string, extension string, file_hash string, parts array<string>, error string")
    text = F.array_join("parts", "\n\n")
    return out.withColumns({"content": text, "success": F.col("error").isNull(), "extraction_type": extraction_type(F.col("extension")), "lines": F.size(F.split(text, "\n", -1)).cast("long"), "words": F.size(words(text)).cast("long"), "chars": F.length(text).cast("long")})


def classify_page(text_chars: Column, image_width: Column, image_height: Column, drawings: Column) -> Column:
    """text, scan, mixed or empty, of a PDF page by its text length, largest image and number of drawings."""
    text, image = text_chars >= 50, (image_width >= 50) & (image_height >= 50)
    return F.when(text & ~image, "text").when(text & image, "mixed").when(~text & (image | (drawings > 20)), "scan").otherwise("empty")


def merge_page(text_blocks: DataFrame, images: DataFrame, page: str = "page") -> DataFrame:
    """(page, content): text blocks and recognised images from top to bottom, without tiny, extreme or overlapping images.

    Both tables hold page, box (x0, y0, x1, y1) and text.
    """
    from corvane.operators.registry import bbox_overlap

    w, h = F.col("box.x1") - F.col("box.x0"), F.col("box.y1") - F.col("box.y0")
    good = images.filter((w >= 50) & (h >= 50) & (w / h <= 20) & (w / h >= 0.05))
    t = text_blocks.select(F.col(page).alias("__p"), F.col("box").alias("__tb"))
    free = good.join(t, (F.col(page) == F.col("__p")) & (bbox_overlap(F.col("box"), F.col("__tb")) > 0.5), "left_anti")
    both = text_blocks.select(page, "box", "text").unionByName(free.select(page, "box", "text"))
    return both.groupBy(page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("box.y0").alias("y"), F.col("box.x0").alias("x"), "text"))), lambda b: b["text"]), "\n\n").alias("content"))


def ocr_summary(boxes: DataFrame, least: float = 0.5, page: str = "page") -> DataFrame:
    """(page, n, kept, mean_confidence): boxes of at least that confidence; a page without any has 0."""
    ok = F.col("confidence") >= least
    return boxes.groupBy(page).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("kept"), F.round(F.coalesce(F.avg(F.when(ok, F.col("confidence"))), F.lit(0.0)), 6).alias("mean_confidence"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet in its own folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def import_snapshot(spark: SparkSession, path: str, names: list[str], into: dict[str, DataFrame] | None = None, key: str = "id") -> dict[str, DataFrame]:
    """Read a snapshot; with ``into``, merge: imported rows win."""
    from corvane.operators.registry import upsert

    got = {n: spark.read.parquet(f"{path}/{n}") for n in names}
    return {n: upsert(into[n], df, key) if into and n in into else df for n, df in got.items()}


def read_squad(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(id, query, context_id, context, ground_truth_answer): articles, paragraphs and questions flattened; first answer, else first plausible one; questions without either go."""
    answer = "array<struct<text:string,answer_start:int>>"
    schema = f"data array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<id:string,question:string,answers:{answer},plausible_answers:{answer}>>>>>>"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path)
    q = rows.select(F.explode("data").alias("a")).select("a.title", F.posexplode("a.paragraphs").alias("p", "par")).select("title", "p", "par.context", F.explode("par.qas").alias("q"))
    first = F.coalesce(F.try_element_at("q.answers", F.lit(1))["text"], F.try_element_at("q.plausible_answers", F.lit(1))["text"])
    out = q.select("q.id", F.col("q.question").alias("query"), F.concat_ws("_", "title", F.col("p").cast("string")).alias("context_id"), "context", first.alias("ground_truth_answer")).filter("query <> '' and context <> '' and ground_truth_answer <> ''")
    return out.orderBy("id").limit(most) if most else out


def load_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("chunk_id string, text string, embedding array<double>").json(path)


def parse_json_column(c: Column, schema: str) -> Column:
    return F.from_json(c, schema)


def canonical_json(row: dict) -> str:
    return json.dumps(row, sort_keys=True, ensure_ascii=False)
