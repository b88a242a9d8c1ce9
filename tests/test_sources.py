import io
import json
import sys

import zipfile


from pyspark import cloudpickle
from pyspark.sql import functions as F

from corvane import cache, providers
from corvane.plans import rag
from corvane.session import Settings
from corvane.sources import files, transcripts
from corvane.streaming import ingest

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def zipped(**parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/"), text)
    return b.getvalue()


W = 'xmlns:w="http://w"'


def test_office_files():
    doc = f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    assert files.read_docx(zipped(**{"word__document.xml": doc})) == ["## Title", "Text", "[Table 1]\na | b"]
    sheet = '<s xmlns="http://m"><row><c t="s"><v>0</v></c><c><v>2</v></c></row><row><c/><c/></row><row><c><v>3</v></c><c><v>4</v></c></row></s>'
    shared = '<sst xmlns="http://m"><si><t>head</t></si></sst>'
    assert files.read_xlsx(zipped(**{"xl__worksheets__sheet1.xml": sheet, "xl__sharedStrings.xml": shared})) == ["head | 2\n" + "-" * 50 + "\n3 | 4"]
    slide = '<p xmlns:a="http://a"><a:p><a:t>Slide</a:t></a:p></p>'
    assert files.read_pptx(zipped(**{"ppt__slides__slide1.xml": slide, "ppt__notesSlides__notesSlide1.xml": slide})) == ["Slide\n[Speaker Notes] Slide"]


def test_scan_extract_and_validate(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("xin chào\nhai".encode())
    (tmp_path / "sub" / "b.csv").write_text("x,y\n1,2\n")
    (tmp_path / "c.docx").write_bytes(b"broken")
    (tmp_path / "d.weird").write_bytes(b"?")
    (tmp_path / "e.md").write_bytes("é".encode("cp1252"))
    scanned = files.scan_folder(spark, str(tmp_path))
    ok, bad = files.validated(scanned)
    assert [r.reason for r in bad.collect()] == ["unsupported type"] and files.validated(scanned, 3)[1].filter("reason = 'too large'").count() > 0
    got = {r.extension: r for r in files.extract(ok).collect()}
    assert (got["txt"].lines, got["txt"].words, got["txt"].success) == (2, 3, True) and got["csv"].content == "x | y\n" + "-" * 50 + "\n1 | 2"
    assert not got["docx"].success and "BadZipFile" in got["docx"].error and got["md"].content == "é"


def test_catalogue(spark):
    c = files.catalogue(spark)
    assert c.count() == c.select("extension").distinct().count() and dict(c.groupBy("category").count().collect())["video"] == 8
    df = spark.createDataFrame([("x/a.MP3",), ("b.pdf",), ("c",), ("d.R",)], "p string")
    e = files.extension(F.col("p"))
    assert [tuple(r) for r in df.select(files.category(e), files.folder(e), files.extraction_type(e)).collect()] == [("audio", "audio", "indirect"), ("document", "pdf", "direct"), ("unknown", "other", "direct"), ("document", "code", "direct")]


def test_page_classes_and_merge(spark):
    df = spark.createDataFrame([(60, 0, 0, 0), (0, 60, 60, 0), (60, 60, 60, 0), (0, 0, 0, 30), (0, 0, 0, 3)], "t int, w int, h int, d int")
    assert [r[0] for r in df.select(files.classify_page(*[F.col(c) for c in "twhd"])).collect()] == ["text", "scan", "mixed", "scan", "empty"]
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    t = spark.createDataFrame([(1, (0.0, 0.0, 100.0, 100.0), "top")], f"page int, box {box}, text string")
    i = spark.createDataFrame([(1, (0.0, 0.0, 90.0, 90.0), "inside"), (1, (0.0, 200.0, 100.0, 300.0), "below"), (1, (0.0, 0.0, 5.0, 5.0), "tiny")], f"page int, box {box}, text string")
    assert files.merge_page(t, i).first().content == "top\n\nbelow"


def test_squad(spark, tmp_path):
    qa = {"id": "1", "question": "Q?", "answers": [{"text": "A", "answer_start": 0}], "plausible_answers": []}
    qb = {"id": "2", "question": "R?", "answers": [], "plausible_answers": [{"text": "B", "answer_start": 0}]}
    qc = {"id": "3", "question": "S?", "answers": [], "plausible_answers": []}
    (tmp_path / "s.json").write_text(json.dumps({"data": [{"title": "T", "paragraphs": [{"context": "C", "qas": [qa, qb, qc]}]}]}))
    got = files.read_squad(spark, str(tmp_path / "s.json"))
    assert [(r.id, r.ground_truth_answer, r.context_id) for r in got.orderBy("id").collect()] == [("1", "A", "T_0"), ("2", "B", "T_0")] and files.read_squad(spark, str(tmp_path / "s.json"), 1).count() == 1


def test_transcripts(spark, tmp_path):
    seg = [{"id": 0, "start": 0.0, "end": 61.5, "text": " hi ", "duration": 61.5, "words": []}]
    (tmp_path / "t.json").write_text(json.dumps({"audio_filename": "a.mp3", "full_text": "hi", "segments": seg}))
    df = transcripts.read_transcripts(spark, str(tmp_path / "t.json"))
    assert df.select(transcripts.srt(F.col("segments"))).first()[0] == "1\n00:00:00,000 --> 00:01:01,500\nhi\n"


def test_snapshot(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "id string, n int")
    files.export_snapshot({"reg": df}, str(tmp_path / "s"))
    newer = spark.createDataFrame([("a", 5), ("b", 6)], "id string, n int")
    assert {(r.id, r.n) for r in files.import_snapshot(spark, str(tmp_path / "s"), ["reg"], {"reg": newer})["reg"].collect()} == {("a", 1), ("b", 6)}


def test_stream_ingests_each_content_once(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("same")
    (tmp_path / "in" / "b.txt").write_text("same")
    ingest.ingest(ingest.file_stream(spark, src), out, cp).awaitTermination(60)
    assert spark.read.parquet(out).count() == 1
    (tmp_path / "in" / "c.txt").write_text("other")
    ingest.ingest(ingest.file_stream(spark, src), out, cp).awaitTermination(60)
    assert spark.read.parquet(out).count() == 2


class Loud:
    def correct(self, text):
        if "bad" in text:
            raise RuntimeError
        return text.upper()


class Fixed:
    def embed(self, texts):
        return [[float(len(t)), 1.0] for t in texts]

    def score(self, query, texts):
        return [float(len(t)) for t in texts]


def test_providers(spark):
    df = spark.createDataFrame([("good.", "indirect"), ("bad.", "indirect"), ("raw", "direct"), (None, "indirect")], "text string, extraction_type string")
    assert [r.corrected for r in providers.correct_column(df, Loud()).collect()] == ["GOOD.", "bad.", "raw", None]
    rows = spark.createDataFrame([("aa", "q"), ("aa", "q"), ("bbb", "q")], "text string, query string")
    empty = spark.createDataFrame([], "key string, embedding array<double>")
    full, fresh = providers.embed_cached(rows, empty, Fixed(), "m")
    assert fresh.count() == 2 and sorted(r.embedding[0] for r in full.collect()) == [2.0, 2.0, 3.0]
    assert sorted(r.new_score for r in providers.rerank_column(rows, Fixed()).collect()) == [2.0, 2.0, 3.0]
    r = spark.createDataFrame([("Score: 7.5 of 10",), ("none",), ("99",)], "r string").select(providers.reply_score(F.col("r")).alias("s"), providers.reply_lines(F.col("r"), 2).alias("l"))
    assert [x.s for x in r.collect()] == [0.75, 0.5, 1.0]


def test_multi_query(spark):
    docs = spark.createDataFrame([(1, "what is a red fox"), (2, "define the red fox"), (3, "stock prices")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "what is fox")], "query_id long, question string")
    for fusion in ("rrf", "score"):
        assert {r.id for r in rag.multi_query(docs, q, 2, fusion=fusion).collect()} == {1, 2}


def test_templates(spark):
    rag.add_template("short", "{question}|{context}")
    assert spark.range(1).select(rag.prompt("short", F.lit("c"), F.lit("q"))).first()[0] == "q|c"
    assert "Question: q" in spark.range(1).select(rag.prompt("unknown", F.lit("c"), F.lit("q"))).first()[0]
    assert "Câu hỏi: q" in spark.range(1).select(rag.prompt("version_compare", F.lit("c"), F.lit("q"), "vi")).first()[0]
    assert len(rag.template_names("vi")) == 9 and {"basic_qa", "audio_qa", "factual_qa", "cot_qa", "strict_qa", "citation_required", "conflict_aware", "safe_abstention"} <= set(rag.template_names())


def test_lru_cache():
    now = [0.0]
    c = cache.LruCache(2, ttl=10, clock=lambda: now[0])
    c.put("a", 1)
    c.put("b", 2)
    c.put("b", 3)
    assert c.get("a") == 1 and c.get("b") == 3
    c.put("c", 4)
    assert c.get("a") is None and c.stats()["size"] == 2
    now[0] = 20
    assert c.get("b") is None
    r, calls = cache.ResponseCache(), []
    make = lambda: calls.append(1) or "x"
    assert [r.response("p", "m", t, make) for t in (0.1, 0.1, 0.9)] == ["x"] * 3 and len(calls) == 2
    f = cache.cached(cache.LruCache())(lambda x: calls.append(x) or x)
    assert f(5) == f(5) == 5 and calls.count(5) == 1


def test_settings(monkeypatch):
    monkeypatch.setenv("CORVANE_TOP_K", "9")
    assert Settings.from_env().top_k == 9 and Settings().top_k == 5


