"""What came with the second round: PDF text, sheets with gaps, hot contents, evictions over a whole cache, generator plans, recall of the approximate search."""

import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from corvane import providers
from corvane.operators import answers, chunking, lexical, registry, search
from corvane.plans import catalogue, ingest
from corvane.sources import files, pdf


def pdf_file(texts, packed=True):
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (5 + 2 * i) for i in range(len(texts))) + b"] /Count %d >>" % len(texts), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", b"<< /Title (A \\(small\\) file) /Author (Nobody) >>"]
    for i, t in enumerate(texts):
        content = b"BT /F1 12 Tf 72 700 Td " + b" 0 -14 Td ".join(b"(" + line.encode().replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj" for line in t.split("\n")) + b" [(kern) -300 (ed)] TJ ET"
        data = zlib.compress(content) if packed else content
        objects += [b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (6 + 2 * i), b"<< /Length %d %s>>\nstream\n%s\nendstream" % (len(data), b"/Filter /FlateDecode " if packed else b"", data)]
    return b"%PDF-1.4\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % (i, o) for i, o in enumerate(objects, 1)) + b"\ntrailer << /Root 1 0 R /Info 4 0 R >>\n%%EOF"


def test_pdf_pages(spark):
    texts = ["First page (one)\nsecond line", "Other page"]
    for packed in (True, False):
        assert pdf.pages(pdf_file(texts, packed)) == [f"{t}kern ed" for t in texts]
    assert pdf.metadata(pdf_file(texts)) == {"title": "A (small) file", "author": "Nobody", "pages": "2"}
    assert pdf.tables("Title\na | b | c\n1 | 2 | 3\nend\nx\ty\n") == [[["a", "b", "c"], ["1", "2", "3"]]]
    with pytest.raises(ValueError):
        pdf.pages(b"no such file")
    rows = spark.createDataFrame([("a.pdf", "pdf", "h", pdf_file(texts)), ("b.pdf", "pdf", "h", b"broken")], "path string, extension string, file_hash string, content binary")
    got = {r.path: r for r in files.extract(rows).collect()}
    assert got["a.pdf"].parts[1] == "[Page 2]\nOther pagekern ed" and not got["b.pdf"].success and "ValueError" in got["b.pdf"].error


def test_sheets_keep_their_columns_and_order():
    cell = lambda ref, v: f'<c r="{ref}"><v>{v}</v></c>'
    sheet = lambda rows: '<worksheet xmlns="m"><sheetData>' + "".join("<row>" + "".join(cell(*c) for c in r) + "</row>" for r in rows) + "</sheetData></worksheet>"
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet([[("A1", "h1"), ("C1", "h3")], [("B2", "x"), ("AA2", "far")]]))
        z.writestr("xl/worksheets/sheet2.xml", sheet([[("A1", "first")]]))
        z.writestr("xl/workbook.xml", '<workbook xmlns="m" xmlns:r="rel"><sheets><sheet name="Two" r:id="r2"/><sheet name="One" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="p"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>')
    two, one = files.read_xlsx(raw.getvalue())
    assert two.startswith("first") and one.split("\n")[0] == "h1 |  | h3" and one.split("\n")[2].split(" | ")[1] == "x" and len(one.split("\n")[2].split(" | ")) == 27
    many = files.read_table(",")(("a,b\n" + "1,2\n" * 20_000).encode())[0]
    assert many.count("\n") == 20_001 and files.sheet_text([["a"]] * 5, 2).endswith("[2 more rows]")


def test_fresh_documents_with_a_hot_content(spark):
    batch = spark.range(300).select(F.col("id").alias("path"), F.when(F.col("id") % 3 > 0, "same").otherwise(F.col("id").cast("string")).alias("content"))
    new, old = registry.fresh_documents(batch)
    assert new.count() == 101 and old.count() == 199 and new.filter("content = 'same'").first().path == 1
    assert spark.range(1).select(registry.document_id(F.lit("x"))).first()[0] == "doc_9dd4e461268c8034f5c8564e155c67a6"


def test_eviction_of_a_whole_cache(spark):
    rows = [(str(i), i * i, 1 + i % 7) for i in range(500)]
    cache = spark.createDataFrame(rows, "key string, used_at long, bytes long")
    left, want = 900 * 0.8, []
    for key, _, size in sorted(rows, key=lambda r: (-r[1], r[0])):
        if size > left:
            break
        left -= size
        want.append(key)
    assert {r.key for r in registry.cache_evict(cache, 900).collect()} == set(want)
    assert registry.cache_evict(cache, 10**9).count() == 500 and registry.cache_evict(cache.limit(0), 5).count() == 0


def test_generator_plans(spark):
    class Says:
        def __init__(self, reply):
            self.reply = reply

        def answer(self, prompt):
            if self.reply is None:
                raise RuntimeError("down")
            return self.reply


    pairs = spark.createDataFrame([(1, 1, "what", "word " * 60), (1, 2, "what", "short text")], "query_id long, id long, query string, text string")
    assert {r.id: r.compressed for r in answers.compress(pairs, "llm", Says(" sum ")).collect()} == {1: "sum", 2: "short text"}
    assert {r.compressed_length for r in answers.compress(pairs, "llm", Says(None)).collect()} == {300, 10}
    assert answers.compress(pairs.withColumn("query", F.lit("word")), "llm").count() == 1  # extractive without a generator
    assert {r.new_score for r in providers.generated_scores(pairs, Says("about 7 of 10")).collect()} == {0.7} and {r.new_score for r in providers.generated_scores(pairs, Says(None)).collect()} == {0.5}
    q = spark.createDataFrame([(5, "what is fox")], "query_id long, query string")
    lines = lambda *a, **k: [r.variant for r in providers.rephrased(q, *a, **k).orderBy("position").collect()]
    assert lines(Says("1. one\n\n- two\nthree\nfour")) == ["what is fox", "one", "two", "three"] and lines(Says(None)) == ["what is fox"]
    assert lines(Says(None), angles=True) == [r.variant for r in lexical.expand_synonyms(q).orderBy("position").collect()]


def test_embedding_is_tried_again(spark, tmp_path):
    class Flaky:
        def embed(self, texts):
            mark = tmp_path / "failed"
            if not mark.exists():
                mark.touch()
                raise RuntimeError("once")
            assert len(texts) <= 2
            return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([("a",), ("bb",), ("ccc",)], "text string").coalesce(1)
    assert [r.embedding for r in providers.embed_column(df, Flaky(), batch=2, wait=0.01, prefix=providers.model_prefix("multilingual-e5-base", True)).collect()] == [[8.0], [9.0], [10.0]]
    assert providers.model_prefix("sbert", True) == "" and providers.models()["e5-large"] == 1024


def test_tokens_are_counted_in_the_row(spark):
    df = spark.createDataFrame([(1, "b a B c a a"), (2, ""), (3, None), (4, "x")], "doc_id long, text string")
    assert {(r.id, r.token): (r.tf, r.len) for r in lexical.postings(df).collect()} == {(1, "a"): (3, 6), (1, "b"): (2, 6), (1, "c"): (1, 6), (4, "x"): (1, 1)}
    terms = spark.createDataFrame([(9, "a", 1), (9, "zz", 1)], "query_id long, token string, qf long")
    index, stats = lexical.query_index(df, terms)
    assert [tuple(r) for r in stats.collect()] == [(4, 1.75)] and [(r.id, r.tf) for r in index.collect()] == [(1, 3)]
    plan = lexical.postings(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_separators_of_the_splitter():
    assert chunking.split_recursive("aaa, bbb, ccc", 5, 0) == ["aaa,", "bbb,", "ccc"] and chunking.SEPARATORS[3:6] == ["? ", "! ", ", "]


def test_hybrid_keeps_what_the_whole_join_gives(spark):
    hits = spark.createDataFrame([(1, i, 0.9 - i / 100) for i in range(4)], "query_id long, id long, score double")
    lex = spark.createDataFrame([(1, i, 5.0 - (i % 9) / 3) for i in range(2, 60)], "query_id long, id long, score double")
    vec = {i: 0.9 - i / 100 for i in range(4)}
    words = {i: (5.0 - (i % 9) / 3) / 5.0 for i in range(2, 60)}
    want = sorted(((round(0.3 * vec.get(i, 0) + 0.7 * words.get(i, 0), 6), -i) for i in {*vec, *words}), reverse=True)[:5]
    assert [(r.score, -r.id) for r in search.hybrid(hits, lex, 5, 0.3).orderBy("rank").collect()] == want


def test_adding_a_folder_again_after_a_death(spark, tmp_path):
    source, store = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()
    for i in range(3):
        (source / f"{i}.txt").write_text(f"Sentence number {i}. Another one follows here.")
    ingest.add_folder(spark, str(source), store)
    whole = {n: spark.read.parquet(f"{store}/{n}").count() for n in ("processed", "points", "registry")}
    (tmp_path / "store" / "registry").rename(tmp_path / "gone")  # as if the job had died before the last append
    ingest.add_folder(spark, str(source), store)
    assert {n: spark.read.parquet(f"{store}/{n}").count() for n in whole} == whole


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_recall_of_the_registered_approximate_search(spark, sf):
    import os

    folder = f"/root/testdata/{sf}"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    pairs = lambda name: {(r.query_id, r.id) for r in catalogue.QUERIES[name](spark, folder).collect()}
    exact = pairs("vector_knn_cosine")
    assert len(pairs("vector_knn_lsh") & exact) >= 0.9 * len(exact)
