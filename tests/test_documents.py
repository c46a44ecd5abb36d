import os

import pytest
from pyspark.sql import functions as F

from ticketveil import plans
from ticketveil.operators import documents as D
from ticketveil.operators.redaction import redact_documents
from ticketveil.sources import read_documents, write_ordered, write_redacted
from ticketveil.streaming import start_redaction

PAGES = [
    (1, 1, "one"), (1, 3, "three"), (1, 2, ""), (1, 4, "four"),
    (2, 1, ""), (2, 2, None),
    (3, 2, "b"), (3, 1, "a"),
]


def pages(spark):
    return spark.createDataFrame(PAGES, "doc_id int, page_no int, text string")


@pytest.mark.parametrize("most, expected", [(None, ["one\nthree\nfour", "", "a\nb"]), (2, ["one", "", "a\nb"]), (3, ["one\nthree", "", "a\nb"])])
def test_assemble_pages(spark, most, expected):
    got = D.assemble_pages(pages(spark), max_pages=most).orderBy("doc_id").collect()
    assert [r.text for r in got] == expected


def test_assemble_parts(spark):
    got = D.assemble_pages(pages(spark), pages_per_part=3).orderBy("doc_id", "part").collect()
    assert [(r.doc_id, r.part, r.text) for r in got] == [(1, 0, "one"), (1, 1, "three\nfour"), (2, 0, ""), (3, 0, "a\nb")]


def test_no_text_gate(spark):
    df = spark.createDataFrame([("  \n",), ("x",), (None,)], "text string")
    assert [r.status for r in D.no_text_gate(df).collect()] == ["error", "processing", "error"]


def test_conversation_without_text(spark):
    turns = spark.createDataFrame([(1, 1, "user", None), (1, 0, "system", None)], "conv_id int, turn int, role string, text string")
    row = D.conversation_export(turns).first()
    assert (row.n_turns, row.text_length) == (2, 0)
    assert row.export.startswith('{"conversation":[{"role":"system"')


def test_pages_to_redacted_text(spark):
    df = spark.createDataFrame([(1, 1, "Caller: Caleb Franklin\nfrom"), (1, 2, "host 8.8.8.8")], "doc_id int, page_no int, text string")
    row = plans.redact_pages(df).first()
    assert row.redacted_text == "Caller: Caleb F. from host [REDACTED IP]"
    assert row.stats.total_redactions == 2


def test_batch_files(spark):
    docs = spark.createDataFrame([("a.pdf", "mail a@b.com", 1.0), ("b.pdf", " ", 1.0)], "filename string, text string, processing_time double")
    reports = spark.createDataFrame([("a.pdf", "11/12")], "filename string, audit_report string")
    got = {r.filename: r for r in plans.batch_files(docs, reports).collect()}
    assert (got["a.pdf"].status, got["a.pdf"].redaction_count, got["a.pdf"].audit_score) == ("success", 1, "11/12 (92%)")
    assert (got["b.pdf"].status, got["b.pdf"].redaction_count, got["b.pdf"].error_message) == ("error", 0, D.NO_TEXT)


def test_prompt_table(spark):
    df = spark.createDataFrame([(1, "text")], "doc_id int, redacted_text string")
    row = plans.prompt_table(df, "{{PROCEDURES_SNIPPET}}|{{QUESTION_BLOCKS}}|{{INCIDENT_TEXT}}", "q", "p" * 2001, "gpt-4").first()
    assert row.optimized_prompt == "p" * 2000 + "...|q|text"


def test_sources(spark, tmp_path):
    for name, text in (("a", "one\ntwo"), ("b", "8.8.8.8")):
        (tmp_path / f"{name}.txt").write_text(text)
    docs = read_documents(spark, str(tmp_path / "*.txt"), "text")
    assert sorted(r.text for r in docs.collect()) == ["8.8.8.8", "one\ntwo"]
    out = str(tmp_path / "redacted")
    write_redacted(redact_documents(docs), out)
    assert spark.read.parquet(out).agg(F.sum("ip_addresses")).first()[0] == 1
    for fmt in ("csv", "json"):
        path = str(tmp_path / fmt)
        spark.createDataFrame([("x", 'a "b"\nc')], "id string, body string").write.options(header=True, escape='"').format(fmt).save(path)
        back = read_documents(spark, path, fmt, id="id", text="body").first()
        assert (back.doc_id, back.text) == ("x", 'a "b"\nc')


def test_write_ordered(spark, tmp_path):
    blocks = spark.createDataFrame([(1, "b", "2\n"), (0, "", "head\n"), (1, "a", "1\n")], "section int, filename string, content string")
    path = tmp_path / "summary"
    write_ordered(blocks, str(path), "section", "filename")
    text = "".join(p.read_text() for p in sorted(path.glob("part-*")))
    assert text == "head\n1\n2\n"


def test_stored(spark, shared_dir):
    df = plans.stored(spark.range(5), "numbers")
    assert df.count() == 5
    assert any(p.startswith("numbers-") for p in os.listdir(shared_dir))
    assert all(f.startswith(f"file://{shared_dir}") for f in df.inputFiles())


def test_stream_equals_batch(spark, tmp_path, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text")
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    docs.repartition(3).write.parquet(source)
    start_redaction(spark, source, sink, checkpoint=str(tmp_path / "cp"), files_per_trigger=1, once=True).awaitTermination()
    streamed = spark.read.parquet(sink)
    assert streamed.count() == docs.count()
    assert streamed.exceptAll(redact_documents(docs)).count() == 0


def test_two_streams_share_nothing(spark, tmp_path):
    for n in (1, 2):
        source, sink = str(tmp_path / f"in{n}"), str(tmp_path / f"out{n}")
        spark.range(n * 10).selectExpr("id AS doc_id", "'from 8.8.8.8' AS text").write.parquet(source)
        start_redaction(spark, source, sink, checkpoint=str(tmp_path / f"cp{n}"), once=True).awaitTermination()
        assert spark.read.parquet(sink).count() == n * 10


def test_stored_needs_a_folder(spark, tmp_path):
    assert plans.stored(spark.range(3), "own", str(tmp_path)).count() == 3


@pytest.mark.parametrize("format", ["csv", "json"])
def test_read_documents_keeps_columns(spark, tmp_path, format):
    from ticketveil.sources import read_documents

    path = str(tmp_path / format)
    df = spark.createDataFrame([("en", 'two\n"lines"', "a", 3), ("de", "ü, x", "b", None)], "lang string, body string, name string, n int")
    (df.write.options(header=True, escape='"') if format == "csv" else df.write).format(format).save(path)
    got = read_documents(spark, path, format, id="name", text="body", keep=("lang", "n int"))
    assert got.dtypes == [("doc_id", "string"), ("text", "string"), ("lang", "string"), ("n", "int")]
    assert sorted(map(tuple, got.collect())) == [("a", 'two\n"lines"', "en", 3), ("b", "ü, x", "de", None)]
    assert read_documents(spark, path, format, id="name", text="body").columns == ["doc_id", "text"]
