"""Files in, files out, and files arriving over time."""

import gzip
import json

from pyspark.sql import functions as F

from pagegrid.operators import extraction
from pagegrid.sources import readers, writers
from pagegrid.streaming import incremental


def pages_frame(spark, n):
    rows = [(1, i, f"text {i}\n| a | b{i} |") for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "doc_id bigint, page_no int, markdown string")


def response(*texts):
    return json.dumps({"pages": [{"index": 7, "markdown": t, "images": []} for t in texts]})


def test_scan_docs_does_not_read_contents(spark, tmp_path):
    (tmp_path / "a.b.pdf").write_bytes(b"x" * 2_097_152)
    (tmp_path / "note.txt").write_text("x")
    docs = readers.scan_docs(spark, str(tmp_path))
    assert [(r.name, r.size_mb) for r in docs.collect()] == [("a.b", 2.0)]
    assert "ReadSchema: struct<path:string,length:bigint>" in docs._jdf.queryExecution().toString()


def test_read_ocr_json(spark, tmp_path):
    (tmp_path / "d1.json").write_text(response("one", "two\nlines"))
    (tmp_path / "d2.json").write_text(response())
    (tmp_path / "d3.json").write_text(response("| a | b |")[:-9])
    pages = readers.read_ocr_json(spark, str(tmp_path))
    rows = pages.orderBy("name", "page_no").collect()
    assert [(r.name, r.is_readable, r.page_no, r.markdown) for r in rows] == [
        ("d1", True, 1, "one"),
        ("d1", True, 2, "two\nlines"),
        ("d2", True, None, None),
        ("d3", False, None, None),
    ]
    summary = extraction.run_summary(pages).orderBy("name").collect()
    assert [(r.name, r.pages_processed, r.tables_found) for r in summary] == [
        ("d1", 2, 0),
        ("d2", 0, 0),
        ("d3", 0, 0),
    ]
    parts = writers.document_markdown(pages.filter("name <> 'd1'")).collect()
    assert [(r.part_no, r.markdown) for r in parts] == [(0, "# Enhanced OCR Results\n\n")] * 2
    assert extraction.page_csv(pages).count() == 0


def test_each_line_is_a_response_of_its_own(spark, tmp_path):
    one, two = response("| a | b |", "x"), response("| a | b |", "x")
    (tmp_path / "all.json").write_text("\n".join([one, two, '{"pages": [', response()]))
    pages = readers.read_ocr_json(spark, str(tmp_path), lines=True).cache()
    summary = extraction.run_summary(pages).collect()
    assert sorted((r.pages_processed, r.tables_found) for r in summary) == [(0, 0)] * 2 + [(2, 1)] * 2
    assert len({r.name for r in summary}) == 4
    assert len({r.file_name for r in extraction.page_csv(pages).collect()}) == 2
    assert pages.filter("NOT is_readable").count() == 1


def test_responses_by_id_field_with_whole_page_records(spark, tmp_path):
    page = {"index": 0, "markdown": "| a | b |", "images": [{"id": "i"}]}
    lines = [json.dumps({"id": k, "pages": [page]}) for k in ("u", "v")]
    (tmp_path / "all.json").write_text("\n".join(lines))
    pages = readers.read_ocr_json(
        spark,
        str(tmp_path),
        lines=True,
        id_field="id",
        page_fields="index:int,markdown:string,images:array<struct<id:string>>",
        records=True,
    )
    files = extraction.page_csv(pages).orderBy("doc_id").collect()
    assert [(r.doc_id, r.file_name) for r in files] == [("u", "u_page_1.csv"), ("v", "v_page_1.csv")]
    named = extraction.page_csv(pages, F.concat(F.lit("n-"), "doc_id")).orderBy("doc_id").collect()
    assert [r.file_name for r in named] == ["n-u_page_1.csv", "n-v_page_1.csv"]
    written = writers.ocr_json_parts(pages).orderBy("doc_id").first().asDict(True)
    assert written == {"doc_id": "u", "part_no": 0, "pages": [{"page_number": 1, **page}]}


def test_ground_truth_joins_the_text_of_its_document(spark, tmp_path):
    word = {"pages": [{"blocks": [{"lines": [{"words": [{"value": "ab"}]}]}]}]}
    (tmp_path / "truth").mkdir()
    (tmp_path / "ocr").mkdir()
    with gzip.open(tmp_path / "truth" / "d.1.json.gz", "wt") as f:
        json.dump(word, f)
    (tmp_path / "ocr" / "d.1.json").write_text(response("ab"))
    truth = readers.read_ground_truth(spark, str(tmp_path / "truth"))
    pages = readers.read_ocr_json(spark, str(tmp_path / "ocr"))
    rows = truth.join(pages, "name").select("ground_truth", "markdown").collect()
    assert [tuple(r) for r in rows] == [("ab", "ab")]


def test_read_ground_truth(spark, tmp_path):
    words = lambda *vs: {"words": [{"value": v} if v else {"confidence": 1} for v in vs]}
    data = {
        "pages": [
            {"blocks": [{"lines": [words("a", None, "b"), words()]}, {"lines": [words("c")]}]},
            {"blocks": []},
            {},
        ]
    }
    with gzip.open(tmp_path / "x.json.gz", "wt") as f:
        json.dump(data, f)
    rows = readers.read_ground_truth(spark, str(tmp_path)).collect()
    assert [r.ground_truth for r in rows] == ["ab  \nc"]


def test_document_parts_concatenate_to_one_file(spark):
    pages = pages_frame(spark, 130)
    parts = writers.document_markdown(pages).orderBy("part_no").collect()
    assert [r.part_no for r in parts] == [0, 1, 2]
    expected = "# Enhanced OCR Results\n\n" + "".join(
        f"## Page {i}\n\ntext {i}\n| a | b{i} |\n\n---\n\n" for i in range(1, 131)
    )
    assert "".join(r.markdown for r in parts) == expected


def test_ocr_json_round_trip(spark, tmp_path):
    pages = pages_frame(spark, 70)
    out = str(tmp_path / "json")
    writers.write_ocr_json(pages, out, by_document=True)
    back = spark.read.json(out).select("doc_id", F.explode("pages").alias("p"))
    got = sorted((r.doc_id, r.p.page_number, r.p.markdown) for r in back.collect())
    assert got == sorted((r.doc_id, r.page_no, r.markdown) for r in pages.collect())


def test_written_markdown_and_csv_bytes(spark, tmp_path):
    pages = pages_frame(spark, 2)
    writers.write_document_markdown(pages, str(tmp_path / "md"))
    text = next((tmp_path / "md" / "doc_id=1" / "part_no=0").glob("part-*")).read_bytes().decode()
    assert text == writers.document_markdown(pages).first().markdown
    writers.write_page_csv(pages, str(tmp_path / "csv"), per_file=True)
    file = next((tmp_path / "csv" / "file_name=1_page_2.csv").glob("part-*"))
    assert file.read_bytes() == b"a,b2\r\n"
    writers.write_page_csv(pages, str(tmp_path / "set"))
    assert spark.read.parquet(str(tmp_path / "set")).count() == 2


def test_stream_takes_each_file_once(spark, tmp_path):
    source, out, state = (tmp_path / n for n in ("in", "out", "state"))
    source.mkdir()
    run = lambda: incremental.stream_tables(
        incremental.stream_ocr_json(spark, str(source)), str(out), str(state)
    ).awaitTermination(120)
    (source / "a.json").write_text(response("| a | b |", "none"))
    assert run()
    (source / "b.json").write_text(response("| c | d |\n| e | f |"))
    assert run()
    got = spark.read.parquet(str(out)).select("page_no", "table_no", "row_no", "cells").collect()
    assert sorted(map(tuple, got)) == [
        (1, 1, 1, ["a", "b"]),
        (1, 1, 1, ["c", "d"]),
        (1, 1, 2, ["e", "f"]),
    ]
    batch = extraction.extract_tables(readers.read_ocr_json(spark, str(source)))
    assert batch.count() == len(got)
