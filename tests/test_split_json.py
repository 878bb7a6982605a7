"""Responses read by byte ranges: any split size gives what a whole parse gives."""

import json

import pytest

from pagegrid.sources import readers, split_json

NASTY = ['a "quoted" {[', "back\\slash \\\\", "}]}{", '\\"pages": [{', "é😀" * 9, "", "line\nline"]


def response(texts, **more):
    pages = [{"index": 7, "markdown": t, "images": [{"id": "{"}]} for t in texts]
    return {"usage": {"info": {"pages": 2}}, "list": [{"markdown": "no page"}], "pages": pages, **more}


def rows_of(pages):
    kept = pages.select("doc_id", "name", "is_readable", "page_no", "markdown").collect()
    return sorted([tuple(r) for r in kept], key=str)


@pytest.mark.parametrize("size", [7, 100, 1 << 20])
def test_ranges_of_any_size(spark, tmp_path, size):
    (tmp_path / "one.json").write_text(json.dumps(response(NASTY, tail=[{"markdown": "x"}]), indent=2))
    many = [response(NASTY[k:]) for k in range(2)] + [response([]), {"model": "m"}]
    (tmp_path / "many.json").write_text(
        "\n".join(json.dumps(r, ensure_ascii=False) for r in many), encoding="utf-8"
    )
    (tmp_path / "none.json").write_text("")
    pages = split_json.read_split_pages(spark, str(tmp_path), split_bytes=size)
    rows = rows_of(pages)
    expected = [("one", k, t) for k, t in enumerate(NASTY, 1)]
    at, names = 0, []
    for r in many:
        names.append("many" if not at else f"many_{at}")
        at += len(json.dumps(r, ensure_ascii=False).encode()) + 1
        texts = [p["markdown"] for p in r.get("pages", [])]
        expected += [(names[-1], k, t) for k, t in enumerate(texts, 1)] or [(names[-1], None, None)]
    assert sorted([(r[1], r[3], r[4]) for r in rows], key=str) == sorted(expected, key=str)
    assert all(r[2] for r in rows) and len({r[0] for r in rows}) == 5
    assert rows == rows_of(split_json.read_split_pages(spark, str(tmp_path), split_bytes=333))


def test_one_response_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(response([f"page {k}" for k in range(500)])))
    ranges = split_json.byte_ranges(spark, str(tmp_path), split_bytes=1000)
    assert ranges.count() > 30
    pages = split_json.read_split_pages(spark, str(tmp_path), split_bytes=1000)
    told = pages.selectExpr("spark_partition_id() AS p", "page_no", "markdown").collect()
    assert len({r.p for r in told}) > 4
    assert sorted((r.page_no, r.markdown) for r in told) == [(k + 1, f"page {k}") for k in range(500)]
    whole = readers.read_ocr_json(spark, str(tmp_path)).select("page_no", "markdown").collect()
    assert sorted(map(tuple, whole)) == sorted((r.page_no, r.markdown) for r in told)


@pytest.mark.parametrize("size", [16, 1 << 20])
def test_files_cut_off_and_pages_that_are_no_json(spark, tmp_path, size):
    (tmp_path / "cut.json").write_text(json.dumps({"pages": [{"markdown": "a"}, {"markdown": "b"}]})[:-7])
    (tmp_path / "bad.json").write_text('{"pages": [{"markdown": "a"}, {"markdown" oops}, {"markdown": "c"}]}')
    rows = rows_of(split_json.read_split_pages(spark, str(tmp_path), split_bytes=size))
    assert [r[1:] for r in sorted(rows, key=lambda r: (r[1], r[3] or 9))] == [
        ("bad", True, 1, "a"),
        ("bad", True, 3, "c"),
        ("bad", False, None, None),
        ("cut", True, 1, "a"),
        ("cut", False, None, None),
    ]
