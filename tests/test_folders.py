"""Folder listings and the company's file."""

import json

import pytest

from docloom.operators.origin import CompanyIdentity
from docloom.sources import files


def test_listing_is_in_natural_order(spark):
    paths = ["b/part10.pdf", "b/Part2.pdf", "b/part002a.pdf", "b/x/y/1.pdf", "b/X1/1.pdf", "b/x/2.pdf", "a/1.pdf", "bb/1.pdf", "b/part99999999999999999999.pdf"]
    table = spark.createDataFrame([(p,) for p in paths], "path string")
    got = [(r.kind, r.name, r.files) for r in files.folder_listing(table, "a/../b/").collect()]
    assert got == [
        ("directory", "x", 2),
        ("directory", "X1", 1),
        ("file", "Part2.pdf", 1),
        ("file", "part002a.pdf", 1),
        ("file", "part10.pdf", 1),
        ("file", "part99999999999999999999.pdf", 1),
    ]
    assert [r.name for r in files.folder_listing(table, "").collect()] == ["a", "b", "bb"]
    assert files.folder_listing(table, "none").count() == 0


@pytest.mark.parametrize("directory", ["..", "../a", "/etc", "a/../../b"])
def test_listing_stays_inside(spark, directory):
    table = spark.createDataFrame([("a/1.pdf",)], "path string")
    with pytest.raises(ValueError):
        files.folder_listing(table, directory)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (json.dumps({"name": " Muster GmbH ", "aliases": ["MG", 7, None]}), CompanyIdentity("Muster GmbH", ("MG",))),
        (json.dumps({"name": "Muster", "aliases": "MG"}), CompanyIdentity("Muster")),
        (json.dumps({"name": "  "}), None),
        (json.dumps(["Muster"]), None),
        ("{", None),
        (None, None),
    ],
)
def test_company_of_a_file(tmp_path, text, expected):
    path = tmp_path / "company.json"
    if text is not None:
        path.write_text(text, "utf-8")
    assert CompanyIdentity.load(str(path)) == expected
