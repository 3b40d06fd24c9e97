import pytest

from gridsight.operators import files


@pytest.fixture
def listing(spark):
    return spark.createDataFrame(
        [("a/x.txt", 5, 10, "o"), ("a/b/", 0, 11, "o"), ("a/b/y.tar.gz", 2048, 12, "o"), ("c/z", 1, 13, None), ("root.csv", 9, 14, "o")],
        "name string, size bigint, last_modified bigint, owner string",
    )


def test_root_lists_directories_once(listing, rows):
    assert rows(files.list_root(listing)) == [
        ("a/", True, 0, 0, None), ("c/", True, 0, 0, None), ("root.csv", False, 9, 14, "o"),
    ]


def test_prefix_is_recursive(listing, rows):
    assert rows(files.list_prefix(listing, "a/"), "name", "is_directory") == [
        ("a/b/", True), ("a/b/y.tar.gz", False), ("a/x.txt", False),
    ]


def test_pages_follow_each_other(listing):
    names, marker = [], None
    for _ in range(10):
        page = files.list_page(listing, marker, 2).orderBy("position").collect()
        names += [row["name"] for row in page]
        if not page[0]["has_more"]:
            assert page[0]["next_marker"] is None
            break
        marker = page[0]["next_marker"]
    assert names == ["a/b/", "a/b/y.tar.gz", "a/x.txt", "c/z", "root.csv"]


def test_exactly_full_page_has_no_more(listing):
    assert {row["has_more"] for row in files.list_page(listing, None, 5).collect()} == {False}


def test_kinds(listing, rows):
    assert rows(files.with_file_kind(listing), "name", "extension", "size_text") == [
        ("a/b/", None, "--"), ("a/b/y.tar.gz", "gz", "2.0 KB"), ("a/x.txt", "txt", "5 Bytes"), ("c/z", None, "1 Bytes"),
        ("root.csv", "csv", "9 Bytes"),
    ]
