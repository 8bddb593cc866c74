"""Ignore rules by hand-worked cases."""

import pytest

from chronolith.sources import ignore

PATHS = ["a.log", "keep.log", "src/a.log", "src/keep.log", "build/x", "src/build/x", "src/build.txt", "doc/frotz/a", "a/doc/frotz/b", "x/a/b/c/y", "x/y", "tmp", "tmp2/tmp/z", "#odd", "!odd", "f(1).txt", "s/e/c/r/e/t", "one.py", "two.pyc", "b c.txt"]


@pytest.mark.parametrize(
    ("lines", "gone"),
    [
        ([("", "*.log"), ("", "!keep.log")], {"a.log", "src/a.log"}),
        ([("", "!keep.log"), ("", "*.log")], {"a.log", "keep.log", "src/a.log", "src/keep.log"}),
        ([("", "build/")], {"build/x", "src/build/x"}),
        ([("", "/build")], {"build/x"}),
        ([("", "doc/frotz")], {"doc/frotz/a"}),
        ([("", "**/doc/frotz/")], {"doc/frotz/a", "a/doc/frotz/b"}),
        ([("", "x/**/y")], {"x/a/b/c/y", "x/y"}),
        ([("", "x/**")], {"x/a/b/c/y", "x/y"}),
        ([("", "x/*")], {"x/a/b/c/y", "x/y"}),
        ([("", "tmp/")], {"tmp2/tmp/z"}),
        ([("", "tmp")], {"tmp", "tmp2/tmp/z"}),
        ([("", r"\#odd"), ("", r"\!odd"), ("", "# comment"), ("", "  "), ("", "!")], {"#odd", "!odd"}),
        ([("", "f(?).txt"), ("", "*.py[co]"), ("", "[!a-z]dd  ")], {"f(1).txt", "two.pyc"}),
        ([("", "src/*"), ("src", "!keep.log"), ("src", "!build")], {"src/a.log", "src/build.txt"}),
        ([("", "src"), ("src", "!keep.log")], {"src/a.log", "src/keep.log", "src/build/x", "src/build.txt"}),
        ([("src", "/a.log"), ("s/e", "t"), ("s/e/c", "!t")], {"src/a.log"}),
        ([], set()),
    ],
)
def test_rules(spark, lines, gone):
    rows = [(f, i, t) for i, (f, t) in enumerate(lines)]
    frame = spark.createDataFrame(rows, "folder string, line int, text string")
    paths = spark.createDataFrame([(p,) for p in PATHS + PATHS[:3]], "path string")
    got = {r["path"]: r["ignored"] for r in ignore.ignored(paths, frame).collect()}
    assert set(got) == set(PATHS) and {p for p, x in got.items() if x} == gone
