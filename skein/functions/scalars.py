"""Scalar column functions: paths, names, test files, unprintable text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What marks the path of a test file, inside it and at its end.
TEST_PATH_PARTS = (".test.", ".spec.", "__tests__/", "__mocks__/", "/test/", "/tests/", "/testing/", "/fixtures/", "/spec/", "/test_", "/conftest.")
TEST_PATH_ENDS = ("_test.go", "_test.py", "_spec.rb", "_test.rb")


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def is_test_file(path: Column) -> Column:
    """Whether a path names a test file; null paths don't."""
    p = F.lower(slashes(F.coalesce(path, F.lit(""))))
    hit = F.lit(False)
    for x in TEST_PATH_PARTS:
        hit = hit | p.contains(x)
    for x in TEST_PATH_ENDS:
        hit = hit | p.endswith(x)
    return hit


def base_name(path: Column) -> Column:
    return F.element_at(F.split(slashes(path), "/"), -1)


def top_folder(path: Column) -> Column:
    """First part of a relative path; the whole where there is none."""
    return F.element_at(F.split(F.regexp_replace(slashes(path), "^/+", ""), "/"), 1)


def capitalise(text: Column) -> Column:
    """First letter upper, the rest as it is."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def looks_binary(text: Column) -> Column:
    """Whether over a tenth of the first 1000 characters are control characters."""
    head = F.substring(text, 1, 1000)
    bad = F.regexp_count(head, F.lit(r"[\x00-\x08\x0E-\x1F\x7F]"))
    return F.coalesce(bad * 10 > F.length(head), F.lit(False))


def clean_text(text: Column) -> Column:
    """Line ends as \\n, and no control characters but tabs and line ends."""
    return F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def stable_id(*parts: Column) -> Column:
    """First 12 hex digits, upper case, of the SHA-256 of the trimmed lower-case parts joined by line ends."""
    return F.upper(F.substring(F.sha2(F.concat_ws("\n", *(F.lower(F.trim(p)) for p in parts)), 256), 1, 12))
