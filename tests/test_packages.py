"""Packages are committed as a whole: what fails on the way is never read."""

import pytest

from yomibon.sources import books


def rows(spark, *found):
    return spark.createDataFrame([*found], "book string, value string")


def value(spark, path, kind):
    return {r.book: r.value for r in books.read_package(spark, path, kind).collect()}


def test_a_failed_generation_is_never_read(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/package"
    with pytest.raises(ValueError, match="no package"):
        books.read_package(spark, path, "metadata")
    books.commit(spark, path, {"metadata": rows(spark, ("a", "1"), ("b", "1")), "chapters": rows(spark, ("a", "x"), ("a", "y"), ("b", "z"))})
    broken = spark.range(1).selectExpr("'a' as book", "raise_error('lost') as value")
    with pytest.raises(Exception, match="lost"):  # after its metadata, before its chapters
        books.commit(spark, path, {"metadata": rows(spark, ("a", "2")), "chapters": broken})
    assert value(spark, path, "metadata") == {"a": "1", "b": "1"} and books.read_package(spark, path, "chapters").count() == 3
    books.commit(spark, path, {"metadata": rows(spark, ("a", "3")), "chapters": rows(spark, ("a", "w"))})
    assert value(spark, path, "metadata") == {"a": "3", "b": "1"}
    assert value(spark, path, "chapters") == {"a": "w", "b": "z"} and books.read_package(spark, path, "chapters").count() == 2


def test_of_two_writers_one_fails(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/package"
    books.commit(spark, path, {"metadata": rows(spark, ("a", "1"))})
    seen = books.generations(spark, path)
    books.commit(spark, path, {"metadata": rows(spark, ("a", "2"))})
    monkeypatch.setattr(books, "generations", lambda *_: seen)  # as a writer sees it that began before
    with pytest.raises(Exception, match="exist"):
        books.commit(spark, path, {"metadata": rows(spark, ("a", "3"))})
    monkeypatch.undo()
    assert value(spark, path, "metadata") == {"a": "2"}
    # One that died while it committed has taken its number, and no more.
    (tmp_path / "package" / "commits" / "000000000003").touch()
    books.commit(spark, path, {"metadata": rows(spark, ("a", "4"))})
    assert value(spark, path, "metadata") == {"a": "4"}
