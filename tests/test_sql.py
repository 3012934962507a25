"""The dialect: parsing, values, order, changes, keys and transactions."""

from __future__ import annotations

import pytest

from loomwork.errors import AnalysisFailure, ConflictFailure, ConstraintFailure, EngineError, SyntaxFailure
from loomwork.plans.statements import Both, Compare, Either, parse
from loomwork.session import Session
from loomwork.sources.shared import new_folder


@pytest.fixture
def s(spark):
    return Session(spark, new_folder(spark, "test"))


def rows(df):
    return [tuple(r) for r in df.collect()]


def filled(s, columns, *values):
    s.sql(f"CREATE TABLE t ({columns})")
    for v in values:
        s.sql(f"INSERT INTO t VALUES ({v})")
    return s


def test_and_binds_tighter_than_or():
    where = parse("SELECT * FROM t WHERE a = 1 OR b = 2 AND c = 3").where
    assert where == Either((Compare("a", "=", 1), Both((Compare("b", "=", 2), Compare("c", "=", 3)))))


@pytest.mark.parametrize("text", ["", "SELECT", "SELECT * FROM t extra", "SELECT * FROM t WHERE a <> 1", "SELECT * FROM t LIMIT -1", "SELECT * FROM t LIMIT 1.5", "INSERT INTO t VALUES (1), (2)", "SELECT * FROM t WHERE a = 9223372036854775808", "CREATE TABLE t (a DATE)", "SELECT * FROM t -- note", "SELECT * FROM t WHERE a = 1.2.3", "INSERT INTO t VALUES ('it''s')"])
def test_rejected_texts(text):
    with pytest.raises(SyntaxFailure):
        parse(text)


def test_keywords_in_either_case_names_as_they_are(s):
    filled(s, "id int, Val text", "1, 'x'")
    assert rows(s.sql("select Val from t where id = 1;")) == [("x",)]
    with pytest.raises(AnalysisFailure):
        s.sql("SELECT val FROM t")
    with pytest.raises(AnalysisFailure):
        s.sql("SELECT id FROM T")


def test_nulls_in_comparisons(s):
    filled(s, "id INT, name TEXT", "1, 'Alice'", "2, NULL", "3, 'Charlie'")
    assert rows(s.sql("SELECT id FROM t WHERE name IS NULL")) == [(2,)]
    assert rows(s.sql("SELECT id FROM t WHERE name IS NOT NULL ORDER BY id")) == [(1,), (3,)]
    assert rows(s.sql("SELECT id FROM t WHERE name != 'Alice'")) == [(3,)]
    assert rows(s.sql("SELECT id FROM t WHERE name = NULL")) == []


def test_order_of_nulls_and_ties(s):
    filled(s, "id INT, val FLOAT", "1, 1.1", "2, NULL", "3, -1.1", "4, 1.1")
    assert rows(s.sql("SELECT id, val FROM t ORDER BY val")) == [(3, -1.1), (1, 1.1), (4, 1.1), (2, None)]
    assert rows(s.sql("SELECT id, val FROM t ORDER BY val DESC LIMIT 3")) == [(2, None), (1, 1.1), (4, 1.1)]
    with pytest.raises(AnalysisFailure):
        s.sql("SELECT id FROM t ORDER BY val")


def test_numbers_compare_across_types_text_does_not(s):
    filled(s, "id INT, val FLOAT, name TEXT", "1, 3.14, 'a'", "2, 5.0, 'b'")
    assert rows(s.sql("SELECT id FROM t WHERE val > 4")) == [(2,)]
    assert rows(s.sql("SELECT id FROM t WHERE id < 1.5")) == [(1,)]
    with pytest.raises(AnalysisFailure):
        s.sql("SELECT id FROM t WHERE name = 5")


def test_insert_checks(s):
    filled(s, "id INT PRIMARY KEY, val FLOAT", "1, 1.0")
    for bad in ("1, 2.0", "NULL, 2.0"):
        with pytest.raises(ConstraintFailure):
            s.sql(f"INSERT INTO t VALUES ({bad})")
    for bad in ("2, 2", "2", "2, 'x'", "2, 1.0, 1"):
        with pytest.raises(EngineError):
            s.sql(f"INSERT INTO t VALUES ({bad})")
    assert rows(s.sql("SELECT * FROM t")) == [(1, 1.0)]
    Session(s.spark, s.root, coerce_numeric=True).sql("INSERT INTO t VALUES (2, 2)")
    assert rows(s.sql("SELECT val FROM t WHERE id = 2")) == [(2.0,)]


def test_update_and_delete(s):
    filled(s, "id INT PRIMARY KEY, val INT, name TEXT", "1, 10, 'a'", "2, 20, 'b'", "3, 30, 'c'")
    s.sql("UPDATE t SET val = 99, name = 'a much longer text than before' WHERE id = 2")
    s.sql("DELETE FROM t WHERE val = 10")
    assert rows(s.sql("SELECT * FROM t ORDER BY id")) == [(2, 99, "a much longer text than before"), (3, 30, "c")]
    with pytest.raises(ConstraintFailure):
        s.sql("UPDATE t SET id = 7")
    with pytest.raises(ConstraintFailure):
        s.sql("UPDATE t SET id = NULL WHERE id = 2")
    s.sql("UPDATE t SET val = 1 WHERE id = 12345")
    s.sql("DELETE FROM t")
    assert rows(s.sql("SELECT * FROM t")) == []


def test_tables_outlive_sessions(s):
    filled(s, "id INT, name TEXT", "1, 'Alice'")
    again = Session(s.spark, s.root)
    assert again.tables() == ["t"] and rows(again.sql("SELECT * FROM t")) == [(1, "Alice")]
    with pytest.raises(AnalysisFailure):
        again.sql("CREATE TABLE t (a INT)")


def test_rollback_and_conflict(s):
    filled(s, "id INT, v INT", "1, 1")
    s.sql("BEGIN")
    s.sql("UPDATE t SET v = 2")
    assert rows(s.sql("SELECT v FROM t")) == [(2,)]
    other = Session(s.spark, s.root)
    assert rows(other.sql("SELECT v FROM t")) == [(1,)]
    s.sql("ROLLBACK")
    assert rows(s.sql("SELECT v FROM t")) == [(1,)]
    s.sql("BEGIN")
    s.sql("UPDATE t SET v = 3")
    other.sql("UPDATE t SET v = 4")
    with pytest.raises(ConflictFailure):
        s.sql("COMMIT")
    assert rows(s.sql("SELECT v FROM t")) == [(4,)]


def test_append_and_compact(s):
    filled(s, "id INT PRIMARY KEY, v INT", "1, 1")
    s.append("t", s.spark.range(2, 50).selectExpr("id", "id * 2 AS v"))
    with pytest.raises(ConstraintFailure):
        s.append("t", s.spark.range(49, 51).selectExpr("id", "id AS v"))
    s.compact("t")
    assert s.table("t").count() == 49


def test_commit_of_two_tables_is_whole(s, monkeypatch):
    s.sql("CREATE TABLE a (id INT)")
    s.sql("CREATE TABLE b (id INT)")
    for fails in (True, False):
        s.sql("BEGIN")
        s.sql("INSERT INTO a VALUES (1)")
        s.sql("INSERT INTO b VALUES (2)")
        if fails:  # another writer changes one of the two
            Session(s.spark, s.root).sql("INSERT INTO b VALUES (9)")
            with pytest.raises(ConflictFailure):
                s.sql("COMMIT")
            assert rows(s.sql("SELECT * FROM a")) == []
        else:  # a crash before the entry is published leaves nothing of it
            with monkeypatch.context() as m:
                m.setattr("os.link", lambda *_: (_ for _ in ()).throw(OSError("crash")))
                with pytest.raises(OSError):
                    s.sql("COMMIT")
            again = Session(s.spark, s.root)
            assert rows(again.sql("SELECT * FROM a")) == [] and rows(again.sql("SELECT * FROM b")) == [(9,)]
    s.sql("BEGIN")
    s.sql("INSERT INTO a VALUES (1)")
    s.sql("INSERT INTO b VALUES (2)")
    s.sql("COMMIT")
    assert rows(s.sql("SELECT * FROM a")) == [(1,)] and sorted(rows(s.sql("SELECT * FROM b"))) == [(2,), (9,)]


def test_second_writer_of_an_entry_loses_nothing(s):
    """Two writers that read the same state: of one table the second conflicts, of another it comes after."""
    s.sql("CREATE TABLE a (id INT)")
    s.sql("CREATE TABLE b (id INT)")
    first, second = Session(s.spark, s.root), Session(s.spark, s.root)
    state = first.store.state
    a, b = (dict(state()[1])[t] for t in "ab")
    stale = state()
    second.sql("INSERT INTO a VALUES (1)")
    answers = iter([stale])
    first.store.state = lambda *x: next(answers, None) or state(*x)  # its first look is from before the other's commit
    with pytest.raises(ConflictFailure):
        first.store.commit({"a": (a, a.number)})
    answers = iter([stale])
    done = first.store.commit({"b": (b, b.number)})
    assert done["b"].number == second.store.latest("a").number + 1
    assert rows(s.sql("SELECT * FROM a")) == [(1,)]


def test_log_is_trimmed_and_tables_stay(s, monkeypatch):
    monkeypatch.setattr("loomwork.sources.store.EVERY", 3)
    filled(s, "id INT PRIMARY KEY, v INT", *(f"{k}, {k}" for k in range(10)))
    entries, states = Session(s.spark, s.root).store._listed()
    assert states == [6, 9] and entries == [7, 8, 9, 10]
    assert sorted(rows(Session(s.spark, s.root).sql("SELECT id FROM t"))) == [(k,) for k in range(10)]


def test_names_that_differ_in_case(s):
    with pytest.raises(AnalysisFailure):
        s.sql("CREATE TABLE c (a INT, A INT)")
    s.spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        s.sql("CREATE TABLE c (a INT, A INT)")
        s.sql("INSERT INTO c VALUES (1, 2)")
        assert rows(s.sql("SELECT A FROM c WHERE a = 1")) == [(2,)]
    finally:
        s.spark.conf.set("spark.sql.caseSensitive", "false")


def test_stream_into_table(s, spark):
    from loomwork.streaming.ingest import append_stream

    filled(s, "id INT PRIMARY KEY, v INT", "1, 1")
    source, check = new_folder(spark, "in"), new_folder(spark, "check")
    spark.range(2, 12).selectExpr("id", "id AS v").write.parquet(source)
    for _ in range(2):
        append_stream(s, "t", spark.readStream.schema("id long, v long").parquet(source), check).awaitTermination()
    assert s.table("t").count() == 11


def test_batch_that_runs_again_adds_nothing(s):
    filled(s, "id INT", "1")
    more = s.spark.range(2, 4).selectExpr("id")
    for number in (0, 0, 1):
        s.append("t", more, ("stream", number))
    assert s.table("t").count() == 5
