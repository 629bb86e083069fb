"""Every query with SQL against DuckDB, on the smallest tables."""

import re

import duckdb
import pytest

from evidence_engine.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    return round(float(v), 6) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(str(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name not in ORACLE_SQL:
        assert got
        return
    found = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(str(tuple(plain(r[names.index(c)]) for c in columns)) for r in found.fetchall())


def test_near_dup_questions_on_whole_texts(spark, sf, db):
    from difflib import SequenceMatcher

    plain_text = lambda t: re.sub("[^0-9a-z\u4e00-\u9fff]", "", t.lower())
    b = db.execute("SELECT item_id, text FROM benchmark").fetchall()
    made = [(i, f"q{i}", plain_text(t)) for i, t in b] + [(i + 1000, f"r{i}", plain_text(t[:-4] + "??")) for i, t in b]
    want = set()
    for o, later, x in made:
        for e, earlier, y in made:
            if e < o and SequenceMatcher(None, x, y).ratio() >= 0.88:
                want.add((later, earlier, round(SequenceMatcher(None, x, y).ratio(), 9)))
    assert {(r[0], r[1], round(r[2], 9)) for r in QUERIES["near_dup_questions"](spark, sf).collect()} == want
    near = {r["question_id"] for r in QUERIES["review_queue"](spark, sf).collect() if "near_duplicate_question" in r["flags"].split(",")}
    assert near == {w[0] for w in want}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 40
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
