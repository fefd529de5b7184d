"""Every query of the catalogue against its SQL, on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from lakelens.plans import catalog

FOLDER = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()
CASES = catalog.cases()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    same(catalog.queries()[name](spark, FOLDER), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(CASES))
def test_cases_over_inline_records(spark, duck, name):
    f, sql = CASES[name]
    assert name not in catalog.queries()
    same(f(spark, FOLDER), duck, sql)


def test_near_duplicate_flags_with_shared_ids_and_odd_characters(spark, tmp_path):
    """Items 10,000 apart share ids with the batch's second half; capitals, white space and blanks as SQL takes them."""
    odd = ["a\u000bb   c", "Straße İstanbul ΟΣ ende", "\u00a0nbsp words here\u00a0", "\u2003em space\u3000", "ΑΣ ΟΔΟΣ ΣΣΣ words alpha", "x\u0085y zz", "tail newline\n", "ab", "", None]
    texts = odd + [None if x is None else x.lower() + " " for x in odd]
    con = duckdb.connect()
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", [(i, x) for i, x in enumerate(texts)])
    con.execute(f"INSERT INTO benchmark SELECT 10000 * k + item_id, text FROM (SELECT * FROM '{FOLDER}/benchmark.parquet' WHERE item_id < 8), range(3) r(k)")
    con.execute(f"COPY benchmark TO '{tmp_path}/benchmark.parquet' (FORMAT parquet)")
    same(catalog.queries()["near_duplicate_flags"](spark, str(tmp_path)), con, SQL["near_duplicate_flags"])


def same(df, duck, sql):
    names = sorted(df.columns)
    got = sorted([plain(r[c]) for c in names] for r in df.collect())
    found = duck.execute(sql)
    held = [c[0] for c in found.description]
    assert sorted(held) == names
    assert got == sorted([plain(r[held.index(c)]) for c in names] for r in found.fetchall())
