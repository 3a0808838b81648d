"""Each registered query that has SQL gives DuckDB's rows."""

import math
import subprocess
import sys

import duckdb
import pytest

from inkveil.plans import catalogue, placed  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return repr(v) if isinstance(v, (bool, str)) else "-" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(columns).collect())
    want = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    places = [want.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in places) for r in want.fetchall())
    assert got


LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int"


def both_resolve(spark, folder, lines, order="rule, start, id"):
    """What the query gives on ``lines``, and what its SQL gives with its rows taken by ``order``."""
    spark.createDataFrame(lines, LINES).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    sql = catalogue.ORACLE_SQL["resolve_claims"]
    assert sql.count("ORDER BY rule, start, id)") == 1
    want = con.sql(sql.replace("ORDER BY rule, start, id)", f"ORDER BY {order})")).select("doc_id", "id").fetchall()
    got = catalogue.QUERIES["resolve_claims"](spark, str(folder)).select("doc_id", "id").collect()
    return sorted(tuple(map(plain, r)) for r in got), sorted(tuple(map(plain, r)) for r in want)


@pytest.mark.parametrize("null", [0, 1, 2, 3])
def test_claims_of_lines_with_nulls(spark, tmp_path, null):
    """No two lines of a page are tied: each has another place, or another id."""
    lines = [(i % 97, i * 7 % 300, i % 11, 1 + i // 97) for i in range(291)]
    lines = [tuple(None if k == null and i % 5 == 0 else v for k, v in enumerate(r)) for i, r in enumerate(lines)]
    got, want = both_resolve(spark, tmp_path, lines)
    assert got == want and got


def test_claims_of_lines_that_the_order_ties(spark, tmp_path):
    lines = [(i % 40, i % 40 * 8 % 150, i * 3 % 9, 1 + i % 2) for i in range(400)]
    got, want = both_resolve(spark, tmp_path, lines, 'rule, start, id, "end", claim_start, claim_end')
    assert got == want and got


def test_layout_query_finds_what_text_mode_finds(spark, sf_dir):
    layout = catalogue.QUERIES["detect_layout_items"](spark, sf_dir).where("category <> 'Address'")
    text = catalogue.QUERIES["detect_ko_all"](spark, sf_dir)
    by = lambda df, n: {r.category: r.k for r in df.groupBy("category").agg({n: "sum" if n == "n" else "count"}).toDF("category", "k").collect()}
    expected = {c: k for c, k in by(text, "n").items() if c != "Address"}
    assert {c: k for c, k in by(layout, "id").items() if c != "BankAccount"} == expected


def test_entry_point_does_without_the_llm_folder():
    code = "import sys; sys.modules['inkveil.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'detect_summary' in e.queries() and not [q for q in e.queries() if q.startswith('op') or q == 'pipeline'] and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
