"""Queries of the catalogues against their SQL, and that no function of theirs uses a name that its module lacks."""

import builtins
import dis
import types
from pathlib import Path

import pytest

from tideway import catalogue, catalogue_more, catalogue_roads
from tideway.operators import graph


def _globals(code: types.CodeType) -> set[str]:
    own = {i.argval for i in dis.get_instructions(code) if i.opname == "LOAD_GLOBAL"}
    return own.union(*[_globals(c) for c in code.co_consts if isinstance(c, types.CodeType)])


@pytest.mark.parametrize("module", [catalogue, catalogue_more, catalogue_roads], ids=lambda m: m.__name__)
def test_names_are_there(module):
    known = set(vars(module)) | set(vars(builtins))
    assert not _globals(compile(Path(module.__file__).read_text(), module.__file__, "exec")) - known


def test_column_totals(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(1, 30000.5), (1, 19999.0), (1, None), (2, 5.0), (2, 20000.0), (3, 20001.25), (3, 70000.0), (None, 40000.0), (4, None)]
    spark.createDataFrame(rows, "l_linenumber int, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = catalogue.QUERIES["column_totals"](spark, str(tmp_path))
    assert found.dtypes == [("weekday", "bigint"), ("km", "double")]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    expected = con.execute(catalogue.SQL["column_totals"]).fetchall()
    none_first = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(map(tuple, found.collect()), key=none_first) == sorted(expected, key=none_first)


def _against_sql(spark, tmp_path, module, name, tables):
    """Both results of a query over tables {name: (rows, schema)}, sorted."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{table}.parquet"))
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    found = module.QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({module.SQL[name]})").fetchall()
    return sorted(map(tuple, found.collect())), sorted(want)


def test_cut_edges_of_one_place(spark, tmp_path):
    """Parts 1 and 171 stand at one place: the edge between them is of no pieces."""
    tables = {
        "part": ([(1, 900.0), (171, 900.0), (2, 905.0), (90, 4000.0)], "p_partkey long, p_retailprice double"),
        "orders": ([(4, "O"), (5, "F")], "o_orderkey long, o_orderstatus string"),
        "lineitem": ([(4, 1, 1), (4, 2, 171), (4, 3, 90), (5, 1, 2), (5, 2, 1)], "l_orderkey long, l_linenumber int, l_partkey long"),
    }
    got, want = _against_sql(spark, tmp_path, catalogue_more, "cut_edges", tables)
    assert got == want and want[0] == (0, 0, 0.0)


def test_simple_paths_beyond_the_bound_of_the_sql(spark, tmp_path):
    """From part 39 the only way to part 118 has eleven streets: it is none of those of up to nine that the SQL asks for."""
    both = {5 * 40 + 38, 5 * 40 + 37, 4 * 40 + 37, 3 * 40 + 37, 2 * 40 + 37}
    tables = {
        "part": ([(k, 1 if k in both else 7) for k in range(240)], "p_partkey long, p_size int"),
        "supplier": ([(39,), (0,), (119,)], "s_suppkey long"),
    }
    got, want = _against_sql(spark, tmp_path, catalogue_roads, "simple_paths", tables)
    assert got == want and {r[0] for r in want} == {0, 119}


def test_long_edges_are_cut_after_one_join(spark):
    """Short, long, one-way and unplaced edges in one join, over edges that are made once."""
    nodes = spark.createDataFrame([(i, i * 1.0, 0.0) for i in range(1, 5)], "id long, lat double, lon double")
    edges = spark.createDataFrame([(1, 2, 120.0, "x"), (2, 1, 120.0, "y"), (3, 2, 90.0, "z"), (3, 4, 40.0, "w"), (4, 9, 500.0, "v"), (1, 1, 0.0, "u")], "src long, dst long, len_m double, name string")
    new, cut = graph.break_long_edges(nodes, edges, 50.0)
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    got = sorted((r.name, r.src, r.dst, r.len_m) for r in cut.collect())
    assert got == sorted([("x", 1, 5, 40.0), ("x", 5, 6, 40.0), ("x", 6, 2, 40.0), ("y", 2, 6, 40.0), ("y", 6, 5, 40.0), ("y", 5, 1, 40.0), ("z", 3, 7, 45.0), ("z", 7, 2, 45.0), ("w", 3, 4, 40.0), ("v", 4, 9, 500.0), ("u", 1, 1, 0.0)])
    assert sorted((r.id, round(r.lat, 6)) for r in new.collect())[4:] == [(5, 1.333333), (6, 1.666667), (7, 2.5)]
