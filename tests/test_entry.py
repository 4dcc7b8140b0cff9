import numbers
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
HERE = Path(__file__).resolve().parent.parent


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def _registered(*modules: str) -> list[str]:
    """Names of the queries with SQL that the modules register."""
    text = "".join((HERE / "lattica" / m).read_text() for m in modules)
    return [n for n in re.findall(r'@query\("(\w+)"', text) if n in entry.oracle_sql()]


def _plain(value) -> str:
    """A value without its engine's type: numbers alike, whatever their width, and all kinds of nothing alike."""
    if isinstance(value, (list, np.ndarray)):
        return str([_plain(x) for x in value])
    if pd.isna(value):
        return "null"
    return f"{float(value):.6f}" if isinstance(value, (numbers.Number, np.number)) and not isinstance(value, (bool, np.bool_)) else str(value)


def _rows(df: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(map(_plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))


MOST = ["set_measures", "hubs", "network_without_hubs", "clustering_coefficient", "fisher_tables", "expr_rank", "expr_spearman", "empirical_fdr", "permuted_scores", "maf_site_frequency", "configuration_model", "bfs_distances", "simple_cycles"]


@pytest.mark.parametrize("name", [*MOST, *_registered("file_queries.py", "report_queries.py", "structure_queries.py", "value_queries.py")])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_library_stands_without_the_text_subpackage(tmp_path):
    code = "import sys; sys.path[:0] = [sys.argv[1]]; import __spark_entry__ as e; assert e.queries() and 'pipeline' not in e.queries() and not any(k.startswith('op1') for k in e.queries())"
    for part in ("__spark_entry__.py", "lattica"):
        target = tmp_path / part
        if part.endswith(".py"):
            target.write_text((HERE / part).read_text())
            continue
        for f in (HERE / part).rglob("*.py"):
            if "llm" not in f.parts:
                to = target / f.relative_to(HERE / part)
                to.parent.mkdir(parents=True, exist_ok=True)
                to.write_text(f.read_text())
    subprocess.run([sys.executable, "-c", code, str(tmp_path)], check=True, cwd=tmp_path)
    (tmp_path / "lattica/llm").mkdir()
    (tmp_path / "lattica/llm/__init__.py").write_text("")
    (tmp_path / "lattica/llm/queries.py").write_text("import no_such_module_anywhere\n")
    subprocess.run([sys.executable, "-c", code, str(tmp_path)], check=True, cwd=tmp_path)
