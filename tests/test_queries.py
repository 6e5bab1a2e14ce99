"""Some registered queries against their SQL on the smallest tables, and the driver's contract."""

import math
import os

import pytest

import __spark_entry__ as entry
from tidemark.plans import ensemble_queries, source_queries

DATA = "/root/testdata/sf0.001"
NAMES = ["z6_frozen_domain", "z10_frozen_conditional", "z13_domain_paths", "p18_arsenal", "p21_priors", "w8_prefix_inversion", "a17_probability_metrics", "a20_grouped_evaluation", "u4_keep_last", "o1_stable_sort", "o4_mixed_sort", "j10_positional_alignment", "v5_canonical_invariants", "a10_candidate_summary", "p21_season_prior", "e6_gate_grid", "d2_fold_validation", "m9_joint_to_success", "a26_robust_scale", "a22_anchor_shares", "e3_simplex_blend", "e5_core_and_final", "m6_indicators", "v12_independent_rows", "k1_verified_table", "s12_bundle_round_trip", "u6_name_sets", "v2_split_overlap", "j7_outer_add"]


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "~"
    return repr(round(float(x), 8)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    import duckdb

    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{t}'")
    con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in con.description]
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in con.fetchall())
    assert sorted(names) == columns and got == want


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "z6_frozen_domain" in entry.queries()


def test_names_are_known_without_a_session():
    """The driver asks for names and SQL before there is a session."""
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert e.oracle_sql() and set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.abspath(entry.__file__)), capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_blends_read_rows_that_are_written_once(spark, monkeypatch):
    """Two passes for moments and the result: none of them shuffles the rows again."""
    seen, core = [], ensemble_queries.E.core_and_final
    monkeypatch.setattr(ensemble_queries.E, "core_and_final", lambda df, *a: seen.append(df) or core(df, *a))
    entry.queries()["e5_core_and_final"](spark, DATA)
    assert all("/bound-" in f for f in seen[0].inputFiles()) and len(seen[0].columns) == 11


def test_rows_are_told_apart_by_a_number(spark, monkeypatch):
    keys, found = [], source_queries.dependent_rows
    monkeypatch.setattr(source_queries, "dependent_rows", lambda f, past, now, key, *a: keys.append([past.select(key).dtypes, now.count() - now.select(key).distinct().count()]) or found(f, past, now, key, *a))
    entry.queries()["v12_independent_rows"](spark, DATA)
    assert keys == [[[("id", "bigint")], 0]] * 2
