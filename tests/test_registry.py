"""Registered queries against their SQL on the smallest scale factor."""

import os
import re
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
CHECKED = [
    "s8_payload_flatten", "f2_complete_filter", "f7_popularity_band", "j11_feature_cascade", "a1_mood_statistics",
    "a3_listening_patterns", "a9_quality_profile", "a20_keywords", "w1_keep_first", "w3_profile_top",
    "w2_similar_to_seeds", "w7_mood_quotas", "w17_profile_discovery", "u5_overlap", "j9_resolve_titles", "p7_retrain_decision",
    "j8_pruned_join", "w4_greedy_diversity", "w9_sample", "w10_split", "w12_unresolved_by_popularity", "w13_staged_candidates",
    "p2_default_target", "p4_mood_quick", "p1_collect_gated_rows", "p1_collect_users", "p1_collect_grown_catalog",
    "s9_snapshot_profile_top", "g15_incremental_lists", "p7_growth_decision", "p8_delivered_batches", "p8_skipped_rows", "t1_stream_ingest", "a19_six_suites",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, db, name):
    mine = entry.queries()[name](spark, FOLDER).toArrow()
    cursor = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    got = rows_of(mine.column_names, zip(*[c.to_pylist() for c in mine.columns]))
    assert sorted(mine.column_names) == sorted(columns)
    assert got == rows_of(columns, cursor.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(re.fullmatch(r"(op|[a-z])\d+_[a-z0-9_]+|pipeline", name) for name in entry.queries())


def test_core_stands_alone(tmp_path):
    """Without the training-data folders and the pipeline, or without their libraries, all core queries still register."""
    here = os.path.dirname(os.path.abspath(entry.__file__))
    core = {name for name in entry.queries() if not re.fullmatch(r"op\d+_.*|pipeline", name)}
    skip = shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__")
    shutil.copytree(here, tmp_path / "bare", ignore=skip)
    shutil.copytree(here, tmp_path / "no_library", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    (tmp_path / "no_library" / "public_tokenizers.py").write_text("raise ImportError('not here')")
    for folder in ("bare", "no_library"):
        code = "import __spark_entry__ as e; print('\\n'.join(e.queries()))"
        run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / folder, capture_output=True, text=True, check=True)
        assert set(run.stdout.split()) == core
