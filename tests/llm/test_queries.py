"""Registered queries: whole tables, stable columns, and the SQL forms where there are any."""

from __future__ import annotations

import ast
import pathlib

import pytest

from strata.llm.queries import ORACLE_SQL, QUERIES

ROOT = pathlib.Path(__file__).resolve().parents[2]
COLUMNS = {
    "op1_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op3_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op4_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op5_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op8_url_filters": ["page_id", "host", "path", "rule", "verdict"],
    "op9_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op10_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op11_conversation_trie": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
    "op12_ranked_search": ["item_id", "rank", "doc_id", "score"],
    "op13_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
}


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_whole_table_and_columns(spark, name):
    sf = "/root/testdata/sf0.001"
    out = QUERIES[name](spark, sf)
    table = "pages" if name.startswith("op8") else "documents"
    assert out.columns[: len(COLUMNS.get(name, []))] == COLUMNS.get(name, [])
    if name.startswith(("op11", "op12")):  # one row per node and per hit: held against SQL below
        assert out.count() > 0
        return
    assert out.count() == spark.read.parquet(f"{sf}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, duck, name):
    sf = "/root/testdata/sf0.01"
    got, want = QUERIES[name](spark, sf).toPandas(), duck(sf).execute(ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    got, want = (df[cols].astype(object).where(df[cols].notna(), None).values.tolist() for df in (got, want))
    assert sorted(map(_row, got)) == sorted(map(_row, want))


def _row(values):
    """A row in one spelling: pandas turns whole numbers beside nulls into floats."""
    return tuple(str(int(v)) if isinstance(v, float) and v.is_integer() else str(v) for v in values)


def _imports(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.ImportFrom):
            yield node.module or ""
        elif isinstance(node, ast.Import):
            yield from (a.name for a in node.names)


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "strata").rglob("*.py"):
        if "llm" not in path.parts:
            assert not any(m.startswith(("strata.llm", "corpus_pipeline")) for m in _imports(path)), path


@pytest.mark.parametrize("name", ["fingerprint", "line_dedup", "mixing"])
def test_native_operators_use_no_python_in_tasks(name):
    text = (ROOT / "strata" / "llm" / f"{name}.py").read_text()
    assert not any(word in text for word in ("pandas", "Arrow", "udf", ".rdd", "numpy"))
