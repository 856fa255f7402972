"""Rules that hold for the whole repository."""

import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_outside_imports_the_corpus_operators():
    for path in (ROOT / "parcelspark").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), path


def test_every_query_has_sql_or_is_listed():
    from parcelspark import plans

    without = set(plans.queries()) - set(plans.oracle_sql())
    assert without == {"sample_n", "sample_per_group", "transitions", "pairwise", "mpc_plan", "ward_blocks"}


def test_entry_has_a_row(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
