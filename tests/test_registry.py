import ast
import pathlib

import __spark_entry__ as entry
from cairnflow.plans import catalog, tools

ROOT = pathlib.Path(__file__).resolve().parents[1]


def test_registry():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(catalog.sql()) <= set(catalog.queries()) and set(s) <= set(q) and len(catalog.queries()) > 120
    assert all(callable(f) for f in q.values()) and "p4_found" in q
    assert len(tools.TOOLS) == 23


def test_the_core_does_not_import_the_training_data_operators():
    for p in (ROOT / "cairnflow").rglob("*.py"):
        if "llm" in p.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any(n.startswith("cairnflow.llm") for n in names), p


def test_tools(spark):
    from tests.oracle import SF

    t = {n: spark.read.parquet(f"{SF.replace('sf0.01', 'sf0.001')}/{n}.parquet") for n in ("raw_memories", "memories", "associations", "retrieval_feedback")}
    one = t["memories"].select("id").orderBy("id").first()[0]
    assert tools.forget(t, [one]).filter("state = 'archived'").count() >= 1
    assert tools.check_memory(t, one).count() == 1 and tools.status(t).count() == 1
    assert tools.audit_encodings(t).count() == 20 and tools.get_patterns(t).count() >= 0
    new = spark.createDataFrame([("new-1", "mcp", "decision", "we chose parquet")], "id string, source string, type string, content string")
    assert tools.create_handoff(t, new).filter("id = 'new-1'").select("initial_salience").first()[0] == 0.95
