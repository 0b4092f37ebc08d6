import ast
import pathlib

ROOT = pathlib.Path(__file__).parent.parent


def test_nothing_outside_imports_the_corpus_operators():
    for path in (ROOT / "sparkbrook").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path
