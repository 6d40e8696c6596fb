"""The driver's contract."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    known = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(known)
    assert all(callable(q) for q in known.values())


def test_registry_without_the_corpus_part(tmp_path):
    """The rest imports when evidra/llm and corpus_pipeline.py are gone."""
    top = Path(__spark_entry__.__file__).parent
    for f in [top / "__spark_entry__.py", *(p for p in (top / "evidra").rglob("*.py") if "llm" not in p.relative_to(top).parts)]:
        to = tmp_path / f.relative_to(top)
        to.parent.mkdir(parents=True, exist_ok=True)
        to.write_bytes(f.read_bytes())
    code = "import __spark_entry__ as e; n = e.queries(); assert 'search_substring' in n and 'pipeline' not in n and not any(k.startswith('op') for k in n)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": "/tmp"})
