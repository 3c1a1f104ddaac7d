"""The driver's entry: every query has a callable, SQL belongs to a query, and a missing library takes only the corpus queries along."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_sql_belongs_to_queries():
    found = entry.queries()
    assert len(found) > 90 and all(map(callable, found.values()))
    assert set(entry.oracle_sql()) <= set(found)


def test_entry_without_a_library_of_the_corpus_queries():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); assert 'vector_topk' in q and 'pipeline' not in q and not any(n.startswith('op1') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
