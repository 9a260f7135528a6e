import os

import pytest

ROOT = "/root/testdata/sf0.001"


def test_core_does_not_need_the_rest():
    import subprocess
    import sys
    from pathlib import Path

    here = Path(__file__).resolve().parent.parent
    code = "import sys; sys.modules['docweave.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p4_found' in q and 'p1_found' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=here, check=True)


@pytest.mark.skipif(not os.path.exists(ROOT), reason="needs the test tables")
def test_every_core_query_runs(spark):
    from docweave.plans import registry

    assert set(registry.oracle_sql()) <= set(registry.queries())
    for name, f in registry.queries().items():
        assert f(spark, ROOT).limit(5).collect() is not None, name
