import os
import subprocess
import sys

import corpus_pipeline

from .conftest import SMALL

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_every_operator_is_registered():
    import __spark_entry__ as entry
    names = entry.queries()
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


def test_pipeline_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), docs.schema)
        assert docs.columns == columns
        left = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert left <= ids and len(left) > 100
        ids = left
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()


def test_rest_works_without_the_subpackage():
    code = ("import sys; sys.modules['adyield.llm'] = None; import __spark_entry__ as e;"
            "assert len(e.queries()) > 100 and not any(k.startswith('op') for k in e.queries()) and e.oracle_sql()")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
