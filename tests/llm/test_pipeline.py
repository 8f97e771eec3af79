import os
import subprocess
import sys

import corpus_pipeline
from msgshield.llm.common import DOCUMENT_COLUMNS, table
from .helpers import SMALL, edge_docs, empty_docs, words
from .test_simhash import plain_fingerprint, plain_groups

LABELLED = "/root/testdata/sf0.01"       # large enough to learn labels from
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages_in_order(spark):
    docs = table(spark, LABELLED, "documents")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], LABELLED).cache())
        if name != "pack":
            assert frames[-1].columns == list(DOCUMENT_COLUMNS)
    given, clean, lined, single, mixed, packed = [f.collect() for f in frames]
    toxic = {r.doc_id for r in spark.read.parquet(f"{LABELLED}/labels.parquet").where("toxic = 1").collect()}
    gone = {r.doc_id for r in given} - {r.doc_id for r in clean}
    labelled = {r.doc_id for r in spark.read.parquet(f"{LABELLED}/labels.parquet").collect()}
    assert gone & toxic and not (gone & labelled) - toxic
    assert {r.doc_id for r in lined} == {r.doc_id for r in clean} and all(r.n_chars == len(r.text) for r in lined)
    groups = plain_groups({r.doc_id: plain_fingerprint(r.text) for r in lined})
    assert {r.doc_id for r in single} == set(groups.values()) and len(single) == len(set(groups.values()))
    size = sum(len(words(r.text)) for r in single)
    assert abs(sum(len(words(r.text)) for r in mixed) - size) <= 0.02 * size
    texts = {r.doc_id: r.text for r in mixed}
    copies = {i: sum(r.doc_id == i for r in mixed) for i in texts}
    assert sum(p.length for p in packed) == sum(
        c * next(p.doc_tokens for p in packed if p.doc_id == i) for i, c in copies.items())


def test_stages_take_odd_and_empty_tables(spark):
    for docs in (edge_docs(spark), empty_docs(spark)):
        for _, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), stage(spark, docs, SMALL).schema)


def test_the_rest_imports_without_the_subpackage(tmp_path):
    """A copy without ``llm`` and the pipeline still registers the other queries."""
    import shutil
    shutil.copytree(os.path.join(ROOT, "msgshield"), tmp_path / "msgshield", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') or k == 'pipeline' for k in q), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True,
                         env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0, out.stderr
    n, has, oracles = out.stdout.split()
    assert int(n) > 60 and has == "False" and int(oracles) > 60
