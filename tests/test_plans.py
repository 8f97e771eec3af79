"""Plan shape: pruning and pushdown reach the scan, dedup runs before the
Python scorer, fixed-size dimensions are broadcast, nothing is Cartesian."""

import pandas as pd
from pyspark.sql import functions as F

from msgshield.operators import scoring
from msgshield.operators.detect import dedup_first, filter_messages
from msgshield.operators.report import format_report
from msgshield.plans import catalog as C
from msgshield.plans import fixtures as fx

from conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_prunes_columns_and_reduces_keys_only(spark):
    p = plan(C.q_severity_counts(spark, SF_SMALL))
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in p
    assert "partial_min(" in p and "min_by" not in p          # key-only hash reduction
    assert "CartesianProduct" not in p


def test_filter_pushed_to_scan(spark):
    d = fx.documents(spark, SF_SMALL).where(F.col("lang") == "fr").select("doc_id")
    p = plan(d)
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,fr)]" in p
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in p


def test_dedup_exchange_below_python_scorer(spark):
    def factory():
        def fn(texts: pd.Series) -> pd.DataFrame:
            p = texts.str.len().clip(upper=1000) / 1000.0
            return pd.DataFrame({"abusive": p, "non-abusive": 1 - p})
        return fn
    msgs = dedup_first(filter_messages(fx.document_messages(spark, SF_SMALL)))
    scored = scoring.score_with(msgs, factory)
    p = plan(scored)
    assert p.index("ArrowEvalPython") < p.index("Exchange hashpartitioning(scope")
    rows = scored.select("pred", "scores").collect()
    assert len(rows) == msgs.count() and all(len(r.scores) == 2 for r in rows)


def test_severity_dimension_broadcast(spark):
    p = plan(format_report(fx.evidence(spark, SF_SMALL)))
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p


def test_reads_add_no_shuffle_by_size(spark):
    """A table is read as it is split; dealing it out is a caller's choice."""
    from msgshield.session import read_table
    assert "Exchange" not in plan(read_table(spark, SF_SMALL, "documents"))
    assert read_table(spark, SF_SMALL, "documents", partitions=5).rdd.getNumPartitions() == 5


def test_positions_sort_and_checkpoint_keys_only(spark):
    """No text and no screenshot below the range sort and the checkpoint."""
    from msgshield.operators.index import positions
    ev = fx.evidence(spark, SF_SMALL)
    placed = positions(ev, [F.col("timestamp").desc(), "revision", "seq"], keep=["revision", "seq"], index_col="p")
    assert placed.columns == ["revision", "seq", "p"]
    p = plan(ev.orderBy(F.col("timestamp").desc(), "revision", "seq").select("revision", "seq"))
    below = p[p.index("rangepartitioning"):].split("FileScan")[0]
    assert "screenshot" not in below and "chain_of_custody" not in below and "categories#" not in below
