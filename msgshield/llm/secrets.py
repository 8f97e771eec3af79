"""Secret scans with an incremental blob ledger.

Every version of every path is content-addressed: its blob is the SHA-256 of the text.
The ledger is a folder with two tables, ``scanned`` (blob, rule, rule version) and
``findings`` (the spans found). A scan takes the pairs of blob and rule version that are
not in the ledger, scans each blob's text once however many paths hold it, appends both
tables and joins the findings back to all paths. Changing a rule's version rescans with that
rule alone.

A rule's spans come from two arrays of one text, the matches and the pieces between them; their
running lengths are the positions (code points, end exclusive).

Writes are appended per batch under the batch's name, findings before pairs, and a
finding counts only with its pair of the same batch, so a batch that dies half way leaves nothing
that counts and is scanned again.

Defined results: null text is the empty blob; repeated rows and paths each get their
blob's findings; no rows give no rows. Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import prepare, scratch_path, written


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str           # may use a group for the part whose length counts
    least: int             # code points that part must have
    group: int = 0
    version: int = 1


# Fixed values of the query. Maximal runs need no shorter match first, so the run of
# hex digits carries its length in the pattern and common short runs are not matches.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)

_SCANNED = "blob string, rule string, version int, batch string"
_FINDINGS = "blob string, rule string, version int, start long, stop long, batch string"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _matches(rule: Rule) -> Column:
    """Array of one rule's matches in ``text``: their order, the gap before, sizes."""
    p = F.lit(rule.pattern)
    sizes = F.arrays_zip(
        F.transform(F.regexp_extract_all("text", p, F.lit(0)), F.length).alias("size"),
        F.transform(F.regexp_extract_all("text", p, F.lit(rule.group)), F.length).alias("counted"),
        F.transform(F.split("text", rule.pattern, -1), F.length).alias("gap"))
    rows = F.transform(F.filter(sizes, lambda m: m["size"].isNotNull()), lambda m, i: F.struct(
        F.lit(rule.name).alias("rule"), F.lit(rule.version).alias("version"), i.alias("i"),
        m["gap"].alias("gap"), m["size"].alias("size"), (m["counted"] >= rule.least).alias("kept")))
    return F.when(~F.array_contains("done", rule.name) & F.col("text").rlike(rule.pattern), rows).otherwise(
        F.array().cast("array<struct<rule:string,version:int,i:int,gap:int,size:int,kept:boolean>>"))


def find(texts: DataFrame, rules) -> DataFrame:
    """``(blob, rule, version, start, stop)`` in texts of distinct blobs, all rules in one pass."""
    each = texts.select("blob", F.explode(F.concat(*[_matches(r) for r in rules])).alias("m")).select("blob", "m.*")
    upto = Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return (each.withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(upto)).where("kept")
                .select("blob", "rule", "version", (F.col("stop") - F.col("size")).alias("start"), "stop"))


def scan(versions: DataFrame, ledger: str, rules=RULES) -> DataFrame:
    """Scan what the ledger has not seen; ``(path, blob, spans)`` for every version.

    ``versions`` has ``path`` and ``text``. ``spans`` is an array of ``(start, kind, stop,
    rule)``, sorted by start and then by the rule's place in ``rules``.
    """
    spark = versions.sparkSession
    prepare(spark)
    batch = uuid.uuid4().hex
    named = versions.select("path", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "blob", F.sha2(F.col("text").cast("binary"), 256))
    paths = written(named.select("path", "blob"), "secret-paths")
    current = F.create_map(*[x for r in rules for x in (F.lit(r.name), F.lit(r.version))])
    kinds = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))])

    before = _read(spark, f"{ledger}/scanned", _SCANNED)
    done = (before.where(F.element_at(current, F.col("rule")) == F.col("version"))
                  .groupBy("blob").agg(F.collect_set("rule").alias("done")))
    texts = named.select("blob", "text").dropDuplicates(["blob"])
    if before.isEmpty():
        texts = texts.withColumn("done", F.array().cast("array<string>"))
    else:
        texts = (texts.join(done, "blob", "left").withColumn(
            "done", F.coalesce("done", F.array().cast("array<string>"))).where(F.size("done") < len(rules)))

    find(texts, rules).withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{ledger}/findings")
    pairs = (paths.select("blob").distinct()
                  .withColumn("rule", F.explode(F.array(*[F.lit(r.name) for r in rules])))
                  .withColumn("version", F.element_at(current, F.col("rule"))))
    (pairs.join(before.select("blob", "rule", "version"), ["blob", "rule", "version"], "left_anti")
          .withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{ledger}/scanned"))

    scanned = _read(spark, f"{ledger}/scanned", _SCANNED)
    found = _read(spark, f"{ledger}/findings", _FINDINGS).join(
        scanned, ["blob", "rule", "version", "batch"], "left_semi")
    spans = (found.where(F.element_at(current, F.col("rule")) == F.col("version"))
                  .groupBy("blob").agg(F.array_sort(F.collect_list(F.struct(
                      "start", F.element_at(kinds, F.col("rule")).alias("kind"), "stop", "rule"))).alias("spans")))
    return (paths.join(spans, "blob", "left")
                 .withColumn("spans", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType))))


def secret_report(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """Counts per kind and the spans of every document."""
    spark = docs.sparkSession
    prepare(spark)
    found = scan(docs.select(F.col("doc_id").alias("path"), "text"), ledger or scratch_path(spark, "secret-ledger"))
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["rule"], s["start"], s["stop"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["rule"] == F.lit(kind))).cast("long").alias(f"n_{kind}")

    return found.select(F.col("path").alias("doc_id"), count("assign"), count("access"), count("hex"),
                        F.sha2(text.cast("binary"), 256).alias("base_sha256"), text.alias("spans"))
