import hashlib
import re

from msgshield.llm import secrets
from .helpers import EDGE_ROWS, clashing, edge_docs, empty_docs, rows

BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                          re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
TEXTS = [
    None, "", "nothing", "Token = 'abc' token: abcdefgh", "token=token: abcdefgh", "secret=secret=abcdef",
    "API_KEY:\"x1y2z3w4\" apikey=short api_key==abcd12", "AKIA" + "Z" * 15, "AKIA" + "Z" * 16 + " AKIAAKIA" + "0" * 12,
    "é😀 password = " + "f" * 30 + " tail", "0123456789abcdef" * 3 + "g" + "a" * 23, "passwd:" + "deadbeef" * 4 + "\npasswd:ok",
    "ſecret=abcdefgh toKen=abcdefgh PASSWORD=ABCDEF", "x" * 5000 + "token=abcdef" + "y" * 5000, "token=abcdef " * 300,
]


def plain_spans(text):
    out = []
    for k, (kind, pattern, group, least) in enumerate(BASE):
        for m in pattern.finditer(text or ""):
            if len(m.group(group)) >= least:
                out.append((m.start(), k, kind, m.end()))
    return ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in sorted(out))


def test_spans_match_brute_force(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(99, TEXTS[9])], "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.secret_report(docs).collect()}
    assert len(got) == len(TEXTS) + 1 and got[99].spans == got[9].spans
    for i, t in enumerate(TEXTS):
        want = plain_spans(t)
        assert got[i].spans == want, (i, t[:60] if t else t)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [
            sum(s.startswith(k) for s in want.split(",")) for k in ("assign", "access", "hex")]


def test_ledger_scans_only_unseen_pairs(spark, tmp_dir):
    def docs(*r):
        return spark.createDataFrame(list(r), "path long, text string")

    def scanned():
        return sorted((r.rule, r.version, r.blob[:6], r.batch) for r in spark.read.parquet(f"{tmp_dir}/l/scanned").collect())
    first = secrets.scan(docs((1, "token=abcdef"), (2, "plain")), f"{tmp_dir}/l")
    assert {r.path: [s.rule for s in r.spans] for r in first.collect()} == {1: ["assign"], 2: []}
    one = scanned()
    assert len(one) == 6
    again = secrets.scan(docs((1, "token=abcdef"), (3, "token=abcdef"), (4, "AKIA" + "Q" * 20)), f"{tmp_dir}/l")
    assert {r.path: [s.rule for s in r.spans] for r in again.collect()} == {1: ["assign"], 3: ["assign"], 4: ["access"]}
    two = scanned()
    assert len(two) == 9 and set(one) < set(two)              # three pairs for the one new blob
    newer = tuple(secrets.Rule("assign", r"token=([a-z]+)", 1, 1, version=2) if r.name == "assign" else r for r in secrets.RULES)
    last = secrets.scan(docs((1, "token=abc"), (5, "token=abcdef")), f"{tmp_dir}/l", newer)
    assert {r.path: [(s.start, s.stop) for s in r.spans] for r in last.collect()} == {1: [(0, 9)], 5: [(0, 12)]}
    three = scanned()
    # One new blob under three rules, and the old blob under the changed rule alone.
    assert len(three) == 13 and sum(v == 2 for _, v, _, _ in three) == 2


def test_findings_of_a_batch_that_died_do_not_count(spark, tmp_dir):
    lost = spark.createDataFrame([(hashlib.sha256(b"plain").hexdigest(), "hex", 1, 0, 5, "dead")], secrets._FINDINGS)
    lost.write.parquet(f"{tmp_dir}/l/findings")
    got = secrets.scan(spark.createDataFrame([(1, "plain")], "path long, text string"), f"{tmp_dir}/l").first()
    assert got.spans == []


def test_edges(spark):
    got = rows(secrets.secret_report(edge_docs(spark)))
    assert got == rows(secrets.secret_report(clashing(edge_docs(spark)))) and len(got) == 12
    assert {r.doc_id: r.spans for r in secrets.secret_report(edge_docs(spark)).collect()}[5] == plain_spans(EDGE_ROWS[6][1]) != ""
    assert secrets.secret_report(empty_docs(spark)).count() == 0
