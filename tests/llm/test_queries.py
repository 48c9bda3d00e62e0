"""Every query of the package on the smallest tables, against its SQL where it has one."""

import hashlib
import os
import re

import pytest

from quire.llm import queries

DIR = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels".split()


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    got = queries.QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    with duckdb.connect() as c:
        for t in TABLES:
            c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
        n = c.execute(f"select count(*) from {'pages' if name.startswith('op1_') else 'documents'}").fetchone()[0]
        if name not in ("op5_repeated_passages", "op10_benchmark_overlaps", "ledger_ablation"):
            assert len(rows) == n  # a row for each row of the table
        if name in queries.ORACLES:
            c.execute(queries.ORACLES[name])
            names = [d[0] for d in c.description]
            want = [tuple(plain(r[names.index(k)]) for k in columns) for r in c.fetchall()]
            assert sorted(names) == columns and rows == sorted(want, key=repr)


#: The base rules of secrets, written by themselves.
BASE = (
    ("assign", re.compile(r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 1, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)


def test_secret_base_columns(spark):
    texts = ['API_KEY = "abcdef"', "Passwd:'abc' token=token: abcdefgh", "AKIA" + "Z" * 16 + "AKIA" + "1" * 30, "ü" + "0a" * 13 + " " + "f" * 23, None, "", "secret" + " " * 100_000 + "=" + "x" * 100_000, "a" * 1_000_000, "token=" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    from quire.llm import common, secrets

    ledger = secrets.Ledger(spark, common.new_path(spark, "ledger"))
    got = {r.doc_id: r for r in secrets.digest(secrets.per_path(ledger.scan(df), ledger.findings(secrets.RULES))).collect()}
    for i, text in enumerate(texts):
        spans = [(m.start(), n, kind, m.end()) for n, (kind, p, group, least) in enumerate(BASE) for m in p.finditer(text or "") if len(m[group]) >= least]
        counts = [sum(s[1] == n for s in spans) for n in range(3)]
        told = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans))
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == counts and got[i].base_sha256 == hashlib.sha256(told.encode()).hexdigest()
