"""Each query of the engine proper against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from patchlight.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KEYS = {"id", "pr_id", "line", "filename", "agent_group", "name", "feature", "tier", "language"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def shown(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") and hasattr(v, "tzinfo") else str(v)


def check_tells_rows_apart(name, columns, found):
    """No query over assembled texts gives the same for all, and most features of each catalogue occur in some changes only."""
    values = [c for c in columns if c not in KEYS] or columns
    assert len({tuple(r[c] for c in values) for r in found}) > 1
    if name.startswith("feature_counts_"):
        features = [c for c in values if c not in ("total", "features")]
        assert sum(len({r[c] for r in found}) > 1 for c in features) >= 0.7 * len(features)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_same_rows_as_sql(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    found = df.collect()
    rows = sorted(tuple(map(shown, r)) for r in found)
    if plans.QUERIES[name].__module__ == "patchlight.plans.extraction":
        check_tells_rows_apart(name, df.columns, found)
    if name not in plans.ORACLE_SQL:
        assert rows
        return
    cur = con.execute(plans.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    assert rows == sorted(tuple(shown(r[i]) for i in order) for r in cur.fetchall())
