"""Every registered query against its SQL."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from wavemill.plans import catalog

ORACLE = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def canonical(rows):
    return Counter(tuple(f"{v:.6g}" if isinstance(v, float) and not math.isnan(v) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    assert got
    if name in ORACLE:
        cur = con.execute(ORACLE[name])
        names = [x[0] for x in cur.description]
        want = [tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()]
        assert sorted(names) == cols
        a, b = canonical(got), canonical(want)
        assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])


@pytest.mark.parametrize("name", ["phase_locked_power", "surrogate_shifts"])
def test_long_channel(spark, tmp_path, name):
    """Spikes beyond sample 60,000 of the channel count too."""
    x = spark.range(60_500).selectExpr("id as event_id", "'click' as event_type", "cast(id % 101 - 40 + if(id > 60000, 500, 0) as double) as value")
    x.write.parquet(f"{tmp_path}/events.parquet")
    df = catalog.queries()[name](spark, str(tmp_path))
    cols = sorted(df.columns)
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    cur = c.execute(ORACLE[name])
    names = [n[0] for n in cur.description]
    want = [tuple(r[names.index(n)] for n in cols) for r in cur.fetchall()]
    assert canonical([tuple(r[n] for n in cols) for r in df.collect()]) == canonical(want)


def test_edf_roundtrip_whole(spark, tmp_path):
    """Channels of any length come back whole, as near as 16 bits allow."""
    types = ["a"] * 1000 + ["b"] * 70 + ["c"] * 7 + ["d"] * 64
    x = spark.createDataFrame([(i, t, float(i % 997) - 400) for i, t in enumerate(types)], "event_id long, event_type string, value double")
    x.write.parquet(f"{tmp_path}/events.parquet")
    want = {("abcd".index(r.ch), r.idx): r.value for r in catalog.ev(spark, str(tmp_path)).df.collect()}
    got = [tuple(r) for r in catalog.queries()["edf_roundtrip"](spark, str(tmp_path)).select("ch", "idx", "value").collect()]
    assert len(got) == len(want) == len(types) and all(abs(want[c, i] - v) <= 10000 / 65535 + 0.006 for c, i, v in got)


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
