"""Every query of the library against its SQL on the smallest tables; those without SQL must give rows."""

import math
import os
from pathlib import Path

import pytest

from palisade.plans import building, evaluating, gating, reports, scanning  # noqa: F401
from palisade.plans.registry import ORACLE_SQL, QUERIES

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.10g}") + 0.0
    return x.isoformat() if hasattr(x, "isoformat") else x


@pytest.fixture(scope="module")
def con():
    import duckdb

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    rows = [tuple(map(plain, r)) for r in df.select(*columns).collect()]
    assert rows
    if name in ORACLE_SQL:
        found = con.execute(ORACLE_SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        want = [tuple(plain(r[i]) for i in at) for r in found.fetchall()]
        key = lambda r: [(v is None, str(v)) for v in r]
        assert sorted(rows, key=key) == sorted(want, key=key)


def test_planted_markup_is_found(spark):
    got = QUERIES["e10_planted_html"](spark, str(DATA)).collect()
    assert all(r["found"] for r in got)
    assert {r["category"] for r in got if "html_attribute_text" in r["flags"]} == {"attr_id"}


def test_no_query_holds_a_row_limit_but_the_stated_ones(spark):
    limited = {n for n, q in QUERIES.items() if "Limit" in q(spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()}
    # the first n of each group is what f6 (which flags all rows) and f9 are about; Spark limits groups before a window
    assert limited == {"f8_first_messages", "f10_seeded_sample", "f6_first_images", "f9_top_revealed"}
