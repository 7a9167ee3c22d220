"""PRJ-5 as views over a session variable."""

import os

import pytest

from ledgerlens.operators import marts as M
from ledgerlens.operators import staging as S
from ledgerlens.sources import fixtures as FX
from ledgerlens.sources import tenant_views as V


@pytest.fixture()
def own(spark, sf_dir, scratch):
    """A session of its own, so the variable is too."""
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "UTC")
    FX.tx(session, sf_dir).write.parquet(os.path.join(scratch, "tx"))
    V.create_tenant_views(session, {"transactions": session.read.parquet(os.path.join(scratch, "tx")),
                                    "memberships": FX.memberships(session, sf_dir)})
    return session


def test_no_tenant_no_rows(own):
    for org in (None, ""):
        V.set_tenant(own, org)
        for query in ("SELECT count(*) FROM transactions", "SELECT * FROM memberships", "SELECT * FROM transactions WHERE org_id = '1'"):
            with pytest.raises(Exception, match="no tenant is set"):
                own.sql(query).collect()


def test_each_tenant_sees_its_own_rows(own, spark, sf_dir):
    everything = FX.tx(spark, sf_dir).groupBy("org_id").count().collect()
    for r in everything:
        V.set_tenant(own, r.org_id)
        assert [tuple(x) for x in own.sql("SELECT org_id, count(*) FROM transactions GROUP BY 1").collect()] == [(r.org_id, r["count"])]
        assert own.sql("SELECT * FROM transactions WHERE org_id <> session.ledgerlens_tenant OR true").where(f"org_id <> '{r.org_id}'").isEmpty()
    V.set_tenant(own, "1' OR '1' = '1")
    assert own.table("transactions").isEmpty()
    V.set_tenant(own, "1")
    stg = S.stg_transactions(own.table("transactions"))
    want = M.fct_monthly_revenue(S.stg_transactions(FX.tx(spark, sf_dir)), "1")
    assert sorted(map(str, M.fct_monthly_revenue(stg).collect())) == sorted(map(str, want.collect()))


def test_the_predicate_reaches_the_scan(own):
    V.set_tenant(own, "1")
    plan = own.sql("SELECT sum(amount) FROM transactions")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(org_id,1)" in plan and "raise_error" not in plan, plan


def test_a_table_without_tenants_is_refused(spark):
    with pytest.raises(ValueError, match="org_id"):
        V.create_tenant_views(spark.newSession(), {"plain": spark.range(1)})
