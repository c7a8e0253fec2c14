import duckdb
import pytest

from plumbline.plans import registry
from tests import oracle
from tests.oracle import DATA, compare


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_equals_sql(spark, name):
    compare(spark, registry.QUERIES[name], registry.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_nodes_without_coefficient(spark, tmp_path, monkeypatch):
    """Nodes whose coefficient is NULL add nothing to a prediction, with fewer and with more nodes than harmonics."""
    for n in (40, 120):
        folder = tmp_path / str(n)
        folder.mkdir()
        con = duckdb.connect()
        con.sql(f"COPY (SELECT * FROM '{DATA}/customer.parquet' LIMIT 20) TO '{folder}/customer.parquet'")
        con.sql(f"COPY (SELECT i AS s_suppkey, CASE WHEN i % 3 > 0 THEN i * 37e0 - 999e0 END AS s_acctbal FROM range({n}) t(i)) TO '{folder}/supplier.parquet'")
        monkeypatch.setattr(oracle, "DATA", str(folder))
        assert compare(spark, registry.QUERIES["predict_potential"], registry.ORACLE["predict_potential"]) == 20


def test_coefficients_come_with_their_nodes(spark, monkeypatch):
    """One query on the nodes gives the basis and the coefficients."""
    asked = []
    view = registry.view
    monkeypatch.setattr(registry, "view", lambda spark, sf_dir, name: asked.append(name) or view(spark, sf_dir, name))
    registry.QUERIES["predict_potential"](spark, DATA)
    assert sorted(asked) == ["nodes", "obs_ter"]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
