"""Twins over rows that the smallest tables lack: unterminated references, large keys."""

import os

import duckdb
import pytest

from harrow.plans.queries import SQL, Q

from .compare import spark_rows, sql_rows

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def tables(tmp_path):
    """A folder of tables in which one is replaced."""

    def made(name, sql):
        for f in os.listdir(DATA):
            if f != f"{name}.parquet":
                os.symlink(f"{DATA}/{f}", tmp_path / f)
        duckdb.sql(f"copy ({sql.format(t=f'{DATA}/{name}.parquet')}) to '{tmp_path}/{name}.parquet' (format parquet)")
        return str(tmp_path)

    return made


@pytest.mark.parametrize("name", ["strip_html", "visible_text"])
def test_references_without_semicolon(spark, tables, name):
    d = tables("pages", "select * replace('<p>a &amp b &ltc &quot, x&amp</p>' || html as html) from '{t}' limit 20")
    got = spark_rows(Q[name](spark, d))
    assert got == sql_rows(SQL[name], d)
    assert all('a & b <c ", x&' in r[-1] for r in got[1])


def test_counts_beyond_belief(spark, tables):
    d = tables("customer", "select * replace(cast(c_custkey + 99900 as {k}) as c_custkey) from '{{t}}'".format(k=duckdb.sql(f"describe select c_custkey from '{DATA}/customer.parquet'").fetchall()[0][1]))
    got = spark_rows(Q["page_texts"](spark, d))
    assert got == sql_rows(SQL["page_texts"], d)
    assert {None, 99} < {r[-1] for r in got[1]}
