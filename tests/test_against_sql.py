"""Queries against their SQL on rows that the given tables lack."""

import duckdb
import pytest

from roadloom.plans.axis_advice import ORACLE_SQL, QUERIES

LINE = "{order} as l_orderkey, cast({n} as bigint) as l_partkey, cast(1 as bigint) as l_suppkey, {line} as l_linenumber, 20.0 as l_quantity, 1.5 as l_extendedprice"


def differences(spark, tmp_path, name: str, select: str) -> list:
    """Rows that only the query or only its SQL gives, over a lineitem of DuckDB's select; the query must give some."""
    con = duckdb.connect()
    con.execute(f"copy ({select}) to '{tmp_path}/lineitem.parquet'")
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    QUERIES[name](spark, str(tmp_path)).write.mode("overwrite").parquet(f"{tmp_path}/got")
    con.execute(f"create table want as {ORACLE_SQL[name]}")
    columns = ", ".join(f'"{c[0]}"' for c in con.execute("describe want").fetchall())
    con.execute(f"create table got as select {columns} from '{tmp_path}/got/*.parquet'")
    assert con.execute("select count(*) from got").fetchone()[0] > 0
    return con.execute("(select 'query', * from (from got except all from want)) union all (select 'sql', * from (from want except all from got))").fetchall()


#: One road around the block whose name runs from 99.6 to 10.0, for labels have two digits.
TURNED = "select " + LINE.format(order="cast(i * 12 as bigint)", n="i", line="cast(l as int)") + " from range(3960, 4040) a(i), range(1, 4) b(l)"


@pytest.mark.parametrize("name", ["parse_project_names", "validate_project_names", "control_list"])
def test_names_that_begin_behind_their_end(spark, tmp_path, name):
    assert differences(spark, tmp_path, name, TURNED) == []
