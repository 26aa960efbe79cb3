"""Constraints of the data model, checked over rows that break them."""
import re

from conftest import SF_MID
from knightshift import schemas
from knightshift.operators import quality as Q
from knightshift.plans.model_fixture import MODEL, model_tables


def test_every_constraint_is_checked_and_broken_ones_are_seen(spark):
    tables = model_tables(spark, SF_MID)
    assert list(tables) == list(MODEL) and set(tables) == set(schemas.TABLES)
    got = {(r.constraint_type, r.table_name, r.column_names): (r.violations, r.detail) for r in Q.check_model(tables).collect()}
    keys = {("primary_key", t, ",".join(k)) for t, k in schemas.PRIMARY_KEYS.items()}
    refs = {("foreign_key", c, f"{col}->{p}.{pc}") for c, col, p, pc in schemas.FOREIGN_KEYS}
    required = {("not_null", t, c) for t in schemas.TABLES for c in schemas.not_null_columns(t)}
    lengths = {("length", t, c) for t, cs in schemas.LENGTHS.items() for c in cs}
    assert set(got) == keys | refs | required | lengths and len(keys) == 12 and len(refs) == 14
    assert all(sum(got[k]) > 0 for k in keys) and all(got[k][0] > 0 for k in refs | lengths)
    assert sum(got[k][0] > 0 for k in required) >= 28


def test_a_table_is_scanned_once_for_its_own_constraints(spark):
    for name in ("puzzle_evaluations", "games"):
        plan = Q.check_table(model_tables(spark, SF_MID)[name], name)._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"FileScan parquet", plan.split("== Initial Plan ==")[-1])) == 1


def test_empty_tables_break_nothing(spark):
    empty = {t: spark.createDataFrame([], s) for t, s in schemas.TABLES.items()}
    assert {r.violations for r in Q.check_model(empty).collect()} == {0}
