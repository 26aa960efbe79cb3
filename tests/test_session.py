"""Scratch tables in the shared folder."""
import os

from knightshift.session import cut_lineage, discard


def test_discarded_tables_leave_the_shared_folder(spark):
    a, b = cut_lineage(spark.range(10), "one"), cut_lineage(spark.range(5), "two")
    folder = lambda df: df.scratch.removeprefix("file:")
    assert os.path.isdir(folder(a)) and a.count() == 10
    discard(a)
    assert not os.path.exists(folder(a)) and b.count() == 5
    discard(b, a)          # a second time does no harm
    assert not os.path.exists(folder(b))
