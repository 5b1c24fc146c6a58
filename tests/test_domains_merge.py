from pathlib import Path

import pytest

from wharfside import queries_index

FOLDER = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not FOLDER.exists(), reason="no test data")
def test_merge_keeps_the_present_rows_and_numbers_new_ones_after_them(spark):
    present = {tuple(r) for r in queries_index.table(spark, str(FOLDER), "domains").collect()}
    merged = [tuple(r) for r in queries_index.QUERIES["domains_merge"](spark, str(FOLDER)).collect()]
    new = sorted(r[0] for r in set(merged) - present)
    top = max(r[0] for r in present)
    assert present <= set(merged) and new == list(range(top + 1, top + 1 + len(new)))
    assert len({r[1] for r in merged}) == len(merged) and new
