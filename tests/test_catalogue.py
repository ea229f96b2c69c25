"""Registration of the queries."""

import pytest

from quarry.plans import catalogue


def test_names_are_registered_once():
    assert {"no_answer", "refusals"} <= set(catalogue.QUERIES) and {"no_answer", "refusals"} <= set(catalogue.ORACLE_SQL)
    assert "best" in catalogue.ORACLE_SQL["no_answer"] and "refused" in catalogue.ORACLE_SQL["refusals"]

    def no_answer(spark, sf):
        pass

    with pytest.raises(ValueError):
        catalogue.query()(no_answer)
