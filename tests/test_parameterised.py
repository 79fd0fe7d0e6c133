"""SQL with named parameters gives what the operators give."""

import pytest

from grantlens.operators import dossier, guards, parameterised, scoring
from grantlens.plans import inputs as i
from grantlens.plans.spending import _catalogued

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def catalogued(spark):
    _catalogued(spark, SF_DIR)
    return spark


def rows(df, like):
    return sorted((tuple(r) for r in df.select(like.columns).collect()), key=repr)


@pytest.mark.parametrize(("limit", "floor"), [(7, 3), (1000, 0), (5, 99)])
def test_feed(catalogued, limit, floor):
    want = scoring.findings_feed(i.entities(catalogued, SF_DIR), i.grants(catalogued, SF_DIR), i.loops(catalogued, SF_DIR), i.violations(catalogued, SF_DIR), limit, floor)
    got = parameterised.findings_feed(catalogued, limit, floor)
    assert sorted(got.columns) == sorted(want.columns) and rows(got, want) == rows(want, want)


@pytest.mark.parametrize("code", ["h3 A0b1", "H3A0B1", "' OR true --", ""])
def test_postal(catalogued, code):
    want = dossier.postal_lookup(i.entities(catalogued, SF_DIR), code, 3)
    got = parameterised.postal_lookup(catalogued, code, 3)
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]


@pytest.mark.parametrize("null_safe", [True, False])
def test_payments(catalogued, null_safe):
    want = guards.clean_payments(i.payments(catalogued, SF_DIR), null_safe=null_safe)
    assert rows(parameterised.clean_payments(catalogued, null_safe), want) == rows(want, want)
