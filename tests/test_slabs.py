"""Trajectories by slabs of frames, which are one frame here, against SQL over all faces."""

import pytest
from support import SF, spark_rows

from swirlframe import queries as q
from swirlframe.operators import critical
from swirlframe.plans import components, slabs


@pytest.mark.parametrize("name", ["cp_links", "cp_components", "cp_curves"])
def test_slabs_of_a_frame(spark, duck, monkeypatch, name):
    monkeypatch.setattr(slabs, "FACES_AT_ONCE", 1)
    assert spark_rows(q.QUERIES[name](spark, SF)) == duck(q.SQL[name])


def test_only_what_slabs_share_is_connected(spark, monkeypatch):
    """A round goes over the faces that slabs share, not over all links."""
    seen, connected = [], components.connected
    monkeypatch.setattr(components, "connected", lambda edges, *a: (seen.append(edges.count()), connected(edges, *a))[1])
    monkeypatch.setattr(slabs, "FACES_AT_ONCE", 12 * 800 * 5)
    assert q.QUERIES["cp_curves"](spark, SF).count() > 0
    assert 0 < seen[0] < q.QUERIES["cp_links"](spark, SF).count() / 20


@pytest.mark.parametrize("frames", [1, 5])
def test_order_by_slabs(spark, duck, monkeypatch, frames):
    """Stretches between slabs are ranked, and what lies within them is put in its place; loops over several slabs too."""
    seen, ranked = [], critical.ranked_paths
    monkeypatch.setattr(critical, "ranked_paths", lambda links, *a: (seen.append(links.count()), ranked(links, *a))[1])
    monkeypatch.setattr(slabs, "FACES_AT_ONCE", 12 * 800 * frames)
    assert spark_rows(q.QUERIES["cp_ordered_curves"](spark, SF)) == duck(q.SQL["cp_ordered_curves"])
    assert 0 < seen[0] and (frames == 1 or seen[0] < q.QUERIES["cp_links"](spark, SF).count() / 2)
