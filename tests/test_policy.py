import math

import pytest

from amberweave.functions import policy as p


def test_golden_values():
    assert [p.capacity(t) for t in (0, 1, 1000, 5000, 10**4, 10**5, 10**6)] == [1, 1, 50, 124, 183, 645, 2233]
    assert [p.capacity(x) for x in (math.nan, math.inf, -3, None)] == [1, 1, 1, 1]
    assert [p.neighbor_degree(t) for t in (1, 10, 100, 250, 438)] == [1, 3, 13, 23, 32]
    assert [p.subgraph_bounds(t) for t in (1, 10, 100, 1000, 10**4, 10**5)] == [(1, 1, 1), (1, 2, 1), (3, 3, 1), (10, 4, 1), (27, 4, 2), (30, 5, 1)]
    assert [p.fanout_limit(n) for n in (2, 4, 8, 16, 32)] == [1, 2, 3, 5, 7]
    assert p.salience(2.0, 0.5, 3) == 1.75 and p.salience(math.inf, 0, 0) == 0


def test_quotas():
    assert list(p.tier_quotas(10).values()) == [1, 2, 2, 5]
    assert list(p.tier_quotas(5).values()) == [1, 1, 1, 2]
    assert p.community_quotas(100, [70, 30]) == [70, 30]
    assert p.community_quotas(0, [1, 2]) == [0, 0] and p.community_quotas(3, []) == []
    assert sum(p.community_quotas(7, [5, -1, 9])) == 7


def test_routing_and_limits():
    r = p.routing_policy(1536)
    assert [r[k]["dim_out"] for k in ("broad", "normal", "narrow")] == [192, 384, 768] and r["broad"]["bits"] == 128
    assert [x["dim_out"] for x in p.routing_policy(99).values()] == [8, 24, 48]
    assert [x["offset"] for x in p.routing_policy(256).values()] == [0, 8192, 24576]
    assert (p.truncation_tokens(8192), p.chunk_limit(6144)) == (6144, 1536)
    with pytest.raises(ValueError):
        p.routing_policy(0)
