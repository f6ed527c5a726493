"""Words taken against targets on the given documents and on sources of few, very unequal documents."""

from collections import defaultdict

import numpy as np
import pytest

from careledger.llm import mixing
from careledger.llm.storage import table


def off_target(found):
    """Per source: what it takes less its target, its target, and the size of its smallest document with words."""
    taken, target, least = defaultdict(int), {}, {}
    for r in found:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        if r["size"]:
            least[r["source"]] = min(r["size"], least.get(r["source"], r["size"]))
    return {s: (taken[s] - target[s], target[s], least.get(s, 0)) for s in target}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_given_documents_come_near_their_targets(spark, sf):
    found = mixing.mix_sources(table(spark, f"/root/testdata/{sf}", "documents")).collect()
    assert all(r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in found)
    for source, (off, target, least) in off_target(found).items():
        assert abs(off) <= max(0.01 * target, least), (source, off, target, least)


def test_unequal_documents(spark):
    rng = np.random.default_rng(8)
    rows = []
    for s in range(12):
        sizes = [*rng.integers(1, 8, 40), *rng.integers(20, 400, 10), *rng.integers(1000, 4000, 2)]
        rows += [(len(rows) + k, "w " * int(n), f"s{s:02}") for k, n in enumerate(sizes)]
    found = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(found) == len(rows)
    for source, (off, target, _) in off_target(found).items():
        assert abs(off) <= max(0.01 * target, 10), (source, off, target)
