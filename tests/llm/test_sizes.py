"""What tables too large for the filters have, on small ones with smaller filters."""

from pathlib import Path

import numpy as np
import pytest

from glossarium.llm import op10_jaccard_join
from glossarium.llm.op10_jaccard_join import Join, brute_force, with_partner
from glossarium.llm.two_bloom import repeated_alone


@pytest.mark.parametrize("n", [40_100, 1 << 30])
def test_hashes_that_occur_once_fill_no_filter(spark, n):
    h = np.random.default_rng(1).integers(0, 1 << 63, 40_000).astype(np.uint64) * np.uint64(2)
    again = h[:100]
    rows = spark.createDataFrame([(int(x),) for x in np.concatenate([h, again]).view(np.int64)], "h long").repartition(7)
    known = repeated_alone(rows, lambda pdf: pdf["h"].to_numpy().view(np.uint64), n, 1 << 13)
    assert known.has(again).all()
    assert known.has(h[100:]).mean() < 0.05


def test_sets_without_partners_stay_out_however_small_the_filter(spark):
    # 4000 sets of elements of their own and two that are alike; the filter has fewer positions than there are elements
    sets = [(k, 20, list(range(20 * k, 20 * k + 20))) for k in range(4000)]
    points = spark.createDataFrame([*sets, (4000, 20, sets[7][2])], "node long, n long, first array<long>").repartition(5)
    assert {7, 4000} <= (left := {r.node for r in with_partner(points, Join(words=5, percent=80, bits=1 << 13)).collect()})
    assert len(left) < 200


def test_first_elements_lie_on_disk_once_and_not_beside_the_sets(spark, monkeypatch):
    made, at_sets = {}, []

    def noting(df, label):
        if label == "sets":
            at_sets.extend(x for x in made if made[x] and "first" in made[x].columns and Path(made[x]._cut_path.removeprefix("file:")).exists())
        made[label] = out = op10_cut(df, label)
        return out

    op10_cut = op10_jaccard_join.cut
    monkeypatch.setattr(op10_jaccard_join, "cut", noting)
    # copies with one id, with others and without, near copies, and a set of its own
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(5, base), (5, base), (3, base), (None, base), (9, base + " more"), (None, "x y z q r"), (None, "x y z q r"), (7, "some other words that stand here alone"), (8, None), (1, "x y z q r s")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = op10_jaccard_join.jaccard_components(df).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=repr) == sorted(((r[0], c) for r, c in zip(rows, brute_force(rows, 4, 85))), key=repr)
    assert "first" in made["shingles"].columns and "first" not in made["points"].columns
    assert at_sets == ["chosen"]  # those of sets that may have a partner
