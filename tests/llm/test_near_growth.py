"""Large groups of near copies: rows follow the number of members, and nothing that may be similar is lost."""

import numpy as np
import pyarrow as pa
import pytest

from matchspark.llm import common, near


def _parts(n, pairs):
    of = list(range(n))

    def top(k):
        while of[k] != k:
            k = of[k]
        return k

    for a, b in pairs:
        of[top(a)] = top(b)
    return [top(k) for k in range(n)]


def _texts(n, seed, words):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        text = [f"w{k}" for k in range(words)]
        for j in rng.choice(words, int(rng.integers(0, 4)), replace=False):
            text[j] = f"x{rng.integers(9)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("words", [60, 200])
def test_pivots_give_a_few_pairs_for_each_member(words):
    """Links connect what all links connect; a pair of the bridging similarity in other parts is stood for. Before, each member gave a pair for each pivot."""
    texts = _texts(300, 3, words)
    sets = [set(near._set(t).tolist()) for t in texts]
    pivots = list(range(0, 300, 3))
    columns = [np.zeros(400, np.int64), np.r_[np.ones(100, np.int64), np.zeros(300, np.int64)], np.r_[pivots, np.arange(300)], [texts[k] for k in pivots] + texts]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cell", "pivot", "id", "text"])
    got = [(a, b, link) for part in near._near_pivots(85, 70)([batch]) for a, b, link in zip(*[c.to_pylist() for c in part.columns], strict=True)]

    def like(a, b):
        return 100 * len(sets[a] & sets[b]) / len(sets[a] | sets[b])

    every = [(a, b, like(a, b)) for a in range(300) for b in pivots]
    links = [(a, b) for a, b, s in every if s >= 85]
    parts = _parts(300, links)
    mine = _parts(300, [(a, b) for a, b, link in got if link])
    assert len({*zip(parts, mine, strict=True)}) == len(set(parts)) == len(set(mine))
    assert {a for a, _, link in got if link} == {a for a, _ in links}
    assert {(a, a) for a in pivots} <= {(a, b) for a, b, link in got if link}
    wanted = {(a, parts[b]) for a, b, s in every if s >= 70 and parts[a] != parts[b]}
    assert {(a, parts[b]) for a, b, link in got if not link and parts[a] != parts[b]} == wanted
    assert wanted if words == 60 else len(links) > 5 * len(got)


def test_leaving_a_large_node_loses_no_pair(spark):
    """Pairs that agree on enough tokens both stay, or ties connect them; close copies leave, unlike sets stay."""
    rng = np.random.default_rng(1)
    copies = np.tile(rng.integers(0, 256, 256), (400, 1))
    for row, n in zip(copies, rng.integers(0, 60, 400), strict=True):
        row[rng.choice(256, n, replace=False)] = rng.integers(0, 256, n)
    tokens = np.r_[copies, rng.integers(0, 256, (100, 256))].astype(np.uint8)
    reps = common.stored(spark.createDataFrame([(k, bytearray(t.tobytes())) for k, t in enumerate(tokens)], "id bigint, brief binary"), "test", "reps")
    members = common.stored(spark.range(500).selectExpr("id % 500 div 500 + 9L AS node", "id"), "test", "large")
    large = common.stored(near.with_sizes(members), "test", "sized")
    cut = near.layout(85)[2]
    ties, stay = near.near_pivots(large, reps, cut)
    stay = {r.id for r in stay.collect()}
    parts = _parts(500, [(r.a, r.b) for r in ties.collect()])
    equal = (tokens[:, None, :] == tokens[None, :, :]).sum(2)
    pairs = [(a, b) for a, b in zip(*np.nonzero(equal >= cut), strict=True) if a < b]
    assert len(pairs) > 1000
    assert all(a in stay and b in stay or parts[a] == parts[b] for a, b in pairs)
    assert len(stay & set(range(400))) < 250 and len(stay & set(range(400, 500))) > 90


def test_briefs_are_joined_once_for_each_set(spark):
    """As many rows as members, whatever the number of nodes of a set."""
    reps = spark.range(50).selectExpr("id", "cast(cast(id AS string) AS binary) AS brief")
    members = spark.range(1000).selectExpr("id % 7 AS node", "id div 20 AS id").distinct()
    got = near.with_brief(members, reps)
    assert sorted((r.node, r.id, int(bytes(r.brief))) for r in got.collect()) == sorted((r.node, r.id, r.id) for r in members.collect())
