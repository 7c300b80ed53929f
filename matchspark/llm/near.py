"""Near duplicates by a chosen-path similarity join on shingle sets, links confirmed on the full sets.

1. Each text becomes its set of distinct 5-word shingles (64-bit hashes) and ``COORDINATES`` minwise tokens: eight bits of
   each (``brief``), and the whole of the first ``ROOTS`` (``sketch``). Equal sets are one class from here on.
2. Trees: each root branches by a minwise token of its own, a node that is larger than ``SMALL`` branches again by one
   that its path chooses (now and then by two). Small nodes are compared exhaustively on the brief tokens, equal ones
   as one; what may be similar is tied together. In a large node, sets that differ from one of ``NODE_PIVOTS`` pivots in at
   most ``CLOSE`` tokens leave it (at the first roots): unequal tokens obey the triangle inequality, so whatever may be similar to such a set is
   within the sum of both differences of the pivot, and is tied to it. So near copies in great number don't branch on.
   A node that is still large after ``DEPTH`` levels is tied as a whole.
   All sets are in the first trees; those that stay in a large root are in all. ``layout`` takes as many trees, and a
   cut of the comparison so low, that by its binomial figures a pair of the given similarity is lost with chance
   ``LOSS`` at most, even where no node ever gets small. With so many tokens the cut lies at about three quarters, so
   texts that only share a passage are hardly ever tied.
3. Ties make candidate groups. Within a group every pair is checked on the full sets behind one list of its shingles;
   groups too large for a task (members times shingles above ``GROUP_WORK``) are checked against blocks of pivots in rounds. By the triangle inequality of the Jaccard
   distance a link between the stars of two pivots has an end whose similarity to the other pivot is .70 or more;
   such texts become pivots themselves, so no link between parts is lost.

A text of fewer than five words is one shingle; NULL, empty and blank texts have no set and are linked with nothing.
Rows that repeat an id count as one. An empty table gives an empty table. NULL ids are reported as their own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.llm import common
from matchspark.llm.merging import BLANK, WordCoder, word_hashes

SHINGLE = 5
DEPTH = 8
COORDINATES = 256
ROOTS = 64
SMALL = 2048
NODE_PIVOTS = 4
CLOSE = 32
LOSS = 1e-6
GROUP_SHINGLES = 2_000_000
GROUP_WORK = 2_000_000_000
PIVOTS = 512
CHUNK_SHINGLES = 1_000_000
SECOND_BRANCH = 25

_ODD = np.random.default_rng(20240501).integers(1, 1 << 62, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def layout(percent: int) -> tuple[int, int, int]:
    """Trees for all sets, trees for sets that meet a large root, and the least number of equal minwise tokens.

    A third of ``LOSS`` each for pairs that share no root of the first trees, that lose each other in every tree before
    the full depth, and that agree on too few tokens. The tokens that a pair shares are binomial; given their number,
    the trees, whose paths choose from all tokens, are taken as independent.
    """
    s, part, two = percent / 100, LOSS / 3, SECOND_BRANCH / 100
    k = np.arange(COORDINATES + 1)
    chance = np.array([math.comb(COORDINATES, i) * s**i * (1 - s) ** (COORDINATES - i) for i in k.tolist()])
    alike = k / COORDINATES
    lives = np.ones(len(k))
    for _ in range(DEPTH - 1):
        lives = (1 - two) * alike * lives + two * (1 - (1 - alike * lives) ** 2)
    lost = 1 - alike * lives
    first = next(n for n in range(1, COORDINATES + 1) if (1 - s) ** n <= part)
    every = next(n for n in range(first, ROOTS + 1) if chance @ lost**n <= part)
    return first, every, int(np.searchsorted(np.cumsum(chance), part, side="right"))


def shingle_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts, one text after another and with repeats, and how many each text has."""
    joined = b"\xff".join([*[t.encode("utf-8", "surrogatepass").lower() for t in texts], b""])
    data = np.frombuffer(joined, np.uint8)
    edge = data == 255
    blank = BLANK[data] | edge
    starts = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    ends = np.flatnonzero(np.r_[blank[1:], True] & ~blank) + 1
    words = word_hashes(data, starts, ends, WordCoder.BASE) if len(starts) else np.zeros(0, np.uint64)
    limits = np.r_[0, np.searchsorted(starts, np.flatnonzero(edge))]
    counts = np.diff(limits)
    sizes = np.where(counts > 0, np.maximum(counts - SHINGLE + 1, 1), 0)
    total = int(sizes.sum())
    first = np.repeat(limits[:-1] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(total)
    width = np.repeat(np.minimum(counts, SHINGLE), sizes)
    padded = np.r_[words, np.zeros(SHINGLE, np.uint64)]
    out = width.astype(np.uint64)
    for k in range(SHINGLE):
        out = np.where(k < width, (out ^ padded[first + k]) * _MIX, out)
        out ^= out >> np.uint64(32)
    return out, sizes


def _sketches(batches):
    for batch in batches:
        for part in common.by_bytes(batch):
            hashes, sizes = shingle_hashes(part.column("text").to_pylist())
            edges = np.r_[0, np.cumsum(sizes)]
            full = np.flatnonzero(sizes)
            least = np.zeros((len(sizes), COORDINATES), np.uint32)
            if len(full):
                for c in range(COORDINATES):
                    mixed = hashes * _ODD[c]
                    mixed ^= mixed >> np.uint64(29)
                    mixed *= _ODD[c - 1]
                    least[full, c] = np.minimum.reduceat(mixed, edges[full]).astype(np.uint32)
            distinct, keys = [], []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                own = np.unique(hashes[a:b])
                distinct.append(len(own))
                keys.append(xxhash.xxh3_128_digest(own.tobytes()) if b > a else None)
            sketch = common.list_array(least[:, :ROOTS].ravel().view(np.int32), np.full(len(sizes), ROOTS))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(distinct, pa.int64()), pa.array(keys, pa.binary()), sketch, pa.array(brief(least), pa.binary())],
                ["doc_id", "n_shingles", "set_key", "sketch", "brief"],
            )


def brief(least: np.ndarray) -> list[bytes]:
    """Eight bits of each minwise token; different tokens seem equal now and then, which only adds candidates."""
    return [row.tobytes() for row in (least & 255).astype(np.uint8)]


def _groups(batches, key: str):
    """Rows of each value of a key from a stream sorted by it, as one batch; groups must fit in memory."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        values = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b == a:
                continue
            if held and held[0].column(key)[0].as_py() != values[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


class _Parts:
    """Parts of positions, each named by its smallest one."""

    def __init__(self, n: int) -> None:
        self.of = np.arange(n)

    def tie(self, k: int, others: np.ndarray) -> None:
        """One part for all parts of these positions."""
        met = np.unique(np.r_[self.of[k], self.of[others]])
        if len(met) > 1:
            self.of[np.isin(self.of, met)] = met[0]


def _tie_node(cut: int):
    """For each small node, ties from members to the least member of their part."""

    def run(batches):
        for node in _groups(batches, "node"):
            ids = np.asarray(node.column("id"))
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            rows = np.frombuffer(b"".join(node.column("brief").to_pylist()), np.uint8).reshape(len(ids), COORDINATES)[order]
            flat, first, same = np.unique(rows, axis=0, return_index=True, return_inverse=True)
            parts = _Parts(len(flat))
            for k in range(len(flat) - 1):
                others = np.flatnonzero(parts.of[k + 1 :] != parts.of[k]) + k + 1
                alike = np.count_nonzero(flat[others] == flat[k], axis=1) >= cut
                if alike.any():
                    parts.tie(k, others[alike])
            least = np.full(len(flat), len(ids))
            np.minimum.at(least, parts.of, first)
            tops = least[parts.of][same.ravel()]
            keep = tops != np.arange(len(ids))
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(ids[tops[keep]])], ["a", "b"])

    return run


def _equal_tokens(least: int):
    """For each member and each pivot of its node the number of equal tokens, where there are ``least`` or more."""

    def run(batches):
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column("brief").to_pylist()), np.uint8).reshape(-1, COORDINATES)
            pivots = batch.column("pivots")
            at = np.repeat(np.arange(len(rows)), np.diff(pivots.offsets.to_numpy()))
            flat = pivots.flatten()
            own = np.frombuffer(b"".join(flat.field("brief").to_pylist()), np.uint8).reshape(-1, COORDINATES)
            equal = np.count_nonzero(rows[at] == own, axis=1)
            keep = np.flatnonzero(equal >= least)
            at, ids = pa.array(at[keep]), flat.field("id").take(pa.array(keep))
            columns = [batch.column("node").take(at), batch.column("id").take(at), ids, pa.array(equal[keep], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "id", "pivot", "equal"])

    return run


def near_pivots(large: DataFrame, reps: DataFrame, cut: int) -> tuple[DataFrame, DataFrame]:
    """Ties (a, b) to the pivots of large nodes, and the members (node, id) that stay in them. ``large`` has node, id and n.

    Two sets of a node that agree on ``cut`` tokens both stay, or ties connect them.
    """
    spots = large.groupBy("node", F.pmod(F.xxhash64("id"), F.lit(NODE_PIVOTS)).alias("k")).agg(F.min("id").alias("id"), F.first("n").alias("n"))
    pivots = spots.join(reps.select("id", "brief"), "id").groupBy("node").agg(F.first("n").alias("n"), F.collect_list(F.struct("id", "brief")).alias("pivots"))
    rows = common.join_groups(with_brief(large.select("node", "id"), reps), common.stored(pivots), "node", "n")
    met = common.stored(rows.select("node", "id", "brief", "pivots").mapInArrow(_equal_tokens(cut - CLOSE), "node bigint, id bigint, pivot bigint, equal int"))
    near = F.col("equal") >= COORDINATES - CLOSE
    stay = large.select("node", "id").join(met.filter(near).select("node", "id").distinct(), ["node", "id"], "left_anti")
    met = met.withColumn("spot", F.xxhash64("node", "pivot"))
    reach = met.groupBy("spot").agg(F.min(F.when(near, F.col("equal"))).alias("least"), F.count(F.lit(1)).alias("n"))
    wide = common.join_groups(met.filter(F.col("equal") < cut), common.stored(reach.filter(F.col("least") < COORDINATES)), "spot", "n")
    tied = met.filter(F.col("equal") >= cut).select("id", "pivot").unionByName(
        wide.filter(F.col("equal") + COORDINATES - F.col("least") >= cut).select("id", "pivot")
    )
    return tied.filter("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct(), stay


def _set(text: str) -> np.ndarray:
    return np.unique(shingle_hashes([text])[0])


def _link_group(percent: int):
    def run(batches):
        for group in _groups(batches, "group"):
            ids, texts = group.column("id").to_pylist(), group.column("text").to_pylist()
            order = sorted(range(len(ids)), key=ids.__getitem__)
            ids, sets = [ids[k] for k in order], [_set(texts[k]) for k in order]
            block, parts, at = _Block(ids, sets), _Parts(len(ids)), np.array(ids)
            for k, own in enumerate(sets):
                shared = block.shared(own)
                either = block.sizes + len(own) - shared
                parts.tie(k, np.flatnonzero((100 * shared >= percent * either) & (shared > 0) | (at == ids[k])))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at[parts.of], pa.int64())], ["id", "component"])

    return run


def components(ties: DataFrame) -> DataFrame:
    """id and the smallest id that ties connect it with (``component``), for every id in a tie.

    Labels fall to the least of the neighbours and then to their label's label, until none changes. Ids with many
    ties are joined as hot groups.
    """
    both = common.stored(ties.select("a", "b").union(ties.select("b", "a")).filter("a <> b").distinct())
    labels = common.stored(both.groupBy("a").agg(F.count(F.lit(1)).alias("degree"), F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        seen = common.join_groups(both.withColumnRenamed("b", "id"), labels.withColumnRenamed("a", "id"), "id", "degree")
        least = seen.groupBy("a").agg(F.min("component").alias("least"))
        lower = labels.join(least, "a").select("a", "degree", F.col("component").alias("was"), F.least("component", "least").alias("component"))
        lower = common.stored(lower)
        tops = lower.select(F.col("a").alias("component"), F.col("component").alias("top"))
        sizes = lower.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        jumped = common.join_groups(lower, common.stored(sizes.join(tops, "component")), "component", "n")
        new = common.stored(jumped.select("a", "degree", "was", F.least("component", "top").alias("component")))
        labels = new.drop("was")
        if new.filter("was <> component").isEmpty():
            return labels.select(F.col("a").alias("id"), "component")


def with_sizes(members: DataFrame) -> DataFrame:
    """Members (node, id) with the size ``n`` of their node, NULL where they are alone: every join makes one row for each
    row it gets, whatever the sizes are. ``members`` should be stored, as it is read twice."""
    sizes = common.stored(members.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    hot = sizes.orderBy(F.desc("n"), "node").limit(common.HOT_GROUPS).withColumnRenamed("n", "hot")
    marked = common.stored(members.join(F.broadcast(hot), "node", "left"))
    rest = marked.filter("hot IS NULL").drop("hot").join(sizes.hint("merge"), "node", "left")
    return marked.filter("hot IS NOT NULL").withColumnRenamed("hot", "n").unionByName(rest.select("node", "id", "n"))


def with_brief(members: DataFrame, reps: DataFrame) -> DataFrame:
    """Members (node, id) with the brief tokens of their set, which are joined once for each set and not once for each node."""
    nodes = members.groupBy("id").agg(F.collect_list("node").alias("nodes"))  # at most one for each tree and way down
    return nodes.join(reps.select("id", "brief"), "id").select("id", "brief", F.explode("nodes").alias("node"))


def candidate_ties(reps: DataFrame, percent: int) -> DataFrame:
    """Ties (a, b) between sets that may be similar; ``reps`` has id, sketch and brief."""
    first, every, cut = layout(percent)
    out = []

    def roots(rows: DataFrame, trees: range) -> DataFrame:
        nodes = F.array(*[F.xxhash64(F.lit(t), F.get("sketch", F.lit(t))) for t in trees])
        return rows.select("id", F.explode(nodes).alias("node"))

    def compared(members: DataFrame, reps: DataFrame) -> DataFrame:
        """Members of large nodes; small nodes are compared."""
        members = common.stored(with_sizes(common.stored(members)))
        leaves = with_brief(members.filter(F.col("n") <= SMALL), reps)
        out.append(leaves.repartition("node").sortWithinPartitions("node").mapInArrow(_tie_node(cut), "a bigint, b bigint"))
        return members.filter(F.col("n") > SMALL)

    def large_of(members: DataFrame, reps: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members of nodes that are large even without those close to a pivot, and the sets that large nodes have."""
        large = compared(members, reps)
        if large.isEmpty():
            return large, reps
        some = common.stored(reps.join(large.select("id").distinct(), "id", "left_semi"))
        ties, stay = near_pivots(large, some, cut)
        out.append(ties)
        return compared(stay, some), some

    large, some = large_of(roots(reps, range(first)), reps)
    if every > first and not large.isEmpty():
        some = common.stored(some.join(large.select("id").distinct(), "id", "left_semi"))
        large = large.unionByName(compared(roots(some, range(first, every)), some))  # close copies have left
    for level in range(1, DEPTH):
        if large.isEmpty():
            break
        one, other = (F.pmod(F.xxhash64("node", F.lit(way)), F.lit(COORDINATES)).cast("int") for way in (level, -level))
        second = F.when(F.pmod("node", F.lit(100)) < SECOND_BRANCH, other)
        branch = F.explode(F.array_distinct(F.filter(F.array(one, second), lambda c: c.isNotNull())))
        wide = with_brief(large, some).select("node", "id", "brief", branch.alias("c"))
        large = compared(wide.select("id", F.xxhash64("node", "c", F.substring(F.col("brief"), F.col("c") + 1, F.lit(1))).alias("node")), some)
    if not large.isEmpty():
        pivots = common.stored(large.groupBy("node").agg(F.min("id").alias("b"), F.count(F.lit(1)).alias("n")))
        tied = common.join_groups(large.select("node", F.col("id").alias("a")), pivots, "node", "n")
        out.append(tied.filter("a <> b").select("a", "b"))
    ties = out[0]
    for more in out[1:]:
        ties = ties.union(more)
    return ties


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links) and kept of every row."""
    if percent < 80:
        raise ValueError("trees and pivots are laid out for similarities of 80 hundredths or more")
    texts = common.texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    sketched = common.stored(texts.mapInArrow(_sketches, "doc_id bigint, n_shingles bigint, set_key binary, sketch array<int>, brief binary"))
    classes = common.stored(sketched.filter("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(
        F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch"), F.first("brief").alias("brief")
    ))
    ties = common.stored(candidate_ties(classes.select("id", "sketch", "brief"), percent))
    groups = components(ties).withColumnRenamed("component", "group")
    sized = common.stored(groups.join(classes.groupBy("id").agg(F.max("size").alias("size")), "id"))
    totals = common.stored(sized.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")))
    small = (F.col("n") * F.col("total") <= GROUP_WORK) & (F.col("total") <= GROUP_SHINGLES)
    wanted = common.join_groups(sized.select("id", "group"), totals, "group", "n").withColumn("small", small)
    members = wanted.join(texts.withColumnRenamed("doc_id", "id"), "id")
    members = common.stored(members)
    done = members.filter("small").select("group", "id", "text").repartition("group").sortWithinPartitions("group").mapInArrow(
        _link_group(percent), "id bigint, component bigint"
    )
    large = members.filter("NOT small")
    if not large.isEmpty():
        done = done.union(_large_groups(large, percent))
    labels = done.groupBy("id").agg(F.min("component").alias("component"))
    named = common.stored(classes.drop("sketch", "brief").join(labels, "id", "left").select("set_key", "n", F.coalesce("component", "id").alias("component")))
    rows = sketched.drop("sketch", "brief")
    full = common.join_groups(rows.filter("set_key IS NOT NULL AND doc_id IS NOT NULL"), named, "set_key", "n")
    alone = rows.filter("set_key IS NULL OR doc_id IS NULL").withColumn("component", F.col("doc_id"))
    both = full.select("doc_id", "n_shingles", "component").unionByName(alone.select("doc_id", "n_shingles", "component"))
    return both.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def _large_groups(large: DataFrame, percent: int) -> DataFrame:
    """id and component for the members of groups of any size, by rounds of pivots."""
    chunks = F.ceil(F.col("total") / CHUNK_SHINGLES).cast("int")
    members = common.stored(large.withColumn("chunk", F.pmod(F.xxhash64("id"), chunks).cast("int")).withColumn("chunks", chunks).drop("n", "total", "small"))
    near = None
    open_ids = members.select("group", "id")
    bridge = 2 * percent - 100
    while True:
        pivots = common.stored(open_ids.groupBy("group", F.pmod(F.xxhash64("id"), F.lit(PIVOTS)).alias("k")).agg(F.min("id").alias("id")).select("group", "id"))
        spread = members.join(pivots, ["group", "id"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        rows = members.withColumn("pivot", F.lit(0)).unionByName(spread.withColumn("pivot", F.lit(1)))
        rows = rows.withColumn("cell", F.xxhash64("group", "chunk")).select("cell", "pivot", "id", "text")
        found = rows.repartition("cell").sortWithinPartitions("cell", F.desc("pivot")).mapInArrow(
            _near_pivots(percent, bridge), "id bigint, pivot bigint, link boolean"
        )
        near = common.stored(found if near is None else near.unionByName(found))
        used = near.filter("id = pivot").select("id").distinct()
        links = near.filter("link AND id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b"))
        labels = components(links)
        named = near.join(labels, "id", "left").withColumn("mine", F.coalesce("component", "id")).drop("component")
        tops = labels.select(F.col("id").alias("pivot"), F.col("component").alias("pivot_component"))
        tops = used.select(F.col("id").alias("pivot")).join(tops, "pivot", "left")
        sized = named.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"))
        tops = common.stored(tops.join(sized, "pivot").select("pivot", "n", F.coalesce("pivot_component", "pivot").alias("theirs")))
        across = common.join_groups(named, tops, "pivot", "n").filter("mine <> theirs").select("id")
        reached = near.filter("link").select("id")
        todo = members.select("group", "id").join(reached.distinct(), "id", "left_anti")
        todo = todo.unionByName(members.select("group", "id").join(across.distinct(), "id", "left_semi"))
        open_ids = common.stored(todo.join(used, "id", "left_anti").distinct())
        if open_ids.isEmpty():
            return members.select("id").distinct().join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


class _Block:
    """Sets of a group or of a block of pivots behind one sorted list of their shingles, so that a text meets all of them at once."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]) -> None:
        self.ids, self.sizes = ids, np.array([len(s) for s in sets], np.int64)
        keys, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[order]

    def shared(self, values: np.ndarray) -> np.ndarray:
        """Shingles that a sorted set has in common with each pivot."""
        first = np.searchsorted(self.keys, values, side="left")
        n = np.searchsorted(self.keys, values, side="right") - first
        at = np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        return np.bincount(self.owner[at], minlength=len(self.ids))


class _Stars:
    """Members of a cell around its pivots. Members link pivots, and pivots linked so are one part: they are connected for
    good, so one link to a part, and one pair of the bridging similarity with another part, stand for all."""

    HELD = 1_000_000

    def __init__(self, ids: list[int], sets: list[np.ndarray]) -> None:
        self.block, self.ids, self.parts = _Block(ids, sets), np.array(ids, np.int64), _Parts(len(ids))
        self.held: list[tuple[int, int, np.ndarray]] = []
        self.size = 0

    def meet(self, own: int, values: np.ndarray, percent: int, bridge: int):
        """Links (member, pivot, True) of one member: to itself where it is a pivot, and to one pivot of each part."""
        shared = self.block.shared(values)
        either = self.block.sizes + len(values) - shared
        close = np.flatnonzero(100 * shared >= bridge * either)
        link = (100 * shared[close] >= percent * either[close]) | (self.ids[close] == own)
        linked, others = close[link], close[~link]
        of = self.parts.of[linked]
        ends = set(self.ids[np.unique(of)].tolist()) | set(self.ids[linked[self.ids[linked] == own]].tolist())
        if len(of) and (of != of[0]).any():
            self.parts.tie(int(linked[0]), linked[1:])
        if len(others):
            others = others[np.unique(self.parts.of[others], return_index=True)[1]]
            self.held.append((own, int(linked[0]) if len(linked) else -1, others))
            self.size += len(others)
        return [(own, end, True) for end in ends]

    def bridges(self):
        """Pairs (member, pivot, False) of the bridging similarity whose parts are not one so far."""
        of, out = self.parts.of, []
        for own, at, others in self.held:
            theirs = np.unique(of[others])
            out += [(own, end, False) for end in self.ids[theirs[theirs != (of[at] if at >= 0 else -1)]].tolist()]
        self.held, self.size = [], 0
        return out


def _near_pivots(percent: int, bridge: int):
    """Pairs (member, pivot) that stand for those of at least the bridging similarity; pivots come first in each cell."""

    def run(batches):
        cell, ids, sets, stars = None, [], [], None
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("cell", "pivot", "id", "text")]
            for here, is_pivot, own, text in zip(*columns, strict=True):
                if here != cell:
                    out += stars.bridges() if stars else []
                    cell, ids, sets, stars = here, [], [], None
                values = _set(text)
                if is_pivot:
                    ids.append(own)
                    sets.append(values)
                    continue
                if not ids:
                    continue
                stars = stars or _Stars(ids, sets)
                out += stars.meet(own, values, percent, bridge)
                if stars.size > _Stars.HELD:
                    out += stars.bridges()
            if out:
                yield _pairs(out)
        if stars and (out := stars.bridges()):
            yield _pairs(out)

    return run


def _pairs(rows: list[tuple[int, int, bool]]) -> pa.RecordBatch:
    a, b, link = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(link)], ["id", "pivot", "link"])
