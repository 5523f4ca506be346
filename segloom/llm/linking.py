"""Links between rows that share keys, and the connected groups they make.

No pairs of a key are made into rows: rows with a common hub are compared together, the hub with all of them first,
which joins most of a group, then only rows of different groups. What comes out are links enough to connect them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.llm.tables import forget, map_arrow, settle

#: Rounds after which groups must have come to rest; each at least halves a chain.
ROUNDS = 60
#: Nodes of a hub that are compared in one go.
BLOCK = 1024
#: Rows, and bytes, of whole groups that are prepared at once; groups of up to so many rows have all pairs looked at in one go.
_ROWS, _BYTES, _SQUARE = 4096, 1 << 25, 48
#: Pairs whose distance is estimated at once.
_PAIR_ROWS = 1 << 15
#: Rows of each larger group that are tried with its others in one go.
_ROWS_EACH = 32
_PAIRS = [np.triu_indices(n, 1) for n in range(_SQUARE + 1)]


class Matcher(Protocol):
    """What decides about links between the rows of one table."""

    #: Whether holds is much faster for many pairs at once; may be left out.
    MANY = False

    def far(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far rows a[i] and b[i] seem apart; infinite where they can't be linked."""
        ...

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether rows a[i] and b[i] are linked."""
        ...


def _sum(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))).alias("s")).first()
    return r["n"], r["s"]


def components(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """node and component, the smallest node that it reaches, for nodes that are not their own component.

    edges: a, b. Alternating stars: neighbours above a node move to its smallest neighbour, then all below it do.
    Raises where rounds don't suffice.
    """
    edges = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    before = _sum(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        old, edges = edges, settle(small)
        forget(old)
        now = _sum(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"groups did not come to rest in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def forest(rows: np.ndarray, match: Matcher) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that connect some rows as all links among them would, and which rows those of the first one are not connected with.

    The first row is tried with all others first; these only across the groups that are left.
    """
    n, links = len(rows), []
    group = np.arange(n)

    def tried(y: int, some: np.ndarray) -> None:
        far = match.far(np.full(len(some), rows[y]), rows[some])
        some = some[np.argsort(far, kind="stable")[: np.isfinite(far).sum()]]
        for at in range(0, len(some), 64):
            few = some[at : at + 64]
            few = few[group[few] != group[y]]
            if len(few):
                for x in few[match.holds(np.full(len(few), rows[y]), rows[few])]:
                    if group[x] != group[y]:
                        links.append((int(rows[y]), int(rows[x])))
                        group[group == group[x]] = group[y]

    if n <= _SQUARE:
        i, j = _PAIRS[n]
        far = match.far(rows[i], rows[j])
        may = np.flatnonzero(np.isfinite(far))
        for p in may[np.lexsort((far[may], i[may] > 0))]:
            if group[i[p]] != group[j[p]] and match.holds(rows[i[p : p + 1]], rows[j[p : p + 1]])[0]:
                links.append((int(rows[i[p]]), int(rows[j[p]])))
                group[group == group[j[p]]] = group[i[p]]
    else:
        tried(0, np.arange(1, n))
        alone = group != 0
        for y in np.flatnonzero(alone):
            tried(int(y), np.flatnonzero((np.arange(n) > 0) & (~alone | (np.arange(n) > y))))
    return links, group != group[0]


def forests(opens: np.ndarray, sizes: np.ndarray, match: Matcher) -> tuple[list[tuple[int, int]], np.ndarray]:
    """What forest finds for groups of consecutive rows, many pairs of all groups at a time.

    In rounds, each group that links made so far is tried with its nearest others, with more of them from round to round.
    """
    group, links = np.arange(int(opens[-1] + sizes[-1]) if len(opens) else 0), []

    def joined(a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            while group[x] != x:
                x = int(group[x])
            while group[y] != y:
                y = int(group[y])
            if x != y:
                group[max(x, y)] = min(x, y)
        while (group[group] != group).any():
            group[:] = group[group]

    def tried(a: np.ndarray, b: np.ndarray, few: int) -> None:
        far = np.concatenate([np.zeros(0), *(match.far(a[k : k + _PAIR_ROWS], b[k : k + _PAIR_ROWS]) for k in range(0, len(a), _PAIR_ROWS))])
        order = np.argsort(far, kind="stable")[: np.isfinite(far).sum()]
        a, b = a[order], b[order]
        while len(a):
            left = group[a] != group[b]
            a, b = a[left], b[left]
            own = group[a]
            order = np.argsort(own, kind="stable")
            rank = np.empty(len(own), np.int64)
            rank[order] = np.arange(len(own)) - np.searchsorted(own[order], own[order])
            now = rank < few
            x, y = a[now], b[now]
            holds = match.holds(x, y)
            old = group[x[holds]] != group[y[holds]]
            links.extend(zip(x[holds][old].tolist(), y[holds][old].tolist(), strict=True))
            joined(x[holds], y[holds])
            a, b, few = a[~now], b[~now], 8 * few

    small = sizes <= _SQUARE
    pairs = [(opens[small & (sizes == n), None] + np.stack(_PAIRS[n])[:, None]).reshape(2, -1) for n in np.unique(sizes[small])]
    if pairs:
        tried(*np.concatenate(pairs, axis=1), 1)
    large = list(zip(opens[~small].tolist(), sizes[~small].tolist(), strict=True))
    if large:
        # The first row of each is tried with all others; these only across the groups that are left, some of all groups at a time.
        tried(np.repeat(opens[~small], sizes[~small] - 1), np.concatenate([np.arange(lo + 1, lo + n) for lo, n in large]), 1 << 62)
    alone = [group[lo : lo + n] != group[lo] for lo, n in large]
    rest = [lo + np.flatnonzero(x) for (lo, _), x in zip(large, alone, strict=True)]
    for k in range(0, max(map(len, rest), default=0), _ROWS_EACH):
        pairs = []
        for (lo, n), own, some in zip(large, alone, rest, strict=True):
            y, x = (c.reshape(-1) for c in np.broadcast_arrays(some[k : k + _ROWS_EACH, None], np.arange(lo + 1, lo + n)[None]))
            new = ~own[x - lo] | (x > y)
            pairs.append(np.stack([y[new], x[new]]))
        tried(*np.concatenate(pairs, axis=1), 16)
    return links, group


def across(rest: np.ndarray, others: np.ndarray, later: np.ndarray, match: Matcher) -> list[tuple[int, int]]:
    """Links that connect the rows rest, which a hub doesn't reach, with others as all links would.

    later: which others are in a rest themselves. The others but these are all linked with the hub, and count as connected.
    """
    links, n = [], len(rest)
    group = np.arange(n + len(others))
    group[n:][~later] = n + len(others)
    for k, y in enumerate(rest):
        far = match.far(np.full(len(others), y), others)
        some = np.argsort(far, kind="stable")[: np.isfinite(far).sum()]
        for at in range(0, len(some), 64):
            few = some[at : at + 64]
            few = few[group[n + few] != group[k]]
            if len(few):
                for x in few[match.holds(np.full(len(few), y), others[few])]:
                    if group[n + x] != group[k]:
                        links.append((int(y), int(others[x])))
                        group[group == group[n + x]] = group[k]
    return links


def linked(rows: DataFrame, payload: Callable[[DataFrame], DataFrame], matcher: Callable[[pa.Table], Matcher]) -> DataFrame:
    """Links (a, b) that connect what all links between rows of a common key would connect.

    rows: key, node; read twice. payload: from a table of nodes, theirs: node and what the matcher needs. matcher: from
    the payload of some nodes, what decides about links between them.

    A key's smallest node is its hub, and nodes with a common hub are compared together: whoever shares a key shares
    its hub. Beyond BLOCK nodes a hub's nodes are dealt into blocks, each of which gets the hub; only nodes that the hub
    does not reach in their block are then compared with the other blocks, so that no task holds more than two blocks and
    what is copied grows with those nodes alone.
    """
    hubs = rows.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub")
    stars = settle(rows.join(hubs, "key").where("hub <> node").select("hub", "node").distinct())
    found = compared_stars(stars, payload, matcher)
    forget(stars)
    return found


def _blocks(stars: DataFrame) -> DataFrame:
    return stars.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))


def _own(blocks) -> F.Column:
    return F.pmod(F.xxhash64("node"), blocks).cast("int")


def compared_stars(stars: DataFrame, payload: Callable[[DataFrame], DataFrame], matcher: Callable[[pa.Table], Matcher]) -> DataFrame:
    """Links of linked from its stars: the different hub and node of every key, hubs themselves left out; read more than once."""
    sizes = _blocks(stars)
    # Hubs with more than a block are few, and only they are joined with their many nodes; the others have one block.
    placed = stars.join(sizes.where("blocks > 1"), "hub", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.select("hub", _own(F.col("blocks")).alias("i"), (F.col("blocks") > 1).alias("more"), "node")
    every = sizes.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), (F.col("blocks") > 1).alias("more"), F.col("hub").alias("node"))
    nodes = stars.select("node").unionByName(stars.select(F.col("hub").alias("node"))).distinct()
    held = payload(nodes)
    full = placed.unionByName(every).join(held, "node").repartition("hub", "i").sortWithinPartitions("hub", "i", "node")

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = getattr(matcher, "MANY", False)
        for table, cuts in _chunks(batches, ["hub", "i"], 4 * _ROWS if many else _ROWS):
            node, hub, more = (table.column(c).to_numpy() for c in ("node", "hub", "more"))
            match = matcher(table)
            sizes = np.diff(cuts)
            if many:
                links, group = forests(cuts[:-1], sizes, match)
                rest = np.flatnonzero(more & (group != group[np.repeat(cuts[:-1], sizes)]))
            else:
                twos = cuts[:-1][(sizes == 2) & ~more[cuts[:-1]]]
                links, rest = _pairs(twos, match), []
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    if hi - lo > 2 or more[lo]:
                        some, alone = forest(np.arange(lo, hi), match)
                        links += some
                        if more[lo]:
                            rest += (lo + np.flatnonzero(alone)).tolist()
            a, b = np.array(links, np.int64).reshape(-1, 2).T
            rest = np.array(rest, np.int64)
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b]), none], names=["a", "b", "hub"])
            yield pa.RecordBatch.from_arrays([pa.array(node[rest]), pa.nulls(len(rest), pa.int64()), pa.array(hub[rest])], names=["a", "b", "hub"])

    found = settle(map_arrow(full, first, "a long, b long, hub long"))
    links = found.where("hub is null and a <> b").select("a", "b")
    rest = found.where("hub is not null").select("hub", F.col("a").alias("node")).distinct()
    if rest.isEmpty():
        return settle(links.distinct())
    parts = rest.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")).join(sizes, "hub")
    asking = rest.join(parts, "hub").withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int"))
    others = stars.join(parts, "hub").withColumn("block", _own(F.col("blocks"))).join(rest.withColumn("later", F.lit(True)), ["hub", "node"], "left")
    left = asking.select("hub", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "node", F.lit(True).alias("asks"), F.lit(True).alias("later"))
    right = others.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "block", "node", F.lit(False).alias("asks"), F.coalesce("later", F.lit(False)).alias("later"))
    full = left.unionByName(right).join(held, "node").repartition("hub", "part", "block").sortWithinPartitions("hub", "part", "block", "node")

    def second(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in _chunks(batches, ["hub", "part", "block"]):
            node, asks, later = (table.column(c).to_numpy() for c in ("node", "asks", "later"))
            match, links = matcher(table), []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                own = np.arange(lo, hi)
                other = own[~asks[lo:hi]]
                links += across(own[asks[lo:hi]], other, later[other], match)
            a, b = np.array(links, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    return settle(links.unionByName(map_arrow(full, second, "a long, b long").where("a <> b")).distinct())


def _pairs(twos: np.ndarray, match: Matcher) -> list[tuple[int, int]]:
    """Links of groups of two rows, given their first ones, all at once."""
    may = twos[np.isfinite(match.far(twos, twos + 1))] if len(twos) else twos
    return [(int(x), int(x) + 1) for x in may[match.holds(may, may + 1)]] if len(may) else []


def _chunks(batches: Iterable[pa.RecordBatch], keys: list[str], most: int = _ROWS) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of consecutive rows with the same keys, and where the groups begin, and end."""
    held: list[pa.RecordBatch] = []
    rows = size = 0

    def cut(last: bool) -> Iterator[tuple[pa.Table, np.ndarray]]:
        nonlocal held, rows, size
        table = pa.Table.from_batches(held).combine_chunks()
        columns = [table.column(k).to_numpy() for k in keys]
        starts = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)]))
        done = table.num_rows if last else int(starts[-1])
        if done:
            yield table.slice(0, done), np.append(starts[starts < done], done)
        held = table.slice(done).to_batches()
        rows, size = table.num_rows - done, 0

    for batch in batches:
        step = max(1, min(_ROWS, batch.num_rows * _BYTES // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            piece = batch.slice(at, step)
            held.append(piece)
            rows += piece.num_rows
            size += batch.nbytes * piece.num_rows // batch.num_rows
            if rows >= most or size >= _BYTES:
                yield from cut(False)
    if rows:
        yield from cut(True)
