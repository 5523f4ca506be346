"""Fuzzy line deduplication: one occurrence of each group of lines that are equal or nearly so stays.

Lines are normalised (lower case, punctuation as spaces, digits as 0, single spaces). Equal normalised lines are one
class from the start. Classes that share a key are candidates; candidates whose SimHash fingerprints differ in more than
RADIUS bits go, the others are linked when their edit similarity is 90 % or more. Of each connected group the first
occurrence stays, by doc_id and position.

Keys are runs of characters at nearly the same place, by the pigeonhole principle over the line itself: blocks of the
fingerprint would miss most links, since a tenth of edits changes a third of its bits. Lines under SHORT
characters are keyed by all their runs of 5 to 7 characters, one of which any allowed number of edits leaves whole, so
none of their links is missed; under ten characters no edit is allowed. Longer lines are keyed by 24 or 40 of their runs
of 8, 12 or 16 characters (CHOSEN), those of least hash, so that a link is missed only by chance; so it is by
fingerprints, which are heeded from SHORT characters on.

Every line with a word takes part, however short; lines of spaces and ASCII punctuation alone count as blank.

Defined cases: a null text stays null, an empty one empty; blank lines stay; rows that repeat a doc_id and text are one
document, and each keeps its lines; null doc_ids count as one document for each text and come first; a document all of
whose lines with words went is left with what remains and marked emptied; other columns stay as they are, n_chars follows the
text where there is one; a text of any number of lines, and a line of any length, is taken whole; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructType

from segloom.llm import edits
from segloom.llm.linking import BLOCK, _chunks, compared_stars, components
from segloom.llm.tables import aside, forget, map_arrow, restored, settle, small
from segloom.llm.words import chunks, mix

EDIT_PERCENT = 90
#: From so many characters on, runs are chosen; their length, for lines from how many characters to below how many, and how many are kept.
SHORT = 40
ALL = ((5, 9, 20, 0), (6, 18, 30, 0), (7, 27, 40, 0))
CHOSEN = ((8, 36, 110, 24), (12, 99, 250, 24), (16, 225, 1 << 62, 40))
#: Bits of a line's fingerprint, over runs of GRAM characters, and how many may differ: about 1 in 100 pairs at the edit limit has more.
PRINT_BITS, GRAM, RADIUS = 512, 5, 178
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_BUCKET_BITS = 9
#: Bits of keys that name their part, and keys that a task holds before it deals them into parts.
_PART_BITS, _KEYS = 12, 1 << 20
#: Classes of a line's runs that are counted before its edits are.
BUCKETS = 1024
#: Pairs whose bands have the same number of words are taken at once from so many on.
FEW = 64
#: Runs of so few characters are shared by chance, so beside each of their keys goes, in 8 bytes, how often its line has the characters of each
#: of KINDS classes (at most 15) and its size; frequent characters have a class of their own. Up to BLOCK lines of a hub are told apart by them.
KINDS = 14
ROUGH = (*ALL, CHOSEN[0])
_FREQUENT = " etaoinshrdlu"
#: Places that a run may be apart, by band of lengths.
_WIDTHS = 0.2 * 1.25 ** np.arange(200.0)
_ASCII = bytes(32 if c < 33 and c != 10 or 33 <= c < 48 or 58 <= c < 65 or 91 <= c < 97 or 123 <= c < 128 else 48 if 48 <= c < 58 else c for c in range(256))


def normal_bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass").translate(_ASCII)


def normal_lines(text: str) -> list[bytes]:
    """The normalised lines of a text, empty where a line has no words."""
    return _single_spaced(normal_bytes(text))


def _single_spaced(text: bytes) -> list[bytes]:
    """The lines of normal_bytes with single spaces."""
    held = np.frombuffer(b"\n" + text + b"\n", np.uint8)
    # Spaces after a space or at a line's beginning go, then the one that may be left at its end.
    space = held == 32
    again = space[1:] & (space[:-1] | (held[:-1] == 10))
    return held[1:][~again].tobytes().replace(b" \n", b"\n").split(b"\n")[:-1]


def _lines_of(texts: list[str]) -> Iterator[tuple[int, list[bytes]]]:
    """Number of each text with its normalised lines, of many texts normalised at once."""
    for lo, hi in chunks(texts, 1 << 16):
        some, at = texts[lo:hi], 0
        held = [normal_bytes(x) for x in some]
        found = _single_spaced(b"\n".join(held))
        for k, text in enumerate(held, lo):
            count = text.count(b"\n") + 1
            yield k, found[at : at + count]
            at += count


def line_hash(line: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(line, digest_size=8).digest(), "little", signed=True)


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of lines, each followed by a line feed; sizes and first places of the lines."""
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(t) for t in texts], np.int64)
    return points, sizes, np.cumsum(sizes + 1) - sizes - 1


def _runs(points: np.ndarray, q: int) -> np.ndarray:
    """Polynomial hashes of all runs of q characters, longer runs made of two shorter ones."""
    if q == 1 or len(points) < q:
        return points if q == 1 else points[:0]
    half = _runs(points, q // 2)
    h = half[: len(points) - q // 2 * 2 + 1] * np.uint64(pow(int(_GRAM), q // 2, 1 << 64))
    h += half[q // 2 :][: len(h)]
    if q % 2:
        h = h[:-1] * _GRAM
        h += points[q - 1 :]
    return h


def line_prints(texts: list[str]) -> np.ndarray:
    """The SimHash fingerprint of each line, as 64-bit words: its runs vote, through signed buckets, on each bit.

    Which sign a bucket has for a bit is a Hadamard matrix, so that nine rounds of sums and differences take all votes.
    """
    if len(texts) > 128:
        return np.concatenate([line_prints(texts[lo : lo + 128]) for lo in range(0, len(texts), 128)])
    points, sizes, _ = _points(texts)
    n, h = len(texts), mix(_runs(points, GRAM))
    owner = np.repeat(np.arange(n), sizes + 1)[: len(h)]
    place = (h >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64) * n + owner
    votes = np.bincount(place, weights=((h >> np.uint64(32)) & np.uint64(1)) * 2.0 - 1, minlength=n << _BUCKET_BITS)
    # No sum exceeds a line's votes in size.
    votes = votes.astype(np.int16 if sizes.max(initial=0) < 1 << 15 else np.int64)
    other = np.empty_like(votes)
    for k in range(_BUCKET_BITS if n else 0):
        pair, out = votes.reshape(-1, 2, n << k), other.reshape(-1, 2, n << k)
        np.add(pair[:, 0], pair[:, 1], out=out[:, 0])
        np.subtract(pair[:, 0], pair[:, 1], out=out[:, 1])
        votes, other = other, votes
    return np.packbits(np.ascontiguousarray((votes.reshape(PRINT_BITS, n) > 0).T), axis=1, bitorder="little").view(np.uint64)


def line_bags(texts: list[str]) -> np.ndarray:
    """How often each line, of 255 characters at most, has those of each class, four bits each, and in the last byte its size."""
    points, sizes, _ = _points(texts)
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    kind = (mix(points) % np.uint64(KINDS)).astype(np.int64)
    for k, c in enumerate(_FREQUENT):
        kind[points == ord(c)] = k
    inside = points != 10
    counts = np.minimum(np.bincount(owner[inside] * KINDS + kind[inside], minlength=len(texts) * KINDS), 15).reshape(-1, KINDS).astype(np.uint8)
    return np.concatenate([counts[:, ::2] | counts[:, 1::2] << 4, sizes[:, None].astype(np.uint8)], axis=1).view(np.uint64)[:, 0]


def bags_near(bags: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Whether lines a[i] and b[i] may be within the edit limit, by their bags: a change of one character moves two counts by one, others move one."""
    parts = bags[:, None].view(np.uint8)
    size = parts[:, -1].astype(np.int64)
    # A count as that many bits: the bits in which two lines differ are the sum of what their counts differ by.
    bits = ((np.uint64(1) << np.arange(16, dtype=np.uint64)) - np.uint64(1))[np.stack([parts[:, :-1] & 15, parts[:, :-1] >> 4], axis=2).reshape(len(bags), KINDS)]
    words = [sum((bits[:, k] << np.uint64(15 * (k - lo)) for k in range(lo, min(lo + 4, KINDS))), np.zeros(len(bags), np.uint64)) for lo in range(0, KINDS, 4)]

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = size[a], size[b]
        off, most = np.abs(x - y), np.maximum(x, y) * (100 - EDIT_PERCENT) // 100
        apart = sum(np.bitwise_count(w[a] ^ w[b]).astype(np.int64) for w in words)
        return (off <= most) & (apart <= 2 * most - off)

    return near


def _line_rows(batches: Iterable[pa.RecordBatch], most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Place and hash of every line with words; size and fingerprint but where the same task gave them (while few are held)."""
    seen: set[int] = set()
    for batch in small(batches):
        ids, tids, texts = (c.to_pylist() for c in batch.columns)
        for lo, hi in chunks(texts, 1 << 18):
            doc, tid, pos, hashes, fresh, lines = [], [], [], [], [], []
            for k, found in _lines_of(texts[lo:hi]):
                k += lo
                for place, line in enumerate(found):
                    if line:
                        h = line_hash(line)
                        doc.append(ids[k]), tid.append(tids[k]), pos.append(place), hashes.append(h)
                        if h not in seen:
                            if len(seen) < most:
                                seen.add(h)
                            fresh.append(len(hashes) - 1)
                            lines.append(line.decode("utf-8", "surrogatepass"))
            if not hashes:
                continue
            prints, sizes = [None] * len(hashes), [None] * len(hashes)
            for at, line, words in zip(fresh, lines, line_prints(lines), strict=True):
                prints[at], sizes[at] = words.tobytes(), len(line)
            columns = [pa.array(doc, pa.int64()), pa.array(tid, pa.int64()), pa.array(pos, pa.int32()), pa.array(hashes, pa.int64()), pa.array(prints, pa.binary()), pa.array(sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tid", "pos", "h", "print", "size"])


def _least(h: np.ndarray, opens: np.ndarray, sizes: np.ndarray, q: int, few: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The few least different hashes of the runs of q characters of each line with a size, their lines and first places."""

    def least(limits: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero(h <= np.repeat(limits, widths)[: len(h)])
        owner = np.searchsorted(opens, at, side="right") - 1
        inside = at - opens[owner] <= sizes[owner] - q
        at, owner = at[inside], owner[inside]
        # One sort by line and hash; of equal hashes in a line the first place counts.
        bits = np.uint64(max(1, len(sizes).bit_length()))
        both = (owner.astype(np.uint64) << (np.uint64(64) - bits)) | (h[at] >> bits)
        order = np.argsort(both)
        both = both[order]
        new = np.flatnonzero(np.concatenate([both[:1] == both[:1], both[1:] != both[:-1]]))
        at = np.minimum.reduceat(at[order], new) if len(new) else at
        owner = owner[order][new]
        kept = np.arange(len(at)) - np.searchsorted(owner, owner) < few
        return h[at[kept]], owner[kept], (at - opens[owner])[kept]

    # Twice as many as are needed are sorted; lines that repeat themselves come up short and are sorted whole.
    widths = np.diff(np.append(opens, len(h) + q - 1))
    counts = np.where(sizes, sizes - q + 1, 0)
    most = np.minimum(2.0 * few / np.maximum(counts, 1), 1.0) * (2.0**64 - 2048)
    found, owner, place = least(np.where(sizes, most, 0).astype(np.uint64), widths)
    short = np.bincount(owner, minlength=len(sizes)) < np.minimum(counts, few)
    if short.any():
        more = least(np.where(short, 2.0**64 - 2048, 0).astype(np.uint64), widths)
        whole, also = ~short[owner], short[more[1]]
        return tuple(np.concatenate([x[whole], y[also]]) for x, y in zip((found, owner, place), more, strict=True))
    return found, owner, place


def line_keys(texts: list[str], runs: tuple[tuple[int, int, int, int], ...] = ALL + CHOSEN) -> tuple[np.ndarray, np.ndarray]:
    """Keys of normalised lines, and the line of each: lines of 90 % edit similarity share one (see the module's text)."""
    every = np.array([len(t) for t in texts], np.int64)
    keys, lines = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for q, low, high, few in runs:
        some = np.flatnonzero((every >= low) & (every < high))
        if not len(some):
            continue
        points, sizes, opens = _points([texts[i] for i in some.tolist()])
        h = _runs(points, q)
        if not few:
            k = q - 4
            counts = sizes - q + 1
            owner = np.repeat(np.arange(len(some)), counts)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            cell = (place // (k + 1)).astype(np.uint64)
            found = mix(h[opens[owner] + place] + np.uint64(k))
            for c in (cell, cell + np.uint64(1)):
                keys.append(mix(found + _GRAM * (c + np.uint64(1))))
                lines.append(some[owner])
            continue
        found, owner, place = _least(mix(h + np.uint64(q)), opens, sizes, q, few)
        # Each hash draws its own borders of lengths and of places, so that no pair lies across all of them.
        band = np.floor((np.log(sizes) / np.log(1.25))[owner] + (mix(found ^ _GRAM) >> np.uint64(11)) / 2.0**53)
        cell = np.floor(place / _WIDTHS[band.astype(np.int64)] + (mix(found + _GRAM) >> np.uint64(11)) / 2.0**53)
        keys.append(mix(mix(found + band.astype(np.uint64)) + cell.astype(np.uint64)))
        lines.append(some[owner])
    return np.concatenate(keys), np.concatenate(lines)


def _new_lines(batches: Iterable[pa.RecordBatch], most: int = 1 << 18) -> Iterator[tuple[list[int], list[str]]]:
    """Hashes and normalised lines, some at once; a line that comes again in the same task is left out while few are held."""
    seen: set[int] = set()
    hashes, lines, size = [], [], 0
    for batch in small(batches):
        for _, found in _lines_of(batch.column(0).to_pylist()):
            for line in found:
                h = line_hash(line) if line else None
                if h is None or h in seen:
                    continue
                if len(seen) < most:
                    seen.add(h)
                hashes.append(h)
                lines.append(line.decode("utf-8", "surrogatepass"))
                size += len(line) + 1
                if size >= 1 << 16:
                    yield hashes, lines
                    hashes, lines, size = [], [], 0
    if hashes:
        yield hashes, lines


def _key_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of lines by hash, in blocks: 32 bits of the keys of one part, in order, then the lines' hashes.

    Keys of ROUGH runs have parts of their own, and the bag of each key's line beside them.
    """
    keys, nodes, sacks, count = ([], []), ([], []), [], 0

    def blocks(rough: bool) -> Iterator[pa.RecordBatch]:
        if not keys[rough]:
            return
        key, node = np.concatenate(keys[rough]), np.concatenate(nodes[rough])
        order = np.argsort(key)
        key, node = key[order], node[order]
        bag = np.concatenate(sacks)[order] if rough else key[:0]
        cuts = np.append(np.searchsorted(key, np.arange(1 << _PART_BITS, dtype=np.uint64) << np.uint64(64 - _PART_BITS)), len(key))
        rest = (key >> np.uint64(32 - _PART_BITS)).astype(np.uint32)
        parts = np.flatnonzero(np.diff(cuts))
        for lo in range(0, len(parts), 512):
            some = parts[lo : lo + 512]
            data = [rest[a:b].tobytes() + node[a:b].tobytes() for a, b in zip(cuts[some], cuts[some + 1], strict=True)]
            bags = [bag[a:b].tobytes() for a, b in zip(cuts[some], cuts[some + 1], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(some + (rough << _PART_BITS), pa.int32()), pa.array(data, pa.binary()), pa.array(bags, pa.binary())], names=["part", "block", "bags"])

    for hashes, lines in _new_lines(batches):
        own = np.array(hashes, np.int64)
        for rough, runs in ((False, CHOSEN[1:]), (True, ROUGH)):
            found, of = line_keys(lines, runs)
            keys[rough].append(found)
            nodes[rough].append(own[of])
            count += len(found)
            if rough:
                some, of = np.unique(of, return_inverse=True)
                sacks.append(line_bags([lines[i] for i in some.tolist()])[of])
        if count >= _KEYS:
            yield from blocks(False)
            yield from blocks(True)
            keys, nodes, sacks, count = ([], []), ([], []), [], 0
    yield from blocks(False)
    yield from blocks(True)


def _block_nodes(blocks: list[bytes]) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, np.int64, len(x) // 12, len(x) // 12 * 4) for x in blocks])


def _star_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest line of each key with each of the others, from blocks in the order of their parts; a batch for each part."""

    def stars(held: list[bytes]) -> pa.RecordBatch:
        key = np.concatenate([np.frombuffer(x, np.uint32, len(x) // 12) for x in held])
        order = np.argsort(key, kind="stable")
        key = key[order]
        # Most keys are of one line alone.
        same = key[1:] == key[:-1]
        many = np.append(False, same) | np.append(same, False)
        key, node = key[many], _block_nodes(held)[order[many]]
        opens = np.flatnonzero(np.append(key[:1] == key[:1], key[1:] != key[:-1]))
        hub = np.repeat(np.minimum.reduceat(node, opens), np.diff(np.append(opens, len(key)))) if len(key) else node
        more = hub != node
        return pa.RecordBatch.from_arrays([pa.array(hub[more]), pa.array(node[more])], names=["hub", "node"])

    part, held = None, []
    for batch in batches:
        for own, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if own != part and held:
                yield stars(held)
                held = []
            part = own
            held.append(block.as_py())
    if held:
        yield stars(held)


def _likely_stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_star_rows, in which the lines of a part with a common hub that chains of near bags connect are a star of their own, and lines alone go."""
    for table, cuts in _chunks(batches, ["part"]):
        found = list(_star_rows(table.to_batches()))
        rough = table.column("part").to_numpy()[cuts[:-1]] >= 1 << _PART_BITS
        yield from (x for x, own in zip(found, rough, strict=True) if not own)
        found = [x for x, own in zip(found, rough, strict=True) if own]
        if not sum(x.num_rows for x in found):
            continue
        hub, node = (np.concatenate([x.column(k).to_numpy() for x in found]) for k in (0, 1))
        part = np.repeat(np.arange(len(found)), [x.num_rows for x in found])
        # Each part's stars with their hubs, once each.
        node, hub, part = np.unique(np.stack([np.append(node, hub), np.append(hub, hub), np.append(part, part)]), axis=1)
        order = np.lexsort((node, hub, part))
        node, hub, part = node[order], hub[order], part[order]
        own = table.filter(pc.greater_equal(table.column("part"), 1 << _PART_BITS))
        nodes, at = np.unique(_block_nodes(own.column("block").to_pylist()), return_index=True)
        bags = np.frombuffer(b"".join(own.column("bags").to_pylist()), np.uint64)[at]
        opens = np.flatnonzero(np.append(True, (hub[1:] != hub[:-1]) | (part[1:] != part[:-1])))
        group = _near_groups(np.append(opens, len(node)), bags_near(bags[np.searchsorted(nodes, node)]), BLOCK)
        # A group's rows stand in the order of their nodes, so that its first row is its hub.
        more = group != np.arange(len(node))
        yield pa.RecordBatch.from_arrays([pa.array(node[group[more]]), pa.array(node[more])], names=["hub", "node"])


def _near_groups(cuts: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray], most: int | None = None) -> np.ndarray:
    """For the rows of groups, the first row that chains of near rows of their group connect each with; groups of more than most rows are one."""
    group, sizes = np.arange(cuts[-1]), np.diff(cuts)
    for a, b in _pairs_within(cuts, most=most):
        close = near(a, b)
        a, b = a[close], b[close]
        while (group[a] != group[b]).any():
            least = np.minimum(group[a], group[b])
            np.minimum.at(group, group[a], least)
            np.minimum.at(group, group[b], least)
            while (group[group] != group).any():
                group = group[group]
    if most is not None:
        whole = np.repeat(sizes > most, sizes)
        group[whole] = np.repeat(cuts[:-1], sizes)[whole]
    return group


def _wanted_lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines at given places of texts, by hash."""
    for batch in small(batches):
        for text, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            # A line feed ends what lower case looks at, so that lines may be normalised alone.
            found = text.split("\n")
            lines = normal_lines("\n".join([found[k] for k in places]))
            yield pa.RecordBatch.from_arrays([pa.array([line_hash(x) for x in lines], pa.int64()), pa.array([x.decode("utf-8", "surrogatepass") for x in lines], pa.string())], names=["node", "line"])


def _plausible(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of the rows of a hub that near fingerprints connect; rows that are near to no other go."""
    for table, cuts in _chunks(batches, ["hub"]):
        node, size = table.column("node").to_numpy(), table.column("size").to_numpy()
        words = np.frombuffer(b"".join(table.column("print").to_pylist()), np.uint64).reshape(table.num_rows, -1)

        def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            small, large = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])  # noqa: B023
            return ((small < SHORT) | (np.bitwise_count(words[a] ^ words[b]).sum(axis=-1) <= RADIUS)) & (large - small <= large * (100 - EDIT_PERCENT) // 100)  # noqa: B023

        group = _near_groups(cuts, near)
        order = np.lexsort((node, group))
        group, node = group[order], node[order]
        opens = np.flatnonzero(np.concatenate([group[:1] == group[:1], group[1:] != group[:-1]]))
        hub = np.repeat(node[opens], np.diff(np.append(opens, len(node))))
        more = np.ones(len(node), bool)
        more[opens] = False
        yield pa.RecordBatch.from_arrays([pa.array(hub[more]), pa.array(node[more])], names=["hub", "node"])


def _pairs_within(cuts: np.ndarray, at_once: int = 1 << 15, most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of each group of consecutive rows, about at_once at once; groups of more than most rows are left out."""
    sizes = np.diff(cuts)
    # Each row goes with those after it in its group.
    after = np.repeat(cuts[1:], sizes) - np.arange(cuts[-1]) - 1
    if most is not None:
        after[np.repeat(sizes > most, sizes)] = 0
    rows = np.flatnonzero(after)
    after = after[rows]
    done = np.cumsum(after)
    lo = 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] - after[lo] + at_once, side="right")))
        a, each = np.repeat(rows[lo:hi], after[lo:hi]), after[lo:hi]
        yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(each) - each, each)
        lo = hi


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is most at most, by bit vectors: one step for each character of b.

    What both begin and end with is left out first.
    """
    if a == b:
        return True
    lo, top = 0, min(len(a), len(b))
    for back in (False, True):
        # The longest common beginning, then end, by bisection over slices.
        lo, hi = 0, top
        while lo < hi:
            mid = (lo + hi + 1) // 2
            same = a[len(a) - mid :] == b[len(b) - mid :] if back else a[:mid] == b[:mid]
            lo, hi = (mid, hi) if same else (lo, mid - 1)
        a, b = (a[: len(a) - lo], b[: len(b) - lo]) if back else (a[lo:], b[lo:])
        top = min(len(a), len(b))
    if len(a) < len(b):
        a, b = b, a
    if len(a) <= most:
        return True
    if len(a) - len(b) > most:
        return False
    if not b:
        return len(a) <= most
    return _by_bits(a, b, most)


def _by_bits(a: str, b: str, most: int) -> bool:
    """Edit distance within most by bit vectors along a band of diagonals (see edits); a is the longer one."""
    off = len(a) - len(b)
    low = (most - off) // 2
    peq: dict[str, int] = {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | 1 << i + low
    full, top = (1 << off + 2 * low + 1) - 1, off + low
    plus, minus, distance = full >> low << low, 0, off
    for j, c in enumerate(b):
        match = peq.get(c, 0) >> j & full
        diagonal = (((match & plus) + plus) ^ plus | match | minus) & full
        up = minus | ~(diagonal | plus) & full
        down = diagonal & plus
        if not diagonal >> top & 1:
            distance += 1
            if distance > most:
                return False
        diagonal >>= 1
        plus, minus = down | ~(diagonal | up) & full, diagonal & up
    return distance <= most


class Lines:
    """Decides by edit distance; lines whose fingerprints, sizes or runs are too far apart aren't looked at."""

    MANY = True

    def __init__(self, rows: pa.Table):
        self.rows = rows.column("line").combine_chunks()
        self.size = rows.column("size").to_numpy().astype(np.int64)
        self.words = np.frombuffer(b"".join(rows.column("print").to_pylist()), np.uint64).reshape(rows.num_rows, PRINT_BITS // 64)
        points = np.frombuffer("".join(self.rows.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.lines = edits.Lines(points, self.size)
        # How often each line has the runs of GRAM characters of each of BUCKETS classes.
        self.runs = np.zeros((rows.num_rows, BUCKETS), np.uint8)
        opens = np.cumsum(self.size) - self.size
        for lo in range(0, rows.num_rows, 1024):
            sizes = self.size[lo : lo + 1024]
            owner = np.repeat(np.arange(len(sizes)), sizes)
            own = points[opens[lo] : opens[lo] + len(owner)].astype(np.uint64)
            h = own
            for k in range(1, GRAM):
                h = h[:-1] * _GRAM + own[k:]
            whole = owner[: len(h)] == owner[len(owner) - len(h) :]
            counts = np.bincount(owner[: len(h)][whole] * BUCKETS + (mix(h[whole]) % np.uint64(BUCKETS)).astype(np.int64), minlength=len(sizes) * BUCKETS)
            self.runs[lo : lo + 1024] = np.minimum(counts, 255).reshape(-1, BUCKETS)

    def far(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        off = np.bitwise_count(self.words[a] ^ self.words[b]).sum(axis=1)
        small, large = np.minimum(self.size[a], self.size[b]), np.maximum(self.size[a], self.size[b])
        may = ((small < SHORT) | (off <= RADIUS)) & (large - small <= large * (100 - EDIT_PERCENT) // 100)
        return np.where(may, off.astype(float), np.inf)

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        most = np.maximum(self.size[a], self.size[b]) * (100 - EDIT_PERCENT) // 100
        for k in range(0, len(a), 512):
            x, y = self.runs[a[k : k + 512]], self.runs[b[k : k + 512]]
            # Each edit takes GRAM runs from a line at most, and adds as many; classes and counts that end at 255 only hide some.
            out[k : k + 512] = (np.maximum(x, y) - np.minimum(x, y)).sum(axis=1, dtype=np.int64) <= 2 * GRAM * most[k : k + 512]
        # A step of one pair alone costs less than a step of many, so few pairs of long lines are taken one by one.
        words = np.minimum(most // 64, edits.WORDS)
        alone = (words == edits.WORDS) | (np.bincount(words[out], minlength=edits.WORDS + 1) < FEW)[words]
        some = np.flatnonzero(out & ~alone)
        one = np.flatnonzero(out & alone)
        out[some] = self.lines.within(a[some], b[some], most[some])
        for k in one.tolist():
            out[k] = within(self.rows[int(a[k])].as_py(), self.rows[int(b[k])].as_py(), int(most[k]))
        return out


def _without(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their text's lines at lines_gone left out, and what became of them."""
    for batch in small(batches):
        at = batch.schema.get_field_index("text")
        left, every, dropped, emptied = [], [], [], []
        for text, gone in zip(batch.column(at), batch.column(batch.schema.get_field_index("lines_gone")), strict=True):
            text, out = text.as_py(), set(gone.as_py() or ())
            lines = text.split("\n") if text is not None else []
            if out:
                text = "\n".join([x for k, x in enumerate(lines) if k not in out])
            left.append(text)
            every.append(len(lines))
            dropped.append(len(out))
            emptied.append(bool(out) and not text.strip())
        columns = batch.columns
        columns[at] = pa.array(left, batch.schema.field(at).type)
        yield pa.RecordBatch.from_arrays([*columns, pa.array(every, pa.int32()), pa.array(dropped, pa.int32()), pa.array(emptied, pa.bool_())], names=[*batch.schema.names, "lines_all", "lines_dropped", "emptied"])


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the repeated lines gone from text, and lines_all, lines_dropped and emptied beside their columns."""
    columns = docs.columns
    docs, names = aside(docs, ("doc_id", "text", "n_chars"))
    base = docs.withColumn("lines_tid", F.xxhash64("text"))
    texts = base.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lines_tid").alias("tid"), "text")
    rows = settle(map_arrow(texts, _line_rows, "doc_id long, tid long, pos int, h long, print binary, size int"))
    classes = rows.groupBy("h").agg(F.min(F.struct("doc_id", "tid", "pos")).alias("first"), F.count("*").alias("n"), F.first("print", True).alias("print"), F.first("size", True).alias("size"))
    classes = settle(classes)
    fat, rows = rows, settle(rows.select("doc_id", "tid", "pos", "h"))
    forget(fat)
    # One shuffle of the keys: they are many, and few are shared. As blocks they take 12 bytes each.
    keys = map_arrow(texts.select("text"), _key_rows, "part int, block binary, bags binary").repartition("part").sortWithinPartitions("part")
    every = settle(map_arrow(keys, _likely_stars, "hub long, node long").distinct())
    stars = settle(_near_stars(every, classes.select(F.col("h").alias("node"), "print", "size")))
    forget(every)

    def payload(nodes: DataFrame) -> DataFrame:
        own = classes.join(nodes.withColumnRenamed("node", "h"), "h").select("first.doc_id", "first.tid", "first.pos")
        places = own.groupBy("doc_id", "tid").agg(F.collect_set("pos").alias("places"))
        held = texts.alias("t").join(places.alias("w"), F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t.tid") == F.col("w.tid"))).select("text", "places")
        lines = map_arrow(held, _wanted_lines, "node long, line string").dropDuplicates(["node"])
        return settle(lines.join(classes.select(F.col("h").alias("node"), "print", "size"), "node"))

    links = compared_stars(stars, payload, Lines)
    groups = settle(components(links))
    # Classes that occur once and are in no group have nothing to drop.
    grouped = classes.join(groups.withColumnRenamed("node", "h"), "h", "left").join(groups.select(F.col("component").alias("h"), F.lit(True).alias("head")).distinct(), "h", "left")
    many = settle(grouped.where("n > 1 or component is not null or head").select("h", F.coalesce("component", "h").alias("component"), "first"))
    kept = many.groupBy("component").agg(F.min("first").alias("kept"))
    repeated = many.join(kept, "component").select("h", "kept")
    gone = rows.select("doc_id", "tid", "pos", "h").join(repeated, "h").where(~F.struct("doc_id", "tid", "pos").eqNullSafe(F.col("kept")))
    gone = settle(gone.groupBy("doc_id", "tid").agg(F.collect_set("pos").alias("lines_gone")).select(F.col("doc_id").alias("lines_doc"), F.col("tid").alias("lines_of"), "lines_gone"))
    forget(rows, classes, stars, groups, many)
    found = base.join(gone, (F.col("doc_id").cast("long").eqNullSafe(F.col("lines_doc"))) & (F.col("lines_tid") == F.col("lines_of")), "left").drop("lines_doc", "lines_of", "lines_tid")
    more = StructType(list(found.schema)).add("lines_all", IntegerType()).add("lines_dropped", IntegerType()).add("emptied", BooleanType())
    out = map_arrow(found, _without, more).drop("lines_gone")
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return restored(out, columns, names, "lines_all", "lines_dropped", "emptied")


def _near_stars(stars: DataFrame, prints: DataFrame) -> DataFrame:
    """Stars without the nodes whose fingerprints are near to none with the same hub. stars: hub, node; prints: node, print, size.

    Hubs of more than a block keep all their nodes: their blocks are compared with each other.
    """
    large = stars.groupBy("hub").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("hub")
    few = stars.join(large, "hub", "left_anti")
    members = few.unionByName(few.select("hub", F.col("hub").alias("node")).distinct()).join(prints, "node")
    near = map_arrow(members.repartition("hub").sortWithinPartitions("hub", "node"), _plausible, "hub long, node long").where("hub <> node")
    return near.unionByName(stars.join(large, "hub", "left_semi")).distinct()
