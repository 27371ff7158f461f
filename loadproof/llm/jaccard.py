"""N-gram Jaccard join by prefix trees, and the near-duplicate classes that it gives.

A text's set holds its distinct 5-word shingles as 60-bit hashes. Two sets link when
100 * intersection >= 75 * union.

1. Any two linked sets share the first tokens of their intersection, all of which lie in the
   first part of either set (prefix filter, here with several common tokens asked for). Only texts
   enough of whose prefix, in the order of the hashes, other texts share stay; each run of
   documents reports a token once, so that a token in a third of all texts is a few rows a run.
2. The sets of those texts are ordered anew, rare tokens first, by ranks of their frequency; the
   ranks of at most RANKED tokens are sent out, and all others rank as rare, which keeps one global
   order whatever the size. The sets then meet by prefix token. The least text of each token is its leader; a
   leader's set is looked up in a trie of the sets that share a token with it: the trie's paths
   share partial overlaps, and a subtree ends where the tokens that remain can't reach the
   threshold. The links' components follow.
3. A token whose texts lie in one component by now can add nothing. The sets of the others are
   joined in full, block against block within a token, each block a trie; pairs in one component are
   skipped. That makes the components exact, without a row for each pair of a large group.

Tries of one task hold a bounded block of sets; nothing about all documents reaches the driver.

Texts are told by 128-bit digests and shingles by 60-bit hashes; in the first step alone texts are numbered by
64-bit hashes, and of two with one number in a run the second isn't counted there.

Defined results: a null text or one without words has an empty set and is its own component;
with fewer than five words the whole sequence is the one shingle; equal texts are linked;
a null id is left out of the smallest id but its row is kept; rows that repeat an id share its
component where their texts do; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadproof.llm.common import small_batches, stored, table
from loadproof.llm.components import components
from loadproof.sources.scratch import forget

SIZE, NEED, OF = 5, 75, 100
#: Postings gathered before a task reports them, sets in one block of a trie, text bytes a partition.
RUN, BLOCK, PART_BYTES = 500_000, 128, 16_000_000
#: Bytes of text that are hashed at once, unless one text is longer; a piece takes about 60 times as much.
PIECE = 1 << 18
#: The most texts of a family whose pairs are tried family-wise.
FAMILY = 4096
#: How many times larger the blocks of larger families are.
WIDE = 16
#: Tokens whose frequency rank every worker holds; slots of the filter that thins out texts before the exact join.
RANKED, SLOTS = 2_000_000, 1 << 21
#: A text with more than one in so many rows has its answer sent to all.
HOT = 1000
#: Buckets of tokens for each partition; a run's tokens of one bucket are one row, and several even partitions out.
BUCKETS = 8
#: Bits of the filter that tells tokens that occur once.
BITS = 1 << 25

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240607))
_CODE = _RNG.integers(0, 2**64, 256, dtype=_U)
_STEP = _RNG.integers(0, 2**64, SIZE, dtype=_U) | _U(1)
_BASE = 0x9E3779B97F4A7C15 & ~7 | 5
#: Hashes keep 60 bits, so that a rank of eight can stand before them in one positive integer.
_SHIFT, _RANK = _U(4), 60
_BACK = pow(_BASE, -1, 2**64)
_POWERS: list[np.ndarray] = [np.empty(0, _U), np.empty(0, _U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _BACK)):
            steps = np.full(max(n + n // 8, PIECE), base, _U)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _hashed(texts: list[bytes]) -> list[np.ndarray]:
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(_CODE[data] * up[: len(data)], dtype=_U)])
    word = _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * _STEP[0])
    n = len(word) - SIZE + 1
    runs = np.zeros(max(n, 0), _U)
    for i in range(SIZE if n > 0 else 0):
        runs += word[i : i + n] * _STEP[i]
    runs = (_mix(runs) >> _SHIFT).view(np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    at, out = np.searchsorted(starts, offsets), []
    for first, last in zip(at[:-1], at[1:], strict=True):
        if last - first >= SIZE:
            out.append(np.unique(runs[first : last - SIZE + 1]))
        elif last > first:
            short = np.array([sum(int(word[first + i]) * int(_STEP[i]) for i in range(last - first)) + int(last - first)], dtype=object) % 2**64
            out.append((_mix(short.astype(_U)) >> _SHIFT).view(np.int64))
        else:
            out.append(np.empty(0, np.int64))
    return out


def shingle_sets(texts: list[str | None], size: int = PIECE) -> Iterator[np.ndarray]:
    """The hashed shingles of each text, ascending; long runs of texts are taken in pieces."""
    part, held = [], 0
    for text in texts:
        part.append((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
        held += len(part[-1])
        if held >= size:
            yield from _hashed(part)
            part, held = [], 0
    if part:
        yield from _hashed(part)


def _least(n):
    """The least intersection that a set of n can have with a linked one."""
    return (n * NEED + OF - 1) // OF


def _shared(n):
    """Common tokens that the longer prefix is laid out for; a partner may be smaller than the set."""
    return 1 + n // 10


def _prefix(n):
    return n - _least(n) + _shared(n)


def links(one: np.ndarray, other: np.ndarray) -> bool:
    """Whether two ascending sets link."""
    common = len(np.intersect1d(one, other, assume_unique=True))
    return OF * common >= NEED * (len(one) + len(other) - common)


class Trie:
    """Ascending sets as the paths of a prefix tree: sorted, each with the length it shares with the last."""

    def __init__(self, sets: list[list[int]]):
        self.order = sorted(range(len(sets)), key=sets.__getitem__)
        self.sets = [sets[i] for i in self.order]
        self.common = [0]
        for a, b in zip(self.sets, self.sets[1:], strict=False):
            n, most = 0, min(len(a), len(b))
            while n < most and a[n] == b[n]:
                n += 1
            self.common.append(n)

    def linked(self, probe: list[int], wanted=None, first: int | None = None) -> Iterator[int]:
        """Numbers of the sets that link with the probe; only of those wanted, if it is given.

        first: only sets whose least common token with the probe it is; others end their subtree.
        """
        inside, size = {x: i + 1 for i, x in enumerate(probe)}, len(probe)
        # at[d]: overlap of the first d tokens of the path, and the probe's place after the last common one
        at, cut = [(0, 0)], None
        for number, path, common in zip(self.order, self.sets, self.common, strict=True):
            n = len(path)
            if cut is not None and common > cut:
                continue  # below a pruned node
            cut = None
            depth = min(common, len(at) - 1)
            del at[depth + 1 :]
            need = -(-NEED * (n + size) // (OF + NEED))
            # lengths differ within a subtree, so a prune for all of it takes the least that any partner needs
            low = max(_least(size), 1)
            if min(n, size) < need or wanted and not wanted(number):
                continue
            overlap, place = at[depth]
            while depth < n:
                where = inside.get(path[depth])
                if where:
                    overlap, place = overlap + 1, where
                    if overlap == 1 and first is not None and path[depth] != first:
                        cut = depth
                        break
                depth += 1
                at.append((overlap, place))
                if overlap + size - place < low:
                    cut = depth - 1  # nothing below can reach even the least
                    break
                if overlap + min(n - depth, size - place) < need:
                    break
            else:
                if overlap >= need:
                    yield number


def _set_rows(docs: DataFrame, key: str) -> DataFrame:
    """(key, n, tokens) of (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array(sets, pa.list_(pa.int64()))], names=["key", "n", "tokens"])

    return docs.select(F.col(key).alias("key"), "text").mapInArrow(run, "key binary, n int, tokens array<long>")


def _sizes(docs: DataFrame) -> DataFrame:
    """(id, key, n) of (id, key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(s) for s in shingle_sets(batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["id", "key", "n"])

    return docs.select("id", "key", "text").mapInArrow(run, "id long, key binary, n long")


def _counts(sets: DataFrame, parts: int) -> DataFrame:
    """(token, count) of the tokens that several of the sets hold; a batch of sets reports a token once, a bucket as one row."""
    buckets = BUCKETS * parts

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, count = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            order, used, (ends, _) = _by_bucket(token, None, buckets)
            cells = [_cut(token[order], ends), _cut(count[order].astype(np.int32), ends)]
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *cells], names=["bucket", "token", "count"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [(_whole(b.column(1), np.int64)[0], _whole(b.column(2), np.int32)[0]) for b in batches]
        if pairs:
            token, count = (np.concatenate(x) for x in zip(*pairs, strict=True))
            order = np.argsort(token)
            token, count = token[order], count[order].astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])[: len(token)])
            if len(first):
                token, count = token[first], np.add.reduceat(count, first)
                yield pa.RecordBatch.from_arrays([pa.array(token[count > 1]), pa.array(count[count > 1])], names=["token", "count"])

    rows = sets.select("tokens").mapInArrow(counted, "bucket int, token binary, count binary")
    return rows.repartition(parts, "bucket").mapInArrow(added, "token long, count long")


def _ranks(sets: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeated tokens, ascending, with their rank (1: twice or three times .. 7: 4096 times and more), the most
    frequent, at most RANKED; and a filter of BITS bits, in 64-bit words, that all repeated tokens set."""
    counts = _counts(sets, parts)
    rank = F.array_size(F.filter(F.array(*[F.lit(x) for x in (2, 4, 8, 16, 64, 256, 4096)]), lambda x: x <= F.col("count")))
    ranked = stored(counts.select("token", rank.alias("rank")))
    least, total = 1, 0
    for value, tokens in sorted(((r[0], r[1]) for r in ranked.groupBy("rank").count().collect()), reverse=True):
        if (total := total + tokens) > RANKED:
            least = value + 1
            break
    got = ranked.where(F.col("rank") >= least).toArrow()
    tokens, ranks = got.column(0).to_numpy(), got.column(1).to_numpy().astype(np.int8)
    order = np.argsort(tokens)
    bit = F.pmod("token", F.lit(BITS))
    words = ranked.groupBy(F.shiftright(bit, 6).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(token, {BITS}) % 64 as int))")).alias("v")).toArrow()
    seen = np.zeros(BITS // 64, np.int64)
    seen[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return tokens[order], ranks[order], seen


def _ordered(sets: DataFrame, ranks) -> DataFrame:
    """The sets with each token led by its rank, ascending: rare tokens first, in one global order.

    A set fewer of whose tokens are repeated than any link needs is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank, seen = ranks.value
        for batch in batches:
            flat, n = batch.column(2).flatten().to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            slot = flat % BITS
            repeated = (seen[slot >> 6] >> (slot & 63)) & 1
            if len(known) and len(flat):
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                flat = flat + (np.where(known[at] == flat, rank[at], 0).astype(np.int64) << _RANK)
            ends = np.cumsum(n)
            kept = np.bincount(np.repeat(np.arange(len(n)), n), repeated, len(n)) >= _least(n)
            parts = [np.sort(x) for x, k in zip(np.split(flat, ends[:-1]), kept, strict=True) if k] if len(n) else []
            mask = pa.array(kept)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask), pa.array(parts, pa.list_(pa.int64()))], names=["key", "n", "tokens"])

    return sets.mapInArrow(run, "key binary, n int, tokens array<long>")


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings (token, sid, c, n) of rows (sid, text), run by run."""

    def rows(sids: list[int], sets: list[np.ndarray], sizes: list[int]) -> pa.RecordBatch:
        tokens = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
        sets.clear()
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        del order
        first = np.concatenate([[True], tokens[1:] != tokens[:-1]])
        lone = first & np.concatenate([first[1:], [True]])
        counts = np.bincount(owner[~lone], minlength=len(sids))
        ids = np.array(sids, np.int64)
        tokens, owner = tokens[first], owner[first]
        held = pa.array(ids[owner], pa.int64(), mask=~lone[first])
        zero = np.zeros(len(tokens), np.int32)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([tokens, ids])),
                pa.concat_arrays([held, pa.array(ids, pa.int64())]),
                pa.array(np.concatenate([zero, counts.astype(np.int32) + 1])),
                pa.array(np.concatenate([zero, np.array(sizes, np.int32)])),
            ],
            names=["token", "sid", "c", "n"],
        )

    sids, sets, sizes, seen, held = [], [], [], set(), 0
    for batch in batches:
        keys = batch.column(0).to_pylist()
        for sid, tokens in zip(keys, shingle_sets(batch.column(1).to_pylist()), strict=True):
            if len(tokens) and sid not in seen:
                seen.add(sid)
                sids.append(sid)
                sizes.append(len(tokens))
                sets.append(tokens[: _prefix(len(tokens))].copy())
                held += len(sets[-1])
                if held >= RUN:
                    yield rows(sids, sets, sizes)
                    sids, sets, sizes, seen, held = [], [], [], set(), 0
    if sids:
        yield rows(sids, sets, sizes)


def _cut(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The values' bytes as binary cells, each up to the next of the ends."""
    offsets = np.concatenate([[0], ends * values.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _whole(cells: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """What _cut was given: the values of all cells, and how many each has."""
    kind = np.dtype(kind)
    if not len(cells):
        return np.empty(0, kind), np.empty(0, np.int64)
    offsets = np.frombuffer(cells.buffers()[1], np.int32, len(cells) + 1, 4 * cells.offset).astype(np.int64)
    size = int(offsets[-1] - offsets[0])
    values = np.frombuffer(cells.buffers()[2], kind, size // kind.itemsize, int(offsets[0])) if size else np.empty(0, kind)
    return values, np.diff(offsets) // kind.itemsize


def _by_bucket(token: np.ndarray, last: np.ndarray | None, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by bucket, those marked as last at each bucket's end; the buckets that occur, and (all, not last) ends of each."""
    bucket = (token % buckets).astype(np.uint16 if buckets <= 1 << 16 else np.int32)
    marked = np.zeros(len(token), bool) if last is None else last
    order = np.flatnonzero(~marked)
    order = np.concatenate([order, np.flatnonzero(marked)])
    order = order[np.argsort(bucket[order], kind="stable")]
    every, front = np.bincount(bucket, minlength=buckets), np.bincount(bucket[~marked], minlength=buckets)
    used = np.flatnonzero(every)
    return order, used, np.stack([np.cumsum(every[used]), np.cumsum(front[used])])


def _packed(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, token, sid, c, n) of bytes from the postings of _reported: for a run and bucket its tokens, those with a sid
    first, and these sids; for a run one row more with all sids, c and n of its texts."""
    for batch in batches:
        token, c, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3))
        none, sid = batch.column(1).is_null().to_numpy(zero_copy_only=False), batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
        own = c > 0
        ids, c, n = sid[own], c[own], n[own]
        token, sid, none = token[~own], sid[~own], none[~own]
        order, used, (ends, front) = _by_bucket(token, none, buckets)
        token, sid = token[order], sid[order][~none[order]]
        nothing, one = np.zeros(len(used), np.int64), np.zeros(1, np.int64)
        bucket = np.append(used, int(ids[0]) % buckets).astype(np.int32)
        cells = [
            [_cut(token, ends), _cut(token[:0], one)],
            [_cut(sid, front), _cut(ids, one + len(ids))],
            [_cut(c[:0], nothing), _cut(c, one + len(c))],
            [_cut(n[:0], nothing), _cut(n, one + len(n))],
        ]
        yield pa.RecordBatch.from_arrays([pa.array(bucket), *[pa.concat_arrays(x) for x in cells]], names=["bucket", "token", "sid", "c", "n"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sid, c, n) of the postings of some buckets: how many of their tokens each text shares with others."""
    tokens, sids, null = [], [], []
    out = ["sid", "c", "n"]
    for batch in batches:
        token, many = _whole(batch.column(1), np.int64)
        sid, known = _whole(batch.column(2), np.int64)
        own = np.repeat(many == 0, known)
        if own.any():
            c, n = (_whole(batch.column(k), np.int32)[0] for k in (3, 4))
            yield pa.RecordBatch.from_arrays([pa.array(sid[own]), pa.array(c.astype(np.int64) - 1), pa.array(n)], names=out)
        if len(token):
            none = np.arange(len(token)) - np.repeat(np.cumsum(many) - many, many) >= np.repeat(known, many)
            whole = np.zeros(len(token), np.int64)
            whole[~none] = sid[~own]
            tokens.append(token)
            sids.append(whole)
            null.append(none)
    if not tokens:
        return
    token, sid, none = (np.concatenate(x) for x in (tokens, sids, null))
    del tokens, sids, null
    order = np.argsort(token)
    token, sid, none = token[order], sid[order], none[order]
    # a token that one text alone has, told by its one posting, adds nothing
    again = token[1:] == token[:-1]
    kept = none | np.concatenate([[False], again]) | np.concatenate([again, [False]])
    token, sid, none = token[kept], sid[kept], none[kept]
    if not len(token):
        return
    order = np.lexsort((sid, token))
    token, sid, none = token[order], sid[order], none[order]
    del order
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    size = np.diff(np.append(first, len(token)))
    low, high = np.minimum.reduceat(sid, first), np.maximum.reduceat(sid, first)
    shared = np.repeat((low != high) | np.logical_or.reduceat(none, first), size)
    # a text may have been reported by several runs; it counts once for a token
    again = np.concatenate([[False], (token[1:] == token[:-1]) & (sid[1:] == sid[:-1])])
    ids, counts = np.unique(sid[shared & ~none & ~again], return_counts=True)
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts.astype(np.int64)), pa.array(np.zeros(len(ids), np.int32))], names=out)


def _candidates(docs: DataFrame, parts: int) -> DataFrame:
    """Short keys of the texts that share enough of their prefix with other texts.

    Postings of _reported: (token, sid, c, n). c = 0: a posting, null sid if the run has counted all
    of its own; c > 0: c tokens of text sid, which has n, are shared (c counts one too many).
    Between the steps those of a run and bucket are one row, as rows of single ones cost several times as much.
    """
    buckets = BUCKETS * parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed(_reported(batches), buckets)

    rows = docs.select("sid", "text").mapInArrow(run, "bucket int, token binary, sid binary, c binary, n binary").repartition(parts, "bucket")
    counts = rows.mapInArrow(_met, "sid long, c long, n int").groupBy("sid").agg(F.sum("c").alias("c"), F.max("n").alias("n"))
    partner = F.ceil(F.col("n") * NEED / OF)
    return counts.where(F.col("c") >= 1 + F.floor(partner / 10)).select("sid")


def _probe(pairs: DataFrame) -> DataFrame:
    """Links among rows (leader, tokens of the leader, key, tokens of the key): a trie of a batch's members for each leader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[bytes, list[int]] = {}
            for i, leader in enumerate(batch.column(0).to_pylist()):
                groups.setdefault(leader, []).append(i)
            a, b = [], []
            for leader, rows in groups.items():
                trie = Trie([batch.column(3)[i].as_py() for i in rows])
                for k in trie.linked(batch.column(1)[rows[0]].as_py()):
                    a.append(leader)
                    b.append(batch.column(2)[rows[k]].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return pairs.mapInArrow(run, "a binary, b binary")


def _token_pairs(sets: list[np.ndarray], left: list[int], right: list[int], first: int, wanted) -> Iterator[tuple[int, int]]:
    """Wanted pairs of linked sets whose least common token is first."""
    trie = Trie([sets[k].tolist() for k in left])
    for r in right:
        for k in trie.linked(sets[r].tolist(), lambda n, r=r: wanted(left[n], r), first):
            yield left[k], r


def _prefix_pairs(sets: list[np.ndarray], left: list[int], right: list[int], wanted) -> Iterator[tuple[int, int]]:
    """Wanted pairs of linked sets, found by the tokens of their prefixes, of which linked ones share one."""
    prefix = lambda x: x[: len(x) - _least(len(x)) + 1].tolist()
    having: dict[int, list[int]] = {}

    def add(k: int) -> None:
        for token in prefix(sets[k]):
            having.setdefault(token, []).append(k)

    if left is not right:
        for k in left:
            add(k)
    for r in right:
        size = len(sets[r])
        for k in sorted({k for token in prefix(sets[r]) for k in having.get(token, ())}):
            low, high = sorted((len(sets[k]), size))
            if OF * low >= NEED * high and wanted(k, r) and links(sets[k], sets[r]):
                yield k, r
        if left is right:
            add(r)


def _block_links(members: DataFrame) -> DataFrame:
    """All links between components in pairs of blocks of members (grp, first, i, j, block, key, label, tokens).

    All members of a token's group share it, and a trie ends at sets of which it isn't the least common token. Most members
    of a family share nothing, so there only pairs with a common prefix token are tried.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("key")
        block, key, label = (group.column(c).to_pylist() for c in ("block", "key", "label"))
        i, j, first = (group.column(c)[0].as_py() for c in ("i", "j", "first"))
        sets = [x.values.to_numpy() for x in group.column("tokens")]
        left = [k for k, b in enumerate(block) if b == i]
        right = left if i == j else [k for k, b in enumerate(block) if b == j]
        root = {x: x for x in label}

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        a, b = [], []
        apart = lambda k, r: find(label[k]) != find(label[r])
        for k, r in _prefix_pairs(sets, left, right, apart) if first is None else _token_pairs(sets, left, right, first, apart):
            root[find(label[k])] = find(label[r])
            a.append(key[k])
            b.append(key[r])
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return members.groupBy("grp", "first", "i", "j").applyInArrow(run, "a binary, b binary")


def _mixed(postings: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of tokens whose texts lie in several components, dealt to pairs of blocks.

    Tokens with the same texts are taken once: number, sum and xor of the texts' hashes tell them.
    Texts that such tokens connect are a family. A family of moderate size is one group, so that a
    pair that shares many tokens is tried once; in a larger one each token is a group, which tries
    the pairs that it is the first to share.
    """
    labelled = postings.join(labels, F.col("key") == F.col("node"), "left").select("token", "key", F.coalesce("label", "key").alias("label"))
    one, two = F.xxhash64("key"), F.xxhash64(F.lit(7), "key")
    groups = labelled.groupBy("token").agg(
        F.count("*").alias("m"), F.min("label").alias("low"), F.max("label").alias("high"), F.min("key").alias("anchor"), F.sum(one.cast("decimal(20,0)")).alias("s"), F.bit_xor(two).alias("x")
    )
    open_ = groups.where("low <> high").groupBy("m", "s", "x").agg(F.min(F.struct("token", "anchor")).alias("t")).select("t.*")
    rows = stored(labelled.join(open_, "token"))
    family = components(rows.select(F.col("anchor").alias("a"), F.col("key").alias("b")).where("a <> b").distinct()).withColumnRenamed("label", "family")
    size = family.groupBy("family").agg(F.count("*").alias("size"))
    known = family.join(size, "family").withColumnRenamed("node", "key")
    rows = stored(rows.join(known, "key").select("token", "key", "label", "family", "size"))
    moderate = rows.where(F.col("size") <= FAMILY).select(F.col("family").alias("grp"), F.lit(None).cast("long").alias("first"), "key", "label", F.col("size").alias("m")).distinct()
    large = rows.where(F.col("size") > FAMILY)
    counts = large.groupBy("token").agg(F.count("*").alias("m"))
    by_token = large.join(counts, "token").select(F.col("token").cast("string").cast("binary").alias("grp"), F.col("token").alias("first"), "key", "label", "m")
    # a larger family's blocks are larger, so that its members are copied less often
    blocks = F.ceil(F.col("m") / F.when(F.col("first").isNull(), BLOCK).otherwise(WIDE * BLOCK)).cast("int")
    members = moderate.union(by_token).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key", F.lit(3)), F.col("blocks")).cast("int"))
    dealt = members.select("grp", "first", "key", "label", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("grp", "first", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "label")
    return dealt.join(sets.select("key", "tokens"), "key")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles and component_id, the smallest id that links reach."""
    return _classes(docs, id_col, text_col).drop("_key")


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of near_duplicates with the digest of each row's text as _key."""
    spark = docs.sparkSession
    small_batches(spark)
    text = F.col(f"`{text_col}`").cast("string")
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    docs = docs.withColumns({"key": F.unhex(F.md5("text")), "sid": F.xxhash64("text")})
    total, rows_ = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // PART_BYTES) + 1)

    # one row for each distinct text: its least id is the row by which it is fetched again
    texts = stored(docs.groupBy("key").agg(F.min("id").alias("low"), F.min("sid").alias("sid"), F.count("*").alias("m")))
    chosen = stored(texts.join(_candidates(docs, parts), "sid", "left_semi").select("low", F.col("key").alias("chosen"), F.pmod("sid", F.lit(SLOTS)).alias("slot")))
    # at most SLOTS rows, whatever the input; they spare most other texts the shuffle of the exact join
    slots = chosen.select("slot").distinct()
    thinned = docs.join(F.broadcast(slots), F.pmod("sid", F.lit(SLOTS)) == F.col("slot"), "left_semi").select("id", "key", "text")
    fetched = thinned.join(chosen, (F.col("key") == F.col("chosen")) & F.col("id").eqNullSafe(F.col("low")), "left_semi")
    plain = stored(_set_rows(fetched, "key").dropDuplicates(["key"]))
    sets = stored(_ordered(plain, spark.sparkContext.broadcast(_ranks(plain, parts))))
    forget(plain)

    n = F.col("n")
    prefix = n - F.floor((n * NEED + OF - 1) / OF) + 1
    postings = stored(sets.select("key", F.explode(F.slice("tokens", F.lit(1), prefix.cast("int"))).alias("token")))
    leaders = postings.groupBy("token").agg(F.min("key").alias("leader"), F.count("*").alias("m")).where("m > 1").select("token", "leader")
    pairs = postings.join(leaders, "token").where("key <> leader").select("leader", "key").distinct()
    whole = pairs.join(sets.select(F.col("key").alias("leader"), F.col("tokens").alias("of_leader")), "leader").join(sets.select("key", "tokens"), "key")
    first = stored(_probe(whole.select("leader", "of_leader", "key", "tokens")))
    labels = components(first)
    rest = stored(_block_links(_mixed(postings, sets, labels)))
    if not rest.isEmpty():
        labels = components(first.union(rest))

    low = texts.select("key", "low")
    least = labels.join(low, F.col("node") == F.col("key")).groupBy("label").agg(F.min("low").alias("least"))
    linked = labels.join(least, "label").select(F.col("node").alias("key"), "least")
    of_text = texts.join(linked, "key", "left").select("key", "m", F.coalesce("least", "low").alias("least"))
    sized = _sizes(docs)
    # texts with more than a thousandth of all rows are at most a thousand: their answer is sent to all, and their rows,
    # which would meet in one task, are dealt at random instead
    hot = F.broadcast(of_text.where(F.col("m") > rows_ // HOT).select(F.col("key").alias("_hot"), F.col("least").alias("_hot_least")))
    spread = F.unhex(F.md5(F.monotonically_increasing_id().cast("string")))
    dealt = sized.join(hot, F.col("key") == F.col("_hot"), "left").withColumn("_by", F.when(F.col("_hot").isNull(), F.col("key")).otherwise(spread))
    out = dealt.join(of_text.select(F.col("key").alias("_by"), "least"), "_by", "left")
    least = F.when(F.col("n") == 0, F.col("id")).when(F.col("_hot").isNotNull(), F.col("_hot_least")).otherwise(F.col("least"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), least.alias("component_id"), F.col("key").alias("_key"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with one document of each near-duplicate class: the one with the smallest id, once. Rows without id stay.

    Rows are told by id and text: a row goes if its own text is in a class with a smaller id, or repeats
    a row with the same id and text (one of these stays). Other texts of the same id stay, whatever becomes of
    that row. Columns of any name are kept; an empty table gives an empty one.

    Only rows in whose slot an id is to go, or occurs repeatedly, take part in a join by id; the slots
    are at most SLOTS, so that all other rows stay where they are.
    """
    goes = (F.col("id") != F.col("component")).alias("goes")
    found = stored(_classes(docs, id_col, text_col).toDF("id", "n", "component", "key").select("id", "key", goes).where("id IS NOT NULL"))
    special = stored(found.groupBy("id", "key").agg(F.bool_or("goes").alias("goes"), F.count("*").alias("n")).where("goes OR n > 1").withColumnsRenamed({"id": "sid", "key": "skey"}))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
    slots = F.broadcast(special.select(slot("sid").alias("slot")).distinct())
    names = docs.columns
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.unhex(F.md5(text)).alias("key"))
    untouched = rows.join(slots, slot("id") == F.col("slot"), "left_anti")  # rows without id have a slot too, but are in no special row
    looked_at = rows.join(slots, slot("id") == F.col("slot"), "left_semi")
    told = looked_at.where("id IS NOT NULL").join(special, (F.col("id") == F.col("sid")) & (F.col("key") == F.col("skey")), "left")
    single = told.where("goes IS NULL")
    # partial aggregates keep one row of each repeated one in a task, however many there are
    once = told.where("NOT goes").groupBy("id", "key").agg(F.first("row").alias("row"))
    parts = [untouched, looked_at.where("id IS NULL"), single, once]
    return reduce(DataFrame.union, (p.select("row") for p in parts)).select(*[F.col(f"row.`{c}`").alias(c) for c in names])


def op10_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
