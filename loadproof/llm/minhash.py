"""Near duplicates by one-permutation MinHash with optimal densification.

A text's set holds its distinct 5-word shingles as 60-bit hashes. Two sets link when
100 * intersection >= 85 * union.

1. One hash of each shingle deals it to one of BINS bins; a bin keeps its least hash. An empty bin takes the
   value of the first filled one in its own fixed random order of all bins (optimal densification). ROWS bins
   make a band and a band's hash a bucket; equal sets are one node, so copies of a text meet nowhere. A
   pair that just links shares no bucket with a probability of (1 - 0.85 ** ROWS) ** BANDS, 6e-9.
2. A bucket's candidates are a star: its members against its hub, the member that shares most buckets with others, so that the
   buckets of a family have few hubs and a member few edges. Edges are confirmed on the full sets.
3. A star can miss a link between two members that aren't linked to the hub. Buckets whose members lie in several components
   are therefore tried once more: the members outside the bucket's largest component against all
   others, in blocks of bounded weight, pairs of one component or without a common band skipped. Only links that join come out.

Nothing about all documents reaches the driver but a filter of FILTER bits. Buckets and hubs with more than a thousandth of the rows are at
most a thousand for each band; what is known of them is sent to all, and their rows stay spread.

Defined results: a null text or one without words has an empty set, links with nothing and is its own
component; with fewer than five words the whole sequence is the one shingle; equal sets are linked; a null id is
left out of the smallest id but its row is kept, with the component of the others of its class, if any has an id; rows that repeat an id
come out each; a row is kept if its id is its component's, both null included; an empty table gives no rows; extra columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadproof.llm.common import small_batches, stored, table
from loadproof.llm.components import components
from loadproof.llm.jaccard import shingle_sets

NEED, OF = 85, 100
ROWS, BANDS = 6, 40
BINS = ROWS * BANDS
#: A bucket, hub or set with more than one in so many rows is hot; so many parts its rows are dealt to.
HOT, SALTS = 1000, 64
#: Bits of the filter that tells the texts whose sets are needed again.
FILTER = 1 << 25
#: Weight of a block: each set counts its shingles, BINS at least.
BLOCK = 1_000_000

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20261128))
#: For each bin, all bins in the order in which it borrows.
_ORDER = np.argsort(_RNG.random((BINS, BINS)), axis=1).astype(np.int16)
_MUL = _RNG.integers(0, 2**64, BINS, dtype=_U) | _U(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BINS values for each set, which must not be empty: the least hash of each bin, empty bins densified."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if len(sets) else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    # a set's hashes ascend, and with them its bins, so the first of each bin is its least
    slot = owner * BINS + (((flat.view(_U) >> _U(28)) * _U(BINS)) >> _U(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])[: len(slot)])
    out = np.zeros(len(sets) * BINS, np.int64)
    filled = np.zeros(len(sets) * BINS, bool)
    out[slot[first]] = flat[first]
    filled[slot[first]] = True
    empty = np.flatnonzero(~filled)
    for attempt in range(BINS):
        if not len(empty):
            break
        lender = empty - empty % BINS + _ORDER[empty % BINS, attempt]
        hit = filled[lender]
        out[empty[hit]] = out[lender[hit]]
        empty = empty[~hit]
    return out.reshape(len(sets), BINS)


def bands(sigs: np.ndarray) -> np.ndarray:
    """A row of BANDS bucket numbers for each signature; the bands' numbers differ by their multipliers."""
    x = (sigs.view(_U) * _MUL).reshape(len(sigs), BANDS, ROWS).sum(axis=2, dtype=_U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return (x ^ (x >> _U(31))).view(np.int64)


def links(one: np.ndarray, other: np.ndarray) -> bool:
    """Whether two ascending sets link."""
    common = len(np.intersect1d(one, other, assume_unique=True))
    return OF * common >= NEED * (len(one) + len(other) - common)


def set_key(tokens: np.ndarray) -> bytes | None:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None


def _rows(docs: DataFrame) -> DataFrame:
    """(id, tid, key, n, bands) of (id, tid, text); key and bands are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(2).to_pylist()))
            full = [s for s in sets if len(s)]
            buckets = iter(bands(signatures(full)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(map(set_key, sets), pa.binary()), pa.array(map(len, sets), pa.int64()), pa.array([next(buckets) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                names=["id", "tid", "key", "n", "bands"],
            )

    return docs.select("id", "tid", "text").mapInArrow(run, "id long, tid long, key binary, n long, bands array<long>")


def _bits(values: DataFrame) -> np.ndarray:
    """A filter that the column `tid` sets, in 64-bit words."""
    bit = F.pmod("tid", F.lit(FILTER))
    words = values.groupBy(F.shiftright(bit, 6).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(tid, {FILTER}) % 64 as int))")).alias("v")).toArrow()
    out = np.zeros(FILTER // 64, np.int64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return out


def _sets(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(key, sid, n, tokens) of the chosen nodes (key, tid): their texts are shingled again, one row of each set in a task."""
    seen = docs.sparkSession.sparkContext.broadcast(_bits(chosen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, done = seen.value, set()
        for batch in batches:
            slot = batch.column(0).to_numpy() % FILTER
            wanted = batch.filter(pa.array(((words[slot >> 6] >> (slot & 63)) & 1).astype(bool)))
            found = {}
            for tokens in shingle_sets(wanted.column(1).to_pylist()):
                if (key := set_key(tokens)) and key not in done:
                    found[key] = tokens
                    done.add(key)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.list_(pa.int64()))], names=["key", "tokens"])

    again = docs.select("tid", "text").mapInArrow(run, "key binary, tokens array<long>").join(chosen.select("key"), "key", "left_semi").dropDuplicates(["key"])
    return again.select("key", F.xxhash64("key").alias("sid"), F.size("tokens").cast("long").alias("n"), "tokens")


def _with(rows: DataFrame, known: DataFrame, on: str, limit: int) -> DataFrame:
    """rows joined to known (on, m, ..), m being how many rows have that value: those of more than `limit` are few and sent to all, so that their rows stay where they are."""
    hot = F.broadcast(known.where(F.col("m") > limit))
    return rows.join(hot, on).unionByName(rows.join(known.where(F.col("m") <= limit), on))


def _confirmed(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) among the edges (key, hub), tested on full sets; a hub of many edges meets them in SALTS parts."""
    edges = stored(edges.select("key", "hub"))
    total = edges.count()
    hot = F.broadcast(stored(edges.groupBy("hub").count().where(F.col("count") > total // HOT).select("hub", F.lit(True).alias("hot"))))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("key", F.lit(5)), F.lit(SALTS))).otherwise(0).cast("int")
    dealt = edges.join(hot, "hub", "left").select("key", "hub", salt.alias("salt"))
    hubs = sets.join(edges.select(F.col("hub").alias("sid")).distinct(), "sid", "left_semi")
    hubs = hubs.select(F.col("sid").alias("hub"), F.col("key").alias("hub_key"), F.col("n").alias("hub_n"), F.col("tokens").alias("hub_tokens")).join(hot, "hub", "left")
    hubs = hubs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("hot"), SALTS - 1).otherwise(0)))).drop("hot")
    fits = OF * F.least("n", "hub_n") >= NEED * F.greatest("n", "hub_n")
    both = dealt.join(sets.select("key", "n", "tokens"), "key").join(hubs, ["hub", "salt"]).where((F.col("key") != F.col("hub_key")) & fits)
    common = F.size(F.array_intersect("tokens", "hub_tokens"))
    return both.where(OF * common >= NEED * (F.col("n") + F.col("hub_n") - common)).select(F.col("key").alias("a"), F.col("hub_key").alias("b"))


def _labelled(rows: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """rows with the component of a node; a node without a link is its own."""
    return rows.join(labels.select(F.col("node").alias(key), F.col("label").alias("_label")), key, "left").withColumn(label, F.coalesce("_label", key)).drop("_label")


def _rest(members: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """Blocks (bucket, i, j, minor, key, label) of members of buckets that hold several components.

    Buckets with the same members are taken once. A bucket's members outside its heaviest component (minor) meet all its
    members, in pairs of blocks of bounded weight.
    """
    labelled = stored(_labelled(members.select("bucket", "key", F.greatest("n", F.lit(BINS)).alias("n")), labels, "key", "label"))
    by_label = labelled.groupBy("bucket", "label").agg(F.sum("n").alias("w"), F.count("*").alias("m"), F.sum(F.xxhash64("key").cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(7), "key")).alias("x"))
    of_bucket = by_label.groupBy("bucket").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("w", "label")).alias("major"), F.sum("w").alias("all"), F.max("w").alias("most"), F.sum("m").alias("m"), F.sum("s").alias("s"), F.bit_xor("x").alias("x"))
    one = of_bucket.where("labels > 1").groupBy("m", "s", "x").agg(F.min(F.struct("bucket", "major", "all", "most")).alias("t")).select("t.*", "m")
    blocks = lambda w: F.ceil(w / BLOCK).cast("int")
    known = one.select("bucket", "major", "m", F.greatest(F.lit(1), blocks(F.col("all") - F.col("most"))).alias("bi"), blocks(F.col("all")).alias("bj"))
    dealt = _with(labelled, stored(known), "bucket", limit).withColumns({"h": F.xxhash64("key", F.lit(3)), "minor": F.col("label") != F.col("major")})
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n: F.pmod("h", F.col(n)).cast("int")
    few = dealt.where("minor").select("bucket", part("bi").alias("i"), upto("bj").alias("j"), F.lit(True).alias("minor"), "key", "label")
    return few.union(dealt.select("bucket", upto("bi").alias("i"), part("bj").alias("j"), F.lit(False).alias("minor"), "key", "label"))


def _block_links(blocks: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components among a block's minor members and its others; of those that join the same components, one."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("minor", "descending"), ("key", "ascending")])
        key, minor = group["key"].to_pylist(), group["minor"].to_numpy(zero_copy_only=False)
        label = group["label"].combine_chunks().dictionary_encode().indices.to_numpy()
        flat = group["tokens"].combine_chunks()
        sets = np.split(flat.flatten().to_numpy(), np.cumsum(pc.list_value_length(flat).to_numpy())[:-1])
        size = np.array([len(s) for s in sets])
        sigs = signatures(sets)
        buckets, root = bands(sigs), list(range(int(label.max()) + 1))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        a, b, others = [], [], np.flatnonzero(~minor)
        for r in np.flatnonzero(minor):
            fits = others[(label[others] != label[r]) & (OF * np.minimum(size[others], size[r]) >= NEED * np.maximum(size[others], size[r]))]
            fits = fits[(buckets[fits] == buckets[r]).any(axis=1)]
            # seven standard deviations below the threshold, of as many bins as either set can fill
            least = NEED / OF - 7 * np.sqrt(NEED * (OF - NEED) / OF**2 / np.minimum(np.minimum(size[fits], size[r]), BINS))
            for k in fits[(sigs[fits] == sigs[r]).mean(axis=1) >= least]:
                if find(label[r]) != find(label[k]) and links(sets[r], sets[k]):
                    root[find(label[r])] = find(label[k])
                    a.append(key[r])
                    b.append(key[k])
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    whole = blocks.join(sets.select("key", "tokens"), "key")
    return whole.groupBy("bucket", "i", "j").applyInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id that links reach) and kept."""
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text")).withColumn("tid", F.xxhash64("text"))
    rows = stored(_rows(docs))
    total = rows.count()
    # equal sets are one node, however many rows have it
    nodes = stored(rows.where("n > 0").groupBy("key").agg(F.min("id").alias("low"), F.min("tid").alias("tid"), F.max("n").alias("n"), F.count("*").alias("m"), F.first("bands").alias("bands")))
    limit = total // HOT

    postings = nodes.select("key", "n", "tid", F.xxhash64("key").alias("sid"), F.explode("bands").alias("bucket"))
    shared = stored(postings.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1"))
    members = stored(_with(postings, shared, "bucket", limit))
    # the member that shares most is a bucket's hub
    degree = members.groupBy("sid").agg(F.sum("m").alias("degree"))
    ranked = stored(members.join(degree, "sid"))
    hubs = stored(ranked.groupBy("bucket").agg(F.max(F.struct("degree", "sid")).alias("top"), F.count("*").alias("m")).select("bucket", F.col("top.sid").alias("hub"), "m"))
    star = _with(ranked.select("bucket", "key", "sid"), hubs, "bucket", limit).where("sid <> hub")
    edges = star.select("key", "hub").distinct()

    sets = stored(_sets(docs, members.select("key", "tid").distinct()))
    found = stored(_confirmed(edges, sets))
    labels = components(found)
    rest = stored(_block_links(_rest(members, labels, limit), sets))
    if not rest.isEmpty():
        labels = components(found.union(rest))

    low = labels.join(nodes.select(F.col("key").alias("node"), "low"), "node")
    linked = low.join(low.groupBy("label").agg(F.min("low").alias("least")), "label").select(F.col("node").alias("key"), "least")
    # the answers of all sets that occur repeatedly or link; a set of many rows is sent to all
    answers = stored(nodes.select("key", "low", "m").join(linked, "key", "left").where("m > 1 OR least IS NOT NULL").select("key", F.coalesce("least", "low").alias("least"), "m"))
    hot = F.broadcast(answers.where(F.col("m") > limit).select(F.col("key").alias("_hot"), F.col("least").alias("_hot_least")))
    spread = F.unhex(F.md5(F.monotonically_increasing_id().cast("string")))
    lone = F.col("key").isNull() | F.col("_hot").isNotNull()
    dealt = rows.select("id", "key", "n").join(hot, F.col("key") == F.col("_hot"), "left").withColumn("_by", F.when(lone, spread).otherwise(F.col("key")))
    out = dealt.join(answers.select(F.col("key").alias("_by"), "least"), "_by", "left")
    component = F.when(F.col("_hot").isNotNull(), F.col("_hot_least")).otherwise(F.coalesce("least", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op11_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
