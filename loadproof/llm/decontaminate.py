"""Benchmark decontamination: one Aho-Corasick automaton over the items' word windows.

Words are runs of digits, ASCII letters (lower-cased) and non-ASCII characters. The automaton's
keys are windows of consecutive words, each word led by one space, so that a match always covers
whole words. A text is normalised to the same form and scanned once; word numbers lead back to
offsets in the original text.

Defined results: null or empty texts have no words and no hits; items without words have no
windows; repeated rows give repeated results; a repeated or shared window counts for each item
that has it; null item ids are left out; texts of any length are scanned whole; an empty benchmark hits
nothing, and no documents give no rows; extra columns are ignored by benchmark_hits and kept by
drop_contaminated, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadproof.llm.common import filter_texts, small_batches, stored, table

#: Words in a window.
WINDOW = 10
#: Characters of benchmark text that one automaton takes; a larger benchmark, as measured, is scanned in
#: parts, a pass for each, so what the driver and a worker hold doesn't grow with it.
BLOCK_CHARS = 4_000_000

#: Bytes to words: A-Z to lower case; other ASCII that is no digit or letter to a space.
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32) for c in range(256))
_WORD = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

HITS = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("hit", pa.list_(pa.int32())), ("items", pa.list_(pa.int64())), ("spans", pa.string())])


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows(tokens: list[bytes], size: int = WINDOW) -> set[str]:
    """Windows as automaton keys: every word led by a space, bytes as Latin-1 characters."""
    found = [tokens[i : i + size] for i in range(max(1, len(tokens) - size + 1))] if tokens else []
    return {b" ".join([b"", *w]).decode("latin-1") for w in found}


def automaton(items: list[tuple[int, str]], size: int = WINDOW):
    import ahocorasick

    out, seen = ahocorasick.Automaton(), {}
    for item, text in items:
        for key in windows(words(text), size):
            seen.setdefault(key, set()).add(item)
    for key, owners in seen.items():
        out.add_word(key + " ", (key.count(" "), len(key) + 1, sorted(owners)))
    if seen:
        out.make_automaton()
    return out if seen else None


def scan(text: str | None, machine) -> tuple[int, np.ndarray, list[int]]:
    """Words, the numbers of those hit, and the items that have a window here."""
    tokens = words(text)
    if not tokens or machine is None:
        return len(tokens), np.empty(0, np.int32), []
    line = b" ".join([b"", *tokens, b""]).decode("latin-1")
    if not (found := list(machine.iter(line))):
        return len(tokens), np.empty(0, np.int32), []
    spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    cover, items = np.zeros(len(tokens) + 1, np.int32), set()
    for end, (n, length, owners) in found:
        first = int(np.searchsorted(spaces, end - length + 1))
        cover[first] += 1
        cover[first + n] -= 1
        items.update(owners)
    return len(tokens), np.flatnonzero(np.cumsum(cover[:-1]) > 0).astype(np.int32), sorted(items)


def parts_of(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> tuple[DataFrame, int]:
    """(item, text, part) of the items that have both, and the number of parts; measured, so that a part has about limit characters. An item is never cut."""
    rows = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text")).dropna()
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-chars // limit))
    return rows.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(n))), n


def _scanned(rows: DataFrame, items: DataFrame, part: int, size: int) -> DataFrame:
    """(id, n_words, hit, items, spans) of (id, text) against one part, whose automaton each task builds once."""
    small_batches(rows.sparkSession)
    # about the limit in characters, by the count of parts_of
    held = rows.sparkSession.sparkContext.broadcast([tuple(r) for r in items.where(F.col("part") == part).select("item", "text").toLocalIterator()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(held.value, size)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [scan(t, machine) for t in texts]
            spans = pa.array([spans_text(t, r[1]) for t, r in zip(texts, found, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in found], pa.int64()), pa.array([r[1] for r in found], pa.list_(pa.int32())), pa.array([r[2] for r in found], pa.list_(pa.int64())), spans], schema=HITS
            )

    return rows.select("id", "text").mapInArrow(run, "id long, n_words long, hit array<int>, items array<long>, spans string")


def _in_parts(rows: DataFrame, items: DataFrame, n: int, size: int) -> DataFrame:
    """(id, n_words, hit, items) by a pass for each part, for ids that are unique; only rows with hits meet again."""
    first, *others = (_scanned(rows, items, k, size) for k in range(n))
    more = reduce(DataFrame.union, others).where(F.size("items") > 0)
    merged = more.groupBy(F.col("id").alias("_id")).agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(f"_{c}") for c in ("hit", "items")])
    joined = first.join(merged, F.col("id") == F.col("_id"), "left")
    both = lambda c: F.when(F.col("_id").isNull(), F.col(c)).otherwise(F.array_sort(F.array_union(c, f"_{c}"))).alias(c)
    return joined.select("id", "n_words", both("hit"), both("items"))


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """One row per document: id, n_words, hit (numbers of the words hit), items (ids of items found), spans (`start:end` of each run of hit words in the original text)."""
    items, n = parts_of(benchmark, item_col, item_text_col, block_chars)
    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("own"), F.col(f"`{text_col}`").cast("string").alias("text"))
    if n == 1:
        return _scanned(picked.withColumnRenamed("own", "id"), items, 0, size).withColumnRenamed("id", id_col)
    rows = stored(picked.withColumn("id", F.monotonically_increasing_id()))
    found = _in_parts(rows, items, n, size).join(rows, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [spans_text(t, w) for t, w in zip(batch.column(4).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(spans, pa.string())], schema=HITS)

    placed = found.select("own", "n_words", "hit", "items", "text").mapInArrow(run, "id long, n_words long, hit array<int>, items array<long>, spans string")
    return placed.withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows whose text has no window of any item, all columns kept."""
    items, n = parts_of(benchmark, item_col, item_text_col, block_chars)
    if n > 1:
        names = docs.columns
        rows = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"), F.monotonically_increasing_id().alias("id")))
        hits = _in_parts(rows, items, n, size).where(F.size("items") > 0).select("id")
        return rows.join(hits, "id", "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in names])
    held = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in items.select("item", "text").toLocalIterator()])

    def start():
        machine = automaton(held.value, size)
        return lambda texts: [not scan(t, machine)[2] for t in texts]

    return filter_texts(docs, text_col, start)


def hit_spans(text: str, hit: list[int]) -> list[tuple[int, int]]:
    """Offsets in the original text of each run of hit words, end exclusive."""
    if not len(hit):
        return []
    at, out = [m.span() for m in _WORD.finditer(text)], []
    for k, w in enumerate(hit):
        if k and w == hit[k - 1] + 1:
            out[-1] = (out[-1][0], at[w][1])
        else:
            out.append(at[w])
    return out


def spans_text(text: str | None, hit: list[int]) -> str:
    return ",".join(f"{a}:{b}" for a, b in hit_spans(text or "", hit))


def items_digest(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    n_hit = F.size("hit").cast("long")
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "spans"
    )


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: What stands before each word: nothing before the first, if the text begins with it.
_BETWEEN = rf"list_concat(CASE WHEN regexp_matches({_LOWER}, '^[\x00-\x2F\x3A-\x60\x7B-\x7F]') THEN [] ELSE [''] END, regexp_extract_all({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'))"
OP9_SQL = rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () rid, doc_id, {_WORDS} w, {_BETWEEN} b FROM documents),
b AS (SELECT item_id, w, least(len(w), {WINDOW}) z FROM (SELECT item_id, {_WORDS} w FROM benchmark) WHERE len(w) > 0 AND item_id IS NOT NULL),
k AS (SELECT DISTINCT item_id, z, list_aggregate(w[i : i + z - 1], 'string_agg', ' ') g FROM (SELECT item_id, w, z, unnest(range(1, len(w) - z + 2)) i FROM b)),
sizes AS (SELECT DISTINCT z FROM k),
g AS (SELECT rid, i, z, list_aggregate(w[i : i + z - 1], 'string_agg', ' ') g FROM (SELECT rid, w, z, unnest(range(1, len(w) - z + 2)) i FROM d, sizes WHERE len(w) >= z)),
h AS (SELECT rid, i, z, item_id FROM g JOIN k USING (z, g)),
n AS (SELECT rid, count(DISTINCT p) n FROM (SELECT rid, unnest(range(i, i + z)) p FROM h) GROUP BY rid),
p AS (SELECT DISTINCT rid, unnest(range(i, i + z)) p FROM h),
o AS (SELECT rid, p, sum(lb + lw) OVER (PARTITION BY rid ORDER BY p) - lw st, lw FROM (SELECT rid, unnest(range(1, len(w) + 1)) p, unnest(list_transform(w, lambda x: length(x))) lw, unnest(list_transform(b[1 : len(w)], lambda x: length(x))) lb FROM d WHERE rid IN (SELECT rid FROM h))),
r AS (SELECT rid, min(st) a, max(st + lw) z FROM (SELECT rid, p, st, lw, p - row_number() OVER (PARTITION BY rid ORDER BY p) g FROM p JOIN o USING (rid, p)) GROUP BY rid, g),
t AS (SELECT rid, string_agg(a || ':' || z, ',' ORDER BY a) spans FROM r GROUP BY rid),
s AS (SELECT rid, count(*) n, string_agg(x, ',' ORDER BY x) v FROM (SELECT DISTINCT rid, item_id::VARCHAR x FROM h) GROUP BY rid)
SELECT doc_id, len(w) n_words, coalesce(n.n, 0) n_hit, coalesce(s.n, 0) n_items, sha256(coalesce(v, '')) items_sha256, coalesce(n.n, 0) > 0 contaminated, coalesce(t.spans, '') spans
FROM d LEFT JOIN n USING (rid) LEFT JOIN s USING (rid) LEFT JOIN t USING (rid)"""
