"""BPE encoding and decoding over a table of distinct words.

A word here is the text between two spaces, with the space before it. A space that is followed by a
non-space always begins a new piece of byte-level BPE, so the ids of a text are the ids of its words, joined by
position; texts in which a space is followed by white space or by the end are cut only where that holds.

Distinct words are counted over all documents. Those that occur at least twice, the most frequent first up to a
fixed bound, are encoded once, in Spark; their ids are joined to the vocabulary's pieces, and the pieces, joined
in order, are the words' decoded bytes. That table, whose size the bound proves, is sent out, and a text takes ids and
bytes from it by position. What is left (words that occur once, very long words, and words beyond the bound) is
encoded where it occurs, once for each run of documents: sending such a word to another machine and back
moves more than it saves.

encode_by_join is the same with joins alone and without a bound: chunks of texts report their distinct words, each
distinct word is encoded once, and words are joined back to their chunks and meet the chunks' texts. It
moves several times the input where most words are rare; the README has the figures.

Defined results: a null text counts as empty (no ids); empty tables give no rows; words and texts of any length are
taken whole; repeated rows give repeated results; extra columns of any name are ignored; the special
token's string is one id, as the library has it by default.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadproof.llm.common import small_batches, stored, table

#: The most words in the table that every worker holds, and the most characters of one of them.
TABLE_WORDS, WORD_CHARS = 200_000, 48
#: Rows of one chunk, as a power of two; distinct words that a task gathers before it passes them on.
CHUNK, LOCAL_WORDS = 14, 150_000
#: Words outside the table that a task remembers.
CACHED_WORDS = 50_000
#: Bytes of text in one partition of the last step.
PART_BYTES = 64_000_000

_ODD = re.compile(r" (?:\s|\Z)")
_CUT = re.compile(r" (?=\S)")
#: Letters for which the two libraries' character classes agree (ASCII, Latin); other words take the slower one.
_PLAIN = re.compile(r"[\x20-\x7e\n\xc0-\xd6\xd8-\xf6\xf8-ɏ]*")


class Codec:
    """One tokenizer file: words to packed ids, packed ids to text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.no_truncation()
        self.slow.no_padding()
        self.special = {t.content: i for i, t in self.slow.get_added_tokens_decoder().items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = self.slow.get_vocab_size()
        names = [self.slow.id_to_token(i) or "" for i in range(size)]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.pieces = [n.encode() if n in self.special else bytes(back[c] for c in n) for n in names]
        self.fast = self._ranks(path)

    def _ranks(self, path: str):
        """The same vocabulary as merge ranks, for words on which both libraries agree; None: always the slow one."""
        import tiktoken
        from tokenizers.pre_tokenizers import ByteLevel

        before = self.slow.pre_tokenizer
        if self.slow.normalizer is not None or not isinstance(before, ByteLevel) or before.add_prefix_space:
            return None
        ranks = {p: i for i, p in enumerate(self.pieces) if i not in self.special.values() and p}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def tokens(self, part: str) -> list[int]:
        if part in self.special:
            return [self.special[part]]
        if self.fast and _PLAIN.fullmatch(part):
            return self.fast.encode_ordinary(part)
        return self.slow.encode(part, add_special_tokens=False).ids

    def parts(self, text: str) -> list[str]:
        """The words of a text in order; special tokens stand as parts of their own."""
        out: list[str] = []
        for part in self.split.split(text) if self.split and any(s in text for s in self.special) else [text]:
            if part in self.special:
                out.append(part)
            elif part:
                first, *rest = _CUT.split(part) if _ODD.search(part) else part.split(" ")
                out += [first, *(" " + w for w in rest)] if first else [" " + w for w in rest]
        return out

    def ids(self, part: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return np.array(self.tokens(part), "<u4").tobytes()

    def bytes_of(self, packed: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(packed, "<u4").tolist()))

    def text(self, text: str, known: dict[str, bytes], local: dict[str, bytes]) -> tuple[bytes, bytes]:
        """Ids and decoded bytes of a whole text from its words' own, by position; words not known are kept in local."""
        parts = self.parts(text)
        got: list = list(map(known.get, parts))
        if None in got:
            long = False
            for i, one in enumerate(got):
                if one is None:
                    if (one := local.get(parts[i])) is None:
                        ids = self.tokens(parts[i])
                        one = packed(struct.pack(f"<{len(ids)}I", *ids), b"".join(map(self.pieces.__getitem__, ids)))
                        if len(one) > 1:
                            long = True
                        else:
                            if len(local) >= CACHED_WORDS:
                                local.clear()
                            one = local[parts[i]] = one[0]
                    got[i] = one
            if long:
                got = [x for one in got for x in (one if type(one) is list else (one,))]
        return b"".join([x[1 : 1 + 4 * x[0]] for x in got]), b"".join([x[1 + 4 * x[0] :] for x in got])


def packed(ids: bytes, decoded: bytes) -> list[bytes]:
    """A word's ids and bytes as one value (number of ids, ids, bytes), which takes half the memory of two; several for more than 255 ids."""
    if len(ids) <= 1020:
        return [bytes((len(ids) // 4,)) + ids + decoded]
    runs = [ids[i : i + 1020] for i in range(0, len(ids), 1020)]
    return [bytes([len(r) // 4]) + r + (b"" if k else decoded) for k, r in enumerate(runs)]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(token, piece) of the tokenizer file, pieces as hexadecimal bytes: a table of the size of the vocabulary."""
    pieces = codec(path).pieces
    return spark.createDataFrame(pa.table({"token": pa.array(range(len(pieces)), pa.int32()), "piece": pa.array([x.hex() for x in pieces], pa.string())}))


def _joined(rows: DataFrame, keys: list[str], pieces: DataFrame) -> DataFrame:
    """(keys, bytes) of (keys, ids): ids joined to their pieces, pieces joined in order; an unknown id is an error."""
    each = rows.select(*keys, F.posexplode_outer("ids").alias("at", "token"))
    with_piece = each.join(F.broadcast(pieces), "token", "left")  # the vocabulary has a fixed size
    piece = F.when(F.col("token").isNull(), "").otherwise(F.coalesce("piece", F.raise_error(F.concat(F.lit("unknown id "), F.col("token").cast("string")))))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("at", piece.alias("piece")))), lambda x: x["piece"])
    return with_piece.groupBy(*keys).agg(F.unhex(F.array_join(in_order, "")).alias("bytes"))


def _chunk() -> Column:
    return F.shiftright(F.monotonically_increasing_id(), CHUNK)


def _encoded(words: DataFrame, path: str) -> DataFrame:
    """(word, ids, bytes) of distinct words: ids by the tokenizer, bytes by the join to the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            ids = [np.frombuffer(c.ids(w), "<i4") for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    ids = stored(words.select("word").mapInArrow(run, "word string, ids array<int>"))
    return ids.join(_joined(ids, ["word"], vocabulary(words.sparkSession, path)), "word")


def word_counts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Distinct words of up to WORD_CHARS characters and how often they occur, over all documents; counted in each task before the shuffle."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(counts: Counter) -> pa.RecordBatch:
            kept = [w for w in counts if len(w) <= WORD_CHARS]
            return pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array(map(counts.__getitem__, kept), pa.int64())], names=["word", "n"])

        c, counts = codec(path), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(c.parts(text))
                if len(counts) > LOCAL_WORDS:
                    yield rows(counts)
                    counts = Counter()
        if counts:
            yield rows(counts)

    return docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_table(docs: DataFrame, path: str, text_col: str = "text", most: int = TABLE_WORDS) -> dict[str, bytes]:
    """The table of distinct words with their ids and bytes, packed: those that occur twice or more, at most so many."""
    counts = stored(word_counts(docs, path, text_col).where("n > 1"))
    least, total = 2, 0
    capped = F.least("n", F.lit(10_000)).alias("n")
    for n, words in sorted(((r[0], r[1]) for r in counts.groupBy(capped).count().collect()), reverse=True):
        if (total := total + words) > most:
            least = n + 1
            break
    got = _encoded(counts.where(F.col("n") >= least), path).toArrow()
    ids = got.column(1).combine_chunks()
    values, ends = ids.flatten().to_numpy().astype("<u4"), ids.offsets.to_numpy() - ids.offsets[0].as_py()
    values_ = (packed(values[a:b].tobytes(), x)[0] for a, b, x in zip(ends[:-1], ends[1:], got.column(2).to_pylist(), strict=True))
    return dict(zip(got.column(0).to_pylist(), values_, strict=True))  # up to WORD_CHARS characters are at most 192 ids


def _fields(keep_ids: bool) -> tuple[list, str]:
    fields = [("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *([("ids", pa.list_(pa.int32()))] if keep_ids else [])]
    return fields, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")


def _batch(ids: list[int], made: list[tuple[bytes, bytes]], fields: list) -> pa.RecordBatch:
    """Result rows from documents' ids, packed token ids and decoded bytes."""
    cols = [
        pa.array(ids, pa.int64()),
        pa.array([len(p) // 4 for p, _ in made], pa.int64()),
        pa.array([hashlib.sha256(p).hexdigest() for p, _ in made], pa.string()),
        pa.array([hashlib.sha256(b.decode("utf-8", "replace").encode()).hexdigest() for _, b in made], pa.string()),
    ]
    if len(fields) > len(cols):
        cols.append(pa.array([np.frombuffer(p, "<i4") for p, _ in made], pa.list_(pa.int32())))
    return pa.RecordBatch.from_arrays(cols, schema=pa.schema(fields))


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, most: int = TABLE_WORDS) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    path = path or default_path()
    held = spark.sparkContext.broadcast(word_table(docs, path, text_col, most))
    fields, schema = _fields(keep_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, known, local = codec(path), held.value, {}
        for batch in batches:
            yield _batch(batch.column(0).to_pylist(), [c.text(t, known, local) if t else (b"", b"") for t in batch.column(1).to_pylist()], fields)

    out = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return out.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def chunk_words(docs: DataFrame, path: str, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(chunk, word) of the distinct words of each chunk of rows that lie together, and (word, ids, bytes) of all distinct words."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, seen, at = codec(path), set(), None
        rows = lambda: pa.RecordBatch.from_arrays([pa.array([at] * len(seen), pa.int64()), pa.array(list(seen), pa.string())], names=["chunk", "word"])
        for batch in batches:
            for chunk, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if seen and (chunk != at or len(seen) > LOCAL_WORDS):
                    yield rows()
                    seen = set()
                at = chunk
                if text:
                    seen.update(c.parts(text))
        if seen:
            yield rows()

    pairs = stored(docs.select(_chunk().alias("chunk"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "chunk long, word string"))
    return pairs, _encoded(pairs.distinct().select("word").distinct(), path)


def encode_by_join(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """As encode, with joins alone.

    A chunk's words and texts are sorted together, words first, so a task holds the words of one chunk and streams its
    texts. Chunks are told by the place of rows in their partition; should a lost task's rows come in another order
    when they are read again, a word that its chunk then lacks is encoded where it stands, with the same result.
    """
    spark: SparkSession = docs.sparkSession
    path = path or default_path()
    pairs, words = chunk_words(docs, path, text_col)
    text = F.col(f"`{text_col}`").cast("string")
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // PART_BYTES) + 1)
    none = F.lit(None)
    of_words = pairs.join(words, "word").select("chunk", F.lit(0).alias("kind"), none.cast("long").alias("id"), F.col("word").alias("text"), "ids", "bytes")
    of_texts = docs.select(_chunk().alias("chunk"), F.lit(1).alias("kind"), F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"), none.cast("array<int>").alias("ids"), none.cast("binary").alias("bytes"))
    met = of_words.unionByName(of_texts).repartition(parts, "chunk").sortWithinPartitions("chunk", "kind")
    fields, schema = _fields(keep_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, known, local, at = codec(path), {}, {}, None
        for batch in batches:
            rows, made = [], []
            for chunk, kind, own, text, ids, piece in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if chunk != at:
                    known, local, at = {}, {}, chunk
                if kind == 0:
                    if len(ids) < 256:
                        known[text] = packed(np.array(ids, "<u4").tobytes(), piece)[0]
                else:
                    rows.append(own)
                    made.append(c.text(text, known, local) if text else (b"", b""))
            if rows:
                yield _batch(rows, made, fields)

    return met.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(rows: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: id and the text of its ids, by a join to the vocabulary; null ids give an empty text, an unknown id an error."""
    spark = rows.sparkSession
    small_batches(spark)
    # stored, so that the number that tells rows apart is one
    picked = stored(rows.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([b.decode("utf-8", "replace") for b in batch.column(2).to_pylist()], pa.string())], names=["id", "text"])

    return _joined(picked, ["row", "id"], vocabulary(spark, path or default_path())).mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def op5_bpe_encoding(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), default_path(), keep_ids=False)
