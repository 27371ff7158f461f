"""Secret scans: fixed patterns plus sliding-window Shannon entropy, in built-in expressions only.

Defined results: a null or empty text has no spans; repeated rows give repeated results;
extra columns are ignored; offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadproof.llm.common import table

#: The base patterns, each with the group and length that a match must reach.
_WORDS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
BASE = (
    ("assign", rf"""({_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
#: Any text in which a base pattern can succeed matches its probe; probes are cheap to try.
PROBES = {"assign": rf"""({_WORDS})["']?\x20*[:=]""", "access": r"AKIA[A-Z0-9]{12}", "hex": r"[0-9a-f]{32}"}

#: Entropy: strings of at least CANDIDATE characters are scanned by windows of WINDOW.
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: Character classes in the order tried, with the least bits a character of a hot window.
CLASSES = (("entropy_hex", r"^[0-9a-fA-F]+$", 3.0), ("entropy_alnum", r"^[A-Za-z0-9]+$", 3.7), ("entropy_base64", r"^[A-Za-z0-9+/_-]+$", 3.8))
#: Candidates that are never secrets: words, numbers, UUIDs, joined words, paths, placeholders.
ALLOW = (
    r"^[A-Za-z]+$",
    r"^[0-9]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[A-Za-z]+([-_/][A-Za-z]+)+$",
    r"^/?[a-z0-9]+(/[a-z0-9]+){2,}/?$",
    r"EXAMPLE|example|XXXX|xxxx|0123456789|abcdefgh",
)
KINDS = (*(k for k, *_ in BASE), *(k for k, *_ in CLASSES))
_SPAN = "array<struct<start:int,rank:int,end:int>>"
_SCALE = 1_000_000


def _scaled(c: int) -> int:
    return round(c * math.log2(c) * _SCALE) if c else 0


def _most(bits: float) -> int:
    """The largest scaled sum of c*log2(c) over a window whose entropy reaches the bits."""
    return math.floor((WINDOW * math.log2(WINDOW) - WINDOW * bits) * _SCALE)


def _ends(lengths: Column) -> Column:
    """Running sums, in blocks so that the work stays near linear in the number of matches."""
    block, one = 256, F.lit(1)

    def run(part: Column) -> Column:
        return F.aggregate(part, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x)))

    starts = F.when(F.size(lengths) > 0, F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / block).cast("int"))).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(starts, lambda b: run(F.slice(lengths, b * block + one, F.lit(block))))
    shifts = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.try_element_at(acc, F.lit(-1)) + F.try_element_at(x, F.lit(-1)))))
    return F.flatten(F.zip_with(blocks, F.slice(shifts, one, F.size(blocks)), lambda x, s: F.transform(x, lambda v: v + s)))


def _found(df: DataFrame, name: str, pattern: str, group: int, probe: str) -> DataFrame:
    """Adds name: the pattern's matches, leftmost and without overlap, as structs (start, end, part)."""
    empty = F.array().cast("array<string>")
    text = F.when(F.col("_text").rlike(probe), F.col("_text"))
    df = df.withColumn("_hot", text)
    df = df.withColumns({
        "_whole": F.coalesce(F.regexp_extract_all("_hot", F.lit(pattern), F.lit(0)), empty),
        "_part": F.coalesce(F.regexp_extract_all("_hot", F.lit(pattern), F.lit(group)), empty),
        "_gaps": F.coalesce(F.split("_hot", pattern, -1), empty),
    })
    df = df.withColumn("_ends", _ends(F.zip_with(F.slice("_gaps", F.lit(1), F.size("_whole")), "_whole", lambda g, m: F.length(g) + F.length(m))))
    both = F.arrays_zip(F.col("_ends").alias("end"), F.col("_whole").alias("whole"), F.col("_part").alias("part"))
    return df.withColumn(name, F.transform(both, lambda x: F.struct((x["end"] - F.length(x["whole"])).alias("start"), x["end"].alias("end"), x["part"].alias("part")))).drop("_hot", "_whole", "_part", "_gaps", "_ends")


def _hot_windows(codes: Column, most: Column) -> Column:
    """Joined windows whose entropy is high enough, by counts kept from one position to the next."""
    table_ = F.array(*[F.lit(_scaled(c)).cast("long") for c in range(WINDOW + 2)])
    at = lambda c: F.try_element_at(table_, c + 1)
    start = F.struct(
        F.array_repeat(F.lit(0), 128).alias("n"), F.lit(0).cast("long").alias("s"), F.lit(0).alias("i"), F.array().cast("array<struct<from:int,to:int>>").alias("runs")
    )

    def step(state: Column, code: Column) -> Column:
        i = state["i"]
        out = F.when(i >= WINDOW, F.try_element_at(codes, i - WINDOW + 1)).otherwise(F.lit(-1))
        grown, gone = F.try_element_at(state["n"], code + 1), F.when(i >= WINDOW, F.try_element_at(state["n"], F.greatest(out, F.lit(0)) + 1)).otherwise(F.lit(0))
        s = F.when(out == code, state["s"]).otherwise(state["s"] + at(grown + 1) - at(grown) + F.when(out >= 0, at(F.greatest(gone, F.lit(1)) - 1) - at(gone)).otherwise(F.lit(0).cast("long")))
        n = F.when(out == code, state["n"]).otherwise(F.transform(state["n"], lambda v, k: v + F.when(k == code, 1).when(k == out, -1).otherwise(0)))
        last = F.try_element_at(state["runs"], F.lit(-1))
        new = F.struct((i - WINDOW + 1).alias("from"), (i + 1).alias("to"))
        joined = F.concat(F.slice(state["runs"], F.lit(1), F.greatest(F.size(state["runs"]) - 1, F.lit(0))), F.array(F.struct(last["from"].alias("from"), (i + 1).alias("to"))))
        hot = (i >= WINDOW - 1) & (s <= most)
        runs = F.when(hot & (F.size(state["runs"]) > 0) & (last["to"] >= i - WINDOW + 1), joined).when(hot, F.concat(state["runs"], F.array(new))).otherwise(state["runs"])
        return F.struct(n.alias("n"), s.alias("s"), (i + 1).alias("i"), runs.alias("runs"))

    return F.aggregate(codes, start, step)["runs"]


def _long_enough(df: DataFrame, name: str, rank: int, least: int) -> DataFrame:
    kept = F.filter(name, lambda x: F.length(x["part"]) >= least)
    return df.withColumn(name, F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"))))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: tuple[str, ...] = ALLOW, keep_text: bool = False) -> DataFrame:
    """One row per input row: id, base and spans, arrays of (start, rank, end) in order; rank indexes KINDS."""
    df = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        df = _long_enough(_found(df, f"_{kind}", pattern, group, PROBES[kind]), f"_{kind}", rank, least)
    df = df.withColumn("_base", F.array_sort(F.concat(*[F.col(f"_{k}") for k, *_ in BASE])))
    df = _found(df, "_strings", CANDIDATE, 0, CANDIDATE)
    plain = lambda x: F.array_contains(F.array(*[x["part"].rlike(p) for p in allow]), True) if allow else F.lit(False)
    df = df.withColumn("_strings", F.filter("_strings", lambda x: ~plain(x)))

    def ranked(x: Column) -> Column:
        hexes, alnum = x["part"].rlike(CLASSES[0][1]), x["part"].rlike(CLASSES[1][1])
        limits = [F.lit(_most(b)).cast("long") for _, _, b in CLASSES]
        rank = F.when(hexes, F.lit(len(BASE))).when(alnum, F.lit(len(BASE) + 1)).otherwise(F.lit(len(BASE) + 2))
        most = F.when(hexes, limits[0]).when(alnum, limits[1]).otherwise(limits[2])
        return F.struct(x["start"].alias("start"), rank.alias("rank"), most.alias("most"), F.transform(F.filter(F.split(x["part"], ""), lambda c: c != ""), F.ascii).alias("codes"))

    df = df.withColumn("_strings", F.transform("_strings", ranked))
    df = df.withColumn("_strings", F.transform("_strings", lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), _hot_windows(x["codes"], x["most"]).alias("runs"))))
    added = F.flatten(F.transform("_strings", lambda x: F.transform(x["runs"], lambda r: F.struct((x["start"] + r["from"]).alias("start"), x["rank"].alias("rank"), (x["start"] + r["to"]).alias("end")))))
    cols = [F.col("_id").alias(id_col), *([F.col("_text").alias(text_col)] if keep_text else [])]
    return df.select(*cols, F.col("_base").cast(_SPAN).alias("base"), F.array_sort(F.concat("_base", added)).cast(_SPAN).alias("spans"))


def rendered(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.try_element_at(names, x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def mask_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows with each secret replaced by the mark; overlapping spans share one. A null text stays null.

    The other columns are kept as they are. Runs in the same row, without a join.
    """
    names = df.columns
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(f"`{text_col}`").alias("_body"))
    found = find_secrets(packed, "_row", "_body", keep_text=True)
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at"))

    def step(state: Column, x: Column) -> Column:
        piece = F.col("_body").substr(state["at"] + 1, F.greatest(x["start"] - state["at"], F.lit(0)))
        apart = x["start"] >= state["at"]
        return F.struct(F.when(apart, F.concat(state["parts"], F.array(piece, F.lit(mark)))).otherwise(state["parts"]).alias("parts"), F.greatest(state["at"], x["end"]).alias("at"))

    cut = found.withColumn("_cut", F.when(F.size("spans") > 0, F.aggregate("spans", start, step)))
    text = F.when(F.col("_cut").isNull(), F.col(f"_row.`{text_col}`")).otherwise(F.concat(F.array_join("_cut.parts", ""), F.col("_body").substr(F.col("_cut.at") + 1, F.length("_body"))))
    return cut.select(*[text.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in names])


def op8_secret_scans(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda r: F.size(F.filter("base", lambda x: x["rank"] == r)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(rendered("base"), 256).alias("base_sha256"), rendered("spans").alias("spans")
    )


def _sql() -> str:
    base, rows = [], []
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        p = pattern.replace("'", "''")
        base.append(f"""m{rank} AS (SELECT rid, unnest(range(1, len(w) + 1)) i, w, g, q FROM (SELECT rid, regexp_extract_all(t, '{p}', 0) w, regexp_extract_all(t, '{p}', {group}) g, regexp_split_to_array(t, '{p}') q FROM d) WHERE len(w) > 0),
s{rank} AS (SELECT rid, {rank} rk, st, st + length(w[i]) en FROM (SELECT *, CAST(list_sum(list_transform(q[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[:i-1], lambda x: length(x))), 0) AS BIGINT) st FROM m{rank}) WHERE length(g[i]) >= {least})""")
        rows.append(f"SELECT * FROM s{rank}")
    allow = " OR ".join("regexp_matches(c, '" + p.replace("'", "''") + "')" for p in ALLOW)
    rank = "CASE " + " ".join(f"WHEN regexp_matches(c, '{p}') THEN {len(BASE) + i}" for i, (_, p, _) in enumerate(CLASSES)) + " END"
    most = "CASE rk " + " ".join(f"WHEN {len(BASE) + i} THEN {_most(b)}" for i, (*_, b) in enumerate(CLASSES)) + " END"
    table_ = "[" + ", ".join(str(_scaled(c)) for c in range(WINDOW + 1)) + "]"
    kinds = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    return f"""WITH d AS (SELECT row_number() OVER () rid, doc_id, coalesce(text, '') t FROM documents),
{", ".join(base)},
base AS ({" UNION ALL ".join(rows)}),
c0 AS (SELECT rid, unnest(range(1, len(w) + 1)) i, w, q FROM (SELECT rid, regexp_extract_all(t, '{CANDIDATE}') w, regexp_split_to_array(t, '{CANDIDATE}') q FROM d) WHERE len(w) > 0),
c1 AS (SELECT rid, w[i] c, CAST(list_sum(list_transform(q[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[:i-1], lambda x: length(x))), 0) AS BIGINT) st FROM c0),
c2 AS (SELECT row_number() OVER () cid, rid, c, st, {rank} rk FROM c1 WHERE NOT ({allow})),
win AS (SELECT cid, rid, rk, st, c, unnest(range(0, length(c) - {WINDOW} + 1)) o FROM c2),
ch AS (SELECT cid, rid, rk, st, o, unnest(string_split(substr(c, o + 1, {WINDOW}), '')) x FROM win),
n AS (SELECT cid, rid, rk, st, o, x, count(*) k FROM ch GROUP BY ALL),
hot AS (SELECT cid, rid, rk, st, o FROM n GROUP BY cid, rid, rk, st, o HAVING sum({table_}[k + 1]) <= {most}),
isl AS (SELECT *, sum(brk) OVER (PARTITION BY cid ORDER BY o) g FROM (SELECT *, CASE WHEN o - lag(o) OVER (PARTITION BY cid ORDER BY o) <= {WINDOW} THEN 0 ELSE 1 END brk FROM hot)),
extra AS (SELECT rid, rk, CAST(st + min(o) AS BIGINT) s, CAST(st + max(o) + {WINDOW} AS BIGINT) e FROM isl GROUP BY cid, rid, rk, st, g),
b AS (SELECT rid, count(*) FILTER (rk = 0) n0, count(*) FILTER (rk = 1) n1, count(*) FILTER (rk = 2) n2, string_agg({kinds}[rk + 1] || ':' || st || ':' || en, ',' ORDER BY st, rk, en) v FROM base GROUP BY rid),
a AS (SELECT rid, string_agg({kinds}[rk + 1] || ':' || st || ':' || en, ',' ORDER BY st, rk, en) v FROM (SELECT * FROM base UNION ALL SELECT * FROM extra) GROUP BY rid)
SELECT doc_id, coalesce(n0, 0) n_assign, coalesce(n1, 0) n_access, coalesce(n2, 0) n_hex, sha256(coalesce(b.v, '')) base_sha256, coalesce(a.v, '') spans FROM d LEFT JOIN b USING (rid) LEFT JOIN a USING (rid)"""


OP8_SQL = _sql()
