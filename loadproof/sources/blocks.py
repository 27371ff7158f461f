"""Rows of dump text: row blocks cut by a parallel quote-parity scan, and their literals decoded by declared types.

A literal may hold line breaks, so whether a line begins a row depends on all quotes before it in its file. Each split
reports, for both states it may begin in, the state it ends in; a fold over a file's splits gives each one's true state, the header above it and
where the row that is open at its start began. With that, each split's rows are cut by its own task, in whatever pieces a file is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadproof.sources.scratch import stored

#: A literal that is open for more bytes than this is broken off at the next split, and its row refused.
OPEN_BYTES = 1 << 28
#: What is known of so many splits is sent to all at once; files with more are scanned in groups.
SENT_SPLITS = 2_000_000

_HEAD = re.compile(r"%class\s+(?:\[([^\]]*)\]\.)?\[([^\]]*)\]\s*\((.*)\)\s*$", re.DOTALL)
_ROW = "file string, owner string, cls string, cols array<string>, line string, open long, at long"


def _toggles(odd: np.ndarray, percent: np.ndarray, state: int) -> np.ndarray:
    """Which lines change the state; quotes in a `%` line that begins outside a literal count for nothing."""
    out = odd.copy()
    for p in np.flatnonzero(odd & percent):
        out[p] = (state + np.count_nonzero(out[:p])) % 2 == 1
    return out


def _segments(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """The batch's rows by split, ((fid, at), rows); a split's rows are neighbours."""
    fid, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    cuts = np.flatnonzero((fid[1:] != fid[:-1]) | (at[1:] != at[:-1])) + 1
    for a, b in zip([0, *cuts], [*cuts, len(fid)], strict=True):
        if b > a:
            yield (int(fid[a]), int(at[a])), batch.slice(a, b - a)


def _flags(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(part.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in (2, 3))


def _survey(lines: DataFrame) -> DataFrame:
    """For each split with a quote or header: its end state, whether it begins the row open there and its last header, for both states it may begin in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["fid", "at", "file", "end", "own", "head"]
        key, file, state, own, head = None, None, [0, 1], [False, False], [None, None]
        done = lambda: pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([file]), pa.array([state]), pa.array([own]), pa.array([head], pa.list_(pa.string()))], names=names)
        for batch in batches:
            for now, part in _segments(batch):
                if now != key:
                    if key:
                        yield done()
                    key, file, state, own, head = now, part.column(5)[0].as_py(), [0, 1], [False, False], [None, None]
                odd, percent = _flags(part)
                for h in (0, 1):
                    toggles = _toggles(odd, percent, state[h])
                    before = (state[h] + np.cumsum(toggles) - toggles) % 2
                    own[h] |= bool((toggles & (before == 0)).any())
                    heads = [x for i in np.flatnonzero(percent & (before == 0)) if (x := part.column(4)[int(i)].as_py()).startswith("%class")]
                    head[h] = heads[-1] if heads else head[h]
                    state[h] = int(before[-1] + toggles[-1]) % 2
        if key:
            yield done()

    marked = lines.where("odd OR percent").select("fid", "at", "odd", "percent", F.when(F.col("percent"), F.col("value")).alias("head"), "file")
    return marked.mapInArrow(run, "fid long, at long, file string, end array<long>, own array<boolean>, head array<string>")


def _folded(survey: DataFrame) -> DataFrame:
    """(fid, at, file, state, open, head) after each surveyed split; a group is a file's splits, of one row each."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        state, open_, head, rows = 0, None, None, []
        for at, end, own, heads in zip(*(group[c].to_pylist() for c in ("at", "end", "own", "head")), strict=True):
            if state and at - open_ > OPEN_BYTES:
                state = 0
            h, state = state, end[state]
            open_ = (at if own[h] else open_) if state else None
            head = heads[h] or head
            rows.append((state, open_, head))
        states, opens, found = zip(*rows, strict=True)
        return pa.table({"fid": group["fid"], "at": group["at"], "file": group["file"], "state": pa.array(states, pa.int64()), "open": pa.array(opens, pa.int64()), "head": pa.array(found, pa.string())})

    return survey.groupBy("fid").applyInArrow(run, "fid long, at long, file string, state long, open long, head string")


class _Known:
    """What is known after each surveyed split, as arrays: sent to all tasks, some 30 bytes a split."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by([("fid", "ascending"), ("at", "ascending")])
        self.fid, self.at, self.state = (rows[c].to_numpy() for c in ("fid", "at", "state"))
        self.open = rows["open"].fill_null(-1).to_numpy()
        head, file = (rows[c].combine_chunks().dictionary_encode() for c in ("head", "file"))
        self.head, self.heads = head.indices.fill_null(-1).to_numpy(), head.dictionary.to_pylist()
        self.open_bytes = OPEN_BYTES
        self.file, self.files = file.indices.to_numpy(), file.dictionary.to_pylist()

    def before(self, fid: int, at: int) -> tuple[str | None, int, int | None, str | None]:
        """(file, state, where the open row began, header above) at the start of a split."""
        first, last = np.searchsorted(self.fid, fid), np.searchsorted(self.fid, fid, "right")
        if first == last:
            return None, 0, None, None
        file, k = self.files[self.file[first]], first + int(np.searchsorted(self.at[first:last], at)) - 1
        if k < first:
            return file, 0, None, None
        state, open_, head = int(self.state[k]), int(self.open[k]), self.heads[self.head[k]] if self.head[k] >= 0 else None
        return (file, 1, open_, head) if state and at - open_ <= self.open_bytes else (file, 0, None, head)


def _header(text: str | None) -> tuple[str | None, str | None, list[str] | None]:
    """(owner, class, columns); without a header above, no class."""
    if text is None:
        return None, None, None
    if not (m := _HEAD.match(text)):
        return None, "", []
    return (m[1] or "").lower() or None, m[2].lower(), re.findall(r"\[([^\]]*)\]", m[3])


def _cut(lines: DataFrame, known, wanted: Sequence[str]) -> DataFrame:
    """Whole rows, and the pieces (open, at) of those that go over the end of a split: open is where their row began.

    Of a row's places those that aren't wanted are null, as they are longer than most lines; cls always stands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_, key = known.value, None
        file = head = began = None
        pieces: list[str] | None = None  # of the row that is open
        state = 0

        def left() -> pa.RecordBatch:
            return out([head], np.zeros(1, np.int64), pa.array(["\n".join(pieces)], pa.string()), [key[1] if began is None else began], key[1])

        def out(heads: list, which: np.ndarray, rows: pa.Array, opens: list | None, at: int) -> pa.RecordBatch:
            parsed, of_head = [_header(h) for h in heads], pa.array(which)
            full = opens is not None  # pieces are put together by their file
            of = lambda i, kind, name: pa.array([p[i] for p in parsed], kind).take(of_head) if full or name in wanted else pa.nulls(len(rows), kind)
            same = lambda x, kind: pa.repeat(pa.scalar(x, kind), len(rows))
            opened = same(None, pa.int64()) if opens is None else pa.array(opens, pa.int64())
            return pa.RecordBatch.from_arrays(
                [same(file if full or "file" in wanted else None, pa.string()), of(0, pa.string(), "owner"), of(1, pa.string(), "cls"), of(2, pa.list_(pa.string()), "cols"), rows, opened, same(at, pa.int64())],
                names=["file", "owner", "cls", "cols", "line", "open", "at"],
            )

        for batch in batches:
            for now, part in _segments(batch):
                if now != key:
                    if pieces is not None:
                        yield left()
                    key = now
                    file, state, began, head = all_.before(*now)
                    pieces = [] if state else None
                odd, percent = _flags(part)
                lines_ = part.column(4)
                text = lambda i, lines_=lines_: lines_[int(i)].as_py()
                some = lambda a, b, lines_=lines_: lines_[a:b].to_pylist()
                toggles = _toggles(odd, percent, state)
                before = (state + np.cumsum(toggles) - toggles) % 2
                marks = [i for i in np.flatnonzero(percent & (before == 0)) if text(i).startswith("%class")]
                heads_ = [head, *map(text, marks)]
                # rows of one line, nearly all, stay in Arrow; those of several lines are joined below
                filled = pc.not_equal(pc.utf8_trim_whitespace(lines_), "").to_numpy(zero_copy_only=False)
                single = np.flatnonzero((before == 0) & ~toggles & ~percent & filled)
                if len(single):
                    yield out(heads_, np.searchsorted(marks, single), lines_.take(pa.array(single)), None, now[1])
                which, rows, opens = [], [], []
                turns = [int(i) for i in np.flatnonzero(toggles)]
                if pieces is not None:  # a row is open as these lines begin
                    end = turns.pop(0) if turns else len(lines_) - 1
                    pieces += some(0, end + 1)
                    if toggles[end]:
                        which.append(0)
                        rows.append("\n".join(pieces))
                        opens.append(began)
                        pieces = began = None
                for a, b in zip(turns[::2], turns[1::2], strict=False):
                    which.append(np.searchsorted(marks, a))
                    rows.append("\n".join(some(a, b + 1)))
                    opens.append(None)
                if rows:
                    yield out(heads_, np.array(which, np.int64), pa.array(rows, pa.string()), opens, now[1])
                head = heads_[-1]
                if len(turns) % 2:
                    pieces, began = some(turns[-1], len(lines_)), None
                state = int(before[-1] + toggles[-1]) % 2
        if pieces is not None:
            yield left()

    return lines.select("fid", "at", "odd", "percent", "value").mapInArrow(run, _ROW)


def scan_objects(spark: SparkSession, paths: str | list[str], columns: Sequence[str] = ("file", "owner", "cls", "cols", "line")) -> DataFrame:
    """(file, owner, cls, cols, line), or those of them that are asked for: each row with the nearest `%class` header above it; a line break within a literal belongs to its row.

    Lines end at \\n; a row below no header is none. The text is read once for its quotes and once for its rows, and once more only if
    a row goes over the end of a split; its pieces, at most one row's a split, meet by where it began. A literal that is
    open for more than OPEN_BYTES is broken off at a split's start, so that a lost quote costs the rows up to there, which decoding refuses.
    """
    file, at = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    odd = F.contains("value", F.lit("'")) & ((F.length("value") - F.length(F.replace("value", F.lit("'")))) % 2 == 1)
    lines = spark.read.option("lineSep", "\n").text(paths).select(F.xxhash64(file).alias("fid"), at.alias("at"), odd.alias("odd"), F.startswith("value", F.lit("%")).alias("percent"), "value", file.alias("file"))
    folded = stored(_folded(_survey(lines)))
    groups, out = folded.count() // SENT_SPLITS + 1, None
    for g in range(groups):
        own = F.pmod("fid", F.lit(groups)) == g
        rows = folded.where(own).toArrow()
        cut = _cut(lines.where(own), spark.sparkContext.broadcast(_Known(rows)), {*columns, "cls"})
        found = cut.where("open IS NULL")
        if pc.any(pc.equal(rows["state"], 1)).as_py():
            pieces = F.array_sort(F.collect_list(F.struct("at", "line")))
            whole = cut.where("open IS NOT NULL").groupBy("file", "open").agg(pieces.alias("p"), *[F.min_by(c, "at").alias(c) for c in ("owner", "cls", "cols")])
            found = found.select("file", "owner", "cls", "cols", "line").union(whole.select("file", "owner", "cls", "cols", F.array_join(F.transform("p", lambda x: x["line"]), "\n").alias("line")))
        found = found.where("cls IS NOT NULL").select(*columns)
        out = found if out is None else out.union(found)
    return out


#: What may stand before a quoted literal, national text, hex digits, bits and names of types, longer ones first.
PREFIXES = ("N", "X", "B", "DATETIMELTZ", "DATETIMETZ", "DATETIME", "DATE", "TIMESTAMPLTZ", "TIMESTAMPTZ", "TIMESTAMP", "TIME")
#: A quoted literal with doubled quotes. Loops are possessive, which are matched without recursion.
_QUOTED = rf"(?:{'|'.join(PREFIXES)})?+'[^']*+(?:''[^']*+)*+'"
_TOKEN = re.compile(rf"{_QUOTED}|[^\s'{{}}]++|['{{}}]")
_MEMBER = re.compile(rf"{_QUOTED}|[^\s'{{}},]++|['{{}},]")


#: A row of bare tokens, one space between two.
_BARE = r"^[!-&(-z|~]+( [!-&(-z|~]+)*$"
#: Bytes of lines whose literals a task holds at once.
DECODED_BYTES = 1 << 20


def _slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about DECODED_BYTES of lines; a line is never cut."""
    part = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy().astype(np.int64)) // DECODED_BYTES
    cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
    for a, b in zip([0, *cuts], [*cuts, len(part)], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def literals(line: str) -> list[str] | None:
    """A row's literals as written: quoted, a collection in braces, or a bare token; None if a quote or brace is open."""
    tokens = _TOKEN.findall(line)
    if "'" in tokens:
        return None
    if "{" not in tokens and "}" not in tokens:
        return tokens
    out, depth, start = [], 0, 0
    for m in _TOKEN.finditer(line):
        depth += (m[0] == "{") - (m[0] == "}")
        if depth < 0:
            return None
        if m[0] == "{" and depth == 1:
            start = m.start()
        elif depth == 0:
            out.append(line[start : m.end()] if m[0] == "}" else m[0])
    return out if depth == 0 else None


def text_of(literal: str) -> str | None:
    """A literal's text; bare NULL is null, quoted 'NULL' is not; of bits, their hex digits."""
    if literal[-1] != "'":
        return None if literal == "NULL" else literal
    kind, _, inner = literal[:-1].partition("'")
    inner = inner.replace("''", "'")
    if kind.upper() == "B" and not inner.strip("01"):
        bits = inner + "0" * (-len(inner) % 8)
        return f"{int(bits, 2):0{len(bits) // 4}X}" if bits else ""
    return inner


def members(literal: str, depth: int) -> list | None:
    """A collection's members as texts, nested as its type is; ValueError if it is written otherwise."""
    if literal == "NULL":
        return None
    tokens, root = _MEMBER.findall(literal), []
    stack, expect = [root], "value"
    for t in tokens:
        if t == "{" and expect != "comma":
            if len(stack) > depth:
                raise ValueError
            stack[-1].append(inner := [])
            stack.append(inner)
            expect = "first"
        elif t == "}" and expect != "value" and len(stack) > 1:
            stack.pop()
            expect = "comma"
        elif t == "," and expect == "comma" and len(stack) > 1:
            expect = "value"
        elif t not in ("'", "{", "}", ",") and expect != "comma" and (len(stack) == depth + 1 or t == "NULL" and len(stack) > 1):
            stack[-1].append(text_of(t))
            expect = "comma"
        else:
            raise ValueError
    if len(stack) != 1 or len(root) != 1:
        raise ValueError
    return root[0]


def _nesting(kind: str) -> tuple[list[str], str]:
    """The collections of a type from the outside in, and the type of their members."""
    outer = []
    while (m := re.fullmatch(r"\s*(set|multiset|sequence|array)<(.*)>\s*", kind, re.DOTALL)) is not None:
        outer.append(m[1])
        kind = m[2]
    return outer, kind.strip()


def _cast(text: Column, kind: str) -> tuple[Column, Column]:
    """(value, whether a text that isn't null has none): a number with digits beyond its type's scale has none either."""
    if kind == "string":
        return text, F.lit(False)
    value = F.try_to_binary(text, F.lit("hex")) if kind == "bit" else text.try_cast(kind)
    bad = text.isNotNull() & value.isNull()
    if m := re.fullmatch(r"decimal\(\d+,\s*(\d+)\)", kind):
        bad |= F.length(F.rtrim(F.regexp_extract(text, r"^[^.eE]*\.(\d*)$", 1), F.lit("0"))) > int(m[1])
    return value, bad


def _collection(items: Column, outer: list[str], kind: str) -> tuple[Column, Column]:
    """(value, whether any member is not of its type) of nested arrays of texts."""
    if not outer:
        return _cast(items, kind)
    each = lambda i: F.transform(items, lambda x: _collection(x, outer[1:], kind)[i])
    value = {"set": lambda x: F.array_sort(F.array_distinct(x)), "multiset": F.array_sort}.get(outer[0], lambda x: x)(each(0))
    return value, F.coalesce(F.exists(each(1), lambda x: x), F.lit(False))


def decode(rows: DataFrame, types: Mapping[str, str], line_col: str = "line") -> DataFrame:
    """(source, row, reason): each row's own columns, its values by declared types in column order, and why it is refused, or null.

    Types are Spark's, `set<t>`, `multiset<t>`, `sequence<t>` for collections, nested as often as wanted, and `bit` for X'..' and B'..'.
    Refused are a wrong number of literals, an open quote or brace, and a value that isn't of its type: a member of a
    collection too, and digits beyond a decimal's scale. Each line is parsed once.
    """
    kinds = [(_nesting(k), n) for n, k in types.items()]
    names, at = rows.columns, rows.columns.index(line_col)
    arrow = lambda n: pa.string() if n == 0 else pa.list_(arrow(n - 1))
    declared = lambda n: "string" if n == 0 else f"array<{declared(n - 1)}>"
    fields = [arrow(len(outer)) for (outer, _), _ in kinds]
    schema = ", ".join([*(f"c{i} {t}" for i, (_, t) in enumerate(rows.dtypes)), "why string", *(f"p{i} {declared(len(outer))}" for i, ((outer, _), _) in enumerate(kinds))])
    plain = all(not outer and kind != "bit" for (outer, kind), _ in kinds)

    def values(line: str) -> tuple[str | None, list]:
        found = literals(line)
        if found is None:
            return "an open quote or bracket", [None] * len(kinds)
        if len(found) != len(kinds):
            return f"{len(found)} values for {len(kinds)} columns", [None] * len(kinds)
        if plain:
            return None, [text_of(x) for x in found]
        out, why = [], []
        for x, ((outer, kind), name) in zip(found, kinds, strict=True):
            try:
                if kind == "bit" and not outer and x != "NULL" and x[:2].upper() not in ("X'", "B'"):
                    raise ValueError
                out.append(members(x, len(outer)) if outer else text_of(x))
            except ValueError:
                out.append(None)
                why.append(f"{name}: not a {types[name]}")
        return "; ".join(why) or None, out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = [*(f"c{i}" for i in range(len(names))), "why", *(f"p{i}" for i in range(len(kinds)))]
        made = lambda batch, why, cells: pa.RecordBatch.from_arrays([*batch.columns, why, *cells], names=labels)
        for batch in batches:
            if plain and kinds:  # rows of bare tokens alone are split in Arrow
                bare = pc.fill_null(pc.match_substring_regex(batch.column(at), _BARE), False)
                bare = pc.and_(bare, pc.fill_null(pc.equal(pc.count_substring(batch.column(at), " "), len(kinds) - 1), False))
                if n := bare.true_count:
                    rest, batch = batch.filter(pc.invert(bare)), batch.filter(bare)
                    found = pc.split_pattern(batch.column(at), " ").flatten()
                    cells = [found.take(pa.array(np.arange(i, n * len(kinds), len(kinds)))) for i in range(len(kinds))]
                    yield made(batch, pa.nulls(n, pa.string()), [pc.if_else(pc.equal(c, "NULL"), pa.scalar(None, pa.string()), c) for c in cells])
                    batch = rest
            for part in _slices(batch, at):
                why, cells = zip(*(values(line or "") for line in part.column(at).to_pylist()), strict=True)
                yield made(part, pa.array(why, pa.string()), [pa.array(c, f) for c, f in zip(zip(*cells, strict=True), fields, strict=True)])

    parsed = rows.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, schema)
    row, reasons = [], [F.col("why")]
    for i, ((outer, kind), name) in enumerate(kinds):
        value, bad = _collection(F.col(f"p{i}"), outer, kind)
        row.append(value.alias(name))
        reasons.append(F.when(bad, f"{name}: not a {types[name]}"))
    reason = F.nullif(F.concat_ws("; ", *reasons), F.lit(""))
    return parsed.select(F.struct(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)]).alias("source"), F.struct(*row).alias("row"), reason.alias("reason"))


def decode_rows(rows: DataFrame, types: Mapping[str, str], line_col: str = "line") -> tuple[DataFrame, DataFrame]:
    """(good, rejects) of decode: the values, and the refused rows' own columns with their reason."""
    decoded = decode(rows, types, line_col)
    return decoded.where("reason IS NULL").select("row.*"), decoded.where("reason IS NOT NULL").select("source.*", "reason")
