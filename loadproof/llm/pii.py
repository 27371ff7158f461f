"""PII by surrogate generation, in built-in expressions only.

Entities (e-mail addresses, IP addresses, cards, phone numbers, social security numbers, IBANs,
names after a title) are found by one pattern; where a document gives names with a title, their words
are then found in that document without one too. Each is brought to a canonical form, so that forms
of one entity share it, and gets the surrogate that a keyed digest of the form spells in the
entity's own format: digits stay digits, case stays, separators stay; addresses stay valid; cards
that pass the check digit still do; names keep title and gender, and Latin, Cyrillic or Greek script
(names in other scripts get Latin surrogates). A name is up to WORDS capitalised words and initials
with the particles between them, or up to four words of a script without case. The same entity gets
the same surrogate everywhere. Initials are letters moved by a keyed distance, for which distinctness
within their alphabet holds without a check; particles stay. A name has at most WORDS words, each of any length.

A person is one within a document: a given name after a title without gender, or without title, is
that of the mention with one, and a word alone is the family name if it is one in any mention. Words of
names are looked for without title as they are written, unless the document also holds the word in
lower case.

A check over all distinct entities finds surrogates that two entities
share or that are real entities themselves; those get the digest of a further attempt until none
is left, so distinct entities stay distinct; surrogates of names and e-mail addresses grow longer with
each attempt, and all others do from the ninth on, giving up their format, so that free ones don't run
out and the check ends.

Defined results: a null text stays null; an empty text or one without entities is unchanged; texts of
any length are taken whole; repeated rows, and rows that repeat an id, give each its own result, with one
surrogate for one entity; an empty table gives no rows; extra columns are ignored by the query and kept by
replace_pii, but for columns named as the counts are, which an error names.
"""

from __future__ import annotations

import hashlib
import sys
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadproof.llm.common import stored, table

#: Where the query takes its key from, and what it takes for tests where none is set.
KEY_CONF, TEST_KEY = "spark.loadproof.pii.key", "of tests alone"
#: Attempts that keep the format; attempts after which the check gives up (a surrogate that never changes).
KEEPS_FORMAT, MOST_ATTEMPTS = 8, 200
#: Slots of the filter that spares rows the join with further attempts; they are sent to all.
SLOTS = 1 << 20
#: Titles by gender, then the patterns of the kinds in the order tried.
MALE = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mademoiselle", "Señora", "Sra", "Doña", "Госпожа", "Κυρία")
NEUTRAL = ("Dr", "Prof")
_TITLE = "|".join((*MALE, *FEMALE, *NEUTRAL))
#: What stands inside names and stays as it is: particles, titles after the first, generations.
_PARTICLE = "van|von|vom|zu|zum|zur|der|den|dem|de|del|della|di|da|das|dos|do|du|des|la|las|le|les|los|lo|af|av|ten|ter|te|bin|bint|ibn|ben|bat|al|el|y|ur"
_STAYS = rf"(?:{_PARTICLE}|(?:{'|'.join(NEUTRAL)})\.?|Jr|Sr|II|III|IV)"
#: All loops over groups are possessive: the JVM matches others by recursion, which ends it on long texts.
_INITIALS = r"\p{Lu}\.(?:-?\p{Lu}\.)*+"
#: An apostrophe or hyphen joins what follows, but for the s of a genitive.
_JOINED = r"(?:['’](?!s(?![\p{L}]))[\p{L}\p{M}]++|-[\p{L}\p{M}]++)*+"
#: Titles that are no given names end a name; another may follow them.
_NO_TITLE = rf"(?!(?:{'|'.join(t for t in (*MALE, *FEMALE, *NEUTRAL) if t not in ('Don', 'Sir', 'Miss', 'Sr'))})(?![\p{{L}}]))"
_CASED = rf"(?:{_INITIALS}|{_NO_TITLE}(?:\p{{Ll}}{{1,2}}['’])?[\p{{Lu}}\p{{Lt}}][\p{{L}}\p{{M}}]*+{_JOINED})(?![\p{{L}}\p{{M}}])"
_PARTICLES = rf"(?:(?:{_PARTICLE}) )*+"
_CASELESS = r"\p{Lo}[\p{L}\p{M}]*+"
#: Words of one name; the further words of a longer run are no part of it.
WORDS = 40
_NAME = rf"(?:{_PARTICLES}{_CASED}(?: {_PARTICLES}{_CASED}){{0,{WORDS - 1}}}+|{_CASELESS}(?: {_CASELESS}){{0,3}}+)"
_PHONE = (
    r"\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}",
    r"(?:\+|00)[1-9](?:[ ./()-]{0,2}[0-9]){6,14}",
    r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}",
    r"0[0-9](?:[ .-][0-9]{2}){4}",
    r"(?:\(0[0-9]{1,5}\) ?|0[0-9]{1,5}[ /-])[0-9]{5,8}",
    r"(?:\(0[0-9]{2,5}\) ?|0[0-9]{2,5}[ /-])[0-9]{2,4}(?:[ -][0-9]{2,4}){1,3}",
    r"0[1-9][0-9]{7,10}",
    r"1?[2-9][0-9]{2}[2-9][0-9]{6}",
)
KINDS = (
    ("email", r"(?<![A-Za-z0-9._%+-])(?=[._%+-]*[A-Za-z0-9])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"),
    ("ip", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![0-9]|\.[0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("card", r"(?<![0-9A-Za-z-])(?:(?:[0-9]{4}[ -]?){3}[0-9]{1,7}|[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{4,5})(?![0-9A-Za-z-])"),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    ("phone", rf"(?<![0-9A-Za-z+])(?:{'|'.join(rf'{p}(?![0-9A-Za-z])' for p in _PHONE)})"),
    ("name", rf"(?<![\p{{L}}])(?:{_TITLE})\.? (?:(?:{'|'.join(NEUTRAL)})\.? )*+{_NAME}(?![\p{{L}}\p{{M}}])"),
)
PATTERN = "|".join(p for _, p in KINDS)
_IS_NAME = rf"^(?:{_TITLE})\.? "
_PROBE = rf"[0-9@]|(?:{_TITLE})\.? \p{{L}}"
#: Syllables and endings of surrogate names by script.
_SYLLABLES = {
    "latin": ("ba", "do", "fe", "ga", "jo", "ka", "le", "mi", "no", "pe", "ra", "si", "ta", "ve", "wi", "zo"),
    "cyrillic": ("ба", "во", "ге", "да", "жи", "за", "ко", "ле", "ми", "но", "пе", "ра", "си", "та", "фе", "хо"),
    "greek": ("βα", "γο", "δε", "ζα", "θι", "κα", "λο", "με", "νι", "ξο", "πε", "ρα", "σι", "τα", "φε", "χο"),
}
_ENDINGS = {"latin": ("n", "lia", "rt"), "cyrillic": ("н", "на", "в"), "greek": ("ς", "ρια", "κης")}


def _alphabets() -> list[str]:
    """Capital letters by alphabet; plain Latin ones apart from those with marks."""
    out: dict[str, str] = {}
    for c in map(chr, range(sys.maxunicode + 1)):
        if unicodedata.category(c) == "Lu":
            kind = "ascii" if c.isascii() else unicodedata.name(c, "OTHER").split()[0]
            out[kind] = out.get(kind, "") + c
    return list(out.values())


_ALPHABETS = _alphabets()


def _initials(text: Column, key: str) -> Column:
    """Each letter moved within its alphabet by a distance that the key gives, never by none."""
    number = int(hashlib.sha256(f"{key}\u0001initial".encode()).hexdigest(), 16)
    moved = [a[k:] + a[:k] for a in _ALPHABETS for k in [1 + number % max(len(a) - 1, 1)]]
    return F.translate(text, "".join(_ALPHABETS), "".join(moved))


def _digest(key: str, unit: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", F.lit(key), unit["kind"], unit["form"], attempt.cast("string")), 256)


def kind_of(entity: Column) -> Column:
    return reduce(lambda out, k: out.when(entity.rlike(f"^(?:{k[1]})$"), k[0]), KINDS[1:], F.when(entity.rlike(f"^(?:{KINDS[0][1]})$"), KINDS[0][0]))


def _gender(entity: Column) -> Column:
    is_ = lambda titles: entity.rlike(rf"^(?:{'|'.join(titles)})\.? ")
    return F.when(is_(MALE), "m").when(is_(FEMALE), "f").otherwise("n")


def name_units(entity: Column) -> Column:
    """A titled name's words as (kind, form, shown); kinds: first_<gender>, last, only_<gender> of a single one, initial, stays."""
    plain = lambda w: F.when(w.rlike(rf"^{_STAYS}$"), "stays").when(w.rlike(rf"^{_INITIALS}$"), "initial")
    words = F.transform(F.split(F.regexp_extract(entity, "^[^ ]+ (.*)$", 1), " "), lambda w: F.struct(w.alias("w"), plain(w).alias("plain")))
    gender = _gender(entity)
    places = F.array_compact(F.transform(words, lambda x, i: F.when(x["plain"].isNull(), i)))
    # bound once, as what a lambda uses is evaluated for each of its elements
    whole = F.array(F.struct(words.alias("words"), F.array_max(places).alias("top"), F.when(F.size(places) > 1, F.lit("last")).otherwise(F.concat(F.lit("only_"), gender)).alias("last"), F.concat(F.lit("first_"), gender).alias("first")))
    kind = lambda s, x, i: F.coalesce(x["plain"], F.when(i == s["top"], s["last"]).otherwise(s["first"]))
    each = lambda s: F.transform(s["words"], lambda x, i: F.struct(kind(s, x, i).alias("kind"), F.lower(x["w"]).alias("form"), x["w"].alias("shown")))
    return F.transform(whole, each)[0]


def _resolved(unit: Column) -> Column:
    """The unit with the kind that the document's names (_known) give it: one person, one kind."""
    kinds = F.transform(F.filter("_known", lambda k: k["form"] == unit["form"]), lambda k: k["kind"])
    one = lambda *wanted: F.get(F.filter(kinds, lambda k: k.isin(*wanted)), F.lit(0))
    first = F.coalesce(one("first_m", "first_f"), one("first_n"))
    own, is_last = unit["kind"], F.array_contains(kinds, "last")
    kind = (
        F.when(own == "first_n", F.coalesce(one("first_m", "first_f"), own))
        .when(own.isin("alone", "only_n"), F.when(is_last, "last").otherwise(F.coalesce(first, F.lit("last"))))
        .when(own == "only_m", F.when(is_last, "last").otherwise(F.coalesce(one("first_m"), one("first_n"), F.lit("last"))))
        .when(own == "only_f", F.when(is_last, "last").otherwise(F.coalesce(one("first_f"), one("first_n"), F.lit("last"))))
        .otherwise(own)
    )
    # a given name that another mention's title gives a gender has that gender here too
    kind = F.when(kind == "first_n", F.coalesce(one("first_m", "first_f"), kind)).otherwise(kind)
    return F.struct(kind.alias("kind"), unit["form"].alias("form"), unit["shown"].alias("shown"))


def units(entity: Column, kind: Column) -> Column:
    """What of an entity is replaced as one: (kind, form, shown). Names give one unit for each word."""
    digits = F.regexp_replace(entity, "[^0-9]", "")
    form = F.when(kind == "phone", F.right(digits, F.lit(10))).when(kind.isin("card", "ssn"), digits).when(kind == "iban", F.regexp_replace(entity, " ", "")).otherwise(F.lower(entity))
    one = F.struct(kind.alias("kind"), form.alias("form"), entity.alias("shown"))
    return F.when(kind == "name", F.transform(name_units(entity), _resolved)).when(kind == "alone", F.array(_resolved(one))).otherwise(F.array(one))


def _stream(digest: Column, to: str) -> Column:
    return F.translate(digest, "0123456789abcdef", to)


def _spelled(text: Column, digest: Column, keep: Column) -> Column:
    """Each digit and ASCII letter after the first keep of them replaced, counted from the end, so that a prefix moves nothing."""
    chars = F.filter(F.split(F.reverse(text), ""), lambda c: c != "")
    digits, letters = _stream(digest, "0123456789012345"), _stream(digest, "abcdefghijklmnop")
    state = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))
    total = F.length(F.regexp_replace(text, "[^0-9A-Za-z]", ""))

    def step(s: Column, c: Column) -> Column:
        at = F.pmod(s["n"], F.lit(64)) + 1
        used = c.rlike("[0-9A-Za-z]")
        free = s["n"] < total - keep
        new = F.when(~used | ~free, c).when(c.rlike("[0-9]"), F.substr(digits, at, F.lit(1))).when(c.rlike("[a-z]"), F.substr(letters, at, F.lit(1))).otherwise(F.upper(F.substr(letters, at, F.lit(1))))
        return F.struct((s["n"] + used.cast("int")).alias("n"), F.concat(s["out"], F.array(new)).alias("out"))

    return F.reverse(F.array_join(F.aggregate(chars, state, step)["out"], ""))


def _luhn(digits: Column) -> Column:
    """The check sum modulo ten; 0 for a valid number."""
    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.pmod(c.cast("int") * 2, F.lit(10)) + (c.cast("int") >= 5).cast("int")))
    return F.pmod(F.aggregate(values, F.lit(0), lambda a, x: a + x), F.lit(10))


def _card(text: Column, digest: Column) -> Column:
    """First digit kept; a valid check digit stays valid."""
    new = _spelled(text, digest, F.lit(1))
    fixed = F.concat(F.substr(new, F.lit(1), F.length(new) - 1), F.pmod(F.right(new, F.lit(1)).cast("int") - _luhn(F.regexp_replace(new, "[^0-9]", "")) + 10, F.lit(10)).cast("string"))
    return F.when(_luhn(F.regexp_replace(text, "[^0-9]", "")) == 0, fixed).otherwise(new)


def _ip(digest: Column) -> Column:
    part = lambda k: (F.pmod(F.conv(F.substr(digest, F.lit(1 + 4 * k), F.lit(4)), 16, 10).cast("long"), F.lit(254)) + 1).cast("string")
    return F.concat_ws(".", *[part(k) for k in range(4)])


def _name(unit: Column, digest: Column, attempt: Column) -> Column:
    """Four syllables and one more for each further attempt, as far as the digest reaches."""
    places = F.sequence(F.lit(1), F.least(attempt + 4, F.lit(64)).cast("int"))

    def made(script: str) -> Column:
        table_ = F.array(*[F.lit(x) for x in _SYLLABLES[script]])
        part = lambda k: F.element_at(table_, F.conv(F.substr(digest, k, F.lit(1)), 16, 10).cast("int") + 1)
        m, f, n = _ENDINGS[script]
        end = F.when(unit["kind"] == "first_m", m).when(unit["kind"] == "first_f", f).otherwise(n)
        return F.initcap(F.concat(F.array_join(F.transform(places, part), ""), end))

    return F.when(unit["form"].rlike(r"\p{IsCyrillic}"), made("cyrillic")).when(unit["form"].rlike(r"\p{IsGreek}"), made("greek")).otherwise(made("latin"))


def surrogate(unit: Column, attempt: Column, key: str, shown: Column | None = None) -> Column:
    """The unit's surrogate in the format of what is shown; by default of its canonical form."""
    text = unit["form"] if shown is None else shown
    digest, kind = _digest(key, unit, attempt), unit["kind"]
    top = F.regexp_extract(text, r"\.[A-Za-z]{2,24}$", 0)
    email = F.concat(F.right(_stream(digest, "abcdefghijklmnop"), attempt), _spelled(F.substr(text, F.lit(1), F.length(text) - F.length(top)), digest, F.lit(0)), top)
    phone = _spelled(text, digest, F.greatest(F.length(F.regexp_replace(text, "[^0-9]", "")) - 10, F.lit(0)))
    more = F.when(attempt >= KEEPS_FORMAT, F.concat(F.lit("-"), F.right(_stream(digest, "abcdefghijklmnop"), 2 * (attempt - KEEPS_FORMAT + 1)))).otherwise("")
    of = lambda k, x: (kind == k, F.concat(x, more))
    out = F.when(kind == "email", email).when(*of("ip", _ip(digest))).when(*of("card", _card(text, digest))).when(*of("phone", phone))
    return out.when(*of("ssn", _spelled(text, digest, F.lit(0)))).when(*of("iban", _spelled(text, digest, F.lit(2)))).when(kind == "stays", text).when(kind == "initial", _initials(text, key)).otherwise(_name(unit, digest, attempt))


def _pattern() -> Column:
    """The pattern of a row's text: PATTERN, and the words in _names without a title."""
    named = F.concat(F.lit(rf"{PATTERN}|(?<![\p{{L}}\p{{M}}\p{{N}}])(?:"), F.col("_names"), F.lit(r")(?![\p{L}\p{M}\p{N}])"))
    return F.coalesce(named, F.lit(PATTERN))


def with_entities(rows: DataFrame) -> DataFrame:
    """Adds to rows with _body: _found, each match of _pattern() with kind and units, and _names, what the pattern ends with in this text."""
    body, none = F.col("_body"), F.array().cast("array<string>")
    titled = F.regexp_extract_all(F.when(body.rlike(_PROBE), body), F.lit(PATTERN), F.lit(0))
    rows = rows.withColumn("_titled", F.coalesce(titled, none))
    named = F.array_distinct(F.filter("_titled", lambda e: e.rlike(_IS_NAME)))
    known = F.filter(F.array_distinct(F.flatten(F.transform(named, name_units))), lambda k: ~k["kind"].isin("stays", "initial"))
    rows = rows.withColumn("_known", known)
    # words of these names that the document never writes small; scripts without case have no small form
    forms = F.transform(F.filter("_known", lambda k: k["form"] != k["shown"]), lambda k: k["form"])
    proper = F.array_except(forms, F.split(body, r"[^\p{L}\p{M}]+"))
    words = F.array_distinct(F.transform(F.filter("_known", lambda k: (k["form"] == k["shown"]) | F.array_contains(F.col("_proper"), k["form"])), lambda k: k["shown"]))
    rows = rows.withColumn("_proper", F.when(F.size("_known") > 0, proper)).withColumn("_alone", F.when(F.size("_known") > 0, words).otherwise(none))
    longest = F.transform(F.sort_array(F.transform("_alone", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))), asc=False), lambda x: F.concat(F.lit("\\Q"), x["w"], F.lit("\\E")))
    rows = rows.withColumn("_names", F.when(F.size("_alone") > 0, F.array_join(longest, "|")))
    all_ = F.when(F.size("_alone") > 0, F.regexp_extract_all(body, _pattern(), F.lit(0))).otherwise(F.col("_titled"))
    kinds = F.transform(all_, lambda e: F.struct(e.alias("entity"), F.coalesce(kind_of(e), F.lit("alone")).alias("kind")))
    found = F.transform(kinds, lambda x: F.struct(x["entity"].alias("entity"), x["kind"].alias("kind"), units(x["entity"], x["kind"]).alias("units")))
    return rows.withColumn("_found", found).drop("_titled", "_known", "_proper", "_alone")


def attempts(distinct: DataFrame, key: str, name=surrogate) -> DataFrame:
    """(kind, form, attempt) of the units whose first surrogate is taken or real; distinct has (kind, form).

    Of units with one surrogate the least keeps it; the others try again against all that is taken.
    """
    group = F.regexp_replace("kind", "_[a-z]$", "")
    real = distinct.select(group.alias("g"), F.lower("form").alias("s")).distinct()
    pending, taken, settled = distinct, real, None
    for attempt in range(MOST_ATTEMPTS):
        tried = pending.withColumn("s", F.lower(name(F.struct("kind", "form"), F.lit(attempt), key))).withColumn("g", group)
        first = tried.groupBy("g", "s").agg(F.min(F.struct("kind", "form")).alias("owner"))
        free = first.join(taken, ["g", "s"], "left_anti")
        won = stored(free.select("g", "s", "owner.kind", "owner.form", F.lit(attempt).alias("attempt")))
        pending = stored(pending.join(won, ["kind", "form"], "left_anti"))
        again = won.select("kind", "form", "attempt")
        settled = again.where("attempt > 0") if settled is None else settled.union(again)
        if pending.isEmpty():
            return settled
        taken = taken.union(won.select("g", "s"))
    raise RuntimeError(f"no free surrogates after {MOST_ATTEMPTS} attempts")


def _with_attempts(rows: DataFrame, used: DataFrame, again: DataFrame) -> DataFrame:
    """Adds _more: the attempts of those of a row's units that again lists, null if there are none; used has (_told, kind, form).

    Only rows in whose slot such a unit occurs take part in a join by _told, a hash of id and text; all others stay where
    they are. Of rows with one hash each learns of the units of all, which changes nothing.
    """
    none = F.lit(None).cast("map<string,int>")
    if again.isEmpty():
        return rows.withColumn("_more", none)
    unit = F.struct(F.concat_ws("\u0001", "kind", "form"), F.col("attempt"))
    more = used.distinct().join(again, ["kind", "form"]).groupBy(F.col("_told").alias("_of")).agg(F.map_from_entries(F.collect_list(unit)).alias("_more"))
    more = stored(more)
    slots = F.broadcast(more.select(F.pmod("_of", F.lit(SLOTS)).alias("_slot")).distinct())
    in_slot = F.pmod("_told", F.lit(SLOTS)) == F.col("_slot")
    apart = rows.join(slots, in_slot, "left_anti").withColumn("_more", none)
    return apart.unionByName(rows.join(slots, in_slot, "left_semi").join(more, F.col("_told") == F.col("_of"), "left").drop("_of"))


def replace_pii(docs: DataFrame, key: str, text_col: str = "text", id_col: str = "doc_id", name=surrogate) -> DataFrame:
    """The rows with every entity replaced, and counts, an array of (kind, n) columns as pii_<kind>."""
    names = docs.columns
    if clash := sorted({f"pii_{k}" for k, _ in KINDS} & {c.lower() for c in names}):
        raise ValueError(f"columns named as counts: {', '.join(clash)}")
    body = F.col(f"`{text_col}`").cast("string")
    others = [F.col(f"`{c}`") for c in names if c != text_col]
    each = F.explode(F.flatten(F.transform("_found", lambda x: x["units"]))).alias("u")
    # entities are found once and kept beside the text
    rows = docs.select(F.struct(F.lit(1).alias("_loadproof"), *others).alias("_row"), body.alias("_body"))
    rows = stored(with_entities(rows.withColumn("_told", F.xxhash64(F.col(f"_row.`{id_col}`"), "_body"))))
    distinct = stored(rows.select(each).select("u.kind", "u.form").where("kind NOT IN ('stays', 'initial')").distinct())
    rows = _with_attempts(rows, rows.select("_told", each).select("_told", "u.kind", "u.form"), stored(attempts(distinct, key, name)))
    tried = lambda u: F.coalesce(F.try_element_at(F.col("_more"), F.concat_ws("\u0001", u["kind"], u["form"])), F.lit(0))
    as_units = lambda x: F.transform(x["units"], lambda u: name(u, tried(u), key, u["shown"]))
    fresh = F.transform("_found", lambda x: F.when(x["kind"] == "name", F.concat_ws(" ", F.substring_index(x["entity"], " ", 1), F.array_join(as_units(x), " "))).otherwise(F.array_join(as_units(x), "")))
    gaps = F.split(F.when(F.size("_found") > 0, F.col("_body")), _pattern(), -1)
    text = F.when(F.size("_found") > 0, F.array_join(F.flatten(F.transform(F.arrays_zip(gaps.alias("g"), fresh.alias("s")), lambda x: F.array(x["g"], F.coalesce(x["s"], F.lit(""))))), "")).otherwise(F.col("_body"))
    also = {"name": ("name", "alone")}
    count = lambda k: F.size(F.filter("_found", lambda x: x["kind"].isin(*also.get(k, (k,))))).cast("long").alias(f"pii_{k}")
    return rows.select(*[text.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in names], *[count(k) for k, _ in KINDS])


def _key(spark: SparkSession) -> str:
    """The key that the session sets; only under a local master is there one without it, which anybody can read here."""
    key = spark.conf.get(KEY_CONF, None)
    if not key and not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError(f"set {KEY_CONF}: without a secret key surrogates can be guessed")
    return key or TEST_KEY


def op7_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), _key(spark))
