"""Texts of a megabyte of one repeated part: they come out right, in bounded time and size, and the session lives on."""

import time

import duckdb
import pytest
from pyspark.sql import functions as F

from loadproof.llm import html, jaccard, licenses, minhash, pii, secrets

LONG = {
    "names": ("Mr. " + "John " * 200_000 + "went", "name"),
    "distinct names": ("Mrs. " + " ".join(f"Q{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}" for i in range(150_000)), "name"),
    "initials": ("Mr. " + "A." * 400_000 + " Smith went", "name"),
    "particles": ("Mr. " + "van " * 250_000 + "Smith went", "name"),
    "joined parts": ("Mr. Smith" + "-ab" * 350_000 + " went", "name"),
    "apostrophes": ("Mr. O" + "'ab" * 350_000 + " went", "name"),
    "titles": ("Mr. " + "Dr. " * 250_000 + "Smith went", "name"),
    "caseless": ("Dr. " + "王 " * 300_000, "name"),
    "digits": ("1 " * 500_000, None),
    "phone": ("+49 " + "12 " * 350_000, None),
    "addresses": ("a" * 1_000_000 + "@x.org", None),
    "dots": ("a@" + "b." * 500_000 + "org", None),
    "capitals": ("JOHN MARY " * 100_000, None),
}


def test_pii_of_megabytes(spark):
    parts = sorted(LONG)
    docs = spark.createDataFrame([(k, LONG[part][0]) for k, part in enumerate(parts)] + [(99, "write to me@x.org")], "doc_id long, text string").repartition(4)
    began = time.time()
    rows = {r.doc_id: r for r in pii.replace_pii(docs, "k").collect()}
    assert time.time() - began < 240
    assert rows[99].pii_email == 1 and "me@x.org" not in rows[99].text
    for k, part in enumerate(parts):
        text, kind = LONG[part]
        if kind:
            assert rows[k][f"pii_{kind}"] >= 1 and rows[k].text != text, part
        if part == "names":
            assert "John" not in rows[k].text and rows[k].text.endswith(" went")
        if part in ("initials", "particles", "joined parts", "titles"):
            assert "Smith" not in rows[k].text and rows[k].text.endswith(" went"), part


def test_names_end_where_they_did(spark):
    """Possessive loops give back nothing, so each word's end is looked for within the loop."""
    texts = {"Mr. John A.B.Smith x": "Mr. John A", "Dr. Jean-Luc d'Artagnan's hat": "Dr. Jean-Luc d'Artagnan", "Mr. de la Cruz de la casa": "Mr. de la Cruz", "Mrs. A.-B. Müller-Lüdenscheidt, x": "Mrs. A.-B. Müller-Lüdenscheidt", "Prof. Dr. van der Berg y": "Prof. Dr. van der Berg", "Mr. Smith's": "Mr. Smith", "Dr. 王 小明 x": "Dr. 王 小明"}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.regexp_extract("t", pii.PATTERN, 0).alias("m")).collect()
    assert {r.t: r.m for r in got} == texts


def test_key_is_asked_for_beyond_a_local_master(spark):
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        def __init__(self, **conf):
            self.conf = Conf(conf)

    assert pii._key(Session(**{"spark.master": "local[4]"})) == pii.TEST_KEY
    assert pii._key(Session(**{"spark.master": "yarn", pii.KEY_CONF: "x"})) == "x"
    with pytest.raises(ValueError, match=pii.KEY_CONF):
        pii._key(Session(**{"spark.master": "yarn"}))


PAGES = {
    "wide cell": "<table>" + "<tr><td>" + "w" * 30_000 + "<td>b</tr>" + "<tr><td>a<td>b</tr>" * 5000 + "</table>",
    "wide span": "<table>" + "<tr><td colspan=900>" + "w" * 30_000 + "<td>b</tr>" + "<tr><td>a<td>b</tr>" * 5000 + "</table>",
    "many spans": "<table>" + "<tr>" + "<td>a" * 3000 + "<tr>" + "<td colspan=2>" + "<td colspan=3>abcdefgh" * 3000 + "</table>",
    "stairs": "<table><tr>" + "<td rowspan=9000>x" * 6000 + "</tr>" + "<tr><td>y</tr>" * 8000 + "</table>",
    "lists": "<ul><li>x" * 40_000,
    "quotes": "<blockquote>x<br>" * 40_000,
    "pre": "<blockquote>" * 1000 + "<pre>" + "y\n" * 100_000,
    "styles": "<style " * 150_000,
    "open styles": "<style>a{" * 100_000,
    "tags": "<a '" * 200_000,
    "paragraphs": "<p>z" * 200_000,
}


@pytest.mark.parametrize("page", sorted(PAGES))
def test_pages_come_out_bounded(page):
    text = PAGES[page]
    began = time.time()
    out = html.render(text)
    assert time.time() - began < 30
    assert len(out) <= 50 * len(text)
    for letter in "wabxyz":  # all that is visible
        if page not in ("styles", "open styles", "tags"):
            visible = "".join(part.split(">", 1)[-1] for part in text.split("<"))
            assert out.count(letter) == visible.count(letter)


def test_cells_after_a_wide_one():
    wide = "w" * 200
    page = f"<table><tr><td>{wide}<td>b<tr><td>a<td>c</table>"
    assert html.render(page) == f"{wide}  b\na{' ' * (html.WIDE + 1)}c"
    assert html.render("<style\n>.x{display:none}</STYLE ><p class=x>no</p><style>p.y{visibility:hidden}") == ""
    assert html.render("<p class=x>yes</p><style .x{display:none}") == "yes"


def test_licenses_and_secrets_in_long_texts(spark):
    gpl = open("/usr/share/common-licenses/GPL-3").read()
    key = "AKIA" + "ABCD1234" * 2
    long = "x y\n" * 300_000 + "Released under the MIT License.\n" + key
    docs = spark.createDataFrame([(1, long, "a", "b"), (2, gpl, "a", "b"), (3, None, "a", "b"), (4, "", "a", "b"), (None, "Released under the MIT License.", "a", "b")], "doc_id long, text string, license string, digest string")
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(docs).collect()}
    assert got == {1: "MIT", 2: "GPL-3.0", 3: "", 4: "", None: "MIT"}
    assert licenses.scan_licenses(docs.where("false")).count() == 0
    masked = {r.doc_id: r.text for r in secrets.mask_secrets(docs).collect()}
    assert key not in masked[1] and masked[1].startswith(long[:1_000_000]) and masked[2] == gpl and masked[4] == "" and masked[3] is None
    assert secrets.mask_secrets(docs.where("false")).count() == 0


def test_full_texts_by_sql(tmp_path):
    """The query's SQL knows the full texts too."""
    texts = [open(f"/usr/share/common-licenses/{f}").read() for f in ("GPL-3", "Apache-2.0", "BSD")]
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    got = {r[0]: r[1] for r in db.sql(f"SELECT doc_id, whole_license FROM ({licenses.OP1_SQL})").fetchall()}
    assert got == {0: "GPL-3.0", 1: "Apache-2.0", 2: "BSD-3-Clause"}


def test_joins_of_long_texts_and_none(spark):
    base = [f"w{i}" for i in range(120_000)]
    texts = [" ".join(base), " ".join([*base[:-9_000], *(f"v{i}" for i in range(9_000))]), " ".join(reversed(base)), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == got
    assert jaccard.near_duplicates(docs.where("false")).count() == 0
