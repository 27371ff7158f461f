"""Each stage of the pipeline against a plain version, on its own input, with awkward rows among it."""

import hashlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tests.llm.test_operators import AWKWARD, brute_classes, brute_hits, brute_secrets

from loadproof.llm import bpe, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """The smallest tables, with nulls, repeated rows and ids, long texts, and columns named as the operators' own."""
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = [r.asDict() for r in docs.orderBy("doc_id").limit(90).collect()]
    extra = [{"doc_id": 10_000 + i, "text": t, "lang": None, "source": "x", "n_chars": len(t or "")} for i, t in enumerate(AWKWARD)]
    again = [{**some[3]}, {**some[4], "text": "one more text of that id"}, {**some[5], "doc_id": None}, {**some[6], "doc_id": 20_000}, {**some[7], "doc_id": None}]
    rows = spark.createDataFrame(some + extra + again, docs.schema)
    for name in ("key", "id", "row", "slot", "goes", "score", "_copy"):
        rows = rows.withColumn(name, F.lit(name))
    rows.repartition(3).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return folder


def as_rows(df):
    return sorted((tuple(sorted(r.asDict().items())) for r in df.collect()), key=str)


def test_stages_equal_plain_versions(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("labels", "benchmark"))
    outs, given = [docs], docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, given, sf_dir)
        out.write.parquet(str(tmp_path / str(k)))
        given = spark.read.parquet(str(tmp_path / str(k)))
        assert k == len(corpus_pipeline.STAGES) - 1 or given.columns == docs.columns
        outs.append(given)
    table = [[r.asDict() for r in o.collect()] for o in outs]
    plain = lambda rows: sorted((tuple(sorted(r.items())) for r in rows), key=str)

    model = toxicity.fit(docs, labels)
    assert plain(r for r in table[0] if model.scores([r["text"]], {})[0] < 0.5) == plain(table[1])

    with_id = [r for r in table[1] if r["doc_id"] is not None]
    classes = brute_classes(list(range(len(with_id))), [r["text"] for r in with_id])
    least = {}
    for i, r in enumerate(with_id):
        least[classes[i][1]] = min(r["doc_id"], least.get(classes[i][1], r["doc_id"]))
    kept = {}
    for i, r in enumerate(with_id):
        if least[classes[i][1]] == r["doc_id"] or classes[i][0] == 0:
            kept.setdefault((r["doc_id"], r["text"]), r)
    assert plain([*kept.values(), *(r for r in table[1] if r["doc_id"] is None)]) == plain(table[2])

    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    assert plain(r for r in table[2] if not brute_hits(r["text"], items)[2]) == plain(table[3])

    def masked(r):
        text = r["text"]
        for a, b in reversed(merged([(s[0], s[2]) for s in brute_secrets(text or "")[1]])):
            text = text[:a] + "[SECRET]" + text[b:]
        return {**r, "text": text, "n_chars": None if text is None else len(text)}

    assert plain(map(masked, table[3])) == plain(table[4])

    from tokenizers import Tokenizer

    own = Tokenizer.from_file(bpe.default_path())
    want = []
    for r in table[4]:
        ids = own.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((str(r["doc_id"]), len(ids), hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["decoded_sha256"]) for r in table[5]) == sorted(want)
    assert 0 < len(table[5]) < len(table[0])


def merged(spans):
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def test_empty_tables_give_empty_results(spark, sf_dir, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
