"""Every stage of the pipeline against plain loops, on awkward rows whose column names clash with any an operator might use."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import secrets
from ledgerloom.sources.tables import table

from test_models import brute_components, brute_fingerprint
from test_native import SECRETS, brute_decontaminate, brute_spans

CLASHES = "__known __walk __lang_pred __score __spans __blob __digest __k1 __k2 __id row spans digest k1 k2 text_ blob fp known lang_pred score held_out label".split()


@pytest.fixture(scope="module")
def docs(spark, awkward):
    plain = awkward.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("int").alias("n_chars"))
    more = [(700 + i, t, None, "s", len(t)) for i, t in enumerate(SECRETS)] + [(800, "x " + PASSAGE + " y", "en", "s", 1), (801, None, None, None, None), (802, PASSAGE + " and more", "en", "s", 2)]
    rows = plain.unionByName(spark.createDataFrame(more, plain.schema))
    return rows.withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) for c in CLASHES}).repartition(3).cache()


PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"


@pytest.fixture(scope="module")
def stages():
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([("1", PASSAGE), ("2", "never here at all")], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def bag(rows, *but):
    return Counter(tuple(v for c, v in zip(r.__fields__, r, strict=True) if c not in but) for r in rows)


def test_language_stage(docs, stages, folder, spark):
    out = stages["language"](spark, docs, folder)
    assert out.schema.names == docs.schema.names
    want = [r for r in docs.collect() if any(c.isalpha() for c in r.text or "")]
    got = out.collect()
    assert bag(got, "lang") == bag(want, "lang")
    assert all(r.lang for r in got) and bag(r for r in got if r.doc_id in {x.doc_id for x in want if x.lang}) == bag(x for x in want if x.lang)


def test_near_duplicates_stage(docs, stages, folder, spark):
    out = stages["near_duplicates"](spark, docs, folder)
    assert out.schema.names == docs.schema.names
    rows = docs.collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    roots = brute_components(set(fps))
    digest = lambda r: hashlib.sha256(f"{'' if r.doc_id is None else r.doc_id}\0{r.text or ''}".encode()).digest()
    best = {}
    for r, f in zip(rows, fps, strict=True):
        key = (r.doc_id is not None, r.doc_id or 0, digest(r))
        if roots[f] not in best or key < best[roots[f]][0]:
            best[roots[f]] = (key, r)
    # The loser of two rows of one id and text is not told apart from the winner but by other columns, which agree here.
    assert bag(out.collect(), "source", "n_chars", "lang") == bag([r for _, r in best.values()], "source", "n_chars", "lang")


def test_decontamination_stage(docs, stages, folder, spark):
    out = stages["decontamination"](spark, docs, folder)
    assert out.schema.names == docs.schema.names
    items = [("1", PASSAGE), ("2", "never here at all")]
    want = [r for r in docs.collect() if not brute_decontaminate(r.text, items)[4]]
    assert bag(out.collect()) == bag(want) and len(want) == docs.count() - 2


def test_secrets_stage(docs, stages, folder, spark):
    out = stages["secrets"](spark, docs, folder)
    assert out.schema == docs.schema
    got, rows = out.collect(), docs.collect()
    assert bag(got, "text", "n_chars") == bag(rows, "text", "n_chars")
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    assert {r.spans_ for r in secrets.find_secrets(out.filter("text not like '%BEGIN%'")).withColumnRenamed("spans", "spans_").collect() if "hex" in r.spans_ or "access" in r.spans_} == set()
    clean = {r.doc_id for r in rows if r.text is None or not brute_spans(r.text)[4]}
    assert {(r.doc_id, r.text) for r in got if r.doc_id in clean} == {(r.doc_id, r.text) for r in rows if r.doc_id in clean}


def test_tokens_stage(docs, stages, folder, spark):
    got = stages["tokens"](spark, docs, folder).collect()
    assert Counter((r.doc_id, r.decoded_sha256) for r in got) == Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect())
    assert all(len(r.ids) == 4 * r.n_tokens and hashlib.sha256(r.ids).hexdigest() == r.ids_sha256 for r in got)


def test_empty_table(docs, stages, folder, spark):
    for name, stage in stages.items():
        out = stage(spark, docs.limit(0), folder)
        assert out.count() == 0 and (name == "tokens" or out.columns == docs.columns), name


def test_run(spark, data_dir):
    import corpus_pipeline

    docs = table(spark, data_dir, "documents")
    sizes, now = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, data_dir)
        assert now.columns == docs.columns, name
        sizes.append(now.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[2] < sizes[1] and sizes[-1] == sizes[-2]
    last = corpus_pipeline.run(spark, data_dir).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in now.select("doc_id").collect()} and len(last) == sizes[-1]
