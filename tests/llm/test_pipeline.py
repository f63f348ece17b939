"""The pipeline's stages on the odd rows, each against a plain version of its decision, and the registered queries."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from check import compare
from sensorloom.llm import mixing, queries
from tests.llm.frames import collected, documents, odd_rows, passage
from tests.llm.test_exact import plain_components, plain_fingerprint, plain_hits, plain_lines

SF = "/root/testdata/sf0.001"
TOXIC = "vileword uglyword meanword"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The tables the stages read beside their documents."""
    out = tmp_path_factory.mktemp("tables")
    labels = [(300 + k, 1, k % 2) for k in range(60)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    items = [(1, passage(2, 90)), (2, None), (None, ""), (3, passage(3, 20))]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def rows():
    return odd_rows() + [(300 + k, f"{passage(400 + k, 12)} {TOXIC if k % 2 else 'goodword'}") for k in range(60)]


def ids(frame):
    return sorted((r["doc_id"] for r in frame.collect()), key=repr)


def test_stages_keep_the_columns_and_stand_empty_tables(spark, folder):
    for _, stage in corpus_pipeline.STAGES:
        for docs in (documents(spark, rows()), documents(spark, [])):
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns
            assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert out.count() == 0


def test_toxic_documents_go(spark, folder):
    docs = documents(spark, rows())
    assert ids(corpus_pipeline.drop_toxic(spark, docs, folder)) == ids(docs.filter("doc_id is null or doc_id < 300 or doc_id % 2 = 0"))


def test_common_lines_stay_once(spark, folder):
    out = corpus_pipeline.drop_common_lines(spark, documents(spark), folder)
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
    assert got == sorted(((i, text) for i, _, _, text in plain_lines(10, True)), key=repr)
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())


def test_one_of_each_group_of_near_duplicates_stays(spark, folder):
    """The stage against fingerprints of three-word shingles compared all with all at three bits, on the odd rows, copies and texts edited a little."""
    base = [passage(900 + k, 400) for k in range(40)]
    edited = [" ".join(w if at != 5 + k else "other" for at, w in enumerate(t.split())) for k, t in enumerate(base)]
    far = [" ".join(w if at % 9 else f"x{at}" for at, w in enumerate(t.split())) for t in base[:10]]
    given = rows() + [(1000 + k, t) for k, t in enumerate(base + edited + far)] + [(2000, base[0]), (2001, base[0])]
    docs = documents(spark, given)
    keyed = {r["key"]: r["text"] for r in corpus_pipeline._key(docs).collect()}
    prints = {key: plain_fingerprint(text, 3) for key, text in keyed.items()}
    roots = plain_components(set(prints.values()), 3)
    groups = {}
    for key, fp in prints.items():
        groups.setdefault(roots[fp], set()).add(key)
    out = corpus_pipeline.drop_near_duplicates(spark, docs, folder)
    kept = {r["key"] for r in corpus_pipeline._key(out).collect()}
    smallest = lambda keys: min(keys, key=lambda k: (k["id"] is not None, k["id"] or 0, k["digest"]))
    assert kept == {smallest(keys) for keys in groups.values()}
    # some edited texts link, those edited far do not
    gone = {k["id"] for k in prints} - {k["id"] for k in kept}
    assert {2000, 2001} <= gone and len(gone & set(range(1040, 1080))) > 10
    assert not gone & set(range(1080, 1090))


def test_contaminated_documents_go(spark, folder):
    docs = documents(spark)
    items = [(1, passage(2, 90)), (3, passage(3, 20))]
    bad = {doc for doc, _, n_hit, _, _ in ((d, n, h, i, c) for d, n, h, i, c in plain_hits([(i, (t or "")[:3000]) for i, t in odd_rows()], items, 10)) if n_hit}
    assert bad == {7, 8, 11}
    kept = corpus_pipeline.drop_contaminated(spark, docs, folder)
    want = [i for i, t in odd_rows() if i not in bad or t.startswith("a different")]
    assert ids(kept) == sorted(want, key=repr)


def test_mixing_draws_by_probability(spark, folder):
    docs = documents(spark)
    keyed = queries.with_margins(corpus_pipeline._key(docs), "key")
    drawn = mixing.mixed(keyed, queries.MARGINS, rounds=queries.ROUNDS, id_col="key").collect()
    assert ids(corpus_pipeline.mix(spark, docs, folder)) == sorted((r["key"]["id"] for r in drawn if r["sampled"]), key=repr)
    assert {r["sampled"] for r in drawn} == {True, False}


def test_whole_pipeline(spark):
    out = corpus_pipeline.run(spark, SF)
    documents_of = spark.read.parquet(f"{SF}/documents.parquet")
    assert out.columns == documents_of.columns
    assert 0 < out.count() < documents_of.count()
    assert out.join(documents_of, "doc_id", "left_anti").count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    text, _, good = compare(spark, con, name, SF)
    assert good, text


def test_results_are_whole(spark):
    count = lambda name: spark.read.parquet(f"{SF}/{name}.parquet").count()
    for name in ("op2_simhash", "op4_toxicity", "op6_chunk_dedup"):
        assert len(collected(contract.queries()[name](spark, SF).select("doc_id"))) == count("documents")
    assert contract.queries()["op3_html_text"](spark, SF).count() == count("pages")


def test_a_single_repeated_chunk_goes(spark, tmp_path):
    """Copies of texts of 40 to 90 bytes, which make no run of 96 bytes."""
    texts = [passage(2000 + k, 20)[: 40 + k] for k in range(50)]
    documents(spark, [*enumerate(texts), *((100 + k, t) for k, t in enumerate(texts))]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["n_removed"] for r in queries.QUERIES["op6_chunk_dedup"](spark, str(tmp_path)).collect()}
    assert not any(got[k] for k in range(50))
    assert all(got[100 + k] >= 32 for k in range(50))
