"""Documents whose other columns have the names that the operators use inside, with negative, null and repeated ids."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from millrace.llm import decontamination, jaccard, language, line_dedup, lm, packing, quality, token_counts, toxicity, wavelet
from millrace.llm.queries import BYTE_BPE, WORD_BPE
from tests.oracle import DATA

HELPERS = "__id __row __gone __size __main __hash __hit __null __text text_hash row_hash key sid n n_sets spare place grp start part at pos h l1 l2 keys line norm sim a b u v node label of far cluster band block split known first_id draw total k x t score held_out n_tokens n_lines n_removed item_id component_id n_shingles sequence_id offset ids content".split()
LONG = "the first of two lines that are alike in all but one letter of them"
TEXTS = [(5, LONG), (-9, LONG.replace("letter", "lettar")), (-5, LONG.upper()), (None, LONG), (None, None), (3, None), (3, ""), (-2, "quite another text\nof two lines"), (-2, "quite another text\nof two lines"), (7, "you stupid idiot"), (2**62, "far away\n\n\n"), (8, "  \t\n")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "src", len(t or ""), *range(len(HELPERS))) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{h}` int" for h in HELPERS)).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(7, 0, 1), (5, 1, 0), (-2, 1, 0), (-9, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=lambda i: (i is None, i or 0))


def test_each_operator_gives_all_rows(spark, docs, labels, tmp_path):
    want = sorted((i for i, _ in TEXTS), key=lambda i: (i is None, i or 0))
    items = spark.createDataFrame([(1, LONG)], "item_id int, text string")
    folder = wavelet.write_ids(docs, BYTE_BPE, str(tmp_path / "ids"))
    for found in (
        toxicity.toxicity(docs, labels),
        quality.quality(docs, labels),
        lm.lm_scores(docs),
        token_counts.token_counts(docs, BYTE_BPE),
        language.languages(docs),
        line_dedup.dedup_lines(docs.drop("n_lines", "n_removed")),
        jaccard.jaccard_components(docs),
        packing.pack(docs, WORD_BPE).filter("start = 0"),
        wavelet.with_starts(wavelet.documents(spark, folder)),
    ):
        assert ids(found) == want
    assert sorted({r.doc_id for r in decontamination.contaminated(docs, items).collect() if r.doc_id is not None}) == [-9, -5, 5]


def test_filters_keep_the_other_columns(spark, docs, labels):
    items = spark.createDataFrame([(1, LONG)], "item_id int, text string")
    for kept in (toxicity.drop_toxic(docs, labels), jaccard.keep_one(docs), decontamination.drop_contaminated(docs, items), line_dedup.dedup_lines(docs).select(*docs.columns), line_dedup.dedup_lines(docs, whole=0.75).select(*docs.columns)):
        assert kept.columns == docs.columns
        extra = [h for h in HELPERS if h not in ("n_lines", "n_removed")]
        assert all([r[h] for h in extra] == [HELPERS.index(h) for h in extra] for r in kept.collect())


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_stages_take_odd_rows_and_none(spark, docs, name, stage):
    d = f"{DATA}/sf0.001"
    for given in (docs, docs.limit(0), docs.select("doc_id", "text")):
        out = stage(spark, given, d)
        if name != P.STAGES[-1][0]:
            assert out.columns == given.columns
        out.collect()


@pytest.mark.parametrize("whole", [None, 0.75])
def test_lines_of_negative_ids_meet(spark, whole):
    other = LONG.replace("alike", "alyke")
    for low, high in ((-9, -5), (5, 9), (-5, 9)):
        df = spark.createDataFrame([(high, f"{other}\na line of its own {high} here"), (low, f"{LONG}\nsome further words {low} there")], "doc_id bigint, text string")
        got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(df, whole=whole).collect()}
        assert got == {low: 0, high: 1}
