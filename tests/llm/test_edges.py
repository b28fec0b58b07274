"""Nulls, empty tables, clashing columns, long texts and repeated rows, through every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldsheet.llm import chat, decontamination, html_extract, language, line_dedup, mixing, near_dedup, quality, simhash, vptree, warc
from fieldsheet.llm.queries import QUERIES, SQL

LONG = "word " * 60_000
ROWS = [(1, "the same text of more than ten letters", "en", "a", 1), (1, "the same text of more than ten letters", "en", "a", 1), (None, None, None, None, None), (2, "", "", "", 0), (3, LONG, "en", "b", 1), (4, "\n\n", None, "b", 2), (5, "A. B? ünï çö 日本", "zz", None, 3)]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")


def clash(df):
    """Extra columns whose names are those of results, inputs and helpers, also in other letter cases."""
    return df.select("*", *[F.lit("x").alias(c) for c in ("Text", "DOC_ID", "size", "score", "key", "rank", "fp", "h", "words", "turns", "_c0", "block", "component_id", "ts", "kind", "v")])


DOCUMENT_OPS = {
    "mixing": lambda d: mixing.allocate(d), "mixed": lambda d: mixing.mixed(d, keep=("text",)), "lines": lambda d: line_dedup.dedup_lines(d), "simhash": lambda d: simhash.group(d), "near": lambda d: near_dedup.groups(d),
    "language": lambda d: language.identify(d, language.fit(d), "doc_id"), "quality": lambda d: quality.score(d, quality.fit(d, d.sparkSession.createDataFrame([(1, 1), (3, 0), (None, None)], "doc_id long, quality int")), "doc_id"),
    "leaks": lambda d: decontamination.contaminated(d, d.sparkSession.createDataFrame([(1, "the same text of more than ten letters"), (2, None), (None, "b 5 km")], "item_id long, text string")),
}


@pytest.mark.parametrize("name", list(DOCUMENT_OPS))
def test_document_operators(spark, docs, name):
    op = DOCUMENT_OPS[name]
    plain = sorted(map(repr, op(docs).collect()))
    assert sorted(map(repr, op(clash(docs)).collect())) == plain
    assert op(docs.limit(0)).count() == 0
    if name in ("mixing", "lines", "simhash", "language", "quality"):
        assert len(plain) == len(ROWS)


def test_other_operators(spark):
    c = spark.createDataFrame([(1, 0, "user", None), (1, 0, "user", None), (None, None, None, "x"), (2, 1, "assistant", "y" * 200_000)], "conv_id long, turn long, role string, text string")
    f = lambda d: chat.render(chat.fold(chat.turns_to_events(d)))
    assert {(r.conv_id, r.formatted.count("</s>")) for r in f(clash(c)).collect()} == {(1, 2), (None, 1), (2, 1)} and f(c.limit(0)).count() == 0
    p = spark.createDataFrame([(1, None, None), (None, "u", "<p>x</p>"), (2, "http://x/", "<article><p>Some text. And more, of it.</p></article>"), (2, "http://x/", "")], "page_id long, url string, html string")
    assert html_extract.main_text(clash(p), "page_id").count() == 4 and html_extract.main_text(p.limit(0), "page_id").count() == 0
    assert warc.resolve(warc.capture_log(clash(p))).count() > 0 and warc.resolve(warc.capture_log(p.limit(0))).count() == 0
    e = spark.createDataFrame([(0, [1.0, 2.0]), (0, [1.0, 2.0]), (None, [1.0, 1.0]), (5, None), (6, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in vptree.nearest(clash(e)).collect()] == [(0, 1, 6, 0.0)] and vptree.nearest(e.limit(0)).count() == 0


def test_pipeline_edges(spark, docs, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "nothing like it at all here")], "item_id long, text string")
    for n, d in enumerate((docs, docs.limit(0))):
        at = str(tmp_path / str(n))
        for name, t in (("labels", labels), ("benchmark", bench), ("documents", d)):
            t.write.parquet(f"{at}/{name}.parquet")
        step = spark.read.parquet(f"{at}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, clash(step) if k < 2 else step, at).write.parquet(f"{at}/{k}")
            step = spark.read.parquet(f"{at}/{k}")
            assert set(corpus_pipeline.COLUMNS) == set(step.columns) or k == 4
        assert corpus_pipeline.run(spark, at).count() == step.count()


def test_registry():
    assert [k.split("_")[0] for k in QUERIES] == [f"op{n}" for n in range(1, 11)] and set(SQL) <= set(QUERIES)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
