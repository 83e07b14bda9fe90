"""What the pipeline's first stage leaves of kept documents."""

import corpus_pipeline

from tessera.llm.quality_rules import keep_good
from tests.llm.helpers import BASE_TEXT, DATA, docs_frame, documents, rows_of


def test_stage_removes_failing_lines(spark):
    rows = [(1, f"| a | b | c | d\n{BASE_TEXT}\n\n### $$$ ###\nRead our cookie policy."), (2, f"{BASE_TEXT}\n\nMore words here."), (3, "| a | b"), (4, None)]
    docs = docs_frame(spark, rows)
    found = corpus_pipeline.STAGES[0][1](spark, docs, DATA)
    assert found.schema == docs.schema
    assert rows_of(found, "doc_id", "text", "n_chars") == [(1, BASE_TEXT, len(BASE_TEXT)), (2, rows[1][1], len(rows[1][1]))]
    assert rows_of(found.drop("text", "n_chars"), *docs.drop("text", "n_chars").columns) == rows_of(keep_good(docs), *docs.drop("text", "n_chars").columns)


def test_stage_keeps_what_passes_in_the_table(spark):
    texts = dict(documents())
    found = rows_of(corpus_pipeline.STAGES[0][1](spark, docs_frame(spark, documents()), DATA), "doc_id", "text", "n_chars")
    assert [d for d, _, _ in found] == [d for (d,) in rows_of(keep_good(docs_frame(spark, documents())), "doc_id")]
    assert all(n == len(t) and set(t.split("\n")) <= set(texts[d].split("\n")) for d, t, n in found)
