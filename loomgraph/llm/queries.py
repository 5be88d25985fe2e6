"""The queries of this folder's operators."""

from __future__ import annotations

from loomgraph.llm import canonical, noise, packing, sentences, similar, splitting, tokens
from loomgraph.queries.registry import Registry
from loomgraph.runtime import table

R = Registry()


@R.add("p8_ids")
def p8_ids(spark, d):
    return tokens.token_ids(table(spark, d, "documents"))


@R.add("p9_containers")
def p9_containers(spark, d):
    return packing.containers(table(spark, d, "documents"))


#: Of the rows of one id the one with the latest updated_at.
LATEST_DOCUMENTS = "docs AS (SELECT * FROM kb_documents WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, body DESC NULLS LAST) = 1)"


@R.add(
    "p3_found",
    f"""WITH {LATEST_DOCUMENTS} SELECT 'document' AS item_kind, id AS item_id FROM docs WHERE length(body) > 1600
    UNION SELECT 'chunk', chunk_id FROM kb_chunks WHERE length(text) > 200 AND chunk_id IS NOT NULL""",
)
def p3_found(spark, d):
    return splitting.found(table(spark, d, "kb_documents"), table(spark, d, "kb_chunks"))


@R.add("p3_pieces")
def p3_pieces(spark, d):
    return splitting.pieces(table(spark, d, "kb_documents"), table(spark, d, "kb_chunks"))


def _records(spark, d):
    return table(spark, d, "exam_items"), table(spark, d, "kb_documents"), table(spark, d, "page_extracts")


@R.add("p4_found")
def p4_found(spark, d):
    return canonical.found(*_records(spark, d))


@R.add("p4_classes")
def p4_classes(spark, d):
    return canonical.look_alike_classes(canonical.record_forms(*_records(spark, d)))


@R.add(
    "p1_found",
    """WITH v AS (SELECT chunk_id, max(e) AS e FROM (SELECT chunk_id, CAST(embedding AS DOUBLE[]) AS e FROM kb_chunks
      WHERE chunk_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0) GROUP BY 1)
    SELECT a.chunk_id AS chunk_a, b.chunk_id AS chunk_b FROM v a JOIN v b ON a.chunk_id < b.chunk_id
    WHERE array_cosine_similarity(CAST(a.e AS DOUBLE[64]), CAST(b.e AS DOUBLE[64])) >= 0.95""",
)
def p1_found(spark, d):
    return similar.found(table(spark, d, "kb_chunks"))


@R.add("p1_neighbours")
def p1_neighbours(spark, d):
    return similar.neighbours(similar.usable(table(spark, d, "kb_chunks")))


@R.add("p10_found")
def p10_found(spark, d):
    return sentences.found(table(spark, d, "documents"))


@R.add("p10_sentences")
def p10_sentences(spark, d):
    return sentences.sentences(table(spark, d, "documents"), with_text=True)


@R.add("p6_found")
def p6_found(spark, d):
    return noise.found(table(spark, d, "page_extracts"))


@R.add("p6_paragraphs")
def p6_paragraphs(spark, d):
    return noise.book_paragraphs(table(spark, d, "page_extracts"), table(spark, d, "doc_extracts"))
