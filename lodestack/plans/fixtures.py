"""Views of papers, citations, vectors, questions, judgements and answers over the star-schema test tables.

The texts are SQL that Spark and DuckDB both run, so queries and their oracles see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PROBES = [
    "What is the best treatment for chemotherapy-induced nausea and vomiting?",
    "Does metformin reduce the risk of colorectal cancer in adults?",
    "p53 mutation and prognosis in breast cancer",
    "Vitamin D supplementation and kidney outcomes",
    "ginger for nausea in pregnancy",
    "How does AMPK activation act on the mTOR pathway?",
    "Survival after SGLT2 inhibitors in heart failure",
    "PD-1 and EGFR expression, GLP-1 agonists",
    "insomnia",
    "statins and mortality in older adults with diabetes",
    "",
]

VIEWS = {
    "papers": """SELECT 10000000 + doc_id AS pmid,
        concat(substr(split_part(text, chr(10), 1), 1, 120), CASE doc_id % 12 WHEN 0 THEN ': a systematic review and meta-analysis'
            WHEN 1 THEN ': a randomized controlled trial in adults' WHEN 2 THEN ': a prospective cohort of patients' WHEN 3 THEN ': a case-control study'
            WHEN 4 THEN ': clinical practice guideline' WHEN 5 THEN ': treatment and management, a review' WHEN 6 THEN ': in vitro study in mice'
            WHEN 7 THEN ': signaling pathway mechanism' WHEN 8 THEN ': safety and adverse events in children' WHEN 9 THEN ': survival and mortality outcomes' ELSE '' END) AS title,
        CASE WHEN doc_id % 17 = 0 THEN '' ELSE concat(text, CASE doc_id % 5 WHEN 0 THEN ' There was no significant reduction in risk.'
            WHEN 1 THEN ' Treatment with metformin reduced incidence.' WHEN 2 THEN ' Vitamin D supplementation and kidney outcomes were measured.'
            WHEN 3 THEN ' TP53 mutation and prognosis were assessed.' ELSE '' END) END AS abstract,
        CASE WHEN doc_id % 11 = 0 THEN NULL ELSE concat('Journal of ', source) END AS journal,
        CASE WHEN doc_id % 29 = 0 THEN NULL ELSE CAST(1970 + doc_id % 55 AS INT) END AS year, '' AS mesh,
        CASE doc_id % 8 WHEN 0 THEN 'Meta-Analysis; Systematic Review' WHEN 1 THEN 'Randomized Controlled Trial' WHEN 2 THEN 'Review' WHEN 3 THEN 'Editorial'
            WHEN 4 THEN 'Practice Guideline' WHEN 5 THEN 'Case Reports' ELSE '' END AS pubtypes,
        CASE WHEN doc_id % 97 = 0 THEN 1 ELSE 0 END AS retracted FROM documents""",
    "citations": """SELECT 10000000 + user_id AS pmid, CASE WHEN user_id % 10 = 9 THEN NULL ELSE count(*) END AS citation_count,
        CASE WHEN user_id % 4 = 0 THEN NULL ELSE round(avg(value) / 20e0, 4) END AS rcr FROM events GROUP BY user_id""",
    "vectors": "SELECT 10000000 + vec_id AS pmid, embedding AS vector, label FROM embeddings",
    "questions": "SELECT item_id AS question_id, text AS question FROM benchmark",
    "probes": "SELECT * FROM (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), '{q}')" for i, q in enumerate(PROBES)) + ") AS p(question_id, question)",
    "judged": "SELECT 10000000 + doc_id AS pmid, doc_id % 13 AS question_id, 2 * quality + (1 - toxic) AS relevance FROM labels",
    "answers": """SELECT conv_id * 100 + turn AS answer_id, conv_id, concat(text, ' [', CAST(10000000 + conv_id AS STRING), ', ', CAST(10000001 + turn AS STRING), ']',
        CASE WHEN conv_id % 7 = 0 THEN concat(' (PMID ', CAST(10000002 + conv_id AS STRING), ')') ELSE '' END,
        CASE WHEN conv_id % 5 = 0 THEN concat(chr(10), '## Short answer', chr(10), 'Yes, observed.', chr(10), '## Evidence basis', chr(10), 'It proves a cause.') ELSE '' END) AS answer
        FROM conversations WHERE role = 'assistant'""",
}
SOURCES = {"papers": "documents", "citations": "events", "vectors": "embeddings", "questions": "benchmark", "probes": None, "judged": "labels", "answers": "conversations"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source = SOURCES[name]
    if source is None:
        return spark.sql(VIEWS[name])
    return spark.sql(VIEWS[name].replace(f"FROM {source}", f"FROM {{{source}}}"), **{source: spark.read.parquet(f"{sf_dir}/{source}.parquet")})


def with_views(*names: str) -> str:
    """The views as the head of a DuckDB query."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
