"""DuckDB SQL for the queries of :mod:`lodestack.queries` that SQL can express."""

from __future__ import annotations

from lodestack.functions import lexicon as L
from lodestack.oracle_rules import BOOST, CLINICAL_Q, CLINICALISH, FINAL, IMPACT, RATE, RECENCY, RULES, any_in
from lodestack.plans.fixtures import VIEWS, with_views
from lodestack.queries import REPLIES

SQL: dict[str, str] = dict(RULES)


def words(terms) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in terms) + "]"


def tok(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+')"


def terms_of(x: str) -> str:
    return f"list_filter({tok(x)}, lambda t: (len(t) > 3 OR (len(t) >= 2 AND regexp_matches(t, '[a-z]') AND regexp_matches(t, '[0-9]'))) AND NOT list_contains({words(L.STOPWORDS)}, t))"


def ordered_distinct(x: str) -> str:
    return f"list_filter({x}, lambda t, i: list_position({x}, t) = i)"


def focus_of(x: str) -> str:
    return f"list_slice(list_filter({tok(x)}, lambda t: len(t) > 3 AND NOT list_contains({words(L.FOCUS_STOPWORDS)}, t)), 1, 2)"


def anchors_of(x: str) -> str:
    return ordered_distinct(f"list_filter({terms_of(x)}, lambda t: NOT list_contains({words(L.GENERIC)}, t))")


def padded(x: str) -> str:
    return f"' ' || array_to_string({tok(x)}, ' ') || ' '"


def ids(x: str) -> str:
    return rf"list_sort(list_distinct(list_transform(regexp_extract_all({x}, '\b[0-9]{{5,9}}\b'), lambda v: CAST(v AS BIGINT))))"


def cited(x: str) -> str:
    return rf"list_sort(list_distinct(list_transform(flatten(list_transform(regexp_extract_all({x}, '\[([^\]]+)\]', 1), lambda b: regexp_extract_all(b, '\b[0-9]{{5,9}}\b'))), lambda v: CAST(v AS BIGINT))))"


def bare(x: str) -> str:
    return ids(rf"regexp_replace({x}, '\[[^\]]*\]', chr(10), 'g')")


INDEX = f"""idx AS (
  SELECT term, id, count(*) AS tf FROM (SELECT pmid AS id, unnest({tok("concat_ws(' ', coalesce(title, ''), coalesce(abstract, ''))")}) AS term FROM papers) GROUP BY ALL
), ds AS (
  SELECT pmid AS id, CAST(len({tok("concat_ws(' ', coalesce(title, ''), coalesce(abstract, ''))")}) AS BIGINT) AS length FROM papers
), ts AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM idx GROUP BY term), sz AS (SELECT count(*) AS n, avg(length) AS al FROM ds)"""
WEIGHT = "greatest(1e-6, ln((n - df + 0.5e0) / (df + 0.5e0))) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * length / al))"
MATCH = "JOIN idx USING (term) JOIN ts USING (term) JOIN ds ON ds.id = idx.id CROSS JOIN sz"


def bm25(name: str, terms: str, k: int = 100) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, pmid) AS INT) AS pos FROM (
      SELECT question_id, idx.id AS pmid, round(sum({WEIGHT}), 6) AS score FROM (SELECT DISTINCT question_id, term FROM ({terms})) q {MATCH} GROUP BY question_id, idx.id)) WHERE pos <= {k})"""


def dense(name: str, k: int, only: str = "TRUE") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, pmid) AS INT) AS pos FROM (
      SELECT question_id, v.pmid, round(list_cosine_similarity(w.vector::DOUBLE[], v.vector::DOUBLE[]), 6) AS score
      FROM questions JOIN vectors w ON w.pmid = 10000000 + question_id JOIN vectors v ON {only})) WHERE pos <= {k})"""


FUSED = f"""{with_views('papers', 'citations', 'vectors', 'questions')}, {INDEX}, {dense('dl', 100)},
{bm25('bl', f"SELECT question_id, unnest({terms_of('question')}) AS term FROM questions")},
{bm25('fl', f"SELECT question_id, unnest({focus_of('question')}) AS term FROM questions")},
lists AS (SELECT question_id, pmid, 0 AS l, pos FROM dl UNION ALL SELECT question_id, pmid, 1, pos FROM bl UNION ALL SELECT question_id, pmid, 2, pos FROM fl),
fused AS (SELECT question_id, pmid, round(sum(1e0 / (60 + pos)), 9) AS fused, min(l * 1000 + pos) AS first_seen FROM lists GROUP BY question_id, pmid),
rel AS (SELECT *, round(fused / max(fused) OVER (PARTITION BY question_id), 9) AS rel FROM fused) """
_low = "lower(coalesce(title, ''))"
RANKED = FUSED + f""", cand AS (
  SELECT question_id, pmid, rel, first_seen, year, citation_count, rcr, lower(trim(concat_ws(' ', coalesce(title, ''), coalesce(abstract, '')))) AS body, {_low} AS low_title,
    lower(coalesce(pubtypes, '') || ' ' || coalesce(title, '')) AS ev, {terms_of('question')} AS terms, {focus_of('question')} AS focus, {anchors_of('question')} AS anchors, lower(question) AS q
  FROM rel JOIN papers USING (pmid) JOIN questions USING (question_id) LEFT JOIN citations USING (pmid)
), m AS (
  SELECT *, {CLINICAL_Q} AS clinical, len(list_filter(terms, lambda t: contains(body, t))) AS overlap, len(list_filter(focus, lambda t: contains(body, t))) AS focus_overlap,
    len(list_filter(anchors, lambda t: contains(body, t))) AS anchor, len(list_filter(anchors, lambda t: contains(low_title, t))) AS title_anchor,
    0 AS entity, 0 AS concept, 0 AS title_entity, 0 AS title_concept FROM cand
), kept AS (
  SELECT * FROM m WHERE length(body) >= 40 AND anchor >= least(len(anchors), 2) AND NOT (len(focus) > 0 AND focus_overlap = 0 AND rel < 0.65e0) AND NOT (len(terms) > 0 AND overlap < 1 AND rel < 0.55e0)
), sc AS (SELECT *, {IMPACT} AS impact, {BOOST} AS boost FROM kept),
ranked AS (SELECT question_id, pmid, round({FINAL}, 6) AS score, first_seen FROM sc) """

SQL["tokenize_docs"] = f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, t[1] AS first_token FROM (SELECT doc_id, {tok('text')} AS t FROM documents)"
SQL["query_terms"] = f"""{with_views('probes', 'questions')} SELECT question_id, array_to_string({terms_of('question')}, ' ') AS terms, array_to_string({anchors_of('question')}, ' ') AS anchors,
  array_to_string({focus_of('question')}, ' ') AS focus FROM (SELECT * FROM probes UNION ALL SELECT question_id + 100, question FROM questions)"""
SQL["norm_title"] = f"{with_views('papers')} SELECT pmid, array_to_string({tok('title')}, ' ') AS norm, CAST(len(list_distinct(list_filter({tok('title')}, lambda t: len(t) > 2))) AS BIGINT) AS n_tokens FROM papers"
SQL["phrase_present"] = f"""{with_views('papers')} SELECT pmid, contains({padded('abstract')}, ' vitamin d supplementation ') AS vitamin, contains({padded('title')}, ' case control ') AS case_control,
  CAST(len(list_filter(['risk', 'tp53', 'metformin', 'risk'], lambda t: contains(lower(trim(concat_ws(' ', coalesce(title, ''), coalesce(abstract, '')))), t))) AS BIGINT) AS overlap FROM papers"""
SQL["term_stats"] = f"{with_views('papers')}, {INDEX} SELECT * FROM ts"
SQL["doc_stats"] = f"{with_views('papers')}, {INDEX} SELECT * FROM ds"
_probe_terms = bm25("bl", f"SELECT question_id, unnest({terms_of('question')}) AS term FROM questions")
SQL["bm25_topk"] = f"{with_views('papers', 'questions')}, {INDEX}, {_probe_terms} SELECT * FROM bl"
_compact = [(sorted({"".join(c for c in a if c.isalnum()) for a in g}), g) for g in L.ENTITIES]
_text = "question || ' ' || array_to_string(" + focus_of("question") + ", ' ')"
_groups = " UNION ALL ".join(
    f"SELECT question_id, {i} AS g, unnest({words(flat)}) AS term FROM probes WHERE list_has_any({tok(_text)}, {words(flat)})" + "".join(f" OR contains({padded(_text)}, ' {' '.join(a.replace('-', ' ').split())} ')" for a in g)
    for i, (flat, g) in enumerate(_compact)
)
_groups += f" UNION ALL SELECT question_id, 99, unnest({words(L.PROGNOSIS_TERMS)}) FROM probes WHERE regexp_matches(lower(question), '\\bprognos(?:is|tic)?\\b')"
SQL["bm25_strict_topk"] = f"""{with_views('papers', 'probes')}, {INDEX}, gr AS ({_groups}), need AS (SELECT question_id, count(DISTINCT g) AS need FROM gr GROUP BY 1 HAVING count(DISTINCT g) >= 2)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, pmid) AS INT) AS pos FROM (
  SELECT question_id, idx.id AS pmid, round(sum({WEIGHT}), 6) AS score FROM gr JOIN need USING (question_id) {MATCH} GROUP BY question_id, idx.id, need HAVING count(DISTINCT g) = need)) WHERE pos <= 100"""
SQL["dense_topk"] = f"{with_views('vectors', 'questions')}, {dense('dl', 100)} SELECT * FROM dl"
SQL["recall_at_k"] = f"""{with_views('vectors', 'questions')}, {dense('truth', 10)}, {dense('found', 10, 'v.pmid % 5 <> 0')}
SELECT count(*) AS n_questions, round(avg(r), 6) AS recall FROM (SELECT question_id, count(f.pmid) / count(*) AS r FROM truth t LEFT JOIN found f USING (question_id, pmid) GROUP BY question_id)"""
SQL["alignment_stats"] = f"""{with_views('vectors')} SELECT count(*) AS n, round(avg(c), 6) AS mean_cosine, round(min(c), 6) AS min_cosine, count(*) FILTER (c > 0.95) AS above_95
FROM (SELECT list_cosine_similarity(a.vector::DOUBLE[], b.vector::DOUBLE[]) AS c FROM vectors a JOIN vectors b ON a.pmid + 1 = b.pmid)"""
SQL["rrf_fuse"] = FUSED + "SELECT question_id, pmid, fused FROM fused"
SQL["rel_normalize"] = FUSED + "SELECT question_id, pmid, rel FROM rel"
SQL["candidate_filter"] = RANKED + "SELECT question_id, pmid FROM ranked"
SQL["final_rank"] = RANKED + "SELECT question_id, pmid, score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, first_seen) AS INT) AS rank FROM ranked"
SQL["recency_score"] = f"{with_views('papers')} SELECT pmid, round({RECENCY}, 6) AS recency FROM papers"
SQL["citation_rate"] = f"{with_views('papers', 'citations')} SELECT pmid, round({RATE}, 6) AS rate FROM papers LEFT JOIN citations USING (pmid)"
SQL["impact_score"] = f"{with_views('papers', 'citations')} SELECT pmid, round({IMPACT}, 6) AS impact FROM papers LEFT JOIN citations USING (pmid)"
SQL["evidence_boost"] = f"""{with_views('papers')} SELECT pmid, round({BOOST}, 6) AS boost, {CLINICALISH} AS clinicalish
FROM (SELECT pmid, pmid % 2 = 0 AS clinical, lower(coalesce(pubtypes, '') || ' ' || coalesce(title, '')) AS ev FROM papers)"""
SQL["exact_title_dedup"] = f"""{with_views('papers')}, n AS (SELECT pmid, pmid % 5 AS question_id, array_to_string({tok('title')}, ' ') AS norm, abstract FROM papers)
SELECT question_id, min(pmid) AS pmid FROM n WHERE NOT (length(norm) = 0 OR (length(norm) < 8 AND length(trim(coalesce(abstract, ''))) < 40)) GROUP BY question_id, norm"""
SQL["title_classes"] = f"""{with_views('papers')}, s AS (SELECT pmid, list_sort(list_distinct(list_filter({tok('title')}, lambda t: len(t) > 2))) AS k FROM papers)
SELECT pmid AS id, min(pmid) OVER (PARTITION BY k) AS representative FROM s WHERE len(k) > 0"""
SQL["title_jaccard_pairs"] = f"""{with_views('papers')}, s AS (SELECT min(pmid) AS pmid, k FROM (SELECT pmid, list_sort(list_distinct(list_filter({tok('title')}, lambda t: len(t) > 2))) AS k FROM papers) GROUP BY k)
SELECT a, b, j AS jaccard FROM (SELECT x.pmid AS a, y.pmid AS b, round(len(list_intersect(x.k, y.k)) / (len(x.k) + len(y.k) - len(list_intersect(x.k, y.k))), 6) AS j
  FROM s x JOIN s y ON x.pmid < y.pmid AND len(x.k) > 0 AND len(y.k) > 0) WHERE j >= 0.8"""
SQL["balanced_context"] = f"""{with_views('papers')}, p AS (SELECT pmid, pmid % 11 AS question_id, pmid % 11 < 5 AS clinical, lower(coalesce(pubtypes, '') || ' ' || coalesce(title, '')) AS ev FROM papers),
g AS (SELECT *, CASE WHEN {CLINICALISH} THEN 0 ELSE 1 END AS g FROM p), n AS (SELECT *, row_number() OVER (PARTITION BY question_id, g ORDER BY pmid) AS nth FROM g),
f AS (SELECT *, CASE WHEN nth <= CASE WHEN g = 0 THEN CASE WHEN clinical THEN 7 ELSE 5 END ELSE CASE WHEN clinical THEN 3 ELSE 5 END END THEN g ELSE 2 END AS phase FROM n)
SELECT question_id, pmid, context_pos, CASE WHEN g = 0 THEN 'clinical/review' ELSE 'mechanistic/other' END AS context_group
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY phase, pmid) AS INT) AS context_pos FROM f) WHERE context_pos <= 10"""
_ANS = with_views("answers") + ", a AS (SELECT *, [10000000 + conv_id, 10000002 + conv_id] AS valid FROM answers) "
SQL["cited_ids"] = _ANS + f"SELECT answer_id, array_to_string({cited('answer')}, ',') AS cited, array_to_string({ids('answer')}, ',') AS anywhere FROM a"
SQL["unbracketed_ids"] = _ANS + f"SELECT answer_id, array_to_string({bare('answer')}, ',') AS bare FROM a"
_minus = lambda x: f"list_sort(list_filter({x}, lambda v: NOT list_contains(valid, v)))"
SQL["invalid_ids"] = _ANS + f"SELECT answer_id, array_to_string({_minus(cited('answer'))}, ',') AS invalid FROM a"
_n = lambda x: f"CAST(len({x}) AS BIGINT)"
SQL["citation_status"] = _ANS + f"""SELECT answer_id, {_n(cited('answer'))} AS n_cited, {_n(ids('answer'))} AS n_anywhere, {_n(bare('answer'))} AS n_unbracketed, {_n(_minus(cited('answer')))} AS n_invalid_cited,
  {_n(_minus(ids('answer')))} AS n_invalid_anywhere, contains(answer, 'not in [PMID] citation format') AND contains(answer, 'WARNING') AS format_warning,
  contains(answer, 'cited PMIDs not in the retrieved') AS validation_warning, contains(answer, 'NOTE: normalized retrieved PMIDs') AS normalization_note FROM a"""
SQL["judge_rollup"] = f"""{with_views('judged')} SELECT question_id, round(avg(relevance), 3) AS mean_relevance, count(*) FILTER (relevance >= 3) AS at_3, count(*) FILTER (relevance >= 2) AS at_2,
  count(*) FILTER (relevance = 0) AS irrelevant, count(relevance) AS judged FROM judged GROUP BY question_id"""
_run = lambda s: f"SELECT question_id, pmid, pos FROM (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY {s} DESC, pmid) AS INT) AS pos FROM judged) WHERE pos <= 10"
_RUNS = ", o AS (" + _run("(pmid * 7919) % 1009") + "), n AS (" + _run("(pmid * 7919) % 1009 + 40 * relevance") + "), x AS (SELECT question_id, pmid, o.pos AS old_pos, n.pos AS new_pos FROM o FULL JOIN n USING (question_id, pmid)) "
SQL["compare_eval"] = with_views("judged") + _RUNS + """SELECT question_id, count(*) FILTER (old_pos IS NOT NULL AND new_pos IS NOT NULL) AS overlap, count(*) AS in_either, count(*) FILTER (old_pos IS NULL) AS added,
  count(*) FILTER (new_pos IS NULL) AS removed, round(count(*) FILTER (old_pos IS NOT NULL AND new_pos IS NOT NULL) / count(*), 6) AS jaccard FROM x GROUP BY question_id"""
SQL["rank_moves"] = with_views("judged") + _RUNS + """SELECT * FROM (SELECT *, old_pos - new_pos AS delta, CAST(row_number() OVER (PARTITION BY question_id ORDER BY abs(old_pos - new_pos) DESC, old_pos - new_pos DESC, pmid DESC) AS INT) AS nth
  FROM x WHERE old_pos <> new_pos) WHERE nth <= 3"""
SQL["set_overlap"] = with_views("judged") + _RUNS + "SELECT CASE WHEN old_pos IS NULL THEN 'added' WHEN new_pos IS NULL THEN 'removed' ELSE 'kept' END AS side, count(*) AS n, CAST(sum(pmid) AS BIGINT) AS ids FROM x GROUP BY 1"
SQL["run_summary"] = with_views("judged", "papers") + _RUNS + f""", p AS (SELECT *, lower(coalesce(pubtypes, '') || ' ' || coalesce(title, '')) AS ev FROM papers)
SELECT question_id, count(*) AS n_results, count(DISTINCT nullif(journal, '')) AS n_journals, min(nullif(year, 0)) AS first_year, max(nullif(year, 0)) AS last_year,
  count(*) FILTER ({CLINICALISH}) AS clinical_review, count(*) FILTER (NOT {CLINICALISH}) AS mechanistic_other FROM n JOIN p USING (pmid) GROUP BY question_id"""
_low = "(' ' || replace(lower(answer), chr(10), ' ') || ' ')"
_basis = r"regexp_matches(answer, '(?im)^(#{1,6}[ \t]+evidence basis[ \t]*|evidence basis:[ \t]*)$')"
_flags = f"""concat_ws('; ', CASE WHEN starts_with(lower(trim(regexp_extract(answer, '(?is)(?:^|\\n)##[ \\t]+short answer[ \\t]*(?:\\n|$)(.*?)(?:\\n##[ \\t]|$)', 1))), 'yes') AND contains({_low}, 'observ')
  THEN 'short-answer starts with yes despite observational language' END, """ + ", ".join(f"CASE WHEN contains({_low}, ' {w} ') THEN 'causal term:{w}' END" for w in L.CAUSAL) + f""",
  CASE WHEN NOT {any_in(_low, L.QUALIFYING)} THEN 'no obvious evidence qualifier' END, CASE WHEN NOT {_basis} THEN 'missing Evidence basis section' END)"""
SQL["answer_flags"] = _ANS + f"SELECT answer_id, {_flags} AS flags FROM a"
_metrics = {
    "validation_or_format_warnings": "(contains(answer, 'not in [PMID] citation format') AND contains(answer, 'WARNING')) OR contains(answer, 'cited PMIDs not in the retrieved')",
    "invalid_cited": f"len({_minus(cited('answer'))}) > 0", "invalid_anywhere": f"len({_minus(ids('answer'))}) > 0", "unbracketed": f"len({bare('answer')}) > 0",
    "normalization_notes": "contains(answer, 'NOTE: normalized retrieved PMIDs')", "with_evidence_basis": _basis, "with_review_flags": f"{_flags} <> ''",
}
SQL["compare_answers_agg"] = _ANS + "SELECT metric, old_value, new_value, new_value - old_value AS delta FROM (" + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, count(*) FILTER (conv_id % 2 = 0 AND ({c})) AS old_value, count(*) FILTER (conv_id % 2 = 1 AND ({c})) AS new_value FROM a" for m, c in _metrics.items()
) + ")"
SQL["citation_audit"] = with_views("judged", "papers", "citations") + _RUNS + f""", r AS (SELECT question_id, pmid, pos, citation_count, round({IMPACT}, 6) AS impact FROM n JOIN papers USING (pmid) LEFT JOIN citations USING (pmid))
SELECT question_id, count(*) AS papers, round(median(impact), 6) AS median_impact, median(CAST(citation_count AS DOUBLE)) AS median_citations, arg_max(pmid, impact * 1000 - pos / 1e6) AS best_pmid,
  count(*) FILTER (coalesce(citation_count, 0) < 10) AS low_cited, count(*) FILTER (impact < 0.35) AS low_impact FROM r GROUP BY question_id"""
SQL["upsert_papers"] = with_views("papers") + """ SELECT pmid, CASE WHEN pmid % 3 = 0 THEN 'new ' || title ELSE title END AS title, year FROM papers
  UNION ALL SELECT pmid + 5000000, 'added', year FROM papers WHERE pmid % 50 = 0"""
SQL["enrich_fill"] = with_views("papers") + """ SELECT pmid, title, CASE WHEN pmid % 2 = 0 AND coalesce(abstract, '') = '' THEN 16 ELSE length(abstract) END AS n_abstract,
  CASE WHEN pmid % 4 = 0 THEN 'Fetched Journal' ELSE journal END AS journal, CAST(CASE WHEN pmid % 2 = 0 THEN 2001 ELSE year END AS INT) AS year, CASE WHEN pmid % 2 = 0 THEN 'M' ELSE mesh END AS mesh, pubtypes,
  CASE WHEN pmid % 2 = 0 THEN 1 ELSE retracted END AS retracted FROM papers"""
SQL["missing_metadata"] = with_views("papers") + " SELECT pmid FROM papers WHERE coalesce(journal, '') = '' OR coalesce(pubtypes, '') = '' OR year IS NULL"
SQL["integrity_report"] = with_views("papers", "citations", "vectors") + """, p AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT pmid) AS DOUBLE) AS di,
  round(100.0e0 * count(*) FILTER (coalesce(title, '') <> '' OR coalesce(abstract, '') <> '') / count(*), 3) AS te, round(100.0e0 * count(*) FILTER (coalesce(abstract, '') <> '') / count(*), 3) AS ab,
  round(100.0e0 * count(*) FILTER (year IS NOT NULL) / count(*), 3) AS ye FROM papers), c AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM citations), v AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM vectors)
SELECT 'papers' AS "check", n AS value, CASE WHEN n > 0 THEN 'pass' ELSE 'warn' END AS status FROM p UNION ALL SELECT 'distinct_ids', di, CASE WHEN di = n THEN 'pass' ELSE 'warn' END FROM p
UNION ALL SELECT 'vectors', n, CASE WHEN n > 0 THEN 'pass' ELSE 'warn' END FROM v UNION ALL SELECT 'citations', n, CASE WHEN n > 0 THEN 'pass' ELSE 'warn' END FROM c
UNION ALL SELECT 'text_coverage', te, CASE WHEN te >= 95 THEN 'pass' ELSE 'warn' END FROM p UNION ALL SELECT 'abstract_coverage', ab, CASE WHEN ab >= 95 THEN 'pass' ELSE 'warn' END FROM p
UNION ALL SELECT 'year_coverage', ye, CASE WHEN ye >= 95 THEN 'pass' ELSE 'warn' END FROM p"""
SQL["chunk_report"] = with_views("papers") + """, c AS (SELECT *, CAST(pmid % 4 AS INT) AS chunk FROM papers UNION ALL SELECT *, 4 FROM papers WHERE pmid % 9 = 0), f AS (SELECT *, min(chunk) OVER (PARTITION BY pmid) AS first FROM c)
SELECT chunk, count(*) AS rows, count(*) FILTER (coalesce(title, '') = '' AND coalesce(abstract, '') = '') AS without_text, count(*) FILTER (coalesce(abstract, '') = '') AS without_abstract,
  count(*) FILTER (coalesce(year, 0) = 0) AS without_year, count(*) FILTER (first < chunk) AS seen_before FROM f GROUP BY chunk"""
SQL["coerce_year"] = r"""SELECT doc_id, CAST(CASE WHEN regexp_full_match(h, '[0-9]{4}') AND TRY_CAST(h AS INT) BETWEEN 1800 AND 2200 THEN TRY_CAST(h AS INT) END AS INT) AS year FROM (SELECT doc_id, substr(CASE doc_id % 4 WHEN 0 THEN CAST(doc_id + 1700 AS VARCHAR) || '0115'
  WHEN 1 THEN 'abcd' WHEN 2 THEN '19' || CAST(doc_id % 100 AS VARCHAR) END, 1, 4) AS h FROM documents)"""
SQL["unique_ids"] = "SELECT user_id AS pmid, min(event_id) AS pos FROM events WHERE event_id % 6 <> 0 AND user_id >= 0 GROUP BY user_id"
SQL["parse_xml"] = with_views("papers") + " SELECT pmid, trim(title) AS title, coalesce(journal, '') AS journal, year, pubtypes, 0 AS retracted FROM papers"
SQL["parse_chunk_json"] = with_views("papers") + " SELECT pmid, title, coalesce(journal, '') AS journal, year, pubtypes FROM papers"
_expected = [(2, "other", False, "", ""), (1, "cohort", False, "", ""), (3, "meta-analysis", True, "", ""), (2, "other", False, "", "x"), (0, "randomized_trial", False, "", ""), (None, "other", False, "", ""), (None, "other", False, "", ""), (3, "other", False, "", "")]
SQL["normalize_judgement"] = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {'NULL' if r is None else r}, '{e}', {a}, '{p}', '{w}')" for i, (r, e, a, p, w) in enumerate(_expected[: len(REPLIES)])) + ") AS v(reply_id, relevance, evidence_type, answers_question, population_or_model, reason)"

_TITLED = with_views("judged", "papers") + _RUNS
SQL["artifact_ids"] = _TITLED + "SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY pos) - 1 AS INT) AS pos, pmid FROM n JOIN papers USING (pmid)"
SQL["text_ids"] = _ANS + r"SELECT answer_id, CAST(i - 1 AS INT) AS pos, CAST(v[i] AS BIGINT) AS pmid FROM (SELECT answer_id, v, unnest(range(1, len(v) + 1)) AS i FROM (SELECT answer_id, regexp_extract_all(answer, '\b[0-9]{5,9}\b') AS v FROM a))"
SQL["selected_rows"] = _TITLED + """, r AS (SELECT question_id AS q, string_agg(CAST(pmid AS VARCHAR), ',' ORDER BY pos) AS ids, count(*) AS k FROM n JOIN papers USING (pmid) GROUP BY question_id),
w AS (SELECT * FROM (VALUES (0, 1, 'exact'), (1, 12, 'contains'), (2, NULL, 'ambiguous'), (3, NULL, 'missing')) AS v(question_id, q, status))
SELECT CAST(question_id AS BIGINT) AS question_id, status, coalesce(ids, '') AS ids, coalesce(k, 0) AS n_valid FROM w LEFT JOIN r USING (q)"""
SQL["load_papers"] = with_views("papers") + """, e AS (SELECT 10000000 + user_id AS pmid, min(event_id) AS pos FROM events GROUP BY 1)
SELECT pmid, CASE WHEN pmid % 4 = 0 THEN 'fetched' ELSE title END AS title, CASE WHEN pmid % 4 = 0 THEN 'Fetched Journal' ELSE journal END AS journal,
  CAST(CASE WHEN pmid % 4 = 0 THEN 2001 ELSE year END AS INT) AS year, pos FROM papers JOIN e USING (pmid) WHERE pmid % 4 = 0 OR title <> '' OR abstract <> ''"""
SQL["uncited_ids"] = with_views("papers", "citations") + " SELECT DISTINCT pmid FROM papers WHERE pmid NOT IN (SELECT pmid FROM citations)"
SQL["judge_deltas"] = with_views("judged") + """, x AS (SELECT question_id, pmid, relevance::DOUBLE AS old_relevance, least(3, relevance + pmid % 3 - 1)::DOUBLE AS new_relevance FROM judged)
SELECT * FROM (SELECT *, new_relevance - old_relevance AS delta, CAST(row_number() OVER (PARTITION BY question_id ORDER BY abs(new_relevance - old_relevance) DESC, new_relevance - old_relevance DESC, pmid DESC) AS INT) AS nth
  FROM x WHERE new_relevance <> old_relevance) WHERE nth <= 5"""
SQL["run_means"] = with_views("judged") + """, m AS (SELECT 'relevance' AS metric, pmid % 2 AS s, relevance::DOUBLE AS v FROM judged UNION ALL SELECT 'seconds', pmid % 2, CASE WHEN pmid % 5 > 0 THEN (pmid % 1000) / 8e0 END FROM judged)
SELECT metric, round(avg(v) FILTER (s = 0), 6) AS old_mean, round(avg(v) FILTER (s = 1), 6) AS new_mean, round(avg(v) FILTER (s = 1) - avg(v) FILTER (s = 0), 6) AS delta FROM m GROUP BY metric"""
_PAIR = _ANS + r""", b AS (SELECT answer_id, answer, CASE WHEN conv_id % 3 = 0 THEN regexp_replace(answer, '\[[^\]]*\]', '', 'g') ELSE answer END || ' [' || (10000005 + conv_id) || ']' AS later FROM a),
c AS (SELECT answer_id AS question_id, """ + f"{cited('answer')} AS o, {cited('later')} AS n FROM b) "
_list = lambda x: f"array_to_string(list_sort({x}), ',')"
SQL["cited_sets"] = _PAIR + f"""SELECT question_id, {_list('list_intersect(o, n)')} AS in_both, {_list('list_distinct(list_concat(o, n))')} AS in_either,
  {_list('list_filter(n, lambda v: NOT list_contains(o, v))')} AS added, {_list('list_filter(o, lambda v: NOT list_contains(n, v))')} AS removed FROM c"""
SQL["run_presence"] = with_views("judged") + " SELECT question_id, CASE question_id % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'old' ELSE 'both' END AS side FROM judged GROUP BY question_id"
SQL["answer_papers"] = _ANS + f"""SELECT answer_id AS question_id, pos, pmid FROM (SELECT answer_id, {cited('answer')} AS c, unnest([10000002 + conv_id, 10000000 + conv_id, 10000003]) AS pmid, unnest([0, 1, 2])::INT AS pos FROM a)
WHERE list_contains(c, pmid)"""
SQL["formatted"] = r"""SELECT doc_id, CASE WHEN length(f) <= 60 THEN f ELSE rtrim(substr(f, 1, 60)) || '…' END AS excerpt, coalesce(printf('%.1f', n), 'n/a') AS shown, coalesce(CASE WHEN n >= 0 THEN '+' ELSE '' END || printf('%.2f', n) || 's', 'n/a') AS delta
FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS f, CASE WHEN doc_id % 7 > 0 THEN (doc_id % 41 - 20) / 4e0 END AS n FROM documents)"""
_CHUNKED = with_views("papers", "vectors", "citations") + """, c AS (SELECT CAST(v.pmid % 4 AS INT) AS chunk, CAST(floor((v.pmid - 10000000) / 4) AS BIGINT) AS pos, v.pmid, p.pmid AS known,
  coalesce(p.title, '') AS title, coalesce(p.abstract, '') AS abstract, p.year, CAST(len(vector) AS BIGINT) AS dim FROM vectors v LEFT JOIN papers p ON p.pmid = v.pmid AND p.pmid % 3 > 0 WHERE v.pmid % 50 < 48) """
SQL["load_chunks"] = _CHUNKED + "SELECT chunk, pos, pmid, title, length(abstract) AS n_abstract, year, dim FROM c"
SQL["snapshot_report"] = _CHUNKED + """, n AS (SELECT count(*)::DOUBLE AS p, count(DISTINCT pmid)::DOUBLE AS di, (SELECT count(*)::DOUBLE FROM citations) AS ci,
  round(100e0 * count(*) FILTER (title <> '' OR abstract <> '') / count(*), 3) AS te, round(100e0 * count(*) FILTER (abstract <> '') / count(*), 3) AS ab, round(100e0 * count(*) FILTER (year IS NOT NULL) / count(*), 3) AS ye FROM c),
k AS (SELECT unnest(['papers', 'distinct_ids', 'vectors', 'citations', 'text_coverage', 'abstract_coverage', 'year_coverage']) AS "check", unnest([p, di, p, ci, te, ab, ye]) AS value, unnest([p > 0, di = p, p > 0, ci > 0, te >= 95, ab >= 95, ye >= 95]) AS ok FROM n)
SELECT "check", value, CASE WHEN ok THEN 'pass' ELSE 'warn' END AS status FROM k UNION ALL SELECT 'overall', count(*) FILTER (NOT ok)::DOUBLE, CASE WHEN bool_and(ok) THEN 'pass' ELSE 'warn' END FROM k"""
_HEAD = "'[' || pmid || '] (' || coalesce(CAST(nullif(year, 0) AS VARCHAR), '?') || ', ' || coalesce(journal, '') || '; types=' || coalesce(pubtypes, '') || ')' || chr(10) || 'Title: ' || coalesce(title, '')"
_cut = lambda n: f"CASE WHEN length(coalesce(abstract, '')) > {n} THEN substr(abstract, 1, {n}) || '...[truncated]' ELSE coalesce(abstract, '') END"
SQL["text_blocks"] = with_views("papers") + f""" SELECT pmid, md5({_HEAD} || chr(10) || 'Abstract: ' || {_cut(400)}) AS paper, md5({_HEAD} || chr(10) || 'Evidence note: A note on ' || pmid || '.') AS noted,
  md5('PMID: ' || pmid || chr(10) || 'Title: ' || coalesce(title, '') || chr(10) || 'Year: ' || coalesce(CAST(year AS VARCHAR), '') || chr(10) || 'Journal: ' || coalesce(journal, '') || chr(10)
    || 'Publication types: ' || coalesce(pubtypes, '') || chr(10) || 'Abstract: ' || {_cut(6000)}) AS judged, '[' || pmid || '] ' || coalesce(title, '') AS line FROM papers"""
_ASKED = with_views("judged", "papers", "questions") + _RUNS + ", q AS (SELECT n.question_id, pmid, pos, question, title, abstract, year, journal, pubtypes FROM n JOIN questions USING (question_id) JOIN papers USING (pmid) WHERE question_id < 13) "
SQL["paper_notes"] = _ASKED + "SELECT question_id, pmid, trim(title || ' [' || pmid || ']') AS note FROM q"
SQL["judged_papers"] = _ASKED + r"""SELECT question_id, pmid, CAST(least(3, len(list_filter(list_filter(list_distinct(regexp_extract_all('question: ' || lower(string_split(question, chr(10) || chr(10))[1]), '[a-z0-9]+')), lambda w: len(w) > 4 AND w <> 'question'),
  lambda w: contains(lower('PMID: ' || pmid || ' title: ' || coalesce(title, '') || ' year: ' || coalesce(CAST(year AS VARCHAR), '') || ' journal: ' || coalesce(journal, '') || ' publication types: ' || coalesce(pubtypes, '') || ' abstract: ' || """ + _cut(6000) + r"""), w)))) AS INT) AS relevance,
  'other' AS evidence_type, NULL::VARCHAR AS error FROM q"""
SQL["flagged_papers"] = _TITLED.replace("WITH", f"WITH citations AS ({VIEWS['citations']}),", 1) + f""", r AS (SELECT question_id, pmid, pos, citation_count, round({IMPACT}, 6) AS impact FROM n JOIN papers USING (pmid) LEFT JOIN citations USING (pmid))
SELECT question_id, pmid, impact, row_number() OVER (PARTITION BY question_id ORDER BY impact, pos) AS nth FROM r WHERE coalesce(citation_count, 0) < 10 OR impact < 0.35"""
SQL["retrieval_query"] = f"""{with_views('probes')}, p AS (SELECT question_id, trim(question) AS own, lower(trim(question)) AS low FROM probes),
a AS (SELECT *, {any_in('low', L.MANAGEMENT_QUERY)} AS manage, CASE WHEN {any_in('low', L.ADJUNCTIVE_QUERY)} THEN {words(L.ADJUNCTIVE_EXPANSION)}
  ELSE list_concat(CASE WHEN regexp_matches(low, '(?:^|[^a-z0-9_])(?:chemo|chemotherapy|antineoplastic)(?:[^a-z0-9_]|[^a-z0-9_].*[^a-z0-9_])(?:nausea|vomiting|emesis)(?:$|[^a-z0-9_])')
    OR regexp_matches(low, '(?:^|[^a-z0-9_])(?:nausea|vomiting|emesis)(?:[^a-z0-9_]|[^a-z0-9_].*[^a-z0-9_])(?:chemo|chemotherapy|antineoplastic)(?:$|[^a-z0-9_])') THEN {words(L.CINV_EXPANSION)} ELSE [] END, {words(L.EXPANSION)}) END AS adds FROM p)
SELECT question_id, CASE WHEN manage THEN concat_ws(' ', own, array_to_string(list_filter(adds, lambda x: NOT list_contains(regexp_extract_all(low, '[a-z0-9]+(?: [a-z0-9]+)*'), lower(x))), ' ')) ELSE own END AS expanded FROM a"""
