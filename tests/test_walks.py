"""The greedy queries' whole output against plain walks, and the text queries without SQL against plain Python."""

import re
from difflib import SequenceMatcher

from lodestack import queries
from lodestack.config import DEFAULT
from lodestack.functions import lexicon as L
from lodestack.functions import text as T
from lodestack.operators import evidence


def norm(title):
    return " ".join(re.findall("[a-z0-9]+", (title or "").lower()))


def test_greedy_dedup_of_all_papers(spark, sf_dir):
    groups = {}
    for r in queries.view(spark, sf_dir, "papers").orderBy("pmid").collect():
        groups.setdefault(r.pmid // queries.DEDUPED_FROM, []).append(r)
    want = set()
    for g, rows in groups.items():
        kept = []
        for r in rows:
            n = norm(r.title)
            toks = {w for w in n.split() if len(w) > 2}
            if len(kept) >= 80 or not n or (len(n) < 8 and len((r.abstract or "").strip()) < 40):
                continue
            if not any(n == k or len(toks & t) / max(1, len(toks | t)) >= DEFAULT.title_jaccard or SequenceMatcher(None, n, k).ratio() >= DEFAULT.title_ratio for k, t in kept):
                kept.append((n, toks))
                want.add((g, r.pmid, len(kept)))
    got = {(r.question_id, r.pmid, r.kept_rank) for r in queries.QUERIES["greedy_dedup"](spark, sf_dir).collect()}
    assert got == want


def choose(rows, most=DEFAULT.max_selected, least=DEFAULT.min_selected):
    """The selection by its description: sort, take, one conflicting paper, caps by kind, fill up."""
    rows = sorted(rows, key=lambda r: -r["evidence_score"])
    intents = set(rows[0]["intents"].split(","))
    mechanism, cinv, manage = ("mechanism" in intents), ("cinv_management" in intents), ("clinical_management" in intents)
    capped = manage and not rows[0]["adjunctive_q"]
    barred = lambda r: "missing required exposure/entity term" in r["penalties"] or "pediatric title for adult question" in r["penalties"]
    out = []

    def take(r):
        ids = {x["pmid"] for x in out}
        alike = any(r["_norm"] and x["_norm"] and SequenceMatcher(None, r["_norm"], x["_norm"]).ratio() >= 0.90 for x in out)
        if r["pmid"] not in ids and not barred(r) and not alike:
            out.append(r)

    for r in rows:
        if len(out) >= most:
            break
        take(r)
    if len(out) < most and not any(r["conflict_signal"] for r in out):
        for r in rows:
            if r["conflict_signal"] and r["evidence_tier"] != "editorial":
                take(r)
                break
    clinical = lambda r: r["evidence_tier"] != "mechanistic" or (cinv and r["cinv_drug"])
    mech_cap = most
    if not mechanism:
        good, mech = [r for r in out if clinical(r)], [r for r in out if not clinical(r)]
        if cinv:
            drugs = [r for r in good if r["cinv_drug"]]
            other, seen = [], 0
            for r in good:
                seen += r["cinv_other"]
                if not r["cinv_other"] or seen <= (1 if drugs else 2):
                    other.append(r)
            good = other
        if len(good) >= 2 and not rows[0]["safety_q"]:
            good = [r for r in good if not r["safety"]]
        mech_cap = 1 if len(good) >= 2 else 2
        if len(good) >= 2:
            mech = [r for r in mech if not r["animal"]]
        out = good + mech[:mech_cap]
    if capped:
        broad, narrow = [r for r in out if not r["narrow"]], [r for r in out if r["narrow"]]
        out = broad + narrow[: 1 if len(broad) >= 4 else 2]
        central, side = [r for r in out if not r["adjunct"]], [r for r in out if r["adjunct"]]
        out = central + side[: 2 if len(central) >= 4 or not central else 1]
    target = min(most, max(least, len(rows)))
    for r in rows:
        if len(out) >= target:
            break
        if r["pmid"] in {x["pmid"] for x in out} or barred(r):
            continue
        if not mechanism:
            if not clinical(r) and sum(x["evidence_tier"] == "mechanistic" for x in out) >= mech_cap:
                continue
            if cinv and r["cinv_other"] and any(x["cinv_other"] for x in out) and any(x["cinv_drug"] for x in out):
                continue
            if len(out) >= 2 and (r["animal"] or (r["safety"] and not rows[0]["safety_q"])):
                continue
            if capped:
                side, narrow = sum(x["adjunct"] for x in out), sum(x["narrow"] for x in out)
                central, broad = len(out) - side, len(out) - narrow
                if r["adjunct"] and side >= (2 if central >= 4 or not central else 1):
                    continue
                if r["narrow"] and narrow >= (1 if broad >= 4 else 2):
                    continue
        out.append(r)
    return [r["pmid"] for r in out[:most]]


def test_select_evidence_of_all_pairs(spark, sf_dir):
    pairs = queries.ruled(spark, sf_dir).withColumn("question_id", queries.block(queries.SELECTED_FROM) * 11 + queries.F.col("question_id"))
    flags = evidence.with_scores(pairs).withColumns({k: queries.F.expr(v) for k, v in evidence.FLAGS.items()}).withColumn("_norm", T.norm_title("raw_title"))
    groups = {}
    for r in flags.orderBy("pmid").collect():
        groups.setdefault(r.question_id, []).append(r.asDict())
    want = {(q, p, i + 1) for q, rows in groups.items() for i, p in enumerate(choose(rows))}
    got = {(r.question_id, r.pmid, r.selected_pos) for r in queries.QUERIES["select_evidence"](spark, sf_dir).collect()}
    assert got == want


def test_alias_terms(spark, sf_dir):
    compact = lambda a: re.sub("[^a-z0-9]", "", a)
    names = {n: list(dict.fromkeys(map(compact, g))) for g in L.ENTITIES for n in map(compact, g)}
    got = {r.question_id: r for r in queries.QUERIES["alias_terms"](spark, sf_dir).collect()}
    for r in queries.view(spark, sf_dir, "probes").collect():
        toks = re.findall("[a-z0-9]+", r.question.lower())
        terms = [t for t in toks if (len(t) > 3 or (len(t) > 1 and re.search("[a-z]", t) and re.search("[0-9]", t))) and t not in L.STOPWORDS]
        want = list(dict.fromkeys(x for t in terms for x in names.get(t, [t])))
        assert got[r.question_id].terms == " ".join(want)
        focus = [t for t in toks if len(t) > 3 and t not in L.FOCUS_STOPWORDS][:2]
        joined = f" {' '.join(toks + focus)} "
        held = [g for g in L.ENTITIES if any(f" {compact(a)} " in joined or f" {' '.join(re.findall('[a-z0-9]+', a))} " in joined for a in g)]
        assert got[r.question_id].n_entities == len(held)
        assert got[r.question_id].n_concepts == bool(re.search(r"\bprognos(is|tic)?\b", r.question.lower()))
        assert got[r.question_id].phrases == ",".join(f"vitamin {m}" for m in re.findall(r"\bvitamin\s+([a-z0-9]+)\b", r.question.lower()))


def test_normalized_citations_of_all_answers(spark, sf_dir):
    got = {r.answer_id: r.answer for r in queries.QUERIES["normalize_citations"](spark, sf_dir).collect()}
    rows = queries.with_valid(spark, sf_dir).collect()
    for r in rows:
        valid = {str(v) for v in r.valid_ids}
        kept, at = [], 0
        bare = set()
        for m in re.finditer(r"\[[^\]]*\]|\(\s*(?:PMID\s*:?\s*)?([0-9]+)\s*\)|\bPMID\s*:?\s*([0-9]+)\b|\b([0-9]{5,9})\b", r.answer, re.I):
            found = next((x for x in m.groups() if x), None)
            kept.append(r.answer[at : m.start()])
            kept.append(f"[{found}]" if found in valid else m[0])
            bare |= {found} & valid if found else set()
            at = m.end()
        text = "".join([*kept, r.answer[at:]])
        assert got[r.answer_id].startswith(text), r.answer
        notes = got[r.answer_id][len(text) :]
        assert ("NOTE: normalized" in notes) == bool(bare)
        cited = {x for b in re.findall(r"\[([^\]]+)\]", text) for x in re.findall(r"\b[0-9]{5,9}\b", b)}
        assert ("possible hallucination" in notes) == bool(cited - valid)
