import math
import textwrap

from lodestack.llm import licenses as L


def classify(words):
    """Prediction on a text of words by the formula: family, probability, similarity, confirmed; None if there is none."""
    weights, offsets, temperature = L.trained()
    families = [*sorted(L.TEMPLATES), L.UNKNOWN]
    if not (hits := [weights[g] for g in L.grams_of(words) if g in weights]):
        return None
    z = [(sum(w[k] for w in hits) + offsets[k]) / temperature for k in range(len(families))]
    e = [math.exp(v - max(z)) for v in z]
    k = max(range(len(e)), key=lambda i: (e[i], -i))
    if families[k] == L.UNKNOWN or e[k] / sum(e) < L.LEAST:
        return None
    own = {" ".join(words[i : i + 3]) for i in range(len(words) - 2)} | {" ".join(words)}
    like = 0
    for t in L.TEMPLATES[families[k]]:
        w = L.words_of(t)
        shape = {" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))}
        like = max(like, len(own & shape) / len(shape))
    return families[k], e[k] / sum(e), like, like >= L.CONFIRM


def brute(text):
    """The notices of a text, by walking over its lines."""
    weights, *_ = L.trained()
    anchors = {w for g in weights for w in g.split() if w not in L.COMMON}
    lines = [L.words_of(x) for x in (text or "").split("\n")]
    stretches = []
    for i, ws in enumerate(lines):
        if not anchors & set(ws):
            continue
        if stretches and (i - stretches[-1][-1] == 1 or (i - stretches[-1][-1] == 2 and lines[i - 1])):
            stretches[-1].append(i)
        else:
            stretches.append([i])
    for st in stretches:
        single = {i: c for i in st if (c := classify(lines[i]))}
        whole = classify([w for ws in lines[st[0] : st[-1] + 1] for w in ws]) if len(st) > 1 else None
        for i, c in single.items():
            if c[3]:
                yield (i, i, c[0], *c)
        if whole and whole[3] and whole[0] not in {c[0] for c in single.values() if c[3]}:
            yield (st[0], st[-1], whole[0], *whole)
        if not any(c[3] for c in single.values()) and not (whole and whole[3]):
            for i, c in single.items():
                yield (i, i, L.UNKNOWN, *c)


def check(spark, rows):
    got = {(r.doc_id, r.line, r.last_line, r.family, r.predicted): r for r in L.op6(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {(d, *x[:4]): x for d, t in rows for x in brute(t)}
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert abs(r.probability - want[k][4]) < 1e-5 and abs(r.similarity - want[k][5]) < 1e-5 and r.confirmed == want[k][6]
    return got


def test_whole_table_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert check(spark, rows)


def test_planted_lines_of_the_documents(spark):
    """Held out: the licence lines that stand in the documents, told by their names, and no other line."""
    names = {"GNU General Public License, version 3": "gpl", "All rights reserved": "proprietary", "MIT License": "mit", "CC BY-NC 4.0": "cc-by-nc", "Apache License, Version 2.0": "apache"}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = {(r.doc_id, i, f) for r in docs.collect() for i, x in enumerate((r.text or "").split("\n")) for n, f in names.items() if n in x}
    got = {(r.doc_id, r.line, r.family) for r in L.op6(docs).collect() if r.confirmed}
    assert len(want) > 20 and got == want


def test_wrapped_notices_and_unseen_families(spark):
    families = ["mit", "bsd", "isc", "epl", "zlib", "mpl", "apache", "boost", "gpl"]
    rows = []
    for width in (40, 60, 76):
        for f in families:
            notice = "\n".join("# " + x for x in textwrap.wrap(" ".join(L.TEMPLATES[f]), width))
            rows.append((len(rows), f"some code line = 1\n\n{notice}\n\nand the code goes on\n"))
    unseen = [
        "This beerware notice: as long as you retain it you can do whatever you want with this stuff. If we meet some day, you can buy me a beer in return.",
        "Dieses Werk darf nur mit Zustimmung des Verfassers kopiert und verbreitet werden.",
        "The licensee shall pay a yearly fee to the licensor for every seat that is in use on the last day of March.",
    ]
    rows += [(100 + i, t) for i, t in enumerate(unseen)]
    rows += [(200, "Licensed under the MIT License.\nLicensed under the Apache License, Version 2.0.\n\nAll rights\n\nreserved.")]
    got = check(spark, rows)
    for i in range(len(rows) - 4):
        assert {k[3] for k in got if k[0] == i and got[k].confirmed} == {families[i % len(families)]}, families[i % len(families)]
    assert all(k[3] == L.UNKNOWN and not got[k].confirmed for k in got if 100 <= k[0] < 200)
    assert {(k[1], k[3]) for k in got if k[0] == 200 and got[k].confirmed} == {(0, "mit"), (1, "apache")}


def test_families_and_plain_text(spark):
    texts = [(f, t) for f in L.TEMPLATES for t in L.TEMPLATES[f]] + [(None, p) for p in L.PLAIN] + [(None, ""), (None, None), (None, "of the and. " * 9000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, (_, t) in enumerate(texts)], "doc_id long, text string, family string, line int")
    got = {r.doc_id: r for r in L.op6(docs).collect()}
    for i, (f, t) in enumerate(texts):
        assert (got[i].family if i in got and got[i].confirmed else None) == f, t


def test_calibration_and_odd_rows(spark):
    rows = L.examples(2)
    weights, offsets, temperature = L.trained()
    right = sum(max(range(len(offsets)), key=lambda k: sum(weights[g][k] for g in gs if g in weights) + offsets[k]) == y for gs, y in rows)
    assert right / len(rows) > 0.93
    twice = spark.createDataFrame([(1, "x\nAll rights reserved.\n\nAll rights reserved."), (1, "x\nAll rights reserved.\n\nAll rights reserved."), (None, "Released under the MIT License")], "doc_id long, text string")
    assert L.op6(twice).count() == 5 and L.op6(twice.limit(0)).count() == 0
