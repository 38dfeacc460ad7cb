"""Terms that disclose an entity, against a plain count over whole documents."""

from symweave.llm import pii


def marked(spark, rows):
    """{doc_id: [(kind, text of the span)]} of the spans that are terms."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text = dict(rows)
    parts = {r.doc_id: [x.split(":") for x in r.spans.split(",") if x] for r in pii.spans(docs).collect()}
    return {i: [(k, text[i][int(a) : int(b)]) for k, a, b in found if k in ("remove", "generalise")] for i, found in parts.items()}


def test_entities_of_one_document_count(spark):
    rows = [(0, "call zanzibar agent A@mail.org now")] + [(k, f"call agent now and then {k}") for k in range(1, 60)]
    got = marked(spark, rows)
    assert got[0] == [("remove", "zanzibar")] and not any(got[k] for k in range(1, 60))


def test_terms_far_from_the_entity_count(spark):
    far = "this and that and so on and on for a while until"
    rows = [(k, f"zanzibar first A@mail.org {far} then Zanzibar {far} quokka{'' if k else '!'}") for k in range(4)]
    rows += [(4, f"quokka {far}")] + [(k, f"first then {far} {k}") for k in range(5, 200)]
    got = marked(spark, rows)
    # zanzibar twice in each; quokka tells nearly as much as the entity, but also stands without it; quokka! stands only with it
    assert got[1] == [("generalise", "quokka"), ("remove", "zanzibar"), ("remove", "Zanzibar")]
    assert ("remove", "quokka!") in got[0] and not any(got[k] for k in range(4, 200))


def test_against_plain_counts(spark):
    import math
    import random

    rng = random.Random(4)
    rows = []
    for k in range(150):
        words = [f"w{int(rng.paretovariate(0.5)) % 900}" for _ in range(40)]
        for _ in range(rng.choice((0, 0, 1, 2))):
            words.insert(rng.randrange(40), rng.choice((f"u{rng.randrange(9)}@x.org", f"10.0.0.{rng.randrange(9)}", f"<a{k}@y.org>")))
        rows.append((k, " ".join(words)))
    held, words, df, n, c = {}, {}, {}, {}, {}
    for k, t in rows:
        spans = pii.base_spans(t)
        held[k] = {pii.entity(kind, t[a:b]) for kind, a, b in spans}
        words[k] = [(m[0].lower(), *m.span()) for m in pii.WORD.finditer(t) if not any(a < m.end() and m.start() < b for _, a, b in spans)]
        for w in set(t.lower().split()):
            df[w] = df.get(w, 0) + 1
        for e in held[k]:
            n[e] = n.get(e, 0) + 1
            for w in {w for w, _, _ in words[k]}:
                c[e, w] = c.get((e, w), 0) + 1
    tells = {(e, w): v >= df[w] for (e, w), v in c.items() if math.log2(v * 150 / (df[w] * n[e])) >= 0.8 * math.log2(150 / n[e])}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for r in pii.spans(docs).collect():
        want = []
        for w, x, y in words[r.doc_id]:
            exact = [tells[e, w] for e in held[r.doc_id] if (e, w) in tells]
            want += [f"{'remove' if any(exact) else 'generalise'}:{x}:{y}"] if exact else []
        assert sorted(p for p in r.spans.split(",") if p.startswith(("remove", "generalise"))) == sorted(want)
    assert len(tells) > 100 and set(tells.values()) == {True, False}
