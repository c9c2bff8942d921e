import random

import pandas as pd

from tickforge.llm.subjects import composition, fit, fold, sentences, subject_areas


def corpus(n=900, seed=5):
    rng = random.Random(seed)
    words = {"tea": ["kettle", "leaf", "saucer", "steep", "brew", "samovar"], "sea": ["anchor", "mast", "harbour", "keel", "tide", "rudder"]}
    plain = ["It rained for most of the week.", "Everyone agreed and the matter was closed.", "The bus was late again."]
    docs, true = [], {}
    for i in range(n):
        mine = rng.choice([["tea"], ["sea"], ["tea", "sea"], []])
        out, count = [], {"tea": 0, "sea": 0}
        for _ in range(rng.randrange(4, 12)):
            s = rng.choice([*mine, None]) if mine else None
            if s:
                a, b = rng.sample(words[s], 2)
                out.append(f"The {a} and the {b} were noted on day {rng.randrange(90)}.")
                count[s] += 1
            else:
                out.append(rng.choice(plain))
        docs.append((i, "en", " ".join(out)))
        true[i] = {s for s, c in count.items() if c >= len(out) / 4}
    terms = [(s, "en", w) for s in words for w in words[s][:2]]
    return docs, terms, true


def test_held_out_accuracy(spark):
    docs, terms, true = corpus()
    labels = [(i, s) for i in range(0, 900, 10) for s in (true[i] or {"none"})]
    extra = [(2000, "en", None), (2001, "en", ""), (2002, None, "?!"), (2003, "en", "The kettle and the leaf were noted. " * 3000)]
    got = subject_areas(
        spark.createDataFrame(docs + extra, "doc_id long, lang string, text string").selectExpr("*", "1 as subject", "2 as threshold"),
        spark.createDataFrame(terms, "subject string, lang string, term string"), spark.createDataFrame(labels, "doc_id long, subject string"),
    )
    found = {}
    for i, s in got.collect():
        found.setdefault(i, set()).add(s)
    assert found.pop(2003) == {"tea"} and not set(found) & {2000, 2001, 2002}
    held = [i for i in true if i % 10]
    hits = sum(len(found.get(i, set()) & true[i]) for i in held)
    assert 2 * hits / sum(len(found.get(i, set())) + len(true[i]) for i in held) > 0.95
    shares = {r["subject"]: r["share"] for r in composition(spark.createDataFrame(docs, "doc_id long, lang string, text string"), got).collect()}
    assert 0.2 < shares["tea"] < 0.7


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, lang string, text string")
    terms = spark.createDataFrame([], "subject string, lang string, term string")
    labels = spark.createDataFrame([], "doc_id long, subject string")
    assert subject_areas(docs, terms, labels).collect() == []
    full = spark.createDataFrame([("tea", "en", "kettle")], terms.schema)
    assert subject_areas(docs, full, labels).collect() == []


def test_sentences_and_folding():
    assert sentences("Eins, zwei! Drei... vier") == [["eins", "zwei"], ["drei"], ["vier"]]
    assert fold("Prüfung É mão") == "prufung e mao"
    assert fit(pd.DataFrame({"doc_id": [], "lang": [], "text": []}), pd.DataFrame({"subject": ["a"], "lang": ["en"], "term": ["x"]}), pd.DataFrame({"doc_id": [], "subject": []})).subjects == ["a"]
