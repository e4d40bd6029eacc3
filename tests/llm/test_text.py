"""Quality, personal data, toxicity and language."""

import itertools
import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from helpers import ODD, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from playbill.llm import langid, pii, quality, queries, toxicity

# -- personal data --------------------------------------------------------------------------------------------------


def brute_base(text):
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m[0].split("."))) <= 255]
    cards = [(m, re.sub("[^0-9]", "", m[0])) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)]
    out += [("card", m.start(), m.end()) for m, d in cards if 12 <= len(d) <= 19 and luhn(d)]
    phones = [(m, re.sub("[^0-9]", "", m[0])) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)]
    return sorted(out + [("phone", m.start(), m.end()) for m, d in phones if 9 <= len(d) <= 15])


PIECES = st.sampled_from(["a", "B", ".", "@", "1", "255", "0", "-", "+", " ", "(", ")", "4111111111111111", "x.y", "12", "99", "@a.b", "%", "é", "1.2.3.4", "+1 (555) 123-4567"])


@settings(max_examples=800, deadline=None)
@given(st.lists(PIECES, max_size=14))
def test_base_spans(pieces):
    text = "".join(pieces)
    assert sorted(pii.base_spans(text)) == brute_base(text)


@pytest.mark.parametrize(
    "text, kind, span",
    [
        ("mail john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
        ("jane (at) site(dot)org, ok", "email", "jane (at) site(dot)org"),
        ("jane at example dot com is", "email", "jane at example dot com"),
        ("jоhn@exаmple.com x", "email", "jоhn@exаmple.com"),
        ("name＠example．com", "email", "name＠example．com"),
        ("a.b_at_example_dot_com", "email", "a.b_at_example_dot_com"),
        ("call plus one five five five zero one two three four five six now", "phone", "plus one five five five zero one two three four five six"),
        ("call +1 five five five, two three four, five six seven eight", "phone", "+1 five five five, two three four, five six seven eight"),
        ("card four one one one one one one one one one one one one one one one x", "card", "four one one one one one one one one one one one one one one one"),
        ("ip 192 dot 168 dot 1 dot 20 ok", "ip", "192 dot 168 dot 1 dot 20"),
        ("１９２．１６８．１．２０", "ip", "１９２．１６８．１．２０"),
        ("at 192[.]168[.]0[.]1", "ip", "192[.]168[.]0[.]1"),
    ],
)
def test_disguises(text, kind, span):
    base, spans = pii.find(text)
    assert not base and [(k, text[a:b]) for k, a, b in spans] == [(kind, span)]


@pytest.mark.parametrize("text", ["look at the dot on the point", "one two", "un deux", "meet me at noon dot", "Привет мир", None, "", "see one. Two dogs at home."])
def test_clean_texts_have_no_spans(text):
    assert pii.find(text) == ([], [])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["five ", "at ", " dot ", "а", "@", "[at]", ".", "com", "7", "plus ", "ﬁ", "​", "x", "-", "double ", "İ"]), max_size=12))
def test_tapes_keep_their_source(pieces):
    text = "".join(pieces)
    tape = pii.plain_marks(pii.plain_digits(pii.plain_glyphs(pii.Tape.of(text))))
    assert len(tape.text) == len(tape.start) == len(tape.end) and all(0 <= a < b <= len(text) for a, b in zip(tape.start, tape.end)) and tape.start == sorted(tape.start)
    base, spans = pii.find(text)
    assert set(base) <= set(spans) and all(0 <= a < b <= len(text) for _, a, b in spans)


def test_personal_data_query_columns(spark):
    rows = [*ODD, (50, "a@b.co and 1.2.3.4, call +1 555 123 4567"), (51, "me [at] b [dot] co")]
    found = {r["doc_id"]: [tuple(x) for x in r["found"]] for r in pii.detect(documents(spark, rows)).collect()}
    assert found[50] == [("email", 0, 6, True), ("ip", 11, 18, True), ("phone", 25, 40, True)] and found[51] == [("email", 0, 18, False)] and found[2] == []
    assert pii.detect(documents(spark, [])).count() == 0
    assert pii.redact("mail a@b.co or c [at] d [dot] org") == "mail [email] or [email]" and pii.redact(None) is None


def test_long_runs_are_linear():
    for text in ("1" * 200_000, "a." * 100_000, "1.2." * 50_000, "+1" * 100_000, "a@" * 100_000, "five " * 40_000, "(" * 100_000, "x at " * 40_000):
        pii.find(text)
    n = 20_000
    for text in ("a" * n + " at x .com", "a." * n + " at x.com", "x [at] y.com" + " " * n + "z", "a dot " * n + " at b.com", "q at " + "b." * n + "!", "w" + " " * n + "@ .com dot", "a@b.co " * n + "c [at] d.org"):
        begun = time.perf_counter()
        pii.find(text)
        assert time.perf_counter() - begun < 5


# -- quality --------------------------------------------------------------------------------------------------------


def lines_of(rnd, n):
    return " ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 9))) for _ in range(n)).capitalize() + "."


def test_quality_learns_from_positives_and_unlabelled(spark):
    rnd = random.Random(1)
    rows, labels = [], []
    for k in range(900):
        good = k % 5 != 0
        text = lines_of(rnd, rnd.randint(20, 80)) if good else rnd.choice([lines_of(rnd, 40).replace(" ", " | "), lines_of(rnd, 40).upper().replace(" ", "!! "), "same words " * 40])
        rows.append((k, text))
        labels.append((k, int(good)))
    docs, held = documents(spark, rows), queries.is_bucket(3, 1)
    model = quality.train(docs, spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, quality int"), ~held)
    assert 0.7 < model.prior < 0.9
    got = quality.score(docs, model).withColumn("held", held).where("held").collect()
    assert np.mean([r["predicted"] == dict(labels)[r["doc_id"]] for r in got]) > 0.95
    kept = quality.keep_good(documents(spark, [*ODD, *rows[:10]]), model)
    assert kept.columns == docs.columns
    scored = quality.score(documents(spark, ODD), model).collect()
    assert len(scored) == len(ODD) and all(0 <= r["score"] <= 1 for r in scored)
    assert quality.score(documents(spark, []), model).count() == 0
    nobody = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.train(docs, nobody, ~held) is None and {r["score"] for r in quality.score(documents(spark, ODD), None).collect()} == {0.5}


def test_quality_risk_is_not_negative():
    """With more weights than texts a negative risk would run away; the scores of unseen negatives stay sensible."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 40)).astype(np.float32)
    y = x[:, 0] > -0.8
    model = quality.fit(x[:100][y[:100]], x[:100], float(y.mean()), decay=0.0)
    s = model.score(x[100:])
    assert np.isfinite(s).all() and np.mean((s >= 0.5) == y[100:]) > 0.7


def test_risk_and_gradient_equal_brute_force():
    rng = np.random.default_rng(2)
    p, u, w, prior = rng.normal(size=(7, 4)), rng.normal(size=(9, 4)), rng.normal(size=4), 0.7
    loss = lambda z: math.log(1 + math.exp(-z))

    def brute(w):
        dot = lambda x: sum(a * b for a, b in zip(x, w))
        plus = prior * sum(loss(dot(x)) for x in p) / len(p)
        minus = sum(loss(-dot(x)) for x in u) / len(u) - prior * sum(loss(-dot(x)) for x in p) / len(p)
        return np.array([plus, minus])

    plus, minus, of_plus, of_minus = quality.risk(w, p, u, prior)
    assert np.allclose([plus, minus], brute(w))
    for k in range(4):
        step = np.eye(4)[k] * 1e-6
        assert np.allclose([of_plus[k], of_minus[k]], (brute(w + step) - brute(w - step)) / 2e-6, atol=1e-6)


@pytest.mark.parametrize("prior, n", [(0.9, 3000), (0.6, 3000), (0.8, 60), (0.5, 4)])
def test_the_prior_needs_no_negatives(prior, n):
    rng = np.random.default_rng(6)
    draw = lambda good: rng.normal(size=(len(good), 3)) + 4 * good[:, None]
    positive, unlabelled = draw(np.ones(n, bool)).astype(np.float32), draw(rng.random(n) < prior).astype(np.float32)
    found = quality.estimate_prior(positive, unlabelled)
    assert abs(found - prior) < (0.05 if n > 1000 else 0.3 if n > 10 else 0.6)


def test_repeated_ids_do_not_enlarge_the_sample(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(1, lines_of(rnd, 20)) for _ in range(60)] + [(k, lines_of(rnd, 20)) for k in range(2, 40)] + [(1, "same row")] * 50
    labels = spark.createDataFrame([(1, 1)] * 30 + [(k, k % 2) for k in range(2, 40)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda p, u, prior: seen.append((len(p), len(u))))
    monkeypatch.setattr(quality, "estimate_prior", lambda p, u: 0.5)
    quality.train(documents(spark, rows), labels, F.lit(True), positives=12, unlabelled=17)
    assert seen == [(12, 17)]


# -- language -------------------------------------------------------------------------------------------------------


def test_language(spark):
    rnd = random.Random(2)
    words = {"en": "the and of with which house there through".split(), "de": "der und für mit welche Häuser über schön".split(), "fr": "le et de avec quelle maison où été".split(), "zz": "qx xq qq xx qxq".split()}
    rows = [(k, " ".join(rnd.choices(words[lang], k=30)), lang) for k in range(600) for lang in [rnd.choice(sorted(words))]]
    rows += [(2000 + k, " ".join(rnd.choices(words["en"], k=9)), None) for k in range(5)]
    docs, held = documents(spark, [*rows, *ODD]), queries.is_bucket(4, 2)
    model = langid.train(docs, ~held)
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert np.mean([got[k]["lang_pred"] == lang for k, _, lang in rows if lang]) > 0.97 and got[2]["lang_pred"] == got[4]["lang_pred"] == "und"
    assert got[2002]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(documents(spark, []), model).count() == 0
    assert langid.train(documents(spark, []), ~held) is None
    assert {r["lang_pred"] for r in langid.identify(documents(spark, ODD), None).collect()} == {"und"}
    alone = langid.train(documents(spark, [(k, "some words here", "en") for k in range(9)]), F.lit(True))
    assert {r["lang_pred"] for r in langid.identify(documents(spark, [(1, "words"), (2, "12")]), alone).collect()} == {"en", "und"}


@pytest.mark.parametrize("text, there", [("²½", False), ("12 _!", False), ("a", True), ("½ß", True), ("日", True), ("", False), (None, False)])
def test_letters(text, there):
    assert langid.has_letter(text) == there


@pytest.mark.parametrize("n", [1, 2, 4, 7])
def test_decoding_equals_brute_force(n):
    rng = np.random.default_rng(n)
    code = langid.codewords(n)
    model = langid.LanguageModel([f"l{k}" for k in range(n)], code, rng.normal(size=(6, code.shape[1])))
    x = rng.normal(size=(20, 5))
    best, share, margin = model.predict(x)
    for row, b, s, m in zip(x, best, share, margin):
        bits = [sum(v * w for v, w in zip(row, model.weights[:-1, j])) + model.weights[-1, j] for j in range(code.shape[1])]
        loss = [sum(math.log(1 + math.exp(-c * z)) for c, z in zip(word, bits)) for word in code]
        order = sorted(range(n), key=loss.__getitem__)
        assert b == order[0] and math.isclose(s, math.exp(-loss[b]) / sum(math.exp(-v) for v in loss), rel_tol=1e-9)
        assert m == math.inf if n == 1 else math.isclose(m, loss[order[1]] - loss[b], rel_tol=1e-6, abs_tol=1e-9)


def test_the_sample_of_languages_is_bounded(spark, monkeypatch):
    rows = [(1, f"text number {k}", "en") for k in range(90)] + [(2, "one row", "en")] * 90 + [(k, f"und so weiter {k}", "de") for k in range(3, 60)] + [(99, "rare", "xx")]
    seen = []
    monkeypatch.setattr(langid, "fit", lambda x, langs: seen.append(sorted(langs)))
    langid.train(documents(spark, rows), F.lit(True), per_lang=10, most_langs=2)
    assert set(seen[0]) == {"de", "en"} and seen[0].count("de") == 10 and 1 < seen[0].count("en") <= 10  # equal rows count once


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9, 40])
def test_codewords_are_apart(n):
    code = langid.codewords(n)
    apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    assert min(apart) >= (1 if n < 3 else 2 if n == 3 else 3) and (np.abs(code.sum(axis=0)) < n).all()


def test_gram_counts_do_not_depend_on_the_batch():
    texts = ["one text", "", None, "zwei Texte äöü", "x"]
    together = langid.gram_counts(pa.array(texts))
    for k, t in enumerate(texts):
        assert np.allclose(together[k], langid.gram_counts(pa.array([t], pa.string()))[0])


# -- toxicity -------------------------------------------------------------------------------------------------------


def brute_marginals(emit, trans, start):
    total = np.zeros(len(emit) + 1)
    for states in itertools.product((0, 1), repeat=len(emit)):
        w = np.exp(start[states[0]] + sum(e * s for e, s in zip(emit, states)) + sum(trans[a, b] for a, b in zip(states, states[1:])))
        total[:-1] += w * np.array(states)
        total[-1] += w
    return total[:-1] / total[-1]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=12), st.integers(0, 10_000))
def test_marginals_are_exact(lengths, seed):
    rng = np.random.default_rng(seed)
    trans, start = rng.normal(size=(2, 2)) * 2, rng.normal(size=2)
    emits = [rng.normal(size=n) * 3 for n in lengths]
    first = np.concatenate([[True] + [False] * (n - 1) for n in lengths])
    got = toxicity.marginals(np.concatenate(emits), trans, start, first)
    assert np.allclose(got, np.concatenate([brute_marginals(e, trans, start) for e in emits]), atol=1e-9)


def test_likelihood_and_gradient_equal_brute_force(monkeypatch):
    monkeypatch.setattr(toxicity, "BUCKETS", 40)
    sequences, states = [["ab", "cd", "ab"], ["cd"], ["xy", "ab"]], [[0, 1, 1], [0], [1, 0]]
    data, w = toxicity.Sequences(sequences, states), np.random.default_rng(5).normal(size=46)

    def brute(w):
        trans, start, total = w[40:44].reshape(2, 2), w[44:], 0.0
        for words, gold in zip(sequences, states):
            emit = [sum(w[k] for k in toxicity.token_features(x)) for x in words]
            score = lambda z: start[z[0]] + sum(e * s for e, s in zip(emit, z)) + sum(trans[a, b] for a, b in zip(z, z[1:]))  # noqa: B023, E731
            total += math.log(sum(math.exp(score(z)) for z in itertools.product((0, 1), repeat=len(words)))) - score(gold)
        return total

    loss, grad = data.loss(w)
    assert math.isclose(loss, brute(w))
    for k in range(46):
        step = np.eye(46)[k] * 1e-5
        assert math.isclose(grad[k], (brute(w + step) - brute(w - step)) / 2e-5, abs_tol=1e-6)


def test_scores_and_spans_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    chain = toxicity.Chain(rng.normal(size=toxicity.BUCKETS), rng.normal(size=(2, 2)), rng.normal(size=2), np.array([-1.0, 0.7, 0.4]))
    texts = ["One idiot, two; idiot!", "x", "", None, "a b c d e f g", "Ein Satz über nichts"]
    for r in toxicity.score(documents(spark, list(enumerate(texts))), chain).collect():
        text = texts[r["doc_id"]] or ""
        found = list(re.finditer(r"[^\W_]+", text.lower()))
        p = brute_marginals([chain.emission(m[0]) for m in found], chain.trans, chain.start) if found else np.zeros(0)
        top, many = (math.log(p.max() / (1 - p.max())), math.log1p(p.sum())) if found else (-20.0, 0.0)
        assert math.isclose(r["score"], 1 / (1 + math.exp(-(-1.0 + 0.7 * top + 0.4 * many))), rel_tol=1e-6)
        assert r["predicted"] == (r["score"] >= 0.5)
        assert [(s["start"], s["end"]) for s in r["spans"]] == [m.span() for m, q in zip(found, p) if q >= 0.5]


def test_repeated_ids_do_not_enlarge_the_toxic_sample(spark):
    rows = [(1, f"text {k}") for k in range(70)] + [(k, f"other {k}") for k in range(2, 40)] + [(1, "same")] * 40
    labels = spark.createDataFrame([(1, 1)] * 9 + [(k, k % 2) for k in range(2, 40)] + [(5, 7)], "doc_id long, toxic int")
    got = toxicity.labelled(documents(spark, rows), labels, F.lit(True), 11).groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in got} == {0: 11, 1: 11}


def test_chain_learns_context_and_words():
    rnd = random.Random(3)
    seqs = [[rnd.choice(["good", "fine", "idiot", "idiotic", "tree"]) for _ in range(10)] for _ in range(60)]
    chain = toxicity.fit_chain(seqs, [[int(w.startswith("idiot")) for w in s] for s in seqs])
    p, starts = toxicity.Tagger(chain).tag(["a good idiot", None, "tree"])
    assert p[2] > 0.9 and p[1] < 0.1 and starts.tolist() == [0, 3, 3, 4]


def test_toxicity(spark):
    rnd = random.Random(4)
    rows, labels = [], []
    for k in range(700):
        words = lines_of(rnd, rnd.randint(10, 60)).split()
        toxic = k % 4 == 0
        for _ in range(rnd.randint(1, 4) if toxic else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(["idiot", "scumbag", "Lowei" + rnd.choice(["s", "en", "ist", "a"])]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    docs, held = documents(spark, rows), queries.is_bucket(5, 0)
    chain = toxicity.train(docs, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int"), ~held)
    got = {r["doc_id"]: r for r in toxicity.score(docs, chain).collect()}
    assert np.mean([got[k]["predicted"] == y for k, y in labels]) > 0.97
    texts = dict(rows)
    marked = {texts[k][s["start"] : s["end"]].lower() for k, y in labels if y for s in got[k]["spans"]}
    assert {"idiot", "scumbag"} <= marked
    odd = toxicity.score(documents(spark, [*ODD, (60, "İİ İdiot idiot!")]), chain).collect()
    assert len(odd) == len(ODD) + 1 and all(0 <= r["score"] <= 1 for r in odd)
    (spans,) = [r["spans"] for r in odd if r["doc_id"] == 60]
    assert "idiot" in ["İİ İdiot idiot!"[s["start"] : s["end"]] for s in spans]
    assert toxicity.score(documents(spark, []), chain).count() == 0
    clean_only = spark.createDataFrame([(k, 0) for k in range(50)], "doc_id long, toxic int")
    assert toxicity.train(docs, clean_only, ~held) is None and {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}
