"""Language identification and toxicity."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmill.llm import language_id, toxicity
from tests.llm import cases

SF = "/root/testdata/sf0.01"


def distance(a, b):
    """Insertions, deletions, substitutions and swaps of neighbours."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, new[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                best = min(best, rows[-2][j - 2] + 1)
            new.append(best)
        rows.append(new)
    return rows[-1][-1]


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 6):
        x = rng.normal(0, 4, (n, 3))
        cost = lambda p, x=x: sum(x[i, l] for i, l in enumerate(p)) - 5 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        best = max(itertools.product(range(3), repeat=n), key=cost)
        assert abs(cost(tuple(language_id.viterbi(x, 5.0))) - cost(best)) < 1e-9


def plain_label(text, model):
    """label() of one text with words by Viterbi alone."""
    bucket, _, first, *_ = language_id.trigrams([text])
    path = language_id.viterbi(np.add.reduceat(model.scores[bucket], first, axis=0).astype(float))
    share = np.bincount(path, weights=np.diff(np.append(first, len(bucket))), minlength=len(model.languages))
    return model.languages[share.argmax()], float(share.max() / share.sum()), 1 + int(np.count_nonzero(np.diff(path)))


def test_shortcut_gives_the_path_of_viterbi():
    scripts = np.ones((len(language_id.SCRIPT_NAMES), 3), bool)
    model = language_id.Model(["a", "b", "c"], np.zeros((language_id.BUCKETS, 3), np.float32), scripts)
    (p, q), *_ = language_id.trigrams(["x y"])
    model.scores[p], model.scores[q] = [0, -9, -4], [-9, 0, -4]
    text = "x x x y y y"  # c is best as a whole, and loses 12 = 0.86 SWITCH in each half
    assert plain_label(text, model) == ("a", 0.5, 2)
    assert language_id.label([text, "x x"], model) == [("a", 0.5, 2), ("a", 1.0, 1)]
    r, rng = random.Random(8), np.random.default_rng(8)
    model.scores = rng.normal(0, 2.5, model.scores.shape).astype(np.float32)
    texts = [" ".join("".join(r.choice("etaoins") for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 25))) for _ in range(3000)]
    fast, slow = language_id.label(texts, model), [plain_label(t, model) for t in texts]
    assert fast == slow and 300 < sum(n > 1 for _, _, n in slow) < 2700


@pytest.fixture(scope="module")
def languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return language_id.fit(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))


def test_whole_texts_without_a_switch_are_left_to_the_shortcut(spark, languages):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text RLIKE '[a-z]'").collect()]
    fast = language_id.label(texts, languages)
    slow = []
    for t in texts:
        bucket, script, first, *_ = language_id.trigrams([t])
        scores = np.add.reduceat(languages.scores[bucket], first, axis=0).astype(float)
        path = language_id.viterbi(scores)
        share = np.bincount(path, weights=np.diff(np.append(first, len(bucket))))
        slow.append(languages.languages[share.argmax()])
    assert [f[0] for f in fast] == slow


def test_held_out_languages(spark):
    got = language_id.op1_language_id(spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = got.collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)


def test_mixed_text_is_split_into_spans(spark, languages):
    by = {r["lang"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) > 800").collect()}
    a, b = by["en"][:700], by["de"][:300]
    lang, share, spans = language_id.label([a + " " + b], languages)[0]
    assert lang == "en" and spans >= 2 and 0.5 < share < 0.9
    found = language_id.label([f"İ! {a} {b}"], languages, spans=True)[0][3]
    assert found[0][0] == 0 and found[-1][1] >= len(a) + len(b) - 5 and {x for _, _, x in found} >= {"en", "de"}
    assert all(x[1] <= y[0] and x[2] != y[2] for x, y in zip(found, found[1:], strict=False))
    df = spark.createDataFrame([(1, a + " " + b, "x")], "doc_id long, text string, spans string")
    r = language_id.predict(df, languages, spans=True).first()
    assert r["row"]["spans"] == "x" and r["n_spans"] == len(r["spans"]) == spans and r["spans"][0]["lang"] == "en"


def test_two_hundred_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "CELLS", 1 << 22)  # fewer buckets than usual
    r = random.Random(4)
    words = {f"l{k:03}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 7))) for _ in range(40)] for k in range(200)}
    rows = [(i, " ".join(r.choice(words[lang]) for _ in range(60)), lang) for i, lang in enumerate(sorted(words) * 3)]
    df = spark.createDataFrame([*rows, (None, "zzz zzz", "none"), (9999, "zzz", None)], "doc_id long, text string, lang string")
    model = language_id.fit(df)
    assert model.languages == sorted(words) and model.scores.size <= 1 << 22
    got = language_id.predict(df.where("doc_id < 600"), model).collect()
    assert sum(x["row"]["lang"] == x["lang_pred"] for x in got) >= 0.99 * 600
    mixed = " ".join(r.choice(words["l007"]) for _ in range(30)) + " " + " ".join(r.choice(words["l150"]) for _ in range(40))
    assert [x for *_, x in language_id.label([mixed], model, spans=True)[0][3]] == ["l007", "l150"]


def test_language_cases(spark, languages):
    docs = cases.documents(spark).withColumn("lang_pred", F.lit("x"))
    rows = language_id.predict(docs, languages).collect()
    got = {r["row"]["doc_id"]: r["lang_pred"] for r in rows}
    assert all(r["row"]["score"] == 0.5 and r["row"]["lang_pred"] == "x" for r in rows)
    assert len(rows) == len(cases.TEXTS) + 2 and [got[k] for k in range(3)] == ["und"] * 3 and got[5] in languages.languages
    assert language_id.predict(cases.empty(spark), languages).count() == 0
    nothing = language_id.fit(cases.empty(spark))
    assert {r["lang_pred"] for r in language_id.predict(cases.documents(spark), nothing).collect()} == {"und"}


def test_automaton_against_levenshtein():
    terms = ["trash", "pathetic", "moron", "scum", "vequ*", "lowei*", "disgusting"]
    lex = toxicity.Lexicon(terms, [1.0] * 7)
    r = random.Random(3)
    for _ in range(6000):
        term = r.choice(terms)
        w = list(term.rstrip("*"))
        for _ in range(r.randint(0, 3)):
            k, o = r.randint(0, len(w)), r.random()
            if o < 0.25 and k < len(w):
                w[k] = r.choice("tranxpm")
            elif o < 0.5 and len(w) > 1 and k < len(w):
                del w[k]
            elif o < 0.75 and k + 1 < len(w):
                w[k], w[k + 1] = w[k + 1], w[k]
            else:
                w.insert(k, r.choice("tranxpm"))
        word = "".join(w) + (r.choice(["", "an", "ouai", "x" * 15]) if term.endswith("*") else "")
        want = []
        for t in terms:
            ends = range(1, len(word) + 1) if t.endswith("*") else [len(word)]
            least = min(distance(t.rstrip("*"), word[:k]) for k in ends)
            if least <= toxicity.edits_for(t):
                want.append(least)
        got = toxicity.hits([word], lex)[0]
        assert [min(want)] == [h[3] for h in got] if want else not got, word


def test_a_thousand_terms(monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_STATES", 2000)  # so that the automaton starts anew
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(6, 12)))
    terms = sorted({word() for _ in range(1100)})[:1000] + ["b" * 60]
    lex = toxicity.Lexicon(terms, [1.0] * len(terms))
    for _ in range(4):
        chosen = [r.choice(terms) for _ in range(60)]
        wrong = [t[:3] + t[4:] for t in chosen]
        found = toxicity.hits([" ".join(x) for x in (chosen, wrong)], lex)
        assert [terms[h[2]] for h in found[0]] == chosen and all(h[3] == 0 for h in found[0])
        assert [terms[h[2]] for h in found[1]] == chosen


def test_context_separates_quotation_from_abuse():
    lex = toxicity.Lexicon(["moron"], [5.0], {"maron": 0.0, "moran": 3.0})
    value = lambda t: toxicity.evidence(t, toxicity.hits([t], lex)[0], lex)
    quoted, plain, abuse = value('he said the word "moron" is rude'), value("that is a moron there"), value("you moron, you m0ron")
    assert quoted < plain < abuse and value("nothing here") == 0
    assert value("you mor0n") > 0 and value("you mooron") > 0 and value("the maroons") == 0
    assert value("omron") == value("xoron") == value("oron") == 4.0 and value("maron") == 0 and value("moran") == 3.0


def test_shortlist_holds_every_strong_word_once():
    rows = [("stupid", 9, 0), ("stupid*", 9, 0), ("stup*", 9, 0), ("stu*", 9, 0), ("st*", 9, 1), ("mor*", 9, 0), ("moron*", 9, 0)]
    assert toxicity.shortlist(rows, 100, 900) == ["stupid", "moron*", "st*"]
    words = ["".join(p) for p in itertools.product("abcdefghij", repeat=3)]
    many = [(w + s, 40, 0) for w in words for s in ("", "*")] + [("rare", 5, 0), ("rare*", 5, 0)]
    assert toxicity.shortlist(many, 1500, 4500) == [*words, "rare"]


@pytest.fixture(scope="module")
def lexicon(spark):
    learn = lambda df: df.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return toxicity.fit(learn(spark.read.parquet(f"{SF}/documents.parquet")), learn(spark.read.parquet(f"{SF}/labels.parquet")))


def test_planted_misspellings_are_found(lexicon):
    r, words = random.Random(2), [t for t in lexicon.terms if t.isalpha() and t.isascii() and len(t) >= 5]
    found = total = 0
    for w in words * 20:
        k = r.randrange(len(w))
        form = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abcdefghij") + w[k + 1 :], w[:k] + r.choice("abcdefghij") + w[k:], w[: max(k - 1, 0)] + w[max(k - 1, 0) : k + 1][::-1] + w[k + 1 :]])
        low = f"thonea the reand, you {form} of the"
        found += toxicity.evidence(low, toxicity.hits([low], lexicon)[0], lexicon) > 0
        total += 1
    assert len(words) >= 5 and found >= 0.85 * total


def test_held_out_toxicity(spark):
    large = "/root/testdata/sf0.1"  # six of its 97 toxic held-out texts are junk without any word to learn from
    rows = toxicity.op7_toxicity(spark, large).where("held_out").join(spark.read.parquet(f"{large}/labels.parquet"), "doc_id").collect()
    caught = sum(r["predicted"] for r in rows if r["toxic"]) / sum(r["toxic"] for r in rows)
    wrong = sum(r["predicted"] for r in rows if not r["toxic"]) / sum(not r["toxic"] for r in rows)
    assert len(rows) > 500 and caught >= 0.9 and wrong <= 0.02


def test_toxicity_cases(spark, lexicon):
    rows = toxicity.score(cases.documents(spark), lexicon).collect()
    assert len(rows) == len(cases.TEXTS) + 2 and all(0 <= r["score"] < 0.5 and r["predicted"] == 0 for r in rows)
    assert rows[0]["row"]["score"] == 0.5  # the input's own column
    assert toxicity.score(cases.empty(spark), lexicon).count() == 0
    nothing = toxicity.fit(cases.documents(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["predicted"] for r in toxicity.score(cases.documents(spark), nothing).collect()} == {0}
    one_sided = toxicity.fit(cases.documents(spark), spark.createDataFrame([(3, 0), (3, 0), (None, 1), (4, None)], "doc_id long, toxic int"))
    assert {r["predicted"] for r in toxicity.score(cases.documents(spark), one_sided).collect()} == {0}
