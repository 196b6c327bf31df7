"""Held-out accuracy of the learned operators, and what they do with odd texts."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stocklens.llm import decision_list, labelled, quality_net, queries, toxicity

LARGER = "/root/testdata/sf0.01"


def held_out(spark, query, label):
    scored = query(spark, LARGER)
    known = queries.table(spark, LARGER, "labels").select("doc_id", F.col(label).alias("label"))
    return scored.join(known, "doc_id").filter("held_out").toPandas()


def test_quality_accuracy(spark):
    rows = held_out(spark, queries.quality_score, "quality")
    assert len(rows) > 80
    assert ((rows["score"] >= 0.5).astype(int) == rows["predicted"]).all()
    assert (rows["predicted"] == rows["label"]).mean() > 0.95


def test_toxicity_accuracy(spark):
    rows = held_out(spark, queries.toxic_score, "toxic")
    toxic = rows[rows["label"] == 1]
    clean = rows[rows["label"] == 0]
    assert toxic["score"].mean() > 0.5 and toxic["predicted"].mean() > 0.5
    assert clean["predicted"].mean() < 0.1


def test_scores_of_odd_texts(spark, odd_docs, no_docs):
    network = quality_net.fitted(["a b c | d | e"] * 9 + ["plain words here"] * 9, [0] * 9 + [1] * 9)
    rows = quality_net.scored(odd_docs, network).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality_net.scored(no_docs, network).count() == 0
    model = toxicity.fitted(["you idiot"] * 9 + ["plain words here"] * 9, [1] * 9 + [0] * 9, 0.5)
    rows = toxicity.scored(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.scored(no_docs, model).count() == 0
    left = toxicity.without_toxic(odd_docs, model, 2.0)
    assert left.columns == odd_docs.columns and left.count() == odd_docs.count()


@pytest.mark.parametrize("labels, score", [([1, 1, 1], 0.99), ([], 0.5)])
def test_one_label_or_none(labels, score):
    network = quality_net.fitted(["some text"] * len(labels), labels)
    assert quality_net.score(["any"], network)[0] == pytest.approx(score, abs=0.01)
    model = toxicity.fitted(["some text"] * len(labels), labels, float(bool(labels)))
    assert toxicity.score(["any"], model, {})[0] == float(bool(labels))


def test_network_sees_the_whole_text(monkeypatch):
    clean, junk = "plain words of a text " * 40, "a | b | c | d | e | f | g "
    rng = np.random.default_rng(1)
    texts = [clean + (junk * 30 if i % 2 else "") + "end " * int(rng.integers(1, 9)) for i in range(120)]
    network = quality_net.fitted(texts, [1 - i % 2 for i in range(120)], epochs=6)
    late = clean * 30 + junk * 300
    assert quality_net.score([clean * 30], network)[0] > 0.5 > quality_net.score([late], network)[0]
    whole = quality_net.score([late, clean], network)
    alone = [quality_net.score([t], network)[0] for t in (late, clean)]
    assert whole == pytest.approx(alone, abs=1e-6)  # whatever stands next to a text in a batch
    monkeypatch.setattr(quality_net, "_GROUP", 1 << 13)  # in parts, the same
    assert quality_net.score([late, clean], network) == pytest.approx(whole, abs=1e-6)


def test_disguised_words_are_restored():
    words = "idiot worthless pathetic stupid scum moron loser trash the of and thing letter hello good".split()
    texts = [" ".join(words)] * 12 + ["the of and thing letter hello good"] * 12
    model = toxicity.fitted(texts, [1] * 12 + [0] * 12, 0.5)
    disguised = {
        "1d10t": "idiot", "i d i o t": "idiot", "idiiiot": "idiot", "w0rthl3ss": "worthless", "p@thet1c": "pathetic",
        "$tupid": "stupid", "s.c.u.m": "scum", "mooorooon": "moron", "l-o-s-e-r": "loser", "hello": "hello",
        "letter": "letter", "1 d 1 0 t": "idiot", "i  d  i  o  t": "idiot", "i. d. i. o. t": "idiot",
        "s - c - u - m": "scum", "m\to\tr\to\tn": "moron", "l/o/s/e/r": "loser", "1 . d . 1 . 0 . t": "idiot",
    }
    texts = [f"the {d} of" for d in disguised]
    for (d, word), read in zip(disguised.items(), toxicity.restored(texts, model.language, {}), strict=True):
        assert word in read.split(), (d, read)
    scores = toxicity.score(["w0rthl3ss 1d10t", "worthless idiot", "the hello"], model, {})
    assert scores[0] == pytest.approx(scores[1]) and scores[0] > 0.5 > scores[2]


def test_sample_is_bounded_and_sees_all_of_long_texts(spark):
    rows = [(1, "b"), (1, "a"), *[(1, "c")] * 50, (2, None), (3, "x" * 500 + "y" * 500), (4, "not chosen")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3)], "doc_id bigint, label int")
    got = {r["doc_id"]: (r["text"], r["label"]) for r in labelled.sample_of(docs, labels, 10, 160).collect()}
    assert got == {1: ("a", 1), 2: (None, 0), 3: ("x" * 80 + "y" * 80, 1)}
    assert labelled.sample_of(docs, labels, 2, 160).count() == 2


def all_readings(token):
    """Every way through a token's lattice with its cost."""
    ways = [("", 0.0)]
    for step in toxicity._lattice(token):
        ways = [(text + reading, cost + more) for text, cost in ways for reading, more in step]
    return ways


def path_score(text, model):
    """Log probability of a reading's letters, word by word; signs end a word."""
    total = 0.0
    for word in re.split(rf"[ {toxicity._SIGNS}]", text):
        if word:
            edged = ["", "", *word, ""]
            total += sum(model.after(*edged[i : i + 3]) for i in range(len(word) + 1))
    return total


def test_the_likeliest_of_all_readings_is_taken():
    """Brute force over short lattices of signs, gaps and repetition."""
    words = "idiot worthless pathetic stupid scum moron loser trash the of and thing letter hello good".split()
    model = toxicity.language_model([" ".join(words)] * 20)
    tokens = ["1d10t", "$tup1d", "s.c.u.m", "i  d  i  o  t", "mooorooon", "7r45h", "a55", "mp3", "1 d 1", "l/o/s/e/r", "thiiing!"]
    for token in tokens:
        best = max(path_score(text, model) - cost for text, cost in all_readings(token))
        read = toxicity.restored_word(token, model)
        found = [path_score(text, model) - cost for text, cost in all_readings(token) if text == read]
        assert max(found) == pytest.approx(best), token


def test_signs_can_be_read_in_a_corpus_of_another_script():
    cyrillic = "".join(chr(c) for c in range(0x430, 0x500))
    model = toxicity.language_model([f"{cyrillic} " * 50 + "the worthless idiot " * 3])
    assert {c for readings in toxicity.LOOKS_LIKE.values() for c in readings} <= set(model.letters)
    assert len(model.letters) < toxicity._LETTERS and "а" in model.letters


def brute_numbers(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_rule_counts(spark, data, texts):
    rows = queries.quality_rules(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_numbers(texts[r["doc_id"]])
        assert tuple(r[c] for c in decision_list.COUNTS) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_rules_find_planted_thresholds():
    rng = np.random.default_rng(2)
    values = {"n_words": rng.uniform(0, 100, 3_000), "symbol_share": rng.uniform(0, 1, 3_000)}
    bad = (values["symbol_share"] > 0.7) & (values["n_words"] > 40)
    rules = decision_list.learned(values, 1 - bad.astype(int))
    covered = np.zeros(3_000, bool)
    for rule in rules:
        covered |= decision_list._covered(rule, values)
    assert (covered == bad).mean() > 0.98
    assert decision_list.learned(values, np.ones(3_000)) == []


def test_rules_as_an_expression(spark, odd_docs, no_docs):
    rules = [
        (decision_list.Condition("n_words", True, 10.0), decision_list.Condition("distinct_share", False, 0.1)),
        (decision_list.Condition("symbol_share", True, 0.5),),
    ]
    rows = decision_list.judged(odd_docs, rules)
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in rows.collect()}
    assert got[3] == (True, False) and got[1] == (True, False)
    alone = decision_list.statistics(odd_docs).withColumn("verdict", decision_list.expression(rules))
    assert {r["doc_id"]: r["verdict"] for r in alone.collect()}[3] is False
    assert decision_list.judged(no_docs, []).count() == 0


def test_rules_on_held_out_rows(spark):
    docs, labels = queries.table(spark, LARGER, "documents"), queries.table(spark, LARGER, "labels")
    seen = labels.filter(F.crc32(F.col("doc_id").cast("string")) % 2 == 0)
    rules = decision_list.fit(docs, seen)
    unseen = labels.join(seen, "doc_id", "left_anti").select("doc_id", "quality")
    rows = decision_list.judged(docs, rules).join(unseen, "doc_id").toPandas()
    good, bad = rows[rows["quality"] == 1], rows[rows["quality"] == 0]
    assert (good["kept"] | good["base_failed"]).mean() > 0.95 and bad["kept"].mean() < 0.2


def restoring_model():
    words = "idiot worthless pathetic stupid scum moron loser trash ass shit you are a the of and thing letter hello good"
    return toxicity.fitted([words] * 12 + ["the of and thing letter hello good"] * 12, [1] * 12 + [0] * 12, 0.5)


@pytest.mark.parametrize("gap", [" ", ".", "*"])
def test_stretches_of_any_length_are_restored(gap):
    model = restoring_model()
    sentence = "you are a worthless stupid pathetic idiot and a loser " * 5
    spread = gap.join(sentence.replace(" ", ""))
    read, stretched, thrice = toxicity.restored(
        [f"the {spread} of", f"the idi{'o' * 200}t of", f"the {'s' * 40}tup{'i' * 40}d"], model.language, {}
    )
    assert "worthless" in read and "stupid" in read and "idiot" in stretched.split() and "stupid" in thrice.split()
    assert toxicity.score([f"the {spread} of"], model, {})[0] > 0.5
    key = "9f8a6c1e0b7d5a3f2e4c" * 5
    assert toxicity.restored([key], model.language, {}) == [key]


def test_signs_at_the_end_and_words_of_signs_are_restored():
    model = restoring_model()
    disguised = {
        "a55": "ass", "a$$": "ass", "@55": "ass", "@$$": "ass", "sh17": "shit", "5h17": "shit", "5h!7": "shit",
        "idio7": "idiot", "7r45h": "trash", "tr@$h": "trash", "mp3": "mp3", "v2": "v2", "2024": "2024",
        "$100": "$100", "hello!": "hello!", "!!!": "!!!",
    }
    for (d, word), read in zip(
        disguised.items(), toxicity.restored([f"the {d} of" for d in disguised], model.language, {}), strict=True
    ):
        assert word in read.split(), (d, read)


def test_letters_are_counted_over_all_documents(spark, odd_docs, no_docs):
    docs = spark.createDataFrame([(i, "you idiot" if i % 2 else "plain words") for i in range(40)], "doc_id int, text string")
    more = docs.unionByName(spark.createDataFrame([(i, "жизнь schtroumpf " * 9) for i in range(40, 80)], docs.schema))
    labels = docs.selectExpr("doc_id", "doc_id % 2 as toxic")
    sample = {r["text"] for r in docs.collect()}
    fitted = toxicity.fit(more, labels)
    assert "ж" not in " ".join(sample) and fitted.language.letters["ж"] > 0
    assert toxicity.restored(["the schtr0umpf"], fitted.language, {}) == ["the schtroumpf"]
    texts = [r["text"] or "" for r in odd_docs.collect()]
    whole, counted = toxicity.language_model(texts), toxicity.counted_language(odd_docs.repartition(3))
    assert whole.letters == counted.letters and np.allclose(whole.log_odds, counted.log_odds)
    assert toxicity.counted_language(no_docs).letters == {}
