"""Texts of languages that were not learned, and nonsense, go; clean ones stay."""

import random
import string

from showerlake.llm import op09_language

WORDS = {
    "en": "the council decided this morning that trees around square would not be cut before next spring because people who live there had asked for it with great patience and many letters",
    "de": "der gemeinderat hat heute morgen beschlossen dass die bäume auf dem platz nicht vor nächstem frühjahr gefällt werden weil viele bewohner darum gebeten haben und lange briefe schrieben",
    "fr": "le conseil municipal a décidé ce matin que les arbres de la place ne seraient pas coupés avant le printemps prochain parce que beaucoup habitants avaient écrit pour demander cela",
}


def test_stage_rejects_what_was_not_learned(spark):
    rng = random.Random(4)
    say = lambda words, n: " ".join(rng.choice(words.split()) for _ in range(n))
    clean = [(i, say(WORDS[g], rng.randrange(20, 200)), g) for i in range(240) for g in [sorted(WORDS)[i % 3]]]
    strange = [
        "dzisiaj rano rada miasta postanowiła że drzewa na placu nie zostaną wycięte przed następną wiosną ponieważ mieszkańcy o to poprosili",
        "сегодня утром городской совет решил что деревья на площади не будут вырублены до следующей весны",
        "".join(rng.choice(string.ascii_lowercase + "   ") for _ in range(200)),
        "xq zzkq vvwx qqj wkkz pqx",
    ]
    learned = spark.createDataFrame(clean, "doc_id long, text string, lang string")
    odd = [(1000 + i, text, None) for i, text in enumerate(strange)]
    kept = {r["doc_id"] for r in op09_language.stage(spark, learned.union(spark.createDataFrame(odd, learned.schema)), "").collect()}
    assert not kept & {o[0] for o in odd}
    assert kept == {c[0] for c in clean}
