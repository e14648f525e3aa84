"""Languages beyond the fixed and the most frequent ones."""

import random

from plenum.llm import langid, quality

SMALL = "/root/testdata/sf0.001"
POLISH = "w i na z że nie się do jest to o jak ale po za od przez przy dla oraz".split()


def test_quality_of_a_sixth_language(spark):
    """Clean texts of a language without a fixed list stay, those of a null language aren't judged by words."""
    draw = random.Random(3)
    made = lambda: " ".join(draw.choice(POLISH) if draw.random() < 0.4 else "".join(draw.choice("aąbcćdeęiklłmnoóprsśtuwyzż") for _ in range(7)) for _ in range(150))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    known = {r.doc_id: tuple(r) for r in quality.judge_quality(docs).collect()}
    rows = [(-i, made(), "pl") for i in range(1, 21)] + [(-30, made(), None), (-31, "brak " * 3, "pl")]
    got = {r.doc_id: r for r in quality.judge_quality(docs.unionByName(spark.createDataFrame(rows, docs.schema))).collect()}
    assert all(got[-i].kept and got[-i].word_distance < 0.3 for i in range(1, 21))
    assert got[-30].kept and not got[-31].kept
    assert len(got) == len(known) + len(rows)
    assert all(tuple(got[i])[:7] == r[:7] for i, r in known.items())
    assert all(abs((got[i].word_distance or 0) - (r[-1] or 0)) < 1e-9 for i, r in known.items())


def test_every_language_is_learned(spark):
    """More languages than a group holds, the last of them the rarest: all are answered, as one group would."""
    draw, rows = random.Random(5), []
    for k in range(langid.GROUP + 6):
        words = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(25)]
        for n in range(14 if k < langid.GROUP else 10):
            rows.append((len(rows), " ".join(draw.choice(words) for _ in range(60)), f"x{k:03d}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(docs).collect()}
    assert [i for i, _, lang in rows if got[i].lang_pred != lang] == []
    contents = {k: v for group in langid.learn(docs) for k, v in group.items()}
    assert len(contents) == langid.GROUP + 6
    whole = langid.Classifier(contents)
    for i, t, _ in rows[:20] + rows[-20:]:
        lang, score, accepted = langid.judged(whole.measure(t))
        assert (got[i].lang_pred, got[i].accepted) == (lang, accepted) and abs(got[i].score - score) < 1e-9
