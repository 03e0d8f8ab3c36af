"""Language identification: held-out accuracy, rejection, and defined cases."""

import random

import numpy as np

from twinledger.llm import langid
from twinledger.llm.scratch import reachable

SCHEMA = "doc_id long, text string, lang string, score string"
WORDS = {
    "en": "the of and to in is that with which there shall being other through thing".split(),
    "de": "der die und nicht eine schön über auch wieder Straße können werden zwischen ich".split(),
    "fr": "le les dans être où déjà même cette votre toujours quelque après nous ainsi".split(),
}


def rows(seed, n=240):
    rng = random.Random(seed)
    made = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        made.append((i, " ".join(rng.choices(WORDS[lang], k=rng.choice([3, 8, 40, 200]))).capitalize() + ".", lang))
    return made


def test_held_out_texts_and_defined_cases(spark):
    made = rows(1)
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "12 34 ...", "de"), (1003, "東京特許許可局 " * 30, None), (None, made[0][1], None),
           (1004, made[0][1] * 2000, None), (0, made[0][1], made[0][2])]
    docs = reachable(spark).createDataFrame([(*r, "x") for r in made + odd], SCHEMA).repartition(3)
    train = docs.filter(~langid.held_out(docs.doc_id))
    found = langid.identify(docs.drop("lang"), langid.train(train, per_language=50)).collect()
    assert len(found) == len(made) + len(odd)
    by_id = {r.doc_id: r for r in found}
    right = [by_id[i].lang_pred == lang for i, _, lang in made]
    assert sum(right) >= 0.97 * len(right)
    assert not any(by_id[i].rejected for i, _, _ in made) and all(0 < by_id[i].score <= 1 for i, _, _ in made)
    for i in (1000, 1001, 1002):
        assert by_id[i].lang_pred == "und" and by_id[i].score == 0 and by_id[i].rejected
    assert by_id[1003].rejected and by_id[1004].lang_pred == made[0][2] == by_id[None].lang_pred


def test_prediction_does_not_depend_on_the_batch(spark):
    made = rows(2, 60)
    docs = reachable(spark).createDataFrame([(*r, "x") for r in made], SCHEMA)
    model = langid.train(docs)
    texts = [t for _, t, _ in made]
    together = model.predict(texts)
    for i, t in enumerate(texts):
        label, score, _ = model.predict([t])
        assert label[0] == together[0][i] and np.isclose(score[0], together[1][i], atol=1e-6)


def test_no_labels_and_no_rows(spark):
    docs = reachable(spark).createDataFrame([(1, "some text", None, None)], SCHEMA)
    found = langid.identify(docs, langid.train(docs)).collect()
    assert found[0].lang_pred == "und" and found[0].rejected
    none = spark.createDataFrame([], SCHEMA)
    assert langid.identify(none, langid.train(none)).count() == 0


def test_against_plain_nearest_centroid(spark):
    """Every prediction again, text by text, from the model's centroids, weights and limits."""
    made = [t for _, t, _ in rows(3, 80)] + [None, "", "½ ² Ⅷ 12", "½ a", "_", "東京特許 " * 9, "x", "der", "der der " * 300, "ÀÉ ß"]
    docs = reachable(spark).createDataFrame([(*r, "x") for r in rows(4)], SCHEMA)
    model = langid.train(docs, per_language=40)
    assert len(model.labels) == 12
    found = langid.identify(spark.createDataFrame([(i, t, None, "x") for i, t in enumerate(made)], SCHEMA).repartition(3), model)
    got = {r.doc_id: (r.lang_pred, r.score, r.rejected) for r in found.collect()}
    for i, text in enumerate(made):
        if not any(c.isalpha() for c in text or ""):
            assert got[i] == ("und", 0.0, True)
            continue
        padded = " " + text.lower() + " "
        folded = [c if c in b"abcdefghijklmnopqrstuvwxyz" or c >= 128 else 32 for c in padded.encode()]
        counts = {}
        for a, b, c in zip(folded, folded[1:], folded[2:]):
            if (a, b, c) != (32, 32, 32):
                place = ((a << 16 | b << 8 | c) * 2654435761 % (1 << 32)) >> 20
                counts[place] = counts.get(place, 0) + 1
        weights = {p: np.log1p(n) * float(model.idf[p]) for p, n in counts.items()}
        norm = np.sqrt(sum(w * w for w in weights.values())) or 1.0
        cosines = [sum(w * float(centre[p]) for p, w in weights.items()) / norm for centre in model.centroids]
        best = int(np.argmax(cosines))
        label, score, rejected = got[i]
        assert np.isclose(score, min(1.0, max(0.0, cosines[best])), atol=1e-5)
        # Another label only where two centroids are equally near.
        assert label == model.labels[best] or np.isclose(max(c for c, at in zip(cosines, model.labels) if at == label), cosines[best], atol=1e-6)
        limit = np.sqrt(min(1.0, len(counts) / 200)) * model.limits[label]
        assert rejected == (score < limit) or np.isclose(score, limit, atol=1e-6)
