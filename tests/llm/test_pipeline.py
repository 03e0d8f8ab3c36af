"""Every stage of the pipeline against a plain version over the rows that its predecessor kept."""

import os
import random
import sys

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(__file__))

import corpus_pipeline  # noqa: E402
from test_filters_and_mix import plain_targets  # noqa: E402
from test_jaccard import plain as plain_groups  # noqa: E402
from test_langid import WORDS  # noqa: E402
from test_repeats import plain as plain_repeats  # noqa: E402

from twinledger.llm import langid  # noqa: E402
from twinledger.llm.scratch import new_path, reachable, written  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(6)
    rows, passage = [], [f"p{i}the" for i in range(60)]
    for i in range(160):
        lang = rng.choice(sorted(WORDS))
        words = [w + rng.choice(["", "", "n", "s", "er", "a"]) for w in rng.choices(WORDS[lang], k=rng.choice([2, 30, 90, 300]))]
        if i % 9 == 0:
            words[len(words) // 2:len(words) // 2] = passage
        rows.append([i, " ".join(words), lang, rng.choice(["a", "b", None, "hot", "hot"]), 0])
    for i in range(160, 200):  # copies, exact and near
        old = rng.choice(rows[:160])
        words = old[1].split(" ")
        if i % 2 and len(words) > 80:
            words[3] = "changed"
        rows.append([i, " ".join(words), old[2], "b", 0])
    rows += [[200, None, None, "a", 0], [201, "", "en", "a", 0], [202, "1 2 3", "en", None, 0], [203, "東京特許許可局、隣の客。" * 40, None, "b", 0]]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s, _ in rows]


def test_stages(spark):
    docs = reachable(spark).createDataFrame(documents(), SCHEMA).repartition(3)
    before = docs.collect()
    names = [name for name, _ in corpus_pipeline.STAGES]
    kept, rows = {}, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, ""), "test-stage")
        kept[name], rows[name] = docs, docs.collect()
        if name != names[-1]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    model = langid.train(spark.createDataFrame(before, SCHEMA))
    labels, _, rejected = model.predict([r.text for r in before])
    assert {(r.doc_id, r.text, r.lang) for r in rows[names[0]]} == {
        (r.doc_id, r.text, lang) for r, lang, out in zip(before, labels, rejected) if not out}
    gone = {r.doc_id for r in before} - {r.doc_id for r in rows[names[0]]}
    assert gone == {200, 201, 202, 203}

    groups = plain_groups([(r.doc_id, r.text) for r in rows[names[0]]])
    assert sorted(r.doc_id for r in rows[names[1]]) == [i for i, _, c in sorted(groups) if i == c]
    assert len(rows[names[1]]) < len(rows[names[0]]) - 30

    plain = {i: (n, removed) for i, n, removed, _ in plain_repeats([(r.doc_id, r.text) for r in rows[names[1]]], 20)}
    text = {r.doc_id: r.text for r in rows[names[1]]}
    for r in rows[names[2]]:
        n, removed = plain[r.doc_id]
        assert len(r.text.split()) == n - removed and r.n_chars == len(r.text)
        assert removed or r.text == text[r.doc_id]
    assert len(rows[names[2]]) == len(rows[names[1]]) and sum(x for _, x in plain.values()) > 300

    sizes, taken = {}, {}
    for r in rows[names[2]]:
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    for r in rows[names[3]]:
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    target = plain_targets(sizes, (5, 2, 1), 3)
    assert all(abs(taken.get(s, 0) - target[s]) <= 0.5 + 1e-6 for s in sizes)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in rows[names[3]])
    filled = {}
    for p in rows[names[4]]:
        filled.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert sum(p.length for p in rows[names[4]]) == expected
    for parts in filled.values():
        starts, lengths = np.array(sorted(parts)).T
        assert (starts == np.cumsum(lengths) - lengths).all() and lengths.sum() <= 1024


def test_run_and_nothing(spark, monkeypatch):
    folder = new_path(spark, "pipeline-test")
    spark.createDataFrame(documents()[:40], SCHEMA).write.parquet(f"{folder}/some/documents.parquet")
    assert corpus_pipeline.run(spark, f"{folder}/some").count() > 30
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    """An unlike text under a repeated doc_id is neither lost nor a bridge between groups."""
    one, two = (" ".join(f"{w}{i}" for i in range(60)) for w in ("a", "b"))
    rows = [(3, one, "en", "a", 0), (7, one + " end", "en", "b", 0), (7, two, "en", "b", 0), (7, two, "en", "a", 0), (9, two + " end", "en", "b", 0),
            (None, two, "en", "b", 0)]
    docs = reachable(spark).createDataFrame(rows, SCHEMA).repartition(3)
    found = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(map(tuple, found), key=repr) == sorted([rows[0], rows[3], rows[5]], key=repr)
