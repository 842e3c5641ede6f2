import math
import random
from collections import Counter

import numpy as np
import pytest
from probelake.llm import reading
from probelake.llm.prose import message_of, prose_words

EASY = "I put the bug back. That was why the lock broke. We keep the word. The old game is gone. "
HARD = "Probabilistic representation presupposes idempotency. Hierarchical decomposition facilitates orchestration notwithstanding irreconcilable divergence. "
MEDIUM = "Several people reported that the service takes more than a minute to open a large message after the recent update. "
DIFF = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n-Hierarchical decomposition facilitates\n"


def git(body):
    return "commit 0123abc\nAuthor: A <a@b.c>\nDate:   today\n\n    subject line\n\n" + "\n".join("    " + x for x in body.split("\n")) + "\n\n" + DIFF


@pytest.fixture(scope="module")
def anchors(spark):
    return spark.createDataFrame([(1, "easy", EASY), (2, "medium", MEDIUM), (3, "hard", HARD), (4, "odd", HARD), (5, "easy", None)], "anchor_id bigint, band string, text string")


@pytest.fixture(scope="module")
def documents(spark):
    texts = [git(EASY * 4), git(HARD * 6), git(MEDIUM * 4), git("short"), None, "", "   ", git("zzz qqq"), git(EASY * 4)]
    return spark.createDataFrame([(i, t, None if i == 8 else "en", "clash", 0.5) for i, t in enumerate(texts)] + [(0, texts[0], "en", "clash", 0.5)], "doc_id bigint, text string, lang string, words string, level double")


@pytest.mark.parametrize("most_words", [10**6, 0])
def test_levels_and_bands(documents, anchors, most_words):
    got = {}
    for r in reading.reading_levels(documents, anchors, most_words=most_words).collect():
        got.setdefault(r.doc_id, r)
    assert [got[i].band for i in (0, 2, 1)] == ["easy", "medium", "hard"]
    assert got[0].level < got[2].level < got[1].level
    assert got[4].level is None and got[5].band is None and got[6].level is None
    assert got[3].prose == 1 and got[7].level is not None


def test_both_ways_agree(documents, anchors):
    a, b = ({(r.doc_id, round(r.level, 6) if r.level is not None else None) for r in reading.reading_levels(documents, anchors, most_words=n).collect()} for n in (10**6, 0))
    assert a == b


@pytest.mark.parametrize("most_words", [10**6, 0])
def test_levels_are_at_rest(spark, documents, anchors, most_words):
    rng = random.Random(6)
    words = EASY.split() + HARD.split() + MEDIUM.split() + [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(60)]
    docs = spark.createDataFrame([(i, git(" ".join(rng.choice(words[max(0, i - 15) : i + 15]) for _ in range(12)))) for i in range(90)], "doc_id bigint, text string")
    sets = [set(r.words) for r in reading.word_sets(docs, "doc_id", "text", []).orderBy("doc_id").collect()]
    graded = [(lv, set(prose_words(t.split("\n")))) for lv, t in ((0.0, EASY), (0.5, MEDIUM), (1.0, HARD))]
    df = Counter(w for s in [*sets, *(g for _, g in graded)] for w in s)
    names = [w for w in df if df[w] > 1]
    at, weight = {w: i for i, w in enumerate(names)}, {w: math.log(1 + (len(sets) + 3) / df[w]) for w in names}
    a, b = np.zeros((len(names), len(names))), np.zeros(len(names))
    hits, count, fixed = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names))
    for s in sets:
        mine = [w for w in s if w in at]
        total = sum(weight[w] for w in mine)
        for w in mine:
            hits[at[w]] += 1
            for v in mine:
                a[at[w], at[v]] += weight[v] / total
    for lv, s in graded:
        for w in s & set(names):
            count[at[w]] += 1
            fixed[at[w]] += lv
    hold = np.where(count > 0, np.maximum(count, reading.GRIP * hits) / np.maximum(count, 1), 0)
    down = hits * (1 + reading.GROUND) + hold * count
    x = np.linalg.solve(np.eye(len(names)) - a / down[:, None], (hold * fixed + reading.GROUND * reading.MIDDLE * hits) / down)
    r = reading.read(docs, anchors, still=1e-5, most_words=most_words)
    assert r.rounds > 5 and r.residue <= 1e-5
    for got in r.levels.collect():
        mine = [w for w in sets[got.doc_id] if w in at]
        want = sum(weight[w] * x[at[w]] for w in mine) / sum(weight[w] for w in mine)
        assert abs(got.level - want) <= 1e-5


def test_levels_that_do_not_rest_raise(documents, anchors):
    with pytest.raises(RuntimeError):
        reading.read(documents, anchors, rounds=2, still=1e-9)


def test_found(documents, anchors):
    got = [(r.doc_id, r.band) for r in reading.commit_bands(documents, anchors).collect()]
    assert sorted(got) == [(0, "easy"), (0, "easy"), (1, "hard"), (2, "medium")]


def test_empty(documents, anchors):
    assert reading.reading_levels(documents.limit(0), anchors).count() == 0
    assert all(r.level is None for r in reading.reading_levels(documents, anchors.limit(0)).collect())


BODY = "First line of prose here.\n\n* a listed sentence\nSigned-off-by: A <a@b.c>\nFixes: 12ab (\"x\")"
FORMS = [
    "commit ab12\nMerge: a b\nAuthor: x\n\n    subj\n\n" + "\n".join("    " + x for x in BODY.split("\n")) + "\n\n" + DIFF,
    ("commit ab12\nAuthor: x\n\n    subj\n\n" + "\n".join("    " + x for x in BODY.split("\n")) + "\n\n" + DIFF).replace("\n", "\r\n"),
    "From ab12 Mon Sep 17 00:00:00 2001\nFrom: x\nDate: y\nSubject: [PATCH] subj\n\n" + BODY + "\n---\n 1 file changed\n\n" + DIFF,
    "------\nr1 | x | today | 2 lines\nChanged paths:\n   M /trunk/a.c\n\nsubj\n" + BODY + "\n\nIndex: a.c\n====\n",
    "changeset: 1:ab\nuser: x\ndescription:\nsubj\n" + BODY + "\n\n\n" + DIFF,
    '{"sha": "ab", "message": "subj\\n\\n' + BODY.replace("\n", "\\n").replace('"', '\\"') + '", "patch": "diff"}',
]


@pytest.mark.parametrize("text", FORMS)
def test_every_form_gives_the_prose(text):
    subject, body = message_of(text)
    assert subject.endswith("subj")
    assert prose_words(body) == "first line of prose here a listed sentence".split()


def test_prose_leaves_code_out():
    assert prose_words(["see <user_name> and `x y` at https://a.b/c (see #12), call f_x() or fooBar.", "Conflicts:", "    src/a.c", "", "src/b/c.py", "done"]) == "see and at call or done".split()
