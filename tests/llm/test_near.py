"""The pipeline's near-dedup stage against brute-force Jaccard similarity."""

import random
import re

import pytest

import corpus_pipeline
from gaugewright.llm import simhash


def shingles(text):
    words = re.findall(r"\S+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def kept(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if root[a] != root[b] and near(sets[a], sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return set(root)


@pytest.mark.parametrize("sample", [1, 16])  # every text, or few, set the order of shingles
def test_stage_links_all_pairs_of_similarity_08(spark, monkeypatch, sample):
    monkeypatch.setattr(simhash, "COMMON_SAMPLE", sample)
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(300)]
    passage = rng.choices(vocab, k=40)
    texts = [None, "", "one", "One", "one two three four", "one two three four five"]
    for _ in range(60):  # near copies by a few changed words, chains of them, and texts that only share a passage
        words = rng.choices(vocab, k=rng.randint(5, 400)) + passage * rng.randint(0, 1)
        for _ in range(rng.randint(1, 6)):
            texts.append(" ".join(words))
            words = [rng.choice(vocab) if rng.random() < 0.012 else w for w in words]
    group = rng.choices(vocab, k=100)
    texts += [" ".join([*group[:i], "new", *group[i + 1 :]]) for i in range(80)]
    texts += [" ".join([*group[: 20 + i], *rng.choices(vocab, k=8 + i)]) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = kept(texts)
    assert len(want) < len(set(texts)) - 100
    assert {r["doc_id"] for r in corpus_pipeline.simhash_near_dedup(spark, df, "").collect()} == want
