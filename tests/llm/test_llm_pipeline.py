"""The stages, each on its own input, against plain Python; and the whole run."""

from __future__ import annotations

from collections import defaultdict

import pytest
from conftest import SF
from test_llm_jaccard import brute
from test_llm_texts import _ids, _words

import corpus_pipeline
from skylag.llm import jaccard_join, quality
from skylag.llm.queries import good_label, table
from skylag.sources.scratch import materialize


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage."""
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        result = materialize(stage(spark, docs, SF), "stage")
        out.append((name, docs, result))
        docs = result
    return out


def _texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_stand_in_order_and_keep_the_columns(stages):
    assert [n for n, *_ in stages] == [
        "quality classifier", "exact dedup", "n-gram jaccard join", "benchmark decontamination", "best-fit packing"
    ]
    for _, docs, out in stages[:-1]:
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert set(out.collect()) <= set(docs.collect())


def test_quality_stage_keeps_what_the_operator_keeps(spark, stages):
    _, docs, out = stages[0]
    scored = quality.score(docs, table(spark, SF, "labels"), good_label()).where("kept").collect()
    assert {r["doc_id"] for r in scored} == set(_texts(out))
    assert len(_texts(out)) > 0.7 * docs.count()


def test_exact_dedup_stage_keeps_the_largest_id(stages):
    _, docs, out = stages[1]
    groups = defaultdict(list)
    for i, t in _texts(docs).items():
        groups[t].append(i)
    assert set(_texts(out)) == {max(g) for g in groups.values()}


def test_jaccard_stage_keeps_the_smallest_id_of_each_group(stages):
    _, docs, out = stages[2]
    texts = _texts(docs)
    ids = sorted(texts)
    # Brute force over documents that share a shingle at all would need hours: compare inside shared prefixes.
    found = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(docs, 5, 80).collect()}
    assert set(_texts(out)) == {i for i in ids if found[i] == i}
    some = ids[:250]
    want = brute([texts[i] for i in some], 5, 80)
    for k, (_, root) in want.items():
        assert found[some[k]] == found[some[root]]


def test_decontamination_stage_drops_by_the_rule(spark, stages):
    _, docs, out = stages[3]
    windows = set()
    for r in table(spark, SF, "benchmark").collect():
        w = _words(r["text"])
        n = min(13, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1) if n}
    sizes = {len(w) for w in windows}
    keep = set()
    for i, t in _texts(docs).items():
        w = _words(t)
        hit = {p for n in sizes for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for p in range(k, k + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            keep.add(i)
    assert set(_texts(out)) == keep


def test_packing_stage_holds_every_id_once(stages):
    _, docs, out = stages[4]
    pieces = defaultdict(list)
    for r in out.collect():
        pieces[r["doc_id"]].append((r["start"], r["length"]))
    texts = _texts(docs)
    assert set(pieces) == set(texts)
    for i in list(texts)[:100]:
        assert sum(n for _, n in pieces[i]) == len(_ids(texts[i]))


def test_run_is_the_chain_of_stages(spark, stages):
    ran = corpus_pipeline.run(spark, SF)
    assert sorted(ran.collect()) == sorted(stages[-1][2].collect())
