"""Queries of this subpackage against their SQL; the pipeline against its own operators."""

from __future__ import annotations

import pytest

import corpus_pipeline
from lodestone.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import connection, same_rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf_dir, name):
    same_rows(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], connection(sf_dir))


def test_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 11))


def test_pipeline(spark, sf_dir):
    """Stage by stage against brute force over the stage's own input."""
    from collections import Counter

    from tests.llm.test_contract_ops import brute_base, brute_quality, check_pack, norm, plain_fingerprint

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plain = max((r.text for r in corpus_pipeline.quality(spark, docs, sf_dir).collect()), key=len)
    planted = [(-1, f"{plain} password = Zx81kQw93LmP07aa", "en", "src0", 0)]
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    before = {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "secrets", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf_dir)
        if name == "packing":
            check_pack([(r.doc_id, r.text, r.lang, r.source) for r in before.values()], made.collect())
            break
        assert made.columns == docs.columns
        after = {r.doc_id: r for r in made.collect()}
        assert after.keys() <= before.keys()
        if name == "quality":
            for i, r in before.items():
                words, *_, repeats = brute_quality(r.text)
                assert i not in after or words >= 50 and 100 * repeats <= 50 * words
            assert len(after) > 0.7 * sum(brute_quality(r.text)[0] >= 50 for r in before.values())
        if name == "exact":
            first = {}
            for i in sorted(before):
                first.setdefault(norm(before[i].text), i)
            assert after.keys() == set(first.values())
        if name == "near":
            fps = {i: plain_fingerprint(r.text) for i, r in before.items()}
            near = {i: [j for j in fps if bin(fps[i] ^ fps[j]).count("1") <= 4] for i in fps}
            kept, seen = set(), set()
            for i in sorted(fps):
                if i in seen:
                    continue
                kept.add(i)
                todo = [i]
                while todo:
                    k = todo.pop()
                    if k not in seen:
                        seen.add(k)
                        todo += near[k]
            assert after.keys() == kept
        if name == "secrets":
            assert after.keys() == before.keys()
            for i, r in after.items():
                assert r.n_chars == len(r.text)
                assert brute_base(before[i].text) or "[SECRET]" in r.text or r.text == before[i].text
            assert Counter("[SECRET]" in r.text for r in after.values())[True] > 0
        else:
            assert all(after[i] == before[i] for i in after)
        docs, before = made, after
