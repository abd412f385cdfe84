"""The stages of the pipeline against brute force, and the registered queries against DuckDB, on the smallest tables."""

import os
import re
from collections import defaultdict

import duckdb
import pytest

import corpus_pipeline
from tillwise.llm import line_crf, passages, registry
from tillwise.llm.storage import read_table, scratch_path

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not available")


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def near_groups(docs):
    """Smallest id of each group of documents that are alike."""
    sets, label = {d: shingles(t) for d, t in docs.items()}, {d: d for d in docs}
    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b]) if a < b else 0
            if common and 100 * common >= 80 * len(sets[a] | sets[b]):
                old, new = label[b], label[a]
                label = {d: new if x == old else x for d, x in label.items()}
    groups = defaultdict(list)
    for d, x in label.items():
        groups[x].append(d)
    return {min(g) for g in groups.values()}


def test_stages(spark):
    docs = read_table(spark, SF_DIR, "documents")
    columns = docs.dtypes
    texts = []
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, "stage")
        stage(spark, docs, SF_DIR).write.parquet(path)
        last, docs = docs, spark.read.parquet(path)
        if name != "best-fit packing":
            assert docs.dtypes == columns, name
            texts.append({r["doc_id"]: r["text"] for r in docs.collect()})
    source = read_table(spark, SF_DIR, "documents")
    good, unique, apart, cut = texts
    judged = line_crf.judge(source, line_crf.fit(source, read_table(spark, SF_DIR, "labels")))
    assert set(good) == {r["doc_id"] for r in judged.filter("kept").collect()} and good
    first = defaultdict(list)
    for doc, text in good.items():
        first[re.sub(r"[\x20\x09-\x0D]+", " ", text)].append(doc)
    assert set(unique) == {min(ids) for ids in first.values()}
    assert set(apart) == near_groups(unique)
    assert set(cut) <= set(apart)
    for doc, text in cut.items():  # what is left are words of the document, in order
        words = iter(apart[doc].split())
        assert all(w in words for w in text.split())
    runs = defaultdict(set)
    for doc, text in cut.items():
        words = text.encode().split()
        for i in range(len(words) - 79):
            runs[tuple(words[i : i + 80])].add(doc)
    assert all(len(ids) == 1 for ids in runs.values())
    assert {r["doc_id"] for r in docs.collect()} == set(cut) and last.count() == len(cut)


@pytest.mark.parametrize("sf_dir", [SF_DIR, "/root/testdata/sf0.01"])
def test_every_shared_run_of_a_passage_is_covered(spark, sf_dir):
    """All runs of MIN_WORDS words that an earlier text has too lie in passages of the later one."""
    docs = read_table(spark, sf_dir, "documents")
    first, words = {}, {r["doc_id"]: (r["text"] or "").encode().split() for r in docs.select("doc_id", "text").collect()}
    spans = defaultdict(set)
    for r in passages.repeated_passages(docs).collect():
        spans[r["doc_id"]].update(range(r["start"], r["start"] + r["words"]))
    n = passages.MIN_WORDS
    for doc in sorted(words):
        for i in range(len(words[doc]) - n + 1):
            if first.setdefault(tuple(words[doc][i : i + n]), doc) != doc:
                assert spans[doc].issuperset(range(i, i + n)), (doc, i)
    assert spans


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_duckdb(spark, name):
    tables = duckdb.connect()
    for file in os.listdir(SF_DIR):
        tables.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{file}'")
    result = tables.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    want = sorted(str(row) for row in result.fetchall())
    assert sorted(str(tuple(r[c] for c in columns)) for r in registry.queries()[name](spark, SF_DIR).collect()) == want


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.queries()) == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(registry.queries())
