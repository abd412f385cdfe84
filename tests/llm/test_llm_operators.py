"""The training-data operators on small cases: NULLs, empty and long texts, ties, repeated rows, empty tables, odd columns."""

import hashlib
import itertools
import json
import os
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillwise.llm import byte_bpe, chat, exact_dedup, graph, html_text, jaccard_join, line_crf, packing, passages, url_filter, warc
from tillwise.llm.storage import prepared, stored
from tillwise.llm.words import Batch, span_hashes
from tillwise.session import shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, digest string, row long, `a.b` int, n int, v int, label string, key string"
WORDS_PATH = public_tokenizers.path("word_bpe_49k.json")
BYTES_PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def prose(seed, words):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(words))


def edited(text, every, seed=0):
    words = text.split(" ")
    for i in range(seed, len(words), every):
        words[i] = f"x{seed}y{i}"
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    base, other = prose(1, 300), prose(2, 120)
    return [
        (5, base), (3, base), (3, base), (9, base.replace(" ", " \t\n")), (None, base), (None, None), (11, None), (12, ""), (13, " \n\t "),
        (20, edited(base, 75)), (21, edited(base, 75, 3)), (22, edited(base, 4)), (30, other), (31, prose(3, 200) + "\n" + other + "\n" + prose(4, 60)),
        (40, "one"), (41, "one two"), (42, "ONE two"), (43, "É é ß"), (44, "wort " * 160), (45, "wort " * 90), (50, prose(9, 30_000)), (51, "z" * 200_000),
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    prepared(spark)
    return spark.createDataFrame([(i, t, "xx", "d", 1, 2, 3, 4, "l", "k") for i, t in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.filter("false").coalesce(1)


def test_word_spans_and_hashes():
    found = ["", " a b\x0b c ", "a\u00a0b \x1c", "x" * 99]
    batch = Batch([t.encode() for t in found])
    spans = [batch.data[a:b].tobytes().decode() for a, b in zip(batch.starts, batch.ends)]
    assert [spans[a:b] for a, b in zip(batch.first, batch.first[1:])] == [WORD.findall(t) for t in found]
    data = np.frombuffer(b"abcabcabd", np.uint8)
    one, two, three = span_hashes(data, np.array([0, 3, 6]), np.array([3, 6, 9]))
    assert one == two != three


def test_exact_dedup(docs, texts, nothing):
    groups = defaultdict(list)
    for doc, text in texts:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc)
    found = exact_dedup.duplicate_groups(docs).collect()
    assert len(found) == len(texts)
    seen = defaultdict(list)
    for r in found:
        seen[r["digest"]].append(r)
    for text, ids in groups.items():
        rows = seen[hashlib.sha256(text.encode()).hexdigest()]
        least = min((i for i in ids if i is not None), default=None)
        assert Counter(r["id"] for r in rows) == Counter(ids)
        assert {(r["keep_id"], r["group_size"]) for r in rows} == {(least, len(ids))}
        assert [r["id"] for r in rows if r["kept"]] == [least]
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.duplicate_groups(nothing).count() == exact_dedup.deduplicate(nothing).count() == 0


def test_misra_gries_bounds():
    items = ["a"] * 500 + ["b"] * 300 + [f"r{i}" for i in range(1000)]
    random.Random(0).shuffle(items)
    found = exact_dedup.misra_gries(itertools.batched(items, 50), 9)
    true = Counter(items)
    assert len(found) <= 9 and all(true[x] - len(items) / 10 <= n <= true[x] for x, n in found.items())
    assert {"a", "b"} <= set(found)


def test_heavy_digests_are_broadcast_only_within_the_bound(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("d"), "id")).alias("digest"))
    assert [r["digest"] for r in exact_dedup.heavy_digests(rows).collect()] == ["hot"]


def test_html_text(spark):
    page = (
        "<html><head><title>t</title></head><body><div class='cookie-notice'>We use cookies<button>OK</button></div><nav><a>Home</a></nav>"
        "<article><h1>T &amp; &eacute;&nbsp;x</h1><p>One <a href=x>link</a> more.<p>Second\n <b>line</b><ul><li>a<li>b</ul><aside>s</aside>"
        "<div class=ad>buy</div><form><input><label>m</label></form><p>Short.</p><section id=comments><p>nice</p></section></article>"
        "<div id=sidebar>z</div><footer>f</footer><script>var t='</p>'</script></body></html>"
    )
    plain = "<div class=menu><a>a</a></div><div><h2>Head</h2><p>Long text that runs on.</p><p>Ok.</p></div><div class=footer>foot</div>"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "u", ""), (None, "u", plain), (4, "u", "<p>" + "w " * 100_000)]
    found = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by_id = {r["page_id"]: r for r in found}
    assert len(found) == 6
    assert by_id[1]["text"] == "T & é x\nOne link more.\nSecond line\na\nb\nShort."
    assert by_id[None]["text"] == "Head\nLong text that runs on.\nOk."
    assert [by_id[i]["text"] for i in (2, 3)] == ["", ""] and by_id[4]["n_chars"] == 199_999
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_text_outside_a_teaser_in_an_article_element():
    body = [prose(i, 60) for i in range(3)]
    teaser = "<article><h3>Next</h3><p>Read this too.</p></article>"
    page = "<div>" + "".join(f"<p>{b}</p>" for b in body) + f"</div><section>{teaser}</section>"
    assert html_text.main_text(page).split("\n")[:3] == body
    marked = f"<div><p>Plain words about the site.</p></div><article><p>{body[0]}</p><p><a>link</a></p></article>"
    assert html_text.main_text(marked) == f"{body[0]}\nlink"


def test_html_text_keeps_short_paragraphs_behind_links():
    links = "<ul><li><a>one</a></li><li><a>two</a></li><li><a>three</a></li></ul>"
    long, short = prose(1, 800), "A closing paragraph of a few words."
    page = f"<div>{links}</div><div><p>Opening.</p>{links}<p>{long}</p>{links}<p>{short}</p></div><div>{links}</div>"
    between = "one\ntwo\nthree"
    assert html_text.main_text(page) == "\n".join(["Opening.", between, long, between, short])


def test_packing(docs, texts, nothing):
    tokenizer = Tokenizer.from_file(WORDS_PATH)
    found = packing.pack(docs, WORDS_PATH).collect()
    pieces = defaultdict(list)
    for r in found:
        pieces[r["doc_id"]].append(r)
    for doc, group in itertools.groupby(sorted(texts, key=lambda r: (r[0] is None, r[0] or 0)), key=lambda r: r[0]):
        want = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in group)
        assert sum(r["length"] for r in pieces[doc]) == want
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    total = sum(r["length"] for r in found)
    assert len(sequences) <= -(-total // packing.CAPACITY) + 1
    assert packing.pack(nothing, WORDS_PATH).count() == 0


def test_best_fit_takes_the_tightest_bin():
    bins, offsets, used = packing.best_fit(np.array([6, 5, 4, 5]), 10)
    assert sorted(used) == [10, 10] and bins[0] == bins[2] and bins[1] == bins[3] and offsets[2] == 6


def test_packed_sequences_hold_the_documents(spark):
    few = spark.createDataFrame([(1, "the cat"), (2, None), (3, "a dog's day " * 3000)], "doc_id long, text string")
    pieces = packing.pack(few, WORDS_PATH)
    tokenizer = Tokenizer.from_file(WORDS_PATH)
    ids = {r["sequence_id"]: r["ids"] for r in packing.sequence_ids(few, pieces, WORDS_PATH).collect()}
    back = defaultdict(list)
    for r in sorted(pieces.collect(), key=lambda r: (r["doc_id"], r["piece"])):
        back[r["doc_id"]] += ids[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
    for r in few.collect():
        assert back[r["doc_id"]] == tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("odd", ["Don't STOP's a<|endoftext|>b", "ΣΑΣ İstanbul ǅ", "\x1c\x85x\u2003y \x00b", "日本語 ﬁ ½ 🙂👍🏽", "e\u0301 12345b２ ...!!!"])
def test_word_ids_agree_with_the_library(odd):
    from tillwise.llm.word_tokens import word_ids

    packed = word_ids(WORDS_PATH).text_ids(odd.encode())
    assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == Tokenizer.from_file(WORDS_PATH).encode(odd, add_special_tokens=False).ids


def test_repeated_passages(docs, texts, nothing):
    found = {(r["doc_id"], r["source_doc_id"]) for r in passages.repeated_passages(docs).collect()}
    assert {(5, 3), (None, 3), (9, 3), (20, 3), (21, 3), (31, 30), (45, 44)} <= found
    assert not any(r[0] in (11, 12, 13, 40, 41, 50, 51) for r in found)
    cut = {r["doc_id"]: r["text"] for r in passages.cut(docs).filter("doc_id IS NOT NULL").collect()}
    assert cut[31] == prose(3, 200) + "\n" + prose(4, 60) and cut[30] == prose(2, 120)
    assert cut[3] == prose(1, 300) and not {5, 9} & set(cut)
    assert all(len(cut.get(i, "").split()) < 8 for i in (20, 21))
    assert {11, 12, 13, 40, 41, 42, 43, 50, 51} <= set(cut)
    assert passages.repeated_passages(nothing).count() == passages.cut(nothing).count() == 0


def covered(found, doc, start, words):
    """Whether passages of a document cover all its words from ``start`` on."""
    spans = [(r["start"], r["start"] + r["words"]) for r in found if r["doc_id"] == doc]
    return all(any(a <= i < b for a, b in spans) for i in range(start, start + words))


@pytest.mark.parametrize("size, excerpts", [(50, [(0, 30), (20, 30)]), (60, [(0, 45)]), (114, [(0, 49), (40, 49), (65, 49)])])
def test_passages_after_excerpts_in_earlier_documents(spark, size, excerpts):
    """More than RARE earlier documents hold only a part of the passage, and come first by all of its seeds."""
    passage, rows = prose(70, size).split(), []
    for copy in range(passages.RARE):
        rows += [" ".join([prose(7000 + 10 * copy + i, 40), *passage[a : a + n], prose(8000 + 10 * copy + i, 40)]) for i, (a, n) in enumerate(excerpts)]
    at = len(rows)
    rows += [" ".join([prose(9000 + i, 35), *passage, prose(9100 + i, 35)]) for i in range(2)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = passages.repeated_passages(docs).collect()
    assert covered(found, at + 1, 35, size)
    assert {r["doc_id"] for r in found} == {at + 1} and {r["source_doc_id"] for r in found} == {at}
    words = [t.split() for t in rows]
    for r in found:
        mine = words[r["doc_id"]][r["start"] : r["start"] + r["words"]]
        assert r["identity"] < 1 or mine == words[r["source_doc_id"]][r["source_start"] : r["source_start"] + r["source_words"]]
    assert prose(70, size) not in {r["doc_id"]: r["text"] for r in passages.cut(docs).collect()}[at + 1]


@pytest.mark.parametrize("excerpts", [[(0, 30), (20, 40)], [(0, 24), (20, 24), (36, 24)]])
def test_edited_passages_after_excerpts_in_earlier_documents(spark, excerpts):
    """No 50 words are equal, and the seeds are frequent and come first in documents that hold less than the passage."""
    passage, rows = prose(71, 60).split(), []
    for copy in range(passages.RARE + 1):
        rows += [" ".join([prose(7500 + 10 * copy + i, 40), *passage[a : a + n], prose(8500 + 10 * copy + i, 40)]) for i, (a, n) in enumerate(excerpts)]
    at = len(rows)
    copies = [passage, *[edited(" ".join(passage), 10, k).split() for k in (3, 6)]]
    rows += [" ".join([prose(9300 + i, 35), *copy, prose(9400 + i, 35)]) for i, copy in enumerate(copies)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = passages.repeated_passages(docs).collect()
    for doc in (at + 1, at + 2):
        assert any(r["doc_id"] == doc and r["source_doc_id"] == at for r in found)
        assert covered(found, doc, 39, 50)
    assert all(r["identity"] >= passages.IDENTITY and r["words"] >= passages.MIN_WORDS for r in found)


def test_passages_are_found_from_the_declared_identity_on(spark):
    """Each place that the alignment accepts from a seed of its own is found, with edits at any distance."""
    rows, want = [], {}
    for i, (size, every) in enumerate(itertools.product([54, 60, 100], [5, 6, 7, 8, 12])):
        for case in range(4):
            passage, doc = prose(100 * i + case, size), len(rows)
            copy = edited(passage, every, every - 1)
            rows += [" ".join([prose(40_000 + doc, 30), passage, prose(50_000 + doc, 30)]), " ".join([prose(60_000 + doc, 25), copy, prose(70_000 + doc, 25)])]
            a, b = rows[-1].split(), rows[-2].split()
            at = [(x, x + 5) for x in range(len(a) - passages.K) if a[x : x + passages.K] == b[x + 5 : x + 5 + passages.K]]
            best = passages.aligned(a, b, *zip(*at))
            assert best
            want[doc + 1] = (doc, best[0][1])
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r["doc_id"]: (r["source_doc_id"], r["words"]) for r in passages.repeated_passages(docs).collect()}
    assert found == want


def brute_chain(pairs):
    best = []
    for i, (x, y) in enumerate(pairs):
        before = [best[j] - passages.GAP_COST / 2 * (x - a + y - b) for j, (a, b) in enumerate(pairs[:i]) if a < x and b < y]
        best.append(passages.SEED_SCORE + max([0.0, *before]))
    return max(best)


@pytest.mark.parametrize("seed", range(5))
def test_chaining_finds_the_best_score(seed):
    rng = random.Random(seed)
    pairs = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(40)})
    chain = passages.chains(pairs)[0]
    assert all(a < c and b < d for (a, b), (c, d) in zip(chain, chain[1:]))
    score = passages.SEED_SCORE * len(chain) - passages.GAP_COST / 2 * (sum(chain[-1]) - sum(chain[0]))
    assert score == pytest.approx(brute_chain(pairs))


def test_matches_in_line_are_chained_without_a_search(monkeypatch):
    """Matches that follow one another in both orders with small gaps are one chain; all others are searched as before."""
    import pyarrow as pa

    rng, searched = random.Random(1), []
    search = passages.chains
    monkeypatch.setattr(passages, "chains", lambda pairs: searched.append(1) or search(pairs))
    lines, others = [], []
    for _ in range(60):
        at, line = (rng.randrange(9), rng.randrange(9)), []
        for _ in range(rng.randint(4, 30)):
            line.append(at)
            at = (at[0] + rng.randint(1, 33), at[1] + rng.randint(1, 33))
        lines.append(line)
        others.append([*line, (line[-1][0] + 1, line[0][1]), (line[-1][0] + 70, line[-1][1] + 70)])
    for group, most in ((lines, 0), (others, 60)):
        rows = [{"c": 9, "l": k, "matches": [{"x": x, "y": y, "flat": False} for x, y in rng.sample(pairs, len(pairs))]} for k, pairs in enumerate(group)]
        record = pa.RecordBatch.from_pylist(rows, pa.schema([("c", pa.int64()), ("l", pa.int64()), ("matches", pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32()), ("flat", pa.bool_())])))]))
        found = [(r["l"], r["xs"], r["ys"]) for b in passages._chained(iter([record])) for r in b.to_pylist()]
        assert len(searched) == most
        want = [(k, *map(list, zip(*chain))) for k, pairs in enumerate(group) for chain in search(pairs) if len(chain) >= passages.LEAST_SEEDS]
        assert found == want


def test_the_third_round_meets_in_parts(spark, monkeypatch):
    """Pairs are made and met in parts, so that the disk they take doesn't grow with their number; no passage is lost."""
    rows, at = [], 0
    for copy in range(passages.RARE + 2):
        for part in range(6):
            rows.append((at, f"{prose(100 + at, 30)} {' '.join(prose(70, 240).split()[part * 40 : part * 40 + 45])} {prose(300 + at, 30)}"))
            at += 1
    rows += [(at + k, f"{prose(500 + k, 30)} {prose(70, 240)}") for k in range(4)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), []
    write = passages.stored
    monkeypatch.setattr(passages, "stored", lambda df, label: labels.append(label) or write(df, label))
    whole = sorted(map(tuple, passages.repeated_passages(docs).collect()))
    steps = Counter(labels)
    monkeypatch.setattr(passages, "MET_A_TEXT", 20)
    monkeypatch.setattr(passages, "PAIRS_A_TEXT", 0.5)
    labels.clear()
    assert sorted(map(tuple, passages.repeated_passages(docs).collect())) == whole and whole
    parts = Counter(labels)
    assert parts["chains"] > steps["chains"] and parts["pairs"] > steps["pairs"], (parts, steps)


def test_shuffle_files_go_with_the_step_that_wrote_them(spark):
    """Nothing reads them again; before, they stayed on disk until the driver collected its garbage."""
    import time

    kept = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f.name() for f in (kept.getAllBlocks().apply(i) for i in range(kept.getAllBlocks().size())) if "shuffle" in f.name()}
    before, usual = files(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    made = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartition(3), "counts")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and made.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == usual


def test_common_words_is_the_longest_common_subsequence():
    assert passages.common_words([1, 2, 3, 4, 5], [2, 9, 4, 5, 1]) == 3 and passages.common_words([], [1]) == 0


def brute_base(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside))


def test_line_labels(spark, docs, texts, nothing):
    found = line_crf.judge(docs, None).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r["doc_id"], *(r[c] for c in line_crf.BASE)) for r in found), key=key) == sorted(((i, *brute_base(t)) for i, t in texts), key=key)
    for r in found:
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed)
    good = [(i, "\n".join(prose(100 * i + k, 12).capitalize() + "." for k in range(8)), 1) for i in range(40)]
    bad = [(100 + i, "Clean line.\n" + "\n".join(" | ".join(prose(500 * i + k, 9).split()) + " ###" for k in range(8)), 0) for i in range(40)]
    rows = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad] + [(None, 1), (7777, None)], "doc_id long, quality int")
    field = line_crf.fit(rows, labels)
    kept = {r["doc_id"] for r in line_crf.keep(rows, field).collect()}
    assert kept == {i for i, _, _ in good}
    assert line_crf.fit(rows, labels.filter("quality = 1")) is None and line_crf.fit(nothing, labels) is None
    assert line_crf.keep(docs, None).columns == docs.columns and line_crf.keep(nothing, field).count() == 0


def test_viterbi_finds_the_best_labels():
    rng = np.random.default_rng(1)
    field = line_crf.Field(rng.normal(size=3), rng.normal(size=(2, 2)))
    first = np.array([0, 5, 5, 6, 12])
    features = rng.normal(size=(12, 3))
    states = field.decode(features, first)
    emit = features @ field.weights
    for a, b in zip(first, first[1:]):
        score = lambda s: sum(emit[a + t] * v for t, v in enumerate(s)) + sum(field.moves[p, q] for p, q in zip(s, s[1:]))  # noqa: B023,E731
        if b > a:
            assert score(tuple(states[a:b])) == pytest.approx(max(map(score, itertools.product((0, 1), repeat=b - a))))


def test_byte_bpe(docs, texts, nothing):
    ranks = byte_bpe.load_ranks(BYTES_PATH)
    encoding = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = byte_bpe.encode(docs, BYTES_PATH, public_tokenizers.PATTERN).collect()
    got = Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in found)
    assert got == Counter((i, tuple(encoding.encode_ordinary(t or "")), (t or "").encode()) for i, t in texts)
    for word in ("x" * 700, prose(5, 200).replace(" ", ""), "日本" * 200, "a"):
        assert byte_bpe.heap_ids(word.encode(), ranks) == encoding.encode_ordinary(word)
    assert byte_bpe.encode(nothing, BYTES_PATH, public_tokenizers.PATTERN).count() == 0


def brute_components(texts, width, num, den):
    def shingles(text):
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if len(words) < width:
            return {tuple(words)} if words else set()
        return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}

    sets = [shingles(t) for _, t in texts]
    label = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        common = len(sets[i] & sets[j])
        if common and den * common >= num * len(sets[i] | sets[j]):
            old, new = label[j], label[i]
            label = [new if x == old else x for x in label]
    out = []
    for i, (doc, _) in enumerate(texts):
        ids = [d for (d, _), x in zip(texts, label) if x == label[i] and d is not None]
        out.append((doc, len(sets[i]), (min(ids) if ids else None) if sets[i] else doc))
    return Counter(out), len({x for x, s in zip(label, sets) if s}) + sum(not s for s in sets)


@pytest.mark.parametrize("alike", [jaccard_join.Alike(), jaccard_join.Alike(5, 80, 100)])
def test_jaccard_join(docs, texts, nothing, alike):
    want, groups = brute_components(texts, alike.width, alike.num, alike.den)
    found = jaccard_join.similar_documents(docs, alike)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()) == want
    kept = jaccard_join.deduplicate(docs, alike)
    assert kept.columns == docs.columns and kept.count() == groups
    assert jaccard_join.similar_documents(nothing, alike).count() == jaccard_join.deduplicate(nothing, alike).count() == 0


@pytest.mark.parametrize("large", [2048, 80])
def test_jaccard_join_of_many_near_and_half_near_copies(spark, monkeypatch, large):
    """Groups whose copies share frequent shingles in every way: linked, just not linked, and sharing lines only."""
    monkeypatch.setattr(jaccard_join, "RARE", 3)
    rng, lines = random.Random(4), [prose(1000 + i, 14) for i in range(8)]
    texts = []
    for base in range(6):
        text = prose(50 + base, rng.choice([40, 90, 400, 900]))
        texts += [edited(text, rng.choice([12, 30, 60, 90, 200]), seed) for seed in range(rng.randint(3, 14))]
    texts += ["\n".join([*rng.sample(lines, 5), prose(2000 + i, rng.choice([3, 20, 60]))]) for i in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)]
    want, _ = brute_components(rows, 3, 90, 100)
    alike = jaccard_join.Alike(large=large)
    found = jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), alike).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == want


def test_jaccard_join_deletes_what_nothing_reads_any_more(spark):
    """What is left behind are narrow tables; prefixes, bitmaps and shingles would be lists."""
    text = prose(77, 200)
    rows = [(i, edited(text, 150, i)) for i in range(6)]
    before = set(os.listdir(folder := shared_dir(spark).removeprefix("file:")))
    found = jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    made = [f"{folder}/{name}" for name in set(os.listdir(folder)) - before if any(f.endswith(".parquet") for f in os.listdir(f"{folder}/{name}"))]
    columns = {c for path in made for c in spark.read.parquet(path).columns}
    assert made and not columns & {"prefix", "neighbours", "shingles", "key", "b0"}
    assert found.count() == len(rows)


def test_components_of_long_chains(spark):
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (105, 101), (200, 200)]
    found = {r["v"]: r["label"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100, 105: 100}


def test_warc_round_trip(spark):
    rows = [(3, "http://a/\r\nx", "same"), (1, None, "same"), (1, None, "same"), (None, "u", "same"), (2, "u", None), (7, "v", ""), (8, "é", "<p>é\r\n\r\n" * 20_000), (None, "w", "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.write(pages)
    found = warc.read(index).collect()
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in found)
    assert kinds == Counter([(3, "revisit", 1), (1, "response", None), (1, "response", None), (None, "revisit", 1), (2, "response", None), (7, "revisit", 2), (8, "response", None), (None, "response", None)])
    long = next(r for r in found if r["page_id"] == 8)
    assert bytes(long["payload"]).decode() == rows[6][2] and long["payload_bytes"] == len(rows[6][2].encode())
    assert {r["payload_digest"] for r in warc.read(index.filter("page_id = 3")).collect()} == {r["payload_digest"] for r in found if r["page_id"] == 1}
    assert all(r["record_type"] == "response" for r in warc.read(warc.write(pages, min_bytes=5)).collect() if r["payload_bytes"] < 5)
    assert warc.read(warc.write(pages.filter("false"))).count() == 0


def test_neighbouring_ranges_are_read_together():
    near = [("a", 0, 10), ("a", 10, 5), ("a", 15 + warc.GAP_BYTES, 5), ("a", 10**7, 5), ("b", 10**7 + 5, 5)]
    assert [len(r) for r in warc._ranges(near)] == [3, 1, 1]


def test_url_verdicts(spark):
    urls = [
        (1, "http://A.Example.NET/en/x?q"), (2, "https://sub.net/p"), (3, "http://net"), (4, "http://example.com/de/1#f"), (5, "http://w.org/fr/"), (6, "http://casinowin.io/a"),
        (7, None), (8, "no scheme"), (9, "x://h://i/j"), (10, "http://garden.io/flowers"), (10, "http://garden.io/flowers"), (None, "http://free-bets.io/1"),
    ]
    more = [(100 + i, f"http://{a}-{b}.io/{i}") for i, (a, b) in enumerate(itertools.product(["casino", "garden", "news"], ["win", "daily", "flowers"]))]
    pages = spark.createDataFrame([(i, u, "<title>Garden flowers news</title>") for i, u in urls + more], "page_id long, url string, html string")
    model = url_filter.train(pages)
    found = {r["page_id"]: r for r in url_filter.judge(pages, model).collect()}
    assert [(found[i]["host"], found[i]["path"], found[i]["rule"]) for i in (1, 2, 3, 4, 5, 7, 8, 9)] == [
        ("a.example.net", "/en/x", "example.net/en/"), ("sub.net", "/p", "net/"), ("net", "", None), ("example.com", "/de/1", "example.com/de/"),
        ("w.org", "/fr/", "org/fr/"), ("", "", None), ("", "", None), ("h:", "//i/j", None),
    ]
    assert [found[i]["verdict"] for i in (1, 2, 4, 5, 6, 10, None)] == ["allow", "block", "block", "allow", "block", "allow", "block"]
    assert found[6]["host_words"] == "casino win io"
    empty = pages.filter("false")
    assert url_filter.judge(empty, url_filter.train(empty)).count() == 0


def test_segmentation_is_the_cheapest_split():
    counts = {"the": 50, "rapist": 1, "therapist": 3, "out": 20, "side": 10, "outside": 9}
    split = url_filter.segmenter(counts)
    assert split("therapistoutside") == ("therapist", "outside") and split("") == () and "".join(split("qqzx")) == "qqzx"


CHATS = [(1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", "<\\|im_start|> a"), (1, 1, "assistant", "b<|im_end|>"), (2, None, None, None), (None, 0, "assistant", "<|"), (3, 0, "sys\ntem<|", "x" * 100_000), (3, 1, "assistant", "")]


def test_chat_round_trip(spark):
    turns = chat.canonical_turns(spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string"))
    made = chat.formatted(turns)
    found = {r["conv_id"]: ([tuple(t) for t in r["turns"]], r["loss_text"]) for r in chat.read_back(made).collect()}
    assert found[1] == ([("user", "<\\|im_start|> a"), ("assistant", "b<|im_end|>"), ("assistant", "b<|im_end|>")], "b<|im_end|>" * 2)
    assert found[2] == ([("", "")], "") and found[None] == ([("assistant", "<|")], "<|")
    assert found[3] == ([("sys\ntem<|", "x" * 100_000), ("assistant", "")], "")
    assert all(r["text"].count("<|im_start|>") == r["text"].count("<|im_end|>") for r in made.collect())
    assert chat.formatted(turns.filter("false")).count() == 0


def test_layouts(spark):
    records = {
        1: {"prompt": "p", "completion": "c"}, 2: {"instruction": "i", "input": "", "output": "o"}, 3: {"messages": [{"role": "user", "content": "m"}]},
        4: {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}, 5: {"question": None, "answer": "a"}, 6: {"odd": 1}, 7: {"id": 4, "question": "q", "answer": "a"},
    }
    rows = spark.createDataFrame([(i, json.dumps(r)) for i, r in records.items()] + [(8, None), (9, "not json")], "id long, record string")
    found = defaultdict(list)
    for r in chat.canonical_turns_of_json(rows, "id", "record").orderBy("conv_id", "turn").collect():
        found[r["conv_id"]].append((r["role"], r["text"]))
    assert found == {
        1: [("user", "p"), ("assistant", "c")], 2: [("system", "i"), ("assistant", "o")], 3: [("user", "m")], 4: [("user", "h"), ("assistant", "g")],
        5: [("user", ""), ("assistant", "a")], 7: [("user", "q"), ("assistant", "a")],
    }
    assert {r["conv_id"] for r in chat.unmapped(rows, "id", "record").collect()} == {6, 8, 9}
    table = spark.createDataFrame([(1, [("human", "h")])], "id long, conversations array<struct<from: string, value: string>>")
    assert [(r["role"], r["text"]) for r in chat.canonical_turns(table).collect()] == [("user", "h")]
    with pytest.raises(ValueError, match="no mapping"):
        chat.canonical_turns(spark.range(1))


def test_layouts_of_later_messages_and_repeated_rows(spark):
    both = {"messages": [{"role": "user", "content": "m"}, {"from": "gpt", "value": "g"}]}
    same = {"messages": [{"role": "user", "content": "m"}, {"role": "assistant", "content": "[1]"}]}
    text = {"prompt": '[{"a": 1}]', "completion": "[]"}
    rows = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate([both, same, text])], "id long, record string")
    found = sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in chat.canonical_turns_of_json(rows, "id", "record").collect())
    assert found == [(1, 0, "user", "m"), (1, 1, "assistant", "[1]"), (2, 0, "user", '[{"a": 1}]'), (2, 1, "assistant", "[]")]
    assert [r["conv_id"] for r in chat.unmapped(rows, "id", "record").collect()] == [0]
    twice = spark.createDataFrame([("p", "c"), ("p", "c")], "prompt string, completion string")
    made = chat.read_back(chat.formatted(chat.canonical_turns(twice))).collect()
    assert [[tuple(t) for t in r["turns"]] for r in made] == [[("user", "p"), ("assistant", "c")]] * 2
