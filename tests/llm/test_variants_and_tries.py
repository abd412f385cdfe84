"""Spelling variants, MinHash fingerprints and conversation tries against brute force, with NULLs, ties, empty and odd tables."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tillwise.llm import minhash, prefix_trie, registry, spelling
from tillwise.llm.storage import prepared, read_table, stored

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not available")


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.fixture(scope="module")
def words():
    rng = random.Random(11)
    made = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(250)}
    made |= {"a" * k for k in range(1, 9)} | {"q" * 3000 + end for end in ("", "a", "b", "ab")} | {"x𝄞y", "x𝄞", "xy", "x𝄞𝄞y", "<ab", ">ab"}
    return {w: rng.choice([1, 1, 5, 5, 30, 200, 2000]) for w in sorted(made)}


def test_near_words_and_forms(spark, words):
    table = spark.createDataFrame([*words.items(), (None, 9)], "word string, n int")
    near = {w: sorted((v for v in words if one_edit(w, v)), key=lambda v: (-words[v], v.encode())) for w in words}
    got = [(r["word"], r["near"], r["near_n"]) for r in spelling.near_words(table).collect()]
    assert sorted(got) == sorted((w, v, words[v]) for w in words for v in near[w])

    def form(w):
        return near[w][0] if near[w] and words[near[w][0]] >= 5 * words[w] else None

    def root(w):
        return root(form(w)) if form(w) else w

    expected = {(w, form(w), root(w), n, len(near[w]), words[form(w)] if form(w) else None) for w, n in words.items()}
    rows = spelling.variants(table).collect()
    assert len(rows) == len(words) and {tuple(r) for r in rows} == expected


def test_no_words(spark):
    nothing = spark.createDataFrame([], "word string, n long")
    assert spelling.near_words(nothing).count() == 0
    assert spelling.variants(nothing).columns == ["word", "form", "root", "n", "n_near", "form_n"] and spelling.variants(nothing).count() == 0
    single = spelling.variants(spark.createDataFrame([("lonely", 7)], "word string, n long"))
    assert [tuple(r) for r in single.collect()] == [("lonely", None, "lonely", 7, 0, None)]


def test_occurrences(spark):
    docs = spark.createDataFrame([(1, "Ab÷cÉ d-ÀZ1ſ", 2, 3), (1, None, 2, 3), (None, "É" * 5000, 2, 3), (2, "", 2, 3)], "doc_id long, text string, run int, word int")
    got = Counter((r["id"], r["run"]) for r in spelling.occurrences(docs).collect())
    assert got == Counter([(1, "ab÷cÉ"), (1, "d"), (1, "Àz"), (None, "É" * 5000)])


@needs_tables
def test_words_of_the_query(spark):
    counts = Counter()
    for row in read_table(spark, SF_DIR, "documents").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", row["text"] or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{row['doc_id']}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    got = {r["word"]: r["n"] for r in registry.op11_spelling_variants(spark, SF_DIR).collect()}
    assert got == {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


# Fingerprints


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def prose(seed, words):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(words))


SCHEMA = "doc_id long, text string, id int, block int, tail int, fingerprint string, rep int, band int, lead int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, "f", 4, 5, 6) for i, t in rows], SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def texts():
    base = prose(1, 400)
    rows = [(1000 + k, prose(100 + k, random.Random(k).randint(1, 60))) for k in range(900)]
    return rows + [
        (5, base), (6, base.replace(" ", "\n\t")), (7, base + " more words at the very end"), (8, prose(2, 100) + " " + base[: len(base) // 2]), (None, base),
        (20, None), (21, ""), (22, " \n "), (30, "one"), (31, "one"), (32, "one two"), (33, "É𝄞 ß"), (40, prose(3, 60_000)), (41, "z" * 300_000), (5000, base),
    ]


def test_fingerprints(spark, texts):
    prepared(spark)
    assert len(minhash._bounds(frame(spark, texts), "doc_id")) >= 5
    got = {r["id"]: r for r in minhash.fingerprints(frame(spark, texts)).collect()}
    order = sorted(texts, key=lambda row: (row[0] is not None, row[0] or 0))
    assert len(got) == len(order)
    errors = []
    for (ident, text), (after, follow) in zip(order, order[1:] + order[:1]):
        text, follow = text or "", follow or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + follow[:cut]
        row = got[ident]
        assert (row["n_chars"], row["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert row["edited_fingerprint"] == minhash.signatures([edited.encode()])[0].tobytes()
        same = sum(a == b for a, b in zip(got[ident]["fingerprint"], got[after]["fingerprint"])) / minhash.PERMUTATIONS
        assert row["near_next"] == pytest.approx(max(0, (same - 1 / 256) / (255 / 256)))
        errors.append(row["near_edited"] - jaccard(shingle_set(text), shingle_set(edited)))
    assert max(map(abs, errors)) < 0.25 and abs(sum(errors) / len(errors)) < 0.01
    assert got[5]["fingerprint"] == got[6]["fingerprint"] == got[None]["fingerprint"] == got[5000]["fingerprint"] != got[8]["fingerprint"]
    assert got[20]["fingerprint"] == got[21]["fingerprint"] == got[22]["fingerprint"]


def test_fingerprints_of_few_rows(spark):
    assert minhash.fingerprints(frame(spark, [])).count() == 0
    (single,) = minhash.fingerprints(frame(spark, [(1, "a b c d e f")])).collect()
    assert single["near_next"] == 1.0
    twice = minhash.fingerprints(frame(spark, [(1, "a b"), (1, "a b"), (1, None)])).collect()
    assert sorted(r["n_chars"] for r in twice) == [0, 3, 3]
    blank = minhash.fingerprints(frame(spark, [(None, None), (None, "")])).collect()
    assert [(r["n_chars"], r["near_edited"], r["near_next"]) for r in blank] == [(0, 1.0, 1.0)] * 2


def classes(found):
    groups = defaultdict(set)
    for r in found.collect():
        groups[r["class_id"]].add(r["id"])
    return {k: v for k, v in groups.items() if len(v) > 1}


def test_near_copies_of_a_large_group(spark):
    """A band with three hundred members of two kinds, and copies of each."""
    base, other = prose(5, 300), prose(6, 30)
    half = " ".join(base.split()[:200]) + " " + prose(7, 100)
    rows = []
    for k in range(300):
        words = (base if k % 3 else half).split()
        words[(k * 7) % 300] = f"w{k}"
        rows.append((k, " ".join(words)))
    rows += [(900, other), (901, other), (902, None), (903, ""), (None, base), (904, "x"), (905, "x")]
    docs = frame(spark, rows)
    found = classes(minhash.near_copies(docs, stored(minhash.fingerprints(docs), "marks")))
    assert found == {0: set(range(0, 300, 3)), 1: {k for k in range(300) if k % 3}, 900: {900, 901}, 904: {904, 905}}
    nothing = frame(spark, [])
    assert minhash.near_copies(nothing, minhash.fingerprints(nothing)).count() == 0


@pytest.mark.parametrize("hot, part", [(1, 2048), (3, 2048), (3, 4)])
def test_near_copies_of_many_kinds_in_one_band(spark, monkeypatch, hot, part):
    """Seven kinds of near copies that share ``hot`` bands only; every pair but the first meets behind another's smallest."""
    monkeypatch.setattr(minhash, "PART", part, raising=False)
    docs, marks, rng = [], [], random.Random(9)
    common = rng.randbytes(hot * minhash.PLACES)
    for kind in range(7):
        text, own = prose(200 + kind, 200), rng.randbytes(minhash.PERMUTATIONS - len(common))
        for copy in range(3):
            print_ = bytearray(common + own)
            for band in range(hot, minhash.BANDS):
                print_[band * minhash.PLACES + copy] ^= (copy > 0)
            docs.append((10 * kind + copy, text + " and one end" * copy))
            marks.append((10 * kind + copy, bytes(print_)))
    table = spark.createDataFrame(marks, "id long, fingerprint binary").repartition(3)
    assert classes(minhash.near_copies(frame(spark, docs), table)) == {10 * k: {10 * k, 10 * k + 1, 10 * k + 2} for k in range(7)}


@needs_tables
def test_near_copies_against_all_pairs(spark):
    docs = {r["doc_id"]: shingle_set(r["text"]) for r in read_table(spark, SF_DIR, "documents").collect()}
    pairs = {(a, b) for a in docs for b in docs if a < b and docs[a] and docs[a] & docs[b] and jaccard(docs[a], docs[b]) >= 0.8}
    label = {d: d for d in docs}
    for a, b in sorted(pairs):
        old, new = sorted((label[a], label[b]), reverse=True)
        label = {d: new if x == old else x for d, x in label.items()}
    got = {r["doc_id"]: r["class_id"] for r in registry.op12_minhash_fingerprints(spark, SF_DIR).collect()}
    assert len(got) == len(docs) and pairs
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.95 * len(pairs)
    assert all(label[d] == label[got[d]] for d in docs)  # nothing else is put together


# Conversation tries


def trie_of(conversations):
    """conv_id -> turns, as the contract says, by brute force."""
    members = defaultdict(list)
    for conv, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
    children = Counter(node[:-1] for node in members if node)
    leaves, saved = Counter(), Counter()
    for node, convs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(convs) - 1) * len(node[-1][1].encode()) if node else 0
    rows = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(conversations[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        rows.append((min(convs), len(node), parent, len(convs), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    plain = {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in plain.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = plain.get(c - c % 5, [])[:h] + turns[h:]
    return out


def check_trie(spark, rows, graft=True):
    table = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "conv_id long, turn int, role string, text string, path int, shard int, bone string").repartition(3)
    paths = prefix_trie.paths(table)
    got = prefix_trie.trie(prefix_trie.grafted(paths, 5, 9) if graft else paths)
    assert got.columns == COLUMNS
    made = rebuilt(rows)
    if not graft:
        own = defaultdict(list)
        for conv, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1])):
            own[conv].append((role, text))
        made = own
    assert sorted((tuple(r) for r in got.collect()), key=str) == trie_of(made)


def test_trie_of_odd_conversations(spark):
    check_trie(spark, [])
    check_trie(spark, [(7, None, None, None)])
    rows = [(None, 1, "user", "lost"), (3, 0, "user", "a"), (3, None, "system", None), (3, 1, "", "é"), (4, 0, "user", ""), (9, 1, None, "x"), (9, 2, "user", "x" * 100_000)]
    rows += [(5, k, "user" if k % 2 else "assistant", f"turn {k % 3}") for k in range(300)] + [(6, k, "user", "same") for k in range(12)]
    check_trie(spark, rows)


def test_trie_of_hot_conversations(spark):
    """A third of all conversations are the same, another third share 20 turns, one path is the start of many."""
    rng = random.Random(4)
    rows = []
    for c in range(1200):
        kind = c % 3
        turns = ["same"] * 4 if kind == 0 else [f"t{k}" for k in range(20)] + [rng.choice("abc") for _ in range(3)] if kind == 1 else [rng.choice("xy") for _ in range(rng.randint(1, 8))]
        rows += [(c, k, "user", t) for k, t in enumerate(turns)]
    check_trie(spark, rows, graft=False)
    check_trie(spark, rows)


def test_splitters_cut_equal_paths(spark):
    rows = [(c, k, "user", "same") for c in range(900) for k in range(3)]
    paths = prefix_trie.paths(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    cuts = prefix_trie._splitters(paths)
    assert len(cuts) > 5 and all(len(keys) == 3 and conv >= 0 for keys, conv in cuts)
    assert [r["n_convs"] for r in prefix_trie.trie(paths).collect()] == [900] * 4


# Names that operators of the pipeline use inside


def test_columns_of_any_name_pass_through(spark):
    from tillwise.llm import jaccard_join, line_crf

    prepared(spark)
    names = ["__s1", "__s2", "__id", "__k1", "__quality", "quality", "s1", "s2", "id", "k1", "row", "c0", "text2"]
    base = prose(8, 120)
    docs = [(1, base), (2, base + " more"), (3, None), (4, prose(9, 80)), (None, "x y")]
    table = spark.createDataFrame([(i, t, *range(len(names))) for i, t in docs], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    kept = jaccard_join.deduplicate(table)
    assert kept.columns == table.columns and {r["doc_id"] for r in kept.collect()} == {1, 3, 4, None}
    assert {tuple(r)[2:] for r in kept.collect()} == {tuple(range(len(names)))}
    labels = spark.createDataFrame([(1, 1, 5), (4, 0, 5)], "doc_id long, quality int, text int")
    assert line_crf.fit(table, labels) is not None
