"""URL verdicts: host words by unigram Viterbi segmentation, then multinomial naive Bayes, below a list of rules.

Word frequencies come from the titles and paths of all pages. Naive Bayes learns from all pages whose segmented
host holds a word of ``BLOCK_WORDS`` (blocked) or none (allowed); its token counts are kept in ``BUCKETS`` hash buckets,
so the model has one size whatever the corpus. The longest fitting rule overrides it.

Defined cases: a NULL url or one without ``://`` has an empty host and path, no rule, and is judged by the class shares
alone; repeated rows get equal verdicts; other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.storage import stored

#: Size of the word model (the most frequent words) and of the classifier.
VOCABULARY, BUCKETS = 50_000, 1 << 16
LONGEST_WORD = 24
SMOOTHING = 0.05
#: Words that make a host an example of a blocked one.
BLOCK_WORDS = frozenset(
    "ads adult bet bets betting casino cheap escort farm free gambling loan loans lottery malware phishing pills poker porn "
    "sex spam track tracker viagra warez win xxx".split()
)
#: rule: block or allow. A rule fits its host with all subdomains, for paths that begin with its own.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}

_PARTS = re.compile(r"[^a-z0-9]+")


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits, else NULL."""
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):
        name, at, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(at + rest)
        chosen = F.when(fits, F.lit(rule)).otherwise(chosen)
    return chosen


def word_counts(pages: DataFrame) -> dict[str, int]:
    """The VOCABULARY most frequent words of titles and paths (in hosts, words are run together); counts cover all pages,
    and the seed words are always known."""
    title = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)
    text = F.lower(F.concat_ws(" ", title, path_of(F.col("url"))))
    words = pages.select(F.explode(F.split(text, r"[^\p{L}]+")).alias("word")).filter(f"length(word) BETWEEN 2 AND {LONGEST_WORD}")
    counted = stored(words.groupBy("word").count(), "words")
    # Only words from the size class up that completes the vocabulary are sorted, or each task would send as many as fit.
    size = F.floor(F.log2("count")).cast("int")
    classes = sorted(counted.groupBy(size.alias("size")).agg(F.count("*").alias("words")).collect(), reverse=True)
    above = list(itertools.accumulate(r["words"] for r in classes))
    least = next((r["size"] for r, n in zip(classes, above) if n >= VOCABULARY), 0)
    top = counted.filter(size >= least).orderBy(F.desc("count"), "word").limit(VOCABULARY).collect()
    counts = {r["word"]: r["count"] for r in top}
    typical = max(1, int(np.median(list(counts.values()) or [1])))
    return {w: typical for w in BLOCK_WORDS} | counts


def segmenter(counts: dict[str, int]) -> Callable[[str], tuple[str, ...]]:
    """The most probable split of a name into words; an unknown word is the less likely the longer it is."""
    total = sum(counts.values()) or 1
    cost = {w: -math.log(n / total) for w, n in counts.items()}
    unknown = [math.log(total) + k * math.log(20) for k in range(LONGEST_WORD + 1)]

    @lru_cache(100_000)
    def split(name: str) -> tuple[str, ...]:
        best, start = [0.0], [0]
        for end in range(1, len(name) + 1):
            options = []
            for begin in range(max(0, end - LONGEST_WORD), end):
                part = name[begin:end]
                options.append((best[begin] + cost.get(part, unknown[end - begin]), begin))
            value, begin = min(options)
            best.append(value)
            start.append(begin)
        words, end = [], len(name)
        while end:
            words.append(name[start[end] : end])
            end = start[end]
        return tuple(reversed(words))

    return split


def tokens(split: Callable[[str], tuple[str, ...]], host: str, path: str) -> tuple[list[str], list[str]]:
    """Words of the host and of the path; numbers all count as one word."""
    found = []
    for text in (host, path.lower()):
        parts = [p for p in _PARTS.split(text) if p]
        found.append(["0" if p.isdigit() else w for p in parts for w in ((p,) if p.isdigit() else split(p))])
    return found[0], found[1]


def bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


@dataclass
class Classifier:
    counts: dict[str, int]
    odds: np.ndarray
    prior: float

    def score(self, words: list[str]) -> float:
        """Log odds of blocking."""
        return self.prior + sum(float(self.odds[bucket(w)]) for w in words)


def train(pages: DataFrame) -> Classifier:
    """Word model and classifier over all ``pages`` (``url``, ``html``)."""
    counts = word_counts(pages)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = segmenter(counts), Counter()
        for batch in batches:
            for host, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                in_host, in_path = tokens(split, host, path)
                kind = int(not BLOCK_WORDS.isdisjoint(in_host))
                seen[kind, -1] += 1
                seen.update((kind, bucket(w)) for w in in_host + in_path)
        keys = list(seen)
        yield pa.RecordBatch.from_pydict(
            {
                "kind": pa.array([k for k, _ in keys], pa.int32()),
                "bucket": pa.array([b for _, b in keys], pa.int32()),
                "n": pa.array([seen[k] for k in keys], pa.int64()),
            }
        )

    urls = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    found = urls.mapInArrow(count, "kind int, bucket int, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).collect()
    table, docs = np.full((2, BUCKETS), SMOOTHING), np.ones(2)
    for word in BLOCK_WORDS:
        table[1, bucket(word)] += 1
    for kind, at, n in found:
        if at < 0:
            docs[kind] += n
        else:
            table[kind, at] += n
    shares = np.log(table / table.sum(1, keepdims=True))
    return Classifier(counts, shares[1] - shares[0], math.log(docs[1] / docs[0]))


def judge(pages: DataFrame, model: Classifier, rules: dict[str, str] = RULES, id_col: str = "page_id") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, and the classifier's ``host_words`` and ``score``."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"), rule_of(host, path, rules).alias("rule"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = segmenter(model.counts)
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            words, scores = [], []
            for h, p in zip(hosts, paths):
                in_host, in_path = tokens(split, h, p)
                words.append(" ".join(in_host))
                scores.append(model.score(in_host + in_path))
            names = [*batch.schema.names, "host_words", "score"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words, pa.string()), pa.array(scores, pa.float64())], names)

    scored = source.mapInArrow(run, "page_id long, host string, path string, rule string, host_words string, score double")
    ruled = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        ruled = F.when(F.col("rule") == rule, verdict).otherwise(ruled)
    return scored.withColumn("verdict", F.coalesce(ruled, F.when(F.col("score") > 0, "block").otherwise("allow")))
