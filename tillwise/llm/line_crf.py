"""Quality rules: a linear-chain conditional random field marks the lines of a text as content or boilerplate.

The field is trained here on a bounded sample of labelled documents. Their lines take the document's label at first; a
fit without moves between lines then decides which lines of bad documents are content after all, and the field is
trained on these marks.
Viterbi decoding marks all lines of all texts; a text is kept if content lines hold at least ``CONTENT_SHARE`` of its
word characters and the base rules hold.

Defined cases: NULL or empty texts have no words and fail the base rules; lines without a word have no mark; without
labels of both kinds there is no model, every line counts as content and the base rules decide alone. Rows are judged one
by one, so repeated rows and NULL ids get their own verdicts. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.llm.storage import plain_names
from tillwise.llm.words import Batch, batches, span_hashes

#: The field is trained on so many labelled documents at most, those with the smallest id hashes.
TRAINING_DOCS = 2000
CONTENT_SHARE = 0.5
BASE_WINDOW = 5
ROUNDS, RATE, RIDGE = 200, 0.1, 1e-4

# The symbols that the base figure n_symbols counts.
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True

FEATURES = ("bias", "symbols", "capitals", "digits", "exclamations", "bars", "short", "repeated line", "echoed words", "ends a sentence")

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _per_span(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mask)])
    return sums[ends] - sums[starts]


def _earlier_equal(texts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which items equal an earlier one of the same text."""
    order = np.lexsort((np.arange(len(hashes)), hashes, texts))
    out = np.zeros(len(hashes), bool)
    same = (texts[order][1:] == texts[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    out[order[1:][same]] = True
    return out


@dataclass
class Lines:
    """Lines with a word: their text, features and word characters; and the base figures of each text."""

    text: np.ndarray
    first: np.ndarray
    features: np.ndarray
    chars: np.ndarray
    base: dict[str, np.ndarray]


def describe(batch: Batch) -> Lines:
    data, n = batch.data, len(batch)
    starts, ends, first_line = batch.lines()
    space = np.ones(len(data), bool)
    edges = np.zeros(len(data) + 1, np.int8)
    edges[batch.starts] += 1
    edges[batch.ends] -= 1
    space = np.cumsum(edges[:-1]) == 0
    code_points = ~space & ((data & 0xC0) != 0x80)
    hashes = batch.hashes()

    first_word = np.searchsorted(batch.starts, starts)
    words = np.searchsorted(batch.starts, ends) - first_word
    full = words > 0
    line_text = np.repeat(np.arange(n), np.diff(first_line))[full]
    starts, ends, words, first_word = starts[full], ends[full], words[full], first_word[full]
    repeated = _earlier_equal(line_text, span_hashes(data, starts, ends))
    chars = _per_span(code_points, starts, ends)
    share = lambda mask: _per_span(mask, starts, ends) / np.maximum(chars, 1)
    echo = np.zeros(len(hashes), bool)
    echo[1:] = hashes[1:] == hashes[:-1]
    echo[first_word] = False
    echoes = np.concatenate([[0], np.cumsum(echo)])
    letters = np.maximum(_per_span(_LETTER[data], starts, ends), 1)
    last_word = first_word + words - 1
    final = data[batch.ends[last_word] - 1] if len(words) else np.empty(0, np.uint8)
    features = np.column_stack(
        [
            np.ones(len(words)),
            share(_SYMBOL[data]),
            _per_span(_UPPER[data], starts, ends) / letters,
            share(_DIGIT[data]),
            share(data == ord("!")),
            share(data == ord("|")),
            words < 4,
            repeated,
            (echoes[first_word + words] - echoes[first_word]) / words,
            np.isin(final, [ord("."), ord("?"), ord("!")]),
        ]
    ).astype(np.float64)

    counts = np.diff(batch.first)
    base = {
        "n_words": counts,
        "word_chars": _per_span(code_points, batch.bounds[:-1], batch.bounds[1:]),
        "n_symbols": _per_span(_SYMBOL[data], batch.bounds[:-1], batch.bounds[1:]),
        "n_dup_lines": np.bincount(line_text[repeated], minlength=n),
        "n_repeat_words": _repeated_words(batch, hashes, counts),
    }
    return Lines(line_text, np.searchsorted(line_text, np.arange(n + 1)), features, chars, base)


def _repeated_words(batch: Batch, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Words inside windows of BASE_WINDOW words that the text holds at least twice."""
    n = len(batch)
    windows = batch.windows(hashes, BASE_WINDOW)
    text = np.repeat(np.arange(n), counts)
    at = np.arange(len(hashes))
    valid = at + BASE_WINDOW <= batch.first[1:][text] if len(text) else np.zeros(0, bool)
    at, text, windows = at[valid], text[valid], windows[valid]
    order = np.lexsort((windows, text))
    same = (text[order][1:] == text[order][:-1]) & (windows[order][1:] == windows[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    cover = np.zeros(len(hashes) + 1, np.int64)
    hit = at[order[twice]]
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + BASE_WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return covered[batch.first[1:]] - covered[batch.first[:-1]]


@dataclass
class Field:
    """Scores of a chain: ``weights`` of the features for content (boilerplate has none), ``moves[a, b]`` from state a
    to b; state 1 is content."""

    weights: np.ndarray
    moves: np.ndarray

    def decode(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best states of all chains at once: chains are sorted by length and advance line by line together."""
        states = np.zeros(len(features), np.int8)
        lengths = np.diff(first)
        order = np.argsort(-lengths, kind="stable")
        at = first[:-1][order]
        live = np.searchsorted(-lengths[order], -np.arange(1, lengths.max(initial=0) + 1), side="right")
        emit = features @ self.weights
        back = np.zeros((len(features), 2), np.int8)
        score = np.zeros((len(order), 2))
        for t, k in enumerate(live):
            here = at[:k] + t
            if t:
                through = score[:k, :, None] + self.moves[None]
                back[here] = through.argmax(1)
                score[:k] = through.max(1)
            score[:k, 1] += emit[here]
        best = score.argmax(1)
        for t in range(len(live) - 1, -1, -1):
            here = at[: live[t]] + t
            states[here] = best[: live[t]]
            best[: live[t]] = back[here, best[: live[t]]]
        return states


def train(features: np.ndarray, first: np.ndarray, content: np.ndarray, chained: bool = True) -> Field:
    """Maximum likelihood by gradient steps; forward-backward over all chains at once. ``content``: each line's label;
    without ``chained`` moves stay at zero."""
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    at = first[:-1][order]
    live = np.searchsorted(-lengths[order], -np.arange(1, lengths.max(initial=0) + 1), side="right")
    label = content.astype(np.int64)
    inner = np.ones(len(label), bool)
    inner[first[:-1][lengths > 0]] = False
    seen_moves = np.zeros((2, 2))
    np.add.at(seen_moves, (label[np.flatnonzero(inner) - 1], label[inner]), 1)
    seen = features.T @ label
    size = np.concatenate([np.zeros(features.shape[1]), np.zeros(4)])
    params, first_moment, second = np.zeros_like(size), np.zeros_like(size), np.zeros_like(size)
    for step in range(1, ROUNDS + 1):
        weights, moves = params[:-4], np.exp(params[-4:].reshape(2, 2))
        emit = np.ones((len(label), 2))
        emit[:, 1] = np.exp(np.clip(features @ weights, -30, 30))
        emit /= emit.sum(1, keepdims=True)
        forward, backward = np.zeros((len(label), 2)), np.ones((len(label), 2))
        for t, k in enumerate(live):
            here = at[:k] + t
            value = emit[here] if not t else emit[here] * (forward[here - 1] @ moves)
            forward[here] = value / value.sum(1, keepdims=True)
        expected_moves = np.zeros((2, 2))
        for t in range(len(live) - 2, -1, -1):
            k = live[t + 1]
            here = at[:k] + t
            ahead = emit[here + 1] * backward[here + 1]
            pair = forward[here][:, :, None] * moves[None] * ahead[:, None, :]
            expected_moves += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
            value = ahead @ moves.T
            backward[here] = value / value.sum(1, keepdims=True)
        both = forward * backward
        chance = both[:, 1] / both.sum(1)
        gradient = np.concatenate([seen - features.T @ chance, (seen_moves - expected_moves).ravel()]) / max(len(label), 1)
        gradient -= RIDGE * params
        gradient[-4:] *= chained
        first_moment = 0.9 * first_moment + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        params += RATE * (first_moment / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Field(params[:-4], params[-4:].reshape(2, 2))


def _sample_features(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for record in source:
        for (quality,), batch in batches([record.column(0)], record.column(1)):
            lines = describe(batch)
            rows = [lines.features[a:b].astype("<f4").tobytes() for a, b in zip(lines.first, lines.first[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(quality, pa.int32()), pa.array(rows, pa.binary())], ["quality", "features"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field | None:
    """The field trained on at most TRAINING_DOCS documents of ``labels`` (``doc_id``, ``quality``)."""
    usable = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("quality")).dropna()
    chosen = usable.orderBy(F.xxhash64("id"), "id", "quality").limit(TRAINING_DOCS).dropDuplicates(["id"])
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sample = texts.join(F.broadcast(chosen), "id").select("quality", "text")
    found = sample.mapInArrow(_sample_features, "quality int, features binary").toPandas()
    found = found.sort_values(["quality", "features"], ignore_index=True)
    chains = [np.frombuffer(f, "<f4").reshape(-1, len(FEATURES)).astype(np.float64) for f in found["features"]]
    if not chains or not {0, 1} <= set(found["quality"]):
        return None
    first = np.concatenate([[0], np.cumsum([len(c) for c in chains])])
    features, good = np.concatenate(chains), np.repeat(found["quality"].to_numpy() == 1, np.diff(first))
    alone = train(features, first, good, chained=False)
    return train(features, first, good | (features @ alone.weights > 0))


def _judge(field: Field | None, batch: Batch) -> dict[str, np.ndarray]:
    lines = describe(batch)
    base = lines.base
    total = np.bincount(lines.text, lines.chars, len(batch))
    content = total
    if field is not None:
        content = np.bincount(lines.text, lines.chars * field.decode(lines.features, lines.first), len(batch))
    failed = (base["n_words"] < 10) | (100 * base["n_repeat_words"] > 20 * base["n_words"])
    return base | {
        "content_share": content / np.maximum(total, 1),
        "base_failed": failed,
        "kept": ~failed & (content >= CONTENT_SHARE * total),
    }


JUDGED = T.StructType(
    [T.StructField(c, T.LongType()) for c in BASE]
    + [T.StructField("content_share", T.DoubleType()), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
)


def judge(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the base figures, ``content_share``, ``base_failed`` and ``kept`` of every row."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *JUDGED.fields])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in source:
            for (ids,), batch in batches([record.column(0)], record.column(1)):
                found = _judge(field, batch)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(found[c]) for c in JUDGED.names]], schema.names)

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, schema)


def keep(docs: DataFrame, field: Field | None, text_col: str = "text") -> DataFrame:
    """The rows whose text is kept, with all their columns."""
    text_at = docs.columns.index(text_col)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in source:
            kept = [_judge(field, batch)["kept"] for _, batch in batches([], record.column(text_at))]
            yield record.filter(pa.array(np.concatenate(kept) if kept else [], pa.bool_()))

    return plain_names(docs).mapInArrow(run, docs.schema)
