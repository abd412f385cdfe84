"""Spelling variants of words: near words by a frontier that walks a trie of all words, kept as a table of edges.

Two words are near when one inserted, deleted or replaced code point turns one into the other. All words are put into one
trie twice, forwards and backwards, under a mark of their own. A state (word, position, node, edits) says that the word's
first ``position`` code points have led to ``node`` with ``edits`` edits. Each round builds the edges of one level with one
aggregation, joins them with the states, and writes the states of the next level; a state that has used up its word at the
end of another word, with one edit, is a pair of near words.

An edge holds all code points up to the next fork, so there are as many rounds as there are forks on a path, not letters.
A forward state makes edits from the middle of its word on, a backward one in the other half: near the root, where every
node has all letters below it, no state forks.

A node through which more than ``1 / HOT_NODES`` of all words pass is served from a broadcast of fewer than ``HOT_NODES``
rows of bounded size; the other states are joined by shuffle, where AQE splits what is still uneven.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.storage import discard, prepared, stored

#: Runs of Latin letters.
LETTERS = "[A-Za-zÀ-ÿ]+"
#: A variant's form is a near word that occurs at least so many times as often.
FORM_TIMES = 5
HOT_NODES = 1000
#: Longer lists of edges (code points in all labels) are not broadcast.
HOT_LABELS = 4096
_MARKS = {True: ">", False: "<"}


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = LETTERS) -> DataFrame:
    """``id`` and ``run``, one row for every match of ``pattern``, with only A-Z lower-cased. NULL texts have none."""
    found = F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(pattern), F.lit(0))
    runs = docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(found).alias("run"))
    return runs.withColumn("run", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def counted(occurrences: DataFrame, column: str, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """``word`` and ``n``: the distinct values of ``column`` with so many code points and occurrences."""
    long = occurrences.select(F.col(column).alias("word")).filter(F.length("word") >= least_length)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def _upto(text: Column, length: Column) -> Column:
    return F.substr(text, F.lit(1), length)


def _from(text: Column, place: Column) -> Column:
    return F.substr(text, place + 1)


def _common(a: Column, b: Column) -> Column:
    """Number of code points that ``a`` and the later ``b`` start with alike."""
    differ = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~x.eqNullSafe(y))
    first = F.array_position(differ, True)
    return F.when(first == 0, F.length(a)).otherwise(first - 1).cast("int")


def _letter() -> Column:
    """The first code point of a state's word that is not used yet; empty at its end."""
    return F.substr("word", F.col("pos") + 1, F.lit(1))


def _level(at: DataFrame) -> DataFrame:
    """The edges below the nodes that words have come to without an edit.

    Of the words behind one letter, the first and the last in order tell what all have in common: the ``label``. ``edge_n``
    is the ``n`` of the word that ends there, if one does; a ``leaf`` has no edges below.
    """
    ahead = at.filter(F.col("pos") < F.length("word"))
    groups = ahead.groupBy(_upto(F.col("word"), F.col("pos")).alias("node"), "pos", _letter().alias("letter")).agg(
        F.min(F.struct("word", "n")).alias("low"), F.max("word").alias("high"), F.count(F.lit(1)).alias("passing")
    )
    low, size = F.col("low.word"), F.col("reach") - F.col("pos")
    return groups.withColumn("reach", _common(low, F.col("high"))).select(
        "node", "letter", F.substr(low, F.col("pos") + 1, size).alias("label"), size.alias("size"),
        F.when(F.length(low) == F.col("reach"), F.col("low.n")).alias("edge_n"), "passing",
    )


def _with_next(edges: DataFrame, below: DataFrame) -> DataFrame:
    """``edges`` with ``next``: the letters that their lower ends have edges for, in one text as long as an alphabet."""
    letters = below.groupBy(F.col("node").alias("end")).agg(F.array_join(F.collect_list("letter"), "").alias("next"))
    return edges.withColumn("end", F.concat("node", "label")).join(letters, "end", "left").drop("end")


def _moved(found: DataFrame, used: Column, edits: int) -> DataFrame:
    """The states behind an edge; those with an edit that can't get any further or anywhere are left out.

    ``near_n`` is set where the node is a word that is near: one edit was made and the word is used up, or none was made
    and one code point of the word is left over.
    """
    pos = F.col("pos") + used
    left = F.length("word") - pos
    near = F.col("edge_n").isNotNull() & (left == 1 - edits)
    goes_on = F.contains(F.col("next"), F.substr("word", pos + 1, F.lit(1))) & (left > 0) if edits else F.col("passing") > 1
    return found.filter(near | goes_on).select(
        "word", *([] if edits else ["n"]), F.concat("node", "label").alias("node"), pos.alias("pos"), F.when(near, F.col("edge_n")).alias("near_n")
    )


def _same_edge(states: DataFrame) -> DataFrame:
    return states.filter(F.startswith(_from(F.col("word"), F.col("pos")), F.col("label")))


def _followed(at: DataFrame, edges: DataFrame, hot: DataFrame) -> DataFrame:
    """Words at the next node of their own. The edges that many of them take are broadcast."""
    key = ["node", "letter"]
    at = at.filter(F.col("pos") < F.length("word")).withColumn("letter", _letter()).drop("near_n")
    cold = at.join(F.broadcast(hot.select(*key)), key, "left_anti").join(edges, key)
    return _moved(_same_edge(at.join(F.broadcast(hot), key).unionByName(cold)), F.col("size"), 0)


def _gone_on(once: DataFrame, edges: DataFrame) -> DataFrame:
    """Where states with an edit behind them come to: the rest of the word has to be there as it is."""
    ahead = once.filter(F.col("pos") < F.length("word")).withColumn("letter", _letter()).drop("near_n")
    return _moved(_same_edge(ahead.join(edges, ["node", "letter"])), F.col("size"), 1)


def _edited(at: DataFrame, edges: DataFrame) -> DataFrame:
    """What words become along the other edges of their nodes, by one edit.

    Where two near words part there is a fork, so that is the only place to make the edit; the rest of the label has to go
    on as the word does after it.
    """
    half = at.filter(F.col("pos") - 1 >= F.floor((F.length("word") - 1) / 2)).select("word", "node", "pos")
    found = half.join(edges, "node").filter(F.col("letter") != _letter())
    rest, tail, left = _from(F.col("word"), F.col("pos")), _from(F.col("label"), F.lit(1)), F.length("word") - F.col("pos")
    replaced = F.when((left >= F.col("size")) & F.startswith(_from(rest, F.lit(1)), tail), F.col("size"))
    inserted = F.when((left >= F.col("size") - 1) & F.startswith(rest, tail), F.col("size") - 1)
    deleted = F.when((left > F.col("size")) & F.startswith(_from(rest, F.lit(1)), F.col("label")), F.col("size") + 1)
    return _moved(found.withColumn("used", F.explode(F.array(replaced, inserted, deleted))).filter("used IS NOT NULL"), F.col("used"), 1)


def near_words(words: DataFrame) -> DataFrame:
    """``word``, ``near`` and ``near_n``: all pairs of near words of ``words`` (distinct ``word``, ``n``), in both directions."""
    spark = prepared(words.sparkSession)

    def marked(forward: bool) -> DataFrame:
        text = F.col("word") if forward else F.reverse("word")
        return words.filter("word IS NOT NULL").select(
            F.concat(F.lit(_MARKS[forward]), text).alias("word"), F.col("n").cast("long").alias("n"), F.lit("").alias("node"),
            F.lit(0).alias("pos"), F.lit(None).cast("long").alias("near_n"),
        )

    at = stored(marked(True).unionByName(marked(False)), "at")
    once = at.drop("n").limit(0)
    edges = stored(_level(at), "edges")
    limit = at.count() / HOT_NODES
    found = []
    while True:
        hot = edges.filter((F.col("passing") > limit) & (F.col("size") <= HOT_LABELS))
        after = stored(_followed(at, edges, hot), "at")
        below = stored(_level(after), "edges")
        ahead = _with_next(edges, below)
        states = stored(_gone_on(once, ahead).unionByName(_edited(at, ahead)), "once")
        pairs = after.drop("n").unionByName(states).filter("near_n IS NOT NULL AND left(word, 1) = left(node, 1)")
        found.append(stored(pairs.select("word", F.col("node").alias("near"), "near_n"), "near"))
        discard(spark, at, edges, once)
        at, edges, once = after, below, states.filter("near_n IS NULL")
        if at.isEmpty() and once.isEmpty():
            break
    discard(spark, at, edges, once)
    forward = F.left("word", F.lit(1)) == _MARKS[True]

    def plain(column: str) -> Column:
        text = _from(F.col(column), F.lit(1))
        return F.when(forward, text).otherwise(F.reverse(text)).alias(column)

    both = reduce(DataFrame.unionByName, found).select(plain("word"), plain("near"), "near_n")
    return both.groupBy("word", "near").agg(F.max("near_n").alias("near_n"))


def variants(words: DataFrame) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` for each of ``words`` (distinct ``word``, ``n``).

    The form is the near word with the largest ``n`` (of equal ones the first in code-point order) where that is at least
    ``FORM_TIMES`` the word's own, else NULL. The root is the last word reached by following forms; since each form is more
    frequent than the word before it, there is one. A NULL word is left out; an empty table gives no rows.
    """
    spark = prepared(words.sparkSession)
    words = stored(words.filter("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n")), "words")
    best = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    is_form = -F.col("best.n") >= FORM_TIMES * F.col("n")
    formed = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"),
        F.when(is_form, -F.col("best.n")).alias("form_n"),
    )
    formed = stored(formed, "formed")
    steps = stored(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    going = not steps.isEmpty()
    while going:  # each round doubles the length of the steps
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = stored(steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(spark, steps)
        steps, going = further.select("word", "root"), not further.filter("moved").isEmpty()
    return formed.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
