"""Deep pages by an order-statistic index, searches by an index of text pieces, and even parts of a database table."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tillwise.operators.listing import filtered, page_rows
from tillwise.operators.paging import block_of_pages, page_index, seek_page
from tillwise.operators.text_index import candidates, grams_of, like_rows, text_index
from tillwise.sources.readers import JOINED_IDS, even_predicates, sample_query, split_columns


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(2)
    made = [(k, rng.choice([None, "a", "b", "c", "c", "c", "d"]), rng.choice([None, 1.5, 2.5, rng.random()])) for k in range(1, 1201)]
    rng.shuffle(made)
    return spark.createDataFrame(made, "id long, name string, value double").repartition(5)


@pytest.mark.parametrize("field, direction", [("name", "asc"), ("name", "desc"), ("value", "asc"), ("value", "desc"), ("id", "desc"), ("id", "asc")])
def test_pages_are_those_of_the_sorted_listing(log, field, direction):
    index = page_index(log, field, direction, block_rows=100)
    assert (index.total_rows, index.blocks) == (1200, 12)
    for page, size in ((1, 10), (7, 15), (40, 30), (3, 350), (120, 10), (121, 10), (4, 100)):
        got, last = seek_page(log, index, page, size)
        assert rows(got) == rows(page_rows(log, field, direction, page, size)), (page, size)
        assert last == -(-1200 // size)


def test_a_deep_page_sorts_one_block(spark):
    many = spark.range(0, 1_000_000).select((F.col("id") * 7919 % 1_000_003).alias("id"), (F.col("id") % 1000).alias("kind"))
    index = page_index(many, "kind", "asc", block_rows=1000)
    first = (10_000 - 1) * 10
    assert block_of_pages(many, index, first, first + 9).count() == 1000
    assert rows(seek_page(many, index, 10_000, 10)[0]) == rows(page_rows(many, "kind", "asc", 10_000, 10))


def test_pages_of_nothing(spark):
    nothing = spark.createDataFrame([], "id long, name string")
    index = page_index(nothing, "name", "asc")
    got, last = seek_page(nothing, index, 1, 10)
    assert (rows(got), last, index.blocks) == ([], 0, 0)


def test_searches_find_what_the_filter_finds(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab" * 8 + "é_%") for _ in range(rng.randint(0, 30))) for _ in range(700)] + [None, "", "ab"]
    table = spark.createDataFrame([(k * 97 - 5000, t) for k, t in enumerate(texts)], "id long, text string")
    index = text_index(table, "text").cache()
    source = next(t for t in texts if len(t or "") > 25)
    for size in range(1, 21):
        value = source[2 : 2 + size]
        assert rows(like_rows(table, index, "text", value), "id") == rows(filtered(table, [("text", "like", value)]), "id"), value
    plain = next(t for t in texts if t and "abab" in t)
    assert candidates(table, index, "abab").count() < table.count() and rows(candidates(table, index, plain[:1])) == rows(table)


def test_grams_between_wildcards():
    assert grams_of("abcd") == ["abc", "bcd"] and grams_of("ab%cd_efg") == ["efg"] and grams_of("ab") == []
    assert grams_of("a\\%b") == ["a%b"] and grams_of("") == []


def in_part(predicate, value):
    """Evaluate one of the generated conditions."""
    if predicate == "1 = 1":
        return True
    parts = predicate.split(" OR ")
    if len(parts) == 2 and value is None:
        return True
    if value is None:
        return False
    return all({"<": value < int(n), ">=": value >= int(n)}[op] for _, op, n in (c.split(" ") for c in parts[0].split(" AND ")))


@pytest.mark.parametrize("parts", [1, 4, 32])
def test_parts_hold_every_row_once_and_are_even(parts):
    rng = random.Random(parts)
    crowded = [int(rng.paretovariate(0.4) * 1000) for _ in range(60_000)]
    ids = [i + rng.randint(0, 10**6) * (i > 10**5) for i in crowded]
    sample = rng.sample(ids, 8000)
    predicates = even_predicates("id", [*sample, None], parts)
    held = [sum(in_part(p, i) for i in ids) for p in predicates]
    assert all(sum(in_part(p, i) for p in predicates) == 1 for i in [*rng.sample(ids, 500), None, -5, 10**12, min(ids), max(ids)])
    assert sum(held) == len(ids) and len(predicates) == parts
    assert max(held) < 2 * len(ids) / parts and min(held) > len(ids) / parts / 2


def test_parts_of_odd_samples():
    assert even_predicates("id", [], 8) == ["1 = 1"] and even_predicates("id", [5, 5, 5], 8) == ["1 = 1"]
    assert even_predicates("id", [1, 2], 8) == ["id < 2 OR id IS NULL", "id >= 2"]
    assert sample_query("t", "id", 3, 2_000_003, 1000) == "(SELECT id AS id FROM t WHERE MOD(id, 2000) = 3) sample"
    assert sample_query("t", "id", 3, 9) == "(SELECT id AS id FROM t WHERE MOD(id, 1) = 0) sample"


def test_every_table_with_an_id_is_split():
    columns = split_columns({"ps_orders": "id_cart"})
    assert columns["ps_orders"] == "id_cart" and columns["ps_cart"] == "id_cart" and columns["ps_order_carrier"] == JOINED_IDS["ps_order_carrier"]


def test_a_task_of_the_text_index_holds_few_rows(spark):
    """Rows are dealt out by bucket before they are cut into pieces, so that no task cuts a whole large table."""
    many = spark.range(0, 400_000, 1, 1).select("id", F.concat(F.lit("user"), "id").alias("text"))
    index = text_index(many, "text")
    plan = index._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("RepartitionByExpression")
    cut = index.select(F.spark_partition_id().alias("task"), "id_bucket").distinct().collect()
    assert len({r["task"] for r in cut}) > 1 and len(cut) == len({r["id_bucket"] for r in cut}) == 14
