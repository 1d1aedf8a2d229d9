import collections
import itertools
import random

import pytest

from taufold.operators.merge import merge_fan_out


def plain(left, right):
    """(key, a, b, c) by a nested loop; b is shared and taken from the right."""
    out = collections.Counter()
    for k, a, _ in left:
        found = [(b, c) for key, b, c in right if key is not None and key == k]
        out.update((k, a, b, c) for b, c in found or [(None, None)])
    return out


@pytest.mark.parametrize("cell", [1, 3, 2000])
def test_fan_out_equals_a_nested_loop(spark, cell):
    draw = random.Random(4)
    keys = [1] * 12 + [2, 2, 3, 4, 5, None]
    left = [(draw.choice(keys), draw.choice("xy"), 7) for _ in range(60)] + [(9, "alone", 7), (None, None, 7)]
    right = [(draw.choice(keys), draw.choice([1, 2, None]), draw.choice("pq")) for _ in range(50)] + [(8, 1, "p")]
    found = merge_fan_out(
        spark.createDataFrame(left, "k long, a string, b long"), spark.createDataFrame(right, "k long, b long, c string"), "k", cell
    )
    assert found.columns == ["k", "a", "b", "c"]
    assert collections.Counter(tuple(r) for r in found.collect()) == plain(left, right)


def test_fan_out_of_empty_tables_and_of_one_repeated_row(spark):
    one = spark.createDataFrame([(1, "x")] * 25, "k long, a string")
    two = spark.createDataFrame([(1, "y")] * 30, "k long, b string")
    assert merge_fan_out(one, two, "k", 4).groupBy("k", "a", "b").count().collect() == [(1, "x", "y", 750)]
    none = two.filter("k > 1")
    assert collections.Counter(tuple(r) for r in merge_fan_out(one, none, "k").collect()) == {(1, "x", None): 25}
    assert list(itertools.chain(merge_fan_out(one.filter("k > 1"), two, "k").collect())) == []
