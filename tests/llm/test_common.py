import pyarrow as pa
from pyspark.sql import functions as F

from gristmill.llm.common import LONGEST_REMEMBERED, Remembered, map_rows
from gristmill.session import BATCH_BYTES


def test_a_worker_remembers_for_one_function_only():
    one, other = Remembered(len), Remembered(len)
    assert [one[b"a"], one[b"bc"], len(one)] == [1, 2, 2]
    assert other[b"a"] == 1 and not one and len(other) == 1
    assert one[b"a"] == 1 and not other


def test_long_words_are_not_remembered():
    one = Remembered(len)
    assert one[b"x" * (LONGEST_REMEMBERED + 1)] == LONGEST_REMEMBERED + 1 and not one


def test_batches_for_python_and_back_are_small(spark):
    """10,000 rows of 2 KB came as one batch of 20 MB, and a block's results went back as one."""
    rows = spark.range(0, 20_000, 1, 1).select("id", F.repeat(F.lit("x"), 2_000).alias("text"))
    whole = map_rows(rows, "id long, n long", lambda held: ((i, j) for i, _ in held for j in range(10)))

    def rows_of(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "size": [batch.nbytes]})

    sizes = rows.mapInArrow(rows_of, "n long, size long").collect()
    assert sum(r["n"] for r in sizes) == 20_000 and max(r["size"] for r in sizes) < 2 * BATCH_BYTES
    assert whole.count() == 200_000 and whole.distinct().count() == 200_000
