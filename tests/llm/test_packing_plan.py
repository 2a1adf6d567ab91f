"""The packing plan: every document in one range and every gap in one at most, whatever the sizes; no range grows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from recordloom.llm import packing


def _gaps_of(plan):
    out = Counter()
    for _, _, per, part, many in plan.gaps:
        for k in range(many):
            out[part + k] += per
    return out


def test_every_document_and_gap_has_one_place():
    rng = random.Random(5)
    for _ in range(300):
        counts = {rng.randint(1, 2048): rng.randint(1, 300) for _ in range(rng.randint(1, 40))}
        gaps = {rng.randint(1, 4095): rng.randint(1, 200) for _ in range(rng.randint(0, 40))}
        plan = packing._plan(counts, gaps, rng.choice((1, 5, 40, 1000)), 4096)
        total = sum(counts.values())
        assert sum(k * n for _, k, n, *_ in packing._alike(plan.docs, plan.each, total)) == total
        used = Counter()
        for gap, first, per, part, many in plan.gaps:
            assert per > 0 and many > 0 and first + per * many <= gaps[gap] and part + many <= plan.ranges
            used.update((gap, r) for r in range(first, first + per * many))
        assert all(n == 1 for n in used.values())
        starts = [at for at, _ in plan.opens]
        assert starts[0] == 0 and starts == sorted(set(starts))


def test_left_over_gaps_belong_to_nobody():
    plan = packing._plan({i: 60_000 // 64 for i in range(1, 65)}, {g: 2_500_000 // 64 for g in range(1, 4096, 64)}, 5_000, 4096)
    assert plan.ranges == 11 and max(_gaps_of(plan).values()) <= 5_500


def test_the_plan_does_not_grow_with_the_documents():
    plan = packing._plan({i: 5_000_000 for i in range(1, 2049)}, {g: 5_000_000 for g in range(1, 4096)}, 5_000, 4096)
    assert plan.ranges == 2_048_000 and plan.each == 5_000 and len(plan.docs) + len(plan.gaps) + len(plan.opens) < 20_000


@pytest.mark.parametrize("kind", ["mixed", "one length"])
def test_places_do_not_depend_on_the_number_of_tasks(spark, kind):
    rng, before, found = random.Random(7), spark.conf.get("spark.sql.shuffle.partitions"), []
    lengths = [rng.choice((45, 80, rng.randint(1, 256))) if kind == "mixed" else 60 for _ in range(600)]
    rows = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long").select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), "length", F.lit(0).cast("long").alias("ids_crc32"), F.col("doc_id").alias("row"))
    try:
        for n in (2, 64):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted((r["doc_id"], r["sequence_id"], r["offset"]) for r in packing.fit(rows, 256, 20).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] and len(found[0]) == 600
