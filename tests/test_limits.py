import random

from siltstone.streaming import limits


def test_stretches_are_dealt_apart_and_equal_the_fold(spark):
    rng = random.Random(7)
    rows = [(rng.choice([0, 0, 0, 1, 2, None]), k, float(rng.randint(0, 900))) for k in range(1500)] + [(1, 2000, None), (1, 2001, None), (3, 2002, 5.0), (3, 2002, 5.0)]
    calls = spark.createDataFrame(rows, "client long, id long, at double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for most, seconds in ((2, 3), (3, 60), (1, 1)):
            df = limits.rate_limit(calls, most, seconds)
            want = []
            for c in {c for c, *_ in rows}:
                own = sorted([(t if t is not None else float("inf"), k) for x, k, t in rows if x == c])
                times = [t if t != float("inf") else float("nan") for t, _ in own]
                want += [(c, k, p) for (_, k), p in zip(own, limits.admitted(times, [], most, seconds)[0])]
            assert sorted(((r["client"], r["id"], r["allowed"]) for r in df.collect()), key=repr) == sorted(want, key=repr)
            assert "InPandas" not in df._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
