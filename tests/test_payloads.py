"""JSON objects with keys put and dropped, against dictionaries."""

import json

from pyspark.sql import functions as F

from siftwork.functions import payloads


def test_merged_equals_dictionaries(spark):
    bodies = ['{"z": 1, "a": {"x": [1, 2.5, null], "b": true}, "é \\"q\\"": "t\\n", "timings": 3}', "{}", None, "[1]", "oops", '{"a": 12345678901234567890, "timings": null}', '"text"', '{"k": "v", "none": null}']
    rows = spark.createDataFrame([(i, b, None if i % 2 else f'{{"ms": {i}}}') for i, b in enumerate(bodies)], "i int, body string, ms string")
    out = rows.select(
        "i",
        payloads.merged(F.col("body"), {"timings": F.col("ms"), "new": F.lit('"n"')}).alias("put"),
        payloads.merged(F.col("body"), {"timings": F.col("ms")}, skip_nulls=True).alias("skipped"),
        payloads.merged(F.col("body"), {}, drop=("timings", "a", "missing")).alias("dropped"),
    )
    for r in out.collect():
        try:
            old = json.loads(bodies[r["i"]])
        except (TypeError, ValueError):
            old = {}
        old = old if isinstance(old, dict) else {}
        ms = None if r["i"] % 2 else {"ms": r["i"]}
        for got, want in ((r["put"], old | {"timings": ms, "new": "n"}), (r["skipped"], old if ms is None else old | {"timings": ms}), (r["dropped"], {k: v for k, v in old.items() if k not in ("timings", "a")})):
            assert json.loads(got) == want and list(json.loads(got)) == list(want), got
