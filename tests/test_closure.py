from quadrille.plans import catalogue


def test_closure_over_all_customers(spark):
    """The path queries use every customer: against brute force."""
    keys = [r.c_custkey for r in spark.read.parquet("/root/testdata/sf0.001/customer.parquet").collect()]
    half, want = {k: k // 2 for k in keys}, set()
    for k in keys:
        at = k
        while at in half and (k, half[at]) not in want:
            at = half[at]
            want.add((k, at))
    name = "http://example.org/customer/{}".format
    got = [(r.x, r.y) for r in catalogue.queries()["q_24_plus"](spark, "/root/testdata/sf0.001").collect()]
    assert len(keys) > 60 and sorted(got) == sorted((name(x), name(y)) for x, y in want)
