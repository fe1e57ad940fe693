from weftline.operators.blocks import depths


def test_deep_chains_and_circles(spark):
    rows = [("s", "m", f"b{i}", f"b{i - 1}" if i else None, "quote" if i == 3 else "list") for i in range(200)]
    rows += [("s", "m", "x", "gone", "paragraph"), ("t", "m", "b0", None, "quote"), (None, "m", "p", "q", None), (None, "m", "q", None, "quote")]
    rows += [("c", "m", "u", "v", "list"), ("c", "m", "v", "w", "quote"), ("c", "m", "w", "u", "list"), ("c", "m", "t", "u", "list"), ("c", "m", "self", "self", "list")]
    out = depths(spark.createDataFrame(rows, "snapshot_id STRING, method STRING, block_id STRING, parent_id STRING, block_type STRING")).collect()
    got = {(r.snapshot_id, r.block_id): (r.depth, r.root, r.quoted) for r in out}
    assert len(out) == len(rows)
    assert all(got["s", f"b{i}"] == (i, "b0", i >= 3) for i in range(200))
    assert got["s", "x"] == (0, "x", False) and got["t", "b0"] == (0, "b0", True)
    assert got[None, "p"] == (0, "p", None) and got[None, "q"] == (0, "q", True)
    assert {k: got["c", k] for k in "uvw"} == {k: (3, k, True) for k in "uvw"}
    assert got["c", "t"] == (4, "u", True) and got["c", "self"] == (1, "self", False)
