import hashlib

from weftline.operators.model import review_manifest


def test_every_case_has_its_partners(spark):
    """Five, or all others of the split, whatever the size of the table."""
    digest = lambda x: hashlib.sha256(f"review:{x}".encode()).hexdigest()
    for n in (1, 4, 9, 700, 3000):
        rows = [(i, f"s{i % 97}") for i in range(n)]
        got = {r.case: (r.split, r.partners) for r in review_manifest(spark.createDataFrame(rows, "case INT, site STRING"), "case", "site").collect()}
        order: dict[str, list[int]] = {"development": [], "heldout": []}
        for i, site in sorted(rows, key=lambda r: digest(r[0])):
            order["development" if digest(site)[0] < "8" else "heldout"].append(i)
        want = {}
        for split, ids in order.items():
            for k, i in enumerate(ids):
                want[i] = (split, (ids[k + 1 :] + ids[:k])[:5])
        assert got == want
