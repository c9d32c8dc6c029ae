"""Price lists: products meet their terms without a broadcast."""

import json

from tideline.sources import offers


def document(prices):
    products = {s: {"sku": s, "productFamily": "Storage", "attributes": {"volumeApiName": s}} for s in prices}
    products["bare"] = {"sku": "bare", "productFamily": "Storage"}
    terms = {s: {"t": {"priceDimensions": {"d": {"pricePerUnit": {"USD": p}}}}} for s, p in prices.items() if p}
    return json.dumps({"products": products, "terms": {"OnDemand": terms}})


def test_products_meet_terms_by_merging(spark):
    rows = [("a", document({"x": "1.5", "y": None})), ("a", document({"x": "2"})), ("b", document({"x": "?"}))]
    rows += [("c", "{}"), ("d", None), ("e", document({})), (None, document({"x": "4"}))]
    found = offers.priced_products(spark.createDataFrame(rows, "region string, offer string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    # A filter on the generated maps would parse the documents ahead of it.
    assert "size(" not in plan
    got = sorted((r["region"], r["sku"], str(r["price"])) for r in found.collect())
    # A region listed twice pairs its products with the terms of both documents.
    assert got == [("a", "x", "1.5"), ("a", "x", "1.5"), ("a", "x", "2.0"), ("a", "x", "2.0"), ("b", "x", "None")]
