"""Each property of a region of evidence, broken by hand."""

from docloom.operators import isolation as I

ENTRY = '<source index="1" source_id="s" title="t">\n<content>\n{}\n</content>\n</source>\n\n'
REGION = "<untrusted_source_data>\n{}</untrusted_source_data>"


def test_each_property(spark):
    whole = REGION.format(ENTRY.format("a &lt;b&gt; &amp;lt; c"))
    cases = {
        "fit": (whole, [" a <b> &lt; c "], []),
        "none": (REGION.format(""), [], []),
        "null passage": (REGION.format(ENTRY.format("")), [None], []),
        "after": (whole + " more", ["a <b> &lt; c"], ["nothing_outside"]),
        "before": ("x" + whole, ["a <b> &lt; c"], ["nothing_outside"]),
        "lost": (whole, ["a <b> &lt; c", "b"], ["one_element_each", "reads_back"]),
        "changed": (whole, ["a"], ["reads_back"]),
        "raw": (REGION.format(ENTRY.format("<i>x")), ["<i>x"], ["escaped"]),
        "twice": (REGION.format("<untrusted_source_data>" + ENTRY.format("x")), ["x"], ["one_region"]),
        "null": (None, [], ["nothing_outside", "one_region"]),
    }
    rows = spark.createDataFrame([(k, e, b) for k, (e, b, _) in cases.items()], "id string, evidence string, bodies array<string>")
    found = {(r["id"], r["property"]) for r in I.isolation_violations(rows, "id").collect()}
    assert found == {(k, p) for k, (_, _, broken) in cases.items() for p in broken}
    assert I.isolation_violations(rows.where("false"), "id").count() == 0
