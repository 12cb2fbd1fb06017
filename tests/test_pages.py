"""Pages are normalised once, whatever is made of them."""

from quarry.operators import chunking, markdown


def test_pages_are_normalised_once(spark):
    texts = ['# One { #one }\n\n<div class="termy">\n$ <b>a</b> &amp;\n</div>\n\n## Two { #two }\n\n' + "word " * 40, "## Plain { #p }\n\n" + "text " * 40, None]
    docs = spark.createDataFrame([(f"{i}.md", t) for i, t in enumerate(texts)], "path string, text string")
    stripped = markdown.strip_termy(docs)
    assert "Union" not in stripped._jdf.queryExecution().optimizedPlan().toString()
    found = {r.path: r.text for r in stripped.collect()}
    assert found["0.md"] == texts[0].replace('<div class="termy">\n$ <b>a</b> &amp;\n</div>', "$ a &") and found["1.md"] == texts[1] and found["2.md"] is None
    snippets = spark.createDataFrame([], "path string, content string")
    chunks = chunking.doc_chunks(markdown.normalize(docs, snippets), "https://e.org")
    assert "ArrowEvalPython" not in chunks._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.path, r.title) for r in chunks.collect()} == {("0.md", "One"), ("1.md", "")}
