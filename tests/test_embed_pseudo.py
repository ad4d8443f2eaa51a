"""embed_pseudo hashes whole texts."""
from feedloom.plans import registry


def wanted(text):
    raw = text.encode("utf-16-le")
    h = 0
    for k in range(0, len(raw), 2):
        h = (31 * h + raw[k] + 256 * raw[k + 1]) % 2**32
    return abs(h - 2**32 if h >= 2**31 else h)


def test_whole_texts(spark, tmp_path):
    start = "same start " * 40
    texts = [start + "one", start + "two", start, "short", "\U0001f600 \u6f22 " * 100, ""]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r.doc_id: r.hash for r in registry.QUERIES["embed_pseudo"](spark, f"file://{tmp_path}").collect()}
    assert got == {i: wanted(t) for i, t in enumerate(texts)}
