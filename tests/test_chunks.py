"""Chunks that end at a full stop, against plain Python."""

from threatloom.operators import chunks


def test_sentence_chunks_equal_plain_python(spark):
    texts = [None, "", "short. text", "no stop " * 400, ("A sentence of some words. " * 120).strip(), "x" * 950 + ". " + "y" * 3000 + ". z"]
    frame = spark.createDataFrame(list(enumerate(texts)), "article_id long, content string")
    got = {}
    for r in chunks.sentence_chunks(frame).collect():
        got.setdefault(r.article_id, []).append((r.chunk, r.start, r.end, r.chunk_text))
    for i, t in enumerate(texts):
        out, start, n = [], 0, len(t or "")
        while start < n:
            end = min(start + 1000, n)
            if end < n and (stop := t.rfind(".", end - 100, end)) >= 0:
                end = stop + 1
            out.append((len(out), start, end, t[start:end]))
            start = n if end >= n else max(end - 200, start + 1)
        assert sorted(got.get(i, [])) == out
