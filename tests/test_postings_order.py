"""The index's segments: in the order of one whole number, so that they are sorted by radix; each term's postings together."""
from pyspark.sql import functions as F

from spark_netwatch.llm.postings import build_index


def test_segments_are_in_the_order_of_the_terms_hashes(spark):
    texts = [f"alpha w{i % 7} beta w{i % 3} alpha x{i}" for i in range(60)] + [None, "", "Beta"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    index = build_index(docs, buckets=3).select("doc", "pos", "term", F.xxhash64("term").alias("slot"), F.input_file_name().alias("file"), F.col("_metadata.row_index").alias("row"))
    files = {}
    for r in index.collect():
        files.setdefault(r.file, []).append((r.row, r.slot, r.doc, r.pos, r.term))
    assert len(files) == 3 and sum(map(len, files.values())) == 60 * 6 + 3
    for rows in files.values():
        rows = [r[1:] for r in sorted(rows, key=lambda r: r[0])]
        assert [r[0] for r in rows] == sorted(r[0] for r in rows)
        for term in {r[3] for r in rows}:
            own = [r[1:3] for r in rows if r[3] == term]
            assert own == sorted(own, key=lambda x: (x[0], x[1] or 0))
