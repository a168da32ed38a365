"""License scans, fingerprints and line dedup: SQL twins and brute force."""

import random
import re
from collections import Counter, defaultdict
from functools import cache
from itertools import combinations

from helpers import SF, duck, same
from pyspark.sql import functions as F

from spark_netwatch.llm import fingerprints as M
from spark_netwatch.llm import fuzzy_lines as L
from spark_netwatch.llm import licenses, queries


def test_license_scan_equals_sql(spark):
    assert same(queries.op7_license_scan(spark, SF).toPandas(), duck(licenses.scan_sql()))


def test_license_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "The MIT-License! apache license,MIT license", "x"), (4, "Released under the MIT License.\nx", "x"),
            (5, "GNU General\nPublic License", "x"), (6, "released under the apache license", "x"), (None, "mit license", "x"), (7, "lıcense µit license", "x"),
            (8, "Permission is hereby granted, free of charge, to any person obtaining a copy of that software", "x")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, label string")).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].labels, got[1].score) == (0, 0, None, "", 0.0)
    assert (got[3].n_base, got[3].first_word, got[3].last_word, got[3].base_labels, got[3].score) == (3, 1, 5, "apache,mit", 0.5)
    assert (got[4].labels, got[4].score) == ("mit", 1.0)
    assert (got[5].n_base, got[5].base_labels) == (1, "gpl") and got[6].labels == "apache" and got[7].n_base == 0
    assert got[None].labels == "mit" and got[8].labels == "mit" and 0.9 <= got[8].score < 1
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fingerprints_equal_sql(spark):
    assert same(queries.op8_fingerprints(spark, SF).toPandas(), duck(M.FINGERPRINT_SQL))


def test_fingerprint_cases(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "same\ntext", 0), (5, "same\ntext", 0), (5, "same\ntext", 0), (5, "other", 0), (None, "x" * 40, 0)]
    got = M.fingerprints(spark.createDataFrame(rows, "doc_id long, text string, hash int")).collect()
    assert len(got) == 6
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert by[1][0].fingerprint == by[2][0].fingerprint and by[1][0].near_next == 1.0 and by[2][0].near_next == 0.0
    assert by[3][0].fingerprint in {r.fingerprint for r in by[5]}
    one = M.fingerprints(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.n_chars == 8
    assert M.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_differing_branches_locate_edits(spark):
    df = spark.createDataFrame([("a\nb\n\nc\nd", "a\nB\n\nc\nd\ne"), ("q", "q")], "a string, b string")
    at = df.select(M.differing(M.paragraph_nodes(F.col("a")), M.paragraph_nodes(F.col("b"))).alias("at")).collect()
    assert [[tuple(x) for x in r["at"]] for r in at] == [[(0, 1), (1, 2)], []]


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@cache
def _bigrams(text):
    return Counter(x + y for x, y in zip(text, text[1:]))


def _linked(a, b):
    """By the edit similarity alone, whatever the candidate search; one edit changes two pairs of letters at most."""
    longest = max(len(a), len(b))
    allowed = int(longest * (1 - L.SIMILARITY) + 1e-9)
    if abs(len(a) - len(b)) > allowed or (_bigrams(a) & _bigrams(b)).total() < longest - 1 - 2 * allowed:
        return False
    return _distance(a, b) <= allowed


def test_line_dedup_against_all_pairs(spark):
    base = "the quick brown fox jumps over the lazy dog while seventeen small birds sing in the old garden"
    texts = [base, base.upper() + "!", base.replace("fox", "fax"), base.replace("lazy", "hazy") + "\nown line\n\n---", "own line\nanother one here",
             None, "", "\n", "Own   LINE", "something else entirely, with nothing in common"]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, line int")
    docs = docs.unionByName(spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 12").select(
        (F.col("doc_id") + 100).alias("doc_id"), "text", F.lit(7).alias("line")))
    keyed = L._keyed(docs)
    lines = L._lines(keyed)
    rows = lines.groupBy(F.array_join("words", " ").alias("normal")).agg(F.min(F.struct(*L._DOC, "line")).alias("first")).collect()
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if _linked(rows[i].normal, rows[j].normal):
            group[top(i)] = top(j)
    members = defaultdict(list)
    for i, r in enumerate(rows):
        members[top(i)].append(tuple(r.first))
    stays = {(min(m)[0], min(m)[2]) for m in members.values()}
    worded = {(r._doc, r.line) for r in lines.select("_doc", "line").collect()}
    got = {r.doc_id: r for r in L.dedup_lines(docs).collect()}
    for d, text in [(r.doc_id, r.text) for r in docs.collect()]:
        want = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if (d, i) not in worded or (d, i) in stays)
        assert got[d].text == want and got[d].line == 7
        assert got[d].n_lines == (0 if text is None else len(text.split("\n")))
    assert got[1].n_removed == got[8].n_removed == 1 and got[3].text.endswith("---")


def test_line_dedup_of_an_empty_table(spark):
    assert L.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_line_similarity_is_in_characters(spark):
    long = "extraordinarily comprehensive documentation accompanies international telecommunication infrastructure"
    texts = [f"{long} at an is of", f"{long} it on as or", "short own line", f"{long} or in a be it we do"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for other in (1, 3):
        assert _distance(texts[0].split(), texts[other].split()) > 0.2 * max(len(texts[0].split()), len(texts[other].split()))
        assert _distance(texts[0], texts[other]) <= 0.2 * max(len(texts[0]), len(texts[other]))
    assert [r.n_removed for r in L.dedup_lines(docs).orderBy("doc_id").collect()] == [0, 1, 0, 1]


def test_near_lines_are_found(spark):
    """One line in each of two documents: typos, digits, changed, split and added words."""
    pairs = [("please contact us today for a free quote", "please contact us todey for a free quote"), ("page 12 of 30", "page 13 of 30"), ("total 1234", "total 1235"),
             ("organisation", "organization"), ("our great football club of the year", "our great foot ball club of the year"), ("Read more!", "read mor"),
             ("seven small birds sing in old gardens", "seven small birds sing in new gardens"), ("ha ha ha ha ha", "ha ha ha ha he"),
             ("the parcel was delivered on monday by our courier", "the parcel was delivered on friday by our courier")]
    for near in pairs:
        assert _linked(*(" ".join(re.findall(r"\w+", x.lower())) for x in near))
    rows = [(2 * i + k, x) for i, near in enumerate(pairs) for k, x in enumerate(near)] + [(100, "an unlike line of its own"), (101, "nothing else"), (102, "else")]
    got = {r.doc_id: r.n_removed for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[2 * i] for i in range(len(pairs))] == [0] * len(pairs) and [got[2 * i + 1] for i in range(len(pairs))] == [1] * len(pairs)
    assert got[100] == got[101] == got[102] == 0


def test_recall_of_the_line_search(spark):
    """Pairs of similarity 0.8 or more made by replaced words and letters meet in a bucket, nine of ten at least for each kind."""
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").dropna().collect()]
    every = sorted({" ".join(w for w in re.split(r"[\W_]+", x.lower()) if w) for t in texts for x in t.split("\n")} - {""})
    vocabulary, rng = sorted({w for x in every for w in x.split()}), random.Random(4)

    def changed(line, n_words, n_letters):
        ws = line.split()
        for i in rng.sample(range(len(ws)), n_words + n_letters)[:n_words]:
            ws[i] = rng.choice(vocabulary)
        out = list(" ".join(ws))
        for i in rng.sample([i for i, c in enumerate(out) if c != " "], n_letters):
            out[i] = rng.choice("abcdefghijklmnopqrstuvwxyz")
        return "".join(out)

    kinds = {"1 word of 5": (5, 1, 0), "1 word of 8": (8, 1, 0), "2 words of 10": (10, 2, 0), "4 words of 20": (20, 4, 0), "2 letters in 8": (8, 0, 2), "5 letters in 20": (20, 0, 5)}
    made = []
    for kind, (n, n_words, n_letters) in kinds.items():
        for line in [x for x in every if n <= len(x.split()) <= n + n // 4 and len(x) < 200][:40]:
            other = changed(line, n_words, n_letters)
            if other != line and _linked(line, other):
                made.append((kind, line, other))
    docs = spark.createDataFrame([(2 * i + k, x) for i, (_, *both) in enumerate(made) for k, x in enumerate(both)], "_doc long, text string").withColumn("_hash", F.col("_doc"))
    places = L.line_places(docs).withColumns({"id": F.col("_doc"), "n": F.lit(1)})
    buckets = defaultdict(set)
    for r in L._buckets(places).collect():
        buckets[r.id].add(r.bucket)
    found = Counter(kind for i, (kind, *_) in enumerate(made) if buckets[2 * i] & buckets[2 * i + 1])
    total = Counter(kind for kind, *_ in made)
    print({k: (found[k], total[k]) for k in kinds})
    assert min(total.values()) >= 5 and set(total) == set(kinds)
    assert all(found[k] >= 0.9 * total[k] for k in kinds)


def test_line_dedup_with_clashing_columns(spark):
    names = ["_hash", "_doc", "_cut", "_cut_hash", "line", "words", "b0", "size"]
    rows = [(1, "own line here\nx", *range(8)), (2, "own line here", *range(8)), (2, "own line here", *range(8)), (None, None, *range(8)), (4, "", *range(8))]
    got = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))).collect()
    assert sorted((r.doc_id or 0, r.text, r.n_removed) for r in got if r.text is not None) == [(1, "own line here\nx", 0), (2, "", 1), (2, "", 1), (4, "", 0)]
    assert all([r[n] for n in names] == list(range(8)) for r in got) and len(got) == 5
