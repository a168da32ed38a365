"""Operator 5, n-gram Jaccard join: prefix-tree join over globally ordered shingle sets.

Shingles are ordered by how frequent they are in the whole corpus, rarest first (counted in
``2**WEIGHT_BITS`` hash cells, so that the table's size is fixed; any order is right, a good one
keeps frequent shingles out of the prefixes). Texts of equal sets form one class. Classes meet
when their prefixes, the first ``n - ceil(t * n) + 1`` shingles, share one and lengths, positions
and parity bits (a lower bound of the shingles in which sets differ) allow the threshold. Candidates of a probe are stored in a trie of their whole ordered
sets; one walk shares the overlap of common beginnings and leaves a subtree when the lengths that
remain cannot reach the threshold. Members of one component are not paired further, so a group of
copies or near copies costs about one link a member.

Defined results: a null text is the empty text; a text without words has an empty set and is
linked with nothing; rows that share a doc_id are scored by their own texts; the component is the
least doc_id of the linked texts, nulls aside; an empty table gives no rows; further columns are
not read. Texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, join_by_weight, written
from .components import bucket_links, components
from .shingles import mix, ordered_sets, shingles
from .tokens import slices

WIDTH = 3
#: Two sets link when HUNDRED * intersection >= PERCENT * union.
PERCENT = 90
WEIGHT_BITS = 18
#: Longs of a set's parity bits.
N_PARITY = 4
_PARITY = [f"p{k}" for k in range(N_PARITY)]
#: Shingles in a trie, about.
TRIE_SIZE = 200_000
SLICE = 4 << 20


def weights(docs: DataFrame, width: int) -> np.ndarray:
    """Rounded logarithm of the count in each hash cell, over all texts (fixed size: one byte a cell)."""

    def count(batches):
        total = np.zeros(1 << WEIGHT_BITS, np.int64)
        for batch in batches:
            for rows in slices(batch, "text", SLICE):
                value, _ = shingles(rows.column("text"), width)
                total += np.bincount((value >> np.uint64(64 - WEIGHT_BITS)).astype(np.int64), minlength=len(total))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(total[cells])], ["cell", "n"])

    counted = docs.select("text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(1 << WEIGHT_BITS)
    total[counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    return np.minimum(8 * np.log2(total + 1), 255).astype(np.uint8)


def _list(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values.view(np.int64)))


def _spare(n):
    """Shingles by which a set's prefix is longer than it must be to share one; numbers, arrays or columns."""
    return n // 50 + 1 if not isinstance(n, Column) else F.floor(n / 50) + 1


def _prefix(n: Column, percent: int) -> Column:
    return F.least(n, n - F.ceil(n * percent / 100) + _spare(n))


def _shared(a: Column, b: Column, percent: int) -> Column:
    """Prefix shingles that two sets must share if they are similar.

    Of ``o`` common shingles, prefixes longer by ``s`` than the shingles that may be missing
    (``n - o``) share ``s``; here ``s`` follows from the prefixes there are.
    """
    overlap = F.ceil(percent * (a["n"] + b["n"]) / (100 + percent))
    return overlap + F.least(_prefix(a["n"], percent) - a["n"], _prefix(b["n"], percent) - b["n"])


def _signature(value: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Two sums over each set's hashes: 128 bits that name the set."""
    ends = np.cumsum(n)
    totals = [np.concatenate([[np.uint64(0)], np.cumsum(mix(value ^ np.uint64(seed)), dtype=np.uint64)]) for seed in (1, 2)]
    return [(t[ends] - t[ends - n]).view(np.int64) for t in totals]


def _parity(value: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Bits that tell whether a hash cell holds an odd number of a set's shingles.

    A shingle that only one of two sets has flips one bit, so sets differ in as many shingles as in bits, at least.
    """
    bit, word = np.uint64(1) << (value & np.uint64(63)), (value >> np.uint64(6)) % np.uint64(N_PARITY)
    some = n > 0
    starts = (np.cumsum(n) - n)[some]
    found = np.zeros((N_PARITY, len(n)), np.uint64)
    if len(starts):
        for k in range(N_PARITY):
            found[k, some] = np.bitwise_xor.reduceat(np.where(word == k, bit, np.uint64(0)), starts)
    return list(found.view(np.int64))


def _prefix_rows(docs: DataFrame, weight: np.ndarray, width: int, percent: int) -> DataFrame:
    """doc_id, n, s1, s2 (the set's signature), p0 to p3 (its parity bits), items (the ordered set's prefix)."""

    def run(batches):
        for batch in batches:
            for rows in slices(batch, "text", SLICE):
                value, n = ordered_sets(rows.column("text"), weight, WEIGHT_BITS, width)
                s1, s2 = _signature(value, n)
                size = np.minimum(n, np.where(n > 0, n - (-(-percent * n // 100)) + _spare(n), 0))
                keep = np.arange(len(value)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(size, n)
                parity = [pa.array(p) for p in _parity(value, n)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(s1), pa.array(s2), *parity, _list(value[keep], size)],
                                                 ["doc_id", "n", "s1", "s2", *_PARITY, "items"])

    parity = "".join(f"{p} long, " for p in _PARITY)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n long, s1 long, s2 long, {parity}items array<long>")


def _class_sets(found: DataFrame, weight: np.ndarray, width: int) -> DataFrame:
    """id, n, items (the whole ordered set) of the rows (id, s1, s2, text) whose text has the signature."""

    def run(batches):
        for batch in batches:
            for rows in slices(batch, "text", SLICE):
                value, n = ordered_sets(rows.column("text"), weight, WEIGHT_BITS, width)
                own = [s == rows.column(c).to_numpy() for s, c in zip(_signature(value, n), ("s1", "s2"))]
                good = own[0] & own[1]
                yield pa.RecordBatch.from_arrays([rows.column("id").filter(pa.array(good)), pa.array(n[good].astype(np.int64)), _list(value[np.repeat(good, n)], n[good])],
                                                 ["id", "n", "items"])

    return found.select("id", "s1", "s2", "text").mapInArrow(run, "id long, n long, items array<long>")


class Trie:
    """Path-compressed prefix tree of ordered sets; each node knows the lengths of the sets below it."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.root = self._node(order, 0)

    def _node(self, ids: list[int], depth: int):
        """(edge, least length, greatest length, ids that end here, children) of sorted ``ids`` that agree up to ``depth``."""
        sizes = [len(self.sets[i]) for i in ids]
        a, b = self.sets[ids[0]], self.sets[ids[-1]]            # of sorted sets, the ends agree least
        n = min(len(a), len(b))
        unlike = np.flatnonzero(a[depth:n] != b[depth:n])
        end = depth + int(unlike[0]) if len(unlike) else n
        here = [i for i in ids if len(self.sets[i]) == end]
        rest = [i for i in ids if len(self.sets[i]) > end]
        groups, last = [], None
        for i in rest:
            if last is None or self.sets[i][end] != last:
                groups.append([])
                last = self.sets[i][end]
            groups[-1].append(i)
        return a[depth:end], min(sizes), max(sizes), here, (groups, end)

    def search(self, probe: np.ndarray, percent: int) -> list[int]:
        """Sets whose Jaccard similarity with ``probe`` reaches ``percent``; each common beginning is counted once."""
        sorter = np.argsort(probe)
        values = probe[sorter]
        found, todo = [], [(self.root, 0, 0, 0)]
        while todo:
            (edge, least, most, here, (groups, end)), depth, overlap, used = todo.pop()
            if len(edge) and len(values):
                at = np.minimum(np.searchsorted(values, edge), len(values) - 1)
                hits = at[values[at] == edge]
                overlap += len(hits)
                if len(hits):
                    used = max(used, int(sorter[hits].max()) + 1)
            reach = overlap + min(most - end, len(probe) - used)
            if (100 + percent) * reach < percent * (len(probe) + least):
                continue
            if (100 + percent) * overlap >= percent * (len(probe) + end):
                found += here
            todo += [(self._node(g, end), end, overlap, used) for g in groups]
        return found


def _verified(sets: DataFrame, percent: int):
    """Pairs (a, b) -> links: the b's of each a go into tries of about TRIE_SIZE shingles, a walks them."""

    def walk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        probe = rows[rows.b.isna()]["items"]
        rest = rows[rows.b.notna()]
        if not len(probe) or not len(rest):
            return pd.DataFrame({"a": [], "b": []})
        trie = Trie([np.asarray(x).view(np.uint64) for x in rest["items"]])
        found = trie.search(np.asarray(probe.iloc[0]).view(np.uint64), percent)
        return pd.DataFrame({"a": rest["a"].iloc[found], "b": rest["b"].iloc[found].astype("int64")})

    def verified(pairs: DataFrame) -> DataFrame:
        known = sets.select(F.col("id").alias("b"), "items", "n")
        sized = pairs.join(known.select("b", "n"), "b")
        of_a = Window.partitionBy("a")
        parts = F.ceil(F.sum("n").over(of_a) / TRIE_SIZE)
        placed = written(sized.select("a", "b", F.pmod(F.hash("b"), parts).cast("int").alias("part")), "trie-pairs")
        members = placed.join(known.drop("n"), "b").select("a", "part", "b", "items")
        probes = placed.select("a", "part").distinct().join(known.select(F.col("b").alias("a"), "items"), "a").select(
            "a", "part", F.lit(None).cast("long").alias("b"), "items")
        return members.unionByName(probes).groupBy("a", "part").applyInPandas(walk, "a long, b long")

    return verified


def _possible(percent: int):
    def possible(a: Column, b: Column) -> Column:
        shared = F.least(a["at"], b["at"]) + 1 + F.least(a["n"] - a["at"], b["n"] - b["at"]) - 1
        unlike = sum((F.bit_count(a[p].bitwiseXOR(b[p])) for p in _PARITY), F.lit(0))
        return ((100 * F.least(a["n"], b["n"]) >= percent * F.greatest(a["n"], b["n"]))
                & ((100 + percent) * shared >= percent * (a["n"] + b["n"]))
                & ((100 + percent) * unlike <= (100 - percent) * (a["n"] + b["n"])))
    return possible


def _candidates(members: DataFrame, percent: int) -> DataFrame:
    """Members of buckets with another of fitting length, of sets that have enough of them.

    ``weight`` becomes the members that a set meets over all its buckets: the text that copies were
    made from meets most, so it is the one that the others are tried against.
    """
    by_size = Window.partitionBy("bucket").orderBy("n", "id")
    below, above = F.lag("n").over(by_size), F.lead("n").over(by_size)
    fits = members.withColumns({"below": below, "above": above}).filter(f"100 * below >= {percent} * n OR 100 * n >= {percent} * above")
    fits = fits.drop("below", "above").withColumn("weight", F.count(F.lit(1)).over(Window.partitionBy("bucket")))
    fits = written(fits, "fitting")
    of_set = Window.partitionBy("id")
    enough = F.count(F.lit(1)).over(of_set) >= _spare(F.ceil(F.col("n") * percent / 100))
    members = written(fits.withColumn("enough", enough).withColumn("weight", F.sum("weight").over(of_set)).filter("enough").drop("enough"), "members")
    dropped(fits)
    return members


def _texts(docs: DataFrame, members: DataFrame, classes: DataFrame) -> DataFrame:
    """id, s1, s2, text of the classes that are members, by the documents with their least ids."""
    needed = members.select("id").distinct().join(classes, "id").select("id", "s1", "s2", "least")
    return docs.join(needed, docs.doc_id.eqNullSafe(needed.least)).select("id", "s1", "s2", "text")


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, class_id (equal sets), class_size."""
    docs = docs.select("doc_id", "text")
    weight = weights(docs, width)
    rows = written(_prefix_rows(docs, weight, width, percent), "prefixes")
    # struct minimum: nulls aside, the least doc_id
    classes = (rows.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("weight"))
               .withColumn("id", F.monotonically_increasing_id()))
    classes = written(classes, "classes")
    key = (F.col("r.s1") == F.col("c.s1")) & (F.col("r.s2") == F.col("c.s2")) & F.col("r.doc_id").eqNullSafe(F.col("c.least"))
    one = rows.filter("n > 0").alias("r").join(classes.alias("c"), key).select("c.id", "c.n", "r.items", *[f"r.{p}" for p in _PARITY])
    members = one.select(F.posexplode("items").alias("at", "bucket"), "id", F.col("n").cast("int").alias("n"), *_PARITY)
    members = _candidates(members, percent)
    sets = written(_class_sets(_texts(docs, members, classes), weight, width), "sets")
    links = bucket_links(members, _possible(percent), _verified(sets, percent), lambda a, b: _shared(a, b, percent))
    label = components(links)
    dropped(members, sets, links)
    named = classes.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    group = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = written(named.join(group, "component").select("s1", "s2", "n", "id", "weight", "component_id"), "named")
    dropped(classes)
    full = join_by_weight(rows.filter("n > 0").select("doc_id", "n", "s1", "s2"), named, ["s1", "s2", "n"], "weight", rows.count())
    full = full.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("id").alias("class_id"), F.col("weight").alias("class_size"))
    empty = rows.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"),
                                        F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return full.unionByName(empty)
