"""Operator 1, SentencePiece encoding and decoding by Gumbel top-k sampling without replacement.

A text's segmentations are the paths of its piece lattice. The model file's pieces are weighted by
rank (log probability ``-log(rank + 2)``, Zipf's law, as the file holds merge ranks and no
frequencies) over a temperature; characters without a piece fall back to their bytes. Backward sums
over the lattice make each edge's conditional probability exact, so a perturbed A-star search needs
no bounds beyond the regions' own masses: the whole lattice draws its greatest Gumbel value and,
independently, the path that has it; taking that path out leaves one region for each of its edges
(same beginning, another edge), whose greatest values are Gumbels truncated at the parent's. The
region with the greatest value gives the next path, which is therefore the next of an exact sample
without replacement. The value of the (k+1)th path is the threshold of the inclusion scores.

White space starts a unit, as no piece crosses it; equal units of a batch share their lattice. The
draws are hashes of row key, sample and place, so a row gives the same samples however the rows
are dealt out.

Defined results: a null or empty text has one segmentation, the empty one; a text with fewer than
k segmentations gives them all, each with inclusion score 1 (log 0); rows that repeat a key draw
alike; an empty table gives no rows; further columns are not read. Texts of any length are read
whole.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import mix
from .tokens import slices

SAMPLES = 2
TEMPERATURE = 0.5
BYTE_COST = 12.0
SLICE = 2 << 20
#: No Gumbel draw from 53 random bits is greater above its location.
MOST_DRAW = 37.0
#: Nodes of the matcher, shallow ones first, whose children stand in a plain table (1 KB each).
TABLE_NODES = 1 << 16
_SPACE = 32


def _order(x: np.ndarray) -> np.ndarray:
    """Stable order of whole numbers from 0 on; 16 bits at a time, which numpy sorts by counting."""
    order = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    shift, most = 16, int(x.max()) if len(x) else 0
    while most >> shift:
        order = order[np.argsort((x[order] >> shift & 0xFFFF).astype(np.uint16), kind="stable")]
        shift += 16
    return order


def _without(options: np.ndarray, taken: tuple[int, ...]) -> np.ndarray:
    for t in taken:
        options = options[options != t]
    return options


class Pieces:
    """The model file's pieces as byte strings (their space mark is a space), and a matcher over byte buffers."""

    def __init__(self, path: str, temperature: float):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.text, self.byte_id = [b""] * size, np.zeros(256, np.int32)
        cost, rank, children, self.piece = np.zeros(size), 0, [{}], [-1]
        for i in range(size):
            if model.is_byte(i):
                b = int(model.id_to_piece(i)[1:-1], 16)
                self.text[i], self.byte_id[b] = bytes([b]), i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.text[i] = model.id_to_piece(i).replace("▁", " ").encode()
                cost[i], rank = math.log(rank + 2), rank + 1
                node = 0
                for b in self.text[i]:
                    if b not in children[node]:
                        children[node][b] = len(children)
                        children.append({})
                        self.piece.append(-1)
                    node = children[node][b]
                self.piece[node] = i
        self.weight, self.byte_weight = -cost / temperature, -BYTE_COST / temperature
        self.piece = np.array(self.piece)
        self.length = np.array([len(t) for t in self.text])
        self.flat = np.frombuffer(b"".join(self.text), np.uint8)
        self.begin = np.cumsum(self.length) - self.length
        number = {0: 0}                                      # breadth first, so that shallow nodes come first
        for node in (order := [0]):
            for child in children[node].values():
                number[child] = len(number)
                order.append(child)
        self.piece = self.piece[order]
        pairs = sorted((number[node] * 256 + b, number[child]) for node, kids in enumerate(children) for b, child in kids.items())
        self.keys, self.child = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int32)
        self.shallow = min(len(children), TABLE_NODES) * 256
        self.table = np.full(self.shallow, -1, np.int32)
        near = self.keys < self.shallow
        self.table[self.keys[near]] = self.child[near]

    def matches(self, data: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(start, end, piece) of every piece that stands in ``data``, within units (``ends``: the end of each byte's unit).

        One entry for each length in bytes, shortest first; a start stands at most once in each.
        """
        at = np.flatnonzero((data & 0xC0) != 0x80).astype(np.int32)
        node, start, found = np.zeros(len(at), np.int32), at, []
        while len(at):
            key = node * np.int64(256) + data[at]
            if key.max() < self.shallow:
                node = self.table[key]
            else:
                i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                node = np.where(self.keys[i] == key, self.child[i], np.int32(-1))
            hit = node >= 0
            at, start, node = at[hit] + 1, start[hit], node[hit]
            piece = self.piece[node]
            whole = piece >= 0
            found.append((start[whole], at[whole], piece[whole]))
            more = at < ends[start]
            at, start, node = at[more], start[more], node[more]
        return found

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the rows' pieces (a row ends at ``ends``), and where each row's bytes end."""
        size = self.length[ids]
        total = np.cumsum(size)
        take = np.arange(total[-1] if len(total) else 0) + np.repeat(self.begin[ids] - (total - size), size)
        return self.flat[take], np.concatenate([[0], total])[ends]


class Lattice:
    """Edges of the units' lattices and their conditional probabilities. A state is a byte of ``data``."""

    def __init__(self, pieces: Pieces, data: np.ndarray, unit_ends: np.ndarray):
        self.pieces, self.data = pieces, data
        sizes = np.diff(np.concatenate([[0], unit_ends]))
        ends = np.repeat(unit_ends, sizes)
        found = pieces.matches(data, ends)
        heads = np.flatnonzero((data & 0xC0) != 0x80)
        size_at = np.zeros(len(data), np.int64)
        size_at[heads] = np.diff(np.append(heads, len(data)))
        alone = np.zeros(len(data), bool)
        for start, end, _ in found:
            alone[start[end - start == size_at[start]]] = True
        bare = heads[~alone[heads]]                          # characters that are no piece: their bytes
        found = [(bare, bare + size_at[bare], np.full(len(bare), -1)), *found[::-1]]
        n_at = np.zeros(len(data), np.int64)
        for start, _, _ in found:
            n_at[start] += 1
        # by distance from the unit's end, then state; a state's longest piece first, as it is the likeliest
        states = np.flatnonzero(n_at)
        states = states[_order(ends[states] - states)]
        n = n_at[states]
        self.first = np.cumsum(n) - n                        # edges of a state lie together
        self.start, group = np.repeat(states, n), np.repeat(np.arange(len(states)), n)
        self.end, self.piece, weight = np.empty(len(group), np.int64), np.empty(len(group), np.int64), np.empty(len(group))
        place = n_at
        place[states] = self.first
        for start, end, piece in found:
            at = place[start]
            self.end[at], self.piece[at] = end, piece
            weight[at] = pieces.weight[piece] if piece is not found[0][2] else pieces.byte_weight * (end - start)
            place[start] += 1
        self.state = np.full(len(data) + 1, -1)
        self.state[states] = np.arange(len(states))
        rest = np.zeros(len(data) + 1)                       # log mass from a state to its unit's end
        closing = self.end == np.repeat(ends[states], n)
        chance = np.empty(len(group))
        levels = np.append(self.first[np.append(True, np.diff(ends[states] - states) > 0)], len(group)) if len(states) else np.zeros(1, int)
        for a, b in zip(levels, levels[1:]):
            value = weight[a:b] + np.where(closing[a:b], 0.0, rest[np.minimum(self.end[a:b], len(data))])
            g = group[a:b] - group[a]
            heads_at = self.first[group[a]:group[b - 1] + 1] - a
            top = np.maximum.reduceat(value, heads_at)
            mass = np.add.reduceat(np.exp(value - top[g]), heads_at)
            rest[self.start[a:b][heads_at]] = top + np.log(mass)
            chance[a:b] = np.exp(value - top[g]) / mass[g]
        self.chance, self.closing = chance, closing
        self.log_chance = np.minimum(weight + np.where(closing, 0.0, rest[np.minimum(self.end, len(data))]) - np.repeat(rest[states], n), 0.0)
        self.log_left = self._others(group) if len(group) else np.zeros(0)
        running = np.cumsum(chance, dtype=np.longdouble)        # long, so that other units' edges leave no trace
        self.running = (running - np.repeat(running[self.first] - chance[self.first], n)).astype(float)
        self.last = np.append(self.first[1:], len(group))[:len(self.first)] - 1
        self.running[self.last] = 2.0

    def _others(self, group: np.ndarray) -> np.ndarray:
        """Log chance of each edge's state without the edge; 1 - chance would round to 0 for the likeliest."""
        likely = np.flatnonzero(self.log_chance == np.maximum.reduceat(self.log_chance, self.first)[group])
        likely = likely[np.append(True, np.diff(group[likely]) > 0)]
        others = self.log_chance.copy()
        others[likely] = -np.inf
        second = np.maximum.reduceat(others, self.first)
        with np.errstate(divide="ignore", invalid="ignore"):
            left = np.log1p(-self.chance)
            sums = np.add.reduceat(np.where(np.isneginf(others), 0.0, np.exp(others - second[group])), self.first)
            left[likely] = np.where(np.isneginf(second), -np.inf, second + np.log(sums))
        return left

    def draw(self, at: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each state by its conditional probability."""
        edge = self.first[self.state[at]]
        on = np.flatnonzero(self.running[edge] < u)
        while len(on):
            edge[on] += 1
            on = on[self.running[edge[on]] < u[on]]
        return edge

    def walk(self, at: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Paths from states to their units' ends: (walker, edge), each walker's edges in order."""
        who, edges, walker, step = [], [], np.arange(len(at)), 0
        while len(at):
            edge = self.draw(at, _uniform(seed + np.uint64(step)))
            who.append(walker), edges.append(edge)
            on = ~self.closing[edge]
            at, seed, walker, step = self.end[edge[on]], seed[on], walker[on], step + 1
        if not who:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        who, edges = np.concatenate(who), np.concatenate(edges)
        order = _order(who)
        return who[order], edges[order]

    def ids(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of the edges, and how many each has."""
        piece = self.piece[edges]
        count = np.where(piece >= 0, 1, self.end[edges] - self.start[edges])
        total = np.cumsum(count)
        place = np.arange(total[-1] if len(total) else 0) - np.repeat(total - count, count)
        out = np.repeat(piece, count)
        raw = out < 0
        out[raw] = self.pieces.byte_id[self.data[(np.repeat(self.start[edges], count) + place)[raw]]]
        return out, count


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1), by hash."""
    return ((mix(x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _units(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Units of the space-led texts in order, units by text, and the texts' bytes with their ends."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    led = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string()))).cast(pa.large_binary())
    ends = np.frombuffer(led.buffers()[1], np.int64)[led.offset:led.offset + len(led) + 1]
    data = np.frombuffer(led.buffers()[2], np.uint8)[ends[0]:ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends = ends[1:] - ends[0]
    cut = np.zeros(len(data) + 1, bool)
    cut[np.concatenate([[0], ends])] = True
    space, line = data == _SPACE, data == 10
    cut[1:-1] |= (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
    cuts = np.flatnonzero(cut)
    if not len(data):
        cuts = np.zeros(1, np.int64)
    units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)])
    return units, np.diff(np.searchsorted(cuts, np.concatenate([[0], ends]))), data, ends


def sample(pieces: Pieces, texts: pa.Array, keys: np.ndarray, k: int):
    """Yield, for each sample in turn: row numbers, ids, ids by row, log probability, Gumbel value, log inclusion."""
    units, per_row, data, text_ends = _units(texts)
    coded = units.dictionary_encode()
    distinct = coded.dictionary
    offsets = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset:distinct.offset + len(distinct) + 1]
    flat = np.frombuffer(distinct.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if len(distinct) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0] if len(distinct) else np.zeros(1, np.int64)
    net = Lattice(pieces, flat, offsets[1:])
    at = offsets[coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)] if len(units) else np.zeros(0, np.int64)
    n = len(per_row)
    unit_row = np.repeat(np.arange(n), per_row)
    unit_end = np.cumsum(per_row)
    unit_no = np.arange(len(at)) - np.repeat(unit_end - per_row, per_row)
    keys = mix(keys.view(np.uint64))
    # a walker is a unit of a row; its draws depend on row, sample and place alone

    def seed_of(rows, sample_no, place):
        return mix(keys + np.uint64(sample_no))[rows] + mix(place.astype(np.uint64) + np.uint64(sample_no)) * np.uint64(1 << 20)

    who, edge = net.walk(at, seed_of(unit_row, 0, unit_no))
    rows = unit_row[who]
    value = -np.log(-np.log(_uniform(seed_of(np.arange(n), 1 << 20, np.zeros(n, np.int64)))))
    paths, regions = [], [[] for _ in range(n)]
    alive, parent = np.arange(n), [None] * n
    emitted = []
    for j in range(k):
        count = np.bincount(rows, minlength=n)
        ends = np.cumsum(count)
        log_p = net.log_chance[edge]
        total = np.zeros(n)
        if len(edge):
            total[count > 0] = np.add.reduceat(log_p, (ends - count)[count > 0])
        paths.append((edge, ends, count))
        emitted.append((alive, rows, edge, total, value.copy()))
        _split(net, edge, (ends - count)[alive], ends[alive], j, [parent[r] for r in alive], value[alive], keys[alive], k - j, [regions[r] for r in alive])
        if j == k - 1:
            break
        # the best region of each row gives its next path: beginning, another edge, then anew to the end
        next_rows, begin_rows, begin_edges, other, at2, row2, no2 = [], [], [], [], [], [], []
        for r in alive.tolist():
            if not regions[r]:
                continue
            best = max(range(len(regions[r])), key=lambda i: regions[r][i][0])
            g, path, place, taken = regions[r].pop(best)
            p_edge, p_ends, p_count = paths[path]
            own = p_edge[p_ends[r] - p_count[r]:p_ends[r]]
            state = net.state[net.start[own[place]]]
            options = np.arange(net.first[state], net.last[state] + 1)
            options = _without(options, taken)
            chance = np.cumsum(np.exp(net.log_chance[options] - net.log_chance[options].max()))
            u = _uniform(mix(keys[r:r + 1] + np.uint64(j + 1)) + np.uint64(1 << 40))[0]
            chosen = options[min(np.searchsorted(chance, u * chance[-1]), len(options) - 1)]
            value[r], parent[r] = g, (place, (*taken, chosen))
            next_rows.append(r), begin_rows.append(place), begin_edges.append(own[:place]), other.append(chosen)
            unit = int(net.closing[own[:place]].sum())
            a = int(unit_end[r] - per_row[r]) + unit + 1
            tail = np.arange(a, int(unit_end[r]))
            if not net.closing[chosen]:
                at2.append(net.end[chosen:chosen + 1]), row2.append(np.array([r])), no2.append(np.array([unit]))
            at2.append(at[tail]), row2.append(np.full(len(tail), r)), no2.append(tail - int(unit_end[r] - per_row[r]))
        alive = np.array(next_rows, np.int64)
        if not len(alive):
            break
        at2, row2, no2 = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at2, row2, no2))
        who, tail_edges = net.walk(at2, seed_of(row2, j + 1, no2))
        all_rows = np.concatenate([np.repeat(alive, begin_rows), alive, row2[who]])
        all_edges = np.concatenate([*begin_edges, np.array(other, np.int64), tail_edges])
        order = _order(all_rows)
        rows, edge = all_rows[order], all_edges[order]
    threshold = np.array([max((x[0] for x in rs), default=-np.inf) for rs in regions])
    for j, (alive, rows, edge, total, gumbel) in enumerate(emitted):
        ids, size = net.ids(edge)
        per = np.bincount(rows, size, n).astype(np.int64)[alive]
        with np.errstate(over="ignore", divide="ignore", under="ignore"):
            expected = np.exp(total[alive] - threshold[alive])
            inclusion = np.where(np.isneginf(threshold[alive]), 0.0, np.where(expected < 1e-12, total[alive] - threshold[alive], np.log(-np.expm1(-expected))))
        yield j, alive, ids, per, total[alive], gumbel[alive], inclusion, (data, text_ends)


def _greatest(best: np.ndarray, keep: int) -> np.ndarray:
    """Places of each row's ``keep`` greatest values, the first of equal ones first."""
    if keep > 4:
        return np.argsort(-best, 1, kind="stable")[:, :keep]
    # what is taken falls below all others, -inf included, so that places stay distinct
    rest = np.maximum(best, -np.finfo(float).max)
    row, top = np.arange(len(best)), np.zeros((len(best), min(keep, best.shape[1])), np.int64)
    for k in range(top.shape[1]):
        top[:, k] = rest.argmax(1)
        rest[row, top[:, k]] = -np.inf
    return top


def _split(net: Lattice, edge: np.ndarray, begin: np.ndarray, end: np.ndarray, number: int, parent: list, value: np.ndarray,
           keys: np.ndarray, keep: int, regions: list, width: int = 96) -> None:
    """Add the regions left when each row's path (edges ``begin`` to ``end``) is taken out of its own region.

    Only the ``keep`` best of a row can matter. They are sought in the first ``width`` places; a row
    where a later place could still be among them is looked through further.
    """
    place = np.array([p[0] if p else 0 for p in parent], np.int64)
    size = np.minimum(end - begin - place, width)
    column = np.arange(width)
    there = column < size[:, None]
    at = np.where(there, (begin + place)[:, None] + column, 0)
    chance = np.where(there, net.log_chance[edge[at]], 0.0) if len(edge) else np.zeros((len(begin), width))
    head = np.array([net.log_chance[edge[b:b + p]].sum() for b, p in zip(begin.tolist(), place.tolist())])
    before = head[:, None] + np.concatenate([np.zeros((len(begin), 1)), np.cumsum(chance, 1)], 1)
    left = np.where(there, net.log_left[edge[at]], -np.inf) if len(edge) else np.full((len(begin), width), -np.inf)
    for i, p in enumerate(parent):
        if p and size[i]:
            state = net.state[net.start[p[1][0]]]
            options = np.arange(net.first[state], net.last[state] + 1)
            left[i, 0] = np.logaddexp.reduce(net.log_chance[_without(options, p[1])], initial=-np.inf)
    some = there & ~np.isneginf(left)
    mass = before[:, :-1] + np.where(some, left, 0.0)
    draw = _uniform(mix(keys + np.uint64(number << 44))[:, None] + (place[:, None] + column).astype(np.uint64))
    best = np.where(some, -np.logaddexp(-value[:, None], np.log(-np.log(draw)) - mass), -np.inf)
    top = _greatest(best, keep)
    floor = np.take_along_axis(best, top[:, -1:], 1)[:, 0] if top.shape[1] == keep else np.full(len(begin), -np.inf)
    # what lies beyond has less mass and no draw above MOST_DRAW
    further = (end - begin - place > width) & (before[:, -1] + MOST_DRAW >= floor)
    for i in np.flatnonzero(~further).tolist():
        own = regions[i]
        for c in top[i].tolist():
            if best[i, c] > -np.inf:
                taken = parent[i][1] if parent[i] and c == 0 else (int(edge[begin[i] + place[i] + c]),)
                own.append((float(best[i, c]), number, int(place[i]) + c, taken))
        own.sort(key=lambda x: -x[0])
        del own[keep:]
    more = np.flatnonzero(further)
    if len(more):
        _split(net, edge, begin[more], end[more], number, [parent[i] for i in more], value[more], keys[more], keep, [regions[i] for i in more], width * 4)


_READY: dict[tuple[str, float], Pieces] = {}


def _pieces(model: str, temperature: float = TEMPERATURE) -> Pieces:
    if (model, temperature) not in _READY:
        _READY[model, temperature] = Pieces(model, temperature)
    return _READY[model, temperature]


def encode(docs: DataFrame, model: str, key: str = "doc_id", k: int = SAMPLES, temperature: float = TEMPERATURE, with_ids: bool = True) -> DataFrame:
    """key, sample, n_pieces, ids_crc32 (little-endian int32), log_prob, gumbel, log_inclusion, round_trip, and ``ids`` if asked for."""

    def run(batches):
        pieces = _pieces(model, temperature)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                for j, rows, ids, per, log_p, gumbel, inclusion, (data, text_ends) in sample(pieces, part.column("text"), part.column("seed").to_numpy(), k):
                    ids = ids.astype("<i4")
                    ends = np.cumsum(per)
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(ends - per, ends)]
                    text, text_at = pieces.decode(ids, ends)
                    size = np.diff(text_at, prepend=0)
                    want = np.diff(text_ends, prepend=0)[rows]
                    same = [w == s and text[b - s:b].tobytes() == data[e - w:e].tobytes() for w, s, b, e in zip(want, size, text_at, text_ends[rows])]
                    columns = [part.column(key).take(pa.array(rows)), pa.array(np.full(len(rows), j)), pa.array(per), pa.array(crc, pa.int64()),
                               pa.array(log_p), pa.array(gumbel), pa.array(inclusion), pa.array(same, pa.bool_())]
                    names = [key, "sample", "n_pieces", "ids_crc32", "log_prob", "gumbel", "log_inclusion", "round_trip"]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids)))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"{key} {dict(docs.dtypes)[key]}, sample long, n_pieces long, ids_crc32 long, log_prob double, gumbel double, log_inclusion double, round_trip boolean"
    return docs.select(key, "text", F.xxhash64(key).alias("seed")).mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded`` with ``text`` put together from its ``ids`` (null ids: null); a column of that name is replaced."""
    encoded = encoded.drop("text")

    def run(batches):
        pieces = _pieces(model)
        for batch in batches:
            column = batch.column("ids")
            size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(size)
            data, at = pieces.decode(column.flatten().to_numpy(zero_copy_only=False), ends)
            text = [data[a:b].tobytes()[1:].decode("utf-8", "replace") if column[i].is_valid else None for i, (a, b) in enumerate(zip(np.concatenate([[0], at[:-1]]), at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], [*batch.schema.names, "text"])

    return encoded.mapInArrow(run, f"{', '.join(f'`{n}` {t}' for n, t in encoded.dtypes)}, text string")
