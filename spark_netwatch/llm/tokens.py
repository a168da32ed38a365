"""Token ids of whole texts by a public byte-level BPE file, one call per distinct word of a batch."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct words whose ids a worker keeps between batches.
KEEP_WORDS = 300_000
#: Bytes of text handled at once.
SLICE_BYTES = 8 << 20


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Consecutive parts of ``batch`` whose ``column`` holds about ``limit`` bytes each (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def byte_characters() -> dict[str, int]:
    """The printable character that a byte-level vocabulary file writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Ids:
    """Ids of texts: ``encode`` gives a flat uint16 array and the texts' lengths.

    The vocabulary of the ``tokenizers`` file is read into the faster ``tiktoken``, whose ids are
    the same (a test compares the two). In the byte-level pattern a space between two visible
    characters always starts a new pre-token, so a text's ids are those of its space-led words in
    turn. Texts with other white space beside a space, or with a special token written out (which is
    that token's id, as in the library), are encoded whole.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        special = {x["content"] for x in model["added_tokens"]}
        byte_of = byte_characters()
        ranks = {bytes(byte_of[c] for c in word): i for word, i in model["model"]["vocab"].items() if word not in special}
        assert max(ranks.values()) < 1 << 16
        encoding = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={x["content"]: x["id"] for x in model["added_tokens"]})
        self.ids, self.special = encoding.encode_ordinary, sorted(special)
        self.whole_ids = lambda text: encoding.encode(text, allowed_special="all")
        self.kept: dict[str, bytes] = {}

    def _of(self, words: list[str]) -> list[bytes]:
        kept, found = self.kept, {}
        for w in words:
            if w not in kept:
                found[w] = np.array(self.ids(w), np.uint16).tobytes()
        out = [kept[w] if w in kept else found[w] for w in words]
        if len(kept) < KEEP_WORDS:
            kept |= found
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        lists = pc.split_pattern(texts, " ")
        ends = lists.offsets.to_numpy().astype(np.int64)
        ends -= ends[0]
        coded = lists.flatten().dictionary_encode()
        words, at, n = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(ends)
        row = np.repeat(np.arange(len(n)), n)
        first = np.zeros(len(at), bool)
        first[ends[:-1][n > 0]] = True
        odd_word = pc.or_(pc.not_equal(pc.utf8_trim_whitespace(words), words), pc.equal(pc.binary_length(words), 0)).to_numpy(zero_copy_only=False)
        odd = np.zeros(len(n), bool)
        odd[row[odd_word[at]]] = True
        for content in self.special:
            odd |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        used = ~odd[row]
        key = at + np.where(first, 0, len(words))
        seen = np.zeros(2 * len(words), bool)
        seen[key[used]] = True
        unit = np.flatnonzero(seen)
        led = words.take(pa.array(unit[unit >= len(words)] - len(words))).to_pylist()
        ids = self._of(words.take(pa.array(unit[unit < len(words)])).to_pylist() + [" " + w for w in led])
        whole = np.flatnonzero(odd)
        ids += [np.array(self.whole_ids(texts[int(i)].as_py()), np.uint16).tobytes() for i in whole]
        place = np.cumsum(seen) - 1
        # one entry a word, or one for a whole odd text, in the order of the texts
        keys = np.concatenate([place[key[used]], len(unit) + np.arange(len(whole))])
        rows = np.concatenate([row[used], whole])
        if len(whole):
            order = np.argsort(rows, kind="stable")
            keys, rows = keys[order], rows[order]
        flat = np.frombuffer(b"".join(ids), np.uint16)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        starts = np.cumsum(sizes) - sizes
        counts = sizes[keys]
        total = np.cumsum(counts)
        take = np.arange(total[-1] if len(total) else 0) + np.repeat(starts[keys] - (total - counts), counts)
        return flat[take], np.bincount(rows, counts, len(n)).astype(np.int64)
