"""Packing of token sequences by cutting stock with column generation.

Blocks of `size` tokens fill a sequence each. What is left of a document is one of size - 1
lengths: their histogram sets the demands of a linear program over patterns (lengths that share a
sequence), whose columns a knapsack dynamic program prices. Patterns that fill a sequence are used
as often as the rounded-down solution says and assigned to the documents ranked within each
length. The rest of the documents lie end to end and are cut at the sequences' ends; the very last
tokens go to sequences of powers of two. So no sequence needs padding.

What the driver holds is bounded by `size`: the histogram, the basis and the patterns.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import arrow_schema, materialise, partitions, record_batch, texts

SIZE, END_ID = 1024, 0
#: Columns that enter the basis at most; the LP stops at a gap of GAP anyway.
PIVOTS, GAP = 150, 0.001
#: Longest run without (or of) white space that the fast byte-pair encoder gets.
_LONG_RUN = re.compile(r"\S{4000}|\s{4000}")
_encoders: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _plain_byte_bpe(spec: dict) -> dict[bytes, int] | None:
    """Ranks of a byte-level BPE whose ids follow its merges and that splits by the usual pattern, else None."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if spec.get("normalizer") or model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(letter[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    made = [ranks[b"".join(bytes(letter[c] for c in x) for x in (m.split(" ") if isinstance(m, str) else m))] for m in model["merges"]]
    return ranks if made == sorted(made) else None


def encoder(path: str):
    """A function from texts to lists of ids, the same ids as tokenizers gives with add_special_tokens=False."""
    if path not in _encoders:
        import os

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ranks, added = _plain_byte_bpe(spec), re.compile("|".join(re.escape(t["content"]) for t in spec.get("added_tokens", [])) or "(?!)")
        fast = ranks and tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(rows: list[str]) -> list[list[int]]:
            # the fast encoder takes quadratic time in a run without a break, and it has no added tokens
            return [fast.encode_ordinary(t) if fast and not _LONG_RUN.search(t) and not added.search(t) else whole.encode(t, add_special_tokens=False).ids for t in rows]

        _encoders[path] = encode
    return _encoders[path]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


_TOKENS = "doc_id long, doc_tokens long, crcs array<long>, rest binary, rest_tokens int, rest_crc long"


def _tokenise(path: str, size: int, end_id: int):
    schema = arrow_schema(_TOKENS)

    def run(batches):
        encode = encoder(path)
        for doc_ids, rows in texts(batches, "doc_id", "text"):
            out = []
            for doc_id, ids in zip(doc_ids, encode([t or "" for t in rows]), strict=True):
                ids = np.array([*ids, end_id], dtype=np.uint32)
                full = len(ids) // size
                rest = ids[full * size :]
                # two bytes an id where all ids of the rest allow it; the length tells which
                packed = rest.astype("<u2") if not len(rest) or rest.max() < 1 << 16 else rest.astype("<u4")
                out.append((doc_id, len(ids), [_crc(ids[i * size : (i + 1) * size]) for i in range(full)], packed.tobytes(), len(rest), _crc(rest)))
            yield record_batch(schema, *map(list, zip(*out, strict=True)))

    return run


def _knapsack(value: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value of each capacity with any number of each length, and the index of the last item taken (-1: none)."""
    best, last = np.zeros(size + 1), np.full(size + 1, -1)
    upto = np.searchsorted(lengths, np.arange(size + 1), side="right")
    for c in range(1, size + 1):
        if n := upto[c]:
            got = value[:n] + best[c - lengths[:n]]
            i = int(got.argmax())
            if got[i] > best[c - 1]:
                best[c], last[c] = got[i], i
                continue
        best[c] = best[c - 1]
    return best, last


def _fill(c: int, last: np.ndarray, lengths: np.ndarray, m: int) -> np.ndarray:
    a = np.zeros(m)
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            a[last[c]] += 1
            c -= int(lengths[last[c]])
    return a


def _greedy(lengths: np.ndarray, demand: np.ndarray, size: int, whole: bool):
    """Patterns, each led by the longest length left and closed by one or a pair that fits exactly if there is any.

    Each is used until a length of it is exhausted and leaves, so the patterns are as many as the
    lengths and, taken as columns, triangular: a basis. whole: only whole numbers of uses.
    """
    place = np.full(size + 1, -1)
    place[lengths] = np.arange(len(lengths))
    there, left = place >= 0, demand.copy()
    for top in range(size, 0, -1):
        while there[top]:
            a, need = np.zeros(len(lengths)), size - top
            a[place[top]] = 1
            while need > 0:
                if there[need]:
                    a[place[need]] += 1
                    break
                half = np.flatnonzero(there[1:need] & there[1:need][::-1]) + 1
                if len(half):
                    a[place[half[-1]]] += 1
                    a[place[need - half[-1]]] += 1
                    break
                under = np.flatnonzero(there[: need + 1])
                if not len(under):
                    break
                a[place[under[-1]]] += 1
                need -= int(under[-1])
            used = np.flatnonzero(a)
            ratio = left[used] // a[used] if whole else left[used] / a[used]
            n = ratio.min()
            left[used] -= n * a[used]
            gone = used[ratio.argmin()]
            there[lengths[gone]] = False
            if not whole:
                left[gone] = 0
            yield a, n, gone


def _enter(a: np.ndarray, inverse: np.ndarray, basis: np.ndarray, x: np.ndarray) -> None:
    """The column takes the place of the one that it drives to zero first."""
    step = inverse @ a
    rows = np.flatnonzero(step > 1e-9)
    ratio = np.maximum(x[rows], 0) / step[rows]
    r = rows[int(ratio.argmin())]
    theta = float(ratio.min())
    x -= theta * step
    x[r] = theta
    inverse[r] /= step[r]
    step[r] = 0
    inverse -= np.outer(step, inverse[r])
    basis[:, r] = a


def solve(demand: dict[int, int], size: int = SIZE, pivots: int = PIVOTS, batch: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, basis (a column per pattern) and use of each pattern in the linear program's solution."""
    lengths = np.array(sorted(x for x, n in demand.items() if n > 0 and 0 < x < size), dtype=np.int64)
    d = np.array([demand[int(x)] for x in lengths], dtype=float)
    columns = list(_greedy(lengths, d, size, False))
    if not columns:
        return lengths, np.zeros((0, 0)), np.zeros(0)
    basis = np.stack([a for a, _, _ in columns], axis=1)
    x = np.array([n for _, n, _ in columns], dtype=float)
    inverse = np.linalg.inv(basis)
    floor = float((d * lengths).sum()) / size  # no solution uses fewer sequences
    entered = 0
    while entered < pivots and x.sum() > floor * (1 + GAP):
        y = inverse.sum(axis=0)
        best, last = _knapsack(y, lengths, size)
        if best[size] <= 1 + 1e-7:
            break
        worth, before = y + best[size - lengths], entered
        for i in np.argsort(-worth)[:batch]:
            a = _fill(int(size - lengths[i]), last, lengths, len(lengths))
            a[i] += 1
            if inverse.sum(axis=0) @ a > 1 + 1e-7:  # the columns that came before have changed the prices
                _enter(a, inverse, basis, x)
                entered += 1
        if entered == before:
            break
    return lengths, basis, x


def patterns(demand: dict[int, int], size: int = SIZE) -> list[tuple[dict[int, int], int]]:
    """Patterns that fill a sequence exactly and how often to use each; together they use no length more than its demand.

    First those of the linear program, rounded down, then whole ones for what they leave.
    """
    lengths, basis, x = solve(demand, size)
    left, out = np.array([demand[int(v)] for v in lengths], dtype=float), []

    def use(a, n):
        if a @ lengths == size:
            used = a > 0
            n = min(n, int((left[used] // a[used]).min()))
            if n > 0:
                left[used] -= n * a[used]
                out.append(({int(v): int(k) for v, k in zip(lengths[used], a[used], strict=True)}, n))

    for r in np.argsort(-x):
        use(basis[:, r], int(x[r] + 1e-6))
    there = left > 0
    for a, n, _ in list(_greedy(lengths[there], left[there], size, True)):
        full = np.zeros(len(lengths))
        full[there] = a
        use(full, int(n))
    return out


class Plan:
    """Where the rest of a document goes, by its length and its rank within the length."""

    def __init__(self, demand: dict[int, int], size: int):
        self.size, self.slots, sequence, covered = size, {}, 0, {}
        for pattern, n in patterns(demand, size):
            offset = 0
            for length, copies in pattern.items():
                first = covered.get(length, 0)
                self.slots.setdefault(length, []).append((first, first + copies * n, sequence, copies, offset))
                covered[length] = first + copies * n
                offset += length * copies
            sequence += n
        self.sequences, self.covered, self.base, at = sequence, covered, {}, 0
        for length in sorted(demand):
            self.base[length] = at
            at += length * (demand[length] - covered.get(length, 0))
        self.stream, tail = at // size, at % size
        self.ends = np.cumsum([1 << b for b in range(size.bit_length() - 1, -1, -1) if tail >> b & 1])

    def pieces(self, length: int, rank: int):
        """(start in the rest, length, sequence, offset in it), sequences from 0, those of the stream after the patterns'."""
        if rank < self.covered.get(length, 0):
            for first, end, sequence, copies, offset in self.slots[length]:
                if first <= rank < end:
                    q, r = divmod(rank - first, copies)
                    return [(0, length, sequence + q, offset + r * length)]
        at, done, out = self.base[length] + (rank - self.covered.get(length, 0)) * length, 0, []
        while done < length:
            o = at + done
            if o < self.stream * self.size:
                sequence, offset = divmod(o, self.size)
                room = self.size - offset
            else:
                o -= self.stream * self.size
                k = int(np.searchsorted(self.ends, o, side="right"))
                sequence, offset = self.stream + k, o - (int(self.ends[k - 1]) if k else 0)
                room = int(self.ends[k]) - o
            out.append((done, min(room, length - done), self.sequences + sequence, offset))
            done += out[-1][1]
        return out


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _assign(plan: Plan):
    schema, size = arrow_schema(_PIECES), plan.size

    def run(batches):
        blocks_from = plan.sequences + plan.stream + len(plan.ends)
        for b in batches:
            out = []
            for r in b.to_pylist():
                doc, n, crcs = r["doc_id"], r["doc_tokens"], r["crcs"] or []
                out += [(doc, j * size, size, c, n, blocks_from + r["block"] + j, 0) for j, c in enumerate(crcs)]
                if length := r["rest_tokens"]:
                    placed = plan.pieces(length, r["rank"])
                    ids = np.frombuffer(r["rest"], "<u2" if len(r["rest"]) == 2 * length else "<u4") if len(placed) > 1 else None
                    for start, k, sequence, offset in placed:
                        out.append((doc, len(crcs) * size + start, k, r["rest_crc"] if ids is None else _crc(ids[start : start + k]), n, sequence, offset))
            if out:
                yield record_batch(schema, *map(list, zip(*out, strict=True)))

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents of docs (doc_id, text), each token in exactly one.

    doc_id, start (the document's tokens before it), length, ids_crc32 (of its ids as little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset. A document is its ids and end_id; a null text
    is empty, so its one token is end_id. Repeated rows are packed one by one. size is a power of two.
    """
    if size < 2 or size & (size - 1):
        raise ValueError("size must be a power of two")
    spark = docs.sparkSession
    tokens = materialise(docs.select("doc_id", "text").mapInArrow(_tokenise(tokenizer or default_tokenizer(), size, end_id), _TOKENS), "tokens")
    salts = partitions(spark)
    tokens = tokens.withColumn("salt", F.pmod(F.xxhash64("doc_id", "rest_crc"), F.lit(salts)).cast("int")).withColumn("blocks", F.size("crcs").cast("long"))
    counts = tokens.groupBy("rest_tokens", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("blocks").alias("b"))
    # one row per length: fewer than size rows reach the driver
    by_length = {r.rest_tokens: (r.n, r.b) for r in counts.groupBy("rest_tokens").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).collect()}
    plan = Plan({k: n for k, (n, _) in by_length.items() if k}, size)
    before, at = {}, 0
    for k in sorted(by_length):
        before[k], at = at, at + by_length[k][1]
    prior = Window.partitionBy("rest_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)  # one row a salt
    shifts = counts.select("rest_tokens", "salt", F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("n0"), F.coalesce(F.sum("b").over(prior), F.lit(0)).alias("b0"))
    ordered = Window.partitionBy("rest_tokens", "salt").orderBy("doc_id", "doc_tokens", "rest_crc")
    ranked = tokens.withColumn("k", F.row_number().over(ordered) - 1).withColumn("b", F.sum("blocks").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - F.col("blocks"))
    starts = F.create_map(*[F.lit(x) for kv in before.items() for x in (kv[0], int(kv[1]))]) if before else None
    block = F.col("b") + F.col("b0") + (F.element_at(starts, F.col("rest_tokens")) if before else F.lit(0))
    placed = ranked.join(shifts, ["rest_tokens", "salt"]).select("doc_id", "doc_tokens", "crcs", "rest", "rest_tokens", "rest_crc", (F.col("k") + F.col("n0")).alias("rank"), block.alias("block"))
    return placed.mapInArrow(_assign(plan), _PIECES)
