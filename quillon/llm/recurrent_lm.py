"""A gated recurrent language model: counts in Spark, numpy training in tasks, scores of whole documents.

Scan tasks cut the texts into words, a chunk of documents at a time, and deal a chunk's distinct
words into hash buckets; a bucket sums their counts over all training documents and sends them back
to the chunks, which become codes of a few bytes a token. The most frequent words (head) have a code
each, HEAD_RATE times the square root of the number of types of them, so the network's vocabulary grows
with the corpus; any other word has that of its tail class: its count's bin and its last letter.

The output is factored: a softmax over classes, then one over the words of a head class; in a tail
class words share by their counts, and unseen words have the share that Good and Turing give them.
With no context the model is the unigram model, so what training adds is context.

Training covers every training document once, in ROUNDS parts. A part's documents are dealt by hash
into shards of about SHARD_TOKENS tokens, whatever files and tasks they come from, and sorted in
them; each shard runs truncated backpropagation from the round's parameters, and the results are averaged by
tokens in Spark. A long text is trained in pieces of PIECE tokens, each of which begins with an empty state but knows the code before it;
scores carry the state through the whole text. So the scores don't depend on the layout of the files. The driver holds one model,
the head words and sums per tail class.
A word is told by 52 bits of its hash, its bucket and its last letter.
"""

from __future__ import annotations

import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import U64, arrow_schema, discard, hash_words, materialise, mix, partitions, record_batch

#: Head words by the square root of the types, head words at least, and letters of tail classes.
HEAD_RATE, LEAST_HEAD, LETTERS = 4, 256, 16
#: Least counts of the bins of tail words; the first bin holds unseen words too.
BINS = (0, 2, 8)
EMBED, HIDDEN = 16, 24
#: Truncated backpropagation: steps of a window, documents side by side, parts of the training documents, tokens of a shard of a part.
STEPS, LANES, ROUNDS, SHARD_TOKENS = 32, 256, 3, 600_000
RATE, CLIP = 0.02, 1.0
#: Rows of logits that are worked on at once, tokens of a piece of a text in training, and lanes of which fewer get longer windows in scoring.
BLOCK, PIECE, FEW_LANES = 2048, 1024, 64
#: Tokens of an update at least, and the share of the past in the running mean of parameters that a task returns.
UPDATE_TOKENS, MEAN = 2048, 0.95
#: Characters of a chunk of documents and tokens that are trained or scored side by side.
CHUNK_CHARS, CHUNK_TOKENS = 6_000_000, 2_000_000
#: Characters of the corpus for each hash bucket of words.
BUCKET_CHARS = 10_000_000
TAIL_CLASSES = len(BINS) * LETTERS
_END = 0x454E44454E44454E
_CHUNKS = "chunk long, bucket int, hashes binary, counts binary, ids array<long>, sizes binary, words binary, letters binary"
_BACK = "chunk long, bucket int, counts binary, cut long, tags binary, top_hash array<long>, top_n array<long>, sums array<double>"
_CODED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, tail_score double, codes binary"


def _squeeze(a: np.ndarray) -> bytes:
    """Compressed bytes of an array, all first bytes before all second ones."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), -1).T.tobytes())


def _unsqueeze(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(kind) if len(raw) else np.zeros(0, kind)


def head_size(types: int) -> int:
    """Words of the head, a power of four, so that classes are as many as their words."""
    return max(LEAST_HEAD, 4 ** round(math.log(max(1, HEAD_RATE * math.sqrt(types)), 4)))


class Sizes:
    """Sizes of the network for a head of so many words."""

    def __init__(self, head: int):
        self.head, self.class_words = head, math.isqrt(head)
        self.head_classes = head // self.class_words
        self.classes, self.codes = self.head_classes + TAIL_CLASSES, head + TAIL_CLASSES
        self.kind = np.uint16 if self.codes <= 1 << 15 else np.int32
        self.shapes = {"embed": (self.codes, EMBED), "wx": (EMBED, 3 * HIDDEN), "wh": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,), "wc": (HIDDEN, self.classes), "bc": (self.classes,), "ww": (self.head_classes, HIDDEN, self.class_words), "bw": (self.head_classes, self.class_words)}

    def flat(self, p) -> np.ndarray:
        return np.concatenate([p[k].ravel() for k in self.shapes])

    def views(self, v: np.ndarray) -> dict[str, np.ndarray]:
        at = np.cumsum([0, *(int(np.prod(s)) for s in self.shapes.values())])
        return {k: v[a:b].reshape(s) for (k, s), a, b in zip(self.shapes.items(), at[:-1], at[1:], strict=True)}

    def unflat(self, v: np.ndarray) -> dict[str, np.ndarray]:
        return {k: x.astype(np.float32) for k, x in self.views(v).items()}


def is_held_out(doc_id: int | None) -> bool:
    """Every tenth id by crc32; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def _coder(buckets: int):
    schema = arrow_schema(_CHUNKS)

    def chunk_rows(number, ids, text):
        # lower case first: ascii_lower of a cast slice reads it from a wrong place (pyarrow 23)
        lists = pc.ascii_split_whitespace(pc.ascii_lower(text).fill_null("").cast(pa.large_string()))
        flat, of = lists.flatten(), pc.list_parent_indices(lists)
        full = pc.greater(pc.binary_length(flat), 0)
        flat, of = flat.filter(full), of.filter(full).to_numpy()
        sizes = np.bincount(of, minlength=len(ids)).astype(np.uint32)
        coded = flat.dictionary_encode()
        words = coded.dictionary.cast(pa.large_binary())
        _, at, data = words.buffers()
        at, data = np.frombuffer(at, np.int64)[words.offset :][: len(words) + 1], data.to_pybytes() if len(words) else b""
        letter = np.concatenate([[0], np.frombuffer(data, np.uint8)[at[1:] - 1] % LETTERS]).astype(np.uint8)
        words = [data[i:j] for i, j in itertools.pairwise(at.tolist())]
        h = np.concatenate([np.array([_END], dtype=U64), hash_words(words)])
        bucket = (mix(h, 0xC2B2AE3D27D4EB4F) % U64(buckets)).astype(np.int32)
        h = ((h >> U64(8)) & ~U64(LETTERS - 1)) | letter.astype(U64)
        # each document's words, then the end
        at = np.zeros(len(of) + len(ids), dtype=np.int64)
        at[np.arange(len(of)) + of] = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
        doc = np.repeat(np.arange(len(ids)), sizes + 1)
        trained = ~np.array([is_held_out(i) for i in ids])
        n = np.bincount(at[trained[doc]], minlength=len(h)).astype(np.uint32)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), dtype=np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        yield number, -1, None, None, ids, sizes.tobytes(), _squeeze(rank[at]), _squeeze(letter[order])
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(ends)):
            i = order[ends[k] : ends[k + 1]]
            yield number, int(k), h[i].view(np.uint8).reshape(-1, 8)[:, :7].tobytes(), _squeeze(n[i]), None, None, None, None

    def code(batches):
        number = (TaskContext.get().partitionId() << 32) - 1
        for b in batches:
            size = pc.binary_length(b.column("text")).fill_null(0).to_numpy().astype(np.int64)
            part = (np.cumsum(size) - size) // CHUNK_CHARS
            for p in np.unique(part):
                i, j = np.searchsorted(part, [p, p + 1])
                number += 1
                rows = list(chunk_rows(number, b.column("doc_id")[i:j].to_pylist(), b.column("text")[i:j]))
                yield record_batch(schema, *map(list, zip(*rows, strict=True)))

    return code


def _bin(c: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array(BINS[1:]), c, side="right")


def _sums(c: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """Per tail class tokens, then types; per letter words seen once and twice."""
    cls = _bin(c) * LETTERS + letter
    seen = c > 0
    return np.concatenate([np.bincount(cls, c, TAIL_CLASSES), np.bincount(cls[seen], minlength=TAIL_CLASSES), np.bincount(letter[c == 1], minlength=LETTERS), np.bincount(letter[c == 2], minlength=LETTERS)])


def _count(group: pa.Table, buckets: int) -> pa.Table:
    """The counts of a bucket's words over all chunks, for each chunk, and the bucket's top words and sums."""
    chunks, hashes, counts = (group.column(c).to_pylist() for c in ("chunk", "hashes", "counts"))
    bucket = group.column("bucket")[0].as_py()
    sizes = [len(x) // 7 for x in hashes]
    h = np.zeros((sum(sizes), 8), np.uint8)
    h[:, :7] = np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 7)
    del hashes
    word, which = np.unique(h.view(U64).ravel(), return_inverse=True)
    n = np.concatenate([_unsqueeze(x, np.uint32) for x in counts])
    total = np.bincount(which, n, len(word)).astype(np.int64)
    # four times a bucket's share of the head, for as many types as its words stand for
    top = np.lexsort((word, -total))[: 4 * head_size(buckets * len(word)) // buckets + 64]
    cut = max(1, int(total[top[-1]]))
    ends = np.cumsum(sizes)
    rows = [(-1, bucket, None, None, None, word[top].astype(np.int64), total[top], _sums(total, (word % U64(LETTERS)).astype(np.int64)))]
    for chunk, a, b in zip(chunks, [0, *ends[:-1]], ends, strict=True):
        own = which[a:b]
        tags = word[own][total[own] >= cut].astype(np.uint32)
        rows.append((chunk, bucket, _squeeze(total[own]), cut, tags.tobytes(), None, None, None))
    return pa.Table.from_batches([record_batch(arrow_schema(_BACK), *map(list, zip(*rows, strict=True)))])


class Vocabulary:
    """Head words, and the shares within tail classes; bounded whatever the corpus."""

    def __init__(self, head: list[tuple[int, int]], sums: np.ndarray):
        """head: (hash, count) from the most frequent on; sums: see _sums, over all words."""
        self.sizes = Sizes(head_size(int(round(sums[TAIL_CLASSES : 2 * TAIL_CLASSES].sum()))))
        head = head[: self.sizes.head]
        self.hash, self.n = (np.array([x[k] for x in head], dtype=np.int64) for k in (0, 1))
        self.tokens = int(round(sums[:TAIL_CLASSES].sum()))
        self.types = int(round(sums[TAIL_CLASSES : 2 * TAIL_CLASSES].sum()))
        rest = sums - _sums(self.n, self.hash % LETTERS)
        self.mass, self.once, self.twice = rest[:TAIL_CLASSES], rest[2 * TAIL_CLASSES : -LETTERS], rest[-LETTERS:]
        key = self._key(self.hash.astype(np.uint32), self.n)
        self.order = np.argsort(key)
        self.keys = key[self.order]

    @staticmethod
    def _key(tag, n):
        return mix(tag.astype(U64) ^ (n.astype(U64) << U64(32)), 0x94D049BB133111EB)

    def codes(self, c: np.ndarray, letter: np.ndarray, tag: np.ndarray, tagged: np.ndarray) -> np.ndarray:
        """Codes of words with counts c, last letters, and tags where tagged."""
        out = self.sizes.head + _bin(c) * LETTERS + letter
        if len(self.keys) and tagged.any():
            key = self._key(tag, c[tagged])
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[tagged] = np.where(self.keys[at] == key, self.order[at], out[tagged])
        return out.astype(self.sizes.kind)

    def within(self, c: np.ndarray, code: np.ndarray) -> np.ndarray:
        """log10 of the share of a word in its tail class; 0 for head words."""
        head = self.sizes.head
        cls = np.maximum(code.astype(np.int64) - head, 0)
        letter = cls % LETTERS
        once = np.where(self.once > 0, np.maximum(2 * self.twice, 0.1 * self.once), 0)
        unseen = np.maximum(self.once, 0.5)
        low = np.where(c > 0, once[letter] / np.maximum(self.once[letter], 1), unseen[letter]) / (once + unseen)[letter]
        share = np.where(cls < LETTERS, low, c / np.maximum(self.mass[cls], 1))
        return np.where(code >= head, np.log10(np.maximum(share, 1e-300)), 0.0)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.tokens + 0.1 * (self.types + 1)))

    def start(self, seed: int = 7) -> dict[str, np.ndarray]:
        """Parameters that give the unigram model: small random weights, no effect of the state, biases by counts."""
        rng, z = np.random.default_rng(seed), self.sizes
        p = {k: np.zeros(s, dtype=np.float32) for k, s in z.shapes.items()}
        for k in ("embed", "wx", "wh"):
            p[k] = (rng.standard_normal(z.shapes[k]) * (0.5 if k == "embed" else 0.25)).astype(np.float32)
        n = np.zeros(z.head)
        n[: len(self.n)] = self.n
        n = n.reshape(z.head_classes, z.class_words)
        p["bw"] = np.where(n > 0, np.log(np.maximum(n, 1)), -30).astype(np.float32)
        mass = np.concatenate([n.sum(axis=1), self.mass])
        mass[z.head_classes : z.head_classes + LETTERS] += 0.5
        p["bc"] = np.where(mass > 0, np.log(np.maximum(mass, 0.5)), -30).astype(np.float32)
        return p


def _encoder(vocabulary: Vocabulary):
    schema = arrow_schema(_CODED)

    def encode(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["bucket"])
        own, back = rows[0], rows[1:]
        c = np.concatenate([_unsqueeze(r["counts"], np.int64) for r in back])
        cut = np.repeat([r["cut"] for r in back], [len(_unsqueeze(r["counts"], np.int64)) for r in back])
        tag = np.frombuffer(b"".join(r["tags"] for r in back), np.uint32)
        code = vocabulary.codes(c, _unsqueeze(own["letters"], np.uint8).astype(np.int64), tag, c >= cut)
        at = _unsqueeze(own["words"], np.uint32)
        sizes = np.frombuffer(own["sizes"], np.uint32).astype(np.int64) + 1
        first = np.cumsum(sizes) - sizes
        add = lambda x: np.add.reduceat(x[at], first)
        codes = code[at]
        ids = own["ids"]
        texts = [codes[a : a + n].tobytes() for a, n in zip(first, sizes, strict=True)]
        return pa.Table.from_batches([record_batch(schema, ids, [is_held_out(i) for i in ids], sizes, add((c > 0).astype(np.int64)), add(vocabulary.base(c)), add(vocabulary.within(c, code)), texts)])

    return encode


class _Ready:
    """A network's parameters as its windows use them: a table of the gates by code (the last row: no code), gates apart, biases
    as a last row of weights. And the arrays that each window fills anew."""

    def __init__(self, p):
        self.arrays, self.ones = {}, np.ones(max(p["bc"].size, p["bw"].shape[1]), dtype=np.float32)
        self.rows = np.arange(BLOCK)
        self.load(p)

    def array(self, name: str, *shape: int) -> np.ndarray:
        """The array of a name, with what the window before has left in it."""
        size = math.prod(shape)
        if len(self.arrays.get(name, ())) < size:
            self.arrays[name] = np.empty(size, dtype=np.float32)
        return self.arrays[name][:size].reshape(shape)

    def load(self, p):
        d = HIDDEN
        self.head_classes, self.width = p["bw"].shape
        apart = lambda w: np.ascontiguousarray(w.reshape(len(w), 3, d).transpose(1, 0, 2))
        # the halves of tanh(x / 2), for z and r
        half = np.repeat(np.array([0.5, 0.5, 1], dtype=np.float32), d)
        self.table = self.array("table", 3, len(p["embed"]) + 1, d)
        for own, w in zip(self.table, apart(p["wx"] * half), strict=True):
            np.matmul(p["embed"], w, out=own[:-1])
            own[-1] = 0
        self.table += apart(p["b"][None] * half)
        self.wh = apart(p["wh"] * half).astype(np.float32)
        self.back = np.ascontiguousarray(p["wh"].T).astype(np.float32)
        # states lie between -1 and 1, so with largest bias 0 exp is safe as long as no word's weights are large
        self.wc, self.ww = (np.concatenate([w, b - b.max(axis=-1, keepdims=True)], axis=-2).astype(np.float32) for w, b in ((p["wc"], p["bc"][None]), (p["ww"], p["bw"][:, None])))
        self.high, self.word_high = (np.abs(w[..., :d, :]).sum(axis=-2).max(axis=-1) > 40 for w in (self.wc, self.ww))


def _softmax(q: _Ready, h: np.ndarray, w: np.ndarray, target: np.ndarray, high: bool, grad=None):
    """Log-likelihoods of the targets by the logits h @ w; with grad also the gradients of their negative sum: of w, added to grad, and of h."""
    x = np.matmul(h, w, out=q.array("logits", len(h), w.shape[1]))
    if high:
        x -= x.max(axis=1, keepdims=True)
    flat, at = x.reshape(-1), q.rows[: len(x)] * x.shape[1] + target
    ll = flat[at]
    np.exp(x, out=x)
    total = x @ q.ones[: x.shape[1]]
    ll -= np.log(total)
    if grad is None:
        return ll, None
    # the rows' common factor is left to the narrow sides
    flat[at] -= total
    total = (1 / total)[:, None]
    grad += (h * total).T @ x
    dh = x @ w[:HIDDEN].T
    dh *= total
    return ll, dh


def _output(p, h: np.ndarray, code: np.ndarray, grad=None, ready: _Ready | None = None):
    """Log-likelihoods of the codes after states h; with grad, adds to it and returns the gradient of h too."""
    q, d = ready or _Ready(p), HIDDEN
    classes, width = q.head_classes, q.width
    cls = np.where(code < classes * width, code // width, classes - classes * width + code).astype(np.uint16 if q.wc.shape[1] < 1 << 16 else np.int32)
    order = np.argsort(cls, kind="stable")
    cls, word = cls[order].astype(np.int64), code[order] % width
    own = q.array("own", len(h), d + 1)
    own[:, :d], own[:, d] = h[order], 1
    ll, dh = np.empty(len(h), dtype=np.float32), None
    dwc = dww = None
    if grad is not None:
        dh, dwc, dww = q.array("dh", len(h), d), q.array("dwc", *q.wc.shape), q.array("dww", *q.ww.shape)
        dwc[:], dww[:] = 0, 0
    for a in range(0, len(h), BLOCK):
        i = slice(a, a + BLOCK)
        ll[i], got = _softmax(q, own[i], q.wc, cls[i], q.high, dwc)
        if got is not None:
            dh[i] = got
    ends = np.searchsorted(cls, np.arange(classes + 1))
    for k in np.flatnonzero(np.diff(ends)):
        for a in range(ends[k], ends[k + 1], BLOCK):
            i = slice(a, min(a + BLOCK, ends[k + 1]))
            more, got = _softmax(q, own[i], q.ww[k], word[i], q.word_high[k], None if dww is None else dww[k])
            ll[i] += more
            if got is not None:
                dh[i] += got
    out = np.empty_like(ll)
    out[order] = ll
    if grad is None:
        return out, None
    for w, b, x in (("wc", "bc", dwc), ("ww", "bw", dww)):
        grad[w] += x[..., :d, :]
        grad[b] += x[..., d, :]
    back = q.array("back", len(h), d)
    back[order] = dh
    return out, back


def _window(p, code: np.ndarray, before: np.ndarray, live: np.ndarray, h: np.ndarray, learn: bool, ready: _Ready | None = None, grad=None, fresh: np.ndarray | None = None):
    """One window: codes and the codes before them (steps by lanes), steps that are a document's (live: by lane), the state.

    fresh: where the state begins anew, in its absence where no code comes before. Returns the log-likelihoods (steps by lanes,
    0 where not live), the state after it, and the gradients, added to grad if it is given.
    """
    q, (steps, lanes), d = ready or _Ready(p), code.shape, HIDDEN
    kept = steps if learn else 1
    states, gates, new, rest = (q.array(name, *shape) for name, shape in (("states", (steps, lanes, d)), ("gates", (kept, 2, lanes, d)), ("new", (kept, lanes, d)), ("rest", (kept, lanes, d))))
    g, u = q.array("g", 3, lanes, d), q.array("u", 3, lanes, d)
    first, who = np.nonzero(before < 0 if fresh is None else fresh)
    ends = np.searchsorted(first, np.arange(steps + 1)).tolist()
    start = h
    for t in range(steps):
        if ends[t] < ends[t + 1]:
            h = h.copy()
            h[who[ends[t] : ends[t + 1]]] = 0
        k = t if learn else 0
        zr, n = gates[k], new[k]
        np.take(q.table, before[t], axis=1, out=g, mode="wrap")  # -1: the last row
        np.matmul(h, q.wh, out=u)
        np.add(g[:2], u[:2], out=zr)
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        np.multiply(zr[1], u[2], out=n)
        n += g[2]
        np.tanh(n, out=n)
        if learn:
            rest[t] = u[2]
        np.subtract(h, n, out=states[t])
        h = states[t]
        h *= zr[0]
        h += n
    at = None if live.min() == steps else np.flatnonzero((np.arange(steps)[:, None] < live[None, :]).ravel())
    picked = lambda x: x if at is None else x[at]
    if learn and grad is None:
        grad = {k: np.zeros(v.shape, dtype=np.float32) for k, v in p.items()}
    got, dflat = _output(p, picked(states.reshape(-1, d)), picked(code.ravel()).astype(np.int64), grad if learn else None, q)
    ll, dstates = got, dflat
    if at is not None:
        ll = np.zeros(steps * lanes, dtype=np.float32)
        ll[at] = got
    if learn:
        if at is not None:
            dstates = q.array("dstates", steps * lanes, d)
            dstates[:] = 0
            dstates[at] = dflat
        dstates = dstates.reshape(steps, lanes, d)
        past, by_z, by_n, by_r = (q.array(name, steps, lanes, d) for name in ("past", "by_z", "by_n", "by_r"))
        past[0], past[1:] = start, states[:-1]
        past[first, who] = 0
        z, r = gates[:, 0], gates[:, 1]
        # what a state's gradient is multiplied by for z, the new state and, of the latter's, r
        for t in range(steps):
            one = np.subtract(1, z[t], out=g[0])
            np.multiply(new[t], new[t], out=by_n[t])
            np.subtract(1, by_n[t], out=by_n[t])
            by_n[t] *= one
            np.subtract(past[t], new[t], out=by_z[t])
            by_z[t] *= z[t]
            by_z[t] *= one
            np.subtract(1, r[t], out=by_r[t])
            by_r[t] *= r[t]
            by_r[t] *= rest[t]
        # of the new state, z, r, and the state's part of the new state
        du, carry, more = q.array("du", steps, lanes, 4 * d), np.zeros((lanes, d), dtype=np.float32), q.array("more", lanes, d)
        for t in range(steps - 1, -1, -1):
            dh, own = dstates[t], du[t]
            dn = own[:, :d]
            dh += carry
            np.multiply(dh, by_z[t], out=own[:, d : 2 * d])
            np.multiply(dh, by_n[t], out=dn)
            np.multiply(dn, by_r[t], out=own[:, 2 * d : 3 * d])
            np.multiply(dn, r[t], out=own[:, 3 * d :])
            np.multiply(dh, z[t], out=carry)
            carry += np.matmul(own[:, d:], q.back, out=more)
            if ends[t] < ends[t + 1]:
                carry[who[ends[t] : ends[t + 1]]] = 0
        du = du.reshape(-1, 4 * d)
        grad["wh"] += past.reshape(-1, d).T @ du[:, d:]
        # steps that aren't live have no gradient: none comes back to them
        du, prev = du[:, : 3 * d], before.ravel()
        wx = np.roll(p["wx"], d, axis=1)
        embed = p["embed"][prev]
        embed[prev < 0] = 0
        grad["wx"] += np.roll(embed.T @ du, -d, axis=1)
        grad["b"] += np.roll(np.ones(len(du), dtype=np.float32) @ du, -d)
        order = np.argsort(prev.astype(np.int16) if len(p["embed"]) < 1 << 15 else prev, kind="stable")
        order = order[np.count_nonzero(prev < 0) :]
        prev = prev[order]
        cuts = np.flatnonzero(np.concatenate([[True], prev[1:] != prev[:-1]])) if len(prev) else prev
        if len(cuts):
            grad["embed"][prev[cuts]] += np.add.reduceat((du @ wx.T)[order], cuts, axis=0)
    return ll.reshape(steps, lanes), states[-1].copy(), grad


def _lanes(docs: list[np.ndarray], lanes: int):
    """Documents end to end in lanes of about equal length, longest lane first: codes and documents of each lane."""
    size = np.array([len(x) for x in docs])
    fill, where = np.zeros(min(lanes, len(docs)), dtype=np.int64), [[] for _ in range(min(lanes, len(docs)))]
    for i in np.argsort(-size, kind="stable"):
        k = int(fill.argmin())
        where[k].append(int(i))
        fill[k] += size[i]
    order = np.argsort(-fill, kind="stable")
    rng = np.random.default_rng(len(docs))
    for own in where:  # long and short ones mixed
        rng.shuffle(own)
    return [where[k] for k in order], fill[order]


def _run(p, docs: list[np.ndarray], learn=None, grad=None) -> np.ndarray:
    """Log-likelihood of each document's codes; with learn, each window's gradients are added to grad and learn(tokens) is called."""
    # in training a long text is several pieces that know the code before them, so that lanes are equally long
    most = PIECE if learn is not None else max(map(len, docs))
    cuts = [(i, a) for i, x in enumerate(docs) for a in range(0, len(x), most)]
    where, fill = _lanes([docs[i][a : a + most] for i, a in cuts], LANES)
    # the codes of each lane one after the other, those before them, and the places of the lanes
    order = [cuts[k] for own in where for k in own]
    codes = [docs[i][a : a + most] for i, a in order]
    size = np.array([len(x) for x in codes])
    first = np.cumsum(size) - size
    codes = np.concatenate(codes).astype(np.int32)
    before = np.empty_like(codes)
    before[1:] = codes[:-1]
    before[first] = [docs[i][a - 1] if a else -1 for i, a in order]
    fresh = np.zeros(len(codes), dtype=bool)
    fresh[first] = True
    lane = np.cumsum(fill) - fill
    told = np.zeros(len(codes), dtype=np.float32)
    state = np.zeros((len(where), HIDDEN), dtype=np.float32)
    ready, a = _Ready(p), 0
    while a < fill[0]:
        n = int(np.searchsorted(-fill, -a, side="left"))  # lanes that go on
        # where few lanes go on, a window that isn't learned from is longer
        live = np.minimum(fill[:n] - a, STEPS if learn is not None else STEPS * max(1, FEW_LANES // n))
        steps = np.arange(int(live.max()))[:, None]
        at = lane[None, :n] + (a + np.minimum(steps, live - 1))
        ll, state, _ = _window(p, codes[at], before[at], live, state[:n], learn is not None, ready, grad, fresh[at])
        if learn is not None:
            learn(int(live.sum()))
            ready.load(p)
        else:
            over = steps < live
            told[at[over]] = ll[over]
        a += len(steps)
    out = np.zeros(len(docs))
    if learn is None:
        out[[i for i, _ in order]] = np.add.reduceat(told, first, dtype=np.float64)
    return out


def _gathered(batches, kind, *columns):
    """Lists of rows of about CHUNK_TOKENS tokens: the columns, and codes as arrays."""
    rows, size = [], 0
    for b in batches:
        for r in zip(*(b.column(c).to_pylist() for c in (*columns, "codes")), strict=True):
            rows.append((*r[:-1], np.frombuffer(r[-1], kind)))
            size += len(rows[-1][-1])
            if size >= CHUNK_TOKENS:
                yield list(zip(*rows, strict=True))
                rows, size = [], 0
    if rows:
        yield list(zip(*rows, strict=True))


_PART = "block int, part int, weight double, shard int, vals binary"
_BLOCK = 1024


def _trainer(flat: np.ndarray, rate: float, sizes: Sizes):
    """What a shard's documents make of the parameters, in blocks."""

    def train(group: pa.Table) -> pa.Table:
        v, mean, m, s, held, g, x = flat.copy(), flat.copy(), *(np.zeros_like(flat) for _ in range(5))
        p, grad = sizes.views(v), sizes.views(held)
        steps = tokens = waiting = 0

        def update():
            nonlocal steps, tokens, waiting
            np.divide(held, waiting, out=g)
            g[:] *= min(1.0, CLIP / (float(np.sqrt(g @ g)) + 1e-12))
            steps, tokens, waiting = steps + 1, tokens + waiting, 0
            held[:] = 0
            m[:] *= 0.9
            m[:] += np.multiply(g, 0.1, out=x)
            s[:] *= 0.99
            s[:] += np.multiply(np.multiply(g, g, out=x), 0.01, out=x)
            np.sqrt(np.multiply(s, 1 / (1 - 0.99**steps), out=x), out=x)
            x[:] += 1e-6
            np.divide(m, x, out=x)
            v[:] -= np.multiply(x, rate / (1 - 0.9**steps), out=x)
            mean[:] += np.multiply(np.subtract(v, mean, out=x), 1 - MEAN, out=x)

        def learn(n):
            nonlocal waiting
            waiting += n
            if waiting >= UPDATE_TOKENS:
                update()

        # the same order whatever tasks the rows come from
        ids, codes = group.column("doc_id").to_pylist(), group.column("codes").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, codes[i]))
        docs, size = [], 0
        for i in order:
            docs.append(np.frombuffer(codes[i], sizes.kind))
            size += len(docs[-1])
            if size >= CHUNK_TOKENS:
                _run(p, docs, learn, grad)
                docs, size = [], 0
        if docs:
            _run(p, docs, learn, grad)
        if waiting:
            update()
        cuts, part = range(0, len(mean), _BLOCK), group.column("shard")[0].as_py() % 64
        return pa.Table.from_batches([record_batch(arrow_schema(_PART), [i // _BLOCK for i in cuts], [part] * len(cuts), [float(tokens)] * len(cuts), [group.column("shard")[0].as_py()] * len(cuts), [mean[i : i + _BLOCK].astype(np.float32).tobytes() for i in cuts])])

    return train


def _average(group: pa.Table) -> pa.Table:
    rows = sorted(zip(*(group.column(c).to_pylist() for c in ("shard", "weight", "vals")), strict=True))
    weight = sum(w for _, w, _ in rows)
    mean = (sum(w * np.frombuffer(x, np.float32).astype(float) for _, w, x in rows) / weight).astype(np.float32).tobytes()
    return pa.Table.from_batches([record_batch(arrow_schema(_PART), [group.column("block")[0].as_py()], [group.column("part")[0].as_py()], [float(weight)], [rows[0][0]], [mean])])


def _fit(coded: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    sizes = vocabulary.sizes
    flat = sizes.flat(vocabulary.start())
    turn = F.pmod(F.xxhash64(F.lit("turn"), "doc_id"), ROUNDS)
    shards = max(1, round(vocabulary.tokens / ROUNDS / SHARD_TOKENS))
    # one document is in one shard, whatever its length; copies of a text with ids of their own are spread
    dealt = coded.where(~F.col("held_out")).select("doc_id", "codes", turn.alias("turn"), F.pmod(F.xxhash64(F.lit("shard"), "doc_id", "codes"), F.lit(shards)).cast("int").alias("shard"))
    for k in range(ROUNDS):
        part = dealt.where(F.col("turn") == k).repartition(shards, "shard").groupBy("shard").applyInArrow(_trainer(flat, RATE * 0.5**k, sizes), _PART)
        mean = part.groupBy("block", "part").applyInArrow(_average, _PART).groupBy("block").applyInArrow(_average, _PART)
        rows = mean.select("block", "vals").collect()  # one model
        if rows:
            flat = np.concatenate([np.frombuffer(r.vals, np.float32) for r in sorted(rows)])
    return flat


def _scorer(flat: np.ndarray, sizes: Sizes):
    schema = arrow_schema("doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")

    def score(batches):
        p = sizes.unflat(flat)
        for *rest, tail, docs in _gathered(batches, sizes.kind, "doc_id", "held_out", "n_tokens", "n_known", "base_score", "tail_score"):
            yield record_batch(schema, *map(list, rest), np.array(tail) + _run(p, docs) / np.log(10))

    return score


def score_documents(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Learns from the rows that is_held_out leaves (repeated rows count each time) and scores all.
    Words are runs of other than ASCII white space, A-Z in lower case; each text has an end token.
    A null or empty text is an end only; without training rows all words are unseen. Other columns
    are ignored.
    """
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(partitions(spark), -(-chars // BUCKET_CHARS))

    def count(group: pa.Table) -> pa.Table:
        return _count(group, buckets)

    chunks = materialise(docs.select("doc_id", "text").mapInArrow(_coder(buckets), _CHUNKS), "chunks")
    back = chunks.where("bucket >= 0").select("chunk", "bucket", "hashes", "counts").groupBy("bucket").applyInArrow(count, _BACK)
    back = materialise(back, "counts")
    sums = back.where("chunk < 0").select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    total = np.zeros(2 * TAIL_CLASSES + 2 * LETTERS)
    for r in sums:
        total[r.i] = r.x
    head = head_size(int(round(total[TAIL_CLASSES : 2 * TAIL_CLASSES].sum())))
    tops = back.where("chunk < 0").select(F.explode(F.arrays_zip("top_hash", "top_n")).alias("w")).select("w.*").where("top_n > 0")
    vocabulary = Vocabulary([(r.top_hash, r.top_n) for r in tops.orderBy(F.desc("top_n"), "top_hash").limit(head).collect()], total)
    none = lambda kind: F.lit(None).cast(kind)
    own = chunks.where("bucket < 0").select("chunk", "bucket", none("binary").alias("counts"), none("long").alias("cut"), none("binary").alias("tags"), "ids", "sizes", "words", "letters")
    parts = own.unionByName(back.where("chunk >= 0").select("chunk", "bucket", "counts", "cut", "tags"), allowMissingColumns=True)
    coded = materialise(parts.groupBy("chunk").applyInArrow(_encoder(vocabulary), _CODED), "coded")
    discard(chunks)
    discard(back)
    scored = coded.mapInArrow(_scorer(_fit(coded, vocabulary), vocabulary.sizes), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), "base_score", "score")
