"""Chosen-path similarity join on word shingles.

Documents with equal shingle sets form a class with a number of its own; one of its rows stands for
it. A row is told by 128 bits of its doc_id and text, so null and repeated ids don't mix texts. A class's set is
embedded as TOKENS MinHash tokens. A run starts from a seed and follows those tokens whose hash
with the path so far falls below 1 / (threshold * TOKENS): classes that share a token chosen so
share its bucket. Buckets of up to SMALL classes are compared by brute force, larger ones are split
again by the next tokens of their paths. Each of RUNS runs finds a pair at the threshold with
probability 0.63, 0.47 or 0.37 if it is met at the first, second or third split; 24 runs miss it
with 4e-11, 3e-7 or 1e-5, and a closer pair with far less.

The recall reached is estimated from the links themselves, the weakest ones: of those that one half
of the runs finds, the share that the other half finds too. While the halves together miss more than
1 - TARGET by that, RUNS / 2 more runs with new seeds follow; they count only what no run before met,
and how much that is tells what is still missed.

A bucket that is still large after DEPTH splits holds mostly classes alike. The Jaccard distance is a
metric, so classes within half the allowed distance of a leader, its core, are all linked: they are
counted as one number and never meet. The leader is the class that most such buckets have. What isn't
in a bucket's largest core meets all of it in pairs of blocks, bounded by the number of classes and of
shingles, so the rows of a bucket grow with its size times the blocks outside that core. A class goes on to the comparison of shingles only with another in its bucket whose
tokens' low bytes agree with its own in `least_agreement` places; a pair at the threshold falls short
of that with about 1e-11, wherever it meets. Comparisons return a count per class and a star of edges, never the pairs: a pair
counts in the first bucket that holds it.
"""

from __future__ import annotations

from math import sqrt

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import U64, arrow_schema, batched, discard, grouped, materialise, mix, partitions, record_batch, row_key, shingle_hashes, texts
from quillon.llm.components import components

THRESHOLD, SHINGLE = 0.8, 5
TOKENS, RUNS, DEPTH = 128, 24, 3
SMALL, BLOCK = 256, 1024
#: Shingles of the classes that meet in one task, about, beyond which a bucket is cut into more blocks.
BLOCK_SHINGLES = 2_000_000
#: Share of the links that are to be found, judged by the weakest ones, up to so much above the threshold.
TARGET, WEAK = 0.9999, 0.05
#: Ids of classes that have a bucket with others, and paths of large buckets, are broadcast up to this number (8 bytes each).
BROADCAST_IDS = 1_000_000
_rng = np.random.default_rng(20)
_COORDINATES = _rng.integers(1, 1 << 63, TOKENS, dtype=np.int64).astype(U64) | U64(1)


def tokens(shingles: np.ndarray) -> np.ndarray:
    """The MinHash token of each coordinate, told apart by coordinate."""
    low = np.full(TOKENS, np.iinfo(U64).max, dtype=U64)
    for a in range(0, len(shingles), 2048):
        h = shingles[a : a + 2048, None] * _COORDINATES[None, :]
        np.minimum(low, (h ^ (h >> U64(32))).min(axis=0), out=low)
    return mix(low ^ _COORDINATES, 0xA0761D6478BD642F)


def seeds(turn: int, runs: int) -> np.ndarray:
    """The runs' seeds of a turn; their first halves are even, the second odd, and so are all paths below them."""
    own = np.random.default_rng([20, turn]).integers(1, 1 << 62, runs, dtype=np.int64).astype(U64) << U64(1)
    own[runs // 2 :] |= U64(1)
    return own


def leaves(token: np.ndarray, seed: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Rows of DEPTH path hashes, one per path; 0 from where it has ended. A path's last bit is its run's half."""
    bound = U64(int((1 << 64) / (threshold * TOKENS)))
    paths = seed.reshape(-1, 1)[:, :0]
    last, out = seed, []
    for level in range(DEPTH):
        chosen = mix(last[:, None] ^ token[None, :], 0xE7037ED1A0B428DB + 2 * level) < bound
        at, which = np.nonzero(chosen)
        ended = np.flatnonzero(~chosen.any(axis=1))
        if level and len(ended):
            out.append(np.hstack([paths[ended], np.zeros((len(ended), DEPTH - level), U64)]))
        last = mix(last[at] + token[which], 0x8EBC6AF09C88C6E3) & ~U64(1) | (last[at] & U64(1))
        paths = np.hstack([paths[at], last[:, None]])
    return np.vstack([*out, paths])


def least_agreement(threshold: float) -> int:
    """Seven standard deviations below the number of tokens that agree at the threshold."""
    return max(1, int(TOKENS * threshold - 7 * sqrt(TOKENS * threshold * (1 - threshold))))


_SETS = "id long, r1 long, r2 long, n int, k1 long, k2 long, tokens binary, sketch binary"


def _sketch(batches):
    schema = arrow_schema(_SETS)
    for *own, rows in texts(batches, "id", "r1", "r2", "text"):
        out = []
        for i, r1, r2, t in zip(*own, rows, strict=True):
            s = shingle_hashes(t, SHINGLE)
            d = xxhash.xxh3_128(s.tobytes()).digest()
            # 32 bits a token do: those that clash by chance only share buckets
            token = tokens(s).astype(np.uint32) if len(s) else np.zeros(0, np.uint32)
            out.append((i, r1, r2, len(s), int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), token.tobytes(), token.astype(np.uint8).tobytes()))
        yield record_batch(schema, *map(list, zip(*out, strict=True)))


def _paths(seed: np.ndarray, threshold: float):
    """id, number of shingles and leaves of each class."""

    def run(batches):
        for b in batches:
            ids, n, token = (b.column(c).to_pylist() for c in ("id", "n", "tokens"))
            yield record_batch(arrow_schema(_LEAVES), ids, n, [leaves(np.frombuffer(t, np.uint32).astype(U64), seed, threshold).astype(np.int64).ravel() for t in token])

    return run


_LEAVES = "id long, n int, leaves array<long>"


def _below(large: np.ndarray, level: int):
    """Of each class the leaves below its large buckets of a level, if it has any; large is sorted."""

    def run(batches):
        for b in batches:
            rows = []
            for i, n, flat in zip(*(b.column(c).to_pylist() for c in ("id", "n", "leaves")), strict=True):
                own = np.array(flat, dtype=np.int64).reshape(-1, DEPTH)
                at = np.minimum(np.searchsorted(large, own[:, level]), len(large) - 1)
                own = own[large[at] == own[:, level]]
                if len(own):
                    rows.append((i, n, own.ravel()))
            if rows:
                yield record_batch(arrow_schema(_LEAVES), *map(list, zip(*rows, strict=True)))

    return run


_TEXTS = "r1 long, r2 long, shingles binary"


def _hash_texts(batches):
    schema = arrow_schema(_TEXTS)
    for r1, r2, rows in texts(batches, "r1", "r2", "text"):
        yield record_batch(schema, r1, r2, [shingle_hashes(t, SHINGLE).tobytes() for t in rows])


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of the intersections of all pairs."""
    if len(sets) == 2:
        n = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), n], [n, len(sets[1])]], dtype=np.float32)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = count[token] > 1
    row, token = row[keep], np.unique(token[keep], return_inverse=True)[1]
    order = np.argsort(token, kind="stable")
    row, token = row[order], token[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    width = 2048
    for a in range(0, int(token[-1]) + 1 if len(token) else 0, width):
        i, j = np.searchsorted(token, [a, a + width])
        part = np.zeros((len(sets), width), dtype=np.float32)
        part[row[i:j], token[i:j] - a] = 1
        out += part @ part.T
    return out


def _roots(alike: np.ndarray) -> np.ndarray:
    """The least place that links lead to from each."""
    root = np.arange(len(alike))
    while True:
        low = np.minimum(root, np.where(alike, root[None, :], len(alike)).min(axis=1))
        if (low == root).all():
            return root
        root = low


def _compare(path: int, rows: list[dict], threshold: float):
    """Of the classes of one bucket, or of a pair of its blocks, that have links: id, number of linked
    documents, root, and of the weak links those that runs of the first half, of the second and of both have met."""
    sets = [np.frombuffer(r["shingles"], U64) for r in rows]
    size = np.array([len(s) for s in sets], dtype=np.float32)
    both = _shared(sets)
    alike = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-4
    core = _core_numbers(rows)
    alike &= core[:, None] != core[None, :]
    block = np.array([r["block"] for r in rows])
    if rows[0]["i"] != rows[0]["j"]:
        alike &= block[:, None] != block[None, :]
    linked = np.flatnonzero(alike.any(axis=1))
    if not len(linked):
        return
    ids = np.array([r["id"] for r in rows], dtype=np.int64)
    root = _roots(alike)
    alike = alike[np.ix_(linked, linked)]
    own = [np.array(rows[k]["own"], dtype=np.int64) for k in linked]
    known, inverse = np.unique(np.concatenate(own), return_inverse=True)
    met = np.zeros((len(linked), len(known)), dtype=np.float32)
    met[np.repeat(np.arange(len(linked)), [len(e) for e in own]), inverse] = 1
    together = lambda which: (met[:, which] @ met[:, which].T) > 0
    new = alike & ~together(known < path)
    links = new @ np.array([rows[k]["copies"] for k in linked], dtype=np.int64)
    weak = new & (both < (threshold + WEAK) * (size[:, None] + size[None, :] - both))[np.ix_(linked, linked)]
    half = [weak & together(known & 3 != 2 - k) for k in (0, 1)]  # the last two bits: 1 and 2 for the halves, 3 for both
    told = [h.sum(axis=1) for h in (*half, half[0] & half[1])]
    for k, n, *seen in zip(linked, links, *told, strict=True):
        yield int(ids[k]), int(n), int(ids[root[k]]), *map(int, seen)


_CORES = "id long, core long"


def _core_numbers(rows: list[dict]) -> np.ndarray:
    """The rows' cores; a row without one has a number of its own, as no row is compared with its own core."""
    return np.array([-1 - k if r["core"] is None else r["core"] for k, r in enumerate(rows)], dtype=np.int64)


def _near_leader(threshold: float):
    """id and core of the classes within half the allowed distance of their leader, which comes first in a group."""

    def run(batches):
        def near():
            at = lead = None
            for b in batches:
                for r in b.to_pylist():
                    own = np.frombuffer(r["shingles"], U64)
                    if (r["core"], r["salt"]) != at:
                        at, lead = (r["core"], r["salt"]), own  # the leader of these
                    elif len(own):
                        both = len(np.intersect1d(lead, own, assume_unique=True))
                        if both >= (1 + threshold) / 2 * (len(lead) + len(own) - both):
                            yield r["id"], r["core"]

        yield from batched(_CORES, near())

    return run


_ALIKE = "path long, i int, j int, id long, block int, core long"


def _partnered(least: int):
    """Rows whose sketch agrees enough with another one of their group."""

    def keep(rows: list[dict], crossed: bool):
        sketch = np.frombuffer(b"".join(r["sketch"] for r in rows), np.uint8).reshape(len(rows), TOKENS)
        block, core = np.array([r["block"] for r in rows]), _core_numbers(rows)
        for a in range(0, len(rows), 64):
            agree = (sketch[a : a + 64, None, :] == sketch[None, :, :]).sum(axis=2) >= least
            agree &= core[a : a + 64, None] != core[None, :]
            if crossed:
                agree &= block[a : a + 64, None] != block[None, :]
            yield from (rows[a + k] for k in np.flatnonzero(agree.any(axis=1)))

    def run(batches):
        found = (r for (_, i, j), rows in grouped(batches, "path", "i", "j") if len(rows) > 1 for r in keep(rows, i != j))
        yield from batched(_ALIKE, ((r["path"], r["i"], r["j"], r["id"], r["block"], r["core"]) for r in found))

    return run


_FOUND = "id long, links long, root long, first long, second long, both long"


def _verify(threshold: float):
    def run(batches):
        yield from batched(_FOUND, (x for (path, _, _), rows in grouped(batches, "path", "i", "j") if len(rows) > 1 for x in _compare(path, rows, threshold)))

    return run


def _buckets(heads: DataFrame, turn: int, runs: int, threshold: float) -> tuple[DataFrame, list[DataFrame]]:
    """path and id of the classes of each bucket to compare, the bucket's size and its number of blocks, and the tables that they are read from.

    A path is the turn, bits of the bucket's hash, and two that tell which halves of the runs have it.
    """
    read = [materialise(heads.select("id", "n", "tokens").mapInArrow(_paths(seeds(turn, runs), threshold), _LEAVES), "leaves")]
    leaf = F.sequence(F.lit(0), (F.size("leaves") / DEPTH).cast("int") - 1)
    live, final = read[0].where(F.size("leaves") > 0), None
    for level in range(DEPTH):
        own = F.transform(leaf, lambda i: F.get("leaves", i * DEPTH + level))  # noqa: B023
        nodes = live.select(F.explode(F.array_distinct(F.filter(own, lambda p: p != 0))).alias("path"), "id", "n")
        sized = nodes.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("id") % (1 << 40)).alias("a"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("b"), F.sum(F.col("n").cast("long")).alias("shingles")).where("size > 1")
        sized = materialise(sized, "buckets")
        read.append(sized)
        done = sized if level == DEPTH - 1 else sized.where(F.col("size") <= SMALL)
        # buckets with the same members are one
        halves = F.bit_or(F.when(F.col("path").bitwiseAND(F.lit(1)) == 0, 1).otherwise(2).cast("long"))
        done = done.groupBy("size", "a", "b").agg(F.min("path").alias("path"), F.min("shingles").alias("shingles"), halves.alias("halves"))
        told = F.lit(turn << 56).bitwiseOR(F.shiftleft(F.shiftrightunsigned("path", 10), 2)).bitwiseOR(F.col("halves"))
        blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
        members = nodes.join(done.select("path", told.alias("told"), "size", F.least(blocks, F.col("size").cast("int")).alias("blocks")), "path").select(F.col("told").alias("path"), "id", "size", "blocks")
        final = members if final is None else final.unionByName(members)
        if level == DEPTH - 1:
            break
        large = sized.where(F.col("size") > SMALL).select("path")
        n = large.count()
        if not n:
            break
        if n <= BROADCAST_IDS:
            own = live.mapInArrow(_below(np.array(sorted(r.path for r in large.collect()), dtype=np.int64), level), _LEAVES)
        else:
            # a class goes on in one row, with the leaves below its large buckets; it has at most a few per run
            hot = nodes.join(large, "path", "left_semi").groupBy("id").agg(F.collect_set("path").alias("hot"))
            below = F.transform(F.filter(leaf, lambda i: F.array_contains("hot", F.get("leaves", i * DEPTH + level))), lambda i: F.slice("leaves", i * DEPTH + 1, F.lit(DEPTH)))  # noqa: B023
            own = live.join(hot, "id").select("id", "n", F.flatten(below).alias("leaves"))
        live = materialise(own, "live")
        read.append(live)
    return final, read


def _shingles(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """_TEXTS of the rows whose r1 is that of a row in wanted."""
    few = wanted.count() <= BROADCAST_IDS
    wanted = wanted.select(F.col("r1").alias("w"))
    texts = docs.join(F.broadcast(wanted) if few else wanted, docs.r1 == F.col("w"), "left_semi")
    return texts.select("r1", "r2", "text").mapInArrow(_hash_texts, _TEXTS).dropDuplicates(["r1", "r2"])


def _cores(docs: DataFrame, heads: DataFrame, members: DataFrame, threshold: float) -> DataFrame | None:
    """_CORES of the buckets of more than a block, if there are any: a class is in one core at most, a leader in its own.

    A class is held against one leader: of those of its buckets the one that most buckets have.
    """
    hot = members.where("blocks > 1").select("path", "id")
    if hot.isEmpty():
        return None
    rank = hot.groupBy("id").agg(F.struct(F.count(F.lit(1)).alias("n"), F.xxhash64("id").alias("h"), "id").alias("rank"))
    ranked = hot.join(rank, "id")
    leads = ranked.groupBy("path").agg(F.max("rank").alias("lead"))
    held = materialise(ranked.join(leads, "path").groupBy("id").agg(F.max("lead")["id"].alias("core")), "held")
    groups = held.groupBy("core").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("salts"))
    salt = F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt")
    rows = held.join(groups, "core").where("id <> core").select("core", salt, F.lit(1).alias("part"), "id")
    first = groups.select("core", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("part"), F.col("core").alias("id"))
    wanted = materialise(held.join(heads.select("id", "r1", "r2"), "id").select("id", "r1", "r2"), "wanted")
    texts = wanted.join(_shingles(docs, wanted), ["r1", "r2"]).select("id", "shingles")
    spread = rows.unionByName(first).join(texts, "id").repartition(partitions(docs.sparkSession), "core", "salt").sortWithinPartitions("core", "salt", "part")
    # a leader that another one holds stays with its own
    near = spread.mapInArrow(_near_leader(threshold), _CORES).join(groups.select(F.col("core").alias("id")), "id", "left_anti")
    return materialise(near.unionByName(groups.select(F.col("core").alias("id"), "core")), "cores")


def _core_links(cores: DataFrame, copies: DataFrame) -> DataFrame:
    """_FOUND of the links within cores: a class has those of all the others of its own."""
    own = cores.join(copies, "id")
    rows = own.join(own.groupBy("core").agg(F.sum("copies").alias("total")), "core")
    none = [F.lit(0).cast("long").alias(c) for c in ("first", "second", "both")]
    return rows.select("id", (F.col("total") - F.col("copies")).alias("links"), F.col("core").alias("root"), *none)


def _blocked(members: DataFrame, sketches: DataFrame, cores: DataFrame | None) -> DataFrame:
    """A row for each member of a bucket and pair of blocks that it meets others in: path, i, j, id, block, core and sketch."""
    keyed = members.join(sketches, "id")
    hashed, total = F.xxhash64("id", "path"), F.col("blocks")
    if cores is None:
        inside, outer, inner = F.lit(False), total, F.lit(0)
    else:
        sizes = members.where("blocks > 1").select("path", "id").join(cores, "id").groupBy("path", "core").agg(F.count(F.lit(1)).alias("m"))
        main = sizes.groupBy("path").agg(F.max(F.struct("m", "core")).alias("main"))
        keyed = keyed.join(main, "path", "left")
        inside, m = F.coalesce(F.col("core") == F.col("main")["core"], F.lit(False)), F.coalesce(F.col("main")["m"], F.lit(0))
        share = lambda n: F.ceil(n * total / F.col("size")).cast("int")
        outer, inner = share(F.col("size") - m), share(m)
    keyed = keyed.select("path", "id", "core", "sketch", inside.alias("inside"), outer.alias("outer"), inner.alias("inner"), hashed.alias("h")).where("outer > 0")
    block = F.when(F.col("inside"), F.col("outer") + F.pmod(F.col("h"), F.greatest("inner", F.lit(1)))).otherwise(F.pmod(F.col("h"), F.col("outer"))).cast("int")
    last = F.when(F.col("inside"), F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1
    rows = keyed.select("path", "id", "core", "sketch", block.alias("block"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
    return rows.select("path", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "block", "core", "sketch")


def _links(docs: DataFrame, heads: DataFrame, copies: DataFrame, threshold: float, runs: int) -> DataFrame:
    """_FOUND of the classes (heads), over as many turns of runs as the target takes."""
    spark, turn, found, owned, cores = docs.sparkSession, 0, None, None, None
    sketches = heads.select("id", "sketch", F.lit(None).cast("long").alias("core"))
    by_group = lambda df: df.repartition(partitions(spark), "path", "i", "j").sortWithinPartitions("path", "i", "j")
    while True:
        members, read = _buckets(heads, turn, runs if turn == 0 else max(2, runs // 2), threshold)
        # joined once: large buckets are read again for their cores and their blocks
        members = materialise(members, "members")
        for df in read:
            discard(df)
        if turn == 0:
            cores = _cores(docs, heads, members, threshold)
            if cores is not None:
                found = materialise(_core_links(cores, copies), "links")
                sketches = heads.select("id", "sketch").join(cores, "id", "left")
        met = by_group(_blocked(members, sketches, cores))
        alike = materialise(met.mapInArrow(_partnered(least_agreement(threshold)), _ALIKE), "alike")
        discard(members)
        paths = alike.select("id", "path")
        owned = paths if owned is None else owned.unionByName(paths)
        own = owned.groupBy("id").agg(F.sort_array(F.collect_set("path")).alias("own"))  # at most a few per run
        own = materialise(own.join(heads.select("id", "r1", "r2"), "id"), "own")
        shingles = _shingles(docs, own)
        rows = alike.join(shingles.join(own, ["r1", "r2"]).join(copies, "id"), "id").select("path", "i", "j", "id", "block", "core", "copies", "own", "shingles")
        new = materialise(by_group(rows).mapInArrow(_verify(threshold), _FOUND), "links")
        found = new if found is None else found.unionByName(new)
        seen = new.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("first", "second", "both")]).first()
        if turn == 0:
            # of the links that one half finds, the other misses as large a share as of all; few links tell little
            half = before = (seen.first + seen.second - 2 * seen.both + 0.05) / (seen.first + seen.second + 10)
            weak = seen.first + seen.second - seen.both
        else:
            more = seen.first + seen.second - seen.both
            weak += more
            before = (more + 0.05) / (weak + 10)  # what the turns before have missed
        if half * max(before, half ** (turn + 1)) <= 1 - TARGET:
            return found
        turn += 1


def _rows(docs: DataFrame, threshold: float, runs: int) -> DataFrame:
    """Per row of docs: id, r1 and r2, any (it has words) and, if so, of its class number, copies, least, with_null and links,
    of its group first (least id, null if all are), group_null, and of the row that stays for the group s1 and s2."""
    docs = docs.select(F.col("doc_id").alias("id"), *[c.alias(n) for c, n in zip(row_key(), ("r1", "r2"), strict=True)], "text")
    sets = materialise(docs.mapInArrow(_sketch, _SETS), "sets")
    classes = sets.where("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("least"), F.max(F.col("id").isNull()).alias("with_null"), F.count(F.lit(1)).alias("copies"))
    classes = materialise(classes.withColumn("number", F.monotonically_increasing_id()), "classes")
    # a row of the class's least document has the tokens that all of the class have
    heads = sets.join(classes, ["k1", "k2"]).where(F.col("id").eqNullSafe(F.col("least"))).select(F.col("number").alias("id"), "r1", "r2", "n", "tokens", "sketch").dropDuplicates(["id"])
    heads = materialise(heads, "heads")
    found = _links(docs, heads, classes.select(F.col("number").alias("id"), "copies"), threshold, runs)
    links = found.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "number")
    labels = components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "number")
    known = classes.join(links, "number", "left").join(labels, "number", "left").withColumn("label", F.coalesce("label", "number"))
    # only groups of more than one class need a look at their classes
    lead = F.min(F.struct(F.col("least").isNull(), "least", "number"))
    groups = classes.join(labels, "number").groupBy("label").agg(lead.alias("lead"), F.max("with_null").alias("group_null"))
    known = known.join(groups, "label", "left").withColumns({
        "first": F.when(F.col("lead").isNull(), F.col("least")).otherwise(F.col("lead")["least"]),
        "group_null": F.coalesce("group_null", "with_null"),
        "stays": F.coalesce(F.col("lead")["number"], F.col("number")),
    })
    heads = heads.select(F.col("id").alias("stays"), F.col("r1").alias("s1"), F.col("r2").alias("s2"))
    known = known.join(heads, "stays").drop("lead", "stays", "label")
    return sets.select("id", "r1", "r2", "k1", "k2", (F.col("n") > 0).alias("any")).join(known, ["k1", "k2"], "left").drop("k1", "k2")


def similar_documents(docs: DataFrame, threshold: float = THRESHOLD, runs: int = RUNS) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, class_id, copy_id and n_links.

    n_links: the other rows whose set of SHINGLE-word shingles has a Jaccard similarity of at least
    threshold. copy_id: the least doc_id with the same set. class_id: the least doc_id that links
    lead to. A text of fewer words is one shingle of all; a null, empty or blank one has no links
    and is a class of its own. A null doc_id comes first; repeated rows are copies of each other.
    So class_id is null in each group that has a null id: distinct_documents goes by the groups themselves.
    """
    out = _rows(docs, threshold, runs)
    rep = F.when(~F.col("any"), F.col("id")).when(~F.col("with_null"), F.col("least"))
    label = F.when(~F.col("any"), F.col("id")).when(~F.col("group_null"), F.col("first"))
    n_links = F.when(F.col("any"), F.col("copies") - 1 + F.coalesce("links", F.lit(0))).otherwise(F.lit(0).cast("long"))
    return out.select(F.col("id").alias("doc_id"), label.alias("class_id"), rep.alias("copy_id"), n_links.alias("n_links"))


def distinct_documents(docs: DataFrame, threshold: float = THRESHOLD, runs: int = RUNS) -> DataFrame:
    """docs with one row of each group of linked rows, that of the least non-null doc_id; texts without words stay.

    Rows that share a doc_id are told by their texts; of rows with the same doc_id and text one stays.
    """
    rows = _rows(docs, threshold, runs).where(F.col("any") & ((F.col("copies") > 1) | (F.coalesce("links", F.lit(0)) > 0)))
    stays = (F.col("r1") == F.col("s1")) & (F.col("r2") == F.col("s2"))
    marks = rows.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n"), F.max(stays).alias("stays")).where("n > 1 or not stays").select("r1", "r2", "stays")
    marks = materialise(marks, "marks").withColumnsRenamed({"r1": "__r1", "r2": "__r2", "stays": "__stays"})
    keyed = docs.withColumns(dict(zip(("__k1", "__k2"), row_key(), strict=True)))
    same = (F.col("__k1") == F.col("__r1")) & (F.col("__k2") == F.col("__r2"))
    once = keyed.join(marks, same, "left_anti").select(*docs.columns)
    again = marks.where("__stays")
    if again.isEmpty():
        return once
    return once.unionByName(keyed.join(again, same, "left_semi").dropDuplicates(["__k1", "__k2"]).select(*docs.columns))
