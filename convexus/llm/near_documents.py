"""Near-duplicate documents: ProbMinHash signatures of weighted word shingles, banding and exact verification."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, connected_components, partitions, tidy

WORDS, REGISTERS, BAND = 5, 252, 7
#: Bits of the map that spares documents without any candidate the way through a shuffle: 1 MB, whatever the input.
MAP_BITS = 1 << 23
#: Bytes of text and shingles that are worked on at once; bytes of sets on one side of a cell, about.
STEP, ROUND, SIDE = 1 << 19, 1 << 18, 4 << 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _step(turn: int) -> np.uint64:
    return np.uint64(turn * int(_GOLDEN) % (1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the SplitMix64 finalizer)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _geometric(x: int, n: int) -> np.ndarray:
    """1, x, x^2, ... modulo 2^64."""
    steps = np.full(n, x, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, and a random word for each byte."""

    def __init__(self, base: int, seed: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.bytes = mix(np.arange(1, 257, dtype=np.uint64) * _step(2 * seed + 1))
        self.forget()

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            for name, x in (("up", self.base), ("down", self.inverse)):
                low = _geometric(x, 4096)
                high = _geometric(pow(x, 4096, 1 << 64), -(-(n + n // 8) // 4096))
                setattr(self, name, (high[:, None] * low).ravel())

    def forget(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)


_POWERS = _Powers(0x5851F42D4C957F2D, 0)


def sums_before(data: np.ndarray, powers: _Powers = _POWERS) -> np.ndarray:
    """At each place, the sum of the bytes before it as a polynomial: any substring's hash is a difference of two."""
    powers.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(powers.bytes[data] * powers.up[: len(data)], out=total[1:])
    return total


def word_hashes(texts: list[bytes]):
    """(hash of each word, text of each word) for the runs between ASCII white space of some texts.

    Bytes are worked on STEP at a time, each time up to the last white space; a longer word is worked on whole.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13)) | ((data >= 28) & (data <= 31))
    begins = np.cumsum([len(t) + 1 for t in texts])
    hashes, owners, s = [], [], 0
    while s < len(data):
        e = min(s + STEP, len(data))
        if not blank[e - 1]:
            back = np.flatnonzero(blank[s:e])
            e = s + int(back[-1]) + 1 if len(back) else s + int(np.argmax(blank[s:])) + 1
        part = blank[s:e]
        start = np.flatnonzero(~part & np.r_[True, part[:-1]])
        end = np.flatnonzero(part & np.r_[False, ~part[:-1]])
        total = sums_before(data[s:e])
        hashes.append(mix((total[end] - total[start]) * _POWERS.down[start]))
        owners.append(np.searchsorted(begins, start + s, "right"))
        s = e
    return np.concatenate(hashes), np.concatenate(owners)


def shingles(texts: list[bytes], words: int = WORDS):
    """(hashes, counts, text of each) of the weighted shingles of some texts, sorted by text and hash.

    A text of fewer words than a shingle has is one shingle; a text without words has none.
    """
    word, doc = word_hashes(texts)
    n = len(word)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    count = np.diff(np.r_[first, n])
    place = np.arange(n) - np.repeat(first, count)
    whole = np.repeat(count, count)
    keep = (place + words <= whole) | (place == 0)
    at = np.flatnonzero(keep)
    out = np.zeros(len(at), np.uint64)
    for k in range(words):
        there = place[at] + k < whole[at]
        value = word[np.minimum(at + k, n - 1)] + _step(k + 1)
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + np.where(there, value, np.uint64(0)))
    doc = doc[at]
    edge = np.r_[np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]), len(doc)]
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        out[a:b].sort()
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (out[1:] != out[:-1])])
    return out[new], np.diff(np.r_[new, len(out)]), doc[new]


def prob_min_hash(hashes: np.ndarray, weights: np.ndarray, doc: np.ndarray, n_docs: int, registers: int = REGISTERS) -> np.ndarray:
    """[text, register]: the element whose arrival is first there.

    Each element's arrivals form a Poisson process with its weight as rate, seeded by its hash, and each arrival
    falls on a random register. Two texts agree in a register with the probability Jaccard of their weights. Arrivals
    are drawn for ROUND elements, one each at a time; an element stops once its time is past the latest first
    arrival of its text's registers, since it can't win any more.
    """
    first = np.full(n_docs * registers, np.inf)
    owner = np.zeros(n_docs * registers, np.uint64)
    latest = np.full(n_docs, np.inf)
    for begin in range(0, len(hashes), ROUND):
        time, alive, turn = np.zeros(min(ROUND, len(hashes) - begin)), np.arange(begin, min(begin + ROUND, len(hashes))), 0
        while len(alive):
            turn += 1
            draw = mix(hashes[alive] + _step(turn))
            now = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights[alive]
            slot = doc[alive] * registers + (mix(draw + _GOLDEN) % np.uint64(registers)).astype(np.int64)
            better = np.flatnonzero(now < first[slot])
            np.minimum.at(first, slot[better], now[better])
            won = better[first[slot[better]] == now[better]]
            owner[slot[won]] = hashes[alive[won]]
            docs = np.unique(doc[alive[better]]) if len(better) else np.zeros(0, np.int64)
            latest[docs] = first.reshape(n_docs, registers)[docs].max(1)
            on = now < latest[doc[alive]]
            alive, time = alive[on], now[on]
    return owner.reshape(n_docs, registers)


def band_keys(signature: np.ndarray, band: int = BAND) -> np.ndarray:
    """[text, band]: one 63-bit key for each band's registers."""
    n, registers = signature.shape
    parts = signature.reshape(n, registers // band, band)
    key = np.broadcast_to(mix(np.arange(1, registers // band + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for k in range(band):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, k])
    return (key >> np.uint64(1)).astype(np.int64)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact similarity of two weighted sets (sorted hashes, counts): sum over common d of 1 / sum over e of max(a_e / a_d, b_e / b_d)."""
    (x, u), (y, v) = a, b
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    if (u == 1).all() and (v == 1).all():
        return len(both) / (len(x) + len(y) - len(both))
    wa, wb = u[i].astype(np.float64), v[j].astype(np.float64)
    ratio = wa / wb
    order = np.argsort(ratio, kind="stable")
    wa, wb, ratio = wa[order], wb[order], ratio[order]
    low = np.searchsorted(ratio, ratio, "left")
    below_b = np.r_[0.0, np.cumsum(wb)][low] + (v.sum() - wb.sum())  # what only b has ranks below every ratio
    above_a = u.sum() - np.r_[0.0, np.cumsum(wa)][low]
    return float((1 / (above_a / wa + below_b / wb)).sum())


def pack_set(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    body = hashes.astype("<u8").tobytes()
    return body if (counts == 1).all() else body + counts.astype("<u4").tobytes() + b"w"


def unpack_set(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    if len(blob) % 2 == 0:  # with counts the length is odd
        x = np.frombuffer(blob, "<u8")
        return x, np.ones(len(x), np.int64)
    n = (len(blob) - 1) // 12
    return np.frombuffer(blob, "<u8", n), np.frombuffer(blob, "<u4", n, 8 * n).astype(np.int64)


def _portions(texts: list[bytes]):
    held, size = [], 0
    for i, t in enumerate(texts):
        held.append(i)
        size += len(t)
        if size >= STEP:
            yield held
            held, size = [], 0
    if held:
        yield held


def sketch(docs: DataFrame, words: int, registers: int, band: int) -> DataFrame:
    """(id, digest, bands, size): of each whole text its 128-bit digest, its band keys (empty for a text without words) and its number of shingles."""

    def run(batches):
        for batch in batches:
            texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column(1)]
            bands: list[bytes] = [b""] * len(texts)
            sizes = np.zeros(len(texts), np.int64)
            for held in _portions(texts):
                hashes, counts, doc = shingles([texts[i] for i in held], words)
                keys = band_keys(prob_min_hash(hashes, counts.astype(np.float64), doc, len(held), registers), band)
                sizes[held] = np.bincount(doc, minlength=len(held))
                for k in np.unique(doc):
                    bands[held[k]] = keys[k].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary()), pa.array(bands, pa.binary()), pa.array(sizes)], names=["id", "digest", "bands", "size"])

    return docs.mapInArrow(tidy(run, _POWERS.forget), "id long, digest binary, bands binary, size long")


def spread_bands(sketches: DataFrame) -> DataFrame:
    """(key, id) for each band key of each row."""

    def run(batches):
        for batch in batches:
            blobs = batch.column(1).to_pylist()
            n = np.array([len(b) // 8 for b in blobs])
            keys = np.frombuffer(b"".join(blobs), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(batch.column(0).to_numpy(), n))], names=["key", "id"])

    return sketches.select("id", "bands").mapInArrow(tidy(run), "key long, id long")


def sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(id, set) of the documents whose ids are wanted, and of a few others: a map of hashed ids, of a fixed size, filters the rest."""
    place = F.pmod("id", F.lit(MAP_BITS))
    rows = wanted.groupBy(F.shiftright(place, 15).alias("b")).agg(F.bitmap_construct_agg((place % 32768).cast("long")).alias("bits")).collect()
    bits = np.zeros(MAP_BITS // 8, np.uint8)
    for r in rows:
        bits[r["b"] * 4096 : (r["b"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            at = np.mod(ids, MAP_BITS)
            on = np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            texts = [(batch.column(1)[int(i)].as_py() or "").encode("utf-8", "surrogatepass") for i in on]
            for held in _portions(texts):
                hashes, counts, doc = shingles([texts[i] for i in held], words)
                edge = np.searchsorted(doc, np.arange(len(held) + 1))
                blobs = [pack_set(hashes[a:b], counts[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[on[held]]), pa.array(blobs, pa.binary())], names=["id", "set"])

    return docs.mapInArrow(tidy(run, _POWERS.forget), "id long, set binary")


def link_cells(cells: DataFrame, sets: DataFrame, least: float, spark: SparkSession) -> DataFrame:
    """(u, v): links between the two sides of each cell, as few as join what the cell joins.

    ``cells``: cell, side (0 or 1), id, part. All pairs across of different parts (classes so far) are verified by exact
    probability Jaccard, after a bound (the common shingles' share of either text) that the common shingles of
    the whole cell give at once. Pairs whose classes the cell has joined meanwhile need no look.
    """

    def solve(side: list[int], ids: list[int], parts: list[int], blobs: list[bytes]):
        left = {i: unpack_set(b) for s, i, b in zip(side, ids, blobs, strict=True) if s == 0}
        right = {i: unpack_set(b) for s, i, b in zip(side, ids, blobs, strict=True) if s == 1}
        part, root = dict(zip(ids, parts, strict=True)), {p: p for p in parts}

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        if len(left) > 1 and len(right) > 1:
            ls, rs = list(left), list(right)
            common = np.intersect1d(np.unique(np.concatenate([left[i][0] for i in ls])), np.unique(np.concatenate([right[i][0] for i in rs])))
            share = np.zeros((2, len(ls), len(rs)), np.float32)
            for s in range(0, len(common), 4096):
                some = common[s : s + 4096]
                dense = []
                for names, group in ((ls, left), (rs, right)):
                    table = np.zeros((len(names), len(some)), np.float32)
                    for k, i in enumerate(names):
                        x, w = group[i]
                        a, b = np.searchsorted(x, some[0]), np.searchsorted(x, some[-1], "right")
                        at = np.searchsorted(some, x[a:b])
                        ok = some[np.minimum(at, len(some) - 1)] == x[a:b]
                        table[k, at[ok]] = w[a:b][ok] / w.sum()
                    dense.append(table)
                share[0] += dense[0] @ (dense[1] > 0).T
                share[1] += (dense[0] > 0).astype(np.float32) @ dense[1].T
            pairs = [(ls[i], rs[j]) for i, j in zip(*np.nonzero(share.min(0) >= least - 1e-4), strict=True)]
        else:
            pairs = [(i, j) for i in left for j in right]
        for i, j in pairs:
            a, b = find(part[i]), find(part[j])
            if a != b and probability_jaccard(left[i], right[j]) >= least:
                root[max(a, b)] = min(a, b)
                yield i, j

    def run(batches):
        cell, held = None, ([], [], [], [])

        def done():
            return list(solve(*held)) if held[0] else []

        for batch in batches:
            out = []
            for c, *row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if c != cell:
                    out += done()
                    cell, held = c, ([], [], [], [])
                for column, value in zip(held, row, strict=True):
                    column.append(value)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["u", "v"])
        if out := done():
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["u", "v"])

    rows = cells.join(sets, "id").select("cell", "side", "id", "part", "set")
    return rows.repartition(partitions(spark), "cell").sortWithinPartitions("cell").mapInArrow(tidy(run), "u long, v long")


def near_duplicates(docs: DataFrame, least: float = 0.8, key: str = "doc_id", text: str = "text", words: int = WORDS, registers: int = REGISTERS, band: int = BAND, chunk: int = 512, stars: int = 1) -> DataFrame:
    """key, class_id, kept for every row: the smallest key of its class of near duplicates, and whether the row has it.

    Texts whose word shingles (runs between ASCII white space, weighted by their count) have a probability
    Jaccard of at least ``least`` are linked; classes are what links reach. Equal texts are one candidate. Band buckets
    give candidates: first each member meets its bucket's leader (``stars`` leaders in turn); then in each bucket that still holds
    several classes all members outside its largest class meet all others, in blocks of ``chunk`` by ``chunk``, so every
    pair that shares a bucket is either joined or compared, and no pair is ever a row. Blocks are also bounded by the bytes
    of their sets (SIDE). A pair at the threshold misses all 36 buckets with a chance of 2 in 10,000, one of similarity
    0.85 with 1 in 200,000. A task needs about 40 bytes for each word of its longest text, and that many for a cell of two
    blocks. Null texts are empty ones; texts without words equal each other only by the same bytes; rows of one key are one node;
    a null key has a null class and isn't kept apart; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-documents")
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    rows = scratch.save(sketch(texts, words, registers, band), "rows")
    known = rows.where("id IS NOT NULL")
    groups = scratch.save(known.groupBy("digest").agg(F.min("id").alias("id"), F.min_by("bands", "id").alias("bands"), F.max("size").alias("size")), "groups")
    entries = spread_bands(groups)
    buckets = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    shared = scratch.save(entries.join(buckets, "key").distinct().join(groups.groupBy("id").agg(F.max("size").alias("size")), "id").select("key", "id", "size"), "shared")
    copies = known.select("id", "digest").join(groups.select("digest", F.col("id").alias("root")), "digest")
    sets = scratch.save(sets_of(texts.where("id IS NOT NULL"), shared, words), "sets")
    # Rows of one key with different texts are one node, so their groups are joined.
    edges = copies.where("id <> root").join(groups.select("id"), "id", "left_semi").select(F.col("id").alias("u"), F.col("root").alias("v"))
    edges = scratch.save(edges, "edges")
    none = spark.createDataFrame([], "node long, component long")
    parts = scratch.save(none, "parts0")
    for turn in range(stars + 1):
        placed = shared.join(parts.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "size", F.coalesce("component", "id").alias("part"))
        # Blocks for so many members and so many shingles (8 bytes each).
        blocks = lambda n, size: F.greatest(F.ceil(n / chunk), F.ceil(size * 8 / SIDE), F.lit(1)).cast("int")
        if turn < stars:
            order = F.struct((F.xxhash64("id", F.lit(turn)) if turn else F.lit(0).cast("long")).alias("o"), "id", "part")
            leaders = placed.groupBy("key").agg(F.min(order).alias("l"), F.min("part").alias("low"), F.max("part").alias("high"), blocks(F.count("*"), F.sum("size")).alias("n")).where("low < high")
            # A leader of many is repeated for each block of its members; of several buckets where the two meet the one of most blocks counts.
            pairs = placed.join(leaders.select("key", F.col("l.id").alias("leader"), F.col("l.part").alias("other"), "n"), "key").where("part <> other").groupBy("leader", "other", "id", "part").agg(F.max("n").alias("n"))
            pairs = scratch.save(pairs, f"pairs{turn}")
            if not pairs.limit(1).count():
                break
            sized = pairs.withColumn("cell", F.concat_ws(":", "leader", "n", F.pmod(F.xxhash64("id"), F.col("n"))))
            cells = sized.select("cell", F.lit(1).alias("side"), "id", "part").unionByName(sized.select("cell", F.lit(0).alias("side"), F.col("leader").alias("id"), F.col("other").alias("part")).distinct())
        else:
            digest = lambda k: F.sum(F.xxhash64("id", F.lit(k)).cast("decimal(38,0)")).alias(f"h{k}")
            kinds = placed.groupBy("key", "part").agg(F.count("*").alias("n"), F.sum("size").alias("size"), digest(0), digest(1))
            main = F.max(F.struct("n", "part", "size")).alias("main")
            mixed = kinds.groupBy("key").agg(main, F.sum("n").alias("n_all"), F.sum("size").alias("size_all"), F.sum("h0").alias("h0"), F.sum("h1").alias("h1"), F.count("*").alias("n_parts")).where("n_parts > 1")
            # Buckets of the same members (the same number, and two sums of 64-bit hashes) are one.
            mixed = mixed.groupBy("h0", "h1", "n_all").agg(F.min(F.struct("key", "main", "size_all")).alias("m")).select("n_all", "m.*")
            mixed = mixed.select("key", F.col("main.part").alias("main"), blocks(F.col("n_all") - F.col("main.n"), F.col("size_all") - F.col("main.size")).alias("n0"), blocks(F.col("n_all"), F.col("size_all")).alias("n1"))
            members = scratch.save(placed.join(mixed, "key"), "members")
            if not members.limit(1).count():
                break
            own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
            every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
            few = members.where("part <> main").select("key", "id", "part", F.lit(0).alias("side"), own("n0").alias("row"), every("n1").alias("column"))
            all_ = members.select("key", "id", "part", F.lit(1).alias("side"), own("n1").alias("column"), every("n0").alias("row"))
            cells = few.unionByName(all_).select(F.concat_ws(":", "key", "row", "column").alias("cell"), "side", "id", "part")
        found = scratch.save(link_cells(cells, sets, least, spark), f"links{turn}")
        scratch.drop(f"pairs{turn}", "members")
        edges = edges.unionByName(found)
        parts = scratch.save(connected_components(edges, scratch), f"parts{turn + 1}")
    classes = groups.select("digest", "id").join(parts.withColumnRenamed("node", "id"), "id", "left").select("digest", F.coalesce("component", "id").alias("class_id"))
    out = rows.select(F.col("id").alias(key), "digest").join(classes, "digest", "left")
    out = out.select(key, F.when(F.col(key).isNotNull(), F.col("class_id")).alias("class_id"))
    out = scratch.save(out.withColumn("kept", F.coalesce(F.col(key) == F.col("class_id"), F.lit(True))), "out")
    scratch.drop("rows", "groups", "shared", "sets", "edges", *[f"links{k}" for k in range(stars + 1)], *[f"parts{k}" for k in range(stars + 2)])
    return out


def op8_near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
