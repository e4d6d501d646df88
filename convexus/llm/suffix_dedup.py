"""Removal of repeated substrings by a difference-cover suffix order, built one bucket at a time.

Two suffixes tie for ``least`` bytes if one string of that length starts at both. Instead of bringing whole
suffixes together, the order is taken over fingerprints of prefixes of a fixed length, which keeps equal prefixes
next to each other, and buckets are ranges of fingerprints:

1. Cover sample: positions i of each text with i mod 133 in a perfect difference set (12 of 133). For any two
   positions there is a shift below 133 that brings both into the sample, so two suffixes that tie have
   shifted samples that tie for the 68 bytes that are left. The sample's buckets are sorted first; a sample
   that is alone in its rank rules out every tie that would need it.
2. Long ties: samples that share their rank are ranked by their next 332 bytes. Those that still tie decide 133
   suffixes at once, and one member of each such rank stands for the others from here on.
3. Suffixes not yet decided, and those that stand for others, are sorted by their ``least`` bytes.
4. What ties in the third step is sorted once more by a second fingerprint that is independent of the first.

Every tie that removes bytes is one of two independent 64-bit fingerprints (both at once in the second step). A task
sees one block of texts or one bucket; answers return to the blocks as bitmaps, with a bitmap of what the block has found
so far. Blocks are parts of the input's partitions, written as a bucketed table, so texts are never shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Blocks, Scratch, partitions, tidy
from .near_documents import _POWERS, _Powers, mix, sums_before

#: A perfect difference set modulo 133 (every non-zero difference occurs once).
PERIOD = 133
COVER = [0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109]
_SECOND = _Powers(0x369DEA0F31A53F85, 1)
#: Of each step, bits of the first fingerprint besides its bucket's number, at most, and whether the second follows. A chance tie in
#: the first step only costs work, one in the third is found in the fourth.
STEPS = {"cover": (48, False), "long": (56, True), "suffix": (56, False), "confirm": (0, True)}
#: Entries of a bucket, bytes of a block, both about, and bytes of text worked on at once.
BUCKET, BLOCK, STEP = 1 << 20, 1 << 21, 1 << 18


class Texts:
    """The texts of a block in one array, with fingerprints of any substring."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.sizes)

    def fingerprints(self, at: np.ndarray, length: int, powers: _Powers = _POWERS) -> np.ndarray:
        """Of the ``length`` bytes from each of some places, which ascend; STEP bytes are worked on at a time."""
        out = np.empty(len(at), np.uint64)
        for s in range(0, len(self.data), STEP):
            a, b = np.searchsorted(at, (s, s + STEP))
            if a < b:
                total, here = sums_before(self.data[s : s + STEP + length], powers), at[a:b] - s
                out[a:b] = mix((total[here + length] - total[here]) * powers.down[here])
        return out

    def fits(self, at: np.ndarray, length: int) -> np.ndarray:
        """Whether ``length`` bytes of its own text follow each place."""
        return at + length <= self.ends[np.searchsorted(self.ends, at, "right")]

    def cover(self, window: int) -> np.ndarray:
        """Places of the cover sample that ``window`` bytes of their text follow."""
        pattern = np.tile(np.isin(np.arange(PERIOD), COVER), int(self.sizes.max(initial=0)) // PERIOD + 1)
        at = np.flatnonzero(np.concatenate([pattern[:n] for n in self.sizes] or [pattern[:0]]))
        return at[self.fits(at, window)]


def spread(n: int, at: np.ndarray, back: int, length: int) -> np.ndarray:
    """Places within ``back`` before to ``length`` after some place of ``at``, which ascends (both ends included)."""
    steps = np.zeros(n + 1, np.int8)
    if len(at):
        low, high = np.maximum(at - back, 0), np.minimum(at + length + 1, n)
        new = np.flatnonzero(np.r_[True, low[1:] > high[:-1]])
        steps[low[new]] = 1
        steps[high[np.r_[new[1:] - 1, len(at) - 1]]] = -1
    return np.cumsum(steps[:-1], dtype=np.int8).astype(bool)


def rest_bits(step: str, bits: int) -> int:
    return min(STEPS[step][0], 64 - bits)


def in_order(keys: np.ndarray, second: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The order of some fingerprints, and where in it a new one begins."""
    order = np.argsort(keys) if second is None else np.lexsort((second, keys))
    new = np.ones(len(keys), bool)
    sorted_ = keys[order]
    new[1:] = sorted_[1:] != sorted_[:-1]
    if second is not None:
        sorted_ = second[order]
        new[1:] |= sorted_[1:] != sorted_[:-1]
    return order, new


class Ranked:
    """Fingerprints of one step and block: sorted and distinct for the buckets, and the way back."""

    def __init__(self, step: str, bits: int, first: np.ndarray, second: np.ndarray | None = None):
        self.step, self.rest = step, rest_bits(step, bits)
        keys = first >> np.uint64(64 - bits - self.rest)
        self.order, new = in_order(keys, second)
        self.run = np.cumsum(new) - 1
        self.first = np.flatnonzero(new)
        self.keys = keys[self.order[self.first]]
        self.second = None if second is None else second[self.order[self.first]]
        self.twice = np.diff(np.r_[self.first, len(keys)]) > 1

    def rows(self, block: int):
        """(step, bucket, block, entries, twice) of each bucket that has any."""
        bucket = (self.keys >> np.uint64(self.rest)).astype(np.int64)
        edge = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)] if len(bucket) else np.zeros(1, np.int64)
        low = self.keys & np.uint64((1 << self.rest) - 1)
        raw = low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-self.rest // 8)]
        if self.second is not None:
            raw = np.hstack([raw, self.second.astype("<u8").view(np.uint8).reshape(-1, 8)])
        cuts = list(zip(edge[:-1], edge[1:], strict=True))
        return pa.table([
            pa.array([self.step] * len(cuts), pa.string()),
            pa.array([int(bucket[a]) for a, _ in cuts], pa.int64()),
            pa.array([block] * len(cuts), pa.int64()),
            pa.array([raw[a:b].tobytes() for a, b in cuts], pa.binary()),
            pa.array([np.packbits(self.twice[a:b]).tobytes() for a, b in cuts], pa.binary()),
        ], names=ENTRY_NAMES)

    def answers(self, told: list[tuple[int, bytes, bytes]]):
        """Which fingerprints are shared, and which stand for their rank; from the buckets' bitmaps."""
        bucket = (self.keys >> np.uint64(self.rest)).astype(np.int64)
        shared, leads = np.zeros(len(self.keys), bool), np.zeros(len(self.keys), bool)
        for b, s, lead in told:
            at = slice(np.searchsorted(bucket, b), np.searchsorted(bucket, b, "right"))
            n = at.stop - at.start
            shared[at] = np.unpackbits(np.frombuffer(s, np.uint8), count=n)
            leads[at] = np.unpackbits(np.frombuffer(lead, np.uint8), count=n)
        all_shared, all_leads = np.zeros(len(self.order), bool), np.zeros(len(self.order), bool)
        all_shared[self.order] = shared[self.run]
        all_leads[self.order[self.first]] = leads
        return all_shared, all_leads


ENTRY_NAMES = ["step", "bucket", "block", "entries", "twice"]
ENTRY = "step string, bucket long, block long, entries binary, twice binary"
#: A row of this step is what a block has to remember; its bucket only spreads such rows.
STATE = "state"
ANSWER = "step string, bucket long, block long, shared binary, leads binary"


def bits_of(*marks: np.ndarray) -> bytes:
    return np.packbits(np.concatenate(marks)).tobytes()


def marks_of(state: bytes, *sizes: int) -> list[np.ndarray]:
    found = np.unpackbits(np.frombuffer(state, np.uint8), count=sum(sizes)).astype(bool)
    return np.split(found, np.cumsum(sizes)[:-1])


def marked(n: int, at: np.ndarray) -> np.ndarray:
    out = np.zeros(n, bool)
    out[at] = True
    return out


def emit(step: str, texts: Texts, state: bytes, told: list, bits: int, least: int) -> tuple[Ranked, bytes]:
    """A step's fingerprints of a block and what the next step needs to know, from the answers to the step before and what that left.

    The state is which samples tie (left by ``long``), then the places already decided and those that are sorted (left by the others).
    """
    if least < PERIOD:
        raise ValueError(f"strings of {PERIOD} bytes at least")
    window, long, n = least - PERIOD + 1, least + PERIOD - 1, len(texts.data)

    def ranked_long(tied: np.ndarray) -> tuple[np.ndarray, Ranked]:
        far = tied[texts.fits(tied, long)]
        return far, Ranked("long", bits, texts.fingerprints(far, long), texts.fingerprints(far, long, _SECOND))

    if step == "confirm":
        known, mask = marks_of(state, n, n)
        at = np.flatnonzero(mask)
        first = texts.fingerprints(at, least)
        shared = Ranked("suffix", bits, first).answers(told)[0]
        at, first = at[shared], first[shared]
        return Ranked("confirm", bits, first, texts.fingerprints(at, least, _SECOND)), bits_of(known, marked(n, at))
    at = texts.cover(window)
    if step == "suffix":
        tied = at[marks_of(state, len(at))[0]]
        far, ranks = ranked_long(tied)
        decided, leads = ranks.answers(told)
        known = spread(n, far[decided], 0, PERIOD - 1)
        at = np.flatnonzero(spread(n, tied, PERIOD - 1, 0) & (~known | spread(n, far[leads], 0, PERIOD - 1)))
        at = at[texts.fits(at, least)]
        return Ranked("suffix", bits, texts.fingerprints(at, least)), bits_of(known, marked(n, at))
    cover = Ranked("cover", bits, texts.fingerprints(at, window))
    if step == "cover":
        return cover, b""
    shared = cover.answers(told)[0]
    del cover
    return ranked_long(at[shared])[1], bits_of(shared)


def starts(texts: Texts, state: bytes, told: list, bits: int, least: int) -> np.ndarray:
    """Marks of where shared strings start, from the answers to the last step."""
    known, mask = marks_of(state, len(texts.data), len(texts.data))
    at = np.flatnonzero(mask)
    sure = Ranked("confirm", bits, texts.fingerprints(at, least), texts.fingerprints(at, least, _SECOND))
    known[at[sure.answers(told)[0]]] = True
    return known


def rank(step: str, bucket: int, held: list, bits: int):
    """Answers to the entries (block, entries, twice) of one bucket, a row for each block."""
    rest, twin = -(-rest_bits(step, bits) // 8), STEPS[step][1]
    width = rest + 8 * twin
    sizes = [len(e) // width for _, e, _ in held]
    raw = np.frombuffer(b"".join(e for _, e, _ in held), np.uint8).reshape(-1, width)
    keys = np.zeros((len(raw), 8), np.uint8)
    keys[:, :rest] = raw[:, :rest]
    second = np.ascontiguousarray(raw[:, rest:]).view("<u8").ravel() if twin else None
    twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=n).astype(bool) for (_, _, t), n in zip(held, sizes, strict=True)])
    order, new = in_order(keys.view("<u8").ravel(), second)
    first = np.flatnonzero(new)
    size = np.diff(np.r_[first, len(raw)])
    shared = (size > 1) | np.logical_or.reduceat(twice[order], first)
    out, leads = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    out[order] = np.repeat(shared, size)
    leads[order[first[shared]]] = True
    at = np.cumsum([0, *sizes])
    for k, (block, _, _) in enumerate(held):
        yield step, bucket, block, np.packbits(out[at[k] : at[k + 1]]).tobytes(), np.packbits(leads[at[k] : at[k + 1]]).tobytes()


def sort_buckets(entries: DataFrame, spark: SparkSession, bits: int) -> DataFrame:
    """Sorts one bucket at a time: which entries of each block share their rank with another, and which come first in it."""

    def run(batches):
        now, held = None, []
        columns = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["step", "bucket", "block", "shared", "leads"])
        for batch in batches:
            out = []
            for step, bucket, block, entry, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if step == STATE:  # goes back to its block as it is
                    out.append((step, bucket, block, entry, twice))
                    continue
                if now != (step, bucket):
                    if held:
                        out += rank(*now, held, bits)
                    now, held = (step, bucket), []
                held.append((block, entry, twice))
            if out:
                yield columns(out)
        if held:
            yield columns(list(rank(*now, held, bits)))

    return entries.repartition(partitions(spark), "bucket").sortWithinPartitions("step", "bucket").mapInArrow(tidy(run), ANSWER)


def as_bytes(texts) -> list[bytes]:
    return [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in texts]


def remove_repeats(docs: DataFrame, least: int = 200, text: str = "text", keep_text: bool = True, prefix: str = "") -> DataFrame:
    """``docs`` without the bytes that repeat, and n_bytes, n_removed, n_spans, kept_sha256 (named with ``prefix``).

    Every byte covered by a string of ``least`` bytes (133 at least) that also starts elsewhere in any text, the same one
    included, is removed; matches never cross texts and are judged on the input. With ``keep_text`` the text is
    replaced by the bytes left (halves of a character cut in two are left out of it, not of the digest); else it is
    dropped. Null texts are empty; equal rows are copies of each other and lose all they share; an empty table gives
    no rows. Other columns stay, but for ones named like the results. A text is never cut between blocks: a task needs
    10 to 60 bytes of memory for each byte of a block or of its longest text, by how much of it repeats.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    names = {n: f"{prefix}{n}" for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
    docs = docs.drop(*names.values())
    blocks = Blocks(docs, text, scratch, BLOCK)
    bits = max(4, int(max(blocks.bytes * len(COVER) / PERIOD / BUCKET, 4 * partitions(spark))).bit_length())
    told = spark.createDataFrame([], ANSWER)
    block, blocks_row, last = blocks.block, blocks.row, None

    def answers(right: pa.Table) -> tuple[bytes, list]:
        state, out = b"", []
        for step, bucket, shared, leads in zip(*(right.column(k).to_pylist() for k in ("step", "bucket", "shared", "leads")), strict=True):
            if step == STATE:
                state = shared
            else:
                out.append((bucket, shared, leads))
        return state, out

    def emitter(step: str):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return pa.table([pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())], names=ENTRY_NAMES)
            left = left.sort_by(blocks_row)
            number = left.column(block)[0].as_py()
            found, state = emit(step, Texts(as_bytes(left.column(text))), *answers(right), bits, least)
            own = pa.table([pa.array([STATE]), pa.array([number], pa.int64()), pa.array([number], pa.int64()), pa.array([state], pa.binary()), pa.array([b""], pa.binary())], names=ENTRY_NAMES)
            return pa.concat_tables([found.rows(number), own])

        return run

    for step in STEPS:
        told = scratch.save(sort_buckets(blocks.cogroup([text], told, emitter(step), ENTRY), spark, bits), step)
        if last:
            scratch.drop(last)
        last = step

    columns = [c for c in docs.columns if c != text or keep_text]
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns]
    schema = ", ".join([*fields, f"`{names['n_bytes']}` long, `{names['n_removed']}` long, `{names['n_spans']}` long, `{names['kept_sha256']}` string"])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by(blocks_row)  # bitmaps are in this order
        texts = as_bytes(left.column(text))
        begins = starts(Texts(texts), *answers(right), bits, least) if texts else np.zeros(0, bool)
        gone, at = spread(len(begins), np.flatnonzero(begins), 0, least - 1), 0
        sizes, removed, spans, digests, kept = [], [], [], [], []
        for t in texts:
            own = gone[at : at + len(t)]
            at += len(t)
            rest = t if not own.any() else np.frombuffer(t, np.uint8)[~own].tobytes()
            sizes.append(len(t))
            removed.append(len(t) - len(rest))
            spans.append(int(np.count_nonzero(own[1:] & ~own[:-1]) + bool(len(own) and own[0])))
            digests.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest.decode("utf-8", "ignore") if keep_text else "")
        arrays = [pa.array(kept, pa.string()) if c == text else left.column(c) for c in columns]
        return pa.table([*arrays, pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())], names=[*columns, *names.values()])

    needed = list(dict.fromkeys([*columns, text]))
    out = scratch.save(blocks.cogroup(needed, told, finish, schema), "out")
    blocks.drop()
    scratch.drop(last)
    return out


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, keep_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
