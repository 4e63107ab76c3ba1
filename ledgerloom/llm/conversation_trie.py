"""Prefix trie of conversations that are rebuilt from the head of a base conversation and their own later turns.

Every prefix has a fingerprint: the polynomial of its turns' digests modulo 2^127 - 1. Fingerprints form a monoid, so the
prefix of a rebuilt conversation is the product of a prefix of the base and a stretch of its own turns. With P(n) the product
of the first n own turns and H that of the head, the prefix that ends at own turn n > h is

    P(n) + (H - P(h)) * B^(n - h),

one constant a conversation; rebuilt texts, and even rebuilt lists of turns, never exist. P is a running product over
range partitions, so a conversation of any length is spread over tasks; what crosses the end of a partition is carried by
the product of its last run.

Turns with equal prefix fingerprints form a node. Each member also gives a reference to its stored last turn (other bits of
the turn's SHA-256) and its parent's fingerprint: if they agree in every node, then by induction from the root all members
of a node have equal turns. If not, all is done again with another base B.

Sums over subtrees need no walk over levels: a node's conversation with the smallest id owns it, so a conversation owns the
end of its own path. A leaf counts for all members that own one, and tokens are saved by what members don't own.

Null conv_id: such turns belong to no conversation and are left out. Null role or text: empty. Turns of one conversation
with the same number, or none, are ordered by their digest; equal turns that repeat are turns of their own. ``c - c % 100``
takes the remainder with the sign of c, as SQL does. No conversations: no nodes. Only the four columns are read, so others
can't clash. Texts are read once, by the digest, and never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm.shared import arrow_map, materialize

PRIME = (1 << 127) - 1
HEADS, GROUP, JOINED = 5, 100, 1 << 18
_KEY = ["depth", "f1", "f2"]


def base_of(seed: int) -> int:
    """The polynomial's base of a seed."""
    return int.from_bytes(hashlib.sha256(b"prefix base %d" % seed).digest()[:16], "big") % (PRIME - 2) + 2


def element(digest: bytes) -> int:
    """A turn's factor: the first half of its digest."""
    return int.from_bytes(digest[:16], "big") % PRIME


class Powers:
    """Powers of the base, remembered while small."""

    def __init__(self, base: int):
        self.base, self.known = base, [1]

    def __getitem__(self, n: int) -> int:
        if n >= 1 << 14:
            return pow(self.base, n, PRIME)
        while len(self.known) <= n:
            self.known.append(self.known[-1] * self.base % PRIME)
        return self.known[n]


def _halves(values: list[int]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(v.to_bytes(16, "big") for v in values), ">i8").reshape(-1, 2).astype(np.int64)
    return both[:, 0], both[:, 1]


def _octets(values: list[int]) -> pa.Array:
    return pa.array([v.to_bytes(16, "big") for v in values], pa.binary())


def _number(octets: bytes) -> int:
    return int.from_bytes(octets, "big")


# -- stored turns ----------------------------------------------------------------------------------------------------
def turn_digests(conversations: DataFrame) -> DataFrame:
    """conv, turn, digest (SHA-256 of role and text, kept apart by the role's length), n_chars."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256))
    return conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("n_chars"))


def running_products(turns: DataFrame, base: int) -> DataFrame:
    """Turns in order with their place in their conversation (``pos`` from 1), the product of the turns up to them
    (``product``) and their characters up to them (``chars``)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, pos, product, chars, runs = TaskContext.get().partitionId(), None, 0, 0, 0, 0
        waiting: pa.RecordBatch | None = None  # the last row's batch, until it is known whether its run goes on
        for batch in batches:
            out = ([], [], [], [])
            convs = batch["conv"].to_pylist()
            if waiting is not None:
                yield _with_last(waiting, convs[0] != conv)
            for own, digest, n in zip(convs, batch["digest"].to_pylist(), batch["n_chars"].to_pylist()):
                if own != conv:
                    conv, pos, product, chars, runs = own, 0, 0, 0, runs + 1
                pos, product, chars = pos + 1, (product * base + element(digest)) % PRIME, chars + n
                for column, value in zip(out, (pos, product, chars, runs)):
                    column.append(value)
            ends = np.append(np.diff(np.array(out[3])) != 0, False)
            waiting = pa.record_batch(
                {
                    "conv": batch["conv"], "digest": batch["digest"], "n_chars": batch["n_chars"], "pos": pa.array(out[0], pa.int64()), "product": _octets(out[1]),
                    "chars": pa.array(out[2], pa.int64()), "part": pa.array([part] * len(convs), pa.int32()), "first": np.array(out[3]) == 1, "last": ends,
                }
            )
        if waiting is not None:
            yield _with_last(waiting, True)

    order = ["conv", "turn", "digest", "row"]
    dealt = turns.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)  # nulls first
    schema = "conv long, digest binary, n_chars long, pos long, product binary, chars long, part int, first boolean, last boolean"
    scanned = materialize(dealt.mapInArrow(scan, schema), "turns")
    carried = _carried(scanned, base)
    if carried is None:
        return scanned

    def carry(batch: pa.RecordBatch) -> pa.RecordBatch:
        power = Powers(base)
        product, pos, chars = batch["product"].to_pylist(), batch["pos"].to_pylist(), batch["chars"].to_pylist()
        for k, before in enumerate(batch["before"].to_pylist()):
            if before is not None:
                product[k] = ((_number(before["product"]) * power[pos[k]] + _number(product[k])) % PRIME).to_bytes(16, "big")
                pos[k], chars[k] = pos[k] + before["pos"], chars[k] + before["chars"]
        columns = {name: batch[name] for name in ("conv", "digest", "n_chars")}
        return pa.record_batch({**columns, "pos": pa.array(pos, pa.int64()), "product": pa.array(product, pa.binary()), "chars": pa.array(chars, pa.int64())})

    joined = scanned.join(F.broadcast(carried), ["part", "first"], "left")  # at most one row a range partition
    return arrow_map(joined.select("conv", "digest", "n_chars", "pos", "product", "chars", "before"), lambda: carry, "conv long, digest binary, n_chars long, pos long, product binary, chars long")


def _with_last(batch: pa.RecordBatch, ends: bool) -> pa.RecordBatch:
    last = batch["last"].to_numpy(zero_copy_only=False).copy()
    last[-1] = ends
    return batch.set_column(batch.schema.get_field_index("last"), "last", pa.array(last))


def _carried(scanned: DataFrame, base: int) -> DataFrame | None:
    """For every partition whose first conversation began in an earlier one: what came before it there. Two rows a
    partition are looked at (its first run and its last)."""
    last_run = F.max(F.struct("conv", "pos", "product", "chars")).alias("tail")
    first_run = F.max(F.when(F.col("first"), F.struct("conv", "pos", "product", "chars"))).alias("head")
    edges = scanned.where("last").groupBy("part").agg(first_run, last_run).orderBy("part").collect()
    power, rows, state = Powers(base), [], None
    for edge in edges:
        head, tail = edge["head"], edge["tail"]
        goes_on = state is not None and state[0] == head["conv"]
        if goes_on:
            rows.append((edge["part"], True, (state[1], bytearray(state[2].to_bytes(16, "big")), state[3])))
        if tail["conv"] == head["conv"] and goes_on:
            state = (tail["conv"], state[1] + tail["pos"], (state[2] * power[tail["pos"]] + _number(tail["product"])) % PRIME, state[3] + tail["chars"])
        else:
            state = (tail["conv"], tail["pos"], _number(tail["product"]), tail["chars"])
    return scanned.sparkSession.createDataFrame(rows, "part int, first boolean, before struct<pos:long, product:binary, chars:long>") if rows else None


# -- members ---------------------------------------------------------------------------------------------------------
_MEMBER = "conv long, depth long, f1 long, f2 long, p1 long, p2 long, r1 long, r2 long, n_chars long, before long, ends boolean"


def _member_batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of conv, depth, prefix, parent, digest, n_chars, characters before, whether the conversation ends here."""
    conv, depth, prefix, parent, digest, n_chars, before, ends = zip(*rows) if rows else [[]] * 8
    (f1, f2), (p1, p2) = _halves(prefix), _halves(parent)
    r1, r2 = _halves([_number(d[16:]) for d in digest])
    numbers = dict(zip(("conv", "depth"), (conv, depth))) | {"f1": f1, "f2": f2, "p1": p1, "p2": p2, "r1": r1, "r2": r2, "n_chars": n_chars, "before": before}
    return pa.record_batch({k: pa.array(v, pa.int64()) for k, v in numbers.items()} | {"ends": pa.array(ends, pa.bool_())})


def conversation_heads(products: DataFrame) -> DataFrame:
    """A row per conversation: its number of turns and its first turns (at most ``HEADS``), and those of its base."""
    first = F.when(F.col("pos") <= HEADS, F.struct("pos", "product", "digest", "n_chars", "chars"))
    own = materialize(products.groupBy("conv").agg(F.max("pos").alias("n"), F.array_sort(F.collect_list(first)).alias("head")), "heads")
    h = (F.crc32(F.col("conv").cast("string")) % (HEADS + 1)).cast("long")
    base = own.select(F.col("conv").alias("base"), F.col("head").alias("base_head"))
    return own.withColumns({"h": h, "base": F.col("conv") - F.col("conv") % GROUP}).join(base, "base", "left")


def head_members(heads: DataFrame) -> DataFrame:
    """Members of the root and of the nodes that end within a head."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for x in batch.to_pylist():
            head = (x["base_head"] or [])[: x["h"]]
            end = len(head) + max(x["n"] - x["h"], 0)
            rows.append((x["conv"], 0, 0, 0, bytes(32), 0, 0, end == 0))
            parent, before = 0, 0
            for turn in head:
                prefix = _number(turn["product"])
                rows.append((x["conv"], turn["pos"], prefix, parent, turn["digest"], turn["n_chars"], before, turn["pos"] == end))
                parent, before = prefix, turn["chars"]
        return _member_batch(rows)

    return arrow_map(heads.select("conv", "n", "h", "base_head"), lambda: run, _MEMBER)


def head_shifts(heads: DataFrame) -> DataFrame:
    """Per conversation with own turns after its head: n, h, the constant ``shift`` = H - P(h), and by how much depth and
    characters in front differ from those of the own turns."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = ([], [], [], [], [], [])
        for x in batch.to_pylist():
            if x["n"] > x["h"]:
                head = (x["base_head"] or [])[: x["h"]]
                skipped = x["head"][x["h"] - 1] if x["h"] else None
                value = (_number(head[-1]["product"]) if head else 0) - (_number(skipped["product"]) if skipped else 0)
                chars = (head[-1]["chars"] if head else 0) - (skipped["chars"] if skipped else 0)
                for column, v in zip(out, (x["conv"], x["n"], x["h"], (value % PRIME), len(head) - x["h"], chars)):
                    column.append(v)
        names = ("conv", "n", "h", "shift", "deeper", "more_chars")
        return pa.record_batch({k: _octets(v) if k == "shift" else pa.array(v, pa.int64()) for k, v in zip(names, out)})

    return arrow_map(heads.select("conv", "n", "h", "head", "base_head"), lambda: run, "conv long, n long, h long, shift binary, deeper long, more_chars long")


def own_members(products: DataFrame, shifts: DataFrame, base: int) -> DataFrame:
    """Members of the nodes that end with a turn of the conversation's own."""

    def make():
        power, inverse = Powers(base), pow(base, -1, PRIME)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = (batch[c].to_pylist() for c in ("conv", "digest", "n_chars", "pos", "product", "chars", "n", "h", "shift", "deeper", "more_chars"))
            rows = []
            for conv, digest, n_chars, pos, product, chars, n, h, shift, deeper, more in zip(*columns):
                prefix = (_number(product) + _number(shift) * power[pos - h]) % PRIME
                parent = (prefix - element(digest)) * inverse % PRIME
                rows.append((conv, pos + deeper, prefix, parent, digest, n_chars, chars + more - n_chars, pos == n))
            return _member_batch(rows)

        return run

    return arrow_map(products.join(shifts, "conv").where("pos > h"), make, _MEMBER)


# -- nodes -----------------------------------------------------------------------------------------------------------
def _agree(*columns: str) -> Column:
    same = F.lit(True)
    for c in columns:
        same &= F.min(c) == F.max(c)
    return same


def nodes_of(members: DataFrame) -> DataFrame:
    """A row per node; ``agrees`` tells whether all its members have the same last turn and the same parent."""
    return members.groupBy(*_KEY).agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("n_chars").alias("n_chars"),
        _agree("p1", "p2", "r1", "r2", "n_chars").alias("agrees"),
    )


def joined_ids(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending ids of each node's conversations that end there, comma-joined. Ids are joined into pieces
    over range partitions; only the pieces of a node, in order, pass through one task, a piece at a time, since the
    digest of a string can't be put together from parts."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, size = None, [], 0
        done: list[tuple] = []

        def close() -> None:
            if ids:
                done.append((*key, ids[0], ",".join(map(str, ids)).encode()))

        def flush() -> pa.RecordBatch:
            columns = dict(zip((*_KEY, "first_id"), zip(*[d[:4] for d in done])))
            return pa.record_batch({k: pa.array(v, pa.int64()) for k, v in columns.items()} | {"joined": pa.array([d[4] for d in done], pa.binary())})

        for batch in batches:
            for depth, f1, f2, conv in zip(*(batch[c].to_pylist() for c in (*_KEY, "conv"))):
                if (depth, f1, f2) != key or size >= JOINED:
                    close()
                    key, ids, size = (depth, f1, f2), [], 0
                ids.append(conv)
                size += len(str(conv)) + 1
            if done:
                yield flush()
                done.clear()
        close()
        if done:
            yield flush()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, done = None, None, []

        def flush() -> pa.RecordBatch:
            columns = dict(zip(_KEY, zip(*[d[:3] for d in done])))
            return pa.record_batch({k: pa.array(v, pa.int64()) for k, v in columns.items()} | {"ends_sha256": pa.array([d[3] for d in done], pa.string())})

        for batch in batches:
            for depth, f1, f2, joined in zip(*(batch[c].to_pylist() for c in (*_KEY, "joined"))):
                if (depth, f1, f2) != key:
                    if key is not None:
                        done.append((*key, sha.hexdigest()))
                    key, sha = (depth, f1, f2), hashlib.sha256(joined)
                else:
                    sha.update(b"," + joined)
            if done:
                yield flush()
                done.clear()
        if key is not None:
            done.append((*key, sha.hexdigest()))
            yield flush()

    order = [*_KEY, "conv"]
    kinds = ", ".join(f"{c} long" for c in _KEY)
    parts = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, f"{kinds}, first_id long, joined binary")
    parts = materialize(parts, "ends")
    return parts.repartition(*_KEY).sortWithinPartitions(*_KEY, "first_id").mapInArrow(digests, f"{kinds}, ends_sha256 string")


def prefix_trie(conversations: DataFrame, seeds: range = range(8)) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 per node."""
    turns = turn_digests(conversations)
    for seed in seeds:
        base = base_of(seed)
        products = running_products(turns, base)
        heads = conversation_heads(products)
        members = materialize(head_members(heads).unionByName(own_members(products, head_shifts(heads), base)), "members")
        nodes = materialize(nodes_of(members), "nodes")
        if not nodes.where(~F.col("agrees")).limit(1).count():
            return _with_sums(members, nodes)
    raise RuntimeError("no base of the fingerprints told all prefixes apart")


def _with_sums(members: DataFrame, nodes: DataFrame) -> DataFrame:
    above = (F.col("depth") - 1).alias("depth")
    children = nodes.where("depth > 0").groupBy(above, F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(F.count("*").alias("n_children"))
    counted = materialize(nodes.join(children, _KEY, "left").fillna(0, ["n_children"]), "counted")
    # what a conversation owns: from which depth, the deepest node it shares, whether its end is a leaf, its characters
    owned = counted.groupBy(F.col("conv_id").alias("conv")).agg(
        F.min("depth").alias("from_depth"), F.max(F.when(F.col("n_convs") > 1, F.col("depth"))).alias("shared"),
        F.max((F.col("n_children") == 0).cast("long")).alias("leaf"), F.sum("n_chars").alias("own_chars"),
    )
    total = members.where("ends").select("conv", (F.col("before") + F.col("n_chars")).alias("all_chars"))
    facts = total.join(owned, "conv", "left").fillna(0, ["leaf", "own_chars"])
    foreign = F.col("from_depth").isNull() | (F.col("depth") < F.col("from_depth"))
    shared = members.join(facts, "conv").where(foreign | (F.col("depth") <= F.col("shared")))
    saved = F.when(foreign, F.col("all_chars") - F.col("before") - F.col("own_chars")).otherwise(0)
    sums = shared.groupBy(*_KEY).agg(F.sum("leaf").alias("n_leaves"), F.sum(saved).alias("saved_tokens"))
    parents = counted.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv_id").alias("parent_conv_id")).where("n_children > 0")
    ends = joined_ids(members.where("ends"))
    return (
        counted.join(sums, _KEY, "left").join(ends, _KEY, "left").join(parents, ["depth", "p1", "p2"], "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
            F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )
