"""SimHash fingerprints and their Hamming self-join by joint descent of a binary trie.

The trie is split over the cluster by prefixes. Pairs of prefixes are followed together from the root, a few bits at a
time; their differing bits add up and a pair over the budget is dropped. A pair whose two subtrees are small enough is
finished by one task, which goes on bit by bit over the two sorted arrays. A task returns a spanning forest of the links
it found (at most one link per word), so groups of copies never become all their pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm.components import star_roots
from ledgerloom.llm.shared import WordHashes, arrow_map, majority_word, majority_words, materialize, mix64, shingle_hashes

BITS = 64
STEP = 4
PAIRS_AT_ONCE = 1 << 20


# ---------------------------------------------------------------- fingerprints


def text_fingerprint(text: bytes, size: int = 3) -> int:
    """SimHash of a text's word shingles: A-Z lowered, words split at ASCII blanks, XXH64 seed 42, bits set in over half."""
    words = text.lower().split()
    if not words:
        return 0
    size = min(size, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())), np.uint64, len(starts))
    return majority_word(hashes)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, word long) per document; a null or wordless text has word 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).cast("binary").alias("body"))

    def make():
        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            words = np.array([text_fingerprint(t, size) for t in b.column("body").to_pylist()], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([b.column("id"), pa.array(words)], ["id", "word"])

        return batch

    return arrow_map(rows, make, "id long, word long")


# ---------------------------------------------------------------- descent inside one task


class Forest:
    """Union-find over local positions that remembers the links which joined two trees."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        for i, j in zip(left.tolist(), right.tolist()):
            a, b = self.find(i), self.find(j)
            if a != b:
                self.root[max(a, b)] = min(a, b)
                self.links.append((i, j))
        self.flatten()

    def flatten(self) -> None:
        while True:
            up = self.root[self.root]
            if np.array_equal(up, self.root):
                return
            self.root = up


def _pairs_of(alo, ahi, blo, bhi) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) of the given products of ranges, in blocks of bounded size."""
    width = bhi - blo
    starts, ends = alo, ahi
    long_rows = np.repeat(np.arange(len(starts)), ends - starts)
    i = np.arange(len(long_rows)) - np.repeat(np.cumsum(ends - starts) - (ends - starts), ends - starts) + starts[long_rows]
    w, lo = width[long_rows], blo[long_rows]
    at = 0
    while at < len(i):
        stop = max(at + 1, int(np.searchsorted(np.cumsum(w[at:]), PAIRS_AT_ONCE, "right")) + at)
        n = w[at:stop]
        for off in range(0, int(n[0]) if stop == at + 1 else 1, PAIRS_AT_ONCE):
            m = np.minimum(n - off, PAIRS_AT_ONCE) if stop == at + 1 else n
            left = np.repeat(i[at:stop], m)
            right = np.arange(len(left)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo[at:stop] + off, m)
            yield left, right
        at = stop


def descend(a: np.ndarray, b: np.ndarray, depth: int, errors: int, budget: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of positions (i, j) with at most ``budget`` differing bits between sorted arrays a and b.

    ``errors`` bits differ in the first ``depth`` already. With ``same`` a is b and each pair comes once, i < j.
    """
    one = np.array([0]), np.array([len(a)]), np.array([0]), np.array([len(b)]), np.array([errors])
    stack = [(BITS - depth, *one)]
    while stack:
        left, alo, ahi, blo, bhi, err = stack.pop()
        small = (ahi - alo) * (bhi - blo) <= 8 if left else np.ones(len(alo), bool)
        if small.any():
            for i, j in _pairs_of(alo[small], ahi[small], blo[small], bhi[small]):
                near = np.bitwise_count(a[i] ^ b[j]) <= budget
                near &= (i < j) if same else True
                if near.any():
                    yield i[near], j[near]
            alo, ahi, blo, bhi, err = (x[~small] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        if len(alo) > PAIRS_AT_ONCE:
            half = len(alo) // 2
            stack.append((left, *(x[:half] for x in (alo, ahi, blo, bhi, err))))
            stack.append((left, *(x[half:] for x in (alo, ahi, blo, bhi, err))))
            continue
        bit = np.uint64(left - 1)
        low = (np.uint64(1) << bit) - np.uint64(1)
        mask = ~((low << np.uint64(1)) | np.uint64(1))
        amid = np.searchsorted(a, (a[alo] & mask) | (low + np.uint64(1)))
        bmid = np.searchsorted(b, (b[blo] & mask) | (low + np.uint64(1)))
        own = same & (alo == blo)
        kids = [(alo, amid, blo, bmid, err), (amid, ahi, bmid, bhi, err), (alo, amid, bmid, bhi, err + 1), (amid, np.where(own, amid, ahi), blo, bmid, err + 1)]
        alo, ahi, blo, bhi, err = (np.concatenate(x) for x in zip(*kids))
        live = (alo < ahi) & (blo < bhi) & (err <= budget)
        stack.append((left - 1, *(x[live] for x in (alo, ahi, blo, bhi, err))))


# ---------------------------------------------------------------- descent over the cluster


def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned("word", BITS - depth) if depth else F.lit(0).cast("long")


def _node_pairs(words: DataFrame, budget: int, leaf: int) -> list[tuple[int, DataFrame]]:
    """By depth, the pairs (tree, pa, pb, errors, na, nb) of prefixes whose subtrees one task may finish."""
    ready = []
    depth, pairs = 0, None
    while True:
        sizes = materialize(words.groupBy("tree", _prefix(depth).alias("p")).agg(F.count("*").alias("n")), "nodes")
        if pairs is None:  # the root with itself
            sized = sizes.select("tree", F.col("p").alias("pa"), F.col("p").alias("pb"), F.lit(0).alias("errors"), F.col("n").alias("na"), F.col("n").alias("nb"))
        else:
            sized = pairs.join(sizes.select("tree", F.col("p").alias("pa"), F.col("n").alias("na")), ["tree", "pa"])
            sized = sized.join(sizes.select("tree", F.col("p").alias("pb"), F.col("n").alias("nb")), ["tree", "pb"])
        sized = materialize(sized.select("tree", "pa", "pb", "errors", "na", "nb"), "pairs")
        fits = (F.greatest("na", "nb") <= leaf) | F.lit(depth == BITS)
        ready.append((depth, sized.filter(fits)))
        unready = sized.filter(~fits)
        if unready.isEmpty():
            return ready
        kids = words.select("tree", _prefix(depth).alias("p"), _prefix(depth + STEP).alias("kid")).distinct()
        both = unready.join(kids.select("tree", F.col("p").alias("pa"), F.col("kid").alias("ka")), ["tree", "pa"])
        both = both.join(kids.select("tree", F.col("p").alias("pb"), F.col("kid").alias("kb")), ["tree", "pb"])
        both = both.filter((F.col("pa") != F.col("pb")) | (F.col("ka") <= F.col("kb")))
        low = F.lit((1 << STEP) - 1)
        both = both.withColumn("errors", F.col("errors") + F.bit_count(F.col("ka").bitwiseXOR(F.col("kb")).bitwiseAND(low))).filter(F.col("errors") <= budget)
        pairs = both.select("tree", F.col("ka").alias("pa"), F.col("kb").alias("pb"), "errors")
        depth += STEP


def hamming_links(words: DataFrame, budget: int, leaf: int = 1 << 15, far: int | None = None) -> DataFrame:
    """A forest (u, v) of ids that joins what the links join: pairs of one tree with at most ``budget`` differing bits.

    ``words`` has tree int, word long, id long, sig binary (may be empty). With ``far`` a pair must also have at most that
    many differing bits in sig. Subtrees of over ``leaf`` words are split by further bits; full-depth groups of equal
    words over it are cut into blocks, and every pair of blocks is compared. Nothing is left out.
    """

    def make():
        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            us, vs = [], []
            for row in range(b.num_rows):
                depth, errors, same = (b.column(c)[row].as_py() for c in ("depth", "errors", "same"))
                sides = []
                for side in ("a", "b")[: 1 if same else 2]:
                    items = b.column(side)[row].values
                    word = np.asarray(items.field("word")).view(np.uint64)
                    order = np.argsort(word, kind="stable")
                    sig = b"".join(items.field("sig").to_pylist()) if far is not None else b""
                    sigs = np.frombuffer(sig, np.uint64).reshape(len(word), -1)[order] if far is not None else None
                    sides.append((word[order], np.asarray(items.field("id"))[order], sigs))
                (wa, ia, sa), (wb, ib, sb) = sides[0], sides[-1]
                off = 0 if same else len(wa)
                forest = Forest(off + len(wb))
                for i, j in descend(wa, wb, depth, errors, budget, same):
                    new = forest.root[i] != forest.root[j + off]
                    i, j = i[new], j[new]
                    if far is not None and len(i):
                        near = np.bitwise_count(sa[i] ^ sb[j]).sum(1, dtype=np.int64) <= far
                        i, j = i[near], j[near]
                    forest.add(i, j + off)
                ids = ia if same else np.concatenate((ia, ib))
                for i, j in forest.links:
                    us.append(int(ids[i]))
                    vs.append(int(ids[j]))
            return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

        return batch

    found = []
    item = F.struct("word", "id", "sig")
    for depth, pairs in _node_pairs(words, budget, leaf):
        pairs = pairs.filter("pa <> pb or na > 1")  # a word alone has no partner
        parts = lambda n: F.ceil(F.col(n) / leaf).cast("int")
        sizes = pairs.select("tree", F.col("pa").alias("p"), F.col("na").alias("n")).union(pairs.select("tree", "pb", "nb")).distinct()
        kept = words.withColumn("p", _prefix(depth)).join(sizes, ["tree", "p"])
        lists = kept.groupBy("tree", "p", F.pmod(F.xxhash64("id"), parts("n")).cast("int").alias("part")).agg(F.collect_list(item).alias("items"))
        blocks = pairs.withColumn("qa", F.explode(F.sequence(F.lit(0), parts("na") - 1))).withColumn("qb", F.explode(F.sequence(F.lit(0), parts("nb") - 1)))
        blocks = blocks.filter((F.col("pa") != F.col("pb")) | (F.col("qa") <= F.col("qb")))
        full = blocks.join(lists.select("tree", F.col("p").alias("pa"), F.col("part").alias("qa"), F.col("items").alias("a")), ["tree", "pa", "qa"])
        full = full.join(lists.select("tree", F.col("p").alias("pb"), F.col("part").alias("qb"), F.col("items").alias("b")), ["tree", "pb", "qb"])
        same = (F.col("pa") == F.col("pb")) & (F.col("qa") == F.col("qb"))
        found.append(full.select(F.lit(depth).alias("depth"), "errors", same.alias("same"), "a", F.when(~same, F.col("b")).alias("b")))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return arrow_map(rows, make, "u long, v long").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, budget: int = 2, leaf: int = 1 << 15) -> DataFrame:
    """(id, word, component_id) per row: the smallest id reachable over links of at most ``budget`` differing bits.

    Null and wordless texts have word 0 and link like others; repeated rows are returned as often as they come; a null id
    is returned and can be in a component but never names one, unless no id in it is known (then component_id is null).
    """
    prints = materialize(fingerprints(docs, id_col, text_col, size), "prints")
    firsts = materialize(prints.groupBy("word").agg(F.min("id").alias("first")), "words")
    words = firsts.select(F.lit(0).alias("tree"), "word", F.col("word").alias("id"), F.lit(b"").alias("sig"))
    roots = star_roots(hamming_links(words, budget, leaf)).select(F.col("u").alias("word"), F.col("v").alias("root"))
    rooted = firsts.join(roots, "word", "left").select("word", "first", F.coalesce("root", "word").alias("root"))
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialize(rooted.join(names, "root").select("word", "component_id"), "named")
    return prints.join(named, "word").select("id", "word", "component_id")


# ---------------------------------------------------------------- near copies of whole documents

#: A text's SimHash has 64 * SIGNATURE_WORDS bits over its five-word shingles. Each of NEAR_TREES trees takes NEAR_EXACT +
#: NEAR_REST of them by a fixed draw: candidates agree in the first NEAR_EXACT, which name the tree's part, and differ in at most
#: NEAR_BUDGET of the rest, which the descent finds. At a similarity (Jaccard) of 0.8 a bit differs with probability 0.15 and a
#: tree then joins a pair with 0.27 * 0.49: all 64 miss it with probability 1e-4; with 0.19 (four shingles inside five), 0.02.
SIGNATURE_WORDS = 16
NEAR_TREES = 64
NEAR_EXACT = 8
NEAR_REST = 24
NEAR_BUDGET = 3
NEAR_SHINGLE = 5
#: Bits that candidates may differ in, of the first 128. A similarity of 0.8 leads to 20 on average, with a deviation of 4;
#: other texts differ in 64. What is left is then compared on its shingles.
FAR_WORDS = 2
NEAR_FAR = 44
NEAR_NINTHS = 4  # |A and B| / |A or B| >= 0.8 is 9 |A and B| >= 4 (|A| + |B|)
BLOCK_RUNS = 1 << 17

_salts = lambda n, seed: np.array([seed * (2 * k + 1) & (2**64 - 1) for k in range(n)], np.uint64)[:, None]
_SIGN_SALTS = mix64(_salts(SIGNATURE_WORDS, 0x9FB21C651E98DF25))
_drawn = np.random.RandomState(7)  # its stream is fixed for good, so all tasks and machines draw alike
_BITS_OF_TREE = np.concatenate([_drawn.permutation(64 * SIGNATURE_WORDS) for _ in range(NEAR_TREES * (NEAR_EXACT + NEAR_REST) // (64 * SIGNATURE_WORDS))])
_BITS_OF_TREE = _BITS_OF_TREE.reshape(NEAR_TREES, NEAR_EXACT + NEAR_REST)

_WORD = re.compile(r"[^\W_]+")


def _text_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def near_signature(runs: np.ndarray) -> np.ndarray:
    """The SimHash of a text's distinct shingle hashes, SIGNATURE_WORDS words; all 0 without shingles."""
    return majority_words(mix64(runs ^ _SIGN_SALTS))


def near_prints(signature: np.ndarray) -> np.ndarray:
    """The bits of a signature that each tree takes, the exact ones highest."""
    bits = np.unpackbits(signature.view(np.uint8), bitorder="little")
    return np.packbits(bits[_BITS_OF_TREE], axis=1).view(">u4").ravel().astype(np.uint64)


def near_bands(runs: np.ndarray) -> np.ndarray:
    """The part of each tree that a text goes to: the bits in which candidates agree."""
    return near_prints(near_signature(runs)) >> np.uint64(NEAR_REST)


def near_sketches(docs: DataFrame) -> DataFrame:
    """(id, prints array of long, sig binary): the bits that each tree takes of the SimHash of the distinct five-word shingles,
    and its first FAR_WORDS words. ``docs`` has id and text."""

    def make():
        hashes = WordHashes()

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            prints, sigs = [], []
            for text in b.column("text").to_pylist():
                signature = near_signature(np.unique(shingle_hashes(hashes.of(_text_words(text or "")), NEAR_SHINGLE)))
                prints.append(near_prints(signature))
                sigs.append(signature[:FAR_WORDS].tobytes())
            flat = pa.array(np.concatenate(prints).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, NEAR_TREES), pa.int32()), flat)
            return pa.RecordBatch.from_arrays([b.column("id"), lists, pa.array(sigs, pa.binary())], ["id", "prints", "sig"])

        return batch

    return arrow_map(docs.select("id", "text"), make, "id long, prints array<long>, sig binary", by_row=True)


def alike(a: list[bytes], b: list[bytes] | None = None) -> list[tuple[int, int]]:
    """A forest of the pairs with a similarity of 0.8 or more, exactly; each item is the distinct shingle hashes of a text.

    Positions run through a and then b; with b only pairs of an item of a and one of b are compared, else all pairs of a.
    """
    items = a + (b or [])
    sizes = np.array([len(x) // 8 for x in items])
    ends = np.cumsum(sizes)
    known, at = np.unique(np.frombuffer(b"".join(items), np.uint64), return_inverse=True)
    mark = np.zeros(len(known), bool)
    forest = Forest(len(items))
    first = len(a) if b is not None else 0
    from_run = int(ends[first - 1]) if first else 0
    starts, stops = ends[first:] - sizes[first:] - from_run, ends[first:] - from_run
    for i in range(len(a)):
        if (forest.root[first:] == forest.root[i]).all():
            continue
        own = at[ends[i] - sizes[i] : ends[i]]
        mark[own] = True
        total = np.concatenate(([0], np.cumsum(mark[at[from_run:]])))
        mark[own] = False
        near = 9 * (total[stops] - total[starts]) >= NEAR_NINTHS * (sizes[i] + sizes[first:])
        j = np.flatnonzero(near & (forest.root[first:] != forest.root[i])) + first
        forest.add(np.full(len(j), i), j)
    return forest.links


def _alike_links(rows: DataFrame) -> DataFrame:
    """(u, v) for rows (a, b) of lists of (id, runs); b is null where a is compared with itself."""

    def make():
        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            us, vs = [], []
            for row in range(b.num_rows):
                sides = [b.column(c)[row].values for c in ("a", "b") if b.column(c)[row].is_valid]
                ids = np.concatenate([np.asarray(x.field("id")) for x in sides])
                for i, j in alike(*(x.field("runs").to_pylist() for x in sides)):
                    us.append(int(ids[i]))
                    vs.append(int(ids[j]))
            return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

        return batch

    return arrow_map(rows, make, "u long, v long").filter("u <> v").distinct()


def near_runs(docs: DataFrame) -> DataFrame:
    """(id, comp, runs binary): the distinct shingle hashes of every row (id, comp, text)."""

    def make():
        hashes = WordHashes()

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            runs = [np.unique(shingle_hashes(hashes.of(_text_words(t)), NEAR_SHINGLE)).tobytes() for t in b.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([b.column("id"), b.column("comp"), pa.array(runs, pa.binary())], ["id", "comp", "runs"])

        return batch

    return arrow_map(docs.select("id", "comp", "text"), make, "id long, comp long, runs binary", by_row=True)


def verified_links(runs: DataFrame, block: int = BLOCK_RUNS) -> DataFrame:
    """(u, v): links whose components are those of all pairs of one comp with a similarity of 0.8 or more, exactly.

    A comp is dealt into blocks of about ``block`` shingles. Blocks are compared within first, then by pairs; a pair of
    blocks whose texts are all linked to each other already is passed over.
    """
    runs = materialize(runs.dropDuplicates(["id", "comp", "runs"]), "runs")
    sizes = runs.groupBy("comp").agg(F.ceil(F.sum(F.octet_length("runs")) / (8 * block)).cast("int").alias("parts"))
    sizes = sizes.withColumn("parts", F.greatest("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part")
    dealt = materialize(runs.join(sizes, "comp").select("comp", "parts", part, "id", "runs"), "dealt")
    lists = materialize(dealt.groupBy("comp", "parts", "part").agg(F.collect_list(F.struct("id", "runs")).alias("items")), "lists")
    kind = lists.select(F.col("items").alias("b")).schema["b"].dataType
    within = materialize(_alike_links(lists.select(F.col("items").alias("a"), F.lit(None).cast(kind).alias("b"))), "within")
    split = dealt.filter("parts > 1")
    if split.isEmpty():
        return within
    roots = star_roots(within).select(F.col("u").alias("id"), F.col("v").alias("root"))
    rooted = split.select("comp", "part", "id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    blocks = rooted.groupBy("comp", "part").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    blocks = materialize(blocks, "blocks")
    side = lambda x: blocks.select("comp", *(F.col(c).alias(c + x) for c in ("part", "low", "high")))
    pairs = side("a").join(side("b"), "comp").filter("parta < partb and not (lowa = higha and lowb = highb and lowa = lowb)")
    full = pairs.join(lists.select("comp", F.col("part").alias("parta"), F.col("items").alias("a")), ["comp", "parta"])
    full = full.join(lists.select("comp", F.col("part").alias("partb"), F.col("items").alias("b")), ["comp", "partb"])
    return within.unionByName(materialize(_alike_links(full.select("a", "b")), "across"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep) per document that is a copy of another: ``keep`` is the smallest id of its group.

    Equal texts are one document from the start. Others are linked if their similarity on five-word shingles is 0.8 or more,
    exactly; they are compared if the trie join of their SimHash finds them in one of its trees and the SimHash as a whole is
    not far off, or are joined by others that do. Rows with a null id are no candidates; a null text counts as empty, and texts
    without words are copies of each other. Words travel with their signature: several texts of one id stay apart.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).filter("id is not null")
    keyed = rows.select("id", F.sha2("text", 256).alias("digest"))
    classes = materialize(keyed.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")), "classes")
    repeated = classes.filter("first <> last")
    exact = keyed.join(repeated, "digest").filter("id <> first").select("id", F.col("first").alias("root")).distinct()
    exact = materialize(exact, "exact")
    single = rows.join(exact, "id", "left_anti")
    sketches = materialize(near_sketches(single), "sketches")
    bits = sketches.select("id", "sig", F.posexplode("prints").alias("tree", "print"))
    part = F.shiftright("print", NEAR_REST).cast("int")
    rest = F.shiftleft(F.col("print").bitwiseAND(F.lit((1 << NEAR_REST) - 1)), BITS - NEAR_REST)
    words = bits.select((F.col("tree") * (1 << NEAR_EXACT) + part).alias("tree"), rest.alias("word"), "id", "sig")
    joined = star_roots(hamming_links(words, NEAR_BUDGET, 1 << 16, NEAR_FAR)).select(F.col("u").alias("id"), F.col("v").alias("comp"))
    members = materialize(joined.unionByName(joined.select(F.col("comp").alias("id"), "comp").distinct()), "members")
    edges = verified_links(near_runs(rows.join(members, "id"))).unionByName(exact.select(F.col("id").alias("u"), F.col("root").alias("v")))
    return star_roots(edges).select(F.col("u").alias("id"), F.col("v").alias("keep"))
