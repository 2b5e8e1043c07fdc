"""SimHash near-duplicates: fingerprints, a binary-trie self-join, and connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free, ship, slices, texts, tidy

#: Fingerprints that one trie holds at most; a larger trie is dealt out as pairs of parts.
TRIE = 1 << 15
#: Node pairs and links that are looked at in one step: this bounds a worker's memory.
STEP = 1 << 18
#: Slots of a sketch, two bits each: the similarity of two texts is known to about 0.042.
SLOTS = 128
#: Bands of so many neighbouring slots each: texts that agree in a whole band are candidates, too.
BANDS, BAND = 25, 5
#: Shingles of the texts that one task compares exactly; a text counts as TEXT_COST more. Larger groups are dealt out as pairs of parts.
EXACT, TEXT_COST = 1 << 20, 512
#: Bytes of a list of texts to compare that is sent to every executor; a longer one is joined by shuffling.
SENT = 1 << 20
#: Links whose components one task finds (about 300 MB of a worker's memory); more are taken by steps over all tasks.
LINKS = 1 << 21
#: Bytes of a text whose words are hashed in one step, and of a word; a digest stands for a longer one.
HASHED, LONG = 1 << 18, 1 << 12
#: Powers of an odd number, one for each place in a word.
POWERS = np.cumprod(np.full(LONG, 0x9FB21C651E98DF25, np.uint64))


def bits(hashes: np.ndarray) -> int:
    """The fingerprint of 64-bit hashes, as a signed long: a bit is 1 if set in over half of them."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    h = hashes.astype(">u8").view(np.uint8).reshape(n, 8)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(">u8")[0].astype(np.uint64).astype(np.int64))


def fingerprint(text: str | None, words: int = 4) -> int:
    """64-bit SimHash of a whole text's shingles, as a signed long; 0 without words."""
    import xxhash

    tokens = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(tokens))
    h64 = xxhash.xxh64_intdigest
    return bits(np.array([h64(line[a:b], 42) for a, b in zip(starts[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64))


def words_of(text: str | None) -> bytes:
    """The words of a whole text, lower-cased, with single spaces between them."""
    import xxhash

    tokens = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if tokens and max(map(len, tokens)) > LONG:
        tokens = [t if len(t) <= LONG else xxhash.xxh128_hexdigest(t, 7).encode() for t in tokens]
    return b" ".join(tokens)


def mixed(h: np.ndarray) -> np.ndarray:
    """The numbers with all their bits mixed, one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def word_hashes(line: bytes) -> np.ndarray:
    """A 64-bit hash of each word of ``words_of``, in order: a polynomial in its bytes, mixed."""
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(line):
        end = len(line) if len(line) - at <= HASHED else line.rindex(b" ", at, at + HASHED)
        b = np.frombuffer(line, np.uint8, end - at, at)
        gaps = np.flatnonzero(b == 32)
        starts = np.concatenate(([0], gaps + 1))
        lengths = np.diff(starts, append=len(b) + 1)
        value = (b + np.uint64(1)) * POWERS[np.minimum(np.arange(len(b)) - np.repeat(starts, lengths)[: len(b)], LONG - 1)]
        value[gaps] = 0
        h = mixed(np.add.reduceat(value, starts))
        out.append(mixed((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)))
        at = end + 1
    return np.concatenate(out)


def distinct_of(h: np.ndarray) -> np.ndarray:
    """The different ones of some hashes, sorted."""
    h = np.sort(h)
    return h[np.concatenate((np.ones(min(len(h), 1), bool), h[1:] != h[:-1]))]


def slots(shingles: np.ndarray) -> np.ndarray:
    """A number for each of SLOTS parts of the hash space: from the smallest hash there, or that of the next part that has one."""
    slot = (shingles >> np.uint64(57)).astype(np.int64)
    low = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(low, slot, shingles & np.uint64((1 << 57) - 1))
    full = np.flatnonzero(np.bincount(slot, minlength=SLOTS))
    ahead = full[np.searchsorted(full, np.arange(SLOTS)) % len(full)]
    away = (ahead - np.arange(SLOTS)) % SLOTS
    return (low[ahead] + away.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)) * np.uint64(0x9E3779B97F4A7C15)


def sketch(slots: np.ndarray) -> bytes:
    """Two bits of each slot, 32 bytes in all."""
    two = (slots >> np.uint64(62)).reshape(-1, 32) << np.arange(0, 64, 2, dtype=np.uint64)
    return np.bitwise_or.reduce(two, axis=1).astype("<u8").tobytes()


def unpacked(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of four numbers."""
    return np.frombuffer(b"".join(sketches), "<u8").reshape(-1, SLOTS // 32)


def bands(slots: np.ndarray) -> list[int]:
    """A signed long for each band of slots. Of two texts with Jaccard J each agrees with a chance of about J ** BAND."""
    own = slots[: BANDS * BAND].reshape(BANDS, BAND)
    out = own[:, 0].copy()
    for j in range(1, BAND):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + own[:, j]
    return out.view(np.int64).tolist()


def shingles(h: np.ndarray, words: int) -> np.ndarray:
    """The distinct shingles of a whole text, as sorted 64-bit hashes made from those of its words."""
    k = min(words, len(h))
    grams = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        grams = (grams ^ (grams >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + h[j : len(h) - k + 1 + j]
    return distinct_of(mixed(grams))


def signature(text: str | None, words: int = 5) -> tuple[int, int, int, bytes, int, list[int]]:
    """(id, check, fp, sketch, size, bands) of a whole text: 128 bits of a hash of its words in order, the SimHash of its distinct words, and of its shingles a sketch, the number and bands.

    A changed word changes one of the distinct words but ``words`` shingles, so near copies agree in more
    bits of this fingerprint than of one over shingles. A passage that is cut or put in changes many words at
    once but few shingles, so such copies agree in bands. The sketch tells which pairs can't be similar.
    """
    import xxhash

    line = words_of(text)
    own, check = np.frombuffer(xxhash.xxh128_digest(line, 9), np.int64).tolist()
    if not line:
        return own, check, 0, bytes(SLOTS // 4), 0, []
    h = word_hashes(line)
    grams = shingles(h, words)
    at = slots(grams)
    return own, check, bits(distinct_of(h)), sketch(at), len(grams), bands(at)


def alike(sketches: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs may be that similar: not those of too different sizes, nor those whose sketches show five standard errors less.

    Two bits agree by chance in a quarter of the slots that hold other shingles. Few shingles fill few
    slots, whose neighbours repeat them: a text counts as a third as many slots as it has shingles.
    """
    small, large = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
    agree = 0.25 + 0.75 * similarity
    least = agree - 5 * np.sqrt(agree * (1 - agree) / np.clip(small / 3, 1, SLOTS))
    share = [np.zeros(0)]
    for i in range(0, len(a), 1 << 16):
        off = sketches[a[i : i + (1 << 16)]] ^ sketches[b[i : i + (1 << 16)]]
        off = (off | off >> np.uint64(1)) & np.uint64(0x5555555555555555)
        share.append(1 - np.bitwise_count(off).sum(1) / SLOTS)
    return (small >= similarity * large * (1 - 1e-12)) & (np.concatenate(share) >= least)


def fingerprints(docs: DataFrame, words: int = 4, doc_id: str = "doc_id", text: str = "text", similar: bool = False) -> DataFrame:
    """One row (doc_id, row, id, check, fp) for each document, with sketch, size and bands if ``similar``.

    ``row`` is a hash of id and text; ``id`` and ``check`` tell apart what is linked: fingerprints, or texts if ``similar``.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            whole = texts(b.column("text"))
            if similar:
                got = [signature(t, words) for t in whole]
                more = [pa.array([g[j] for g in got], k) for j, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64())))]
            else:
                more = [pa.array([fingerprint(t, words) for t in whole], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), *more], names=["doc_id", "row", "id", "check", "fp", "sketch", "size", "bands"][: 8 if similar else 5])

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(doc_id, text).alias("row"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, row long, id long, check long, fp long" + ", sketch binary, size int, bands array<long>" * similar)


def blocks(distance: int, agree: int) -> list[tuple[int, int]]:
    """(first bit, width) of ``distance + agree`` blocks of the 64 bits; fingerprints that link agree in ``agree`` of them."""
    n = distance + agree
    edges = [round(i * 64 / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def hooked(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The roots, each the smallest of its component, once ``a`` and ``b`` are linked as well."""
    while len(a):
        ra, rb = root[a], root[b]
        new = ra != rb
        a, b, ra, rb = a[new], b[new], ra[new], rb[new]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(step := root[root], root):
            root = step
    return root


class Forest:
    """Sorted runs of fingerprints as binary tries, and which of the fingerprints are linked so far."""

    def __init__(self, keys: np.ndarray, sketches: np.ndarray | None = None, sizes: np.ndarray | None = None, similarity: float = 0.0):
        self.keys, self.sketches, self.sizes, self.similarity = keys, sketches, sizes, similarity
        self.root = np.arange(len(keys))
        self.settle()

    def settle(self) -> None:
        """Counts where neighbours differ in their root: a range without such a place is one component."""
        self.mixed = np.concatenate(([0], np.cumsum(self.root[1:] != self.root[:-1])))

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        if not len(a):
            return
        self.root = hooked(self.root, a, b)
        self.settle()

    def one(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return self.mixed[hi - 1] == self.mixed[lo]

    def halves(self, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
        """Where each range, whose keys agree above ``bit``, turns from 0 to 1 at it."""
        lo, hi = lo.copy(), hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            one = ((self.keys[np.minimum(mid, len(self.keys) - 1)] >> np.uint64(bit)) & np.uint64(1)).astype(bool)
            hi, lo = np.where(open_ & one, mid, hi), np.where(open_ & ~one, mid + 1, lo)
        return lo

    def join(self, alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray, top: int, budget: int) -> None:
        """Links all fingerprints of the range pairs that differ in at most ``budget`` bits (and may be similar).

        Pairs of trie nodes go down together, from bit ``top``. A pair keeps the number of bits that its
        nodes differ in; it is pruned beyond the budget, and where both nodes are already one component.
        Small nodes are compared outright.
        """
        stack = [(alo, ahi, blo, bhi, np.zeros(len(alo), np.int64), top)]
        while stack:
            alo, ahi, blo, bhi, off, bit = stack.pop()
            if len(alo) > STEP // 4:
                half = len(alo) // 2
                stack += [(alo[half:], ahi[half:], blo[half:], bhi[half:], off[half:], bit), (alo[:half], ahi[:half], blo[:half], bhi[:half], off[:half], bit)]
                continue
            keep = (ahi > alo) & (bhi > blo) & (off <= budget)
            alo, ahi, blo, bhi, off = (x[keep] for x in (alo, ahi, blo, bhi, off))
            if not len(alo):
                continue
            keep = ~(self.one(alo, ahi) & self.one(blo, bhi) & (self.root[alo] == self.root[blo]))
            alo, ahi, blo, bhi, off = (x[keep] for x in (alo, ahi, blo, bhi, off))
            small = ((ahi - alo) * (bhi - blo) <= 64) | (bit < 0)
            self.compare(alo[small], ahi[small], blo[small], bhi[small], budget)
            alo, ahi, blo, bhi, off = (x[~small] for x in (alo, ahi, blo, bhi, off))
            if not len(alo):
                continue
            am, bm = self.halves(alo, ahi, bit), self.halves(blo, bhi, bit)
            other = (alo != blo) | (ahi != bhi)
            # 0 with 1 and, of two different nodes, 1 with 0 differ in one more bit; the closer pairs come
            # first, so that a frontier that is halved links them before the others are looked at
            stack.append((
                np.concatenate((alo, am, alo, am[other])), np.concatenate((am, ahi, am, ahi[other])), np.concatenate((blo, bm, bm, blo[other])),
                np.concatenate((bm, bhi, bhi, bm[other])), np.concatenate((off, off, off + 1, off[other] + 1)), bit - 1,
            ))

    def compare(self, alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray, budget: int) -> None:
        """Compares all fingerprints of small nodes; of equal fingerprints' nodes, however large, in steps."""
        na, nb = ahi - alo, bhi - blo
        ends = np.cumsum(na * nb)
        total = int(ends[-1]) if len(ends) else 0
        for at in range(0, total, STEP):
            k = np.arange(at, min(at + STEP, total))
            which = np.searchsorted(ends, k, "right")
            k -= ends[which] - (na * nb)[which]
            a, b = alo[which] + k // nb[which], blo[which] + k % nb[which]
            near = (np.bitwise_count(self.keys[a] ^ self.keys[b]) <= budget) & (a != b) & (self.root[a] != self.root[b])
            a, b = a[near], b[near]
            if self.sketches is not None and len(a):
                fit = alike(self.sketches, self.sizes, a, b, self.similarity)
                a, b = a[fit], b[fit]
            self.link(a, b)


def join_tries(group: np.ndarray, side: np.ndarray, ids: np.ndarray, keys: np.ndarray, top: int, budget: int, sketches: np.ndarray | None, sizes: np.ndarray | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of what links within each group (side 0 with itself) or across its sides (0 with 1), to the smallest id, so that groups that link the same give the same."""
    order = np.lexsort((keys, side, group))
    group, side, keys, ids = group[order], side[order], keys[order], ids[order]
    run = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (side[1:] != side[:-1]))))
    stop = np.append(run[1:], len(group))
    forest = Forest(keys, None if sketches is None else sketches[order], None if sizes is None else sizes[order], similarity)
    first = np.flatnonzero(side[run] == 0)
    after = np.minimum(first + 1, len(run) - 1)
    crossed = (after > first) & (group[run[after]] == group[run[first]]) & (side[run[after]] == 1)
    b = np.where(crossed, after, first)
    forest.join(run[first], stop[first], run[b], stop[b], top, budget)
    least = ids.copy()
    np.minimum.at(least, forest.root, ids)
    least = least[forest.root]
    far = np.flatnonzero(least != ids)
    return ids[far], least[far]


def trie_links(nodes: DataFrame, distance: int = 4, similarity: float | None = None) -> DataFrame:
    """Edges (u, v) between rows (id, fp; sketch, size and bands if there is a ``similarity``): a spanning forest of all links.

    Rows link if their fingerprints differ in at most ``distance`` bits. With a similarity they also link if
    they agree in a band, and only if, by their sketches, they may be that similar: such links are candidates
    that ``exact_links`` decides. Those of a band are compared as a trie of equal keys is. Fingerprints that link agree in one of ``distance + 1`` blocks of bits, in two of
    ``distance + 2``, and so on; as many blocks are asked to agree as make nodes of about TRIE rows or
    fewer. Each (blocks, values) is a node of a trie whose first bits are those blocks'; below it, node
    pairs are traversed together. A node of more rows, as near copies make one, is dealt out as pairs of
    parts, so no task holds more than two parts at a time. Each gives at most one edge for each row it
    holds, however many links there are. What links does not depend on how rows are dealt out.
    """
    spark = nodes.sparkSession
    n, agree = nodes.count(), 1
    while agree < 4 and n >> (64 * agree // (distance + agree)) > TRIE:
        agree += 1
    cuts = blocks(distance, agree)
    fp = F.col("fp")
    value = lambda at, w: F.shiftrightunsigned(fp, 64 - at - w).bitwiseAND((1 << w) - 1)
    kinds = list(combinations(range(len(cuts)), agree))
    extra = ["sketch", "size"] if similarity is not None else []
    keyed = nodes.select("id", "fp", *extra, F.posexplode(F.array(*[F.xxhash64(*[value(*cuts[c]) for c in k]) for k in kinds])).alias("kind", "value"))
    if extra:  # only bands that meet others take a row with its sketch along
        narrow = nodes.select("id", F.posexplode("bands").alias("band", "value")).select("id", (F.col("band") + len(kinds)).alias("kind"), "value")
        shared = narrow.groupBy("kind", "value").count().where("count > 1").select("kind", "value")
        met = cut(narrow.join(shared, ["kind", "value"]))
        tidy(spark)
        keyed = keyed.union(met.join(nodes, "id").select(keyed.columns))
    # At most n / TRIE nodes of each kind are large.
    large = keyed.groupBy("kind", "value").count().where(F.col("count") > TRIE)
    parts = large.select("kind", "value", F.ceil(F.col("count") / TRIE * 1.25).cast("int").alias("parts"))
    if large.limit(1).count():
        keyed = keyed.join(parts, ["kind", "value"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        keyed = keyed.withColumn("own", F.pmod(F.xxhash64("id", F.lit(5)), F.col("parts")).cast("int"))
        keyed = keyed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        task, side = F.xxhash64("kind", "value", F.least("own", "other"), F.greatest("own", "other")), (F.col("own") > F.col("other")).cast("int")
    else:
        task, side = F.xxhash64("kind", "value"), F.lit(0)
    tasks = keyed.select("id", "fp", "kind", task.alias("task"), side.alias("side"), *extra)
    dealt = tasks.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), "task").sortWithinPartitions("task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def done(whole: bool) -> tuple[pa.Table, pa.Table]:
            t = pa.Table.from_batches(held).combine_chunks()
            task = t.column("task").to_numpy()
            end = len(task) if whole else int(np.searchsorted(task, task[-1], "left"))
            return t.slice(0, end), t.slice(end)

        def edges(t: pa.Table) -> pa.RecordBatch:
            kind, prints = t.column("kind").to_numpy(), t.column("fp").to_numpy().astype(np.uint64)
            keys, top = np.zeros(len(kind), np.uint64), 0
            for j, k in enumerate(kinds):  # what must agree is left out; the trie is over the other bits
                own = kind == j
                if own.any():
                    keys[own], width = squeezed(prints[own], [cuts[c] for c in range(len(cuts)) if c not in k])
                    top = max(top, width)
            s = unpacked(t.column("sketch").to_pylist()) if extra else None
            sizes = t.column("size").to_numpy() if extra else None
            u, v = join_tries(t.column("task").to_numpy(), t.column("side").to_numpy(), t.column("id").to_numpy(), keys, top - 1, distance, s, sizes, similarity or 0.0)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= 1 << 16:
                ready, rest = done(False)
                if ready.num_rows:
                    yield edges(ready)
                held = rest.to_batches()
                rows = rest.num_rows if ready.num_rows else 0
        if held:
            yield edges(done(True)[0])

    return dealt.mapInArrow(run, "u long, v long").distinct()


def squeezed(prints: np.ndarray, cuts: list[tuple[int, int]]) -> tuple[np.ndarray, int]:
    """The bits of some blocks side by side, and how many they are."""
    out, width = np.zeros(len(prints), np.uint64), 0
    for at, w in cuts:
        out = out << np.uint64(w) | prints >> np.uint64(64 - at - w) & np.uint64((1 << w) - 1)
        width += w
    return out, width


def exact_forest(ids: list[int], sides: list[int], roots: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of all pairs (within side 0, or across the sides if there are two) whose Jaccard is at least the similarity.

    Texts with the same root are linked already: such pairs are not looked at, and an edge is between roots.
    Where none are linked yet, within one side, the forest is of stars: each text with its component's root.
    """
    first = {(s, i): at for at, (s, i) in reversed(list(enumerate(zip(sides, ids, strict=True))))}
    at = sorted(first.values(), key=lambda j: (sides[j], ids[j]))
    names, sets = [ids[j] for j in at], [sets[j] for j in at]
    zeros = sum(sides[j] == 0 for j in at)
    sketches = unpacked([sketch(slots(x)) if len(x) else bytes(SLOTS // 4) for x in sets])
    sizes, root, out = np.array([len(x) for x in sets]), np.array([roots[j] for j in at]), []
    for i in range(zeros):
        others = np.arange(i + 1 if zeros == len(sets) else zeros, len(sets))
        others = others[root[others] != root[i]]
        for j in others[alike(sketches, sizes, np.full(len(others), i), others, similarity)].tolist():
            if root[j] != root[i]:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both / max(len(sets[i]) + len(sets[j]) - both, 1) >= similarity:
                    out.append((root[i].item(), root[j].item()))
                    root[root == root[j]] = root[i]
    if zeros == len(sets) and roots == ids:
        return [(n, r) for n, r in zip(names, root.tolist(), strict=True) if n != r]
    return out


def compared(docs: DataFrame, dealt: DataFrame, similarity: float, words: int) -> DataFrame:
    """Edges (u, v) between the texts of one task, for rows (doc_id, row, id, root, task, side) of ``dealt``."""
    spark = docs.sparkSession
    ship(spark)
    tidy(spark)
    dealt = dealt.select(F.col("doc_id").alias("d"), F.col("row").alias("r"), "id", "root", "task", "side")
    if dealt.count() * 64 <= SENT:  # then texts that no task asks for are not shuffled
        dealt = F.broadcast(dealt)
    met = docs.join(dealt, (docs["row"] == dealt["r"]) & docs["doc_id"].eqNullSafe(dealt["d"])).select("task", "side", "id", "root", "text")
    met = met.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), "task").sortWithinPartitions("task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        held: tuple[list, ...] = ([], [], [], [])
        found: list[tuple[int, int]] = []
        for b in slices(batches, "text"):
            for t, s, i, root, text in zip(*(b.column(c).to_pylist() for c in ("task", "side", "id", "root")), texts(b.column("text")), strict=True):
                if t != now:
                    if now is not None:
                        found += exact_forest(*held, similarity)
                    now, held = t, ([], [], [], [])
                for x, y in zip(held, (i, s, root, shingles(word_hashes(words_of(text)), words)), strict=True):
                    x.append(y)
            yield pa.RecordBatch.from_arrays([pa.array([e[j] for e in found], pa.int64()) for j in range(2)], names=["u", "v"])
            found = []
        if now is not None:
            found = exact_forest(*held, similarity)
            yield pa.RecordBatch.from_arrays([pa.array([e[j] for e in found], pa.int64()) for j in range(2)], names=["u", "v"])

    return met.mapInArrow(run, "u long, v long").distinct()


def in_parts(members: DataFrame) -> DataFrame:
    """``members`` with the number of parts of EXACT shingles that their group has, and the part each is in."""
    parts = members.groupBy("comp").agg(F.ceil(F.sum(F.col("size") + TEXT_COST) / EXACT).cast("int").alias("parts"))
    return members.drop("parts", "own").join(parts, "comp").withColumn("own", F.pmod(F.xxhash64("id", F.lit(5)), F.col("parts")).cast("int"))


def in_pairs(members: DataFrame) -> DataFrame:
    """Every pair of parts of a group as a task."""
    met = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    task, side = F.xxhash64("comp", F.least("own", "other"), F.greatest("own", "other")), (F.col("own") > F.col("other")).cast("int")
    return met.withColumn("task", task).withColumn("side", side)


def exact_links(docs: DataFrame, members: DataFrame, similarity: float, words: int) -> DataFrame:
    """(node, root) of the texts of each group: one root for all that are linked, by an exact Jaccard of their sets of shingles.

    ``docs`` is (doc_id, row, text); ``members`` (id, doc_id, row, size, comp) names the texts of each group ``comp``. All pairs
    within a group are decided from whole texts, unless size or sketch rule them out or both are linked
    already. A task holds texts of about EXACT shingles. A larger group is compared within parts first,
    then by one text of each component that its parts have found. That joins a group of near copies, however
    large, while each text moves once. If more than one component is left, all texts outside the
    largest meet every part of it; if those are more than a task holds, all pairs of parts meet.
    """

    def rooted(rows: DataFrame, stars: DataFrame) -> DataFrame:
        """``rows`` with the root that theirs has in ``stars``."""
        stars = stars.toDF("node", "to")
        tidy(docs.sparkSession)
        return cut(rows.join(stars, rows["root"] == stars["node"], "left").withColumn("root", F.coalesce("to", "root")).drop("node", "to"))

    members = cut(in_parts(members.withColumn("root", F.col("id"))))
    within = members.withColumn("task", F.xxhash64("comp", "own")).withColumn("side", F.lit(0))
    members = rooted(members, compared(docs, within, similarity, words))
    done, many = members.where("parts = 1").select("id", "root"), members.where("parts > 1")
    if not many.limit(1).count():
        return done.toDF("node", "root")
    reps = cut(in_parts(many.where("id = root")))
    found = compared(docs, in_pairs(reps), similarity, words)
    many = rooted(many, components(found) if reps.where("parts > 1").limit(1).count() else found)
    weight = many.groupBy("comp", "root").agg(F.sum(F.col("size") + TEXT_COST).alias("weight"))
    left = weight.groupBy("comp").agg(F.max_by("root", "weight").alias("main"), (F.sum("weight") - F.max("weight")).alias("rest")).where("rest > 0")
    open_ = cut(many.join(left, "comp"))
    if open_.limit(1).count():
        few, rest = open_.where(F.col("rest") <= EXACT), open_.where(F.col("rest") > EXACT)
        part = F.when(F.col("root") == F.col("main"), F.array("own")).otherwise(F.sequence(F.lit(-1), F.col("parts") - 1))
        few = few.withColumn("other", F.explode(part)).withColumn("task", F.xxhash64("comp", "other")).withColumn("side", ((F.col("root") != F.col("main")) & (F.col("other") >= 0)).cast("int"))
        names = ["doc_id", "row", "id", "root", "task", "side"]
        found = cut(compared(docs, few.select(names).union(in_pairs(rest).select(names)), similarity, words))
        if found.limit(1).count():
            many = rooted(many, components(found))
    return done.union(many.select("id", "root")).toDF("node", "root")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v), with the smallest node of its component as root.

    Up to LINKS edges are taken by one task, as each step over all tasks costs the driver jobs and their
    memory. More edges alternate large-star and small-star steps until they are stars; each step's edges are kept in
    the shared folder. Minima are pre-aggregated where the rows are, so a hub is no hot spot for them, and
    joins are of plain shuffles, so that a hub's edges can be split over tasks.
    """

    def step(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select("v", "u")) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        key = low.select(F.col("u").bitwiseXOR(F.lit(0)).alias("w"), "m")  # hides how it is dealt, so that both sides are plain shuffles, whose hot keys Spark splits
        met = both.join(key, both["u"] == key["w"]).drop("w")
        if large:
            out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    def starred(e: DataFrame) -> bool:
        """Whether every node with an edge to a smaller one has one such edge, and none to it."""
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(e.select("v", F.lit(0), F.lit(1)))
        return not ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 OR out = 1 AND in = 1").limit(1).count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
        if held:
            names, at = np.unique(np.concatenate([u for u, _ in held] + [v for _, v in held]), return_inverse=True)
            root = hooked(np.arange(len(names)), at[: len(at) // 2], at[len(at) // 2 :])
            far = np.flatnonzero(root != np.arange(len(names)))
            for i in range(0, len(far), STEP):
                yield pa.RecordBatch.from_arrays([pa.array(names[far[i : i + STEP]]), pa.array(names[root[far[i : i + STEP]]])], names=["node", "root"])

    e = cut(edges.where("u <> v"))
    links = e.count()
    if 0 < links <= LINKS:
        ship(e.sparkSession)
        out = cut(e.coalesce(1).mapInArrow(run, "node long, root long"))
        tidy(e.sparkSession)
        return out
    if links:
        while True:
            e = cut(step(cut(step(e, True)), False))
            tidy(e.sparkSession)
            if starred(e):
                break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def linked(docs: DataFrame, words: int, distance: int, similarity: float | None, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(prints, distinct, stars) of ``near_duplicates``: a row for each document, one for each different text or fingerprint, and roots of linked ones."""
    prints = cut(fingerprints(docs, words, doc_id, text, similarity is not None))
    more = [F.first(c).alias(c) for c in prints.columns if c in ("fp", "sketch", "size", "bands")]
    # Of different texts with one id, which 64 bits can't rule out, one stands for it; the others stay unlinked.
    one = F.min(F.struct("check", F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("one")
    first = F.min(F.struct("check", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"))).alias("first")
    distinct = cut(prints.groupBy("id").agg(*more, one, first, F.max("check").alias("last")))
    stars = components(trie_links(distinct.drop("first", "one", "last"), distance, similarity))
    if similarity is not None:  # so far groups of candidates
        groups = stars.select(F.col("node").alias("id"), F.col("root").alias("comp")).union(stars.select("root", "root").distinct())
        whole = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(doc_id, text).alias("row"), F.col(text).alias("text"))
        stars = exact_links(whole, distinct.select("id", "one.doc_id", "one.row", "size").join(groups, "id"), similarity, words)
    return prints, distinct, stars


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4, similarity: float | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (doc_id, row, id, fp, fingerprint, root, component_id) for each document.

    Documents link if their fingerprints, over shingles of ``words`` words, differ in at most ``distance``
    bits. With a ``similarity`` the fingerprints are over distinct words, texts that agree in a band of their
    sketch are looked at too, and documents link if besides their sets of shingles are that similar (Jaccard, exactly, of whole texts; see ``exact_links``).
    ``component_id`` is the smallest doc_id that a document reaches over links, itself included. Only
    distinct fingerprints (or texts) are joined, so thousands of copies cost as much as one.

    Texts that are null, empty or without words have fingerprint 0, linked like any other; fewer words
    than a shingle make one shingle. Rows with a null doc_id are linked too but are no component's id
    unless it has no other (then it is null). Repeated rows are kept. An empty table gives an empty result.
    """
    prints, distinct, stars = linked(docs, words, distance, similarity, doc_id, text)
    rooted = cut(distinct.join(stars, distinct["id"] == stars["node"], "left").select("id", F.col("one.check").alias("check"), F.col("first.d").alias("d"), F.coalesce("root", "id").alias("root")))
    tidy(docs.sparkSession)
    least = rooted.groupBy("root").agg(F.min("d").alias("component_id"))
    named = rooted.join(cut(least), "root").select("id", "check", "root", F.when(F.col("component_id") < (1 << 63) - 1, F.col("component_id")).alias("component_id"))
    out = prints.join(named, ["id", "check"], "left")
    root, own = F.coalesce("root", F.xxhash64("id", "check")), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "row", "id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), root.alias("root"), own.alias("component_id"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, distance: int = 7, similarity: float | None = 0.8) -> DataFrame:
    """The documents with one of each near-duplicate component: that with the smallest doc_id.

    By default documents are near-duplicates if four fifths of their five-word shingles are the same, among
    those whose SimHashes over distinct words differ in at most seven bits or that agree in a band of their sketch. Null ids come last and ties go to
    the smaller hash of the text; of rows that are equal in id and text one stays. Returns the columns of
    ``docs``.
    """
    prints, distinct, stars = linked(docs, words, distance, similarity, "doc_id", "text")
    row, kept_id, kept_row = free(docs, "_row", "_kept_id", "_kept_row")
    ranked = F.min(F.struct("none", "doc_id", "row")).alias("k")
    roots = distinct.join(stars, distinct["id"] == stars["node"], "left").select("one.*", F.coalesce("root", "id").alias("root"))
    first = roots.groupBy("root").agg(ranked).select("k.*")
    # different texts with one id: those that it doesn't stand for are groups of their own
    lone = prints.join(distinct.where(F.col("one.check") != F.col("last")).select("id", F.col("one.check").alias("own")), "id").where(F.col("check") != F.col("own"))
    lone = lone.withColumn("none", F.col("doc_id").isNull()).groupBy("id", "check").agg(ranked).select("k.*")
    keep = cut(first.union(lone).select(F.col("doc_id").alias(kept_id), F.col("row").alias(kept_row)))
    tidy(docs.sparkSession)
    marked = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    kept = marked.join(keep, (marked[row] == keep[kept_row]) & marked["doc_id"].cast("long").eqNullSafe(keep[kept_id]), "left_semi")
    return kept.dropDuplicates(["doc_id", row]).select(*[docs[c] for c in docs.columns])
