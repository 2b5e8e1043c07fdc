"""Benchmark decontamination: pigeonhole piece hits, verified by Myers' bit-parallel edit distance."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices, texts

#: One error is allowed for so many characters of an item.
PER_ERROR = 12
#: Items of fewer characters are held only by a text that has nothing else: they are in too many texts by chance.
TINY = 16
#: Bytes of items that one automaton holds (about forty times that in memory); more items take more passes, a block of items each.
BLOCK = 4 << 20
#: Distances that a worker remembers, for passages that many documents share.
REMEMBERED = 20_000
#: ASCII marks count as spaces.
MARKS = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)
#: First and last characters of scripts that are written without spaces between words.
UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0x20000, 0x3FFFF)]


def normal(text: str | None) -> str:
    """Lower case, marks as spaces, one space between words."""
    return " ".join((text or "").lower().encode("utf-8", "replace").translate(MARKS).decode().split())


def bordered(item: str) -> str:
    """An item with the spaces that must stand before and after it, so that it is not found within words."""
    within = lambda c: any(a <= ord(c) <= b for a, b in UNSPACED)
    return " " * (not within(item[0])) + item + " " * (not within(item[-1]))


def myers(pattern: str, text: str, most: int) -> tuple[int, int, int] | None:
    """(errors, start, end) of the part of ``text`` nearest to ``pattern`` within ``most`` errors; else None.

    Columns of the edit matrix are bit vectors of the pattern's length, so each character costs a few
    integer operations. The end is the first of the best; the start is found by running backwards from it.
    """

    def scan(p: str, t: str, anchored: bool, limit: int) -> tuple[int, int]:
        m = len(p)
        where: dict[str, int] = {}
        for i, c in enumerate(p):
            where[c] = where.get(c, 0) | 1 << i
        full, high = (1 << m) - 1, 1 << m - 1
        vp, vn, score = full, 0, m
        best, end = m, 0
        for j, c in enumerate(t, 1):
            eq = where.get(c, 0)
            d0 = (((eq & vp) + vp) ^ vp | eq | vn) & full
            hp, hn = vn | full & ~(d0 | vp), d0 & vp
            score += bool(hp & high) - bool(hn & high)
            hp = (hp << 1 | anchored) & full
            hn = hn << 1 & full
            vp, vn = hn | full & ~(d0 | hp), d0 & hp
            if score < best:
                best, end = score, j
            if score - len(t) + j > limit:  # it falls by one a character at most
                break
        return best, end

    errors, end = scan(pattern, text, False, most)
    if errors > most:
        return None
    _, back = scan(pattern[::-1], text[:end][::-1], True, errors)
    return errors, end - back, end


class Matcher:
    """Finds items within their error budgets: an item of budget e is cut into e + 1 pieces, one of which must occur unharmed."""

    def __init__(self, items: list[tuple[int, str]], per_error: int):
        import ahocorasick

        named = [(i, p) for i, p in ((i, normal(t)) for i, t in items) if p]
        self.tiny: dict[str, list[int]] = {}
        for i, p in named:
            if len(p) < TINY:
                self.tiny.setdefault(p, []).append(i)
        self.items = [(i, bordered(p), len(p) // per_error) for i, p in named if len(p) >= TINY]
        self.tree, owners = ahocorasick.Automaton(), {}
        for at, (_, p, budget) in enumerate(self.items):
            cuts = [round(j * len(p) / (budget + 1)) for j in range(budget + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                owners.setdefault(p[a:b], []).append((at, a))
        for piece, own in owners.items():
            self.tree.add_word(piece, (len(piece), own))
        if owners:
            self.tree.make_automaton()
        self.known: dict[tuple[int, str], tuple[int, int, int] | None] = {}

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, errors, start, end) of the best occurrence of each item in the normalised text."""
        t = normal(text)
        if not t:
            return []
        whole = [(i, 0, 0, len(t)) for i in self.tiny.get(t, ())]
        if not self.items:
            return sorted(whole)
        t = f" {t} "
        best: dict[int, tuple[int, int, int]] = {}
        looked: dict[int, int] = {}
        for end, (n, own) in self.tree.iter(t):
            for at, offset in own:
                _, p, budget = self.items[at]
                begin = end - n + 1 - offset  # where the item would start
                if (got := best.get(at)) and not got[0] or looked.get(at) == begin:
                    continue
                looked[at] = begin
                lo, hi = max(0, begin - budget), begin + len(p) + budget
                window = t[lo:hi]
                key = (at, window)
                if key not in self.known:
                    if len(self.known) >= REMEMBERED:
                        self.known.clear()
                    self.known[key] = (0, window.index(p), window.index(p) + len(p)) if p in window else myers(p, window, budget)
                hit = self.known[key]
                if hit and (got is None or hit[0] < got[0]):
                    best[at] = (hit[0], lo + hit[1], lo + hit[2])
        # Offsets are those of the text without the spaces put around it and around the item.
        found = [(self.items[at][0], e, a + (t[a] == " ") - 1, b - (t[b - 1] == " ") - 1) for at, (e, a, b) in best.items()]
        return sorted(whole + found)


def blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The distinct items in blocks of about BLOCK bytes, each of which fits the driver and every executor."""
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.make_valid_utf8(F.col(text)).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n = max(1, -(-size // BLOCK))
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect()
        yield sorted((r["i"], r["t"]) for r in rows)


def find_items(docs: DataFrame, benchmark: DataFrame, per_error: int = PER_ERROR, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, errors, start, end) for each document and each benchmark item it holds.

    An item is held if a part of the document's text differs from it by at most one error (a character
    put in, left out or changed) for ``per_error`` characters, both normalised by case, marks and white
    space. An item starts and ends where words do (a missing border is an error as well), but for scripts
    written without spaces. Offsets are characters of the normalised text. Whole texts are searched; of
    several occurrences the one with the fewest errors, then the first found, is given. Items of less than
    TINY characters are held only by texts that are nothing else.

    Null and empty texts hold nothing, what is no UTF-8 reads as U+FFFD, and items that are null or have no words are in nothing. Repeated
    documents give a row each; other columns are left out.
    """
    spark = docs.sparkSession
    ship(spark)
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, item_id long, errors int, start int, end int"
    out = None
    for items in blocks(benchmark, item_id, item_text):
        sent = spark.sparkContext.broadcast((items, per_error))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            m = Matcher(*sent.value)
            kinds = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("errors", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
            for b in slices(batches, "text"):
                got = [(i, *hit) for i, t in zip(b.column("doc_id").to_pylist(), texts(b.column("text")), strict=True) for hit in m.find(t)]
                yield pa.RecordBatch.from_arrays([pa.array([g[j] for g in got], f.type) for j, f in enumerate(kinds)], schema=kinds)

        found = narrow.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, per_error: int = PER_ERROR, text: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, with the columns they came with; nothing is shuffled."""
    spark = docs.sparkSession
    ship(spark)
    for items in blocks(benchmark, "item_id", "text"):
        sent = spark.sparkContext.broadcast((items, per_error))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            m = Matcher(*sent.value)
            for b in slices(batches, text):
                yield b.filter(pa.array([not m.find(t) for t in texts(b.column(text))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
