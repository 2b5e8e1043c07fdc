"""Substring dedup: repeated lines and paragraphs of sentences are found by global digests and cut out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, ship, slices, texts

#: Words that a unit has at least. Sentences and lines of fewer words come again in texts that have nothing else in common.
WORDS = 20
#: Letters of a word that count as one word more, where it is longer than any: in scripts without spaces a word is a whole sentence.
LETTERS, LONG = 8, 24
#: Units that are compared within a task before any is shuffled.
BLOCK = 1 << 18
#: A line, or a sentence of a line, with the marks that end it.
PIECE = re.compile(r"[^\n.!?。！？]+(?:[.!?]+(?![\s.!?]|$)[^\n.!?。！？]*)*[.!?。！？]*")
UNIT = "doc_id long, row long, pos long, h1 long, h2 long, kind int"
ARROW = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("pos", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("kind", pa.int32())])
#: What happens to a unit's span: undecided, cut out, kept as the first of several, or first of several in its block.
OPEN, CUT, KEEP, LED = 0, 1, 2, 3


def weight(word: str) -> int:
    """How many words a word counts as."""
    return 1 if len(word) < LONG else len(word) // LETTERS


def units(text: str, least: int = WORDS, short_lines: bool = False) -> list[tuple[int, int, bytes]]:
    """(start, end, digest) of a whole text's units, by character offsets.

    The pieces of a text are its lines, cut further into sentences. Each piece starts a unit that runs on
    until it has ``least`` words, over ends of lines too, and a shorter piece also ends one that runs back as
    far. So where a unit lies depends on its own words alone, and a passage is found in the middle of a line
    as well. A text of fewer words in all is one unit. With ``short_lines`` a line of fewer words is a
    unit as well, whatever stands around it. Units are normalised by case and white space.
    """
    import xxhash

    words: list[str] = []
    at, size, spans, lines = [0], [0], [], []  # by piece: words and their weight before it; its span; pieces that start a line
    for m in PIECE.finditer(text):
        w = m.group().lower().split()
        if w:
            a, b = m.span()
            if not spans or text.find("\n", spans[-1][1], a) >= 0:
                lines.append(len(spans))
            words += w
            at.append(len(words))
            size.append(size[-1] + sum(map(weight, w)))
            spans.append((a, b))
    n = len(spans)
    out: dict[tuple[int, int], bytes] = {}

    def add(i: int, j: int) -> None:
        out[spans[i][0], spans[j - 1][1]] = xxhash.xxh128_digest(" ".join(words[at[i] : at[j]]).encode("utf-8", "replace"))

    if n and size[n] < least:
        add(0, n)
    for i, j in zip(lines, [*lines[1:], n], strict=False) if short_lines else ():
        if size[j] - size[i] < least:
            add(i, j)
    j = 0
    for i in range(n):
        j = max(j, i + 1)
        while j < n and size[j] - size[i] < least:
            j += 1
        if size[j] - size[i] >= least:
            add(i, j)
        if size[i + 1] - size[i] < least <= size[i + 1]:
            k = i
            while size[i + 1] - size[k] < least:
                k -= 1
            add(k, i + 1)
    return [(a, b, h) for (a, b), h in out.items()]


def repeats(doc_id: np.ndarray, row: np.ndarray, pos: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (digest, rank); in it, which rows lead their digest and which repeat an earlier one's digest elsewhere.

    The rank is (doc_id, row, pos), with null ids, given as the largest number, last. The same place of
    the same document, as repeated rows have it, is neither.
    """
    order = np.lexsort((pos, row, doc_id, h2, h1))
    d, r, p, a, b = (x[order] for x in (doc_id, row, pos, h1, h2))
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    place = np.concatenate(([True], (d[1:] != d[:-1]) | (r[1:] != r[:-1]) | (p[1:] != p[:-1]))) | new
    return order, new, place & ~new & ((d != d[lead]) | (r != r[lead]) | (p != p[lead]))


NONE = np.iinfo(np.int64).max


def spans(docs: DataFrame, least: int, short_lines: bool, doc_id: str, text: str) -> DataFrame:
    """(doc_id, row, kind, pos) of spans to cut or to keep; ``row`` is a hash of id and text, ``pos`` start << 32 | end.

    Where a unit repeats one of lower rank among BLOCK units of a task, that is decided at once and the
    row only passes through. So at most one row a block and digest meets in a task, however common a unit
    is; there the first of each digest is found while rows stream by in order.
    """
    spark = docs.sparkSession
    ship(spark)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # doc_id, row, pos, digest by batch

        def decided() -> pa.RecordBatch:
            ids, rows, pos, h = (np.concatenate(x) for x in zip(*held, strict=True))
            order, new, repeat = repeats(ids, rows, pos, h[:, 0], h[:, 1])
            pick = new | repeat
            # A leader whose digest was repeated here stays whole, wherever else it occurs first.
            order, kind = order[pick], np.where(new, OPEN, CUT)[pick].astype(np.int32)
            led = np.cumsum(new[pick]) - 1
            twice = np.bincount(led)
            kind = np.where((kind == OPEN) & (twice[led] > 1), LED, kind).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[order], rows[order], pos[order], h[order, 0], h[order, 1], kind)], schema=ARROW)

        for b in slices(batches, "text", 8 << 20):
            ids, rows = b.column("doc_id").to_numpy(), b.column("row").to_numpy()
            owner, pos, digests = [], [], []
            for i, t in enumerate(texts(b.column("text"))):
                got = units(t or "", least, short_lines)
                owner += [i] * len(got)
                pos += [s << 32 | e for s, e, _ in got]
                digests += [h for *_, h in got]
            if owner:
                o = np.array(owner)
                held.append((ids[o], rows[o], np.array(pos, np.int64), np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)))
            if sum(len(x[0]) for x in held) >= BLOCK:
                yield decided()
                held.clear()
        if held:
            yield decided()

    narrow = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NONE)).alias("doc_id"), F.xxhash64(doc_id, text).alias("row"), F.col(text).alias("text"))
    found = narrow.mapInArrow(find, UNIT)
    # Decided rows are dealt out by their document, the others by their digest.
    by = F.when(F.col("kind") == CUT, F.xxhash64("row", "pos")).otherwise(F.col("h1"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = found.withColumn("by", by).repartition(n, "by").drop("by").sortWithinPartitions("h1", "h2", "doc_id", "row", "pos")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the digest at the end of the last batch and its leader: h1, h2, doc_id, row, pos
        for b in batches:
            if not b.num_rows:
                continue
            doc, row, pos, h1, h2, kind = (b.column(c).to_numpy() for c in ("doc_id", "row", "pos", "h1", "h2", "kind"))
            done = kind == CUT
            out = [(doc[done], row[done], pos[done], np.full(done.sum(), CUT))]
            doc, row, pos, h1, h2, kind = (x[~done] for x in (doc, row, pos, h1, h2, kind))
            if len(row):
                new = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
                lead = np.flatnonzero(new)[np.cumsum(new) - 1]
                first = [x[lead] for x in (doc, row, pos)]
                if last is not None and (h1[0], h2[0]) == last[:2]:
                    first = [np.where(lead == 0, x, y) for x, y in zip(last[2:], first, strict=True)]
                gone = (doc != first[0]) | (row != first[1]) | (pos != first[2])
                out.append((doc[gone], row[gone], pos[gone], np.full(gone.sum(), CUT)))
                # Leaders that are repeated, here or in their own block, are kept.
                keep = np.unique(lead[gone | (kind == LED)])
                out.append((*(x[keep] for x in first), np.full(len(keep), KEEP)))
                last = (h1[-1], h2[-1], *(x[-1] for x in first))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(k)) for x, k in zip(zip(*out, strict=True), (np.int64, np.int64, np.int64, np.int32), strict=True)], names=["doc_id", "row", "pos", "kind"])

    return dealt.mapInArrow(decide, "doc_id long, row long, pos long, kind int")


def removed(text: str, cuts: list[int], keeps: list[int]) -> list[tuple[int, int]]:
    """The spans to take out, each with the space after it: the union of ``cuts``, each without the first of its own words in ``keeps``.

    What a cut takes from other units that are kept still stands at its own first occurrence. Only where a
    unit overlaps its own repeat, as in ``a. a. a.``, the first would lose words to it.
    """
    marks = bytearray(len(text))
    words = lambda a, b: " ".join(text[a:b].lower().split())
    firsts = {words(a, b): (a, b) for a, b in ((p >> 32, p & 0xFFFFFFFF) for p in keeps)}
    for p in cuts:
        a, b = p >> 32, p & 0xFFFFFFFF
        c, d = firsts.get(words(a, b), (b, b)) if firsts else (b, b)
        for x, y in ((a, min(b, c)), (max(a, d), b)):
            if x < y:
                marks[x:y] = b"\x01" * (y - x)
    out = []
    at = marks.find(1)
    while at >= 0:
        end = marks.find(0, at)
        end = len(text) if end < 0 else end
        while end < len(text) and text[end].isspace():
            end += 1
        if any(c.isalnum() for c in text[at:end]):
            out.append((at, end))
        at = marks.find(1, end)
    return out


def drop_repeats(docs: DataFrame, least: int = WORDS, short_lines: bool = False, doc_id: str = "doc_id", text: str = "text", report: bool = True) -> DataFrame:
    """The documents without the lines and sentences that repeat an earlier ranked occurrence.

    Units are lines and sentences, taken together until they have ``least`` words (see ``units``), so a
    shorter line that many texts have stays in them, unless ``short_lines`` asks for those as well.
    Occurrences are ranked by doc_id, then by their place in the text; the first stays, and all others
    are taken out, in other documents and in its own. With ``report``, ``removed`` lists the (start, end)
    of what was taken out, in characters of the original text, and ``original_chars`` its length.

    Null texts stay null and empty texts empty; a text may become empty. Null ids come last. Rows equal in
    id and text are one document: each of them keeps and loses the same. What is no UTF-8 reads as U+FFFD.
    Other columns stay as they are, but for ``removed`` and ``original_chars``, which are replaced where
    ``report`` asks for them.
    """
    found = spans(docs, least, short_lines, doc_id, text)
    own, row, owner, at, cuts_, keeps_ = free(docs, "_own", "_row", "_owner", "_at", "_cuts", "_keeps")
    lists = found.groupBy(F.col("doc_id").alias(owner), F.col("row").alias(at)).agg(
        F.collect_set(F.when(F.col("kind") == CUT, F.col("pos"))).alias(cuts_), F.collect_set(F.when(F.col("kind") == KEEP, F.col("pos"))).alias(keeps_)
    ).where(F.size(cuts_) > 0)
    marked = docs.withColumn(row, F.xxhash64(doc_id, text)).withColumn(own, F.coalesce(F.col(doc_id).cast("long"), F.lit(NONE)))
    names = [c for c in docs.columns if not (report and c in ("removed", "original_chars"))]
    met = marked.join(lists, (marked[row] == lists[at]) & (marked[own] == lists[owner]), "left").select(*names, cuts_, keeps_)
    extra = [("removed", "array<struct<start:int,end:int>>"), ("original_chars", "int")] if report else []
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in names] + [f"{n} {k}" for n, k in extra])
    gone = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            clean, lost, sizes = [], [], []
            for t, cuts, keeps in zip(texts(b.column(text)), b.column(cuts_).to_pylist(), b.column(keeps_).to_pylist(), strict=True):
                out = removed(t, cuts, keeps or []) if t and cuts else []
                lost.append([{"start": s, "end": e} for s, e in out])
                sizes.append(None if t is None else len(t))
                if out:
                    edges = [0, *(x for s in out for x in s), len(t)]
                    t = "".join(t[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                clean.append(t)
            columns = [pa.array(clean, b.column(c).type) if c == text else b.column(c) for c in names]
            if report:
                columns += [pa.array(lost, gone), pa.array(sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=names + [n for n, _ in extra])

    return met.mapInArrow(run, schema)
