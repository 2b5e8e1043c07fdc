"""Token counts by the whole-token shortcut."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices, texts

#: How a byte-level tokenizer cuts a text into pre-tokens (``\s`` is Unicode's White_Space).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Counts that a worker remembers besides the whole tokens; then it forgets them and starts again.
REMEMBERED = 200_000


def byte_letters() -> list[str]:
    """The letter for each byte in a byte-level vocabulary: printable bytes stand for themselves, the rest follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def check(spec: dict) -> None:
    """Raises unless a tokenizer file is byte-level BPE as ``Counter`` counts it; any other would be counted wrongly without a sign."""
    model, pre = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
    wrong = [
        f"normalizer {spec['normalizer'].get('type')}" if spec.get("normalizer") else "",
        f"model {model.get('type')}" if model.get("type", "BPE") != "BPE" else "",
        f"pre-tokenizer {pre.get('type')}" if pre.get("type") != "ByteLevel" else "",
        "add_prefix_space" if pre.get("add_prefix_space") else "",
        "use_regex off" if not pre.get("use_regex", True) else "",
        *[k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)],
        *[f"added token {t['content']!r} that takes spaces or parts of words" for t in spec.get("added_tokens") or [] if t.get("lstrip") or t.get("rstrip") or t.get("single_word") or (t.get("normalized") and not t.get("special"))],
    ]
    if any(wrong):
        raise ValueError(f"no plain byte-level BPE file: {', '.join(w for w in wrong if w)}")


class Counter:
    """Counts tokens of texts for one byte-level BPE file; ``whole`` holds the strings proven to be one token."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            check(json.load(f))
        tok = Tokenizer.from_file(path)
        self.letters = byte_letters()
        back = {c: b for b, c in enumerate(self.letters)}
        self.model = tok.model
        self.specials = sorted((t.content for t in tok.get_added_tokens_decoder().values()), key=lambda s: (-len(s), s))
        self.at_special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.find = regex.compile(PRE_TOKEN).findall
        self.whole: dict[str, int] = {}
        for token in tok.get_vocab(with_added_tokens=False):
            if all(c in back for c in token) and len(self.model.tokenize(token)) == 1:
                try:
                    self.whole[bytes(back[c] for c in token).decode()] = 1
                except UnicodeDecodeError:
                    continue  # part of a character: no pre-token is this alone
        self.known = dict(self.whole)

    def merge(self, pre: str) -> int:
        """Tokens of a pre-token that is not a whole token, by the vocabulary's merges."""
        letters = self.letters
        n = len(self.model.tokenize("".join([letters[b] for b in pre.encode("utf-8", "replace")])))
        if len(pre) <= 64:
            if len(self.known) > REMEMBERED + len(self.whole):
                self.known = dict(self.whole)
            self.known[pre] = n
        return n

    def count(self, text: str) -> int:
        n = 0
        if self.at_special is not None and any(s in text for s in self.specials):
            parts = self.at_special.split(text)
            n = len(parts) - 1
        else:
            parts = [text]
        for part in parts:
            get = self.known.get
            for pre in self.find(part):
                n += get(pre) or self.merge(pre)
        return n


_made: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _made:
        _made[path] = Counter(path)
    return _made[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Bytes and tokens of every text, as the tokenizer file at ``path`` gives them without added tokens.

    ``path`` must be readable on every executor (the files come with the library). Strings of special
    tokens inside a text count as that one token, as the library's default has it. A file that is not plain
    byte-level BPE is a ValueError. A null text is empty: 0 bytes, 0 tokens. What is no UTF-8 reads as U+FFFD. Each input row gives one row, repeated rows too; other columns are left out.
    """
    ship(docs.sparkSession)
    with open(path, encoding="utf-8") as f:
        check(json.load(f))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in slices(batches, "text"):
            whole = [t or "" for t in texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(t.encode()) for t in whole], pa.int64()), pa.array([c.count(t) for t in whole], pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
