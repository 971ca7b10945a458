"""Exact token counts by dynamic programming over prefixes.

A text is cut into pieces by the tokenizer's pattern.  Inside a piece of bytes, the
last token of every prefix is found from those of shorter prefixes: a token t that
ends at i is the last one exactly if t and the last token of the prefix before it stay
apart when the two are encoded together.  So each prefix costs a few look-ups, and its
token count is one more than that of the prefix before its last token.  Counts add
up over pieces, which answers truncation ("how many bytes fit into a budget?")
and budget ("how many tokens are in the first n bytes?") questions without
encoding a text again.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space of the pieces' pattern (fixed values: the Unicode property White_Space).
WHITE = r"\t-\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: The pieces of the byte-level tokenizer (a fixed value).
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
BLANKS = rf"[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
PIECES = rf"{CONTRACTIONS}| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|{BLANKS}"
#: Letters and numbers up to U+024F, of which the same pattern can be written for the plain matcher (fixed values).
LATIN = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-" + chr(0x24F)
NUMBERS = r"0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN_PIECES = rf"{CONTRACTIONS}| ?[{LATIN}]+| ?[{NUMBERS}]+| ?[^{WHITE}{LATIN}{NUMBERS}]+|{BLANKS}"
#: Pieces whose counts a task remembers; beyond that it starts anew.
REMEMBERED = 600_000
LIMIT = 1024


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary file.

    Printable Latin-1 characters stand for themselves, the other bytes are numbered from 256 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixCounter:
    """Token counts of texts and of all their prefixes for one byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        special = [t["content"] for t in spec["added_tokens"]]
        self._special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self._tokens = {raw(t) for t in spec["model"]["vocab"] if t not in special}
        self._longest = max(map(len, self._tokens))
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self._merges = {(raw(a), raw(b)): rank for rank, (a, b) in enumerate(pairs)}
        #: How each token came about: (rank, left part, right part); single bytes have no entry.
        self._halves = {a + b: (rank, a, b) for (a, b), rank in self._merges.items()}
        self._tokens = {t for t in self._tokens if len(t) == 1 or t in self._halves}
        self._any_pieces = regex.compile(PIECES).findall
        self._latin_pieces = re.compile(LATIN_PIECES).findall
        self._beyond_latin = re.compile(f"[^{chr(0)}-{chr(0x24F)}]").search
        self._blank = regex.compile(rf"[{WHITE}]+").fullmatch
        self._apart: dict[tuple[bytes, bytes], bool] = {}
        self._counts: dict[str, int] = {}

    def _stay_apart(self, left: bytes, right: bytes) -> bool:
        """Whether two tokens are also the encoding of their concatenation.

        They are unless a merge crosses the border.  Going back in time, the later of the two
        merges beside the border is undone; at each point the border pair must not merge
        earlier than the merge just undone.  Of equal merges the left one comes first.
        """
        key = (left, right)
        known = self._apart.get(key)
        if known is not None:
            return known
        if len(self._apart) > REMEMBERED:
            self._apart.clear()
        merges, halves = self._merges, self._halves
        before = len(merges)
        while True:
            if merges.get((left, right), before) < before:
                known = False
                break
            at_left, at_right = halves.get(left), halves.get(right)
            if at_left and (not at_right or at_left[0] > at_right[0]):
                before, left = at_left[0], at_left[2]
            elif at_right:
                before, right = at_right[0] + 1, at_right[1]
            else:
                known = True
                break
        self._apart[key] = known
        return known

    def piece_prefixes(self, piece: bytes) -> list[int]:
        """The token count of each prefix of a piece, by length in bytes from 0 on."""
        counts = [0] * (len(piece) + 1)
        last: list[bytes] = [b""] * (len(piece) + 1)
        tokens, longest = self._tokens, self._longest
        for end in range(1, len(piece) + 1):
            for start in range(max(0, end - longest), end):
                token = piece[start:end]
                if token in tokens and (not start or self._stay_apart(last[start], token)):
                    last[end] = token
                    counts[end] = counts[start] + 1
                    break
        return counts

    def _pieces(self, text: str) -> list[str]:
        """The pieces of a text; Latin texts by ranges of letters, which the plain matcher knows."""
        return self._any_pieces(text) if self._beyond_latin(text) else self._latin_pieces(text)

    def _count(self, piece: str) -> int:
        counts = self._counts
        known = counts.get(piece)
        if known is None:
            if len(counts) > REMEMBERED:
                counts.clear()
            known = counts[piece] = self.piece_prefixes(piece.encode())[-1]
        return known

    def parts(self, text: str) -> Iterator[tuple[str, int]]:
        """(piece, tokens) in order; a special string is one token, as the library's default has it."""
        at = 0
        for found in self._special.finditer(text) if self._special else ():
            for piece in self._pieces(text[at : found.start()]):
                yield piece, self._count(piece)
            yield found.group(), 1
            at = found.end()
        for piece in self._pieces(text[at:] if at else text):
            yield piece, self._count(piece)

    def _counted(self, text: str) -> tuple[list[str], list[int]]:
        """(pieces, tokens) of a text without special strings."""
        pieces, known, count = self._pieces(text), self._counts.get, self._count
        return pieces, [known(p) or count(p) for p in pieces]

    def total(self, text: str) -> int:
        """The token count of a whole text."""
        return self.measure(text)[0]

    def measure(self, text: str, budget: int | None = None) -> tuple[int, int]:
        """(tokens, bytes of the longest prefix within the budget), in one pass."""
        if self._special and self._special.search(text):
            total = sum(n for _, n in self.parts(text))
            return total, self.cut(text, budget) if budget is not None and total > budget else len(text.encode())
        pieces, counts = self._counted(text)
        total = sum(counts)
        if budget is None or total <= budget:
            return total, len(text.encode())
        sums = list(accumulate(counts))
        whole = bisect_right(sums, budget)
        used = sums[whole - 1] if whole else 0
        return total, len("".join(pieces[:whole]).encode()) + self._fitting(pieces[whole], budget - used)

    def _fitting(self, piece: str, budget: int) -> int:
        """Bytes of the longest prefix of a piece, in whole characters, of at most ``budget`` tokens."""
        raw = piece.encode()
        inner = self.piece_prefixes(raw)
        return max(i for i in range(len(raw)) if inner[i] <= budget and (raw[i] & 0xC0) != 0x80)

    def prefixes(self, text: str) -> tuple[list[int], list[int]]:
        """(bytes, tokens) of every prefix that ends with a piece, from the empty one on.

        White space before a word is cut before its last character; a prefix that ends there has
        the whole run as one piece, and is counted so.
        """
        ends, totals = [0], [0]
        used, before, run = 0, 0, ""
        for piece, n in self.parts(text):
            ends.append(ends[-1] + len(piece.encode()))
            blank = self._blank(piece) is not None
            if blank and run:
                totals.append(before + self._count(run + piece))
            else:
                before = used
                totals.append(used + n)
            run = piece if blank else ""
            used += n
        return ends, totals

    def cut(self, text: str, budget: int) -> int:
        """Bytes of the longest prefix, in whole characters, of at most ``budget`` tokens.

        Pieces are those of the whole text.
        """
        at = used = 0
        for piece, n in self.parts(text):
            if used + n > budget:
                special = self._special and self._special.fullmatch(piece)
                return at if special else at + self._fitting(piece, budget - used)
            at, used = at + len(piece.encode()), used + n
        return at


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, text: str = "text", tokenizer: str = "byte_bpe_50k.json", limit: int = LIMIT) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and limit_bytes (bytes of the longest prefix within the limit).

    Null counts as empty.  Each task reads the tokenizer file where it runs; ``tokenizer`` is a
    public file's name, or a path.
    """
    docs = docs.drop("n_bytes", "n_tokens", "limit_bytes")
    schema = docs.select("*", *[F.lit(0).cast("long").alias(c) for c in ("n_bytes", "n_tokens", "limit_bytes")]).schema
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(tokenizer if "/" in tokenizer else tokenizer_path(tokenizer))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes, totals, cuts = [], [], []
                for value in part.column(place).to_pylist():
                    value = value or ""
                    sizes.append(len(value.encode()))
                    total, cut = counter.measure(value, limit)
                    totals.append(total)
                    cuts.append(cut)
                arrays = [*part.columns, *[pa.array(x, pa.int64()) for x in (sizes, totals, cuts)]]
                yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return docs.mapInArrow(run, schema)


def prefix_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """(doc_id, ends, tokens): bytes and exact token count of every prefix that ends with a piece."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(tokenizer if "/" in tokenizer else tokenizer_path(tokenizer))
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                both = [counter.prefixes(v or "") for v in part.column(1).to_pylist()]
                arrays = [part.column(0), *[pa.array([b[i] for b in both], pa.list_(pa.int64())) for i in (0, 1)]]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "ends", "tokens"])

    return rows.mapInArrow(run, f"doc_id {kind}, ends array<long>, tokens array<long>")


def tokens_before(prefixes: DataFrame, n_bytes: int) -> DataFrame:
    """Tokens of the last stored prefix of at most ``n_bytes`` bytes, from the stored table alone."""
    place = F.size(F.filter("ends", lambda e: e <= n_bytes))
    return prefixes.select("doc_id", F.element_at("tokens", place).alias("n_tokens"))


def op2(docs: DataFrame) -> DataFrame:
    """The contract's digest columns, and the bytes that fit into the limit."""
    counted = count_tokens(docs.select("doc_id", "text"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "limit_bytes")
