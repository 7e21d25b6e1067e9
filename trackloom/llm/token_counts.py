"""Edit-aware token counts with pre-token segment trees, kept per document.

``TokenTree`` cuts a text into pre-tokens (the pieces byte-level BPE never merges across), counts
each one's tokens, and keeps lengths and counts in the leaves of a segment tree whose inner nodes hold
the sums of their subtrees. An edit re-encodes only the leaves it touches: from the last
boundary that the edit can't have moved, until a new boundary falls on an old one behind the edit;
from there on both texts are cut alike. Only the sums above replaced leaves are computed again.

``trees`` makes every document's tree, as a table that can be kept: two numbers a pre-token, and its sums come back by
addition. ``apply_edits`` takes such a table, in a later run too, applies each document's edits without encoding
anything of the old text but what they touch, and gives texts and trees as they are now, to be kept in turn, with the counts
before and after and how much was encoded. ``edited`` does both at once; ``count`` gives the tokens alone.

Vocabularies are read from the folder ``folder`` on every executor.

Defined cases: a null text is empty and has no tokens; edits are applied in order, each to the text
the ones before it left; positions are code points and are clipped to the text; a null replacement
is empty; repeated rows are counted each; texts of any length, with or without white space, are whole (a pre-token is
encoded in one piece, however long); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: How byte-level BPE cuts a text into pre-tokens. Fixed value: counts must equal the tokenizer's.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A pre-token's end depends on no more than so many characters behind it.
LOOK = 3
#: Pre-tokens in a leaf.
LEAF = 32
#: Distinct pre-tokens whose counts a worker remembers.
REMEMBERED = 1 << 18


class Encoder:
    def __init__(self, folder: str, vocabulary: str) -> None:
        import tiktoken

        with open(os.path.join(folder, vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for p in set(pieces).difference(known):
            known[p] = len(self.encoding.encode_ordinary(p))
        return [known[p] for p in pieces]


@lru_cache(2)
def encoder(folder: str, vocabulary: str) -> Encoder:
    return Encoder(folder, vocabulary)


class TokenTree:
    """chars, tokens: one heap each; node 1 is the whole text, leaf k is node ``size`` + k."""

    def __init__(self, text: str, enc: Encoder) -> None:
        self.enc, self.text = enc, text
        self.encoded = 0
        self._build(self._encode(text))

    @classmethod
    def of(cls, text: str, saved: bytes, enc: Encoder) -> TokenTree:
        """The tree of a text as ``saved`` has it: nothing is encoded."""
        tree = cls.__new__(cls)
        tree.enc, tree.text, tree.encoded = enc, text, 0
        kind = np.uint8 if saved[:1] == b"1" else np.uint32
        chars, tokens = np.frombuffer(saved[1:], kind).reshape(2, -1).tolist()
        tree._build(list(zip(chars, tokens, strict=True)))
        return tree

    def saved(self) -> bytes:
        """Lengths and counts of all pre-tokens, a byte each if they all fit one."""
        pieces = np.array([p for leaf in self.leaves for p in leaf], np.uint32).reshape(-1, 2).T
        small = not pieces.size or int(pieces.max()) < 256
        return (b"1" if small else b"4") + pieces.astype(np.uint8 if small else np.uint32).tobytes()

    def _encode(self, text: str) -> list[tuple[int, int]]:
        pieces = self.enc.cut.findall(text)
        return list(zip(map(len, pieces), self.enc.counts(pieces), strict=True))

    def _build(self, pieces: list[tuple[int, int]]) -> None:
        leaves = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self.size = 1 << (len(leaves) - 1).bit_length()
        self.leaves = leaves + [[] for _ in range(self.size - len(leaves))]
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for k, leaf in enumerate(self.leaves):
            self.chars[self.size + k] = sum(n for n, _ in leaf)
            self.tokens[self.size + k] = sum(t for _, t in leaf)
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf with the character ``place`` (the last one with text if there is none) and where it starts."""
        node, start = 1, 0
        place = min(place, self.chars[1] - 1)
        while node < self.size:
            node *= 2
            if place >= start + self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - self.size, start

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replace the characters [start, end)."""
        n = len(self.text)
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        new = self.text[:start] + replacement + self.text[end:]
        if not self.text:
            self.text = new
            self.encoded += len(new)
            return self._build(self._encode(new))
        first, at = self._leaf_at(max(0, start - LOOK - 1))
        # The first pre-token that ends near the edit or behind its start, and what stands before it in the leaf.
        head = []
        for piece in self.leaves[first]:
            if at + piece[0] > start - LOOK:
                break
            head.append(piece)
            at += piece[0]
        # Old boundaries behind the edit, walked along with the new ones.
        shift, fresh, last, offset = len(new) - n, [], first, len(head)
        old = at
        here = at
        while here < len(new):
            m = self.enc.cut.match(new, here)
            fresh.append(m[0])
            here = m.end()
            if here >= start + len(replacement):
                while old < here - shift and last < self.size:
                    if offset < len(self.leaves[last]):
                        old += self.leaves[last][offset][0]
                        offset += 1
                    else:
                        last, offset = last + 1, 0
                if old == here - shift and old >= end:
                    break
        else:
            last, offset = self.size - 1, len(self.leaves[-1])
        self.text = new
        self.encoded += sum(map(len, fresh))
        tail = self.leaves[last][offset:] if last < self.size else []
        last = min(last, self.size - 1)
        pieces = head + list(zip(map(len, fresh), self.enc.counts(fresh), strict=True)) + tail
        if len(pieces) > 8 * LEAF * (last - first + 1):
            kept = [p for leaf in self.leaves[:first] for p in leaf] + pieces + [p for leaf in self.leaves[last + 1 :] for p in leaf]
            return self._build(kept)
        # The places of the leaves stay; what they hold is dealt anew among those that were touched.
        share = -(-len(pieces) // (last - first + 1)) or 1
        for k in range(first, last + 1):
            leaf = self.leaves[k] = pieces[(k - first) * share : (k - first + 1) * share]
            self.chars[self.size + k] = sum(c for c, _ in leaf)
            self.tokens[self.size + k] = sum(t for _, t in leaf)
        low, high = (self.size + first) // 2, (self.size + last) // 2
        while low:
            for i in range(low, high + 1):
                self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
                self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            low, high = low // 2, high // 2
        return None


def count(documents: DataFrame, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens."""

    @F.pandas_udf("long")
    def tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(folder, vocabulary)
        for s in texts:
            yield pd.Series([sum(enc.counts(enc.cut.findall(x))) if x else 0 for x in s], dtype="int64")

    return documents.select("doc_id", tokens(F.col("text")).alias("n_tokens"))


def trees(documents: DataFrame, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """The documents with ``tree`` (binary, see ``TokenTree.saved``) and ``n_tokens``."""

    @F.pandas_udf("tree binary, n_tokens long")
    def build(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = encoder(folder, vocabulary)

        def saved(text: str | None) -> tuple[bytes, int]:
            tree = TokenTree(text or "", enc)
            return tree.saved(), tree.total

        for s in texts:
            # One tree at a time: only what is saved of it stays.
            yield pd.DataFrame([saved(x) for x in s], columns=["tree", "n_tokens"])

    name = fresh(documents, "_tc")
    others = [c for c in documents.columns if c not in ("tree", "n_tokens")]
    return documents.withColumn(name, build(F.col("text"))).select(*others, f"{name}.tree", f"{name}.n_tokens")


def apply_edits(kept: DataFrame, edits: Column, folder: str = FOLDER, vocabulary: str = VOCABULARY, keep: bool = True) -> DataFrame:
    """doc_id, text and tree after the edits, n_tokens (before), n_tokens_edited, n_chars_edited, n_encoded (characters encoded for the edits).

    kept: what ``trees``, or this function, gave: doc_id, text, tree. edits: each row's edits, an array of structs (start, end, replacement); null: none.
    keep: false leaves out text and tree.
    """
    out = {"text": "string", "tree": "binary"} if keep else {}
    out |= dict.fromkeys(("n_tokens", "n_tokens_edited", "n_chars_edited", "n_encoded"), "long")

    @F.pandas_udf(", ".join(map(" ".join, out.items())))
    def change(frames: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        enc = encoder(folder, vocabulary)
        for texts, saved, changes in frames:
            rows = []
            for text, blob, own in zip(texts, saved, changes, strict=True):
                tree = TokenTree.of(text or "", bytes(blob), enc)
                before = tree.total
                for e in own if own is not None else ():
                    tree.edit(int(e["start"]), int(e["end"]), e["replacement"] or "")
                rows.append((*((tree.text, tree.saved()) if keep else ()), before, tree.total, len(tree.text), tree.encoded))
            yield pd.DataFrame(rows, columns=list(out))

    return kept.select("doc_id", change(F.col("text"), F.col("tree"), edits).alias("x")).select("doc_id", "x.*")


def edited(documents: DataFrame, edits: Column, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, n_tokens_edited, n_chars_edited, n_encoded: the edits applied to the documents' new trees."""
    kept = trees(documents.select("doc_id", "text", edits.alias("edits")), folder, vocabulary)
    return apply_edits(kept, F.col("edits"), folder, vocabulary, keep=False)


def sample_edits() -> Column:
    """Two edits a document, at places that depend on its id: 24 code points replaced, then a phrase put in."""
    chars = F.coalesce(F.length("text"), F.lit(0))
    place = lambda seed: F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.greatest(chars, F.lit(1))).cast("int")
    edit = lambda seed, cut, said: F.struct(place(seed).alias("start"), (place(seed) + cut).alias("end"), F.lit(said).alias("replacement"))
    return F.array(edit(1, 24, " revised 2 times,"), edit(2, 0, " see also: the note's end\n"))
