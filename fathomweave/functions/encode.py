"""Whole texts to token ids with a public tokenizer, at the speed of a dictionary for words seen before.

A byte-level BPE of this family splits a text before it merges anything, and a split always lies where a
run of white space begins and between a letter or digit and a punctuation mark after it. So a text is cut
there, each piece is encoded by the tokenizers library once, and later sights of the piece take its ids
from a bounded cache. A piece that is one plain word is merged by the model at once, without the library's search for marks and
its record of places. Texts with white space other than blank,
newline, tab and carriage return are handed to the library whole, as are files whose rules are not these.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate, compress, count
from operator import not_

import numpy as np

from fathomweave.runtime import held

#: White space, then a word up to a mark that follows it at once, or all up to the next white space.
PIECE = re.compile("[ \n\t\r]*(?:[A-Za-z0-9\xc0-\xd6\xd8-\xf6\xf8-\u024f]++(?:(?=[.,;:!?%*$&#])|[^ \n\t\r]*)|[^ \n\t\r]+)|[ \n\t\r]+")
ODD_SPACE = re.compile(r"[^\S \n\t\r]")
#: The characters of ODD_SPACE; each is looked for by itself, which is faster than a pattern.
ODD = [c for c in map(chr, range(0x3001)) if ODD_SPACE.match(c)]
#: One word of the letters of PIECE, which no rule splits.
PLAIN = re.compile(" ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+")
#: The letter that stands for each byte: itself where it is printed, else one from 256 on.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTERS = "".join(chr(b) if b in PRINTED else chr(256 + sum(x not in PRINTED for x in range(b))) for b in range(256))
LONGEST_KEPT = 64
JOINED = 256
ID_TYPE = np.dtype("<u4")


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def pack(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return np.array(ids, ID_TYPE).tobytes() if array("I").itemsize != 4 or sys.byteorder != "little" else array("I", ids).tobytes()


def shared_encoder(path: str, cache: int = 1_000_000) -> Encoder:
    """The encoder of this Python worker, with what its cache holds from earlier tasks."""
    return held(("encoder", path, cache), lambda: Encoder(path, cache))


class Encoder:
    """Encodes with ``path``; about ``cache`` pieces are kept: when half of them are new, those not seen since go."""

    def __init__(self, path: str, cache: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        added = rules.get("added_tokens") or []
        split = rules.get("pre_tokenizer") or {}
        self.pieces = (
            rules.get("normalizer") is None and rules.get("post_processor") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
            and not any(a.get("lstrip") or a.get("rstrip") or a.get("single_word") or re.search(r"\s", a["content"]) for a in added)
        )
        marks = [(a["content"], a["id"]) for a in added if a.get("special") and not a.get("normalized")]
        self.mark = marks[0] if self.pieces and marks else None
        model = rules["model"]
        self.words = self.pieces and model.get("type") == "BPE" and not model.get("dropout") and not any(PLAIN.fullmatch(a["content"]) for a in added)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.counts: dict[str, int] = {}
        self.limit = cache

    def _library(self, texts: list[str]) -> list[bytes]:
        return [pack(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _unseen(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece, which is such as PIECE finds."""
        if not self.words:
            return self._joined(pieces)
        plain, merged = PLAIN.fullmatch, self.tokenizer.model.tokenize
        done = [pack([t.id for t in merged(p.encode().decode("latin-1").translate(LETTERS))]) if plain(p) else None for p in pieces]
        others = iter(self._joined([p for p, x in zip(pieces, done, strict=True) if x is None]))
        return [next(others) if x is None else x for x in done]

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece: many in one text, with the file's own end mark between them, which no merge crosses."""
        if self.mark is None:
            return self._library(pieces)
        word, number = self.mark
        done = []
        for at in range(0, len(pieces), JOINED):
            some = pieces[at : at + JOINED]
            ids = np.frombuffer(self._library([word.join(some)])[0], ID_TYPE)
            cuts = np.flatnonzero(ids == number)
            if len(cuts) != len(some) - 1:  # a piece has the mark in it
                done += self._library(some)
                continue
            raw, starts = ids.tobytes(), [0, *((cuts + 1) * 4).tolist()]
            done += [raw[a:b] for a, b in zip(starts, [*(cuts * 4).tolist(), len(raw)], strict=True)]
        return done

    def encode(self, text: str | None) -> bytes:
        """The ids of the whole text as little-endian unsigned 32-bit integers; nothing for null."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; what the cache lacks goes to the library in one call for all."""
        done, waiting, missing, known = [b""] * len(texts), [], {}, self.cache.get
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.pieces or any(map(text.__contains__, ODD)):
                done[i] = self._library([text])[0]
                continue
            pieces = PIECE.findall(text)
            ids = list(map(known, pieces))
            gaps = list(compress(count(), map(not_, ids)))
            if gaps:
                missing.update(dict.fromkeys(map(pieces.__getitem__, gaps)))
                waiting.append((i, pieces, ids, gaps))
            else:
                done[i] = b"".join(ids)
        if missing:
            new = {p: x for p in missing if (x := self.older.get(p)) is not None}
            unseen = [p for p in missing if p not in new]
            new.update(zip(unseen, self._unseen(unseen), strict=True))
            for i, pieces, ids, gaps in waiting:
                for k in gaps:
                    ids[k] = new[pieces[k]]
                done[i] = b"".join(ids)
            if 2 * (len(self.cache) + len(new)) > self.limit:
                self.older, self.cache = self.cache, {}
            self.cache.update(new)
            for p in [p for p in new if len(p) > LONGEST_KEPT]:
                del self.cache[p]
        return done

    def sizes(self, pieces: list[str]) -> list[int]:
        """How many ids each of ``pieces`` has, which are such as PIECE finds."""
        missing = [p for p in dict.fromkeys(pieces) if p not in self.counts]
        if missing:
            if len(self.counts) + len(missing) > self.limit:
                self.counts = {}
                missing = list(dict.fromkeys(pieces))
            self.counts.update(zip(missing, (len(x) // 4 for x in self._unseen(missing)), strict=True))
        found = list(map(self.counts.__getitem__, pieces))
        for p in [p for p in missing if len(p) > LONGEST_KEPT]:
            del self.counts[p]
        return found

    def between(self, text: str) -> Callable[[int, int], int]:
        """Counts the ids of parts of ``text`` (start, end), each part as if it were a text of its own.

        The pieces of the whole text are counted once; a part that begins or ends within a piece takes that end by itself.
        """
        if not self.pieces or ODD_SPACE.search(text):
            return lambda lo, hi: len(self.tokenizer.encode(text[lo:hi], add_special_tokens=False).ids)
        pieces = PIECE.findall(text)
        cuts, sums = [0, *accumulate(map(len, pieces))], [0, *accumulate(self.sizes(pieces))]

        def count(lo: int, hi: int) -> int:
            first, last = bisect_left(cuts, lo), bisect_right(cuts, hi) - 1
            if first > last:
                return sum(self.sizes(PIECE.findall(text[lo:hi])))
            ends = PIECE.findall(text[lo : cuts[first]]) + PIECE.findall(text[cuts[last] : hi])
            return sums[last] - sums[first] + sum(self.sizes(ends))

        return count

    def stream(self, column, group: int = 1 << 20) -> Iterator[bytes]:
        """The ids of each text of an Arrow column, encoded in groups of about ``group`` letters."""
        texts, size = [], 0
        for cell in column:
            texts.append(cell.as_py())
            size += len(texts[-1] or "")
            if size >= group:
                yield from self.encode_all(texts)
                texts, size = [], 0
        yield from self.encode_all(texts)
