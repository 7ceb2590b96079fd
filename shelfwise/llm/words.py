"""Token ids of whole texts by a word-level tokenizer of the tokenizers library, with a bounded memory of words.

The tokenizer drops white space and never joins characters across it, so a text's ids are those of its runs between
spaces and line ends, one after another. Runs are encoded in batches, each distinct one once while it is remembered. A text
with the string of a special token is encoded whole and alone, so the string is that token, as the library has it.
"""

from __future__ import annotations

import os

import numpy as np

from .common import remembered

#: Runs that a Python worker remembers unless told otherwise (about 180 bytes each); beyond, it starts afresh. More of
#: them save time. Longer runs than LONGEST are never kept.
REMEMBERED, LONGEST = 1_200_000, 200
#: New runs encoded in one call, with a digit between them: the tokenizer makes each digit a token of its own.
TOGETHER = 256
#: Characters before this one have no other composed form and lower-case one by one; such runs need no normalizer.
LATIN = "\u0250"


class WordIds:
    def __init__(self, path: str, most: int = REMEMBERED):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.most, self.tokenizer = most, Tokenizer.from_file(path)
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = Tokenizer.from_file(path)
        self.normalizer, self.tokenizer.normalizer = self.tokenizer.normalizer, None  # set back for runs that need it
        self.zero = self.tokenizer.encode("0", add_special_tokens=False).ids[0]
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        alone = {i for i, t in enumerate(texts) if "|>" in t and any(s in t.lower() for s in self.special)}
        runs = [[] if i in alone else t.replace("\n", " ").split(" ") for i, t in enumerate(texts)]
        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        new: set[str] = set()
        for r in runs:
            new.update(set(r).difference(known))
        self.learn(new)
        out = [b"".join(map(known.__getitem__, r)) for r in runs]
        for i in alone:
            out[i] = np.asarray(self.plain.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes()
        for w in [w for w in known.keys() & new if len(w) > LONGEST]:
            del known[w]
        return out

    def learn(self, new: set[str]) -> None:
        latin = [w for w in new if w.isascii() or max(w) < LATIN]
        self.together(latin, [w.lower() for w in latin])
        other = [w for w in new if not w.isascii() and max(w) >= LATIN]
        if other:
            self.tokenizer.normalizer = self.normalizer
            self.together(other, other)
            self.tokenizer.normalizer = None

    def together(self, runs: list[str], texts: list[str]) -> None:
        """Encodes texts of runs, many in a call; those with the digit that parts them are alone."""
        tokenizer = self.tokenizer
        odd = {i for i, t in enumerate(texts) if "0" in t}
        for i in odd:
            self.known[runs[i]] = np.asarray(tokenizer.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes()
        if odd:
            runs, texts = ([x for i, x in enumerate(xs) if i not in odd] for xs in (runs, texts))
        starts = range(0, len(runs), TOGETHER)
        for i, e in zip(starts, tokenizer.encode_batch_fast([" 0 ".join(texts[i : i + TOGETHER]) for i in starts], add_special_tokens=False), strict=True):
            ids = np.asarray(e.ids, "<u4")
            cuts = 4 * np.flatnonzero(ids == self.zero)
            raw = ids.tobytes()
            self.known.update(zip(runs[i : i + TOGETHER], [raw[a:b] for a, b in zip([0, *(cuts + 4).tolist()], [*cuts.tolist(), len(raw)], strict=True)], strict=True))


@remembered("words")
def word_ids(path: str, most: int = REMEMBERED) -> WordIds:
    """One for each Python worker, until it runs tasks of another kind."""
    return WordIds(path, most)
