"""Token ids of whole texts by the tokenizers library, which encodes each different blank-delimited piece once.

Vocabularies split a text before their merges, and no split joins a non-blank character with a following blank. So a
text may be cut in front of every blank whose left neighbour isn't white space, and the ids of the cuts, put in a row,
are the ids of the text. A text with an added token of the vocabulary, such as ``<|endoftext|>``, is encoded whole. A worker remembers the ids of a bounded number of pieces.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Pieces that a worker remembers before it starts anew, and pieces that go to the library in one string.
REMEMBERED, JOINED = 1_000_000, 200
#: White space in front of a blank or line feed: such a text is encoded whole.
UNEVEN = re.compile(r"\s[ \n]")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; an absolute path is taken as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """``encode(texts)``: per text the ids as little-endian unsigned 32-bit bytes, the end id last.

    Two kinds of vocabulary: those that keep white space (byte-level) and those that drop it (with word ends).
    ``split_added`` takes added tokens in a text as any other characters; without it, they are found as the library does by default.
    """

    def __init__(self, name: str, end: int = 2, remembered: int = REMEMBERED, split_added: bool = True):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(vocabulary(name))
        self.tokenizer.encode_special_tokens = split_added
        added = [] if split_added else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None  # normalizers may change case
        self.end = np.array([end], "<u4").tobytes()
        self.remembered, self.known = remembered, {}
        self.suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None) or ""
        self.drops_blanks = bool(self.suffix)
        size = {i: len(t.removesuffix(self.suffix) if self.suffix else t) for t, i in self.tokenizer.get_vocab().items()}
        self.token_bytes = np.array([size.get(i, 0) for i in range(max(size) + 1)], np.int64)

    @property
    def largest_id(self) -> int:
        return len(self.token_bytes) - 1

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, text: str) -> list[str] | None:
        """Cuts of a text, or None if it must be encoded whole. A piece stands for itself after one blank."""
        if self.added and self.added.search(text):
            return None
        if self.drops_blanks:
            return text.replace("\n", " ").split(" ")
        if not text or text[-1].isspace() or text[0] == "\n" or UNEVEN.search(text):
            return None
        return text.replace("\n", " \n").split(" ")

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces in strings of some hundred, and cut the ids where the bytes of the pieces end."""
        if self.drops_blanks:  # other white space inside a piece, or none at all, would shift the pieces of a string
            odd = [p for p in pieces if p.split() != [p]]
            self.known.update(zip(odd, self._whole(odd)))
            pieces = [p for p in pieces if p not in self.known]
            glue, strings = " ", pieces
        else:
            glue, strings = "", [p if p[:1] == "\n" else " " + p for p in pieces]
        groups = [strings[i:i + JOINED] for i in range(0, len(strings), JOINED)]
        encodings = self.tokenizer.encode_batch_fast([glue.join(g) for g in groups], add_special_tokens=False)
        for k, (group, encoding) in enumerate(zip(groups, encodings)):
            ids = np.array(encoding.ids, "<u4")
            shown = group
            if self.drops_blanks:
                shown = self.tokenizer.normalizer.normalize_str(glue.join(group)).split(" ")
            sizes = np.array([len(s.encode()) for s in shown], np.int64)
            ends = np.cumsum(self.token_bytes[ids])
            cuts = np.searchsorted(ends, np.cumsum(sizes))
            exact = len(shown) == len(group) and len(ids) > 0 and sizes.all() and int(ends[-1]) == int(sizes.sum()) \
                and bool((ends[cuts] == np.cumsum(sizes)).all())
            if exact:
                data, at = ids.tobytes(), [0, *((cuts + 1) * 4).tolist()]
                parts = [data[a:b] for a, b in zip(at, at[1:])]
            else:
                parts = self._whole(group)
            for piece, part in zip(pieces[k * JOINED:(k + 1) * JOINED], parts):
                self.known[piece] = part

    def encode(self, texts: list[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        cuts = [self._pieces(t) for t in texts]
        first = {}
        if not self.drops_blanks:  # the first piece of a text has no blank in front
            heads = list(dict.fromkeys(c[0] for c in cuts if c is not None))
            first = dict(zip(heads, self._whole(heads)))
        get = self.known.get
        found = [None if c is None else list(map(get, c if self.drops_blanks else c[1:])) for c in cuts]
        missing = set()
        for c, values in zip(cuts, found):
            if values is not None and None in values:
                missing.update([p for p, v in zip(c if self.drops_blanks else c[1:], values) if v is None])
        if len(missing) + len(self.known) > self.remembered:
            self.known = {}
        self._learn(list(missing))
        known, out = self.known, []
        odd = iter(self._whole([t for t, c in zip(texts, cuts) if c is None]))
        for c, values in zip(cuts, found):
            if c is None:
                out.append(next(odd) + self.end)
                continue
            if None in values:
                values = [known[p] if v is None else v for p, v in zip(c if self.drops_blanks else c[1:], values)]
            out.append((b"" if self.drops_blanks else first[c[0]]) + b"".join(values) + self.end)
        return out


_encoders: dict[tuple, Encoder] = {}


def encoder(name: str, end: int = 2) -> Encoder:
    """The worker's encoder of this vocabulary, with the library's ids."""
    if (name, end) not in _encoders:
        _encoders[name, end] = Encoder(name, end, split_added=False)
    return _encoders[name, end]


def batches(texts: list, bytes_at_once: int = 4 << 20):
    """Index ranges of texts of about so many characters, so that few pieces are held at once."""
    start = total = 0
    for i, text in enumerate(texts):
        total += len(text or "")
        if total >= bytes_at_once:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
