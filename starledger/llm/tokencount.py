"""Token counts by a compiled finite-state tokenizer (operator 9).

A BPE encoding is the one sequence of valid pieces in which each adjacent
pair is *compatible* (encoding the two pieces together gives them back).  So
the last piece of the encoding of every prefix follows from the last pieces
of shorter prefixes, and only those prefixes matter from which a piece may
still be running.  That makes a deterministic transducer:

* a state is the longest suffix of the text that begins some piece, with the
  last piece at each prefix end inside it;
* a transition reads one character and is annotated with the change of the
  number of emitted tokens.

States and transitions are compiled when first met.  Between two characters
that no piece holds side by side the transducer is back in its start state.
A chunk's state map is therefore its text up to the first such point (what
it does depends on the state at entry), a count for the closed middle, and
the text after the last such point.  The maps of a text's chunks compose by
a scan in log2(chunks) rounds.

Defined results: null text counts as ''; characters without a piece count as
their UTF-8 bytes (byte fallback); strings that look like control pieces are
ordinary text; an empty table gives an empty frame; repeated rows give
repeated rows; other columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starledger.llm.common import text_or_empty

SPACE = "▁"
OUT = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


class State(dict):
    """A transducer state: ``self[char]`` is the next state, whose ``emit``
    is the annotation of the transition taken."""

    __slots__ = ("machine", "suffix", "last", "counts", "emit")

    def __missing__(self, char: str) -> State:
        return self.machine.compile(self, char)


class Transducer:
    def __init__(self, pieces: dict[str, float], memory: int = 300_000):
        """pieces: score by piece, of the pieces that merges may make."""
        self.scores, self.memory = pieces, memory
        self.longest = max(map(len, pieces), default=1)
        self.begins = {p[:i] for p in pieces for i in range(1, len(p) + 1)}
        self.beside = {p[i:i + 2] for p in pieces for i in range(len(p) - 1)}
        self.fits: dict[tuple[str, str], bool] = {}
        self.valid = {p for p in pieces if len(p) == 1 or self.merge(p) == [p]}
        self._reset()

    def _reset(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = self._state("", (None,), (0,), 0)

    def _state(self, suffix: str, last: tuple, counts: tuple, emit: int) -> State:
        key = suffix, last, counts, emit
        s = self.states.get(key)
        if s is None:
            s = self.states[key] = State()
            s.machine, s.suffix, s.last, s.counts, s.emit = self, suffix, last, counts, emit
        return s

    def merge(self, text: str) -> list[str]:
        """Plain merging, best score first, leftmost on ties: used on single
        pieces and on pairs of pieces to compile the machine."""
        parts, score = list(text), self.scores.get
        while len(parts) > 1:
            found = [(-s, i) for i in range(len(parts) - 1) if (s := score(parts[i] + parts[i + 1])) is not None]
            if not found:
                break
            i = min(found)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def compatible(self, a: str | None, b: str) -> bool:
        if a is None or a[-1] + b[0] not in self.beside:
            return True
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            known = self.fits[a, b] = self.merge(a + b) == [a, b]
        return known

    def compile(self, s: State, char: str) -> State:
        """The transition of ``s`` on ``char``.

        ``s.last[i]`` is the last piece of the prefix that ends before
        ``s.suffix[i:]``, ``s.counts[i]`` its tokens less those of the whole.
        """
        if char not in self.scores:  # byte fallback; nothing merges over it
            t = self._state("", (None,), (0,), len(char.encode()))
            s[char] = t
            return t
        if s.suffix and s.suffix[-1] + char not in self.beside:
            suffix, last, counts = "", (None,), (0,)
        else:
            suffix, last, counts = s.suffix, s.last, s.counts
        text = suffix + char
        for i in range(len(text)):
            piece = text[i:]
            if piece in self.valid and self.compatible(last[i], piece):
                break
        else:
            raise AssertionError(f"no piece ends {text!r}")
        emit = counts[i] + 1
        keep = next((i for i in range(len(text)) if text[i:] in self.begins), len(text))
        last = (*last, piece)[keep:]
        counts = tuple(c - emit for c in (*counts, emit)[keep:])
        if len(self.states) > self.memory:  # states met so far are forgotten, texts go on
            self.states = {}
        t = self._state(text[keep:], last, counts, emit)
        s[char] = t
        return t

    def run(self, text: str) -> int:
        """Tokens of a text that begins in the start state."""
        if len(self.states) > self.memory:
            self._reset()
        s, n = self.start, 0
        for c in text:
            s = s[c]
            n += s.emit
        return n

    def chunk_map(self, text: str) -> tuple[str, int | None, str]:
        """(head, count, tail) of a chunk; count None: no reset point in it."""
        first = next((i for i in range(1, len(text)) if text[i - 1:i + 1] not in self.beside), None)
        if first is None:
            return text, None, ""
        end = next(i for i in range(len(text) - 1, 0, -1) if text[i - 1:i + 1] not in self.beside)
        return text[:first], self.run(text[first:end]), text[end:]

    def compose(self, a, b):
        """The map of two chunks in a row; associative."""
        if a[1] is None and b[1] is None:
            return self._open(a[0], b[0])
        if a[1] is None:
            if a[0] and b[0] and a[0][-1] + b[0][0] not in self.beside:
                return a[0], self.run(b[0]) + b[1], b[2]
            return a[0] + b[0], b[1], b[2]
        if b[1] is None:
            if a[2] and b[0] and a[2][-1] + b[0][0] not in self.beside:
                return a[0], a[1] + self.run(a[2]), b[0]
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self.run(a[2] + b[0]) + b[1], b[2]

    def _open(self, x: str, y: str):
        if x and y and x[-1] + y[0] not in self.beside:
            return x, 0, y
        return x + y, None, ""

    def count(self, text: str, chunk: int = 1 << 15) -> int:
        """Tokens of the text.  Short texts run from the start state; long
        ones are cut into chunks whose state maps compose by doubling."""
        if len(text) <= chunk:
            return self.run(text)
        maps = [self.chunk_map(text[i:i + chunk]) for i in range(0, len(text), chunk)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, count, tail = maps[0]
        return self.run(head) + (0 if count is None else count + self.run(tail))


class PieceCounter:
    """Counts as the library does for a BPE piece model with byte fallback
    and an identity normalizer."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not model.trainer_spec.byte_fallback:
            raise ValueError("the counter is built for byte fallback and an identity normalizer")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.machine = Transducer({p.piece: p.score for p in model.pieces if p.type == 1})

    def count(self, text: str) -> int:
        return self.machine.count(self.prefix + text.replace(" ", SPACE)) if text else 0


_counters: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    if path not in _counters:
        _counters[path] = PieceCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text."""
    def run(batches):
        c = counter(path)
        for b in batches:
            n = [c.count(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n_bytes": b["n_bytes"], "n_tokens": n,
                                "over_limit": [x > limit for x in n]})
    text = text_or_empty()
    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"),
                        F.octet_length(text).cast("bigint").alias("n_bytes")).mapInPandas(run, OUT))
