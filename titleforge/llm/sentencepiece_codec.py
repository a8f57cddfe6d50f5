"""SentencePiece encoding and decoding with shared-prefix forward passes.

A text is cut into marked words (a run of word marks and what follows, up to the
next mark). The distinct words of a batch are sorted, which is a depth-first walk
of their trie: a word takes over the forward states of the prefix that it shares
with the word before it, and computes only what is new. The state at a place
says how the best segmentation of the prefix ends:

* unigram models: the piece that maximises the sum of scores (Viterbi);
* BPE models: merging has exactly one result for every prefix, and a sequence of
  pieces is that result if and only if each two neighbours are the result of
  merging their own characters. So the state is the one piece that may follow the
  state before it. A plain Viterbi over BPE scores, which are merge ranks, would
  give other pieces than merging does.

Which pieces may end at a place is read off an automaton over the pieces (Aho and
Corasick), whose state is part of the forward state. Encoded words are kept from
batch to batch, up to ``KEPT`` words and as many older ones. Nothing is shuffled,
and memory is bounded by a batch and the kept words.

Cases:

* null and empty texts have no ids; decoding gives the empty text;
* characters without a piece become their bytes, or the unknown piece in a model
  without byte pieces;
* the mark U+2581 in a text can't be told from a space afterwards;
* null ids and repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

MARK = "▁"
#: The public model that production uses; its path is a parameter.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Encoded words, and results of merging pairs, kept by a worker at most.
KEPT = 200_000
#: Bytes of text that are encoded at once: words sort better the more there are.
TEXT = 4 << 20
#: What a character without a piece costs below the worst piece (a fixed value of the format).
UNKNOWN_PENALTY = 10.0

#: Fixed values of the model format: kinds of pieces, kinds of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
NO_PAIR = float("-inf")
EVERYTHING = r"(?s).+"


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, raw[at : at + n]
            at += n


@dataclass
class Codec:
    """A vocabulary, and the forward passes over it."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    model: int = BPE
    dummy_prefix: bool = True
    _kept: dict[str, bytes] = field(default_factory=dict, repr=False)
    _older: dict[str, bytes] = field(default_factory=dict, repr=False)
    _follows: dict[int, dict[int, bool]] = field(default_factory=dict, repr=False)
    _n_follows: int = 0
    _n_learned: int = 0
    _code: dict[int, bytes] = field(default_factory=dict, repr=False)
    _history: dict[int, tuple] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        usable = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER_DEFINED)]
        self.ids = {self.pieces[i]: i for i in usable}
        self.score_of = {self.pieces[i]: self.scores[i] for i in usable}
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == BYTE}
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        self.longest = max(map(len, self.ids), default=1)
        self.unknown_score = min(self.score_of.values(), default=0.0) - UNKNOWN_PENALTY
        long = [p for p in self.ids if len(p) > 1]
        inside = {c for p in long for c in p}
        alone = "".join(c for c in "\n\r\t" if c not in inside)  # no merge passes these
        if any(MARK in p.lstrip(MARK) for p in long):
            self.words = re.compile(EVERYTHING)  # pieces span words here
        else:
            self.words = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + f"|[{alone}]" * bool(alone))
        self.values = [self._value(i) for i in range(len(self.pieces))]

    def _value(self, i: int) -> bytes:
        if self.kinds[i] == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        if self.kinds[i] == CONTROL:
            return b""
        return (" ⁇ " if self.kinds[i] == UNKNOWN else self.pieces[i].replace(MARK, " ")).encode("utf-8", "surrogatepass")

    @classmethod
    def load(cls, path: str = MODEL) -> Codec:
        pieces, scores, kinds, model, prefix = [], [], [], UNIGRAM, True
        with open(path, "rb") as file:
            raw = file.read()
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append(piece.get(1, b"").decode())
                scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                model = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                prefix = bool(spec.get(3, 1))
                if spec.get(2) or spec.get(4, 1):
                    raise ValueError("only models that leave characters and white space as they are can be used")
        if model not in (UNIGRAM, BPE):
            raise ValueError(f"models of kind {model} can't be used")
        return cls(pieces, scores, kinds, model, prefix)

    # merging

    def merge(self, text: str) -> list[str]:
        """The result of merging: best pair first, of equal ones the leftmost."""
        parts, score = list(text), self.score_of.get
        pairs = [score(a + b, NO_PAIR) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = max(pairs)
            if best == NO_PAIR:
                break
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = score(parts[i - 1] + parts[i], NO_PAIR)
            if i < len(pairs):
                pairs[i] = score(parts[i] + parts[i + 1], NO_PAIR)
        return parts

    # the automaton: states are numbers, 0 is the start

    def _build(self) -> None:
        """Prefixes of pieces as states, and the pieces that end in each, longest first."""
        self._next: list[dict[str, int]] = [{}]
        own, depth = [-1], [0]
        for piece, i in self.ids.items():
            at = 0
            for c in piece:
                to = self._next[at].get(c)
                if to is None:
                    to = self._next[at][c] = len(self._next)
                    self._next.append({})
                    own.append(-1)
                    depth.append(depth[at] + 1)
                at = to
            own[at] = i
        self._fall = [0] * len(own)
        self._ends: list[tuple[tuple, ...]] = [()] * len(own)  # length, piece, what may follow it, its ids
        level = [(0, c, to) for c, to in self._next[0].items()]
        while level:
            deeper = []
            for parent, c, at in level:
                fall = self._fall[parent] if parent else 0
                while fall and c not in self._next[fall]:
                    fall = self._fall[fall]
                self._fall[at] = self._next[fall].get(c, 0) if parent else 0
                self._ends[at] = (((depth[at], own[at], *self._info(own[at])),) if own[at] >= 0 else ()) + self._ends[self._fall[at]]
                deeper += [(at, x, to) for x, to in self._next[at].items()]
            level = deeper

    def _step(self, state: int, c: str) -> int:
        """The state after a character that doesn't go on from ``state``; remembered there while there is room."""
        at = state
        while at and c not in self._next[at]:
            at = self._fall[at]
        to = self._next[at].get(c, 0)
        if self._n_learned < 5 * KEPT:
            self._n_learned += 1
            self._next[state][c] = to
        return to

    def _text(self, i: int) -> str:
        return self.pieces[i] if 0 <= i < len(self.pieces) else "" if i < 0 else chr(i - len(self.pieces))

    def _edges(self, piece: int) -> tuple[bool, str, str, list[tuple[float, str, str]]]:
        """How a piece comes about: whether merging gives it, its first and last character, and
        for each merge its score and the first and last symbol after it."""
        known = self._history.get(piece)
        if known is not None:
            return known
        text = self._text(piece)
        parts, score, steps = list(text), self.score_of.get, []
        while len(parts) > 1:
            pairs = [score(a + b, NO_PAIR) for a, b in zip(parts, parts[1:])]
            best = max(pairs)
            if best == NO_PAIR:
                break
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            steps.append((best, parts[0], parts[-1]))
        got = self._history[piece] = (len(parts) == 1, text[0], text[-1], steps)
        return got

    def _follow(self, left: int, right: int) -> bool:
        """Whether merging the characters of two pieces (left: -1 for none) gives the two pieces.

        Each side merges as it would alone, best pair first and of equal ones the leftmost,
        until the symbols that meet would be a better pair.
        """
        self._n_follows += 1
        if self._n_follows > 20 * KEPT:
            for row in self._follows.values():  # a pass holds the rows themselves
                row.clear()
            self._n_follows = 0
        whole, first, _, theirs = self._edges(right)
        if left < 0:
            got = whole
        else:
            own, _, last, ours = self._edges(left)
            got, i, j, score = own and whole, 0, 0, self.score_of.get
            while got:
                a = ours[i][0] if i < len(ours) else NO_PAIR
                b = theirs[j][0] if j < len(theirs) else NO_PAIR
                here = score(last + first, NO_PAIR)
                if here != NO_PAIR and here > a and here >= b:
                    got = False
                elif a == b == NO_PAIR:
                    break
                elif a >= b:
                    last = ours[i][2]
                    i += 1
                else:
                    first = theirs[j][1]
                    j += 1
        self._follows.setdefault(left, {})[right] = got
        return got

    def _info(self, piece: int) -> tuple[dict[int, bool], bytes]:
        """Whether pieces may follow this one, as far as known, and its ids as bytes."""
        row = self._follows.get(piece)
        if row is None:
            row = self._follows[piece] = {}
        return row, self._code.get(piece) or self._id_bytes(piece)

    # forward passes over sorted words: after each word, the state at each of its places (a live
    # list): the piece that ends the prefix, its length, the prefix's ids as bytes, and more

    def _bpe(self, words: list[str]) -> Iterator[list[tuple]]:
        if not hasattr(self, "_next"):
            self._build()
        next_, ends, n_pieces = self._next, self._ends, len(self.pieces)
        places: list[tuple] = [(-1, 0, b"", 0, self._follows.setdefault(-1, {}))]
        before = ""
        for word in words:
            i = _shared(before, word)
            del places[i + 1 :]
            state = places[i][3]
            for c in word[i:]:
                i += 1
                to = next_[state].get(c)
                state = self._step(state, c) if to is None else to
                for n, piece, row, code in ends[state]:
                    prior = places[i - n]
                    ok = prior[4].get(piece)
                    if ok is None:
                        ok = self._follow(prior[0], piece)
                    if ok:
                        break
                else:  # a character without a piece of its own
                    n, piece, prior = 1, n_pieces + ord(c), places[i - 1]
                    row, code = self._info(piece)
                places.append((piece, n, prior[2] + code, state, row))
            before = word
            yield places

    def _viterbi(self, words: list[str]) -> Iterator[list[tuple]]:
        places: list[tuple] = [(-1, 0, b"", 0.0)]
        before = ""
        for word in words:
            keep = _shared(before, word)
            del places[keep + 1 :]
            for i in range(keep + 1, len(word) + 1):
                options = []
                for n in range(1, min(i, self.longest) + 1):
                    s = self.score_of.get(word[i - n : i])
                    if s is None and n == 1:
                        s = self.unknown_score
                    if s is not None:
                        options.append((places[i - n][3] + s, n))
                s, n = max(options)
                piece = self.ids.get(word[i - n : i], len(self.pieces) + ord(word[i - 1]))
                places.append((piece, n, places[i - n][2] + (self._code.get(piece) or self._id_bytes(piece)), s))
            before = word
            yield places

    def forward(self, words: list[str]) -> Iterator[list[tuple]]:
        return self._bpe(words) if self.model == BPE else self._viterbi(words)

    def segment(self, words: list[str]) -> Iterator[list[str]]:
        """Pieces of each of the sorted ``words``."""
        for places in self.forward(words):
            out, i = [], len(places) - 1
            while i:
                out.append(self._text(places[i][0]))
                i -= places[i][1]
            yield out[::-1]

    def _id_bytes(self, piece: int) -> bytes:
        if piece < len(self.pieces):
            own = [piece]
        elif self.byte_ids:
            own = [self.byte_ids[b] for b in self._text(piece).encode("utf-8", "surrogatepass")]
        else:
            own = [self.unknown]
        got = self._code[piece] = np.array(own, np.int32).tobytes()
        return got

    # texts

    def marked(self, text: str | None) -> str:
        return (MARK if self.dummy_prefix and text else "") + (text or "").replace(" ", MARK)

    def _encode_words(self, words: set[str]) -> dict[str, bytes]:
        """Ids of distinct words as bytes; those not met lately go through a forward pass, sorted."""
        kept, older = self._kept, self._older
        if len(kept) > KEPT:  # what was used since stays at hand
            older, kept = kept, {}
            self._kept, self._older = kept, older
        new = []
        for word in words.difference(kept):
            known = older.get(word)
            if known is None:
                new.append(word)
            else:
                kept[word] = known
        new.sort()
        for word, places in zip(new, self.forward(new)):
            kept[word] = places[-1][2]
        return kept

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        cut = [self.words.findall(self.marked(t)) for t in texts]
        kept = self._encode_words(set().union(*cut))
        return [np.frombuffer(b"".join(map(kept.__getitem__, words)), np.int32) for words in cut]

    def encode_column(self, texts: pa.Array) -> pa.Array:
        """Ids of each text of a column.

        Texts whose words stand between single spaces are cut by Arrow, and only their
        distinct words come to Python; others (runs of spaces, marks) go one by one.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, MARK))
        odd = pc.or_(odd, pc.or_(pc.starts_with(texts, " "), pc.or_(pc.ends_with(texts, " "), pc.equal(texts, ""))))
        if not self.dummy_prefix or self.words.pattern == EVERYTHING:
            odd = pa.array(np.ones(len(texts), bool))
        rest = self.encode(texts.filter(odd).to_pylist())
        cut = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
        found = cut.flatten().dictionary_encode()
        several = pc.match_substring_regex(found.dictionary, "[\n\r\t]").to_numpy(zero_copy_only=False)
        units = [MARK + t for t in found.dictionary.to_pylist()]
        parts = {i: self.words.findall(units[i]) for i in np.flatnonzero(several).tolist()}
        kept = self._encode_words({u for i, u in enumerate(units) if i not in parts}.union(*parts.values()))
        coded = [b"".join(map(kept.__getitem__, parts[i])) if i in parts else kept[u] for i, u in enumerate(units)]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        of_unit = pa.LargeListArray.from_arrays(pa.array(_offsets(sizes)), pa.array(np.frombuffer(b"".join(coded), np.int32)))
        ids = of_unit.take(found.indices).flatten()
        per_text = np.diff(_offsets(sizes[found.indices.to_numpy()])[cut.offsets.to_numpy() - cut.offsets[0].as_py()])
        plain = pa.LargeListArray.from_arrays(pa.array(_offsets(per_text)), ids)
        other = pa.LargeListArray.from_arrays(pa.array(_offsets([len(x) for x in rest])), pa.array(np.concatenate([np.zeros(0, np.int32), *rest])))
        mask = odd.to_numpy(zero_copy_only=False)
        at = np.where(mask, len(plain) + np.cumsum(mask) - 1, np.cumsum(~mask) - 1)
        return pa.concat_arrays([plain, other]).take(pa.array(at))

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.values.__getitem__, ids.tolist()))
        try:
            text = raw.decode("utf-8", "surrogatepass")
        except UnicodeDecodeError:
            text = raw.decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def _shared(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # the prefix of length low is shared, that of high isn't
    while high - low > 1:
        mid = (low + high) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid
    return low


def _offsets(sizes: np.ndarray | list[int]) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(np.asarray(sizes, np.int64))])


def slices(sizes: np.ndarray, most: int = TEXT) -> Iterator[tuple[int, int]]:
    """Start and number of neighbouring rows that together stay under ``most``, one row at least."""
    start = total = 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > most:
            yield start, i - start
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes) - start


def encode_documents(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_ids, ids, and whether decoding the ids gives the text again."""
    codec = Codec.load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, n in slices(pc.binary_length(whole.column("text")).fill_null(0).to_numpy(zero_copy_only=False)):
                batch = whole.slice(at, n)
                texts = batch.column("text")
                ids = codec.encode_column(texts)
                values, ends = ids.flatten().to_numpy(), ids.offsets.to_numpy()
                same = [codec.decode(values[a:b]) == (t.as_py() or "") for a, b, t in zip(ends, ends[1:], texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.diff(ends)), ids.cast(pa.list_(pa.int32())), pa.array(same, pa.bool_())],
                    ["doc_id", "n_ids", "ids", "exact"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_ids long, ids array<int>, exact boolean")


def decode_documents(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, ids -> doc_id, text; null ids give the empty text."""
    codec = Codec.load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [codec.decode(np.array(i or [], np.int32)) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
