"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

A text is cut into marked words (each space is a mark before the word; cuts never fall inside a possible
piece).  The distinct words of a batch are sorted, which walks their trie depth first: going from one word to the next keeps
the forward states of the common prefix and adds states for the rest only.

The state at a position is the best path that ends there.  For a unigram model, a path's score is the
sum of its pieces' scores.  For a BPE model, the score of a step is 0 where the pair of the last piece and the
next one is what merging their joined text gives, and minus infinity otherwise: a segmentation is the merges' own
exactly where all its neighbouring pairs are, so one path at each position survives, and the ids are those of
the merge algorithm.  Characters without a piece are spelled in bytes.  Which pieces end at a position is a state too (of an
automaton over the pieces), so no other lengths are tried.

Defined cases: null and empty texts have no ids and decode to ""; texts of any length are encoded whole; repeated rows
each give their row; spaces are kept, also at the ends; U+2581 in a text is read as a space, as the format
defines; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
import struct
import sys
import types
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesframe.llm import textcols as tc
from seriesframe.llm.tables import small_batches

MARK = "▁"
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: What a worker remembers, at most: bytes of words and their ids (about WORD_BYTES a word, besides its text), pairs of pieces, and steps outside the trie.
BYTES_KEPT, PAIRS_KEPT, STEPS_KEPT = 64 << 20, 500_000, 200_000
WORD_BYTES = 160
#: Of words, what a worker keeps from one task to the next, at most.
IDLE_BYTES = 16 << 20

_UNIGRAM, _BPE = 1, 2
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message; varints as int, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Model:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    kind: int
    dummy_prefix: bool
    ids: dict[str, int] = field(default_factory=dict)
    byte_ids: list[int] = field(default_factory=list)
    digest: str = ""

    def __post_init__(self) -> None:
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (_NORMAL, _USER)}
        bytes_ = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == _BYTE}
        if sorted(bytes_) != list(range(256)):
            raise ValueError("the model can't spell unknown characters in bytes")
        self.byte_ids = [bytes_[b] for b in range(256)]
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece of the model goes over the end of a word")
        self.digest = hashlib.sha256(repr((self.pieces, self.scores, self.kinds, self.kind)).encode()).hexdigest()
        alphabet = {c for p in self.ids for c in p}
        cut = "".join(chr(c) for c in range(32) if chr(c) not in alphabet)  # characters that no piece has part words as well
        self.lines = "\n" in cut
        self.parted = re.compile(f"[{re.escape(cut)}]").search if cut else lambda word: None
        cut = re.escape(cut)
        self.word = re.compile(f"{MARK}+[^{MARK}{cut}]*|[^{MARK}{cut}]+|[{cut}]+" if cut else f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
        self.unknown_score = min(self.scores) - 10.0
        self.left, self.right, self.made = {}, {}, {}
        if self.kind == _BPE:
            self._trace()

    def _trace(self) -> None:
        """How merging makes each piece: its last two parts and its rank; left out if merging its text ends otherwise.

        `made` is -1 for single characters, which are there from the start, and None where a part is made after the whole
        (then pairs with this piece are tried by merging).
        """
        for piece, i in self.ids.items():
            steps: list[tuple[str, str]] = []
            if merge(self, piece, steps) != [i]:
                continue
            self.made[i] = -1.0 if len(piece) == 1 else -self.scores[i]
            if steps:
                self.left[i], self.right[i] = self.ids.get(steps[-1][0], -1), self.ids.get(steps[-1][1], -1)
        for i in sorted(self.left, key=lambda i: len(self.pieces[i])):
            if not self.pieces[i].strip(MARK):
                self.made[i] = None  # runs of spaces have one score, so that places and not ranks order their merges
                continue
            parts = (self.made.get(self.left[i]), self.made.get(self.right[i]))
            if None in parts or max(parts) >= self.made[i]:
                self.made[i] = None

    def stays(self, p: int, q: int) -> bool:
        """Whether merging the joined text of pieces p and q ends in just these two.

        Going back in time from the end: a merge over the border happened if the pieces at it joined to one with a better rank than
        the merges that used them up (at equal ranks the left one comes first).
        """
        made, ids, pieces, scores = self.made, self.ids, self.pieces, self.scores
        if p not in made or q not in made:
            return False
        if made[p] is None or made[q] is None:
            return merge(self, pieces[p] + pieces[q]) == [p, q]
        used_p = used_q = float("inf")
        while True:
            c = ids.get(pieces[p] + pieces[q])
            if c is not None and -scores[c] < used_p and -scores[c] <= used_q:
                return False
            a, b = made[p], made[q]
            if a is None or b is None:
                return merge(self, pieces[p] + pieces[q]) == [p, q]
            if a < 0 and b < 0:
                return True
            if a > b:
                used_p, p = a, self.right[p]
            else:
                used_q, q = b, self.left[q]


def parse(data: bytes) -> Model:
    pieces, scores, kinds = [], [], []
    kind, prefix, fallback = _UNIGRAM, True, False
    for number, value in _fields(data):
        if number == 1:
            piece = {1: b"", 2: struct.pack("<f", 0.0), 3: _NORMAL} | dict(_fields(value))
            pieces.append(piece[1].decode())
            scores.append(struct.unpack("<f", piece[2])[0])
            kinds.append(piece[3])
        elif number == 2:
            spec = dict(_fields(value))
            kind, fallback = spec.get(3, _UNIGRAM), bool(spec.get(35, 0))
        elif number == 3:
            spec = dict(_fields(value))
            prefix = bool(spec.get(3, 1))
            if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                raise ValueError("only models without normalisation of characters and spaces are supported")
    if kind not in (_UNIGRAM, _BPE) or not fallback:
        raise ValueError("only unigram and BPE models with byte fallback are supported")
    return Model(pieces, scores, kinds, kind, prefix)


def load(path: str = MODEL_PATH) -> Model:
    with open(path, "rb") as f:
        return parse(f.read())


def merge(model: Model, text: str, steps: list[tuple[str, str]] | None = None) -> list[int]:
    """The merge algorithm itself: join the neighbours that form the best piece, the leftmost first, until none do.

    steps gets the two parts of each merge.
    """
    parts: list[str | None] = list(text)
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[float, int, str]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n:
            joined = parts[i] + parts[j]
            if joined in model.ids:
                heapq.heappush(heap, (-model.scores[model.ids[joined]], i, joined))

    for i in range(n):
        offer(i)
    while heap:
        _, i, joined = heapq.heappop(heap)
        if parts[i] is None or after[i] >= n or parts[i] + parts[after[i]] != joined:
            continue
        j = after[i]
        if steps is not None:
            steps.append((parts[i], parts[j]))
        parts[i], parts[j] = joined, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [t for p in parts if p is not None for t in _spell(model, p)]


def _spell(model: Model, piece: str) -> list[int]:
    own = model.ids.get(piece)
    return [own] if own is not None else [model.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]


class Suffixes:
    """Which pieces end at a place, the longest first: an automaton over the trie of all pieces (Aho and Corasick).

    next[s] has the steps of state s; those that aren't in the trie are added as they are met, STEPS_KEPT of them at most.
    """

    def __init__(self, model: Model):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[tuple[tuple[int, int], ...]] = [()]
        self.spare = STEPS_KEPT
        for piece, i in model.ids.items():
            s = 0
            for c in piece:
                if c not in self.next[s]:
                    self.next[s][c] = len(self.next)
                    self.next.append({})
                    self.ends.append(())
                s = self.next[s][c]
            if model.kind != _BPE or i in model.made:  # other pieces of a BPE model are never its choice
                self.ends[s] = ((i, len(piece)),)
        self.fail = [0] * len(self.next)
        order = [0]
        for s in order:  # by length, while next holds the trie only
            for c, t in self.next[s].items():
                order.append(t)
                if s:
                    f = self.fail[s]
                    while f and c not in self.next[f]:
                        f = self.fail[f]
                    self.fail[t] = self.next[f].get(c, 0)
                    self.ends[t] += self.ends[self.fail[t]]

    def step(self, s: int, c: str) -> int:
        """Where c leads from s, for steps that next hasn't yet."""
        f = s
        while f and c not in self.next[f]:
            f = self.fail[f]
        t = self.next[f].get(c, 0)
        if self.spare:
            self.next[s][c] = t
            self.spare -= 1
        return t


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    if b.startswith(a):
        return len(a)
    n = 0
    for x, y in zip(a, b):  # noqa: B905
        if x != y:
            break
        n += 1
    return n


def _trace_back(model: Model, word: str, last: list[int], step: list[int], out: list[int]) -> int:
    """Adds the word's ids to out, the last one first, and tells how many there are."""
    before, end = len(out), len(word)
    while end:
        i = last[end]
        if i >= 0:
            out.append(i)
        else:
            out += reversed(_spell(model, word[end - 1]))
        end -= step[end]
    return len(out) - before


def _encode_bpe(model: Model, words: list[str], pieces: Suffixes, stable: dict[int, bool]) -> tuple[list[int], list[int]]:
    """One path survives at each place: that of the first piece, by length, which merging leaves beside the one before it."""
    following, ends, known = pieces.next, pieces.ends, stable.get
    # forward states by position: automaton, last id (-1: none, or spelled in bytes), length of the last step
    state, last, step = [0], [-1], [0]
    ids: list[int] = []
    counts: list[int] = []
    previous = ""
    for word in words:
        keep = _shared(previous, word)
        del state[keep + 1 :], last[keep + 1 :], step[keep + 1 :]
        s, end = state[keep], keep
        for c in word[keep:]:
            end += 1
            t = following[s].get(c)
            s = pieces.step(s, c) if t is None else t
            own, size = -1, 1  # without a piece: in bytes
            for i, n in ends[s]:
                p = last[end - n]
                if p >= 0:
                    pair = p << 32 | i
                    ok = known(pair)
                    if ok is None:
                        ok = stable[pair] = model.stays(p, i)
                    if not ok:
                        continue
                own, size = i, n
                break
            state.append(s)
            last.append(own)
            step.append(size)
        counts.append(_trace_back(model, word, last, step, ids))
        previous = word
    return ids, counts


def _encode_unigram(model: Model, words: list[str], pieces: Suffixes) -> tuple[list[int], list[int]]:
    following, ends, scores, ids, unknown = pieces.next, pieces.ends, model.scores, model.ids, model.unknown_score
    state, last, step, best = [0], [-1], [0], [0.0]
    back: list[int] = []
    counts: list[int] = []
    previous = ""
    for word in words:
        keep = _shared(previous, word)
        del state[keep + 1 :], last[keep + 1 :], step[keep + 1 :], best[keep + 1 :]
        s, end = state[keep], keep
        for c in word[keep:]:
            end += 1
            t = following[s].get(c)
            s = pieces.step(s, c) if t is None else t
            own, size, score = -1, 1, best[end - 1] + unknown if c not in ids else float("-inf")
            for i, n in ends[s]:
                total = best[end - n] + scores[i]
                if total > score:
                    own, size, score = i, n, total
            state.append(s)
            last.append(own)
            step.append(size)
            best.append(score)
        counts.append(_trace_back(model, word, last, step, back))
        previous = word
    return back, counts


def encode_words(model: Model, words: list[str], pieces: Suffixes | None = None, stable: dict[int, bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends): the ids of each of the sorted distinct words one after another, in their order, and where those of each word end."""
    pieces = Suffixes(model) if pieces is None else pieces
    back, counts = _encode_bpe(model, words, pieces, {} if stable is None else stable) if model.kind == _BPE else _encode_unigram(model, words, pieces)
    sizes = np.array(counts, np.int64)
    ends = np.cumsum(sizes)
    ids = np.array(back, np.int32)
    return ids[np.repeat(2 * ends - sizes - 1, sizes) - np.arange(len(ids))], ends  # each word's run the other way round


class Encoder:
    """Ids of marked words, remembered within bounds over the batches and tasks of a worker.

    A word is known by a key: what follows its mark; with several marks, as many spaces and the rest; without one, MARK and the rest.
    A line feed that parts words is a key of its own.
    """

    def __init__(self, model: Model):
        self.model = model
        self.pieces = Suffixes(model)
        gc.freeze()  # the automaton's many small tables stay for the worker's life
        self.stable: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.ends = np.zeros(1 << 14, np.int64)  # ends[k]: where word k-1 ends in flat
        self.uses = np.zeros(0, np.int64)
        self.count = 0
        self.chars = 0

    def trim(self, most: int) -> None:
        """Forget rare words, so that about `most` bytes stay."""
        order, least = list(self.index), 2  # by number
        lengths = np.fromiter(map(len, order), np.int64, len(order))
        kept = np.flatnonzero(self.uses >= least)
        while len(kept) * WORD_BYTES + lengths[kept].sum() > most:
            least *= 2
            kept = np.flatnonzero(self.uses >= least)
        starts, sizes = self.ends[kept], self.ends[kept + 1] - self.ends[kept]
        sums = np.concatenate([[0], np.cumsum(sizes)])
        flat, uses = self.flat[np.repeat(starts - sums[:-1], sizes) + np.arange(sums[-1])], self.uses[kept]
        self._forget()
        self.index = {order[k]: i for i, k in enumerate(kept.tolist())}
        self.flat, self.ends, self.uses = np.append(flat, np.int32(0)), sums, uses
        self.count, self.chars = len(kept), int(lengths[kept].sum())

    def _learn(self, keys: set[str]) -> None:
        if len(self.stable) > PAIRS_KEPT:
            self.stable.clear()
        model, parted = self.model, self.model.parted
        order = list(keys)
        marked = [k.replace(" ", MARK) if k[:1] == " " else k[1:] if k[:1] == MARK else k if k == "\n" and model.lines else MARK + k for k in order]
        several = {k: model.word(w) for k, w in enumerate(marked) if parted(w) or not w}
        if several:
            marked = [w for k, w in enumerate(marked) if k not in several]
            order = [key for k, key in enumerate(order) if k not in several] + [order[k] for k in several]
        words = sorted({*marked, *(w for ws in several.values() for w in ws)})
        ids, ends = encode_words(model, words, self.pieces, self.stable)
        number = dict(zip(words, range(len(words)), strict=True))
        pick = np.fromiter(map(number.__getitem__, chain(marked, chain.from_iterable(several.values()))), np.int64)
        starts = np.concatenate([[0], ends])[pick]
        lengths = ends[pick] - starts
        sums = np.concatenate([[0], np.cumsum(lengths)])
        total, at = int(sums[-1]), int(self.ends[self.count])
        picked = ids[np.repeat(starts - sums[:-1], lengths) + np.arange(total)]
        last = np.cumsum([1] * len(marked) + [len(ws) for ws in several.values()])  # how many words up to the end of each key
        while len(self.flat) < at + total:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.ends) < self.count + len(order) + 1:
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[at : at + total] = picked
        self.ends[self.count + 1 : self.count + 1 + len(order)] = at + sums[last]
        self.index.update(zip(order, range(self.count, self.count + len(order)), strict=True))
        self.count += len(order)
        self.chars += sum(map(len, order))

    def _keys(self, text: str) -> list[str]:
        """Keys of a text's words."""
        text = text.replace(MARK, " ")
        if self.model.dummy_prefix:
            cut = text.replace("\n", f" \n {MARK}") if self.model.lines else text
            if "  " not in cut and cut[:1] != " " and cut[-1:] != " ":
                return cut.split(" ")
            text = " " + text
        out = []
        for w in self.model.word(text.replace(" ", MARK)):
            rest = w.lstrip(MARK)
            marks = len(w) - len(rest)
            out.append(rest if marks == 1 else " " * marks + rest if marks else MARK + rest)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of all texts."""
        if len(self.index) * WORD_BYTES + self.chars + self.flat.nbytes > BYTES_KEPT:
            self.trim(BYTES_KEPT // 2)
        split = [self._keys(t) if t else [] for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        keys = list(chain.from_iterable(split))
        at = np.fromiter(map(self.index.get, keys, repeat(-1)), np.int64, len(keys))
        unknown = np.flatnonzero(at < 0).tolist()
        if unknown:
            self._learn({keys[k] for k in unknown})
            at[unknown] = [self.index[keys[k]] for k in unknown]
        uses = np.bincount(at, minlength=self.count)
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        starts, lengths = self.ends[at], self.ends[at + 1] - self.ends[at]
        total = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.flat[np.repeat(starts - total[:-1], lengths) + np.arange(total[-1])]
        return ids, total[np.concatenate([[0], np.cumsum(sizes)])]


def _spelling(model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all pieces in a row, and where each begins."""
    def make():
        spelled = [bytes([int(p[3:5], 16)]) if k == _BYTE else b"" if k == _CONTROL else p.replace(MARK, " ").encode("utf-8", "surrogatepass") for p, k in zip(model.pieces, model.kinds, strict=True)]
        return np.frombuffer(b"".join(spelled), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in spelled])])

    return _cache("spelling", model.digest, make)


def decode_all(model: Model, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Texts of ids[offsets[k]:offsets[k + 1]]."""
    data, starts = _spelling(model)
    first, size = starts[ids], starts[ids + 1] - starts[ids]
    ends = np.concatenate([[0], np.cumsum(size)])
    whole = data[np.repeat(first - ends[:-1], size) + np.arange(ends[-1])].tobytes()
    cuts = ends[offsets].tolist()
    texts = [whole[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [t[1:] if t.startswith(" ") else t for t in texts] if model.dummy_prefix else texts


def decode(model: Model, ids) -> str:
    return decode_all(model, np.asarray(ids, np.int64), np.array([0, len(ids)]))[0]


def _cache(name: str, of: str, make):
    """A value kept for the life of the Python worker, until it is wanted of another model; the functions here travel by value and can't keep it."""
    home = sys.modules.setdefault("_seriesframe_worker_cache", types.ModuleType("_seriesframe_worker_cache"))
    if getattr(home, name, (None, None))[0] != of:
        setattr(home, name, (of, make()))
    return getattr(home, name)[1]


def encode_column(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None, ids_col: str = "ids", verify: bool = False) -> DataFrame:
    """The columns `keep` of docs (default: all but clashing ones) with ids; with verify, decoded_sha256 of the text that the ids give back."""
    from pyspark.sql import types as T

    extra = [ids_col, *(["n_tokens", "decoded_sha256", "exact"] if verify else [])]
    keep = [c for c in docs.columns if c not in extra] if keep is None else keep
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the vocabulary

    def run(batches):
        model = shared.value
        encoder = _cache("encoder", model.digest, lambda: Encoder(model))
        for batch in batches:
            column = tc.column(batch, text)
            for a, b in tc.pieces(column):
                texts = column.slice(a, b - a).to_pylist()
                ids, offsets = encoder.encode(texts)
                arrays = [*(batch.column(c).slice(a, b - a) for c in keep), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))]
                if verify:
                    back = decode_all(model, ids, offsets)
                    arrays += [pa.array(np.diff(offsets)), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back]), pa.array([x == t for x, t in zip(back, texts, strict=True)])]
                yield pa.RecordBatch.from_arrays(arrays, [*keep, *extra])
        encoder.trim(IDLE_BYTES)
        tc.give_back()

    fields = [T.StructField(ids_col, T.ArrayType(T.IntegerType()))]
    if verify:
        fields += [T.StructField("n_tokens", T.LongType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("exact", T.BooleanType())]
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), *fields]))


def decode_column(frame: DataFrame, model: Model, *, ids: str = "ids", text_col: str = "text") -> DataFrame:
    """All columns of frame (but one named text_col) with the text of each list of ids; null ids give null."""
    from pyspark.sql import types as T

    keep = [c for c in frame.columns if c != text_col]
    small_batches(frame.sparkSession)
    shared = frame.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = [None if x is None else decode(shared.value, x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, text_col])

    return frame.mapInArrow(run, T.StructType([*(frame.schema[c] for c in keep), T.StructField(text_col, T.StringType())]))


def round_trip(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, n_tokens, decoded_sha256 and exact (the ids give the text back) of each row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_t"))
    return encode_column(rows, model, text="_t", keep=["doc_id"], verify=True)
