"""Byte-level BPE as a bounded-lookahead streaming transducer, and its inverse as a byte-to-text state machine.

Lookahead. Take two texts with the same first m bytes and apply the merges rank by rank to both. Call front the last
border up to which both have the same tokens: at first it is m. Only a merge (y, x) across the front moves it, back by the bytes of
y, and the next one that does so has a higher rank, ends in y', the token left of the new front, and its right part x' has y
on its left edge, where y has not been merged at a lower rank. `lookahead` takes the most bytes that any such chain of merges moves the
front, by one pass over the merges in their order: so tokens that end `lookahead` bytes before the end of what has been read are
the tokens of every text that starts so, whatever follows. They are emitted; as no merge ever crosses their end, what
follows is encoded as if it stood alone, so the transducer's state is its window: the lookahead, the longest token and STEP bytes at most.

`Transducer` takes a text in pieces of characters. It cuts pre-tokens where no character to come can change the cut, and feeds their
bytes to the window; a pre-token that doesn't end within a piece stays open and is fed on. `settle` is the one step that
encodes: many windows at once, each a whole short pre-token or a part of a long one. Texts whose pre-tokens are short are cut at
spaces, which always start a pre-token, and what a worker has encoded between spaces is remembered up to CACHE_BYTES.

Decoding maps ids to bytes and bytes to text as they come; a character's bytes may come in different runs.

Defined results: a null text counts as empty: no tokens, both digests those of no bytes; strings of special tokens in
a text become their ids, as the tokenizer does; lone surrogates can't come, as Spark's strings are UTF-8; repeated rows are
encoded one by one; an empty table gives no rows; columns other than doc_id and text aren't read, whatever their names. A text of
any length, with or without spaces, needs no more memory than its own row and the window.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from linkloom.llm.common import table
from linkloom.llm.packing import vocabulary_path

VOCABULARY = "byte_bpe_50k.json"
#: Characters of a text read at a time.
WINDOW = 1 << 16
#: Bytes that a window takes beyond the lookahead before its stable tokens are emitted.
STEP = 1 << 10
#: Characters between two spaces that are remembered with their ids, and memory for that.
SHORT, CACHE_BYTES = 128, 96 << 20
#: Characters of texts whose new words are encoded together.
AHEAD = 1 << 20
#: Characters beyond a pre-token's end that the pattern may look at.
SEEN = 3
NONE = np.int64(1 << 40)

#: The pre-tokenizer's pattern, its runs, and how it sees white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RUNS = [r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]", r"\s"]
BLANK = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNK = re.compile(f" ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
CUT = re.compile(f"(?<=[^{BLANK}]) (?=[^{BLANK}])")


def byte_of_character() -> dict[str, int]:
    """The vocabulary file writes a byte as a printable character: itself where it is one, else the next from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes before the end of a text's read part beyond which its tokens can't change, by the chains of merges described above."""
    rule: dict[bytes, tuple[int, bytes]] = {}
    ended: dict[bytes, tuple[list[int], list[int]]] = {}  # by left part: ranks, and the farthest move of the chains up to each
    most = 0
    for rank, (left, right) in enumerate(merges):
        far, edge, limit, inner = 0, right, rank, False
        while True:
            ranks, moves = ended.get(edge, ((), ()))
            n = bisect_right(ranks, limit) if inner else bisect_left(ranks, limit)
            if n:
                far = max(far, moves[n - 1])
            if edge not in rule:
                break
            (limit, edge), inner = rule[edge], True
        far += len(left)
        ranks, moves = ended.setdefault(left, ([], []))
        ranks.append(rank)
        moves.append(max(far, moves[-1] if moves else 0))
        if left + right in rule:
            raise ValueError("two merges make one token: their chains aren't bounded here")
        rule[left + right] = (rank, left)
        most = max(most, far)
    return most


class Bpe:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = byte_of_character()
        vocab = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {i: bytes(byte[c] for c in t) for t, i in vocab.items() if t not in self.special}
        id_of = {b: i for i, b in self.bytes_of.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(vocab[a], vocab[b]): (k, vocab[a + b]) for k, (a, b) in enumerate(merges)}
        keys = np.array([a << 20 | b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.array([r for r, _ in self.rank.values()], np.int64)[order]
        self.made = np.array([i for _, i in self.rank.values()], np.int64)
        self.first = np.array([id_of[bytes([b])] for b in range(256)], np.int64)
        self.size = np.zeros(max(self.bytes_of) + 1, np.int64)
        self.size[list(self.bytes_of)] = [len(b) for b in self.bytes_of.values()]
        self.lookahead = sufficient_lookahead([(self.bytes_of[vocab[a]], self.bytes_of[vocab[b]]) for a, b in merges])
        self.longest = int(self.size.max())
        self.flat = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(len(self.size))), np.uint8)
        self.start = np.cumsum(self.size) - self.size
        self.pattern = regex.compile(PATTERN)
        self.runs = [(regex.compile(r), regex.compile(r"\s+(?!\S)" if r == r"\s" else r"(?:" + r + ")+")) for r in RUNS]
        self.chunks: dict[str, bytes] = {}
        self.held = 0

    # -- merging ---------------------------------------------------------------------------------------------------

    def merge_one(self, word: bytes) -> np.ndarray:
        """The encoding of one window: the merge of lowest rank, leftmost first, again and again, by a heap of pairs."""
        ids = self.first[np.frombuffer(word, np.uint8)].tolist()
        n, rank = len(ids), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := rank.get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j >= n or ids[j] != b:
                continue  # one of the two has been merged since
            ids[k], ids[j] = rank[a, b][1], -1
            after[k] = j = after[j]
            if j < n:
                before[j] = k
                if (r := rank.get((ids[k], ids[j]))) is not None:
                    heapq.heappush(heap, (r[0], k, ids[k], ids[j]))
            i = before[k]
            if i >= 0 and (r := rank.get((ids[i], ids[k]))) is not None:
                heapq.heappush(heap, (r[0], i, ids[i], ids[k]))
        out = np.array(ids, np.int64)
        return out[out >= 0]

    def merge_many(self, words: list[bytes]) -> list[np.ndarray]:
        """merge_one for many short windows at once; every round merges each one's best pair."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(words)
        sizes = np.array([len(w) for w in words])
        number = np.flatnonzero(sizes > 0)
        sym = self.first[np.frombuffer(b"".join(words), np.uint8)]
        sizes = sizes[number]
        seg = np.repeat(np.arange(len(number)), sizes)
        rank = np.full(len(sym), NONE)
        self._rank_pairs(sym, seg, rank, np.arange(len(sym)))
        while len(number):
            starts = np.cumsum(sizes) - sizes
            best = np.minimum.reduceat(rank, starts)
            done = best == NONE
            if done.any():
                k = np.flatnonzero(done)
                for w, a, b in zip(number[k].tolist(), starts[k].tolist(), (starts[k] + sizes[k]).tolist()):
                    out[w] = sym[a:b]
                keep = ~done[seg]
                sym, rank = sym[keep], rank[keep]
                number, sizes, best = number[~done], sizes[~done], best[~done]
                if not len(number):
                    break
                seg = np.repeat(np.arange(len(number)), sizes)
            take = np.flatnonzero(rank == best[seg])
            # of pairs that overlap, as in "aaa", the first, third ... of the run
            run = np.r_[True, np.diff(take) != 1]
            if not run.all():
                first = np.maximum.accumulate(np.where(run, np.arange(len(take)), 0))
                take = take[(np.arange(len(take)) - first) % 2 == 0]
            sym[take] = self.made[rank[take]]
            keep = np.ones(len(sym), bool)
            keep[take + 1] = False
            sizes = sizes - np.bincount(seg[take], minlength=len(number))
            sym, seg, rank = sym[keep], seg[keep], rank[keep]
            # only pairs with a merged token have another rank; each merge before has taken one symbol away
            now = take - np.arange(len(take))
            self._rank_pairs(sym, seg, rank, np.concatenate([now, now[now > 0] - 1]))
        return out

    def _rank_pairs(self, sym: np.ndarray, seg: np.ndarray, rank: np.ndarray, at: np.ndarray) -> None:
        """Sets the rank of the pairs that begin at some places: NONE if they can't merge or their window ends."""
        rank[at] = NONE
        at = at[at + 1 < len(sym)]
        at = at[seg[at] == seg[at + 1]]
        key = sym[at] << 20 | sym[at + 1]
        found = np.searchsorted(self.keys, key)
        found[found == len(self.keys)] = 0
        hit = self.keys[found] == key
        rank[at[hit]] = self.ranks[found[hit]]

    def settle(self, windows: list[bytes], whole: bool) -> list[tuple[bytes, int]]:
        """For each window of a pre-token's bytes its stable tokens, as little-endian 32-bit ids, and the bytes they cover.

        whole: the pre-tokens end with their windows, so that all tokens are stable; else those that end `lookahead` before.
        """
        out: list = [None] * len(windows)
        short = [k for k, w in enumerate(windows) if len(w) <= SHORT]
        for a in range(0, len(short), 8192):
            for k, ids in zip(short[a : a + 8192], self.merge_many([windows[k] for k in short[a : a + 8192]])):
                out[k] = ids
        for k, w in enumerate(windows):
            ids, size = self.merge_one(w) if out[k] is None else out[k], len(w)
            if not whole:
                ids = ids[: np.searchsorted(np.cumsum(self.size[ids]), len(w) - self.lookahead, "right")]
                size = int(self.size[ids].sum())
            out[k] = (ids.astype("<u4").tobytes(), size)
        return out

    # -- encoding --------------------------------------------------------------------------------------------------

    def parts(self, text: str) -> list[str]:
        """text cut where a pre-token starts, whatever is around."""
        if "  " in text:
            return CHUNK.findall(text)
        if "\0" not in text:
            return text.replace(" ", "\0 ").split("\0")
        parts = text.split(" ")
        return parts[:1] + [" " + p for p in parts[1:]]

    def prepare(self, parts: set[str]) -> None:
        """Encodes the short parts that aren't remembered, all of their new pre-tokens in one step."""
        new = [c for c in parts.difference(self.chunks) if len(c) <= SHORT]
        if not new:
            return
        if self.held > CACHE_BYTES:
            self.chunks.clear()
            self.held = 0
            new = [c for c in parts if len(c) <= SHORT]
        split = list(map(self.pattern.findall, new))
        words = {w for ws in split for w in ws}
        known = {w: self.chunks[w] for w in words if w in self.chunks}
        words = list(words.difference(known))
        known |= {w: ids for w, (ids, _) in zip(words, self.settle([w.encode() for w in words], True))}
        for c, ws in zip(new, split):
            ids = self.chunks[c] = b"".join([known[w] for w in ws])
            self.held += 200 + 2 * len(c) + len(ids)

    def remembered(self, parts: list[str]) -> bytes | None:
        """Ids of the parts, if all are remembered."""
        try:
            return b"".join(map(self.chunks.__getitem__, parts))
        except KeyError:
            return None

    def window(self, text: str, parts: list[str] | None = None) -> Iterator[bytes]:
        """Ids of a text that ends where a pre-token ends, whatever follows. parts: those of the text, if they are known."""
        parts = self.parts(text) if parts is None else parts
        ids = self.remembered(parts)
        if ids is None:
            self.prepare(set(parts))
            ids = self.remembered(parts)
        if ids is not None:
            yield ids
            return
        for p in parts:
            if len(p) <= SHORT:
                yield self.chunks[p]
            else:
                t = Transducer(self)
                yield t.feed(p)
                yield t.end()

    def plain(self, text: str, parts: list[str] | None = None) -> Iterator[bytes]:
        if parts is not None and len(text) <= WINDOW:
            yield from self.window(text, parts)
            return
        at = 0
        while at < len(text):
            to = at + WINDOW
            if to < len(text):
                # the last space between others, near the window's end
                to = text.rfind(" ", at + 1, to)
                while to > 0 and not CUT.match(text, to):
                    to = text.rfind(" ", at + 1, to)
            if to > 0:
                yield from self.window(text[at:to])
                at = to
                continue
            # no certain border: the transducer reads on up to the next one
            t, m, look = Transducer(self), None, at + 1
            while at < len(text) and not m:
                m = CUT.search(text, look, at + WINDOW)
                to = m.start() if m else min(len(text), at + WINDOW)
                yield t.feed(text[at:to])
                at = look = to
            yield t.end()

    def encode(self, text: str, parts: list[str] | None = None) -> Iterator[bytes]:
        """Ids of the text, as little-endian unsigned 32-bit integers, in stable runs. parts: those of a text without special tokens, if they are known."""
        if parts is not None or not any(s in text for s in self.special):
            yield from self.plain(text, parts)
            return
        special, at = re.compile("|".join(map(re.escape, self.special))), 0
        for m in special.finditer(text):
            yield from self.plain(text[at : m.start()])
            yield self.special[m[0]].to_bytes(4, "little")
            at = m.end()
        yield from self.plain(text[at:])

    # -- decoding --------------------------------------------------------------------------------------------------

    def decode(self, runs: Iterable[bytes]) -> Iterator[str]:
        """Text of the runs of ids, each run as soon as it is read: bytes of a character may come in different runs."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for run in runs:
            yield machine.decode(self.spelled(np.frombuffer(run, "<u4")))
        yield machine.decode(b"", True)

    def spelled(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids, one after the other."""
        out = []
        for a in range(0, len(ids), WINDOW):
            some = ids[a : a + WINDOW]
            size = self.size[some]
            end = np.cumsum(size)
            if len(end):
                out.append(self.flat[np.repeat(self.start[some] - (end - size), size) + np.arange(end[-1])].tobytes())
        return b"".join(out)


class Transducer:
    """Encodes a text that is fed in pieces of any size; feed returns the ids that have become stable."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self.text = ""  # characters that aren't cut for certain yet
        self.run = None  # the pattern that an open pre-token goes on by
        self.bytes = b""  # bytes of the current pre-token whose tokens may still change

    def feed(self, more: str) -> bytes:
        self.text += more
        return self._cut(len(self.text) - SEEN)

    def end(self) -> bytes:
        out = self._cut(len(self.text) + 1)
        self.text, self.run = "", None
        return out + self._close()

    def _cut(self, certain: int) -> bytes:
        """Takes the pre-tokens that end at `certain` or before; the start of one that goes beyond is fed once it is long."""
        out, at, bpe = [], 0, self.bpe
        if self.run is not None:
            m = self.run.match(self.text)
            to = m.end() if m else 0
            if to > certain:
                to = max(0, certain)
                out.append(self._push(self.text[:to]))
                self.text = self.text[to:]
                return b"".join(out)
            out += [self._push(self.text[:to]), self._close()]
            self.run, at = None, to
        while at < len(self.text):
            m = bpe.pattern.match(self.text, at)
            if m.end() > certain:
                if certain - at > STEP:
                    self.run = next(go for one, go in bpe.runs if one.match(self.text, certain - 1))
                    out.append(self._push(self.text[at:certain]))
                    at = certain
                break
            out += [self._push(m[0]), self._close()]
            at = m.end()
        self.text = self.text[at:]
        return b"".join(out)

    def _push(self, chars: str) -> bytes:
        """Adds bytes to the window, and emits what is stable whenever it is full."""
        data, out, at = chars.encode(), [], 0
        full = self.bpe.lookahead + self.bpe.longest + STEP  # so that a token at least is stable
        while at < len(data):
            more = data[at : at + full - len(self.bytes)]
            self.bytes += more
            at += len(more)
            if len(self.bytes) >= full:
                ids, size = self.bpe.settle([self.bytes], False)[0]
                out.append(ids)
                self.bytes = self.bytes[size:]
        return b"".join(out)

    def _close(self) -> bytes:
        ids, _ = self.bpe.settle([self.bytes], True)[0] if self.bytes else (b"", 0)
        self.bytes = b""
        return ids


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def ahead(bpe: Bpe, texts: list) -> Iterator[tuple[str, list[str] | None]]:
    """The texts and their parts, after the new words of some of them have been encoded together. Longer ones come without, window by window."""
    some, size = [], 0
    for k, text in enumerate(texts):
        text = text or ""
        size += len(text)
        some.append((text, None if len(text) > WINDOW or any(x in text for x in bpe.special) else bpe.parts(text)))
        if size >= AHEAD or k + 1 == len(texts):
            bpe.prepare(set().union(*[parts for _, parts in some if parts]))
            yield from some
            some, size = [], 0


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the text decoded from them, of docs (doc_id, text)."""
    path = path or vocabulary_path(VOCABULARY)

    def run(batches):
        bpe = load(path)
        for batch in batches:
            out = []
            for text, parts in ahead(bpe, batch.column(1).to_pylist()):
                n, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()

                def runs(text=text, parts=parts, ids=ids):
                    nonlocal n
                    for run in bpe.encode(text, parts):
                        ids.update(run)
                        n += len(run) // 4
                        yield run

                for s in bpe.decode(runs()):
                    decoded.update(s.encode())
                out.append((n, ids.hexdigest(), decoded.hexdigest()))
            cols = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
