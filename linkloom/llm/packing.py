"""Packing of tokenised documents into sequences: first-fit decreasing with a tournament tree.

A document's ids are cut into full sequences and a rest; the pieces of a randomised group of about GROUP_DOCS
documents are packed by first-fit decreasing. Only piece lengths and checksums are shuffled, never texts or ids, and
no group grows with the table: there are more groups instead. Rows of one id and the same ids are counted first and then numbered,
and a group is chosen by a hash of the id, the checksums and that number: copies spread over groups, and the dealing depends on
neither the order in which rows come nor the number of tasks, so a task that is run again deals as before.

Defined results: a null or empty text has the end id alone; repeated rows are packed one by one; a null id is an id of its own;
equal lengths are ordered by id, start and checksum; an empty table gives no rows; columns other than doc_id and text
aren't read, whatever their names. A text of any length is cut into as many pieces as it needs.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import give_back, lean, table

WIDTH = 2048
#: Documents in a group, about.
GROUP_DOCS = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Chunks of text whose ids are kept in a worker, at most.
CACHE = 800_000
#: Characters of texts whose new chunks are encoded together.
AHEAD = 1 << 20
#: How the tokenizer normalises and splits, by its file.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: The same split of lower-case characters below 256, which NFC leaves as they are and of which none but white space is dropped.
PIECE = re.compile(r"[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|'(?:s|t|re|ve|m|ll|d)|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\x09-\x0d\x20\x85\xa0a-z0-9\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-\xff]+")
_word = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+").fullmatch
_narrow = re.compile(r"[\x00-\xff]*").fullmatch
#: Characters of byte-level models by byte, and the texts of characters below 256 in them.
BYTES = {b: chr(b) for b in (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))}
BYTES |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in BYTES)}
LEVEL = {k: "".join(BYTES[b] for b in chr(k).encode()) for k in range(256)}

_encoders: dict[str, "ChunkEncoder"] = {}


def narrow_model(path: str):
    """The tokenizer's model alone, which takes pieces as PIECE splits them, and whether an id ends a piece. None if the file isn't of the known form."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, splits = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    if (spec["normalizer"] or {}).get("normalizers") != NORMALIZERS or len(splits) != 2 or any(not t["content"].startswith("<|") for t in spec["added_tokens"]):
        return None
    if splits[0] != {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True} or splits[1]["type"] != "ByteLevel" or splits[1]["add_prefix_space"] or splits[1]["use_regex"]:
        return None
    if model["type"] != "BPE" or model["end_of_word_suffix"] != WORD_END or any(c + end not in model["vocab"] for c in BYTES.values() for end in ("", WORD_END)):
        return None
    ends = np.zeros(max(model["vocab"].values()) + 1, bool)
    ends[[k for t, k in model["vocab"].items() if t.endswith(WORD_END)]] = True
    return Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": None, "post_processor": None, "added_tokens": []})), ends


def lowered(text: str) -> str:
    """The text in lower case if its characters are below 256, where that is what the tokenizer does, and it can't hold a special token."""
    if "<|" in text:
        return text
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
    return text.lower()


class ChunkEncoder:
    """Ids of texts by a tokenizer that never joins what white space separates, with repeated chunks looked up.

    Chunks of characters below 256 are lower-cased and split as the tokenizer does, and only pieces that aren't known go through its
    model. All other chunks, and those that may hold a special token, go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = narrow_model(path)
        give_back()  # the vocabulary as Python read it
        self.known: dict[str, bytes] = {}

    @staticmethod
    def of(path: str) -> "ChunkEncoder":
        if path not in _encoders:
            _encoders[path] = ChunkEncoder(path)
        return _encoders[path]

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. New chunks of some texts at a time are encoded together."""
        some, size = [], 0
        for k, text in enumerate(texts):
            some.append(text)
            size += len(text)
            if size >= AHEAD or k + 1 == len(texts):
                yield from self.some_ids(some)
                some, size = [], 0

    def some_ids(self, texts: list[str]) -> Iterator[bytes]:
        if self.model:
            # a stop or comma between a letter and a space is a piece of its own
            spaced = pc.replace_substring(pa.array([lowered(t) for t in texts], pa.string()), "\n", " ")
            spaced = pc.replace_substring_regex(spaced, r"([a-z])([.,]) ", r"\1 \2 ")
        else:
            spaced = pc.replace_substring(pa.array(texts, pa.string()), "\n", " ")
        split = pc.split_pattern(spaced, " ")
        coded = split.flatten().dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn(chunks)
        own = [self.known[c] for c in chunks]
        ids = np.frombuffer(b"".join(own), "<u4")
        size = np.fromiter(map(len, own), np.int64, len(own)) // 4
        start = np.cumsum(size) - size
        chunk = coded.indices.to_numpy()
        n = size[chunk]
        after = np.cumsum(n)
        at = np.repeat(start[chunk] - (after - n), n)
        at += np.arange(len(at))
        data = ids[at].tobytes()
        cuts = np.r_[0, after][split.offsets.to_numpy()].tolist()
        for a, b in zip(cuts, cuts[1:]):
            yield data[4 * a : 4 * b]

    def learn(self, chunks: list[str]) -> None:
        """Makes different chunks known."""
        known = self.known
        new = [c for c in chunks if c not in known]
        if len(known) + len(new) > CACHE:
            known = self.known = {c: known[c] for c in chunks if c in known}
        if not self.model:
            self.encode(new)
            return
        whole, pieces, split = [], set(), {}
        for c in new:
            if _word(c):
                pieces.add(c)
            elif "<|" in c or not _narrow(c):
                whole.append(c)
            else:
                split[c] = parts = PIECE.findall(c.lower())
                pieces.update(parts)
        self.encode(whole)
        self.encode_pieces([p for p in pieces if p not in known])
        for c, parts in split.items():
            known[c] = b"".join([known[p] for p in parts])

    def encode(self, new: list[str]) -> None:
        """Chunks by the whole tokenizer. One call for all: as words of one text, each is normalised and split by itself."""
        if new:
            got = self.tok.encode(new, is_pretokenized=True, add_special_tokens=False)
            ids, word = np.array(got.ids, "<u4"), np.array(got.word_ids, np.int64)
            self.keep(new, ids, np.searchsorted(word, np.arange(len(new) + 1)))

    def encode_pieces(self, new: list[str]) -> None:
        """Pieces by the model alone. One call for all: the last id of each piece, and no other, is one that ends a piece."""
        if new:
            model, ends = self.model
            given = [p if p.isascii() and p.isprintable() else p.translate(LEVEL) for p in new]
            ids = np.array(model.encode_batch_fast([given], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
            self.keep(new, ids, np.r_[0, np.flatnonzero(ends[ids]) + 1])

    def keep(self, new: list[str], ids: np.ndarray, cuts: np.ndarray) -> None:
        if len(cuts) != len(new) + 1 or cuts[-1] != len(ids):
            raise ValueError(f"{len(cuts) - 1} encoded pieces of {len(new)}")
        data, cuts = ids.tobytes(), cuts.tolist()
        self.known.update((c, data[4 * i : 4 * j]) for c, i, j in zip(new, cuts, cuts[1:]))


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut(ids: bytes, width: int = WIDTH) -> Iterator[tuple[int, int, int]]:
    """(start, length, checksum) of each piece."""
    for k in range(0, len(ids), 4 * width):
        piece = ids[k : k + 4 * width]
        yield k // 4, len(piece) // 4, zlib.crc32(piece)


def first_fit_decreasing(lengths: Iterable[int], width: int = WIDTH) -> list[int]:
    """The bin of each length, lengths given in falling order. The tree's root knows the most room that any bin has."""
    lengths = list(lengths)
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    room = [width] * (2 * leaves)
    out = []
    for n in lengths:
        k = 1
        while k < leaves:
            k *= 2
            if room[k] < n:
                k += 1
        out.append(k - leaves)
        room[k] -= n
        while k > 1:
            k //= 2
            a, b = room[2 * k], room[2 * k + 1]
            room[k] = a if a >= b else b
    return out


def pieces(docs: DataFrame, groups: int, path: str, width: int = WIDTH, remember: bool = True) -> DataFrame:
    """A row for each piece of each document (doc_id, text), with its group. remember: chunks stay known to a worker's later tasks."""

    def run(batches):
        encoder = ChunkEncoder.of(path)
        for batch in batches:
            sizes, crcs = [], []
            for ids in encoder.ids([t or "" for t in batch.column(1).to_pylist()]):
                ids += END_ID.to_bytes(4, "little")
                sizes.append(len(ids) // 4)
                crcs.append([crc for _, _, crc in cut(ids, width)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["doc_id", "doc_tokens", "crcs"])
        if not remember:
            encoder.known.clear()

    own = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run if remember else lean(run), "doc_id long, doc_tokens long, crcs array<long>")
    rows = own.groupBy("doc_id", "doc_tokens", "crcs").agg(F.count("*").alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    rows = rows.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "doc_tokens", "crcs", "copy"), F.lit(groups)))
    rows = rows.select("doc_id", "doc_tokens", "pack_group", F.posexplode("crcs").alias("k", "ids_crc32")).withColumn("start", F.col("k").cast("long") * width)
    return rows.select("doc_id", "start", F.least(F.lit(width), F.col("doc_tokens") - F.col("start")).alias("length"), "ids_crc32", "doc_tokens", "pack_group")


def pack(docs: DataFrame, rows: int, path: str | None = None, width: int = WIDTH, group_docs: int = GROUP_DOCS, remember: bool = True) -> DataFrame:
    """Pieces of the documents with their sequence and their offset in it."""

    def place(pdf):
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        seats = first_fit_decreasing(pdf["length"].tolist(), width)
        pdf = pdf.assign(sequence_id=[int(g) << 32 | s for g, s in zip(pdf["pack_group"], seats)])
        pdf["offset"] = pdf.groupby("sequence_id")["length"].cumsum() - pdf["length"]
        return pdf.drop(columns="pack_group")

    groups = max(1, -(-rows // group_docs))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return pieces(docs, groups, path or vocabulary_path(VOCABULARY), width, remember).groupBy("pack_group").applyInPandas(place, schema)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack(docs, docs.count())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as packed pieces. Workers stay for other stages, so they don't keep the chunks."""
    return pack(docs, docs.count(), remember=False)
