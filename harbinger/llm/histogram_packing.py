"""Shortest-pack-first packing over the histogram of lengths.

1. Texts are tokenised once, in tasks, and cut into full pieces and a rest; the pieces are
   stored in the shared folder with their place among the equally long pieces of the task.
2. The histogram of piece lengths (at most ``capacity`` rows) is packed, longest length
   first: a length goes to the shortest packs that exist, all packs of equal room at once,
   and opens packs only when none has room for it. A pattern is a run of pack numbers with
   equal contents and a count; placing splits a run and updates the two counts.
3. Every piece finds its pack from its rank among the pieces of its length.
4. Packs that would be padded by more than ``slack`` are filled: the emptiest of them, as
   many as the missing tokens need, are dissolved into a stream that runs through the gaps
   of the others; its end is cut into packs of powers of two, which need no padding.

The plan holds runs, not documents: its size follows the number of different lengths.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harbinger.llm.common import bound_batches, hit_filter, texts, with_hits
from harbinger.sources.shared import settle, shared_folder

CAPACITY = 4096
END_ID = 2
SLACK = 16
CHUNK_BYTES = 1 << 20
CACHE_WORDS = 1_000_000
SPACE = re.compile(rb"[\x20\x09-\x0D]")

STORED = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "part long, place long, piece long, ids binary"
)
OUT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
OUT_SCHEMA = ", ".join(f"{c} long" for c in OUT)


def _splitter(tokenizer):
    """The pattern that cuts a normalised word into the parts whose merges are separate.

    None unless the tokenizer's file says so: a normaliser that only lowers ASCII, a
    splitter that keeps its matches, and a byte alphabet after it.
    """
    says = json.loads(tokenizer.to_str())
    norms, steps = (
        (says.get(k) or {}).get(many) or [says.get(k) or {}]
        for k, many in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))
    )
    lowers = {"type": "Lowercase"} in norms and all(
        n in ({"type": "NFC"}, {"type": "Lowercase"}) or n.get("pattern") == {"Regex": r"\s+"} for n in norms
    )
    cuts = [s for s in steps if s.get("type") == "Split" and s.get("behavior") == "Removed" and s.get("invert")]
    bytewise = [s for s in steps if s.get("type") == "ByteLevel" and not s.get("use_regex") and not s.get("add_prefix_space")]
    if lowers and len(cuts) == len(bytewise) == 1 and steps == cuts + bytewise and "Regex" in cuts[0]["pattern"]:
        return regex.compile(cuts[0]["pattern"]["Regex"])
    return None


class ByteAlphabet(dict):
    """How a character is written in the byte alphabet, for ``str.translate``."""

    def __init__(self):
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.write = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str

    def __missing__(self, code: int) -> str:
        value = self[code] = "".join(part for part, _ in self.write(chr(code)))
        return value


class PartIds(dict):
    """Ids of a normalised part as little-endian bytes."""

    def __init__(self, model, form: str):
        super().__init__()
        self.tokenize, self.form, self.alphabet = model.tokenize, form, ByteAlphabet()

    def __missing__(self, part: str) -> bytes:
        ids = [t.id for t in self.tokenize(part if part.isascii() else part.translate(self.alphabet))]
        value = self[part] = struct.pack(f"<{len(ids)}{self.form}", *ids)
        return value


class WordIds(dict):
    """Ids of a word (bytes) as little-endian bytes; bounded between stretches of text.

    An unseen word of printable characters is put together from its parts, which are fewer
    than the words with glued punctuation; any other is left to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.form = "H" if self.dtype.itemsize == 2 else "I"
        self.splitter = _splitter(self.tokenizer)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts = PartIds(self.tokenizer.model, self.form)
        self.careful = False

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8")
        if self.splitter is None or not text.isprintable() or self.careful and any(t in word for t in self.added):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            value = struct.pack(f"<{len(ids)}{self.form}", *ids)
        else:
            text = text.lower() if text.isascii() else self.tokenizer.normalizer.normalize_str(text)
            parts = self.splitter.findall(text)
            value = self.parts[parts[0]] if len(parts) == 1 else b"".join([self.parts[p] for p in parts])
        self[word] = value
        return value

    def of(self, text: str | None) -> np.ndarray:
        """Ids of a whole text and the end id, read in stretches that end at white space."""
        raw = (text or "").encode("utf-8")
        self.careful = any(t in raw for t in self.added)
        out, at = bytearray(), 0
        while at < len(raw):
            cut = SPACE.search(raw, at + CHUNK_BYTES) if len(raw) - at > CHUNK_BYTES else None
            end = cut.start() if cut else len(raw)
            if max(len(self), len(self.parts)) > CACHE_WORDS:
                self.clear()
                self.parts.clear()
            out += b"".join(map(self.__getitem__, raw[at:end].split()))
            at = end
        out += struct.pack(f"<{self.form}", END_ID)
        return np.frombuffer(bytes(out), self.dtype)


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One table of known words for each Python worker, kept from task to task."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenised_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Full pieces and rest of every text, with ids, checksum and place in their task.

    The tokenizer must drop white space, so that the ids of a text are those of its words
    in order. ``place`` counts the pieces of equal length in the task ``part``.
    """
    bound_batches(docs.sparkSession)

    def run(batches):
        words = word_ids(tokenizer)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        number = part << 32
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                ids = words.of(text)
                for start in range(0, len(ids), capacity):
                    own = ids[start : start + capacity]
                    rows.append((doc_id, start, len(own), crc(own), len(ids), part, int(seen[len(own)]), number, own.tobytes()))
                    seen[len(own)] += 1
                    number += 1
            if rows:
                kinds = [pa.int64()] * 8 + [pa.binary()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in STORED.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, STORED)


def pack_histogram(counts: dict[int, int], capacity: int) -> tuple[list[tuple], list[tuple], int]:
    """(placements, runs, packs) for pieces counted by length.

    A placement (length, rank, count, pack, offset) puts the pieces of that length ranked
    from ``rank`` into ``count`` consecutive packs. A run (room, pack, count) is a pattern
    with its count: consecutive packs with the same contents and ``room`` tokens left.
    """
    runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    placements: list[tuple[int, int, int, int, int]] = []
    packs = 0
    for length in sorted(counts, reverse=True):
        left, rank, room = counts[length], 0, capacity
        while left:
            while room >= length and not runs[room]:
                room -= 1
            if room < length:
                room = capacity
                opened = -(-left // (capacity // length))
                runs[room].append((packs, opened))
                packs += opened
            pack, count = runs[room].pop()
            taken = min(count, left)
            if taken < count:
                runs[room].append((pack + taken, count - taken))
            placements.append((length, rank, taken, pack, capacity - room))
            runs[room - length].append((pack, taken))
            rank += taken
            left -= taken
    return placements, [(room, pack, count) for room, own in enumerate(runs) for pack, count in own], packs


def fill_gaps(runs: list[tuple], packs: int, capacity: int, slack: int) -> tuple[list[tuple], list[tuple]]:
    """(dissolved, gaps) that leave no pack padded by more than ``slack``.

    Dissolved runs are (pack, count, filled, base): the tokens of its packs follow each
    other in a stream from ``base``. Gaps are (base, pack, count, room, offset): the stream
    from ``base`` fills ``count`` packs by ``room`` tokens each.
    """
    def padded(room: int) -> bool:
        filled = capacity - room
        return room > slack and filled & (filled - 1) != 0

    waiting = sorted(run for run in runs if padded(run[0]))
    missing = sum(room * count for room, _, count in waiting)
    needed = -(-missing // capacity)  # a dissolved pack brings its tokens and takes its gap away
    dissolved, stream = [], 0
    while needed:
        room, pack, count = waiting.pop()
        taken = min(count, needed)
        if taken < count:
            waiting.append((room, pack + taken, count - taken))
        dissolved.append((pack, taken, capacity - room, stream))
        stream += taken * (capacity - room)
        needed -= taken
    gaps, base = [], 0
    for room, pack, count in waiting:
        gaps.append((base, pack, count, room, capacity - room))
        base += room * count
    rest = stream - base
    for power in range(capacity.bit_length(), -1, -1):
        if rest >> power & 1:
            gaps.append((base, packs, 1, 1 << power, 0))
            base += 1 << power
            packs += 1
    return dissolved, gaps


RANK_BITS = 44


def _places(placements: list[tuple], dissolved: list[tuple]):
    """A function from lengths and ranks to (pack, offset, place in the stream or -1)."""
    plan = np.array(sorted(placements), np.int64).reshape(-1, 5)
    key = (plan[:, 0] << RANK_BITS) + plan[:, 1]
    loose = np.array(sorted(dissolved), np.int64).reshape(-1, 4)

    def find(length: np.ndarray, rank: np.ndarray):
        row = plan[np.searchsorted(key, (length << RANK_BITS) + rank, "right") - 1]
        pack, offset = row[:, 3] + rank - row[:, 1], row[:, 4]
        stream = np.full(len(pack), -1, np.int64)
        if len(loose):
            own = loose[np.maximum(np.searchsorted(loose[:, 0], pack, "right") - 1, 0)]
            inside = (pack >= own[:, 0]) & (pack < own[:, 0] + own[:, 1])
            stream[inside] = (own[:, 3] + (pack - own[:, 0]) * own[:, 2] + offset)[inside]
        return pack, offset, stream

    return find


def _place_rows(ranked: DataFrame, find) -> DataFrame:
    def run(batches):
        for batch in batches:
            pack, offset, stream = find(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.array(v) for v in (pack, offset, stream)],
                [*kept, "sequence_id", "offset", "stream"],
            )

    kept = [c for c in ranked.columns if c != "rank"]
    return ranked.mapInArrow(run, ", ".join(f"{c} long" for c in [*kept, "sequence_id", "offset", "stream"]))


def _cut_rows(rows: DataFrame, gaps: list[tuple], dtype: str) -> DataFrame:
    """Pieces of the dissolved rows, cut where the gaps they flow into end."""
    table = np.array(gaps, np.int64).reshape(-1, 5)

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                ids, done = np.frombuffer(row["ids"], dtype), 0
                while done < len(ids):
                    at = row["stream"] + done
                    base, pack, _, room, offset = table[np.searchsorted(table[:, 0], at, "right") - 1].tolist()
                    which, inside = divmod(at - base, room)
                    own = ids[done : done + room - inside]
                    out.append(
                        (row["doc_id"], row["start"] + done, len(own), crc(own), row["doc_tokens"], pack + which, offset + inside)
                    )
                    done += len(own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], OUT)

    return rows.select("doc_id", "start", "doc_tokens", "stream", "ids").mapInArrow(run, OUT_SCHEMA)


def pack_tokens(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, slack: int = SLACK) -> DataFrame:
    """One row for each piece: the columns of OUT.

    ``start`` is the number of the document's ids before the piece, ``offset`` its place in
    the sequence ``sequence_id``; pieces follow each other without a gap from 0. A sequence
    holds at most ``capacity`` ids, and lacks more than ``slack`` only when its length is a
    power of two.

    Null and empty texts have the end id alone. Repeated rows, and rows that share an id or
    have none, are packed as often as they occur; equal lengths are told apart by task and
    place in it. A very long text fills as many sequences as it needs; an empty table gives
    no rows. ``docs`` needs doc_id and text; other columns are ignored.
    """
    if capacity < 1 or slack < 0:
        raise ValueError("capacity must be positive and slack not negative")
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/histogram-packing-{uuid.uuid4().hex}"
    tokenised_pieces(docs, tokenizer, capacity).write.parquet(folder)
    stored = spark.read.parquet(folder)

    by_part = settle(stored.groupBy("length", "part").agg(F.count("*").alias("n")))
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placements, runs, packs = pack_histogram(counts, capacity)
    dissolved, gaps = fill_gaps(runs, packs, capacity, slack)

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = stored.drop("ids").join(offsets, ["length", "part"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "piece", (F.col("place") + F.col("before")).alias("rank")
    )
    placed = settle(_place_rows(ranked, _places(placements, dissolved)))
    whole = placed.where("stream < 0").select(*OUT)
    loose = placed.where("stream >= 0")
    ids = with_hits(stored.select("piece", "ids"), "piece", hit_filter(loose, "piece")).where("_hit").drop("_hit")
    dtype = WordIds(tokenizer).dtype.str
    return whole.union(_cut_rows(loose.join(ids, "piece"), gaps, dtype))
