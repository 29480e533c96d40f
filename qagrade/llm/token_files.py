"""Token ids as compressed binary blocks: canonical length-limited Huffman codes.

Texts are encoded once by a tokenizer file and kept as a table. Counts of all ids give one code
for the whole corpus (package-merge, so no code is longer than the limit). Documents are dealt
by ranges of their ids, so files and blocks ascend; a block holds whole documents of about
`BLOCK_IDS` ids, can be read alone, and has the bit offset of every `CHECKPOINT`-th id, from
which all its segments are decoded together, one table look-up a step.

The files are a folder that can be read alone, in any store that Spark reads. `blocks` is a Parquet
table: `part` and `block` give the order, `start` the ids before the block in its part, `doc_ids` and
`lengths` the documents, `offsets` the checkpoints, `payload` the bits. `lengths` is the code, as the
bits of each id: codes are canonical, so nothing else is needed.

Texts are encoded as the library encodes them: the strings of added tokens in a text are those tokens.

Defined results: NULL and empty texts hold the end id alone; NULL doc_ids come first; equal
doc_ids are ordered by their ids; an empty table has no blocks; other columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from qagrade.llm.common import buffers, discard, narrow, ship, stored, worker_cache
from qagrade.sources.scratch import scoped, scratch_path

BLOCK_IDS = 1 << 18
CHECKPOINT = 128
PART_IDS = 8 << 20
MEMO_ENTRIES = 900_000
#: A sign of its own, whose id no other text has.
_MARK = "\x7f"
#: Signs that a tokenizer parts from the letter or digit before them.
_SIGNS = ".,;:!?*$%&#|"
#: Letters that are lower-case and in normal form: any stretch of them is one word of its own.
_LETTERS = "".join(map(chr, [*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)]))
_is_letters = re.compile(f"[{_LETTERS}]+").fullmatch
#: Up to here lower case is one letter for one, and there are no marks to combine.
_beyond = re.compile("[^\x00-\u012f]").search
_WORKER: dict[str, CachedTokenizer] = worker_cache()


# --- ids -----------------------------------------------------------------------------------


class CachedTokenizer:
    """Ids of whole texts, by a memo of the stretches between white space.

    Arrow splits a column of texts at ASCII white space and numbers its distinct stretches, of which
    each is looked up once a column. Texts with an added token, or with characters that some take for
    white space and tokenizer files do not, are left to the library whole. It needs a tokenizer that drops
    white space and never joins what stands on both sides of it; `splits_at_space` holds for those.
    """

    def __init__(self, file: str, kind: str):
        self.model = Tokenizer.from_str(file)
        self.kind = kind
        # added tokens are found in whole texts, before anything is split
        added = [re.escape(t.content) for t in self.model.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(["[\x1c-\x1f]", *added]), re.IGNORECASE).search
        first = {t.content[0] for t in self.model.get_added_tokens_decoder().values()}
        # few texts have a sign that one begins with; letters have other cases, so all texts are searched then
        self.first = ["\x1c", "\x1d", "\x1e", "\x1f", *sorted(first)] if all(x.isascii() and not x.isalpha() for x in first) else [""]
        self.mark = self.model.encode(_MARK, add_special_tokens=False).ids
        if len(self.mark) != 1:
            raise ValueError("the tokenizer needs one id for the character 127")
        self.mark = self.mark[0]
        self.letters = _letter_model(file, self.model, self.mark)
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.long: list[str] = []

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Ids of stretches without white space: one text of many, taken apart at a mark."""
        out = self._merged([t for t in texts if _is_letters(t)]) if self.letters else {}
        others = [t for t in texts if t not in out] if out else texts
        out |= self._joined([t for t in others if _MARK not in t])
        out |= {t: self._whole(t) for t in others if _MARK in t}
        return [out[t] for t in texts]

    def _merged(self, words: list[str]) -> dict[str, bytes]:
        """Ids of stretches of plain letters, each a word of its own, by the file's merges."""
        merges, flat, ends = self.letters.model.tokenize, [], [0]
        for word in _byte_letters(" ".join(words)).split(" ") if words else ():
            flat += [x.id for x in merges(word)]
            ends.append(len(flat))
        ids = np.array(flat, self.kind)
        packed, width = ids.tobytes(), ids.itemsize
        return {t: packed[width * a : width * b] for t, a, b in zip(words, ends[:-1], ends[1:], strict=True)}

    def _joined(self, texts: list[str]) -> dict[str, bytes]:
        if not texts:
            return {}
        text = f" {_MARK} ".join([*texts, ""])
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
        cut = np.flatnonzero(ids == self.mark)
        packed, width = ids.tobytes(), ids.itemsize
        ends, starts = cut.tolist(), [0, *(cut + 1).tolist()]
        return {t: packed[width * a : width * b] for t, a, b in zip(texts, starts[:-1], ends, strict=True)}

    def _whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _learn(self, new: list[str]) -> None:
        """Put stretches into the memo; those that end in plain signs by their two parts."""
        memo, old = self.memo, self.old
        ask, parts = set(), []
        for x in new:
            if len(x) > 256:
                self.long.append(x)
            ids = old.get(x)
            if ids is not None:
                memo[x] = ids
                continue
            low = x.lower() if x.isascii() or self.letters and not _beyond(x) else x
            core = low.rstrip(_SIGNS)
            if core == x:
                ask.add(x)
                continue
            if core and not _parts(core[-1]):
                core = low
            tail = low[len(core) :]
            parts += x, core, tail
            for y in (core, tail):
                if y and y not in memo:
                    if y in old:
                        memo[y] = old[y]
                    else:
                        ask.add(y)
        memo.update(zip(ask, self._encode(list(ask)), strict=True))
        memo[""] = b""
        for x, core, tail in zip(parts[::3], parts[1::3], parts[2::3], strict=True):
            memo[x] = memo[core] + memo[tail]

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encode_column(pa.array(texts, pa.string())).to_pylist()

    def encode_column(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        """The ids of each text, and `end`, as bytes; NULL is the empty text."""
        if len(self.memo) > MEMO_ENTRIES:
            self.memo, self.old = {}, self.memo
        memo = self.memo
        whole = {i: t for i, t in enumerate(texts.to_pylist()) if t and any(x in t for x in self.first) and self.added(t)}
        parts = pc.ascii_split_whitespace(pc.if_else(self._plain(texts), pc.ascii_lower(texts), texts))
        if whole:
            parts = pc.if_else(pa.array([i not in whole for i in range(len(texts))]), parts, None)
        found = parts.flatten().dictionary_encode()
        words = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(memo.get, words))
        new = [i for i, x in enumerate(ids) if x is None]
        if new:
            self._learn([words[i] for i in new])
            for i in new:
                ids[i] = memo[words[i]]
        # each text ends with an entry of its own: the end, or all ids of a text that is left whole
        ids.append(end)
        last = np.full(len(texts), len(words))
        for i, text in whole.items():
            last[i] = len(ids)
            ids.append(self._whole(text) + end)
        stops = np.cumsum(pc.fill_null(pc.list_value_length(parts), 0).to_numpy())
        places = np.insert(found.indices.to_numpy().astype(np.int64), stops, last)
        taken = pa.array(ids, pa.binary()).take(pa.array(places))
        _, at, data = taken.buffers()
        bounds = np.frombuffer(at, np.int32)[np.concatenate([[0], stops + np.arange(1, len(texts) + 1)])]
        while self.long:  # very long stretches are not kept
            x = self.long.pop()
            for y in (x, x.lower(), x.lower().rstrip(_SIGNS), x.rstrip(_SIGNS)):
                memo.pop(y, None)
        return pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(bounds.tobytes()), data])

    @staticmethod
    def _plain(texts: pa.Array) -> pa.Array:
        """Whether a text has no sign beyond those of one or two bytes that begin below 0xC4: plain letters
        with no marks to combine, of which A-Z can be lowered before all else."""
        offsets, data = buffers(texts)
        high = np.flatnonzero(data[offsets[0] : offsets[-1]] >= 0xC4) + offsets[0]
        return pa.array(np.diff(np.searchsorted(high, offsets, "left")) == 0)


def _byte_signs() -> str:
    """The character that byte-level tokenizer files write for each byte, but the space itself."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    signs = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return "".join(signs[b] if b != 32 else " " for b in range(256))


_SIGN_OF_BYTE = _byte_signs()


def _byte_letters(text: str) -> str:
    return codecs.charmap_decode(text.encode(), "strict", _SIGN_OF_BYTE)[0]


def _letter_model(file: str, model: Tokenizer, mark: int) -> Tokenizer | None:
    """The file's own model without its normal form and its splits, which leave `_LETTERS` as they
    are, told by examples; None where that does not hold."""
    parts = json.loads(file)
    steps = [parts.get(k) or {} for k in ("normalizer", "pre_tokenizer")]
    forms, splits = ([x, *x.get("normalizers", x.get("pretokenizers", []))] for x in steps)
    plain = {None, "Sequence", "NFC", "Lowercase"}
    if any(x.get("type") not in plain and x.get("pattern") != {"Regex": "\\s+"} for x in forms):
        return None
    if splits[-1].get("type") != "ByteLevel":
        return None
    parts |= {"normalizer": None, "post_processor": None, "pre_tokenizer": {"type": "WhitespaceSplit"}}
    own, rng = Tokenizer.from_str(json.dumps(parts)), random.Random(0)
    examples = [*_LETTERS, *("".join(rng.choices(_LETTERS, k=rng.randint(2, 12))) for _ in range(400))]
    one = lambda m, t: m.encode(t, add_special_tokens=False).ids
    cases = {x: x.upper() for x in _LETTERS if x.upper().lower() == x}
    same = all(one(own, _byte_letters(t)) == one(model, t) == one(model, "".join(cases.get(x, x) for x in t)) for t in examples)
    return own if same and one(own, _byte_letters(_MARK)) == [mark] else None


def _parts(last: str) -> bool:
    """Whether a sign after this character begins anew: plain letters and digits, whose normal and
    lower-case forms end in a letter or digit too."""
    return last.isascii() and last.isalnum() or "\xc0" <= last < "\u0130" and last.isalpha()


def splits_at_space(model: Tokenizer) -> bool:
    """Whether a text's ids are those of its stretches between white space, by an example."""
    one = lambda t: model.encode(t, add_special_tokens=False).ids
    whole, parts = "AB, c1\n\n dé (e) f*** 2.", ("ab", ",", "c1", "dé", "(e)", "F", "***", "2", ".")
    return one(whole) == [i for x in parts for i in one(x)]


def encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, n and ids (binary) of every text, with the end id."""
    with open(path, encoding="utf-8") as lines:
        file = lines.read()
    model = Tokenizer.from_str(file)
    if not splits_at_space(model):
        raise ValueError("the tokenizer has to drop white space and split at it")
    kind = "<u2" if max(model.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    end, key = np.array([end_id], kind).tobytes(), hashlib.sha256(file.encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(file)
    width = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _WORKER:
            _WORKER.clear()
            _WORKER[key] = CachedTokenizer(shared.value, kind)
        model = _WORKER[key]
        for batch in batches:
            if batch.num_rows:
                ids = model.encode_column(batch.column(1), end)
                n = pc.divide(pc.binary_length(ids), width).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), n, ids], ["doc_id", "n", "ids"])

    doc = docs.schema["doc_id"].dataType.simpleString()
    out = narrow(docs, "doc_id", "text").mapInArrow(run, f"doc_id {doc}, n long, ids binary")
    out = stored(out, "ids", compression="zstd")
    out._id_kind = kind
    return out


def id_counts(ids: DataFrame) -> np.ndarray:
    """How often each id occurs; at most as many rows as the vocabulary come to the driver."""
    kind = ids._id_kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            column = batch.column(0)
            _, at, data = column.buffers()
            at = np.frombuffer(at, np.int32)[column.offset : column.offset + len(column) + 1]
            if not len(column) or at[0] == at[-1]:
                continue
            own = np.bincount(np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind))
            size = max(len(own), len(total))
            total = np.pad(own, (0, size - len(own))) + np.pad(total, (0, size - len(total)))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "count"])

    rows = ids.select("ids").mapInArrow(run, "id long, count long").groupBy("id").agg(F.sum("count").alias("count"))
    table = rows.toArrow()
    out = np.zeros(int(max(table["id"].to_pylist(), default=-1)) + 1, np.int64)
    out[table["id"].to_numpy()] = table["count"].to_numpy()
    return out


# --- the code ------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits; 0 for ids that do not occur."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of that length")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, row = [], leaves
    levels.append(np.ones(len(leaves), bool))
    for _ in range(limit - 1):  # pair the cheapest of the level below, then mix with the leaves
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        by = np.argsort(both, kind="stable")
        row = both[by]
        levels.append(by < len(leaves))
    take = 2 * len(order) - 2
    for is_leaf in reversed(levels):
        own = int(is_leaf[:take].sum())
        lengths[order[:own]] += 1
        take = 2 * (take - own)
    return lengths


class Code:
    """Canonical code of given lengths: shorter codes first, equal lengths by id."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        self.bits = int(max(lengths, default=0)) or 1
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        self.codes = np.zeros(len(lengths), np.int64)
        step = np.left_shift(1, self.bits - lengths[order])  # room of each code in the table
        begin = np.concatenate([[0], np.cumsum(step)])
        self.codes[order] = begin[:-1] >> (self.bits - lengths[order])
        self.table = np.zeros(1 << self.bits, np.int64)
        filled = np.repeat(order << 6 | lengths[order], step)
        self.table[: len(filled)] = filled

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bits of the ids, and the bit at which every CHECKPOINT-th begins."""
        ids = ids.astype(np.int64)
        size = self.lengths[ids]
        end = np.cumsum(size)
        at = end - size
        total = int(end[-1]) if len(end) else 0
        unit, word = at >> 4, self.codes[ids] << (48 - size - (at & 15))
        n = (total >> 4) + 4
        units = np.zeros(n, np.int64)
        for k, shift in enumerate((32, 16, 0)):  # bits never overlap, so sums are unions
            units += np.bincount(unit + k, weights=(word >> shift) & 0xFFFF, minlength=n).astype(np.int64)
        return units.astype(">u2").tobytes(), at[::CHECKPOINT]

    def unpack(self, payload: bytes, offsets: np.ndarray, n: int) -> np.ndarray:
        """The `n` ids of a payload: all segments advance together, one id a step."""
        units = np.frombuffer(payload, ">u2").astype(np.int64)
        units = np.concatenate([units, np.zeros(3, np.int64)])
        wide = units[:-2] << 32 | units[1:-1] << 16 | units[2:]
        at = np.array(offsets, np.int64)
        out = np.zeros((len(at), CHECKPOINT), np.int64)
        last, mask = n - CHECKPOINT * (len(at) - 1), (1 << self.bits) - 1
        for step in range(min(n, CHECKPOINT)):
            if step == last:  # the last segment is shorter
                at = at[:-1]
            found = self.table[wide[at >> 4] >> (48 - self.bits - (at & 15)) & mask]
            out[: len(at), step] = found >> 6
            at = at + (found & 63)
        return out.reshape(-1)[:n]


def make_code(counts: np.ndarray) -> Code:
    used = int((counts > 0).sum())
    return Code(code_lengths(counts, max(16, used.bit_length() + 2)))


# --- blocks --------------------------------------------------------------------------------

BLOCK_SCHEMA = (
    "part int, block int, start long, n long, doc_ids array<{doc}>, lengths array<long>, "
    "offsets array<long>, payload binary"
)


def write_files(ids: DataFrame, path: str) -> None:
    """Write the blocks of a table of ids, in ascending doc_id order, and their code to a folder."""
    code = make_code(id_counts(ids))
    used = np.flatnonzero(code.lengths)
    # one row an id that occurs: as many as the vocabulary at most
    lengths = pa.table({"id": pa.array(used, pa.int32()), "length": pa.array(code.lengths[used], pa.int32())})
    ids.sparkSession.createDataFrame(lengths).coalesce(1).write.parquet(f"{path}/lengths")
    _blocks(ids, code).write.option("compression", "none").parquet(f"{path}/blocks")


def _blocks(ids: DataFrame, code: Code) -> DataFrame:
    kind, shared = ids._id_kind, ids.sparkSession.sparkContext.broadcast(code)
    total = ids.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // PART_IDS), min(total // BLOCK_IDS, ids.sparkSession.sparkContext.defaultParallelism))
    schema = BLOCK_SCHEMA.format(doc=ids.schema["doc_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start, code = TaskContext.get().partitionId(), 0, 0, shared.value
        docs: list = []
        held: list[bytes] = []
        lengths: list[int] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, start
            payload, offsets = code.pack(np.frombuffer(b"".join(held), kind))
            row = [[part], [block], [start], [sum(lengths)], [docs], [lengths], [offsets.tolist()], [payload]]
            block, start = block + 1, start + sum(lengths)
            return pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(row, types, strict=True)],
                ["part", "block", "start", "n", "doc_ids", "lengths", "offsets", "payload"],
            )

        types = None
        for batch in batches:
            if types is None:
                longs = pa.list_(pa.int64())
                own = pa.list_(batch.schema.field(0).type)
                types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), own, longs, longs, pa.binary()]
            for doc, n, x in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                docs.append(doc)
                lengths.append(n)
                held.append(x)
                size += n
                if size >= BLOCK_IDS:
                    yield flush()
                    docs, held, lengths, size = [], [], [], 0
        if docs:
            yield flush()

    dealt = ids.repartitionByRange(int(parts), "doc_id").sortWithinPartitions("doc_id", "n", "ids")
    return dealt.mapInArrow(run, schema)


def read_code(spark: SparkSession, path: str) -> Code:
    """The code of written files."""
    rows = spark.read.schema("id int, length int").parquet(f"{path}/lengths").toArrow()
    lengths = np.zeros(max(rows["id"].to_pylist(), default=-1) + 1, np.int64)
    lengths[rows["id"].to_numpy()] = rows["length"].to_numpy()
    return Code(lengths)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary, unsigned 32-bit) of the
    documents in written files."""
    ship(spark)
    blocks = spark.read.parquet(f"{path}/blocks")
    shared = spark.sparkContext.broadcast(read_code(spark, path))
    # One total for each part, of which there are as many as write tasks.
    totals = blocks.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").toArrow().to_pydict()
    before = dict(zip(totals["part"], np.concatenate([[0], np.cumsum(totals["n"])])[:-1].astype(int).tolist(), strict=True))
    starts = spark.sparkContext.broadcast(before)
    doc = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, before = shared.value, starts.value
        for batch in batches:
            for i in range(batch.num_rows):
                part, first, n, docs, lengths, offsets, payload = (c[i].as_py() for c in batch.columns)
                ids = code.unpack(payload, np.array(offsets), n).astype("<u4").tobytes()
                at = np.concatenate([[0], np.cumsum(lengths)])
                begin = (at[:-1] + before[part] + first).tolist()
                own = [ids[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                kinds = batch.schema.field(3).type.value_type
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, kinds), pa.array(begin, pa.int64()), pa.array(lengths, pa.int64()), pa.array(own, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    columns = blocks.select("part", "start", "n", "doc_ids", "lengths", "offsets", "payload")
    return columns.mapInArrow(run, f"doc_id {doc}, start long, n_tokens long, ids binary")


def with_crc32(read: DataFrame) -> DataFrame:
    """Digest of each document's ids; Spark's crc32 is the unsigned one."""
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@scoped
def files_round_trip(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Write the files of all documents to the shared folder and read them back."""
    files = scratch_path(docs.sparkSession, "llm-token-files")
    ids = encoded(docs, path, end_id)
    write_files(ids, files)
    discard(ids)
    return read_files(docs.sparkSession, files)
