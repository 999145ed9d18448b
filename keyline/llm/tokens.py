"""Token-ID output: Parquet list columns with delta encoding, written in key order.

Texts are encoded with a ``tokenizers`` file, an end id is appended, and the ids go
to Parquet through Spark's own committing writer: delta (or dictionary) encoding,
bounded row groups and pages, and a page index, so a reader can fetch the lengths of
all documents, or the tokens of a few, without reading the rest. Rows are range
partitioned by key; files and rows in them ascend by key.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .memory import lean
from .storage import CLEANUP, Scratch, setting
from .words import groups, mix, utf8

#: Distinct words and pieces that a task remembers; then it starts afresh.
CACHE_WORDS, CACHE_PIECES = 600_000, 400_000
#: Longer words are encoded anew each time.
LONGEST = 64

#: Words of printable ASCII and Latin letters without special lower-case forms.
PLAIN = re.compile("[\x21-\x7e\u00c0-\u012f\u0131-\u017f]+")
#: Those of letters, with only signs behind them: two pieces.
LETTERS_SIGNS = "^(?P<s>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+)(?P<r>[!-/:-@\\[-`{-~\u00d7\u00f7]*)$"

#: Options of the writer: v2 pages give DELTA_BINARY_PACKED integers.
DELTA = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false"}
DICTIONARY = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "true"}

FILE_SCHEMA = "part int, seq long, {key} long, n_tokens long, before long, ids array<int>"

_encoders: dict[str, WordEncoder] = {}
_U = np.uint64


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices first, first + 1, ... of each run, one run after another."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - size), size)


class Memory:
    """Ids of short strings by 128 bits of multilinear hashes of their bytes.

    Strings beyond ``LONGEST`` bytes are never kept. All ids lie in one array.
    """

    _rng = np.random.Generator(np.random.PCG64(77))
    _byte = _rng.integers(1, 2**63, (2, 256), dtype=_U) * _U(2) + _U(1)
    _place = _rng.integers(1, 2**63, (2, LONGEST), dtype=_U) * _U(2) + _U(1)

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.hash, self.check = np.zeros(0, _U), np.zeros(0, _U)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, "<i4"), 0

    def __len__(self) -> int:
        return len(self.hash)

    def hashes(self, strings: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both hashes, and whether a string is short enough to be kept."""
        data, where = utf8(strings)
        size = np.diff(where)
        short = size <= LONGEST
        size = np.where(short, size, 0)
        flat = data[spread(where[:-1], size)]
        place = spread(np.zeros(len(size), np.int64), size)
        some = np.flatnonzero(size)
        starts = (np.cumsum(size) - size)[some]
        out = []
        for byte, by_place in zip(self._byte, self._place, strict=True):
            half = mix(size.astype(_U))
            if len(some):
                half[some] ^= mix(np.add.reduceat(byte[flat] * by_place[place], starts))
            out.append(half)
        return out[0], out[1], short

    def find(self, hashed: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Place in ``ids`` and number of ids; place -1 where a string is not known."""
        h, check, short = hashed
        at, size = np.full(len(h), -1), np.zeros(len(h), np.int64)
        if len(self):
            i = np.minimum(np.searchsorted(self.hash, h), len(self) - 1)
            known = short & (self.hash[i] == h) & (self.check[i] == check)
            at[known], size[known] = self.at[i[known]], self.size[i[known]]
        return at, size

    def append(self, ids: np.ndarray) -> int:
        """Put ids behind the others; where they begin."""
        begin = self.used
        self.used += len(ids)
        if self.used > len(self.ids):
            grown = np.zeros(1 << int(self.used).bit_length(), "<i4")
            grown[:begin] = self.ids[:begin]
            self.ids = grown
        self.ids[begin : self.used] = ids
        return begin

    def keep(self, hashed: tuple[np.ndarray, np.ndarray, np.ndarray], at: np.ndarray, size: np.ndarray) -> None:
        """Remember distinct strings that were not known."""
        h, check, short = hashed
        new, first = np.unique(h[short], return_index=True)
        place = np.searchsorted(self.hash, new)
        if len(self):  # one string a hash; another one is not kept
            free = self.hash[np.minimum(place, len(self) - 1)] != new
            new, first, place = new[free], first[free], place[free]
        rows = np.flatnonzero(short)[first]
        self.hash = np.insert(self.hash, place, new)
        self.check = np.insert(self.check, place, check[rows])
        self.at, self.size = np.insert(self.at, place, at[rows]), np.insert(self.size, place, size[rows])


class WordEncoder:
    """Encodes texts word by word, remembering words and their pieces.

    The tokenizer's pre-tokens never reach over white space, and its normaliser
    (NFC, white-space folding, lower case) works on either side of it alone. So the
    ids of a text are those of its runs of non-blank characters in order, and each
    distinct run needs the library only once. Splitting at ASCII blanks alone is
    enough: other white space stays inside a run, which the library then splits.
    Arrow splits the texts and numbers their distinct words; those met before are
    found by their hashes in numpy.
    :meth:`WordEncoder.check` verifies this for a tokenizer file; else whole texts are
    encoded.

    A word of letters with signs behind them, or neither, is cut into these two pieces
    by Arrow; other runs of plain letters and signs (``PLAIN``, where every Unicode
    version agrees) by the file's own pattern. The library's model encodes pieces not
    met before, thousands a call, so that it meets 'the', 'The' and 'the,' once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.known, self.pieces = Memory(), Memory()
        self.pattern, self.suffix = self._piece_pattern()
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        # the two bytes that stand for each one of Latin letters
        to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.to_bytes = np.stack([np.arange(256, dtype=np.uint8), np.zeros(256, np.uint8)])
        for c in map(chr, range(0xC0, 0x180)):
            for byte, sign in zip(c.encode(), to_bytes.pre_tokenize_str(c)[0][0], strict=True):
                self.to_bytes[:, byte] = list(sign.encode())
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if self.suffix and token.endswith(self.suffix)]] = True
        self.by_word = self.check()

    def forget(self) -> None:
        """Drop what was remembered."""
        self.known.clear()
        self.pieces.clear()

    def _piece_pattern(self):
        """The pre-token pattern, if the file's pipeline is lower case, split, byte level, and
        what the model puts behind the last token of a pre-token."""
        import json

        import regex

        said = json.loads(self.tokenizer.to_str())
        steps = [n["type"] for n in (said["normalizer"] or {}).get("normalizers", [])]
        cut = (said["pre_tokenizer"] or {}).get("pretokenizers", [])
        if steps != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cut] != ["Split", "ByteLevel"]:
            return None, None
        split, level = cut
        plain = split["behavior"] == "Removed" and split["invert"] and not level["add_prefix_space"] and not level["use_regex"]
        pattern = regex.compile(split["pattern"]["Regex"]) if plain and "Regex" in split["pattern"] else None
        return pattern, said["model"].get("end_of_word_suffix")

    def check(self) -> bool:
        """Whether words can be encoded one by one, tried on a probe of hard cases."""
        probe = "Ab c'd  é\n\tΑΣ ΣΑ 12,3 x <|y|> \u0301z ß It's ÀÉ×÷ŉ a__b the, End. Ça. x, ''S l'été I\u0307 \u0130"
        whole = self.tokenizer.encode(probe, add_special_tokens=False).ids
        return self._by_words(pa.array([probe]), np.zeros(0, "<i4"))[0].tolist() == whole

    def _cut(self, words: list[str]) -> tuple[dict[str, list[str]], list[str]]:
        """Pre-tokens of plain words, and the other words."""
        plain, other, find = {}, [], self.pattern.findall
        for w in words:
            if "<|" in w or not PLAIN.fullmatch(w):
                other.append(w)
            else:
                plain[w] = find(w.lower())
        return plain, other

    def _piece_ids(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of pieces (lower case) lie in ``self.pieces``, and how many there are."""
        coded = pieces.dictionary_encode()
        hashed = self.pieces.hashes(coded.dictionary)
        at, size = self.pieces.find(hashed)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new], size[new] = self._encode_pieces(coded.dictionary.take(pa.array(new)))
            self.pieces.keep(tuple(x[new] for x in hashed), at[new], size[new])
        of = coded.indices.to_numpy()
        return at[of], size[of]

    def _joined(self, pieces: pa.StringArray) -> bytes:
        """Pieces as the model sees them, byte by byte, with a blank behind each."""
        data, where = utf8(pieces)
        data = np.insert(data, where[1:], 32)
        wide = data > 0x7F
        ends = np.cumsum(1 + wide)
        out = np.empty(int(ends[-1]), np.uint8)
        out[ends - 1 - wide] = self.to_bytes[0, data]
        out[ends[wide] - 1] = self.to_bytes[1, data[wide]]
        return out.tobytes()

    def _encode_pieces(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Encode and append to the ids of ``self.pieces``: places and sizes.

        Thousands of pieces go to the library as one text, which the model's pre-tokenizer
        cuts at blanks. Only the last id of a piece has the suffix, so it says where the next
        begins; where that does not add up, or there is no suffix, each piece is a text.
        """
        begin, size = self.pieces.used, np.zeros(len(pieces), np.int64)
        for i in range(0, len(pieces), 4096):
            some = pieces.slice(i, 4096)
            text = self._joined(some).decode()
            filled = i + np.flatnonzero(pc.binary_length(some).to_numpy())
            if self.suffix and self.suffix not in text:
                ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<i4")
                ends = np.flatnonzero(self.last[ids]) + 1
                if len(ends) == len(filled) and (ends[-1] if len(ends) else 0) == len(ids):
                    size[filled] = np.diff(ends, prepend=0)
                    self.pieces.append(ids)
                    continue
            size[i : i + len(some)] = self._encode_all(self.model, text[:-1].split(" "), self.pieces)[1]
        return begin + np.cumsum(size) - size, size

    @staticmethod
    def _encode_all(encoder, texts: list[str], memory: Memory) -> tuple[np.ndarray, np.ndarray]:
        """Encode and append to the ids of ``memory``: places and sizes."""
        sizes, begin = [], memory.used
        for i in range(0, len(texts), 4096):
            found = [e.ids for e in encoder.encode_batch(texts[i : i + 4096], add_special_tokens=False)]
            sizes += map(len, found)
            memory.append(np.fromiter(chain.from_iterable(found), "<i4"))
        size = np.array(sizes, np.int64)
        return begin + np.cumsum(size) - size, size

    def _join(self, at: np.ndarray, size: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Append words of ``many`` pieces each, given one after another."""
        total = np.concatenate([[0], np.cumsum(size)])
        ends = total[np.cumsum(many)]
        begin = self.known.append(self.pieces.ids[spread(at, size)])
        starts = np.concatenate([[0], ends[:-1]])
        return begin + starts, ends - starts

    def _learn(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Encode new words: where their ids lie in ``self.known``, and how many."""
        at, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        left = np.arange(len(words))
        if self.pattern is not None:
            two = pc.extract_regex(words, LETTERS_SIGNS)
            yes = two.is_valid().to_numpy(zero_copy_only=False)
            some, left = np.flatnonzero(yes), np.flatnonzero(~yes)
            if len(some):
                two = two.take(pa.array(some))
                both = pa.concat_arrays([pc.utf8_lower(two.field("s")), two.field("r")])
                p, n = self._piece_ids(both)
                order = np.arange(2 * len(some)).reshape(2, -1).T.ravel()
                at[some], size[some] = self._join(p[order], n[order], np.full(len(some), 2))
        names = words.take(pa.array(left)).to_pylist()
        plain, other = self._cut(names) if self.pattern is not None else ({}, names)
        where = dict(zip(names, left.tolist(), strict=True))
        if plain:
            p, n = self._piece_ids(pa.array([x for found in plain.values() for x in found], pa.string()))
            i = [where[w] for w in plain]
            at[i], size[i] = self._join(p, n, np.array([len(found) for found in plain.values()]))
        if other:
            i = [where[w] for w in other]
            at[i], size[i] = self._encode_all(self.tokenizer, other, self.known)
        return at, size

    def _by_words(self, column: pa.Array, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(column)
        where = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.slice(where[0], where[-1] - where[0]).dictionary_encode()
        where -= where[0]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        if len(self.pieces) > CACHE_PIECES:
            self.pieces.clear()
        # ascii_split_whitespace makes an empty word at either end of a text
        hashed = self.known.hashes(coded.dictionary)
        first, size = self.known.find(hashed)
        new = np.flatnonzero(first < 0)
        if len(new):
            first[new], size[new] = self._learn(coded.dictionary.take(pa.array(new)))
            self.known.keep(tuple(x[new] for x in hashed), first[new], size[new])
        # the words of each text, and one more for its end
        first = np.append(first, self.known.append(tail))
        self.known.used -= len(tail)
        size = np.append(size, len(tail))
        word = np.insert(coded.indices.to_numpy().astype(np.int64), where[1:], len(size) - 1)
        size = size[word]
        total = np.concatenate([[0], np.cumsum(size)])[where + np.arange(len(where))]
        return self.known.ids[spread(first[word], size)], np.diff(total)

    def encode_column(self, column: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each with ``end_id`` behind it, and the
        number of ids of each text. Null is empty."""
        if column.null_count:
            column = column.fill_null("")
        tail = np.zeros(0, "<i4") if end_id is None else np.array([end_id], "<i4")
        if self.by_word:
            return self._by_words(column, tail)
        found = self.tokenizer.encode_batch(column.to_pylist(), add_special_tokens=False)
        each = [np.concatenate([np.asarray(e.ids, "<i4"), tail]) for e in found]
        return np.concatenate([np.zeros(0, "<i4"), *each]), np.array([len(e) for e in each], np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian int32 ids of each text."""
        ids, sizes = self.encode_column(pa.array(texts, pa.string()))
        ends = np.cumsum(sizes).tolist()
        return [ids[b - n : b].tobytes() for b, n in zip(ends, sizes.tolist(), strict=True)]


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def encode_rows(docs: DataFrame, tokenizer: str, *, end_id: int, key: str, text: str) -> DataFrame:
    """``FILE_SCHEMA`` of rows as they lie in their partitions; ``before`` counts the ids
    of the rows before one in its part."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq, before = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for a, b in groups(batch.column(1), 2 << 20):
                ids, sizes = enc.encode_column(batch.column(1).slice(a, b - a), end_id)
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                n = b - a
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, part, np.int32)),
                        pa.array(np.arange(seq, seq + n)),
                        batch.column(0).slice(a, n).cast(pa.int64()),
                        pa.array(sizes),
                        pa.array(before + offsets[:-1]),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)),
                    ],
                    names=names,
                )
                seq, before = seq + n, before + int(offsets[-1])
        enc.forget()  # the worker goes on to other tasks

    names = ["part", "seq", key, "n_tokens", "before", "ids"]
    if len(set(names)) < len(names):
        raise ValueError(f"the key must not be named like a column of the files: {key}")
    return docs.select(key, text).mapInArrow(lean(run), FILE_SCHEMA.format(key=f"`{key}`"))


def write_token_ids(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    *,
    end_id: int,
    key: str = "doc_id",
    text: str = "text",
    by_key: bool = True,
    encoding: str = "delta",
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 256 << 10,
    page_rows: int = 1000,
) -> None:
    """Write the ids of all texts to ``path`` in ascending key order.

    Null texts are empty and get the end id alone. Null keys come first. Rows with
    equal keys lie side by side, ordered by text, so that the files do not depend on
    the order of the input. Without ``by_key`` rows stay where they lie, as a global
    shuffle left them, and nothing is exchanged. ``encoding``: 'delta' or 'dictionary'.
    A key named like a column of the files (part, seq, ...) is an error.
    """
    options = {"delta": DELTA, "dictionary": DICTIONARY}[encoding]
    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).alias(text))
    if by_key:
        # rows that repeat a key are dealt by their text, so a hot key is no hot task
        rows = rows.repartitionByRange(F.col(key), F.xxhash64(text)).sortWithinPartitions(F.col(key), F.xxhash64(text), F.col(text))
    rows = encode_rows(rows, tokenizer, end_id=end_id, key=key, text=text)
    writer = rows.write.mode("overwrite").option("parquet.block.size", row_group_bytes)
    with setting(docs.sparkSession, CLEANUP, "true"):
        writer = writer.option("parquet.page.size", page_bytes).option("parquet.page.row.count.limit", page_rows)
        writer.options(**options).parquet(path)


def read_token_ids(spark: SparkSession, path: str, key: str = "doc_id", *, keys: Sequence[int] | None = None) -> DataFrame:
    """The rows of :func:`write_token_ids`; selecting columns reads only those.

    ``keys``: only rows with one of these keys. The files ascend by key, so the row
    groups' statistics and the page index leave most of them unread.
    """
    rows = spark.read.schema(FILE_SCHEMA.format(key=f"`{key}`")).parquet(path)
    return rows if keys is None else rows.filter(F.col(key).isin(*keys))


def _crc(ids: pa.Array) -> list[int]:
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    offsets = ids.offsets.to_numpy()
    values = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")
    return [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def token_index(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Per written row, from the files: key, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all rows before it: those of its part are in the files,
    and the totals of the parts, one row a written file, give each part's base.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            sizes = np.diff(ids.offsets.to_numpy()).astype(np.int64)
            columns = [*batch.columns[:3], pa.array(sizes), pa.array(_crc(ids), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", key, "before", "n_tokens", "ids_crc32"])

    rows = read_token_ids(spark, path, key).select("part", key, "before", "ids")
    rows = rows.mapInArrow(lean(run), f"part int, `{key}` long, before long, n_tokens long, ids_crc32 long")
    totals = read_token_ids(spark, path, key).groupBy("part").agg(F.max(F.col("before") + F.col("n_tokens")).alias("_sum"))
    bases = totals.select(
        F.col("part").alias("_part"),
        (F.sum("_sum").over(Window.orderBy("part")) - F.col("_sum")).alias("_base"),
    )
    # one row per writing task, whatever the data
    return rows.join(F.broadcast(bases), rows["part"] == bases["_part"]).select(
        key, (F.col("_base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def tokenize_to_table(
    docs: DataFrame, tokenizer: str, *, end_id: int, key: str = "doc_id", text: str = "text", by_key: bool = True
) -> DataFrame:
    """Write to the shared folder, read back, and return :func:`token_index` of it."""
    spark = docs.sparkSession
    path = Scratch(spark, "tokens").path("ids")
    write_token_ids(docs, path, tokenizer, end_id=end_id, key=key, text=text, by_key=by_key)
    return token_index(spark, path, key)
