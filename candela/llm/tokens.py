"""Token counts and token ids for a public vocabulary file.

Work is per distinct pre-token. A slice of texts is cut at white space and dictionary-encoded, each distinct chunk is cut
into pre-tokens, and each pre-token that the worker has not met goes to the vocabulary's model once. The sizes (or ids) of
the pre-tokens are then joined back to the chunks and these to the places in each document, by array look-ups. That a
chunk's pieces depend on the chunk alone holds for a vocabulary that turns white space into one space and drops it,
lower-cases character by character and never merges across pre-tokens; special strings hold no white space. A file is
asked for just this; one of another kind gets its whole texts encoded by its library.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candela.llm.common import fresh, slices, small_batches

#: Pre-tokens and chunks that one worker remembers; a table is emptied beyond it, which costs time, not results.
CACHE_ENTRIES = 600_000

#: How byte-level vocabularies spell each byte: visible Latin characters stand for themselves, the rest follow from 256 on.
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: chr(b) for b in _VISIBLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}

#: What the file of a vocabulary must say, as fixed by its format, for texts to be cut into chunks and pre-tokens here.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same pattern for chunks of plain Latin characters, with a line feed between chunks.
CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zª\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\sa-zª\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+|\n")
#: Chunks that are not plain or may hold a special string go to the library whole.
ODD = r"[^\x21-\x7e\x{a1}-\x{ff}]|<\|"


def by_chunks(spec: dict) -> bool:
    """Does a vocabulary file of the ``tokenizers`` library cut texts as NORMALIZERS and SPLIT say?"""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return (
        (spec.get("normalizer") or {}).get("normalizers") == NORMALIZERS
        and [s.get("type") for s in steps] == ["Split", "ByteLevel"]
        and (steps[0]["pattern"], steps[0]["behavior"], steps[0]["invert"]) == ({"Regex": SPLIT}, "Removed", True)
        and not steps[1]["add_prefix_space"]
        and not steps[1]["use_regex"]
        and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or not t["content"].startswith("<|") for t in spec["added_tokens"])
    )


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``starts``, one after the other."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between successive bounds."""
    return np.diff(np.concatenate(([0], np.cumsum(values)))[bounds])


class Runs:
    """A table from strings to runs of ids: row numbers by string, sizes, starts and ids by row number. It is emptied beyond
    CACHE_ENTRIES strings, but only when a slice begins."""

    def __init__(self):
        self.row: dict[str, int] = {}
        self.sizes, self.ids, self.starts = np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def lookup(self, keys: list[str], make) -> np.ndarray:
        """Row numbers of distinct ``keys``; ``make`` gives the ids, in one array, and the sizes of those not met before."""
        if len(self.row) > CACHE_ENTRIES:
            self.__init__()
        found = np.array([-1 if r is None else r for r in map(self.row.get, keys)], np.int64)
        new = np.flatnonzero(found < 0)
        if len(new):
            fresh_keys = [keys[i] for i in new.tolist()]
            ids, sizes = make(fresh_keys)
            found[new] = np.arange(len(self.row), len(self.row) + len(new))
            self.row.update(zip(fresh_keys, found[new].tolist(), strict=True))
            self.ids, self.sizes = np.concatenate((self.ids, ids)), np.concatenate((self.sizes, sizes))
            self.starts = np.cumsum(self.sizes) - self.sizes
        return found

    def take(self, rows: np.ndarray) -> np.ndarray:
        return gathered(self.ids, self.starts[rows], self.sizes[rows])


class Pieces:
    """A worker's tables: ids of the pre-tokens, and of the chunks that they make up."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.chunked, self.tokens, self.chunks = False, Runs(), Runs()
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            lib = SentencePieceProcessor(model_file=path)
            self.encode, self.size = lambda text: lib.encode(text, num_threads=1), lib.get_piece_size()
        else:
            from tokenizers import Tokenizer

            lib = Tokenizer.from_file(path)
            lib.no_truncation()
            lib.no_padding()
            self.encode, self.model = lambda text: lib.encode(text, add_special_tokens=False).ids, lib.model
            self.chunked, self.size = by_chunks(json.loads(lib.to_str())), max(lib.get_vocab(with_added_tokens=True).values()) + 1

    def of_tokens(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each pre-token is given to the vocabulary's model once."""
        ask = self.model.tokenize
        return flat([[t.id for t in ask(p if p.isascii() else "".join(map(BYTE_CHARS.__getitem__, p.encode())))] for p in tokens])

    def of_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Plain chunks from their pre-tokens, others by the library."""
        is_odd = np.asarray(pc.match_substring_regex(pa.array(chunks, pa.string()), ODD).to_numpy(zero_copy_only=False), bool)
        cut = pa.array([*CUT.findall("\n".join(c for c, o in zip(chunks, is_odd.tolist(), strict=True) if not o).lower()), "\n"], pa.string()).dictionary_encode()
        names, code = cut.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(cut.indices)
        mark = names.index("\n")
        rows = np.insert(self.tokens.lookup(names[:mark] + names[mark + 1 :], self.of_tokens), mark, -1)
        ends = np.flatnonzero(code == mark)
        number = (np.diff(ends, prepend=-1) - 1)[: len(chunks) - int(is_odd.sum())]
        used = rows[code[code != mark]]
        sizes, ids = sums(self.tokens.sizes[used], np.concatenate(([0], np.cumsum(number)))), self.tokens.take(used)
        if not is_odd.any():
            return ids, sizes
        odd_ids, odd_sizes = flat([self.encode(chunks[i]) for i in np.flatnonzero(is_odd).tolist()])
        both, starts = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        both[~is_odd], both[is_odd] = sizes, odd_sizes
        starts[~is_odd], starts[is_odd] = np.cumsum(sizes) - sizes, len(ids) + np.cumsum(odd_sizes) - odd_sizes
        return gathered(np.concatenate((ids, odd_ids)), starts, both), both

    def rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of the chunks of all texts, and the bounds of each text."""
        words, bounds = chunks_of(texts)
        return self.chunks.lookup(words.dictionary.to_numpy(zero_copy_only=False).tolist(), self.of_chunks)[np.asarray(words.indices)], bounds

    def counted(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text: the sizes of distinct chunks joined to the places in the documents, and summed."""
        if not self.chunked:
            return np.array([len(self.encode(t)) for t in texts.to_pylist()], np.int64)
        rows, bounds = self.rows(texts)
        return sums(self.chunks.sizes[rows], bounds)

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and how many each text has."""
        if not self.chunked:
            return flat([self.encode(t) for t in texts.to_pylist()])
        rows, bounds = self.rows(texts)
        return self.chunks.take(rows), sums(self.chunks.sizes[rows], bounds)


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes


def chunks_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Runs of characters between ASCII white space, dictionary-encoded, and the bounds of each text; other white space stays
    inside a chunk, for the library to handle."""
    lists = pc.ascii_split_whitespace(texts)
    bounds = np.asarray(lists.offsets).astype(np.int64)
    return lists.flatten().dictionary_encode(), bounds - bounds[0]


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One table for a worker process, so that it serves later tasks of that worker too."""
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def unpacked(column: pa.BinaryArray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids in a column of packed runs of the given lengths, one after the other, and where each run starts."""
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    width = int(bounds[-1] - bounds[0]) // int(lengths.sum())
    return np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].view(f"<u{width}"), np.cumsum(lengths) - lengths


def _texts(part: pa.RecordBatch, name: str) -> pa.Array:
    return pc.fill_null(part.column(name), "")


def count_tokens(docs: DataFrame, vocabulary: str, *, text_col: str = "text", limit: int = 2048, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) plus n_bytes, n_tokens and over_limit (n_tokens > limit), per row.

    Ids are never materialised: sizes of distinct pre-tokens are joined to a document's chunks and summed. Null and empty
    texts have 0 bytes and 0 tokens; very long ones are counted whole, a slice of one text; repeated rows are counted each;
    no rows, no rows. A kept column with a result's name gives way to the result.
    """
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {f.name for f in fields}]
    text = fresh(docs, "count_text")
    d = docs.withColumn(text, F.col(text_col).cast("string"))
    schema = T.StructType([d.schema[c] for c in keep] + fields)

    def run(batches):
        table = pieces(vocabulary)
        for batch in batches:
            for part in slices(batch):
                texts = _texts(part, text)
                n = table.counted(texts)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], names=schema.names)

    small_batches(docs.sparkSession)
    return d.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def token_pieces(docs: DataFrame, vocabulary: str, *, text_col: str = "text", capacity: int = 4096, end_id: int = 1, keep: list[str], with_ids: bool = False, with_total: bool = False, packed: bool = False) -> DataFrame:
    """One row per piece of at most ``capacity`` tokens of each document: ``keep`` columns, piece, start, length, ids_crc32
    and, on request, doc_tokens (of the whole document) and ids, ``packed`` as little-endian unsigned numbers of 2 bytes where the
    vocabulary allows, else 4. A document is its tokens and ``end_id``; only longer ones are cut. Null and empty texts: no tokens
    but the end. Very long texts are encoded whole, a slice of one text; repeated rows are cut each."""
    fields = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), *([T.StructField("doc_tokens", T.LongType())] if with_total else []), *([T.StructField("ids", T.BinaryType() if packed else T.ArrayType(T.IntegerType()))] if with_ids else [])]
    keep = [c for c in keep if c.lower() not in {f.name for f in fields}]
    text = fresh(docs, "piece_text")
    d = docs.withColumn(text, F.col(text_col).cast("string"))
    schema = T.StructType([d.schema[c] for c in keep] + fields)

    def run(batches):
        table = pieces(vocabulary)
        for batch in batches:
            for part in slices(batch):
                ids, sizes = table.encoded(_texts(part, text))
                flat = np.insert(ids, np.cumsum(sizes), end_id).astype("<u4")
                sizes = sizes + 1
                number = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), number)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
                length = np.minimum(capacity, sizes[row] - piece * capacity)
                bounds = np.concatenate(([0], np.cumsum(length)))
                raw = memoryview(flat).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                made = [pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(length), pa.array(crc, pa.int64())]
                if with_total:
                    made.append(pa.array(sizes[row]))
                if with_ids and packed:
                    width = 2 if max(table.size, end_id + 1) <= 1 << 16 else 4
                    made.append(pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer((bounds * width).astype(np.int32)), pa.py_buffer(flat.astype(f"<u{width}"))]))
                elif with_ids:
                    made.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.view("<i4"))))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(row)) for c in keep), *made], names=schema.names)

    small_batches(docs.sparkSession)
    return d.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
