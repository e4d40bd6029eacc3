"""Operator 12: byte-level BPE over a shuffle of distinct words.

A scan cuts every text into pre-tokens and counts distinct ones; each distinct word is merged into ids once, wherever it occurs.
Ids then go back to the places of the words: those of frequent words, a bounded number, are sent to the tasks; for the others each
piece of the corpus asks once for every distinct word, by a shuffle on the word, and the answers meet the piece, which
has kept only places. There the texts' ids are put together by position. Decoding joins ids with the table of token bytes.

Words are cut by a table of character classes and array operations over a whole piece; the rules are those of the public pattern.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import PATTERN
from .runtime import persist_table

#: A word is frequent if it is more than one of so many pre-tokens: there cannot be more frequent words than this.
FREQUENT = 1_000_000
#: Bytes of a word that may be sent to all tasks.
FREQUENT_BYTES = 48
#: Rows, and bytes of text, of a piece; a longer text is a piece of its own.
PIECE_ROWS, PIECE_BYTES = 4096, 2 << 20
#: Distinct words, and pre-tokens, of the corpus for each bucket of the shuffle on words.
BUCKET_WORDS, BUCKET_TOKENS = 50_000, 5_000_000
OTHER, LETTER, NUMBER, SPACE = range(4)
PLACES = "piece long, mark long, docs array<long>, sizes binary, codes binary, others binary"
#: What `encode` returns: the ids are unsigned 32-bit numbers, little-endian, one after another.
ENCODED = "doc_id long, n_tokens long, ids binary"


def ranks(vocabulary: str) -> dict[bytes, int]:
    """The token table of a rank file: its ids by their bytes."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(vocabulary).read_bytes().splitlines())}


def character_classes() -> bytes:
    """For each code point the class that the tokenizer's own pattern engine sees, compressed; unpacked, 1.1 MB."""
    import tiktoken

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    table = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        plain = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        table[np.frombuffer(bytes(plain.encode_ordinary(every)).decode().encode("utf-32-le"), "<u4")] = kind
    return zlib.compress(table.tobytes())


def cut(data: np.ndarray, begin: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin, in bytes. `data`: the UTF-8 bytes of texts one after another; `begin`: where non-empty texts begin.

    A run of letters, of numbers or of other signs takes a blank before it. White space of more than one character leaves its
    last one, unless the text ends. An apostrophe that begins a word takes s, t, m, d, re, ve or ll from the letters behind it.
    """
    chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    n = len(chars)
    if n == len(data):  # plain ASCII
        at = np.arange(n + 1)
    else:
        at = np.concatenate(([0], np.cumsum(1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF))))
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(at, begin)] = True
    first[n] = True
    kind = table[chars]
    new = first[:n].copy()
    new[1:] |= kind[1:] != kind[:-1]
    # a word behind white space within its text
    word = np.flatnonzero(~first[1:n] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
    new[word - 1] = True
    new[word[chars[word - 1] == 0x20]] = False
    mark = np.flatnonzero((chars == 0x27) & new)
    mark = mark[mark + 1 < n]
    mark = mark[~first[mark + 1]]
    one = np.isin(chars[mark + 1], [ord(c) for c in "stmd"])
    rest = mark[~one & (mark + 2 < n)]
    rest = rest[~first[rest + 2]]
    pair = chars[rest + 1].astype(np.int64) << 32 | chars[rest + 2]
    rest = rest[np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])]
    for where, length in ((mark[one], 2), (rest, 3)):
        new[where + 1] = False
        end = where + length
        new[end[end < n]] = True
    return at[np.flatnonzero(new)]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Pieces: doc_ids, all bytes, and each text's start (one more at the end). They depend on the rows and their order alone."""
    ids, texts, size = [], [], 0

    def piece():
        starts = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        return pa.array(ids, pa.int64()), np.frombuffer(b"".join(texts), np.uint8), starts

    for batch in batches:
        # one value at a time: the texts of a whole batch as Python objects would be a second copy of it
        for doc, text in zip(batch.column("doc_id"), batch.column("text")):
            raw = text.as_buffer()
            doc, raw = doc.as_py(), b"" if raw is None else raw.to_pybytes()
            if texts and (len(texts) >= PIECE_ROWS or size + len(raw) > PIECE_BYTES):
                yield piece()
                ids, texts, size = [], [], 0
            ids.append(doc)
            texts.append(raw)
            size += len(raw)
    if texts:
        yield piece()


def _words(data: np.ndarray, starts: np.ndarray, table: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The pre-tokens of a piece, as a dictionary in order of first occurrence, and how many each text has."""
    if not len(data):
        return pa.array([], pa.large_binary()).dictionary_encode(), np.zeros(len(starts) - 1, np.int64)
    begin = cut(data, np.unique(starts[:-1][starts[1:] > starts[:-1]]), table)
    edges = np.append(begin, len(data)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(edges), pa.py_buffer(data)])
    return words.dictionary_encode(), np.diff(np.searchsorted(begin, starts))


# -- blobs: columns of numbers and words, dense enough to be shuffled ------------------------------------------------


def _packed(numbers: np.ndarray, width: int = 4) -> bytes:
    """Unsigned numbers, compressed byte plane by byte plane."""
    planes = numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return zstandard.ZstdCompressor(3).compress(np.ascontiguousarray(planes).tobytes())


def _unpacked(blob: bytes, width: int = 4) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


def _pack_words(words: list[bytes]) -> bytes:
    lengths = np.array([len(w) for w in words], "<u4")
    return zstandard.ZstdCompressor(3).compress(np.uint32(len(words)).tobytes() + lengths.tobytes() + b"".join(words))


def _unpack_words(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw[:4], "<u4")[0])
    ends = (4 + 4 * n + np.cumsum(np.frombuffer(raw[4 : 4 + 4 * n], "<u4"), dtype=np.int64)).tolist()
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends], ends)]


# -- words ----------------------------------------------------------------------------------------------------------


def _bucket(word: bytes, buckets: int) -> int:
    return zlib.crc32(word) % buckets


def word_counts(docs: DataFrame, classes) -> DataFrame:
    """(word, n): every distinct pre-token and how often it occurs; added up within each piece before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(zlib.decompress(classes.value), np.uint8)
        for _, data, starts in _texts(batches):
            words, _ = _words(data, starts, table)
            n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
            yield pa.record_batch([words.dictionary.cast(pa.binary()), pa.array(n, pa.int64())], names=["word", "n"])

    return docs.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def encode_words(words: DataFrame, vocabulary) -> DataFrame:
    """(word, n, ids): the ids of each distinct word, as unsigned 32-bit little-endian numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        merge = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=vocabulary.value, special_tokens={})._encode_single_piece
        for rows in batches:
            ids = [np.array(merge(w), "<u4").tobytes() for w in rows.column("word").to_pylist()]
            yield pa.record_batch([rows.column("word"), rows.column("n"), pa.array(ids, pa.binary())], names=["word", "n", "ids"])

    return words.mapInArrow(run, "word binary, n long, ids binary")


def _frequent(words: DataFrame, total: int):
    """The frequent words and their ids, most frequent first: at most FREQUENT of at most FREQUENT_BYTES bytes each."""
    rows = words.where((F.col("n") * FREQUENT > total) & (F.octet_length("word") <= FREQUENT_BYTES)).select("word", "ids", "n").toArrow()
    rows = rows.combine_chunks().sort_by([("n", "descending"), ("word", "ascending")])
    words_blob, ids = _pack_words(rows.column("word").to_pylist()), rows.column("ids").to_pylist()
    return words_blob, _pack_words(ids)


def _asked(docs: DataFrame, classes, frequent, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Two frames from equal scans. Places: (piece, mark, docs, sizes, codes, others). Questions: (bucket, piece, mark, words).

    A piece is a partition's number and a running number; `mark` is a checksum of its bytes, by which the two scans are found to
    be the same. A code below the number of frequent words is a frequent word, that number stands for the next distinct other
    word, and what lies above for one that was there before. `others`: the bucket of each distinct other word.
    """

    def pieces(batches):
        table = np.frombuffer(zlib.decompress(classes.value), np.uint8)
        rank = {w: k for k, w in enumerate(_unpack_words(frequent.value[0]))}
        for number, (ids, data, starts) in enumerate(_texts(batches)):
            words, sizes = _words(data, starts, table)
            known = np.array([rank.get(w, -1) for w in words.dictionary.to_pylist()], np.int64)
            piece = TaskContext.get().partitionId() << 32 | number
            mark = zlib.crc32(np.ascontiguousarray(starts), zlib.crc32(data))
            yield piece, mark, ids, sizes, words, known, len(rank)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, mark, ids, sizes, words, known, n in pieces(batches):
            index = words.indices.to_numpy().astype(np.int64)
            other = np.cumsum(known < 0) - 1  # the number of each other word, in order of first occurrence
            codes = np.where(known[index] >= 0, known[index], n + 1 + other[index])
            fresh = np.zeros(len(index), bool)
            fresh[np.unique(index, return_index=True)[1]] = True
            codes[fresh & (known[index] < 0)] = n
            own = np.array([_bucket(w, buckets) for w in words.dictionary.filter(pa.array(known < 0)).to_pylist()], np.uint32)
            blobs = [pa.array([_packed(x)], pa.binary()) for x in (sizes, codes, own)]
            yield pa.record_batch([pa.array([piece]), pa.array([mark]), pa.array([ids], pa.list_(pa.int64())), *blobs], names=["piece", "mark", "docs", "sizes", "codes", "others"])

    def questions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, mark, _, _, words, known, _ in pieces(batches):
            asked: dict[int, list[bytes]] = {}
            for word in words.dictionary.filter(pa.array(known < 0)).to_pylist():
                asked.setdefault(_bucket(word, buckets), []).append(word)
            if asked:
                blobs = pa.array([_pack_words(w) for w in asked.values()], pa.binary())
                yield pa.record_batch([pa.array(list(asked), pa.int32()), pa.array([piece] * len(asked)), pa.array([mark] * len(asked)), blobs], names=["bucket", "piece", "mark", "words"])

    return docs.mapInArrow(places, PLACES), docs.mapInArrow(questions, "bucket int, piece long, mark long, words binary")


def _answers(questions: DataFrame, words: DataFrame, buckets: int) -> DataFrame:
    """(piece, mark, bucket, ids): the ids of the words that were asked for, in their order."""

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        known = dict(zip(right.column("word").to_pylist(), right.column("ids").to_pylist()))
        ids = [_pack_words([known[w] for w in _unpack_words(blob)]) for blob in left.column("words").to_pylist()]
        return left.select(["piece", "mark", "bucket"]).append_column("ids", pa.array(ids, pa.binary()))

    dealt = words.select("word", "ids", F.pmod(F.crc32("word"), F.lit(buckets)).cast("int").alias("bucket"))
    return questions.groupBy("bucket").cogroup(dealt.groupBy("bucket")).applyInArrow(solve, "piece long, mark long, bucket int, ids binary")


# -- texts ----------------------------------------------------------------------------------------------------------


def _reassembled(places: DataFrame, answers: DataFrame, frequent) -> DataFrame:
    """ENCODED: the ids of every word at its place, piece by piece."""

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        table = _unpack_words(frequent.value[1])
        n = len(table)
        answered = {b: (m, _unpack_words(x)) for b, m, x in zip(*(right.column(c).to_pylist() for c in ("bucket", "mark", "ids")))}
        out = []
        for row in left.to_pylist():
            bucket = _unpacked(row["others"])
            own = [b""] * len(bucket)
            for b in np.unique(bucket).tolist():
                mark, ids = answered.get(b, (None, []))
                where = np.flatnonzero(bucket == b).tolist()
                if mark != row["mark"] or len(ids) != len(where):
                    raise RuntimeError("the documents came in another order at the second reading: write the frame to a table first")
                for k, x in zip(where, ids):
                    own[k] = x
            codes = _unpacked(row["codes"]).astype(np.int64)
            fresh = codes == n
            codes[fresh] = n + 1 + np.arange(int(fresh.sum()))
            words = [*table, b"", *own]
            length = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.concatenate(([0], np.cumsum(length[codes])))
            ids = b"".join([words[c] for c in codes.tolist()])
            edge = ends[np.concatenate(([0], np.cumsum(_unpacked(row["sizes"]), dtype=np.int64)))].tolist()
            blobs = pa.array([ids[a:b] for a, b in zip(edge, edge[1:])], pa.binary())
            out.append(pa.record_batch([pa.array(row["docs"], pa.int64()), pa.array(np.diff(edge) // 4, pa.int64()), blobs], names=["doc_id", "n_tokens", "ids"]))
        return pa.Table.from_batches(out, pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]))

    return places.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(solve, ENCODED)


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """ENCODED: one row per row of `docs`: the ids of the whole text, as the public tokenizer gives them, without special tokens.

    Null and empty texts have no ids. Repeated rows and repeated or null doc_ids have a row each; other columns are ignored; an
    empty table gives an empty result. `docs` is read three times and must give its rows in the same order, as a table does;
    a frame that does not is found out and refused.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    send = spark.sparkContext.broadcast
    classes, tokens = send(character_classes()), send(ranks(vocabulary))
    words, _ = persist_table(encode_words(word_counts(docs, classes), tokens), "words")
    seen = words.agg(F.count("*").alias("words"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    frequent = send(_frequent(words, seen["n"]))
    buckets = max(1, -(-seen["words"] // BUCKET_WORDS), -(-seen["n"] // BUCKET_TOKENS))
    places, questions = _asked(docs, classes, frequent, buckets)
    rare = words.where((F.col("n") * FREQUENT <= seen["n"]) | (F.octet_length("word") > FREQUENT_BYTES))
    return _reassembled(places, _answers(questions, rare, buckets), frequent)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """The columns of ENCODED and `decoded`, the bytes: each id joined with the table of token bytes, which every task has.

    Null ids are no bytes. An id that the vocabulary lacks is an error.
    """
    table = encoded.sparkSession.sparkContext.broadcast([w for w, _ in sorted(ranks(vocabulary).items(), key=lambda x: x[1])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = table.value
        for rows in batches:
            for at in range(0, rows.num_rows, PIECE_ROWS):
                part = rows.slice(at, PIECE_ROWS)
                raw = [b"".join([tokens[k] for k in np.frombuffer(x or b"", "<u4").tolist()]) for x in part.column("ids").to_pylist()]
                yield pa.record_batch([*(part.column(c) for c in ("doc_id", "n_tokens", "ids")), pa.array(raw, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, f"{ENCODED}, decoded binary")
