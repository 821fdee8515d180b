"""Operator 8: byte-level BPE encoding and decoding by DuckDB queries.

Spark deals the texts; each task splits them by the vocabulary's pattern and
hands the distinct pieces it has not met lately to DuckDB (in process, one
thread, bounded memory).  There a piece is rows ``(word, position, token)``.
A recursive query joins neighbouring tokens with the merge table, contracts
each word's leftmost pair of minimum rank, and goes on until no word has a
pair; a keyed recursion keeps the last state of each row only.  A piece that is
itself a token needs no merge.  Decoding joins the token rows with the
vocabulary and aggregates the bytes in order of position; token rows are taken
in stretches, so a long text needs no more memory than a short one.

Long pieces (``LONG_PIECE`` bytes or more: runs without blank, digit or
punctuation limits) are first cut where no token of the vocabulary holds the
two bytes side by side, as no merge can cross there.  What is still long goes
through a recursion that contracts in one step all non-overlapping occurrences
of a word's minimum pair, from the left up to the first that opens a pair of
lower rank; up to there the order of single contractions is the same.  So the
steps follow the different tokens of a piece, not its length.

Encoding, digest and decoding are one pass of one Python worker per task, a
slice of the rows at a time; a worker holds the vocabulary, at most
``CACHE_BYTES`` of pieces met before, and DuckDB's rows.  The pieces are kept in
two generations: a piece met again moves to the younger one, and when that is
full the older one goes, so frequent pieces are contracted once.

Defined results: a null text counts as empty and has no tokens; decoding gives
back the bytes of the text exactly; equal texts get equal ids; a text of any
length is worked whole (a single piece that cannot be cut and is longer than
about a megabyte may exceed DuckDB's memory and is an error); extra columns
stay; an id outside the vocabulary is an error when decoding; an empty table
gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.llm import textio as T

LONG_PIECE = 96           # below 256: a row key of the short recursion holds the position in 8 bits
SLICE = 4 << 20           # bytes of text encoded at a time
STEP = 100_000           # pieces contracted in one query
PIECES = 1 << 20          # pieces worked at a time
CACHE_BYTES = 192 << 20   # pieces kept between slices of a worker, in two generations of half of it
ENTRY = 300               # bytes a kept piece takes besides its own
DECODE_ROWS = 1 << 18     # token rows per decoding query
MEMORY = "300MB"          # of DuckDB, taken only where a long piece needs it

#: a row's key is word * 256 + position; a contracted right-hand row gets id -1
_STEP = """
WITH RECURSIVE state(k, id) USING KEY (k) AS (
    SELECT k, id FROM begin_rows
  UNION ALL
    SELECT x.k, CASE WHEN x.k = b.left_key THEN b.merged WHEN x.k = b.right_key THEN -1 ELSE x.id END
    FROM (SELECT k, id FROM state WHERE id >= 0) x
    JOIN (SELECT y.k >> 8 AS w, min(p.m * 256 + (y.k & 255)) AS best,
                 (best & 255) | (w << 8) AS left_key, best >> 8 AS merged,
                 arg_min(y.next_key, p.m * 256 + (y.k & 255)) AS right_key
          FROM (SELECT k, id, lead(id) OVER win AS next_id, lead(k) OVER win AS next_key
                FROM state WHERE id >= 0 WINDOW win AS (ORDER BY k)) y
          JOIN pairs p ON p.l = y.id AND p.r = y.next_id
          WHERE y.next_key >> 8 = y.k >> 8
          GROUP BY y.k >> 8) b ON b.w = x.k >> 8
)
SELECT k >> 8 AS w, id FROM state WHERE id >= 0 ORDER BY k
"""

#: the same with all occurrences of a word's minimum pair, up to the first that opens a lower one; keys hold the position in 32 bits
_STEP_LONG = """
WITH RECURSIVE state(k, id) USING KEY (k) AS (
    SELECT k, id FROM begin_rows
  UNION ALL
    SELECT k, CASE WHEN pick AND rn <= coalesce(stop, rn) THEN best WHEN pick1 AND rn - 1 <= coalesce(stop, rn) THEN -1 ELSE id END
    FROM (
      SELECT f.*, min(CASE WHEN pick AND (coalesce(a.m < best, false) OR coalesce(b.m < best, false)) THEN rn END) OVER (PARTITION BY w) AS stop
      FROM (
        SELECT *, lag(pick, 1, false) OVER (PARTITION BY w ORDER BY rn) AS pick1, lag(pick, 2, false) OVER (PARTITION BY w ORDER BY rn) AS pick2
        FROM (
          SELECT *, hit AND row_number() OVER (PARTITION BY w, hit, island ORDER BY rn) % 2 = 1 AS pick
          FROM (
            SELECT *, coalesce(m = best, false) AS hit, rn - row_number() OVER (PARTITION BY w, coalesce(m = best, false) ORDER BY rn) AS island
            FROM (
              SELECT y.*, p.m, min(p.m) OVER (PARTITION BY w) AS best
              FROM (SELECT k, id, k >> 32 AS w, lag(id) OVER win AS before, lead(id) OVER win AS next_id, lead(id, 2) OVER win AS after,
                           row_number() OVER win AS rn
                    FROM state WHERE id >= 0 WINDOW win AS (PARTITION BY k >> 32 ORDER BY k)) y
              LEFT JOIN pairs p ON p.l = y.id AND p.r = y.next_id)
            WHERE best IS NOT NULL))) f
      LEFT JOIN pairs a ON pick AND a.l = CASE WHEN pick2 THEN best ELSE before END AND a.r = best
      LEFT JOIN pairs b ON pick AND b.l = best AND b.r = after)
)
SELECT k >> 32 AS w, id FROM state WHERE id >= 0 ORDER BY k
"""

_DECODE = """
SELECT t.w, unhex(string_agg(v.hex, '' ORDER BY t.pos)) AS raw
FROM token_rows t JOIN vocab v ON v.id = t.id GROUP BY t.w ORDER BY t.w
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """Vocabulary, merge table and piece cache of one worker process."""

    _open: dict[tuple[str, str], Codec] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        key = (path, pattern)
        if key not in cls._open:
            cls._open[key] = cls(path, pattern)
        return cls._open[key]

    def __init__(self, path: str, pattern: str):
        import duckdb
        self.ranks = read_ranks(path)
        self.split = regex.compile(pattern)
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        merges = [(self.ranks[w[:k]], self.ranks[w[k:]], m) for w, m in self.ranks.items()
                  for k in range(1, len(w)) if w[:k] in self.ranks and w[k:] in self.ranks]
        left, right, merged = (np.array(c, np.int64) for c in zip(*merges))
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        self.db.register("m", pa.table({"l": left, "r": right, "m": merged}))
        self.db.execute("CREATE TABLE pairs AS SELECT l, r, min(m) AS m FROM m GROUP BY l, r")
        self.db.unregister("m")
        tokens = list(self.ranks.items())
        self.db.register("v", pa.table({"id": pa.array([i for _, i in tokens], pa.int64()),
                                        "hex": [w.hex() for w, _ in tokens]}))
        self.db.execute("CREATE TABLE vocab AS SELECT id, hex FROM v")
        self.db.unregister("v")
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        beside = np.zeros((256, 256), bool)
        for w in self.ranks:
            raw = np.frombuffer(w, np.uint8)
            beside[raw[:-1], raw[1:]] = True
        self.beside = beside

    def cut(self, raw: bytes) -> list[bytes]:
        """The piece in parts that no merge can join."""
        data = np.frombuffer(raw, np.uint8)
        at = [0, *(np.flatnonzero(~self.beside[data[:-1], data[1:]]) + 1).tolist(), len(raw)]
        return [raw[i:j] for i, j in zip(at[:-1], at[1:])]

    def recursion(self, raws: list[bytes], query: str, shift: int) -> list[np.ndarray]:
        size = np.array([len(r) for r in raws])
        w = np.repeat(np.arange(len(raws)), size)
        pos = np.arange(len(w)) - np.repeat(np.cumsum(size) - size, size)
        ids = self.byte_id[np.frombuffer(b"".join(raws), np.uint8)]
        self.db.register("begin_rows", pa.table({"k": (w << shift) | pos, "id": ids}))
        got = self.db.execute(query).fetchnumpy()
        self.db.unregister("begin_rows")
        at = np.searchsorted(got["w"], np.arange(len(raws) + 1))
        flat = got["id"].astype("<i4")
        return [flat[i:j] for i, j in zip(at[:-1], at[1:])]

    def encode_long(self, raw: bytes) -> bytes:
        parts = self.cut(raw)
        distinct = list(dict.fromkeys(parts))
        small = [r for r in distinct if len(r) < LONG_PIECE]
        coded = dict(zip(small, self.recursion(small, _STEP, 8))) if small else {}
        for r in distinct:
            if len(r) >= LONG_PIECE:
                whole = self.ranks.get(r)          # here as in the short form, a token is its own encoding
                coded[r] = self.recursion([r], _STEP_LONG, 32)[0] if whole is None else np.array([whole], "<i4")
        return b"".join(coded[r].tobytes() for r in parts)

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids (packed int32) of distinct pieces."""
        out: list[bytes | None] = [None] * len(pieces)
        todo, raws = [], []
        for i, p in enumerate(pieces):
            raw = p.encode("utf-8", "replace")
            whole = self.ranks.get(raw)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(raw) >= LONG_PIECE:
                out[i] = self.encode_long(raw)
            else:
                todo.append(i)
                raws.append(raw)
        if todo:
            for i, ids in zip(todo, self.recursion(raws, _STEP, 8)):
                out[i] = ids.tobytes()
        return out

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, of a long one some at a time."""
        if len(text) <= SLICE:
            yield self.split.findall(text)
            return
        found = (m.group() for m in self.split.finditer(text))
        while part := list(islice(found, PIECES)):
            yield part

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, offsets)`` of the texts."""
        out, tokens = [np.zeros(0, "<i4")], np.zeros(len(texts), np.int64)
        held, owner, size = [], [], 0

        def flush() -> None:
            ids, counts = self.encode_lists(held)
            out.append(ids)
            np.add.at(tokens, owner, counts)
            held.clear(), owner.clear()

        for i, text in enumerate(texts):
            for part in self.pieces(text):
                held.append(part)
                owner.append(i)
                size += len(part)
                if size >= PIECES:
                    flush()
                    size = 0
        if held:
            flush()
        return np.concatenate(out), np.concatenate(([0], np.cumsum(tokens)))

    def keep(self, piece: str, ids: bytes) -> None:
        if self.held > CACHE_BYTES // 2:
            self.older, self.cache, self.held = self.cache, {}, 0
        self.cache[piece] = ids
        self.held += len(piece) + len(ids) + ENTRY

    def known(self, piece: str) -> bytes | None:
        ids = self.cache.get(piece)
        if ids is None and (ids := self.older.get(piece)) is not None:
            self.keep(piece, ids)
        return ids

    def encode_lists(self, found: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in order, and their number per list."""
        flat = pa.array([p for f in found for p in f], pa.string()).dictionary_encode()
        distinct = flat.dictionary.to_pylist()
        coded = [self.known(p) for p in distinct]
        missing = [i for i, c in enumerate(coded) if c is None]
        step = STEP
        for i in range(0, len(missing), step):
            part = [distinct[k] for k in missing[i:i + step]]
            for k, p, c in zip(missing[i:i + step], part, self.encode_pieces(part)):
                coded[k] = c
                self.keep(p, c)
        values = np.frombuffer(b"".join(coded), "<i4")
        size = np.array([len(c) // 4 for c in coded], np.int64)
        start = np.cumsum(size) - size
        use = flat.indices.to_numpy()
        n = size[use]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[use], n)
        ends = np.concatenate(([0], np.cumsum(n)))
        return values[at], np.diff(ends[np.cumsum([0] + [len(f) for f in found])])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Bytes of each run of ids."""
        out: list[list[bytes]] = [[] for _ in range(len(offsets) - 1)]
        for i in range(0, len(ids), DECODE_ROWS):
            part = ids[i:i + DECODE_ROWS].astype(np.int64)
            if part.min() < 0 or part.max() >= len(self.ranks):
                raise ValueError("id outside the vocabulary")
            pos = np.arange(i, i + len(part))
            self.db.register("token_rows", pa.table({"w": np.searchsorted(offsets, pos, "right") - 1, "pos": pos, "id": part}))
            got = self.db.sql(_DECODE).to_arrow_table()
            self.db.unregister("token_rows")
            for k, raw in zip(got["w"].to_pylist(), got["raw"].to_pylist()):
                out[k].append(raw)
        return [b"".join(p) for p in out]


def defaults() -> tuple[str, str]:
    """Rank file and split pattern of the 50k byte-level vocabulary."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


PARTS = {"ids": ("ids", "array<int>"), "decoded": ("decoded", "binary"),
         "digest": ("ids_digest", "struct<n_tokens: bigint, ids_sha256: string>")}


def with_codes(docs: DataFrame, path: str, pattern: str, text_col: str = "text", **out_cols: str) -> DataFrame:
    """Every row and column of ``docs`` plus the columns asked for, all made in
    one pass: ``ids`` (token ids), ``decoded`` (the bytes decoded from them) and
    ``digest`` (``n_tokens`` and the digest of the decimal ids joined by one
    space).  ``out_cols`` names them, as ``ids="ids"``."""
    at = docs.columns.index(text_col)
    names = [*docs.columns, *out_cols.values()]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
                       + [f"`{name}` {PARTS[part][1]}" for part, name in out_cols.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in batches:
            texts = batch.column(at)
            _, off = T.text_bytes(texts)
            for i, j in T.slices(off, SLICE):
                ids, ends = codec.encode([t or "" for t in texts.slice(i, j - i).to_pylist()])
                made = {"ids": lambda: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())),
                        "decoded": lambda: pa.array(codec.decode(ids, ends), pa.binary()), "digest": lambda: digests(ids, ends)}
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, *(made[p]() for p in out_cols)], names=names)

    return docs.mapInArrow(run, schema)


def digests(ids: np.ndarray, off: np.ndarray) -> pa.Array:
    sha = []
    for a, z in zip(off[:-1], off[1:]):
        h = hashlib.sha256()
        for s in range(a, z, DECODE_ROWS):                          # a long text's decimals in stretches
            words = pa.array(ids[s:min(z, s + DECODE_ROWS)]).cast(pa.string())
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()
            h.update((text if s == a else f" {text}").encode())
        sha.append(h.hexdigest())
    return pa.StructArray.from_arrays([pa.array(np.diff(off)), pa.array(sha, pa.string())], names=["n_tokens", "ids_sha256"])


def with_ids(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Every row and column of ``docs`` plus the token ids of its text."""
    return with_codes(docs, path, pattern, text_col, ids=out_col)


def with_bytes(rows: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Every row and column of ``rows`` plus the bytes its ids stand for (null ids: none)."""
    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        flat, off = _flat(ids)
        return pa.array(Codec.of(path, pattern).decode(flat, off), pa.binary())

    return rows.withColumn(out_col, decode(F.col(ids_col)))


def _flat(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    size = np.array(ids.value_lengths().fill_null(0), np.int64)
    return ids.flatten().to_numpy(), np.concatenate(([0], np.cumsum(size)))


def with_id_digest(rows: DataFrame, ids_col: str = "ids", out_col: str = "ids_digest") -> DataFrame:
    """Every row and column plus ``(n_tokens, ids_sha256)`` of the ids written
    in decimal, joined by one space (null ids: none)."""
    @F.arrow_udf(PARTS["digest"][1])
    def digest(ids: pa.Array) -> pa.Array:
        return digests(*_flat(ids))

    return rows.withColumn(out_col, digest(F.col(ids_col)))
