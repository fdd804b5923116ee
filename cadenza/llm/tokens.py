"""Token ids of a whole corpus by a public byte-level BPE vocabulary (problem 8).

Texts are cut into pre-tokens a block at a time. A block, at most BLOCK_BYTES of text (or one longer text), becomes one row: its
documents and the code of every pre-token in order. So positions travel packed. A pre-token that is a token of the vocabulary
has its id as code: the vocabulary is a table of fixed size that every worker holds, and it takes the frequent words out of
the shuffle. The others are numbered within the block and exploded; the distinct ones are encoded once each and their ids
joined back to the blocks, which are reassembled by position.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from .codepoints import gather, utf8
from .pretoken import pretokens

VOCABULARY = "byte_bpe_50k.tiktoken"
BLOCK_BYTES = 2_000_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the installed public vocabularies keep a file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(4)
def vocabulary(path: str) -> tuple[dict[bytes, int], Callable[[str], list[int]]]:
    """(rank of each token's bytes, encoder of one text) of a rank file."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return ranks, tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _block(ranks: dict[bytes, int], ids: pa.Array, text: pa.Array, block: int) -> pa.RecordBatch:
    words, counts = pretokens(*utf8(text))
    coded = words.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    code = np.array([ranks.get(w, -1) for w in distinct], np.int32)
    new = np.flatnonzero(code < 0)
    code[new] = -1 - np.arange(len(new), dtype=np.int32)
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    codes = code[coded.indices.to_numpy()] if len(distinct) else code
    return pa.RecordBatch.from_arrays(
        [
            pa.array([block], pa.int64()), one(ids), one(pa.array(counts.astype(np.int32))), pa.array([len(codes)], pa.int64()),
            pa.array([pa.compress(codes.tobytes(), "zstd", asbytes=True)], pa.binary()), one(pa.array([distinct[i] for i in new], pa.binary())),
        ],
        BLOCK_FIELDS,
    )


BLOCK_FIELDS = ["block", "docs", "counts", "n", "codes", "words"]


def _cuts(sizes: np.ndarray, room: int) -> list[int]:
    """Where lists of sizes are cut so that none holds more than ``room`` unless it is a single one."""
    cuts, held = [0], 0
    for i, n in enumerate(sizes.tolist()):
        if held + n > room and i > cuts[-1]:
            cuts.append(i)
            held = 0
        held += n
    return [*cuts, len(sizes)]


def _blocks(path: str, room: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, _ = vocabulary(path)
        part = TaskContext.get().partitionId() << 32
        ids: pa.Array | None = None
        for b in batches:
            text = b.column(1).cast(pa.large_string())
            ids, text = (b.column(0), text) if ids is None else (pa.concat_arrays([ids, b.column(0)]), pa.concat_arrays([held, text]))
            cuts = _cuts(np.diff(utf8(text)[1]), room)
            for s, e in zip(cuts[:-2], cuts[1:-1]):
                yield _block(ranks, ids[s:e], text[s:e], part)
                part += 1
            ids, held = ids[cuts[-2] :], text[cuts[-2] :]
        if ids is not None and len(ids):
            yield _block(ranks, ids, held, part)

    return run


def _encode(path: str, lengths_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encode = vocabulary(path)
        for b in batches:
            ids = [encode(w.decode("utf-8")) for w in b.column(0).to_pylist()]
            out = pa.array([len(x) for x in ids], pa.int32()) if lengths_only else pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), out], ["word", "ids"])

    return run


def _codes(left: pa.Table) -> np.ndarray:
    return np.frombuffer(pa.decompress(left["codes"][0].as_py(), 4 * left["n"][0].as_py(), "zstd"), np.int32)


def _by_pos(right: pa.Table) -> np.ndarray:
    """The row of ``right`` that has each word of the block."""
    pos = right["pos"].to_numpy()
    order = np.empty(len(pos), np.int64)
    order[pos] = np.arange(len(pos))
    return order


def _assemble(left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents of one block with their ids; ``right`` has the ids of each of its words outside the vocabulary."""
    counts, codes = left["counts"].combine_chunks().values.to_numpy(), _codes(left)
    ids = right["ids"].combine_chunks()
    flat, offs = ids.values.to_numpy(), ids.offsets.to_numpy().astype(np.int64)
    new = np.flatnonzero(codes < 0)
    row = _by_pos(right)[-1 - codes[new]]
    size = np.ones(len(codes), np.int64)
    size[new] = np.diff(offs)[row]
    start = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(start[-1], np.int32)
    out[start[:-1][codes >= 0]] = codes[codes >= 0]
    out[gather(start[new], size[new])] = flat[gather(offs[row], size[new])]
    ends = start[np.concatenate([[0], np.cumsum(counts)])]
    return pa.table({"doc_id": left["docs"].combine_chunks().values, "ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out))})


def _total(left: pa.Table, right: pa.Table) -> pa.Table:
    counts, codes = left["counts"].combine_chunks().values.to_numpy(), _codes(left)
    size, new = np.ones(len(codes), np.int64), codes < 0
    size[new] = right["ids"].to_numpy()[_by_pos(right)][-1 - codes[new]]
    total = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
    return pa.table({"doc_id": left["docs"].combine_chunks().values, "n_tokens": pa.array(np.diff(total))})


def _word_shuffle(docs: DataFrame, key: str, text: str, path: str, lengths_only: bool, room: int = BLOCK_BYTES) -> DataFrame:
    rows = docs.select(F.col(key).cast("bigint"), F.coalesce(F.col(text), F.lit("")))
    blocks = materialise(rows.mapInArrow(_blocks(path, room), "block bigint, docs array<bigint>, counts array<int>, n bigint, codes binary, words array<binary>"), "blocks")
    words = blocks.select("block", F.posexplode("words").alias("pos", "word"))
    of = "int" if lengths_only else "array<int>"
    # each distinct word is encoded once; one that stands in very many blocks is split by the join's skew handling
    encoded = words.select("word").distinct().mapInArrow(_encode(path, lengths_only), f"word binary, ids {of}")
    ids = words.join(encoded, "word").select("block", "pos", "ids")
    out = ("doc_id bigint, n_tokens bigint", _total) if lengths_only else ("doc_id bigint, ids array<int>", _assemble)
    return blocks.select(F.col("block").alias("at"), "docs", "counts", "n", "codes").groupBy("at").cogroup(ids.groupBy("block")).applyInArrow(out[1], out[0])


def token_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids): the token ids of each text, without special tokens; their strings in a text are ordinary text.

    A null or an empty text has an empty list. Repeated rows give repeated results; an empty table gives an empty table;
    other columns are ignored. ``path`` is a rank file, by default the installed byte-level vocabulary of 50,256 ids.
    """
    return _word_shuffle(docs, key, text, path or vocabulary_path(), False)


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens): the number of token ids of each text, 0 for null and empty texts."""
    return _word_shuffle(docs, key, text, path or vocabulary_path(), True)


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, _ = vocabulary(path)
        table: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            table[i] = token
        size = np.array([len(t) for t in table])
        data, start = np.frombuffer(b"".join(table), np.uint8), np.concatenate([[0], np.cumsum(size)])[:-1]
        for b in batches:
            ids = b.column(1)
            flat = ids.values.to_numpy()
            bounds = ids.offsets.to_numpy()
            n = size[flat]
            text = data[gather(start[flat], n)].tobytes()
            ends = np.concatenate([[0], np.cumsum(n)])[bounds]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text[s:e].decode("utf-8", "replace") for s, e in zip(ends, ends[1:])], pa.string())], ["doc_id", "text"])

    return run


def token_texts(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): each id joined with its bytes in the vocabulary, a table of fixed size that every
    worker holds. An empty list gives an empty text."""
    ids = tokens.select(F.col("doc_id").cast("bigint"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return ids.mapInArrow(_decode(path or vocabulary_path()), "doc_id bigint, text string")
